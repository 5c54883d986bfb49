"""History of changing attributes as presence bitmaps."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.operators.hierarchy import hierarchy
from memspark.operators.lineage import materialise
from memspark.operators.ordered import dense_order, neighbour

NEAR_LINKS = 4  # links walked up from rows that share attribute and time before their depths are asked for
WORD = 62  # snapshots of one bitmap word; its two other bits repeat the neighbours' nearest ones


def presence_words(snaps: DataFrame, attr: str, value: str, pos: str) -> DataFrame:
    """(attr, value, word, bits): one bit per snapshot at which the value was seen.

    Bit p (1..62) is the snapshot 62*word+p-1; bits 0 and 63 repeat the last bit of the
    word before and the first of the word after, so that runs need no look at other words.
    """
    w, p = F.floor(F.col(pos) / WORD).cast("long"), (F.col(pos) % WORD).cast("int")
    own = F.struct(w.alias("word"), (p + 1).alias("bit"))
    before = F.when((p == 0) & (w > 0), F.struct((w - 1).alias("word"), F.lit(WORD + 1).alias("bit")))
    after = F.when(p == WORD - 1, F.struct((w + 1).alias("word"), F.lit(0).alias("bit")))
    bits = F.explode(F.filter(F.array(own, before, after), lambda x: x.isNotNull()))
    return snaps.select(attr, value, bits.alias("b")).groupBy(attr, value, F.col("b.word").alias("word")).agg(F.expr("bit_or(shiftleft(1L, b.bit))").alias("bits"))


def run_starts(words: DataFrame, attr: str, value: str, pos: str) -> DataFrame:
    """(attr, value, pos) of the first snapshot of every run of consecutive bits."""
    starts = F.col("bits").bitwiseAND(F.bitwise_not(F.shiftleft("bits", 1)))
    at = F.explode(F.filter(F.sequence(F.lit(1), F.lit(WORD)), lambda i: F.call_function("shiftright", F.col("_s"), i).bitwiseAND(F.lit(1)) == 1))
    return words.withColumn("_s", starts).select(attr, value, "word", at.alias("_i")).select(attr, value, (F.col("word") * WORD + F.col("_i") - 1).alias(pos))


def parent_order(tied: DataFrame, links: DataFrame) -> DataFrame:
    """(attr, at, row, place): place of rows that share attribute and time; the greatest is last in parent order.

    `tied` has (attr, at, row), `links` one (row, up) per row. From every tied row the links
    are walked up, a frontier join per link, until another row of its group is met: it comes
    after that one. A group whose rows are tied by such meetings into one chain is settled,
    also inside a ring, where the shorter way counts. For groups that are not after
    NEAR_LINKS links the depths of the whole forest decide, and the walk goes on for rows of
    rings only, at most once around. What is still equal has equal places.
    """
    spark = tied.sparkSession
    tied = materialise(tied.distinct(), "tied")
    links = links.select(F.col("row").alias("node"), "up")
    group = ["attr", "at"]
    target = tied.select(*group, F.col("row").alias("node"), F.lit(True).alias("_met"))
    sizes = tied.groupBy(*group).agg(F.count("*").alias("k"))

    def walk(front: DataFrame, hits: DataFrame | None) -> tuple[DataFrame, DataFrame]:
        step = front.join(links, "node").filter("up is not null").select(*group, "start", F.col("up").alias("node"))
        step = materialise(step.join(F.broadcast(target), [*group, "node"], "left"), "walk")  # only tied rows, and one row per walker
        new = step.filter("_met").select(*group, "start", F.col("node").alias("met"))
        return step.filter("_met is null").drop("_met"), new if hits is None else hits.unionByName(new)

    def unsettled(hits: DataFrame) -> DataFrame:
        told = hits.filter("start <> met").groupBy(*group).agg(F.count_distinct("start").alias("n"), F.count_distinct("met").alias("m"))
        return sizes.join(told, group, "left").filter("coalesce(n, 0) <> k - 1 or coalesce(m, 0) <> k - 1").select(*group)

    front, hits = tied.select(*group, F.col("row").alias("start"), F.col("row").alias("node")), None
    for _ in range(NEAR_LINKS):
        front, hits = walk(front, hits)
        left = materialise(unsettled(hits), "left")
        if left.isEmpty():
            break
        front = front.join(left, group, "left_semi")
    depth = spark.createDataFrame([], "row string, depth long")
    if not left.isEmpty():
        tree = hierarchy(links.withColumnRenamed("up", "parent"), "node", "parent", with_path=False)
        depth = materialise(tied.join(left, group, "left_semi").join(tree.select(F.col("node").alias("row"), "depth"), "row").select("row", "depth").distinct(), "depths")
        front = front.join(depth.filter("depth < 0").select(F.col("row").alias("start")), "start", "left_semi")
        most = tree.filter("depth < 0").count()
        for _ in range(most):
            if front.isEmpty():
                break
            front, hits = walk(front.filter("node <> start"), hits)
    later = hits.filter("start <> met").select(*group, F.col("met").alias("row")).distinct().withColumn("_earlier", F.lit(True))
    place = F.struct(F.coalesce("depth", F.lit(0)).alias("depth"), F.when(F.col("_earlier"), 0).otherwise(1).alias("last"))
    return tied.join(depth, "row", "left").join(later, [*group, "row"], "left").select(*group, "row", place.alias("place"))


def attribute_history(changes: DataFrame, attribute: list[Column], value: Column, time: str, row: str, order: list[str], links: DataFrame | None = None) -> DataFrame:
    """Versions (row, attr, value, valid_from_ms, valid_to_ms) of every attribute, without gaps.

    `attribute` columns together name the attribute (hashed; null is a name like any
    other), `value` is compared for equality, `time` is bigint milliseconds. Rows with a
    null `value` or `time` are left out. Of rows with the same attribute and time the one
    that is greatest by (`order`..., `row`) counts; with `links`, one (row, up) per row, that
    is the last in `parent_order`, which is asked for such rows only. The snapshots of an attribute are its
    times in order; each value has one bit per snapshot, and every run of consecutive bits
    is a version, so a value that comes back opens a new one. valid_to_ms is the start of
    the attribute's next version, 0 for the last. Repeated rows change nothing; an empty
    table gives an empty history.

    No step holds all of an attribute in one task: snapshots are numbered by a range
    shuffle over (attribute, time) and compared in fixed blocks of positions.
    """
    name = F.md5(F.concat_ws("\u0001", *[F.coalesce(F.concat(F.lit("="), c), F.lit("0")) for c in attribute]))
    tie = [F.col(c).alias(f"tie{i}") for i, c in enumerate(order)]
    rows = changes.select(name.alias("attr"), value.alias("val"), F.col(time).alias("at"), F.col(row).alias("row"), *tie).filter("val is not null and at is not null")
    ties = [f"tie{i}" for i in range(len(order))]
    if links is not None:
        rows = materialise(rows, "changes")
        shared = rows.groupBy("attr", "at").agg((F.min("row") != F.max("row")).alias("_many")).filter("_many").select("attr", "at")
        tied = rows.select("attr", "at", "row").join(shared, ["attr", "at"], "left_semi")
        if not tied.isEmpty():
            rows, ties = rows.join(parent_order(tied, links), ["attr", "at", "row"], "left"), ["place", *ties]
    snaps = (
        rows.groupBy("attr", "at")
        .agg(F.max(F.struct(*ties, "row", "val")).alias("_r"))
        .select("attr", "at", F.col("_r.row").alias("row"), F.md5("_r.val").alias("vkey"), F.col("_r.val").alias("value"))
    )
    snaps, n = dense_order(snaps, "attr", "at")
    starts = run_starts(presence_words(snaps, "attr", "vkey", "pos"), "attr", "vkey", "pos").select("pos")
    versions = snaps.join(starts, "pos").select("attr", "at", "row", "value", "pos")
    nxt = F.col("_next")
    return neighbour(versions, "pos", n, ["attr", "at"], "_next").select(
        F.col("row").alias(row), "attr", "value", F.col("at").alias("valid_from_ms"), F.when(nxt["attr"] == F.col("attr"), nxt["at"]).otherwise(F.lit(0)).cast("long").alias("valid_to_ms"))
