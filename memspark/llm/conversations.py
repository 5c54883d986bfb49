"""Rebuilding conversations from message rows."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators.lineage import materialise
from memspark.operators.ordered import BLOCK, dense_order, neighbour
from memspark.operators.rows import clean_id

# Spellings of the four roles.
ROLES = {"user": "user", "human": "user", "usr": "user", "assistant": "assistant", "ai": "assistant", "bot": "assistant", "agent": "assistant", "model": "assistant",
         "system": "system", "sys": "system", "tool": "tool", "function": "tool"}
# Fixed value: white space and zero-width spaces, which make a message blank.
_SPACE = "[\\p{IsWhite_Space}​]"


def bare(text: Column) -> Column:
    """The text without outer white or zero-width space; null if nothing is left."""
    t = F.regexp_replace(text, f"^{_SPACE}+|{_SPACE}+$", "")
    return F.when(F.length(t) > 0, t)


def role_of(speaker: Column, text: Column) -> Column:
    """user, assistant, system, tool, or null; from the text's start if the speaker is blank."""
    names = F.create_map(*itertools.chain.from_iterable((F.lit(k), F.lit(v)) for k, v in ROLES.items()))
    said = F.lower(bare(speaker))
    lead = F.lower(F.regexp_extract(text, f"(?i)^({'|'.join(sorted(ROLES, key=len, reverse=True))})\\s*[:>]", 1))
    return F.try_element_at(names, F.coalesce(said, lead))


def _fragments(rows: DataFrame, order: list[str]) -> DataFrame:
    """Rows in order of delivery with their export fragment (pos of its first row), their place in it and the messages around.

    A fragment is a run of a session's rows in which each row's index follows the last
    one's, or of rows without an index, of one export where that is told; blocks of
    positions cut it at the latest.
    """
    placed, _ = dense_order(materialise(rows, "turns"), "session", *order, "idx", "msg")
    placed = placed.withColumn("_b", F.floor(F.col("pos") / BLOCK))
    w = Window.partitionBy("_b").orderBy("pos")
    follows = (F.lag("session").over(w) == F.col("session")) & F.lag("export").over(w).eqNullSafe(F.col("export")) & (F.lag("idx").over(w) + 1).eqNullSafe(F.col("idx"))
    placed = placed.withColumn("_f", F.coalesce(follows, F.lit(False)))
    placed = placed.withColumn("fragment", F.max(F.when(~F.col("_f"), F.col("pos"))).over(w)).withColumn("before", F.when(F.col("_f"), F.lag("msg").over(w)))
    after = F.when(F.lead("_f").over(w), F.lead("msg").over(w))
    return placed.withColumn("after", after).withColumn("place", F.col("pos") - F.col("fragment")).drop("_b", "_f", "export", *order)


def place_fragments(rows: DataFrame) -> DataFrame:
    """`rows` of `_fragments`, those without an index given one by overlap where that is unambiguous.

    A fragment without indexes overlaps a placed one if a suffix of one is a prefix of the
    other (or one holds the other), that is, if two neighbouring message hashes of it
    (one, if it has but one) stand at one place only among the placed fragments of the
    session. All its overlaps have to tell the same place; it is then placed itself, and
    others by it, round by round. A session of which no row has an index begins with its
    first delivered fragment, and is counted from 0 in the end. What is not reached keeps no
    index.
    """
    loose = rows.filter("idx is null")
    if loose.isEmpty():
        return rows
    known, loose = rows.filter("idx is not null"), materialise(loose, "loose")
    bare_sessions = loose.select("session").distinct().join(known.select("session").distinct(), "session", "left_anti")
    seeds = loose.join(bare_sessions, "session", "left_semi").groupBy("session").agg(F.min("fragment").alias("fragment")).select("session", "fragment", F.lit(0).alias("offset"))
    told = materialise(seeds, "placed")
    while True:
        at = loose.join(told, ["session", "fragment"]).withColumn("idx", (F.col("place") + F.col("offset")).cast("int")).drop("offset")
        fixed = known.select("session", "idx", "msg", "after").unionByName(at.select("session", "idx", "msg", "after"))
        pairs = fixed.select("session", "idx", "msg", "after").unionByName(fixed.select("session", "idx", "msg", F.lit(None).cast("binary").alias("after")))
        spots = pairs.groupBy("session", "msg", "after").agg(F.min("idx").alias("i0"), F.max("idx").alias("i1")).filter("i0 = i1")
        open_ = loose.join(told, ["session", "fragment"], "left_anti").filter("after is not null or place = 0 and before is null")
        votes = open_.join(spots.select("session", "msg", F.col("after").alias("_a"), "i0"), ["session", "msg"]).filter(F.col("after").eqNullSafe(F.col("_a")))
        offset = votes.groupBy("session", "fragment").agg(F.min(F.col("i0") - F.col("place")).alias("offset"), F.max(F.col("i0") - F.col("place")).alias("o1")).filter("offset = o1")
        new = materialise(offset.select("session", "fragment", F.col("offset").cast("int").alias("offset")), "placed")
        if new.isEmpty():
            break
        told = told.unionByName(new)
    least = at.join(bare_sessions, "session", "left_semi").groupBy("session").agg(F.min("idx").alias("_least"))
    at = at.join(least, "session", "left").withColumn("idx", F.col("idx") - F.coalesce("_least", F.lit(0))).drop("_least")
    rest = loose.join(told, ["session", "fragment"], "left_anti")
    return known.unionByName(at.select(known.columns)).unionByName(rest)


def message_nodes(rows: DataFrame, session: str, index: str, speaker: str, text: str, order: list[str], keep_text: bool = False, export: str | None = None) -> tuple[DataFrame, int]:
    """Overlap graph of the sessions' export fragments, one row per message node.

    A message is its index and the hash of its trimmed text. Two fragments overlap where a
    suffix of one is a prefix of the other, that is, where they hold the same messages; these
    become one node, so a session's fragments lie in one graph whose edges lead from a
    message to the one behind it in a fragment. Fragments without indexes get theirs from
    such overlaps first (`place_fragments`).
    Node columns: session, idx, msg, role (null if none or more than one can be told),
    n_rows, n_before and n_after (distinct messages before and behind it in fragments, 2 for
    more), text, and pos, the node's place in the order (session, idx, msg).
    """
    t = bare(F.col(text))
    by = [f"o_{i}" for i in range(len(order))]
    rows = rows.select(clean_id(session).alias("session"), F.col(index).cast("int").alias("idx"), *[F.col(c).alias(o) for o, c in zip(by, order, strict=True)],
                       (F.col(export).cast("string") if export else F.lit("")).alias("export"), role_of(F.col(speaker), t).alias("role"), F.unhex(F.md5(t)).alias("msg"), *([t.alias("text")] if keep_text else [])).filter("session is not null and msg is not null")
    placed = place_fragments(_fragments(rows, by))
    key = lambda c: F.when(F.col(c).isNotNull(), F.xxhash64(c))
    nodes = placed.groupBy("session", "idx", "msg").agg(
        F.min("role").alias("_r0"), F.max("role").alias("_r1"), F.count("*").alias("n_rows"), *[x for c in ("before", "after") for x in (F.min(key(c)).alias(f"{c}0"), F.max(key(c)).alias(f"{c}1"))],
        *([F.min("text").alias("text")] if keep_text else []))
    ways = [F.when(F.col(f"{c}0").isNull(), 0).when(F.col(f"{c}0") == F.col(f"{c}1"), 1).otherwise(2).alias(f"n_{c}") for c in ("before", "after")]
    nodes = nodes.select("session", "idx", "msg", F.when(F.col("_r0") == F.col("_r1"), F.col("_r0")).alias("role"), "n_rows", *ways, *(["text"] if keep_text else []))
    return dense_order(materialise(nodes, "nodes"), "session", "idx", "msg")


def judge(nodes: DataFrame, n: int) -> DataFrame:
    """One row per session with a node: n_turns, n_rows, n_contigs and `reason`, null if it is whole.

    From a node an edge leads to what is behind it in fragments, and, where fragments end
    and begin, to the next index. A node with two ways on or back, or two nodes at one
    index, make the path ambiguous; a node that leads nowhere before the last one is a
    break, after which a new contig begins. A path without either is merged as it is.
    Reasons, the first that holds: unplaced (no index, and no overlap tells one), conflict,
    gap (or a start other than 0 and 1), role, no_user, no_assistant, first_not_user,
    no_reply.
    """
    walk = neighbour(nodes, "pos", n, ["session", "idx"], "_p", after=False)
    same = F.col("_p.session") == F.col("session")
    talk = nodes.filter(F.col("role").isin("user", "assistant"))
    talk = neighbour(talk.select("session", "role", "pos"), "pos", n, ["session", "role"], "_n")
    alone = (F.col("role") == "user") & ~F.coalesce((F.col("_n.session") == F.col("session")) & (F.col("_n.role") == "assistant"), F.lit(False))
    replies = talk.groupBy("session").agg(F.max(alone).alias("no_reply"))
    count = lambda c: F.count(F.when(c, 1))
    lead = F.struct("pos", F.coalesce("role", F.lit("?")).alias("role"))
    told = walk.groupBy("session").agg(
        F.count("*").alias("n_turns"), F.sum("n_rows").alias("n_rows"), F.min("idx").alias("first_idx"),
        count(F.col("idx").isNull()).alias("n_unplaced"), count((same & (F.col("_p.idx") == F.col("idx"))) | (F.col("n_before") > 1) | (F.col("n_after") > 1)).alias("n_conflicts"),
        count(same & (F.col("_p.idx") + 1 < F.col("idx"))).alias("n_breaks"), count(F.col("role").isNull()).alias("n_unknown"),
        count(F.col("role") == "user").alias("n_user"), count(F.col("role") == "assistant").alias("n_assistant"),
        F.min(F.when(F.coalesce(F.col("role") != "system", F.lit(True)), lead))["role"].alias("first_role"))
    told = told.join(replies, "session", "left")
    reason = (
        F.when(F.col("n_unplaced") > 0, "unplaced").when(F.col("n_conflicts") > 0, "conflict").when((F.col("n_breaks") > 0) | ~F.col("first_idx").isin(0, 1), "gap")
        .when(F.col("n_unknown") > 0, "role").when(F.col("n_user") == 0, "no_user").when(F.col("n_assistant") == 0, "no_assistant")
        .when(F.col("first_role") != "user", "first_not_user").when(F.coalesce("no_reply", F.lit(False)), "no_reply"))
    return told.select("session", "n_turns", "n_rows", (F.col("n_breaks") + 1).alias("n_contigs"), reason.alias("reason"))


def conversation_report(rows: DataFrame, session: str, index: str, speaker: str, text: str, order: list[str], export: str | None = None) -> DataFrame:
    """`judge` for every session of `rows`; sessions without any message have reason empty.

    Blank messages are absent; rows with a null session are ignored; deliveries of the same
    index and trimmed text are one message, whose role is the one role its rows name; an
    empty table gives an empty report; other columns are ignored. Sessions are never held
    in one task: rows are numbered by a range shuffle and compared in fixed blocks.
    """
    nodes, n = message_nodes(rows, session, index, speaker, text, order, export=export)
    everyone = rows.select(clean_id(session).alias("session")).filter("session is not null").distinct()
    r = everyone.join(judge(nodes, n), "session", "left")
    return r.withColumn("reason", F.when(F.col("n_turns").isNull(), "empty").otherwise(F.col("reason"))).na.fill(0, ["n_turns", "n_rows", "n_contigs"])


def conversations(rows: DataFrame, session: str, index: str, speaker: str, text: str, order: list[str], export: str | None = None) -> DataFrame:
    """Whole conversations as ordered turns: session, turn_no (from 0), role, text."""
    nodes, n = message_nodes(rows, session, index, speaker, text, order, keep_text=True, export=export)
    whole = judge(nodes, n).filter("reason is null").select("session")
    first = nodes.groupBy("session").agg(F.min("idx").alias("_0"))
    return nodes.join(whole.join(first, "session"), "session").select("session", (F.col("idx") - F.col("_0")).alias("turn_no"), "role", "text")
