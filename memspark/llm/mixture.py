"""Mixing sources to target weights: hierarchical budgets and seeded token prefixes."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators.lineage import materialise

# Fixed value: how this vocabulary's tokenizer splits text before merging bytes.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
MAX_LEAVES = 100_000
PREFIX_ROWS = 4096  # rows of a hash bucket aimed at; a leaf's last bucket is ordered in one task
_encoders: dict[int, object] = {}


def token_counts(docs: DataFrame, keep: list[str], text: str, tokenizer: str) -> DataFrame:
    """`keep` columns and n_tokens, the tokens of the whole text; null texts have 0. `tokenizer` is a vocabulary file."""
    with open(tokenizer, "rb") as f:
        ranks = f.read()

    def encoder():
        key = hash(ranks)
        if key not in _encoders:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, ranks.splitlines())}
            _encoders[key] = tiktoken.Encoding("mixture", pat_str=PATTERN, mergeable_ranks=table, special_tokens={})
        return _encoders[key]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder().encode_ordinary
        for b in batches:
            n = [len(encode(t)) if t else 0 for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(n, pa.int64())], names=[*b.schema.names[:-1], "n_tokens"])

    rows = docs.select(*keep, F.col(text).alias("_text"))
    schema = rows.select(*keep).schema.add("n_tokens", "long")
    return rows.mapInArrow(run, schema)


@dataclass
class Node:
    """A node of the weight tree: a leaf has a capacity, an inner node children by name."""

    weight: float = 0.0
    tokens: int = 0
    capacity: float = 0.0
    children: dict[str, Node] = field(default_factory=dict)
    budget: float = 0.0

    def room(self) -> float:
        return sum(c.room() for c in self.children.values()) if self.children else self.capacity

    def fill(self, budget: float) -> None:
        """Give `budget` out: by weight among the children, what one cannot take to its siblings.

        A child's room is what its whole subtree can take, so a shortage is made up by
        siblings of the short node and reaches an ancestor only when all of them are full.
        """
        self.budget = min(budget, self.room())
        if not self.children:
            return
        left, open_ = self.budget, {k: c for k, c in self.children.items() if c.room() > 0}
        given = dict.fromkeys(self.children, 0.0)
        while open_ and left > 1e-9:
            total = sum(c.weight for c in open_.values())
            share = {k: left * (c.weight / total if total > 0 else 1 / len(open_)) for k, c in open_.items()}
            full = [k for k, c in open_.items() if given[k] + share[k] >= c.room() - 1e-9]
            for k in full or share:
                take = min(share[k], open_[k].room() - given[k])
                given[k] += take
                left -= take
            if not full:
                break
            open_ = {k: c for k, c in open_.items() if k not in full}
        for k, c in self.children.items():
            c.fill(given[k])


def plan_tree(leaves: list[tuple[tuple[str, ...], int]], shares: dict[tuple[str, ...], float], repeats: dict[str, int], total: float | None = None, temper: float = 1.0) -> Node:
    """The weight tree with the token budget of each node.

    `leaves` are (path, available tokens); `shares` the weights of nodes by path prefix,
    siblings without one weigh as many as their tokens to the power `temper` (below 1, small
    siblings get more than their tokens' share, and run short first); `repeats` caps how often
    the records below a first-level node are used. Without `total` it is the largest at which
    every first-level node meets its share. A node of weight 0 gets nothing.
    """
    root = Node()
    for path, tokens in leaves:
        node = root
        for depth in range(1, len(path) + 1):
            node = node.children.setdefault(path[depth - 1], Node(weight=shares.get(path[:depth], 0.0)))
            node.tokens += tokens
        node.capacity += tokens * repeats.get(path[0], 1)

    def weigh(node: Node, path: tuple[str, ...]) -> None:
        for k, c in node.children.items():
            if (*path, k) not in shares:
                c.weight = float(c.tokens) ** temper
            weigh(c, (*path, k))

    weigh(root, ())
    whole = sum(n.weight for n in root.children.values())
    if total is None:
        total = min((n.room() * whole / n.weight for n in root.children.values() if n.weight > 0), default=0.0)
    for n in root.children.values():
        if n.weight <= 0:
            n.children, n.capacity = {}, 0.0
    root.fill(total)
    return root


def plan_budgets(leaves: list[tuple[tuple[str, ...], int]], shares: dict[tuple[str, ...], float], repeats: dict[str, int], total: float | None = None, temper: float = 1.0) -> dict[tuple[str, ...], float]:
    """Token budget of each leaf path of `plan_tree`."""
    out: dict[tuple[str, ...], float] = {}

    def walk(node: Node, path: tuple[str, ...]) -> None:
        if not node.children:
            out[path] = node.budget
        for k, c in node.children.items():
            walk(c, (*path, k))

    walk(plan_tree(leaves, shares, repeats, total, temper), ())
    return out


def leaf_tokens(counted: DataFrame, levels: list[str]) -> list[tuple[tuple[str, ...], int, int]]:
    """(path, tokens, records) of every leaf, null names as ''; at most MAX_LEAVES of them are planned."""
    named = counted.filter("n_tokens > 0").groupBy(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in levels])
    found = named.agg(F.sum("n_tokens").alias("t"), F.count("*").alias("n")).limit(MAX_LEAVES + 1).collect()
    if len(found) > MAX_LEAVES:
        raise ValueError("too many leaves to plan on the driver")
    return [(tuple(r[c] for c in levels), r.t, r.n) for r in found]


def budget_report(counted: DataFrame, levels: list[str], shares: dict[tuple[str, ...], float], repeats: dict[str, int], total: float, temper: float = 1.0) -> DataFrame:
    """(level, path, wanted, room, budget, short, taken_over) of every node of the tree for a stated total.

    wanted: the node's part, by weight, of its parent's budget; room: what its records can
    give under their cap; short: what it lacks; taken_over: what it got beyond its part
    because siblings were short.
    """
    first = {p[0] for p in shares if shares[p] > 0}
    leaves = [(p, t) for p, t, _ in leaf_tokens(counted, levels) if p[0] in first]
    out: list[tuple] = []

    def walk(node: Node, path: tuple[str, ...]) -> None:
        whole = sum(c.weight for c in node.children.values())
        for k, c in node.children.items():
            wanted = (total if not path else node.budget) * (c.weight / whole if whole else 0.0)
            out.append((len(path) + 1, " > ".join((*path, k)), wanted, float(c.room()), c.budget, max(0.0, wanted - c.budget), max(0.0, c.budget - wanted)))
            walk(c, (*path, k))

    walk(plan_tree(leaves, shares, repeats, total, temper), ())
    return counted.sparkSession.createDataFrame(out, "level int, path string, wanted double, room double, budget double, short double, taken_over double")


def mixture(counted: DataFrame, record: str, levels: list[str], shares: dict[tuple[str, ...], float], repeats: dict[str, int], total: float | None = None, temper: float = 1.0, seed: int = 11) -> DataFrame:
    """(record, levels..., n_tokens, n_uses): how often each record is drawn, 0 left out.

    `counted` has n_tokens per record. Leaves are the distinct values of `levels`, null as
    ''; records whose first level has no share, with no tokens or a null id are not used;
    records with the same id are drawn apart. A leaf with A tokens and budget B is used
    floor(B / A) whole times and, in one more epoch, up to the rest: its records in the
    order of a seeded hash, as long as they bring the sum closer to B. No record is used
    more than its cap. The order is found by hash buckets, whose sums are ordered per leaf
    and of which only the last is ordered by record, so no task holds a leaf.
    """
    spark = counted.sparkSession
    first = sorted({p[0] for p in shares if shares[p] > 0})
    rows = counted.select(record, *[F.coalesce(F.col(c), F.lit("")).alias(c) for c in levels], "n_tokens").filter(F.col(record).isNotNull() & (F.col("n_tokens") > 0) & F.col(levels[0]).isin(first))
    rows = materialise(rows, "counted")
    found = leaf_tokens(rows, levels)
    budgets = plan_budgets([(p, t) for p, t, _ in found], shares, repeats, total, temper)
    leaves = []
    for path, tokens, n in found:
        b = budgets.get(path, 0.0)
        whole = min(int(b // tokens), repeats.get(path[0], 1))
        rest = b - whole * tokens if whole < repeats.get(path[0], 1) else 0.0
        leaves.append((*path, whole, rest, max(1, n // PREFIX_ROWS)))
    schema = ", ".join([f"{c} string" for c in levels] + ["whole int", "rest double", "buckets long"])
    plan = F.broadcast(spark.createDataFrame(leaves, schema))
    mark = F.xxhash64(F.lit(seed), F.col(record).cast("string"))
    rows = rows.join(plan, levels).withColumn("_h", mark).withColumn("_b", F.pmod("_h", F.col("buckets")))
    sums = rows.groupBy(*levels, "_b").agg(F.sum("n_tokens").alias("_t"))
    before = F.sum("_t").over(Window.partitionBy(*levels).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))
    sums = sums.withColumn("_before", F.coalesce(before, F.lit(0))).select(*levels, "_b", "_t", "_before")
    rows = rows.join(sums, [*levels, "_b"])
    edge = (F.col("_before") < F.col("rest")) & (F.col("_before") + F.col("_t") > F.col("rest"))
    extra: Column = (F.col("_before") + F.col("_t") <= F.col("rest")).cast("int")
    run = F.sum("n_tokens").over(Window.partitionBy(*levels, "_b").orderBy("_h", record).rowsBetween(Window.unboundedPreceding, -1))
    last = rows.filter(edge).withColumn("_sofar", F.col("_before") + F.coalesce(run, F.lit(0))).withColumn("_extra", (F.col("_sofar") + F.col("n_tokens") / 2 <= F.col("rest")).cast("int"))
    drawn = rows.filter(~edge).withColumn("_extra", extra).unionByName(last.drop("_sofar"))
    return drawn.withColumn("n_uses", F.col("whole") + F.col("_extra")).filter("n_uses > 0").select(record, *levels, "n_tokens", "n_uses")


def shares_report(drawn: DataFrame, source: str, weights: DataFrame) -> DataFrame:
    """Per source of `weights` (source, target_share, max_repeats): records, tokens, actual share, most uses."""
    got = drawn.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_records"), F.sum(F.col("n_tokens") * F.col("n_uses")).alias("tokens"), F.max("n_uses").alias("most_uses"))
    out = weights.select("source", "target_share", "max_repeats").join(got, "source", "left").na.fill(0, ["n_records", "tokens", "most_uses"])
    whole = F.sum("tokens").over(Window.partitionBy())  # one row per source
    return out.withColumn("actual_share", F.try_divide("tokens", whole))
