"""Graph operators over an edge table (source, target, edge_type, weight)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def both_ways(edges: DataFrame, *cols: str) -> DataFrame:
    """(node, other, cols...): every edge seen from both ends."""
    out = edges.select(F.col("source").alias("node"), F.col("target").alias("other"), *cols)
    back = edges.select(F.col("target").alias("node"), F.col("source").alias("other"), *cols)
    return out.unionByName(back).filter("node is not null and other is not null")


def neighbours(edges: DataFrame, seeds: DataFrame, k: int = 50, order: str = "timestamp_ms") -> DataFrame:
    """(node, other, edge_id, edge_type, rank): up to k newest neighbours of each seed, without 'default' edges."""
    near = both_ways(edges.filter("edge_type <> 'default'"), "edge_id", "edge_type", order).join(seeds.select(F.col(seeds.columns[0]).alias("node")).distinct(), "node", "left_semi")
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc_nulls_last(order), "edge_id", "other"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k).select("node", "other", "edge_id", "edge_type", "rank")


def cluster_scores(links: DataFrame, seeds: DataFrame, depth: int = 2, fade: float = 0.6) -> DataFrame:
    """(seed, node, score): sum over all undirected walks of up to `depth` links, each link fading the score.

    Walks are pre-aggregated per (seed, node) after every step, so a step joins distinct
    ends and not walks. Walks back to the seed count.
    """
    near = both_ways(links).groupBy("node", "other").agg(F.count("*").alias("n"))
    front = seeds.select(F.col(seeds.columns[0]).alias("seed")).filter("seed is not null").distinct().withColumn("node", F.col("seed")).withColumn("score", F.lit(1.0))
    found = None
    for _ in range(depth):
        front = front.join(near, "node").groupBy("seed", F.col("other").alias("node")).agg(F.sum(F.col("score") * F.col("n") * fade).alias("score"))
        found = front if found is None else found.unionByName(front)
    return found.groupBy("seed", "node").agg(F.sum("score").alias("score"))


def heavy_neighbours(edges: DataFrame, k: int) -> DataFrame:
    """Up to k heaviest neighbours of every node, by weight."""
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "other", "edge_type"))
    near = both_ways(edges, "edge_type", "weight").groupBy("node", "other", "edge_type").agg(F.max("weight").alias("weight"))
    return near.withColumn("rank", rank).filter(F.col("rank") <= k)


def preference_chains(edges: DataFrame) -> DataFrame:
    """(entity, preferred, cause): what an entity prefers beside what has caused it."""
    a = edges.filter("edge_type = 'prefers'").select(F.col("source").alias("entity"), F.col("target").alias("preferred")).distinct()
    b = edges.filter("edge_type = 'caused_by'").select(F.col("source").alias("entity"), F.col("target").alias("cause")).distinct()
    return a.join(b, "entity")


def causal_sequences(edges: DataFrame) -> DataFrame:
    """(root_cause, intermediate, final_effect): two leads_to edges in a row."""
    e = edges.filter("edge_type = 'leads_to'").select("source", "target").distinct()
    a = e.select(F.col("source").alias("root_cause"), F.col("target").alias("intermediate"))
    return a.join(e.select(F.col("source").alias("intermediate"), F.col("target").alias("final_effect")), "intermediate")


def of_type(edges: DataFrame, edge_type: str | None) -> DataFrame:
    """Edges of a type, or all without one."""
    return edges if edge_type is None else edges.filter(F.col("edge_type") == edge_type)


def bounded_walk(edges: DataFrame, seeds: DataFrame, depth: int, breadth: int) -> DataFrame:
    """(seed, node, depth): nodes within `depth` links of each seed, of every node the first `breadth` neighbours by name.

    The neighbours are cut before the walk, so a hub adds at most `breadth` rows to a step.
    """
    rank = F.row_number().over(Window.partitionBy("node").orderBy("other"))
    near = both_ways(edges).distinct().withColumn("r", rank).filter(F.col("r") <= breadth).select("node", "other")
    front = seeds.select(F.col(seeds.columns[0]).alias("seed")).filter("seed is not null").distinct().withColumn("node", F.col("seed"))
    found = None
    for k in range(1, depth + 1):
        front = front.join(near, "node").select("seed", F.col("other").alias("node")).distinct()
        step = front.withColumn("depth", F.lit(k))
        found = step if found is None else found.unionByName(step)
    return found.filter("seed <> node").groupBy("seed", "node").agg(F.min("depth").alias("depth"))


def edge_cluster_scores(edges: DataFrame, seeds: DataFrame, raised: tuple[str, ...] = (), most: int = 50, fade: float = 0.6) -> DataFrame:
    """(seed, node, score): weights of the edges one link from each seed and, faded, of those behind them.

    Of every node its `most` heaviest edges count, so a hub gives at most so many rows; types
    in `raised` weigh one and a half. A node reached several times is walked on from once.
    """
    rank = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("weight"), "edge_id", "other"))
    near = both_ways(edges, "edge_id", "edge_type", "weight").withColumn("r", rank).filter(F.col("r") <= most)
    near = near.select("node", "other", (F.col("weight") * F.when(F.lower("edge_type").isin(*raised), 1.5).otherwise(1.0)).alias("w"))
    start = seeds.select(F.col(seeds.columns[0]).alias("seed")).filter("seed is not null").distinct()
    first = start.withColumn("node", F.col("seed")).join(near, "node").select("seed", F.col("other").alias("node"), "w")
    behind = first.select("seed", "node").distinct().join(near, "node").select("seed", F.col("other").alias("node"), (F.col("w") * fade).alias("w"))
    return first.unionByName(behind).groupBy("seed", "node").agg(F.sum("w").alias("score"))


# How two names of one text are related by their kinds, and endings that tell a kind.
RELATED = {("PER", "ORG"): "associated_with", ("PER", "LOC"): "located_in", ("ORG", "LOC"): "headquartered_in", ("PER", "PER"): "knows"}
KIND_ENDINGS = {"ORG": " (Studio|Labs|Logistics|Bakery)$", "LOC": " (Square|Harbour)$"}


def related_pairs(names: Column) -> Column:
    """Array of (source, predicate, target) for every two names of an array of which a rule relates the kinds."""

    def kind(c: Column) -> Column:
        out = F.lit("PER")
        for k, p in KIND_ENDINGS.items():
            out = F.when(c.rlike(p), k).otherwise(out)
        return out

    def pair(a: Column, b: Column) -> Column:
        word = F.lit(None).cast("string")
        for (x, y), p in RELATED.items():
            word = F.when((kind(a) == x) & (kind(b) == y), p).otherwise(word)
        return F.struct(a.alias("source"), word.alias("predicate"), b.alias("target"))

    pairs = F.transform(names, lambda a, i: F.transform(F.slice(names, i + 2, F.size(names)), lambda b: pair(a, b)))
    return F.filter(F.flatten(pairs), lambda p: p["predicate"].isNotNull())
