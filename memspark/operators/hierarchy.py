"""Parent-child links to full hierarchies."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.operators.lineage import materialise


def hierarchy(nodes: DataFrame, node: str, parent: str, with_path: bool = True, wide_levels: int = 2) -> DataFrame:
    """Root, depth and path of every node of a forest of unknown depth.

    `nodes` has one row per node. Result: node, root_id, depth and, with `with_path`,
    path (array from root to node).

    Level-wise frontier joins from the roots: each round joins the waiting links with
    what is known of their upper end and so extends paths and depths. For the first
    `wide_levels` rounds a level is one link; after that a waiting link whose upper end
    is itself waiting takes over that link's upper end, so that a round's level is twice
    as wide as the last one's and a chain of depth d ends after about log2(d) rounds.
    A round in which no node is reached leaves only nodes whose links run in a ring, or
    hang below one: depth -1, root_id '' and path null.

    Nulls and unknown parents make a root; null nodes give no row; a node that is its own
    parent is a ring; an empty table gives an empty result. Other columns are ignored.
    A hot parent is on the left of each join, where adaptive execution splits it; each
    node has one row on the right.
    """
    base = nodes.select(F.col(node).alias("node"), F.col(parent).alias("up")).filter("node is not null")
    base = base.groupBy("node").agg(F.max("up").alias("up"))
    known = base.select(F.col("node").alias("up"), F.lit(True).alias("_known"))
    links = base.join(known, "up", "left").select("node", F.when(F.col("_known"), F.col("up")).alias("up"))
    seg = [F.array("node").alias("seg")] if with_path else []
    state = materialise(
        links.select("node", "up", F.when(F.col("up").isNull(), F.col("node")).alias("root_id"), F.lit(1).cast("long").alias("hops"),
                     F.when(F.col("up").isNull(), 0).cast("long").alias("depth"), *seg), "forest")
    done = state.filter("up is null").select("node", "root_id", "depth", *([F.col("seg").alias("path")] if with_path else []))
    wait = state.filter("up is not null").select("node", "up", "hops", *(["seg"] if with_path else []))
    parts, left, rounds = [done], wait.count(), 0
    while left:
        right = None
        for p in parts:
            p = p.select(F.col("node").alias("up"), F.col("root_id").alias("r_root"), F.col("depth").alias("r_depth"),
                         F.lit(None).cast("string").alias("r_up"), F.lit(None).cast("long").alias("r_hops"), *([F.col("path").alias("r_seg")] if with_path else []))
            right = p if right is None else right.unionByName(p)
        if rounds >= wide_levels:
            right = right.unionByName(wait.select(F.col("node").alias("up"), F.lit(None).cast("string").alias("r_root"), F.lit(None).cast("long").alias("r_depth"),
                                                  F.col("up").alias("r_up"), F.col("hops").alias("r_hops"), *([F.col("seg").alias("r_seg")] if with_path else [])))
        met = F.col("r_root").isNotNull()
        step = wait.join(right, "up", "left").select(
            "node", F.when(met, None).otherwise(F.coalesce("r_up", "up")).alias("up"), F.col("r_root").alias("root_id"),
            (F.col("hops") + F.when(met, 0).otherwise(F.coalesce("r_hops", F.lit(0)))).alias("hops"), (F.col("r_depth") + F.col("hops")).alias("depth"),
            *([F.when(F.col("r_seg").isNotNull(), F.concat("r_seg", "seg")).otherwise(F.col("seg")).alias("seg")] if with_path else []))
        state = materialise(step, "forest")
        new = state.filter("root_id is not null").select("node", "root_id", "depth", *([F.col("seg").alias("path")] if with_path else []))
        wait = state.filter("root_id is null").select("node", "up", "hops", *(["seg"] if with_path else []))
        still = wait.count()
        if still == left:
            break
        parts.append(new)
        left, rounds = still, rounds + 1
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    if left:
        ring = wait.select("node", F.lit("").alias("root_id"), F.lit(-1).cast("long").alias("depth"), *([F.lit(None).cast("array<string>").alias("path")] if with_path else []))
        out = out.unionByName(ring)
    return out


def ancestor_pairs(tree: DataFrame) -> DataFrame:
    """(ancestor, descendant, distance) from the paths of `hierarchy`; rings have none."""
    return tree.filter("depth > 0").select(F.posexplode("path").alias("place", "ancestor"), F.col("node").alias("descendant"), "depth").filter("place < depth").select(
        "ancestor", "descendant", (F.col("depth") - F.col("place")).alias("distance"))
