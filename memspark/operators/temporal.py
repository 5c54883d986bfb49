"""Facts that supersede one another, and their state at a point in time."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators.lineage import materialise
from memspark.operators.ordered import dense_order

BLOCK = 4096  # rows of a key and task that are looked at together


def supersede(facts: DataFrame, key: list[str], fact_id: str, ts: str, arrival: list[str]) -> DataFrame:
    """Versions of facts registered in order of `arrival`, per key.

    The newest fact so far is current; one that is newer makes it stale (valid_to is the
    newcomer's time); one that is not newer than the current one arrives stale. Adds
    status, superseded_by, valid_from_ms and valid_to_ms. Each fact_id comes once per key;
    rows with a null time are left out; of equal times the first to arrive stays.
    """
    # Rows are numbered over (key, arrival); what a row has to know of those before and behind
    # it in its key is put together from its block of positions and from one row per key and block.
    df, _ = dense_order(materialise(facts.filter(F.col(ts).isNotNull()), "facts"), *key, *arrival)
    df = df.withColumn("_b", F.floor(F.col("pos") / BLOCK).cast("long"))
    group = [*key, "_b"]
    inside, blocks = Window.partitionBy(*group).orderBy("pos"), Window.partitionBy(*key).orderBy("_b")
    before, behind = inside.rowsBetween(Window.unboundedPreceding, -1), inside.rowsBetween(1, Window.unboundedFollowing)
    earlier, later = blocks.rowsBetween(Window.unboundedPreceding, -1), blocks.rowsBetween(1, Window.unboundedFollowing)
    same = lambda a, b: [F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in group]
    tops = df.groupBy(*group).agg(F.max(ts).alias("_top")).withColumn("_past", F.max("_top").over(earlier)).drop("_top")
    df = df.alias("a").join(tops.alias("b"), same("a", "b"), "left").select("a.*", "b._past")
    df = df.withColumn("_max", F.greatest(F.col("_past"), F.max(ts).over(before)))
    df = materialise(df.withColumn("_sets", F.col("_max").isNull() | (F.col(ts) > F.col("_max"))).drop("_past", "_max"), "setters")
    setter = F.struct(F.col(fact_id).alias("id"), F.col(ts).alias("ts"))
    ends = df.filter("_sets").groupBy(*group).agg(F.min_by(setter, "pos").alias("_first"), F.max_by(setter, "pos").alias("_last"))
    every = df.select(*group).distinct().alias("a").join(ends.alias("b"), same("a", "b"), "left").select(*[F.col(f"a.{c}").alias(c) for c in group], "b._first", "b._last")
    around = every.select(*group, F.first("_first", ignorenulls=True).over(later).alias("_then"), F.last("_last", ignorenulls=True).over(earlier).alias("_was"))
    df = df.alias("a").join(around.alias("b"), same("a", "b"), "left").select("a.*", "b._then", "b._was")
    setter = F.when(F.col("_sets"), setter)
    df = df.withColumn("_next", F.coalesce(F.first(setter, ignorenulls=True).over(behind), "_then")).withColumn("_held", F.coalesce(F.last(setter, ignorenulls=True).over(before), "_was"))
    by = F.when(F.col("_sets"), F.col("_next")).otherwise(F.col("_held"))
    return df.withColumn("status", F.when(by.isNull(), "current").otherwise("stale")).withColumn("superseded_by", by["id"]).withColumn("valid_from_ms", F.col(ts)).withColumn(
        "valid_to_ms", by["ts"]).drop("_sets", "_next", "_held", "_then", "_was", "_b", "pos")


def as_of(versions: DataFrame, t: int) -> DataFrame:
    """Versions in force at `t`."""
    return versions.filter((F.col("valid_from_ms") <= t) & (F.col("valid_to_ms").isNull() | (F.col("valid_to_ms") > t)))


def stale_at(versions: DataFrame, fact_id: str, t: int | None = None) -> DataFrame:
    """Distinct ids that are stale now, or not in force at `t`."""
    if t is None:
        return versions.filter("status = 'stale'").select(fact_id).distinct()
    return versions.filter((F.col("valid_to_ms") <= t) | (F.coalesce("valid_from_ms", F.lit(0)) > t)).select(fact_id).distinct()


def status_edges(versions: DataFrame, fact_id: str) -> DataFrame:
    """(source, target, edge_type): superseded_by from each stale fact to the one in force, and supersedes back."""
    stale = versions.filter("status = 'stale'").select(F.col(fact_id).alias("a"), F.col("superseded_by").alias("b"))
    there = stale.select(F.col("a").alias("source"), F.col("b").alias("target"), F.lit("superseded_by").alias("edge_type"))
    return there.unionByName(stale.select(F.col("b").alias("source"), F.col("a").alias("target"), F.lit("supersedes").alias("edge_type")))
