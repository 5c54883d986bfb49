"""Metric aggregation: ranges and fixed-width buckets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.operators.lineage import materialise
from memspark.operators.ordered import dense_order

# Bucket widths in milliseconds; a month is 30 days and a year 365.
WIDTHS = {"hour": 3_600_000, "day": 86_400_000, "week": 604_800_000, "month": 2_592_000_000, "year": 31_536_000_000}


def summary(value: str) -> list[Column]:
    """sum, count, avg, min, max (0 if there is none) and population stddev (0 for up to one value)."""
    v = F.col(value)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return [zero(F.sum(v)).alias("sum"), F.count(v).alias("count"), zero(F.avg(v)).alias("avg"), zero(F.min(v)).alias("min"), zero(F.max(v)).alias("max"), zero(F.stddev_pop(v)).alias("stddev")]


def usable(df: DataFrame, value: str) -> DataFrame:
    return df.filter(F.col(value).isNotNull() & ~F.isnan(F.col(value).cast("double")))


def aggregate_range(df: DataFrame, keys: list[str], time: str, value: str, start: int | None = None, end: int | None = None) -> DataFrame:
    """`summary` per key over start <= time <= end; null and NaN values are left out."""
    df = usable(df, value)
    if start is not None:
        df = df.filter(F.col(time) >= start)
    if end is not None:
        df = df.filter(F.col(time) <= end)
    return df.groupBy(*keys).agg(*summary(value))


def aggregate_bucketed(df: DataFrame, keys: list[str], time: str, value: str, width: str, both_ends: bool = False) -> DataFrame:
    """`summary` per key and bucket of `width`, aligned to the epoch; empty buckets give no row.

    With `both_ends` a bucket's end belongs to it too, so a value just there counts twice.
    """
    ms = WIDTHS[width]
    at = F.floor(F.col(time) / ms).cast("long") * ms
    df = usable(df, value).filter(F.col(time).isNotNull())
    if both_ends:
        edge = F.when(F.col(time) % ms == 0, F.array(at, at - ms)).otherwise(F.array(at))
        df = df.withColumn("bucket_start_ms", F.explode(edge))
    else:
        df = df.withColumn("bucket_start_ms", at)
    return df.groupBy(*keys, "bucket_start_ms").agg(*summary(value)).withColumn("bucket_end_ms", F.col("bucket_start_ms") + ms)


def nearest_rank(df: DataFrame, key: str, value: str, shares: list[float]) -> DataFrame:
    """Nearest-rank percentiles: the value at place ceil(n p), per key, and the count; exact.

    Rows are numbered by a range shuffle over (key, value), so a hot key lies in many tasks;
    of each key only its first place and count are looked up, and the rows at the wanted
    places. Null keys are a key like any other; null and NaN values are left out.
    """
    rows, _ = dense_order(materialise(usable(df, value).select(key, value), "values"), key, value)
    spans = materialise(rows.groupBy(key).agg(F.min("pos").alias("_0"), F.count("*").alias("count")), "spans")
    at = [(F.col("_0") + F.ceil(F.col("count") * p).cast("long") - 1).alias(f"p{round(p * 100)}") for p in shares]
    wanted = spans.select("count", key, F.explode(F.create_map(*[x for p, c in zip(shares, at, strict=True) for x in (F.lit(f"p{round(p * 100)}"), c)])).alias("_name", "pos"))
    found = wanted.join(rows.select("pos", F.col(value).alias("_v")), "pos")
    return found.groupBy(key).agg(*[F.max(F.when(F.col("_name") == f"p{round(p * 100)}", F.col("_v"))).alias(f"p{round(p * 100)}") for p in shares], F.max("count").alias("count"))
