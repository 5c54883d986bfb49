"""Row changes as new snapshots: upserts, inserts if absent, deletes, expiry."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def upsert(base: DataFrame, delta: DataFrame, keys: list[str]) -> DataFrame:
    """`base` with the rows of `delta` in place of those with the same keys; `delta` has one row per key."""
    return base.join(delta.select(*keys), keys, "left_anti").unionByName(delta.select(*base.columns))


def insert_if_absent(base: DataFrame, delta: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """`base` and the rows of `delta` whose keys it lacks, the first by `order` of each key."""
    first = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    new = delta.join(base.select(*keys), keys, "left_anti").withColumn("_n", first).filter("_n = 1").drop("_n")
    return base.unionByName(new.select(*base.columns))


def delete_cascade(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """`rows` without those whose key, or whose parent's key (before '::ct' of a chunk), is in `gone`."""
    dead = gone.select(F.col(gone.columns[0]).alias("_dead")).filter("_dead is not null").distinct()
    parent = F.regexp_replace(F.trim(key), "::ct[0-9]*$", "")
    return rows.withColumn("_k", F.trim(key)).withColumn("_p", parent).join(dead, F.col("_k") == F.col("_dead"), "left_anti").join(dead, F.col("_p") == F.col("_dead"), "left_anti").drop("_k", "_p")


def newest_list(rows: DataFrame, owner: str, item: str, order: str, keep: int) -> DataFrame:
    """(owner, items, n): the last `keep` distinct items of each owner, oldest first."""
    last = rows.groupBy(owner, item).agg(F.max(order).alias("_o"))
    rank = F.row_number().over(Window.partitionBy(owner).orderBy(F.desc("_o"), F.desc(item)))
    kept = last.withColumn("_r", rank).filter(F.col("_r") <= keep)
    items = F.transform(F.array_sort(F.collect_list(F.struct((-F.col("_r")).alias("o"), F.col(item).alias("i")))), lambda x: x["i"])
    return kept.groupBy(owner).agg(items.alias("items"), F.count("*").alias("n"))


def merge_lists(stored: DataFrame, new: DataFrame, keys: list[str], numbers: dict[str, Callable[[str], Column]], lists: list[str]) -> DataFrame:
    """Rows of `new` merged into `stored` by key: numbers combined, lists appended without repeats, stored items first.

    Both have one row per key, so a key has at most two rows here.
    """
    both = stored.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    kept = [F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("_new", F.col(c).alias("_x")))), lambda r: r["_x"]))).alias(c) for c in lists]
    return both.groupBy(*keys).agg(*[f(c).alias(c) for c, f in numbers.items()], *kept)


def marked_deleted(rows: DataFrame, key: str, gone: DataFrame) -> DataFrame:
    """`rows` with `deleted`: whether their key is in `gone` (a column of the same name, one row per key); null keys never are."""
    return rows.join(gone.select(key, F.lit(True).alias("_gone")), key, "left").withColumn("deleted", F.coalesce("_gone", F.lit(False))).drop("_gone")


def tombstones_for(rows: DataFrame, key: str, now_ms: int) -> DataFrame:
    """A tombstone for every deleted key: tombstone_id, target, timestamp_ms."""
    return rows.select(F.concat(F.lit("tombstone::"), F.col(key), F.lit("::"), F.lit(now_ms)).alias("tombstone_id"), F.col(key).alias("target"), F.lit(now_ms).cast("long").alias("timestamp_ms"))


def reset(spark: SparkSession, path: str, confirm: str) -> None:
    """Overwrite the table at `path` by an empty one; only with the phrase "delete everything"."""
    if confirm != "delete everything":
        raise ValueError("the reset was not confirmed")
    empty = spark.createDataFrame([], spark.read.parquet(path).schema)
    empty.write.mode("overwrite").parquet(path)


def write_tables(tables: dict[str, DataFrame], root: str, mode: str = "append") -> None:
    """Write several tables of one batch below `root`, in the order given."""
    for name, rows in tables.items():
        rows.write.mode(mode).parquet(f"{root}/{name}")
