"""Order-dependent operators that no hot key can pull into one task.

A window per key sorts all rows of a key in one task. Here the rows are range
partitioned by (key, order), numbered densely over all partitions, and looked at in
blocks of a fixed number of positions; only block heads travel between blocks.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators.lineage import materialise

BLOCK = 4096
_ROW_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in these bits


def dense_order(df: DataFrame, *order: str, pos: str = "pos") -> tuple[DataFrame, int]:
    """Number all rows 0..n-1 in ascending `order`. Returns the written table and n.

    One range shuffle. The driver sees one count per partition, nothing that grows
    with the rows. Ties are numbered in an arbitrary, but written and so fixed, order.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    mark = F.monotonically_increasing_id()
    t = materialise(df.repartitionByRange(n, *order).sortWithinPartitions(*order).withColumn("_m", mark), "order")
    part = F.shiftright("_m", _ROW_BITS)
    counts = {r[0]: r[1] for r in t.groupBy(part.alias("p")).count().collect()}
    offset, starts = 0, []
    for p in sorted(counts):
        starts.append((p, offset))
        offset += counts[p]
    if not starts:
        return t.withColumn(pos, F.lit(0).cast("long")).drop("_m"), 0
    first = F.broadcast(spark.createDataFrame(starts, "_p long, _start long"))
    within = F.col("_m").bitwiseAND((1 << _ROW_BITS) - 1)
    return t.join(first, part == F.col("_p")).withColumn(pos, F.col("_start") + within).drop("_m", "_p", "_start"), offset


def neighbour(df: DataFrame, pos: str, n: int, fields: list[str], out: str, after: bool = True, block: int = BLOCK, level: int = 0) -> DataFrame:
    """Add struct `out`: `fields` of the next (or previous) row by `pos`, over all rows.

    `n` is an upper bound of `pos`, so the number of block heads is known beforehand;
    they are treated the same way until one block holds them all.
    """
    step = F.lead if after else F.lag
    near: Column = F.struct(*[F.col(c).alias(c) for c in fields])
    if n <= block:
        return df.withColumn(out, step(near).over(Window.partitionBy(F.lit(0)).orderBy(pos)))
    at, row, far = f"__block{level}", f"__row{level}", f"__near{level}"
    df = df.withColumn(at, F.floor(F.col(pos) / block).cast("long")).withColumn(out, step(near).over(Window.partitionBy(at).orderBy(pos)))
    heads = df.groupBy(at).agg((F.min_by if after else F.max_by)(near, F.col(pos)).alias(row))
    heads = neighbour(heads, at, n // block + 1, [row], far, after, block, level + 1).select(at, F.col(f"{far}.{row}").alias(far))
    return df.join(heads, at, "left").withColumn(out, F.coalesce(out, far)).drop(at, far)
