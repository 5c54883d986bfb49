"""Small row-level helpers used by every operator."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Fixed value: white space that may stand around an id, as a character class.
BLANKS = "[\\s ​﻿]"


def clean_id(c: Column | str) -> Column:
    """The id without outer blanks; an empty one is null."""
    c = F.col(c) if isinstance(c, str) else c
    t = F.regexp_replace(c, f"^{BLANKS}+|{BLANKS}+$", "")
    return F.when(F.length(t) > 0, t)


def epoch_ms(c: Column | str) -> Column:
    """Epoch milliseconds of a value that may be in seconds (below 10^11)."""
    c = F.col(c) if isinstance(c, str) else c
    return F.when(c < F.lit(100_000_000_000), c * 1000).otherwise(c)


def one_per_key(df: DataFrame, key: str, *cols: str) -> DataFrame:
    """One row per key, the least by `cols`; partial aggregation comes before the shuffle."""
    return df.groupBy(key).agg(F.min(F.struct(*cols)).alias("_r")).select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])


def latest(df: DataFrame, key: str, order: str, *cols: str) -> DataFrame:
    """Per key the row with the greatest `order`; null order comes first, ties go to the greater row."""
    o = F.coalesce(F.col(order), F.lit(-(2**63)).cast("long"))
    return (
        df.groupBy(key)
        .agg(F.max(F.struct(o.alias("_o"), *cols)).alias("_r"))
        .select(key, *[F.col(f"_r.{c}").alias(c) for c in cols])
    )
