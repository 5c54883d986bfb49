"""Dates in texts: Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DAY_MS = 86_400_000
# Names of months, and words that move a time by days.
MONTHS = {"jan": 1, "january": 1, "feb": 2, "february": 2, "mar": 3, "march": 3, "apr": 4, "april": 4, "may": 5, "jun": 6, "june": 6, "jul": 7, "july": 7, "aug": 8, "august": 8, "sep": 9, "sept": 9, "september": 9, "oct": 10, "october": 10, "nov": 11, "november": 11, "dec": 12, "december": 12}
MOVES = [("tomorrow", 1), ("yesterday", -1), ("next week", 7), ("last week", -7), ("past week", -7), ("next month", 30), ("last month", -30), ("past month", -30), ("today", 0)]


def civil_ms(year: Column, month: Column, day: Column) -> Column:
    """Epoch milliseconds of a day; a day beyond the month's end runs on into the next."""
    ms = (F.unix_date(F.make_date(year, month, F.lit(1))) + day - 1).cast("long") * DAY_MS
    return F.when(ms >= 0, ms)


def _number(t: Column, low: int, high: int) -> Column:
    n = F.when(t.rlike("^[0-9]{1,4}$"), t.try_cast("int"))
    return F.when(n.between(low, high), n)


def with_date_ms(df: DataFrame, c: str, reference_ms: str, out: str = "date_ms") -> DataFrame:
    """`df` with the epoch milliseconds of the first date its text `c` tells, null if it tells none.

    A date as year-month-day comes first, then the first month by name with a day before or
    behind it and a year behind; a bare "may" is no month; the year is the reference's if
    none is told. Else the first four-digit number from 1900 to 2200 is a year. The steps are
    columns behind an explode, so that each is worked out once for a row.
    """
    keep = df.columns
    low = F.lower(F.col(c))
    parts = F.transform(F.split(F.col(c), r"\s+"), lambda t: F.regexp_extract(t, r"^[^A-Za-z0-9-]*([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})[^A-Za-z0-9-]*$", 1))
    ymd = F.transform(F.filter(parts, lambda t: t != ""), lambda t: F.transform(F.split(t, "-"), lambda x: x.try_cast("int")))
    iso = F.get(F.filter(ymd, lambda x: x[0].between(1900, 2200) & x[1].between(1, 12) & x[2].between(1, 31)), F.lit(0))
    w = F.col("_x.w")
    words = F.struct(F.filter(F.split(low, "[^a-z0-9]+"), lambda t: t != "").alias("w"), iso.alias("iso"))
    df = df.select(*keep, F.explode(F.array(words)).alias("_x"))
    month = F.create_map(*[x for k, v in MONTHS.items() for x in (F.lit(k), F.lit(v))])
    plain = [k for k in MONTHS if k != "may"]
    number = r"^([1-9]|[0-2][0-9]|3[01]|0[1-9]|19[0-9]{2}|20[0-9]{2}|21[0-9]{2}|2200)$"  # a day or a year
    told = lambda i: F.coalesce(F.get(w, i + 1).rlike(number), F.lit(False)) | ((i > 0) & F.coalesce(_number(F.get(w, i - 1), 1, 31).isNotNull(), F.lit(False)))
    at = F.get(F.filter(F.sequence(F.lit(0), F.size(w)), lambda i: F.coalesce(F.get(w, i).isin(plain), F.lit(False)) | (F.coalesce(F.get(w, i) == "may", F.lit(False)) & told(i))), F.lit(0))
    year = F.get(F.filter(F.transform(w, lambda t: F.when(F.length(t) == 4, _number(t, 1900, 2200))), lambda y: y.isNotNull()), F.lit(0))
    df = df.select(*keep, "_x", F.explode(F.array(F.struct(at.alias("at"), year.alias("year")))).alias("_y"))
    i = F.col("_y.at")
    near = F.struct(F.try_element_at(month, F.get(w, i)).alias("m"), F.when(i > 0, F.get(w, i - 1)).alias("prev"), F.get(w, i + 1).alias("next"), F.get(w, i + 2).alias("then"))
    df = df.select(*keep, "_x", "_y", F.explode(F.array(near)).alias("_n"))
    day = _number(F.col("_n.next"), 1, 31)
    y = F.coalesce(F.when(day.isNotNull(), _number(F.col("_n.then"), 1900, 2200)).otherwise(_number(F.col("_n.next"), 1900, 2200)), F.year(F.timestamp_millis(F.col(reference_ms))))
    named = civil_ms(y, F.col("_n.m"), F.coalesce(_number(F.col("_n.prev"), 1, 31), day, F.lit(1)))
    d = F.col("_x.iso")
    found = F.when(d.isNotNull(), civil_ms(d[0], d[1], d[2])).when(F.col("_n.m").isNotNull(), named).when(F.col("_y.year").isNotNull(), civil_ms(F.col("_y.year"), F.lit(1), F.lit(1)))
    return df.select(*keep, found.alias(out))


def moved_ms(c: Column, reference_ms: Column) -> Column:
    """The reference moved by a word like yesterday; null without one."""
    low = F.lower(c)
    moved = F.lit(None).cast("long")
    for words, days in reversed(MOVES):
        moved = F.when(F.contains(low, F.lit(words)), reference_ms + days * DAY_MS).otherwise(moved)
    return moved
