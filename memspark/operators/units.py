"""Quantities in different units, brought to common ones."""

from __future__ import annotations

import itertools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Unit names of each quantity, with factor and offset to its common unit
# (millimetre, milligram, thousandth of a degree Celsius, millisecond, byte).
UNITS: dict[str, list[tuple[tuple[str, ...], float, float]]] = {
    "distance": [
        (("mile", "miles", "mi"), 1609344.0, 0.0), (("km", "kms", "kilometer", "kilometers", "kilometre", "kilometres"), 1000000.0, 0.0),
        (("m", "meter", "meters", "metre", "metres"), 1000.0, 0.0), (("ft", "foot", "feet"), 304.8, 0.0), (("yd", "yds", "yard", "yards"), 914.4, 0.0),
        (("cm", "cms", "centimeter", "centimeters", "centimetre", "centimetres"), 10.0, 0.0),
        (("mm", "mms", "millimeter", "millimeters", "millimetre", "millimetres"), 1.0, 0.0), (("in", "ins", "inch", "inches"), 25.4, 0.0)],
    "weight": [
        (("lb", "lbs", "pound", "pounds"), 453592.0, 0.0), (("oz", "ozs", "ounce", "ounces"), 28349.5, 0.0), (("g", "gs", "gram", "grams"), 1000.0, 0.0),
        (("mg", "mgs", "milligram", "milligrams"), 1.0, 0.0), (("ton", "tons", "tonne", "tonnes"), 1e9, 0.0), (("kg", "kgs", "kilogram", "kilograms"), 1e6, 0.0)],
    "temperature": [
        (("f", "fahrenheit", "degf"), 5000.0 / 9.0, -160000.0 / 9.0), (("k", "kelvin", "kelvins", "degk"), 1000.0, -273150.0), (("c", "celsius", "degc"), 1000.0, 0.0)],
    "duration": [
        (("hour", "hours", "hr", "hrs", "h"), 3.6e6, 0.0), (("minute", "minutes", "min", "mins"), 60000.0, 0.0), (("second", "seconds", "sec", "secs", "s"), 1000.0, 0.0),
        (("ms", "millisecond", "milliseconds"), 1.0, 0.0), (("day", "days"), 8.64e7, 0.0)],
    "data": [
        (("kb", "kbs", "kilobyte", "kilobytes"), 1024.0, 0.0), (("mb", "mbs", "megabyte", "megabytes"), 1048576.0, 0.0), (("gb", "gbs", "gigabyte", "gigabytes"), 1073741824.0, 0.0),
        (("tb", "tbs", "terabyte", "terabytes"), 1099511627776.0, 0.0), (("byte", "bytes", "b"), 1.0, 0.0)],
}
# Number words that multiply the unit behind them.
MULTIPLIERS = {"hundred": 100.0, "thousand": 1000.0, "million": 1000000.0}


def unit_table(spark: SparkSession) -> DataFrame:
    """(unit_quantity, unit_name, scale, offset): `UNITS` as rows, about a hundred of them whatever the data."""
    rows = [(q, n, float(s), float(o)) for q, units in UNITS.items() for names, s, o in units for n in names]
    return spark.createDataFrame(rows, "unit_quantity string, unit_name string, scale double, offset double")


def unit_words(text: Column) -> Column:
    """Words of a unit's text: lower case, no dots, brackets or degree signs, no "approx"."""
    t = F.lower(F.translate(text, "()[]{}.,;°_~", "            "))
    t = F.regexp_replace(t, "\\bdeg(ree|rees)?\\b|\\bapprox(imately)?\\b", " ")
    return F.filter(F.split(F.trim(t), "\\s+"), lambda w: w != "")


def declared_unit(unit: Column, label: Column) -> Column:
    """Struct (name, multiplier) of the unit a reading declares.

    The unit's text counts if it is not blank; otherwise the last word of the label, if it
    has at least two words. "in" in front of another unit is dropped, a number word in
    front multiplies; the words left are one name, whatever their number.
    """
    blank = F.coalesce(F.trim(unit), F.lit("")) == ""
    last = F.regexp_extract(F.trim(label), "[\\s_]([^\\s_]+)$", 1)
    name = F.array_join(unit_words(F.when(blank, last).otherwise(unit)), " ")
    name = F.regexp_replace(name, "^in (?=.)", "")
    word = F.regexp_extract(name, f"^({'|'.join(MULTIPLIERS)}) .", 1)
    many = F.lit(1.0)
    for w, m in MULTIPLIERS.items():
        many = F.when(word == w, m).otherwise(many)
    name = F.translate(F.regexp_replace(name, f"^({'|'.join(MULTIPLIERS)}) (?=.)", ""), " ", "")
    return F.struct(name.alias("name"), many.alias("multiplier"))


def solve_units(df: DataFrame, identity: dict[str, int], candidates: dict[str, list[tuple[str, float]]], tolerance: float = 0.02) -> DataFrame:
    """Find each row's units from a physical identity among its columns.

    `identity` gives the power of each value column in a product that must be 1 once all
    are in common units (mass = density * volume: mass 1, density -1, volume -1);
    `candidates` the units (name, scale) each may be in; a scale may also be a column.
    For every row the combination of units with the least |log residual| is chosen. Adds
    `<column>_unit`, `<column>_common`, `log_residual` and `unit_status`: solved;
    ambiguous, if another combination of different scales fits within `tolerance` of the
    best; unsolved, if the best residual exceeds `tolerance`, or if a value is null, NaN,
    infinite or not positive (units and common values are then null).

    The combinations are literals of one expression, so a row's solution needs no shuffle
    and no Python; their number is the product of the candidates' numbers.
    """
    cols = list(identity)
    combos = list(itertools.product(*[range(len(candidates[c])) for c in cols]))
    scale = lambda c, i: s if isinstance(s := candidates[c][i][1], Column) else F.lit(float(s))
    usable = F.lit(True)
    for c in cols:
        v = F.col(c)
        usable = usable & v.isNotNull() & ~F.isnan(v) & (v > 0) & (v < float("inf"))
    log_values = sum((F.log(F.col(c)) * identity[c] for c in cols), F.lit(0.0))
    entries = []
    for k, combo in enumerate(combos):
        logs = [F.log(scale(c, i)) * identity[c] for c, i in zip(cols, combo, strict=True)]
        entries.append(F.struct(F.abs(F.col("__log_values") + sum(logs, F.lit(0.0))).alias("residual"), F.lit(k).alias("combo"), F.array(*[scale(c, i) for c, i in zip(cols, combo, strict=True)]).alias("scales")))
    df = df.withColumn("__log_values", F.when(usable, log_values)).withColumn("__fits", F.array_sort(F.array(*entries)))
    best = F.col("__fits")[0]
    rival = F.exists("__fits", lambda x: (x["residual"] <= best["residual"] + tolerance) & (x["scales"] != best["scales"]))
    solved = F.col("__log_values").isNotNull() & (best["residual"] <= tolerance)
    df = df.withColumn("log_residual", F.when(F.col("__log_values").isNotNull(), best["residual"])).withColumn(
        "unit_status", F.when(~F.coalesce(solved, F.lit(False)), "unsolved").when(rival, "ambiguous").otherwise("solved"))
    for j, c in enumerate(cols):
        names = F.array(*[F.lit(candidates[c][combo[j]][0]) for combo in combos])
        df = df.withColumn(f"{c}_unit", F.when(solved, names[best["combo"]])).withColumn(f"{c}_common", F.when(solved, F.col(c) * best["scales"][j]))
    return df.drop("__log_values", "__fits")


def common_readings(metrics: DataFrame) -> DataFrame:
    """(content_hash, quantity, common_value, common_int) of readings with a value and a known unit.

    A reading stands alone: no second column of it is tied to its value by a physical
    identity, so `solve_units` has nothing to solve and the unit is read where it is
    declared, in `unit` or, if that is blank, in the label, and looked up. Rows with the
    same content_hash are one (the least); a null hash, a null or NaN value and labels of
    other quantities give no row. A common value beyond the range of bigint has a null
    common_int.
    """
    one = metrics.select(F.trim("content_hash").alias("content_hash"), "label", "unit", "value").filter("content_hash is not null and content_hash <> ''")
    one = one.groupBy("content_hash").agg(F.min(F.struct("label", "unit", "value")).alias("r")).select("content_hash", "r.label", "r.unit", "r.value")
    one = one.filter(F.col("value").isNotNull() & ~F.isnan("value"))
    one = one.withColumn("quantity", F.lower(F.regexp_extract(F.trim("label"), "^([^\\s_]+)", 1))).filter(F.col("quantity").isin(*UNITS))
    one = one.withColumn("declared", declared_unit(F.col("unit"), F.col("label")))
    known = F.broadcast(unit_table(metrics.sparkSession))
    one = one.join(known, (F.col("quantity") == F.col("unit_quantity")) & (F.col("declared.name") == F.col("unit_name")))
    common = F.col("value") * F.col("declared.multiplier") * F.col("scale") + F.col("offset")
    return one.select("content_hash", "quantity", common.alias("common_value")).withColumn("common_int", F.round("common_value").try_cast("long"))
