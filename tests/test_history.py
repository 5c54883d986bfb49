import random

from pyspark.sql import functions as F

from memspark.operators.history import attribute_history


def brute(rows):
    out = set()
    by = {}
    for row, attr, value, at, depth in rows:
        if value is not None and at is not None:
            by.setdefault(attr, {}).setdefault(at, []).append((depth, row, value))
    for times in by.values():
        versions, last = [], None
        for at in sorted(times):
            _, row, value = max(times[at])
            if value != last:
                versions.append((row, at))
            last = value
        out |= {(row, at, versions[i + 1][1] if i + 1 < len(versions) else 0) for i, (row, at) in enumerate(versions)}
    return out


def test_versions_against_replay(spark):
    rnd = random.Random(1)
    rows = [(f"c{i:04}", rnd.choice(["a", "b", "hot", "hot", None]), rnd.choice(["x", "y", "z", None]), rnd.choice([*range(60), None]), rnd.randrange(3)) for i in range(900)]
    rows += [(f"k{i:04}", "one", "xy"[i // 70 % 2], i, 0) for i in range(400)]  # runs longer than a bitmap word
    df = spark.createDataFrame([(*r, "clash", 5) for r in rows], "row string, attr string, val string, at long, depth int, pos string, word int")
    got = attribute_history(df, [F.col("attr")], F.col("val"), "at", "row", ["depth"])
    assert {(r.row, r.valid_from_ms, r.valid_to_ms) for r in got.collect()} == brute(rows)


def test_empty(spark):
    df = spark.createDataFrame([], "row string, attr string, val string, at long")
    assert attribute_history(df, [F.col("attr")], F.col("val"), "at", "row", []).count() == 0


def test_ties_in_parent_order(spark):
    """Rows of one time: chains, rings (the shorter way up counts), rows below a ring, cousins, long ways."""
    links = [("a1", None), ("a2", "a1"), ("b9", "b1"), ("b1", "b9x"), ("b9x", "b9"), ("c2", "c3"), ("c3", "c4"), ("c4", "c5"), ("c5", "c2"), ("c9", "c2"), ("c8", "c9"), ("d9", "a1"), ("d1", "a2")]
    links += [("e0", None), *[(f"e{i}", f"e{i - 1}") for i in range(1, 9)], *[(f"f{i}", f"f{(i - 1) % 13}") for i in range(13)]]
    tied = {"chain": (["a1", "a2"], "a2"), "ring": (["b9", "b1"], "b9"), "below": (["c8", "c9"], "c8"), "three": (["c2", "c3", "c4"], "c2"), "cousins": (["d9", "d1"], "d1"), "far": (["e0", "e8"], "e8"), "round": (["f1", "f7"], "f7"), "same": (["a1"], "a1")}
    rows = [(r, k, r, 5) for k, (rs, _) in tied.items() for r in rs] * 2
    df = spark.createDataFrame(rows, "row string, attr string, val string, at long")
    got = attribute_history(df, [F.col("attr")], F.col("val"), "at", "row", [], spark.createDataFrame(links, "row string, up string"))
    assert sorted(r.value for r in got.collect()) == sorted(w for _, w in tied.values())
