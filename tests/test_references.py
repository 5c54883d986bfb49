import itertools

from memspark.operators.references import REF_SCHEMA, OrphanState

REFS = [("t", "r1", "f", "m", "a", 10), ("t", "r2", "f", "m", "b", 10), ("t", "r3", "f", "m", "c", None), ("t", "r4", "f", "m", "zz", 10), ("t", "r5", "f", "m", None, 10), ("t", None, "f", "m", "zz", 1), ("t", "r1", "f", "m", "a", 10),
        ("u", "r6", "f", "n", "a", 10)]
PARENTS = [("m", "a", 5), ("m", "b", 20), ("m", "b", 25), ("m", "c", 99), ("m", "d", 1), ("m", None, 1)]
GONE = [("m", "a"), ("m", "a"), ("m", "q")]
WANT = [("t", "r1", "f", "deleted"), ("t", "r2", "f", "late"), ("t", "r4", "f", "missing"), ("u", "r6", "f", "missing")]


def frames(spark):
    return {"refs": spark.createDataFrame(REFS, REF_SCHEMA), "parents": spark.createDataFrame(PARENTS, "kind string, key string, arrived_ms long"), "deleted": spark.createDataFrame(GONE, "kind string, key string")}


def test_all_at_once_and_in_any_order(spark, rows):
    x = frames(spark)
    assert rows(OrphanState.empty(spark).advance(**x).orphans()) == WANT
    for order in itertools.permutations(x):
        s = OrphanState.empty(spark)
        for k in order:
            s = s.advance(**{k: x[k]})
        assert rows(s.orphans()) == WANT


def test_arrival_resolves_and_deletion_reopens(spark, rows):
    one = spark.createDataFrame([("t", "r", "f", "m", "k", 10)], REF_SCHEMA)
    s = OrphanState.empty(spark).advance(refs=one)
    assert rows(s.snapshot()) == [("t", "f", "1970-01", "missing", 1)]
    s = s.advance(parents=spark.createDataFrame([("m", "k", 3)], "kind string, key string, arrived_ms long"))
    assert s.orphans().count() == 0
    s = s.advance(deleted=spark.createDataFrame([("m", "k")], "kind string, key string"))
    assert rows(s.orphans()) == [("t", "r", "f", "deleted")]
    assert OrphanState.empty(spark).advance().orphans().count() == 0


def test_many_batches_stay_small(spark, rows):
    """Each batch writes only its own keys; files are merged now and then; a replayed batch changes nothing."""
    s = OrphanState.empty(spark)
    for i in range(18):
        s = s.advance(refs=spark.createDataFrame([("t", f"r{i}", "f", "m", f"k{i % 5}", 10)], REF_SCHEMA), parents=spark.createDataFrame([("m", f"k{i - 9}", 1)], "kind string, key string, arrived_ms long"))
    assert rows(s.orphans()) == [] and s.references.count() == 18
    assert len(s._files("refs")) == 3 and s._files("refs")[0].endswith("upto-16")
    replay = OrphanState(spark, s.root, 17).advance(refs=spark.createDataFrame([("t", "r17", "f", "m", "zz", 10)], REF_SCHEMA))
    assert rows(replay.orphans()) == [("t", "r17", "f", "missing")]
    assert OrphanState.open(spark, s.root).batch == 18 and OrphanState.open(spark, s.root + "/none").batch == 0
