import pandas as pd

from memspark.operators.references import OrphanState
from memspark.operators.temporal import supersede
from memspark.streaming import pipelines


def test_stream_of_facts_ends_as_the_batch_does(spark, tmp_path):
    rows = [("a", "f1", 5), ("a", "f2", 9), ("b", "g1", 1), ("a", "f3", 7), ("a", "f2", 9), ("b", "g2", 1)]
    for i, r in enumerate(rows):
        pd.DataFrame([r], columns=["key", "fact_id", "ts"]).to_parquet(tmp_path / f"in{i}.parquet")
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / f"in{i}.parquet").rename(tmp_path / "in" / f"{i}.parquet")
    s = spark.readStream.schema("key string, fact_id string, ts long").option("maxFilesPerTrigger", 1).option("latestFirst", "false").parquet(str(tmp_path / "in"))
    changes = pipelines.run_to_table(pipelines.supersession_changes(s), str(tmp_path / "out")).toPandas()
    last = {}
    for r in changes.itertuples():  # a fact is told as current first and as stale later
        if r.fact_id not in last or r.status == "stale":
            last[r.fact_id] = r.status
    batch = supersede(spark.createDataFrame([(*r, i) for i, r in enumerate(dict.fromkeys(rows))], "key string, fact_id string, ts long, n int"), ["key"], "fact_id", "ts", ["n"])
    assert last == {r.fact_id: r.status for r in batch.collect()}


def test_stream_of_references(spark, tmp_path):
    schema = "change string, ref_table string, ref_row string, ref_field string, kind string, key string, ref_ms long, arrived_ms long"
    (tmp_path / "in").mkdir()
    feed = [[("ref", "t", "r1", "f", "m", "a", 5, None), ("ref", "t", "r2", "f", "m", "b", 5, None)], [("parent", None, None, None, "m", "a", None, 1), ("parent", None, None, None, "m", "b", None, 1)], [("gone", None, None, None, "m", "b", None, None)]]
    for i, b in enumerate(feed):
        spark.createDataFrame(b, schema).coalesce(1).write.parquet(str(tmp_path / f"x{i}"))
        next((tmp_path / f"x{i}").glob("part*.parquet")).rename(tmp_path / "in" / f"{i}.parquet")
    s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    seen: list[tuple[int, int]] = []
    last: list[OrphanState] = []

    def done(state, number):
        seen.append((number, state.orphans().count()))
        last[:] = [state]

    feed_all = sorted((tmp_path / "in").glob("*.parquet"))
    later = tmp_path / "later"
    later.mkdir()
    feed_all[2].rename(later / "2.parquet")
    pipelines.keep_orphans(s, str(tmp_path / "log"), done).awaitTermination()
    assert seen == [(0, 2), (1, 0)]
    (later / "2.parquet").rename(tmp_path / "in" / "2.parquet")
    pipelines.keep_orphans(s, str(tmp_path / "log"), done).awaitTermination()  # started again: the state is read back
    assert seen[2:] == [(2, 1)]
    assert [tuple(r) for r in last[0].orphans().collect()] == [("t", "r2", "f", "deleted")]
