"""Structured Streaming forms of the incremental operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from memspark.operators.references import OrphanState

CHANGES = "key string, fact_id string, status string, superseded_by string, valid_from_ms long, valid_to_ms long"


def metric_windows(stream: DataFrame, keys: list[str], time: str, value: str, width: str = "1 day", late: str = "1 day") -> DataFrame:
    """Count and sum per key and tumbling window, with a watermark on `time`."""
    w = F.window(time, width)
    return stream.withWatermark(time, late).groupBy(*keys, w).agg(F.count(value).alias("count"), F.sum(value).alias("sum")).select(*keys, F.unix_millis("window.start").alias("bucket_start_ms"), "count", "sum")


def supersession_changes(stream: DataFrame) -> DataFrame:
    """Change rows of facts (key, fact_id, ts) as they arrive; the state per key is the current fact.

    A newer fact makes the current one stale and becomes current; one that is not newer
    arrives stale; the current one again changes nothing. No watermark: late facts are kept.
    """

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else None
        out: list[tuple] = []
        for b in batches:
            for fact, ts in zip(b["fact_id"], b["ts"], strict=True):
                if now is None or ts > now[1] and fact != now[0]:
                    if now is not None:
                        out.append((key[0], now[0], "stale", fact, now[1], int(ts)))
                    now = (fact, int(ts))
                    out.append((key[0], fact, "current", None, int(ts), None))
                elif fact != now[0]:
                    out.append((key[0], fact, "stale", now[0], int(ts), now[1]))
        if now is not None:
            state.update(now)
        yield pd.DataFrame(out, columns=["key", "fact_id", "status", "superseded_by", "valid_from_ms", "valid_to_ms"]).astype({"valid_from_ms": "Int64", "valid_to_ms": "Int64"})

    return stream.groupBy("key").applyInPandasWithState(step, CHANGES, "fact_id string, ts long", "append", GroupStateTimeout.NoTimeout)


def keep_orphans(stream: DataFrame, checkpoint: str, done: Callable[[OrphanState, int], None]) -> StreamingQuery:
    """Folds a stream of changes into an `OrphanState` batch by batch.

    Rows have `change` (ref, parent or gone) and the columns of `OrphanState.advance`. The
    state lies below the checkpoint folder, so a stream that is started again goes on with
    it; stream batch b is batch b + 1 of the state, and one that is replayed overwrites
    itself. `done` gets the state after each batch, to report its snapshot.
    """

    def fold(batch: DataFrame, number: int) -> None:
        spark: SparkSession = batch.sparkSession
        of = lambda c: batch.filter(F.col("change") == c)
        done(OrphanState(spark, f"{checkpoint}/state", number).advance(of("ref"), of("parent"), of("gone")), number)

    return stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{checkpoint}/log").trigger(availableNow=True).start()


def run_to_table(df: DataFrame, path: str, mode: str = "append") -> DataFrame:
    """Run a stream over what is there now, keeping each batch's rows as Parquet, and read them back.

    Every batch has its own folder, which a replay overwrites; in complete mode there is one.
    """

    def save(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/rows/batch={0 if mode == 'complete' else number}")

    q = df.writeStream.foreachBatch(save).outputMode(mode).option("checkpointLocation", f"{path}/log").trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.read.schema(df.schema).option("recursiveFileLookup", "true").parquet(f"{path}/rows")
