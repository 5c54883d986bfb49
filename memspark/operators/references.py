"""References to records that do not exist: incrementally kept orphan state."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators.lineage import scratch_root

REF = ["ref_table", "ref_row", "ref_field", "kind", "key", "ref_ms"]
REF_SCHEMA = "ref_table string, ref_row string, ref_field string, kind string, key string, ref_ms long"
INDEX_SCHEMA = "kind string, key string, present boolean, arrived_ms long, gone boolean"
STATE_SCHEMA = REF_SCHEMA + ", status string, batch long"
SETTLED = "settled"
COMPACT = 16  # batches after which their files are made one


@dataclass(frozen=True)
class OrphanState:
    """Keyed state of all references seen so far, kept as files below `root`.

    Each batch writes what it changed, and only that: `index/batch-N`, the parent keys it
    brought or deleted, and `refs/batch-N`, the references whose status it set (missing,
    late, deleted, settled; settled ones are kept because a deletion reopens them). The
    state after batch N is the merge of the files up to N: for a parent key presence,
    first arrival and deletion; for a reference its last status. Every COMPACT batches the
    files are merged into `upto-N`. So work per batch is reading the state and
    writing the batch's own keys, and plans don't grow with the number of batches.

    A batch overwrites its own files and reads only earlier ones, so a batch that is run
    again after a crash ends the same; `open` on the same root goes on where it stopped.
    How rows are spread over batches does not change the final state.
    """

    spark: SparkSession
    root: str
    batch: int = 0

    @staticmethod
    def empty(spark: SparkSession, root: str | None = None) -> OrphanState:
        return OrphanState(spark, root or f"{scratch_root(spark)}/orphans-{uuid.uuid4().hex[:10]}")

    @staticmethod
    def open(spark: SparkSession, root: str) -> OrphanState:
        """The state after the last finished batch below `root`, the empty one if there is none."""
        return OrphanState(spark, root, max((n for _, n, ok in _parts(spark, f"{root}/refs") if ok), default=0))

    def _files(self, what: str) -> list[str]:
        parts = [(k, n) for k, n, ok in _parts(self.spark, f"{self.root}/{what}") if ok and n <= self.batch]
        base = max((n for k, n in parts if k == "upto"), default=0)
        return [f"{self.root}/{what}/upto-{base}"] * (base > 0) + [f"{self.root}/{what}/batch-{n}" for k, n in sorted(parts) if k == "batch" and n > base]

    def _read(self, what: str, schema: str) -> DataFrame:
        files = self._files(what)
        return self.spark.read.schema(schema).parquet(*files) if files else self.spark.createDataFrame([], schema)

    @property
    def index(self) -> DataFrame:
        """One row per parent key: whether a row is there, when the first arrived, whether it was deleted."""
        return _merged_index(self._read("index", INDEX_SCHEMA))

    @property
    def references(self) -> DataFrame:
        """One row per distinct reference, with its status."""
        return _last_status(self._read("refs", STATE_SCHEMA))

    def advance(self, refs: DataFrame | None = None, parents: DataFrame | None = None, deleted: DataFrame | None = None) -> OrphanState:
        """The state after a batch of new references, arriving parents and deletions.

        refs: ref_table, ref_row, ref_field, kind, key, ref_ms; parents: kind, key,
        arrived_ms; deleted: kind, key. New references probe the parent index, arriving
        parents resolve waiting references (or make them late, if younger than the
        reference), deletions reopen settled ones. A reference with a null key or row is
        none; a null time on either side is never late; a parent delivered twice counts from
        its first arrival; a reference delivered twice is one; other columns are ignored;
        empty batches are allowed.

        Only references whose key changed in this batch are looked at and written again. A
        hot key's references are on the left of joins with one row per key on the right,
        where adaptive execution splits them.
        """
        news = None
        if parents is not None:
            news = parents.select("kind", "key", F.lit(True).alias("present"), "arrived_ms", F.lit(False).alias("gone"))
        if deleted is not None:
            gone = deleted.select("kind", "key", F.lit(False).alias("present"), F.lit(None).cast("long").alias("arrived_ms"), F.lit(True).alias("gone"))
            news = gone if news is None else news.unionByName(gone)
        if news is None and refs is None:
            return self
        n = self.batch + 1
        news = self.spark.createDataFrame([], INDEX_SCHEMA) if news is None else news
        _merged_index(news.filter("key is not null")).write.mode("overwrite").parquet(f"{self.root}/index/batch-{n}")
        fresh = self.spark.read.schema(INDEX_SCHEMA).parquet(f"{self.root}/index/batch-{n}")
        index = _merged_index(self._read("index", INDEX_SCHEMA).unionByName(fresh)) if self.batch else fresh
        probe = None if refs is None else refs.filter("key is not null and ref_row is not null").select(*REF)
        if self.batch:
            again = self.references.join(fresh.select("kind", "key"), ["kind", "key"], "left_semi").select(*REF)
            probe = again if probe is None else probe.unionByName(again)
        probe = self.spark.createDataFrame([], REF_SCHEMA) if probe is None else probe
        late = F.col("arrived_ms") > F.col("ref_ms")
        status = F.when(F.col("gone"), "deleted").when(~F.coalesce("present", F.lit(False)), "missing").when(late, "late").otherwise(SETTLED)
        judged = probe.join(index, ["kind", "key"], "left").select(*REF, status.alias("status"), F.lit(n).cast("long").alias("batch"))
        judged.write.mode("overwrite").parquet(f"{self.root}/refs/batch-{n}")
        state = OrphanState(self.spark, self.root, n)
        if n % COMPACT == 0:
            state.index.write.mode("overwrite").parquet(f"{self.root}/index/upto-{n}")
            state.references.write.mode("overwrite").parquet(f"{self.root}/refs/upto-{n}")
        return state

    def orphans(self) -> DataFrame:
        """Distinct (ref_table, ref_row, ref_field, ref_status)."""
        return self.references.filter(F.col("status") != SETTLED).select("ref_table", "ref_row", "ref_field", F.col("status").alias("ref_status")).distinct()

    def snapshot(self) -> DataFrame:
        """Counts per table, field, UTC month of the referring row ('' if it has no time) and status."""
        month = F.coalesce(F.date_format(F.timestamp_millis("ref_ms"), "yyyy-MM"), F.lit(""))
        once = self.references.filter(F.col("status") != SETTLED).select("ref_table", "ref_row", "ref_field", "ref_ms", "status").distinct()
        return once.groupBy("ref_table", "ref_field", month.alias("ref_month"), F.col("status").alias("ref_status")).agg(F.count("*").alias("n_refs"))


def _merged_index(rows: DataFrame) -> DataFrame:
    return rows.groupBy("kind", "key").agg(F.max("present").alias("present"), F.min("arrived_ms").alias("arrived_ms"), F.max("gone").alias("gone"))


def _last_status(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*REF).agg(F.max(F.struct("batch", "status")).alias("_s")).select(*REF, "_s.status", "_s.batch")


def _parts(spark: SparkSession, folder: str) -> list[tuple[str, int, bool]]:
    """(kind, number, whether it was finished) of the batch folders below `folder`."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    if not fs.exists(path(folder)):
        return []
    found = [str(x.getPath().getName()).rsplit("-", 1) for x in fs.listStatus(path(folder))]
    return [(k, int(n), fs.exists(path(f"{folder}/{k}-{n}/_SUCCESS"))) for k, n in found]
