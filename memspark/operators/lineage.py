"""Cutting lineage: written tables in the folder the cluster names in
`spark.checkpoint.dir`, so a lost executor costs one re-read and no recomputation
from the sources. A folder of our own is used only where that setting is absent
(local tests)."""

from __future__ import annotations

import atexit
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_RUN = uuid.uuid4().hex[:12]
_used: dict[str, SparkSession] = {}


def scratch_root(spark: SparkSession) -> str:
    """Folder of this process below the shared checkpoint folder."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        base = "file://" + tempfile.gettempdir()
    root = f"{base.rstrip('/')}/memspark-{_RUN}"
    if root not in _used:
        _used[root] = spark
    return root


def materialise(df: DataFrame, name: str = "t") -> DataFrame:
    """Write `df` as Parquet to the shared scratch folder and read it back."""
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/{name}-{uuid.uuid4().hex[:10]}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def release(df: DataFrame) -> None:
    """Delete the files of a materialised table that nothing reads any more."""
    for f in {p.rsplit("/", 1)[0] for p in df.inputFiles()}:
        if f"memspark-{_RUN}/" in f:
            _delete(df.sparkSession, f)


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


@atexit.register
def clear_scratch() -> None:
    """Remove everything this process left in the scratch folder."""
    for root, spark in list(_used.items()):
        try:
            _delete(spark, root)
        except Exception:  # the session has ended: the folder belongs to the cluster's own cleaning
            pass
        _used.pop(root, None)
