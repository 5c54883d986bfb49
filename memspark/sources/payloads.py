"""JSON payloads, one record a line: what is ingested."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# The fields of an ingested record and their types.
FIELDS = ("entity_id string, memory_id string, timestamp long, textual_content string, relations array<struct<subject: string, predicate: string, object: string>>, kind string, fact_key string, "
          "source_memory_id string, index_semantic boolean, enable_semantic_dedup boolean, enable_consolidation boolean, content_type string, fact_operation string, fact_confidence double, "
          "fact_subject string, fact_predicate string, fact_object string, expires_at long, metadata map<string, string>")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """Records of all JSON files below `path`; absent fields are null, broken lines are rows of nulls and left out."""
    return spark.read.schema(FIELDS).json(path).filter("memory_id is not null")


def stream_payloads(spark: SparkSession, path: str) -> DataFrame:
    return spark.readStream.schema(FIELDS).json(path).filter("memory_id is not null")


def write_payloads(rows: DataFrame, path: str) -> None:
    rows.write.json(path)
