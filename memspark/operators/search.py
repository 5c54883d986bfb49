"""Lexical search, rank fusion, exact vector search and selection."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions.text import similarity_tokens

K1, B = 1.2, 0.75  # fixed values of the ranking formula
LEAST_IDF = 1e-6
MAX_QUERY_VECTORS = 20_000


def postings(docs: DataFrame, doc: str, text: str) -> DataFrame:
    """(doc, term, tf, len): one row per document and term."""
    toks = docs.select(F.col(doc).alias("doc"), similarity_tokens(F.col(text)).alias("t")).filter(F.size("t") > 0)
    return toks.select("doc", F.size("t").alias("len"), F.explode("t").alias("term")).groupBy("doc", "len", "term").agg(F.count("*").alias("tf"))


def _best(hits: DataFrame, sizes: DataFrame, queries: list[tuple[str, list[str]]], k: int) -> DataFrame:
    """(query, doc, score, rank) from the postings of the asked terms and one row of (docs, mean)."""
    spark = hits.sparkSession
    wanted = F.broadcast(spark.createDataFrame([(q, t) for q, ts in queries for t in dict.fromkeys(ts)], "query string, term string"))
    df = F.broadcast(hits.groupBy("term").agg(F.count("*").alias("df")))  # as many rows as the batch has terms
    idf = F.greatest(F.log((F.col("docs") - F.col("df") + 0.5) / (F.col("df") + 0.5)), F.lit(LEAST_IDF))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    scored = hits.join(df, "term").join(wanted, "term").crossJoin(F.broadcast(sizes)).groupBy("query", "doc").agg(F.round(F.sum(part), 6).alias("score"))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "doc"))
    return scored.withColumn("rank", rank).filter(F.col("rank") <= k)


def bm25(docs: DataFrame, doc: str, text: str, queries: list[tuple[str, list[str]]], k: int = 10) -> DataFrame:
    """(query, doc, score, rank): the k best documents of each query (any of its terms), by BM25.

    Document count, frequencies and mean length are over all documents. `queries` is a
    batch of a few term lists; only their terms' postings are shuffled. Ties go to the
    lesser document; null and empty texts are no documents.
    """
    sizes = docs.select(F.size(similarity_tokens(F.col(text))).alias("n")).filter("n > 0").agg(F.count("*").alias("docs"), F.avg("n").alias("mean"))
    terms = sorted({t for _, ts in queries for t in ts})
    return _best(postings(docs, doc, text).filter(F.col("term").isin(terms)), sizes, queries, k)


@dataclass(frozen=True)
class TextIndex:
    """Postings stored below `root`, a folder for each batch, in ranges of terms, so that a search reads only the row groups of its terms.

    A batch brings documents or takes some away; a document that is brought again replaces
    itself. `compacted` writes what is left as one batch.
    """

    spark: SparkSession
    root: str
    batches: tuple[tuple[str, str], ...] = ()

    def _write(self, rows: DataFrame, kind: str) -> TextIndex:
        name = f"{kind}-{len(self.batches)}"
        rows.write.mode("overwrite").parquet(f"{self.root}/{name}")
        return TextIndex(self.spark, self.root, (*self.batches, (kind, name)))

    def add(self, docs: DataFrame, doc: str, text: str) -> TextIndex:
        """With the documents of `docs`, one row per document; null and empty texts are none, but take away what was there."""
        out = self._write(docs.select(F.col(doc).alias("doc")).distinct(), "gone") if self.batches else self
        p = postings(docs, doc, text)
        return out._write(p.repartitionByRange("term", "doc").sortWithinPartitions("term"), "added")

    def remove(self, docs: DataFrame) -> TextIndex:
        """Without the documents whose id is in the only column of `docs`."""
        return self._write(docs.select(F.col(docs.columns[0]).alias("doc")).distinct(), "gone")

    def postings(self, terms: list[str] | None = None) -> DataFrame:
        """(doc, len, term, tf) of what is there, of the asked terms only: the filter reaches the scan of each batch."""
        out = None
        for kind, name in self.batches:
            rows = self.spark.read.parquet(f"{self.root}/{name}")
            if kind == "added":
                rows = rows if terms is None else rows.filter(F.col("term").isin(terms))
                out = rows if out is None else out.unionByName(rows)
            elif out is not None:
                out = out.join(rows, "doc", "left_anti")
        return out

    def compacted(self) -> TextIndex:
        return TextIndex(self.spark, f"{self.root}/compacted")._write(self.postings().repartitionByRange("term", "doc").sortWithinPartitions("term"), "added")

    def with_sizes(self) -> TextIndex:
        """The index with its number of documents and their mean length stored beside it."""
        lengths = self.postings().groupBy("doc").agg(F.max("len").alias("n"))
        lengths.agg(F.count("*").alias("docs"), F.avg("n").alias("mean")).write.mode("overwrite").parquet(f"{self.root}/sizes")
        return self

    def search(self, queries: list[tuple[str, list[str]]], k: int = 10) -> DataFrame:
        """As `bm25`, from the stored postings; `with_sizes` has to be called after the last change."""
        terms = sorted({t for _, ts in queries for t in ts})
        return _best(self.postings(terms), self.spark.read.parquet(f"{self.root}/sizes"), queries, k)


def fuse(lanes: DataFrame, item: str, lane: str, rank: str, k: float = 60.0, weights: dict[str, float] | None = None) -> DataFrame:
    """(item, score): reciprocal rank fusion, sum of weight / (k + rank); lanes of weight <= 0 are skipped."""
    w = F.lit(1.0)
    for name, v in (weights or {}).items():
        w = F.when(F.col(lane) == name, F.lit(v)).otherwise(w)
    return lanes.withColumn("_w", w).filter("_w > 0").groupBy(item).agg(F.sum(F.col("_w") / (F.lit(k) + F.col(rank))).alias("score"))


def exact_topk(vectors: DataFrame, key: str, vec: str, scope: str | None, queries: DataFrame, dim: int, k: int = 10) -> DataFrame:
    """(query, near, cosine, rank): exact k most similar rows of a stated set of query rows.

    The query rows, of checked number, are sent to all tasks and multiplied block by
    block; each block gives its own k best, so only those are shuffled. With `scope` only
    rows of the same scope are compared. Rows of another dimension are left out.
    """
    qs = queries.select(key, vec, *([scope] if scope else [])).filter(F.size(vec) == dim).limit(MAX_QUERY_VECTORS + 1).toPandas()
    if len(qs) > MAX_QUERY_VECTORS:
        raise ValueError("too many query vectors for one pass: ask in blocks")
    unit = lambda x: x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-30)
    q = unit(np.array(qs[vec].tolist(), np.float64).reshape(-1, dim))
    sent = vectors.sparkSession.sparkContext.broadcast((q, qs[key].to_numpy(np.int64), qs[scope].to_numpy() if scope else None))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, q_ids, q_scope = sent.value
        for b in batches:
            for at in range(0, b.num_rows, 4096):
                part = b.slice(at, 4096)
                x = unit(np.asarray(part.column("vec").flatten(), np.float64).reshape(-1, dim))
                ids = np.asarray(part.column("id"))
                for lo in range(0, len(q), 1024):
                    s = q[lo : lo + 1024] @ x.T
                    s[q_ids[lo : lo + 1024, None] == ids[None, :]] = -2
                    if scope:
                        s[q_scope[lo : lo + 1024, None] != np.asarray(part.column("scope"))[None, :]] = -2
                    top = np.argsort(-s, axis=1, kind="stable")[:, :k]
                    r = np.repeat(np.arange(len(s)), top.shape[1])
                    c = top.ravel()
                    ok = s[r, c] > -1.5
                    yield pa.RecordBatch.from_arrays([pa.array(q_ids[lo + r[ok]]), pa.array(ids[c[ok]]), pa.array(s[r[ok], c[ok]])], names=["query", "near", "cosine"])

    rows = vectors.filter(F.size(vec) == dim).select(F.col(key).cast("long").alias("id"), F.col(vec).alias("vec"), *([F.col(scope).alias("scope")] if scope else []))
    found = rows.mapInArrow(run, "query long, near long, cosine double").withColumn("cosine", F.round("cosine", 6))
    rank = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("cosine"), "near"))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k)


def round_robin(items: DataFrame, group: str, item: str, score: str, limit: int) -> DataFrame:
    """(item, group, score, place): the groups' best items by turns, groups in order of their best item.

    An item of several groups is taken once, where it comes first.
    """
    inside = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), item))
    ranked = items.withColumn("_round", inside).filter(F.col("_round") <= limit)
    best = ranked.filter("_round = 1").select(group, F.col(score).alias("_best"))
    ranked = ranked.join(best, group).groupBy(item).agg(F.min(F.struct("_round", (-F.col("_best")).alias("_b"), group, score)).alias("_m"))
    ranked = ranked.select(item, f"_m.{group}", f"_m.{score}", "_m._round", "_m._b").orderBy("_round", "_b", group).limit(limit)
    return ranked.withColumn("place", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("_round", "_b", group))).select(item, group, score, "place")


def write_vectors(rows: DataFrame, path: str, scope: str, buckets: int = 16) -> None:
    """Store a vector table, in folders by a hash of its scope, so that a scoped search reads one of them."""
    rows.withColumn("bucket", F.pmod(F.xxhash64(scope), F.lit(buckets))).repartition("bucket").write.partitionBy("bucket").mode("overwrite").parquet(path)


def load_vectors(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path).drop("bucket")
