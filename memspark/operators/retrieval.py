"""Retrieval of memories for planned questions: ranked lanes, fusion, signals."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import scoring
from memspark.operators import search
from memspark.operators.lineage import materialise
from memspark.plans.planner import LANE_FACTORS, RRF_K, SIGNALS, VARIANT_WEIGHTS, Plan

DIM = 64
DEPTH = 50  # ranks of a lane that are fused
FEEDBACK = 5  # lexical hits whose vectors make the query vector


def _ranked(df: DataFrame, score: str, item: str) -> DataFrame:
    r = F.row_number().over(Window.partitionBy("query").orderBy(F.desc(score), item))
    return df.withColumn("rank", r).filter(F.col("rank") <= DEPTH)


def vector_lane(hits: DataFrame, vectors: DataFrame) -> DataFrame:
    """(query, doc, cosine, rank): memories most similar to the mean vector of the first lexical hits of each question.

    `hits` are (query, doc, rank), `vectors` (doc, vec) of DIM finite numbers, one row per
    doc. Query vectors, one for each question, are sent to the vectors, not the other way.
    """
    first = hits.filter(F.col("rank") <= FEEDBACK).join(vectors, "doc").select("query", F.posexplode("vec").alias("dim", "v"))
    mean = first.groupBy("query", "dim").agg(F.avg(F.col("v").cast("double")).alias("m"))
    q = F.broadcast(mean.groupBy("query").agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), lambda x: x["m"]).alias("q")))  # as many rows as questions
    near = vectors.crossJoin(q).select("query", "doc", F.round(scoring.cosine(F.col("q"), F.col("vec")), 6).alias("cosine"))
    return _ranked(near.filter("cosine > 0"), "cosine", "doc")


def card_lane(plans: list[tuple[str, Plan]], cards: DataFrame) -> DataFrame:
    """(query, doc, score, rank): source memories of the cards that hold most of each question's terms.

    `cards` have doc, text and confidence; a card without any term is no hit.
    """
    out = None
    conf = F.least(F.greatest(F.coalesce("confidence", F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    for name, p in plans:
        cover = scoring.coverage(F.col("text"), p.terms)
        x = cards.select("doc", cover.alias("c"), conf.alias("f")).filter("c > 0").groupBy("doc").agg(F.max(F.round(0.42 * F.col("c") + 0.08 * F.col("f"), 6)).alias("score")).select(F.lit(name).alias("query"), "doc", "score")
        out = x if out is None else out.unionByName(x)
    return _ranked(out, "score", "doc")


def lane_weight(intent: str, lane: str) -> float:
    place, kind = {"lexical": (0, "lexical"), "vector": (1, "semantic"), "card": (2, "lexical")}[lane]
    return VARIANT_WEIGHTS[place] * LANE_FACTORS[intent][kind]


def _by_question(plans: list[tuple[str, Plan]], value) -> Column:
    out = F.lit(None).cast("double")
    for name, p in plans:
        out = F.when(F.col("query") == name, F.lit(float(value(p)))).otherwise(out)
    return out


def retrieve(plans: list[tuple[str, Plan]], memories: DataFrame, vectors: DataFrame, cards: DataFrame, degree: DataFrame, stale: DataFrame, now_ms: int, k: int = 10) -> DataFrame:
    """(query, doc, final, place): the k best memories of each planned question.

    Lexical, vector and card lanes are fused by weighted reciprocal ranks, with weights and k
    of the question's class. The fused score, the decay by kind, the confidence and the links
    of a memory are blended by the class's weights. Memories younger than `now_ms` are not
    seen; those in `stale` lose confidence and a third of their score, but stay. Of kinds
    whose time has passed none comes. A question without terms finds nothing.

    memories: doc, content, kind, created_at_ms; degree: doc, n_links; stale: doc. Questions
    are a batch of a few; only their lanes' first ranks are joined.
    """
    seen = memories.filter(F.col("created_at_ms") <= now_ms)
    lexical = materialise(search.bm25(seen.filter("content is not null"), "doc", "content", [(n, p.terms) for n, p in plans if p.terms], DEPTH), "lexical")
    lanes = [("lexical", lexical), ("vector", vector_lane(lexical.select("query", "doc", "rank"), vectors)), ("card", card_lane([x for x in plans if x[1].terms], cards))]
    all_ = None
    for name, lane in lanes:
        part = F.lit(1.0) / (_by_question(plans, lambda p: RRF_K[p.intent]) + F.col("rank")) * _by_question(plans, lambda p, lane=name: lane_weight(p.intent, lane))
        x = lane.select("query", "doc", part.alias("part"))
        all_ = x if all_ is None else all_.unionByName(x)
    fused = all_.groupBy("query", "doc").agg(F.sum("part").alias("fused"))
    decay = scoring.decay_with_policy(F.lit(1.0), F.col("created_at_ms"), F.col("kind"), now_ms)
    x = fused.join(seen.select("doc", decay.alias("decay")).filter("decay is not null"), "doc").join(degree, "doc", "left").join(stale.select("doc", F.lit(True).alias("old")), "doc", "left")
    x = x.withColumn("top", F.max("fused").over(Window.partitionBy("query")))  # at most three lanes' ranks
    signals = [F.col("fused") / F.col("top"), F.col("decay"), F.when(F.col("old"), 0.35).otherwise(0.5), F.least(F.lit(1.0), F.coalesce("n_links", F.lit(0)) / 4.0)]
    blend = sum((s * _by_question(plans, lambda p, i=i: SIGNALS[p.intent][i]) for i, s in enumerate(signals)), F.lit(0.0))
    x = x.select("query", "doc", F.round(blend * F.when(F.col("old"), 0.70).otherwise(1.0), 6).alias("final"))
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.desc("final"), "doc"))
    return x.withColumn("place", place).filter(F.col("place") <= k)
