"""Queries of the operators of this package and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.llm.conversations import conversation_report, conversations
from memspark.llm.cutoffs import cut_rates, cut_texts, source_name
from memspark.llm.leaks import leaked_passages
from memspark.llm.mixture import budget_report, mixture, shares_report, token_counts
from memspark.llm.nearcopies import components, near_copies
from memspark.llm.neighbours import nearest
from memspark.operators.lineage import materialise
from memspark.sources.tables import table

_LEDGER = ("session_id", "turn_index", "speaker", "raw_text", ["ingest_time_ms"])


def _ledger(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "ledger_turns", "session_id", "turn_index", "speaker", "raw_text", "ingest_time_ms")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Sessions to drop."""
    return conversation_report(_ledger(spark, d), *_LEDGER).filter("reason is not null").selectExpr("session as session_id")


def p1_conversations(spark: SparkSession, d: str) -> DataFrame:
    """Turns of the whole conversations, in order and with roles."""
    return conversations(_ledger(spark, d), *_LEDGER).selectExpr("session as session_id", "turn_no", "role", "text")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of cosine 0.90 or more of which one is among the ten most similar of the other."""
    near = nearest(table(spark, d, "agent_observations", "vector_id", "embedding"), "vector_id", "embedding", least=0.9)
    return near.filter("cosine >= 0.9").select(F.least("id", "near").alias("vector_id_a"), F.greatest("id", "near").alias("vector_id_b")).distinct()


def p3_topk(spark: SparkSession, d: str) -> DataFrame:
    """The ten most similar observations of every observation whose id is divisible by 50."""
    near = nearest(table(spark, d, "agent_observations", "vector_id", "embedding"), "vector_id", "embedding", probes=40, ask_every=50)
    return near.select(F.col("id").alias("vector_id"), F.col("near").alias("near_id"), F.round("cosine", 3).alias("cosine"), "rank")


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    """Pairs of memories of at least 24 words of which 80 % are common."""
    classes, pairs = near_copies(table(spark, d, "memories", "memory_id", "content"), "memory_id", "content")
    a, b = (classes.select(F.col("id").alias(f"m{x}"), F.col("class_id").alias(f"class_{x}")) for x in "ab")
    near = pairs.select("class_a", "class_b").join(a, "class_a").join(b, "class_b").select("ma", "mb")
    many = classes.groupBy("class_id").count().filter("count > 1").select("class_id")
    copies = classes.join(many, "class_id")
    copies = copies.select("class_id", F.col("id").alias("ma")).join(copies.select("class_id", F.col("id").alias("mb")), "class_id").filter("ma < mb").select("ma", "mb")
    return near.unionByName(copies).select(F.least("ma", "mb").alias("memory_id_a"), F.greatest("ma", "mb").alias("memory_id_b")).distinct()


def p6_groups(spark: SparkSession, d: str) -> DataFrame:
    """One row per memory of at least 24 words: its class of equal word counts, its group, and the class's links."""
    classes, pairs = near_copies(table(spark, d, "memories", "memory_id", "content"), "memory_id", "content")
    links = pairs.select(F.explode(F.array("class_a", "class_b")).alias("class_id")).groupBy("class_id").agg(F.count("*").alias("n_links"))
    group = components(pairs, "class_a", "class_b").withColumnRenamed("node", "class_id")
    return classes.join(links, "class_id", "left").join(group, "class_id", "left").select(
        F.col("id").alias("memory_id"), "class_id", F.coalesce("group_id", "class_id").alias("group_id"), F.coalesce("n_links", F.lit(0)).alias("n_links"))


def _leaks(spark: SparkSession, d: str, by_item: bool = True) -> DataFrame:
    return leaked_passages(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text", table(spark, d, "eval_items", "item_id", "text"), "item_id", "text", by_item)


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents and the held-out items of which they hold a passage."""
    return _leaks(spark, d).select("doc_id", "item_id").distinct()


def p8_spans(spark: SparkSession, d: str) -> DataFrame:
    """Spans of each item in each document, in words and characters."""
    return _leaks(spark, d)


def p8_removals(spark: SparkSession, d: str) -> DataFrame:
    """Spans to cut out of each document, those of all items merged."""
    return _leaks(spark, d, by_item=False)


TREE = ["source", "doc_kind", "lang"]
TEMPER = 0.5  # domains of a source and languages of a domain weigh the root of their tokens


def _counted(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents", "doc_id", "source", "doc_kind", "lang", "text")
    plain = lambda c: F.lower(F.trim(c)).alias(c)
    names = docs.select("doc_id", source_name(F.col("source")).alias("source"), plain("doc_kind"), plain("lang"), "text")
    return token_counts(names, ["doc_id", *TREE], "text", spark.conf.get("spark.memspark.tokenizer", "/opt/tokenizers/byte_bpe_50k.tiktoken"))


def _weights(spark: SparkSession, d: str) -> tuple[dict, dict]:
    weights = table(spark, d, "source_weights").collect()  # one row per source of the target mixture
    return {(w.source,): w.target_share for w in weights}, {w.source: w.max_repeats for w in weights}


def _mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixture(_counted(spark, d), "doc_id", TREE, *_weights(spark, d), temper=TEMPER)


def p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    """Documents drawn for the target mixture and how often each is used."""
    return _mixture(spark, d)


def p9_shortages(spark: SparkSession, d: str) -> DataFrame:
    """A mixture as large as the corpus: what each source, domain and language should give, lacks and takes over."""
    counted = materialise(_counted(spark, d), "tokens")
    total = counted.agg(F.sum("n_tokens")).first()[0] or 0
    return budget_report(counted, TREE, *_weights(spark, d), float(total), TEMPER)


def p9_shares(spark: SparkSession, d: str) -> DataFrame:
    """Target and actual share of every source."""
    return shares_report(_mixture(spark, d), "source", table(spark, d, "source_weights"))


def _cuts(spark: SparkSession, d: str) -> DataFrame:
    return cut_texts(table(spark, d, "documents", "doc_id", "text", "source"), "doc_id", "text", "source")


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    """Documents cut off in mid-word or mid-sentence."""
    return _cuts(spark, d).filter("cut").select("doc_id").distinct()


def p10_rates(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts texts off."""
    return cut_rates(_cuts(spark, d))


QUERIES = {f.__name__: f for f in (p1_found, p1_conversations, p3_found, p3_topk, p6_found, p6_groups, p8_found, p8_spans, p8_removals, p9_mixture, p9_shares, p9_shortages, p10_found, p10_rates)}

_TURNS = r"""WITH raw AS (SELECT nullif(trim(session_id), '') AS session_id, turn_index AS i, lower(trim(coalesce(speaker, ''))) AS sp,
    regexp_replace(raw_text, '^[\s\p{Z}\x{200B}]+|[\s\p{Z}\x{200B}]+$', '', 'g') AS t FROM ledger_turns),
named AS (SELECT session_id, i, t, CASE WHEN sp <> '' THEN sp ELSE lower(regexp_extract(t, '(?i)^(assistant|function|system|human|agent|model|user|tool|usr|bot|sys|ai)\s*[:>]', 1)) END AS word FROM raw
    WHERE session_id IS NOT NULL AND t <> ''),
roled AS (SELECT session_id, i, t, CASE WHEN word IN ('user', 'human', 'usr') THEN 'user' WHEN word IN ('assistant', 'ai', 'bot', 'agent', 'model') THEN 'assistant'
    WHEN word IN ('system', 'sys') THEN 'system' WHEN word IN ('tool', 'function') THEN 'tool' END AS role FROM named),
turns AS (SELECT session_id, i, t, CASE WHEN count(DISTINCT role) = 1 THEN min(role) END AS role FROM roled GROUP BY 1, 2, 3),
talk AS (SELECT *, lead(role) OVER (PARTITION BY session_id ORDER BY i, t) AS nxt FROM turns WHERE role IN ('user', 'assistant')),
per AS (SELECT session_id, count(*) AS n, count(DISTINCT i) AS ni, min(i) AS i0, max(i) AS i1, count(*) FILTER (role IS NULL OR i IS NULL) AS unknown, count(*) FILTER (role = 'user') AS nu,
    count(*) FILTER (role = 'assistant') AS na, arg_min(coalesce(role, '?'), i) FILTER (role IS DISTINCT FROM 'system') AS r0 FROM turns GROUP BY 1),
whole AS (SELECT session_id, i0 FROM per WHERE n = ni AND i0 IN (0, 1) AND i1 - i0 + 1 = n AND unknown = 0 AND nu > 0 AND na > 0 AND r0 = 'user'
    AND session_id NOT IN (SELECT session_id FROM talk WHERE role = 'user' AND nxt IS DISTINCT FROM 'assistant'))
"""
_BAGS = r"""WITH RECURSIVE m AS (SELECT trim(memory_id) AS id, min(content) AS t FROM memories WHERE trim(memory_id) <> '' AND content IS NOT NULL GROUP BY 1), w AS (SELECT id, regexp_extract_all(lower(t), '[\p{L}\p{N}]+') AS w FROM m),
k AS (SELECT id, len(w) AS n, unnest(w) AS word FROM w WHERE len(w) >= 24), x AS (SELECT id, n, word, row_number() OVER (PARTITION BY id, word) AS k FROM k),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS common, greatest(any_value(a.n), any_value(b.n)) AS longer FROM x a JOIN x b ON a.word = b.word AND a.k = b.k AND a.id < b.id GROUP BY 1, 2),
near AS (SELECT a, b FROM p WHERE common >= 0.8 * longer - 1e-9)
"""
_PAIR = "least(a, b) AS {0}_a, greatest(a, b) AS {0}_b"
SQL = {
    "p3_topk": """WITH o AS (SELECT vector_id, any_value(embedding) AS e FROM agent_observations WHERE vector_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1), s AS (SELECT a.vector_id, b.vector_id AS near_id, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS c FROM o a JOIN o b ON a.vector_id <> b.vector_id WHERE a.vector_id % 50 = 0)
SELECT vector_id, near_id, round(c, 3) AS cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY vector_id ORDER BY c DESC, near_id) AS rank FROM s) WHERE rank <= 10""",
    "p3_found": """WITH o AS (SELECT vector_id, any_value(embedding) AS e FROM agent_observations WHERE vector_id IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1), s AS (SELECT a.vector_id AS a, b.vector_id AS b, list_cosine_similarity(a.e::DOUBLE[], b.e::DOUBLE[]) AS c FROM o a JOIN o b ON a.vector_id <> b.vector_id),
r AS (SELECT *, row_number() OVER (PARTITION BY a ORDER BY c DESC, b) AS rank FROM s) SELECT DISTINCT """ + _PAIR.format("vector_id") + """ FROM r WHERE rank <= 10 AND c >= 0.9""",
    "p6_groups": _BAGS + r""", c AS (SELECT id, list_sort(w) AS bag, min(id) OVER (PARTITION BY list_sort(w)) AS class_id FROM w WHERE len(w) >= 24),
l AS (SELECT DISTINCT x.class_id AS a, y.class_id AS b FROM near JOIN c x ON x.id = a JOIN c y ON y.id = b WHERE x.class_id <> y.class_id), e AS (SELECT a, b FROM l UNION SELECT b, a FROM l),
r AS (SELECT a, a AS b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON e.a = r.b), g AS (SELECT a AS class_id, min(b) AS group_id FROM r GROUP BY 1), n AS (SELECT a AS class_id, count(*) AS n_links FROM e GROUP BY 1)
SELECT id AS memory_id, class_id, coalesce(group_id, class_id) AS group_id, coalesce(n_links, 0) AS n_links FROM c LEFT JOIN g USING (class_id) LEFT JOIN n USING (class_id)""",
    "p6_found": _BAGS + "SELECT a AS memory_id_a, b AS memory_id_b FROM near",
    "p1_found": _TURNS + "SELECT DISTINCT session_id FROM raw WHERE session_id IS NOT NULL AND session_id NOT IN (SELECT session_id FROM whole)",
    "p1_conversations": _TURNS + "SELECT session_id, i - i0 AS turn_no, role, t AS text FROM turns JOIN whole USING (session_id)",
}
