"""Queries of the engine's own operators over the test tables, and their SQL."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from memspark.functions import extract, scoring, text
from memspark.operators import changes, graph, metrics, search, temporal
from memspark.operators.lineage import scratch_root
from memspark.operators.rows import clean_id, latest
from memspark.plans import planner
from memspark.sources.tables import table
from memspark.streaming import pipelines

NOW = 1_790_000_000_000
AS_OF = 1_765_000_000_000
LEXICAL, WHEN, WHO = ["lives", "works", "deadline"], ["march", "june"], ["mother", "team lead"]
QUESTIONS = [("contract", ["contract", "studio", "september"]), ("audit", ["audit", "hosts", "cheerful"]), ("piano", ["piano", "nobody", "jetlag"]), ("ramen", ["ramen", "choir", "minutes"])]



def registry():
    """(queries by name, their SQL by name, decorator that adds a query and its SQL) of a module."""
    queries: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
    sqls: dict[str, str] = {}

    def query(sql: str | None = None):
        def add(f):
            queries[f.__name__] = f
            if sql:
                sqls[f.__name__] = sql
            return f

        return add

    return queries, sqls, query


QUERIES, SQL, query = registry()


def r6(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# ---- tables with one row per key ---------------------------------------------------


def memories(spark: SparkSession, d: str) -> DataFrame:
    m = table(spark, d, "memories").select(clean_id("memory_id").alias("memory_id"), clean_id("entity_id").alias("entity_id"), "content", "kind", "created_at_ms").filter("memory_id is not null")
    return m.groupBy("memory_id").agg(F.min(F.struct("entity_id", "content", "kind", "created_at_ms")).alias("r")).select("memory_id", "r.*")


def edges(spark: SparkSession, d: str) -> DataFrame:
    e = table(spark, d, "edges", "edge_id", "source", "target", "edge_type", "weight", "timestamp_ms")
    e = e.select(*[clean_id(c).alias(c) if c in ("edge_id", "source", "target") else F.col(c) for c in e.columns]).filter("edge_id is not null")
    return e.groupBy("edge_id").agg(F.min(F.struct("source", "target", "edge_type", "weight", "timestamp_ms")).alias("r")).select("edge_id", "r.*")


def cards(spark: SparkSession, d: str) -> DataFrame:
    cols = ["entity_id", "subject", "predicate", "object", "memory_text", "card_type", "confidence", "is_latest", "source_session_id", "expires_at", "created_at_ms", "parent_card_id"]
    c = table(spark, d, "memory_cards", "card_id", "updated_at_ms", *cols)
    c = c.select(*[clean_id(x).alias(x) if x in ("card_id", "entity_id", "parent_card_id", "subject") else F.col(x) for x in c.columns]).filter("card_id is not null")
    # Ties of updated_at_ms are equal in all that matters; the greater row is taken.
    return latest(c, "card_id", "updated_at_ms", "created_at_ms", "is_latest", *[x for x in cols if x not in ("created_at_ms", "is_latest")])


def ledger(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "ledger_turns", "session_id", "turn_index", "speaker", "raw_text", "entity_id", "source_type")
    t = t.select(clean_id("session_id").alias("session_id"), F.col("turn_index").alias("turn"), F.col("raw_text").alias("text"), clean_id("entity_id").alias("entity_id"), "source_type")
    t = t.filter("session_id is not null and turn is not null and text is not null")
    return t.groupBy("session_id", "turn").agg(F.min(F.struct("text", "entity_id", "source_type")).alias("r")).select("session_id", "turn", "r.*")


M = """(SELECT trim(memory_id) AS memory_id, arg_min(nullif(trim(entity_id), ''), content) AS entity_id, min(content) AS content, arg_min(kind, content) AS kind, arg_min(created_at_ms, content) AS created_at_ms
    FROM memories WHERE trim(memory_id) <> '' GROUP BY 1)"""
E = """(SELECT DISTINCT trim(edge_id) AS edge_id, nullif(trim(source), '') AS source, nullif(trim(target), '') AS target, edge_type, weight, timestamp_ms FROM edges WHERE trim(edge_id) <> '')"""
C = """(SELECT * FROM (SELECT trim(card_id) AS card_id, nullif(trim(entity_id), '') AS entity_id, nullif(trim(subject), '') AS subject, predicate, object, memory_text, card_type, confidence, is_latest, source_session_id,
    expires_at, created_at_ms, nullif(trim(parent_card_id), '') AS parent_card_id,
    row_number() OVER (PARTITION BY trim(card_id) ORDER BY updated_at_ms DESC NULLS LAST, created_at_ms DESC NULLS LAST, is_latest DESC NULLS LAST) AS rn FROM memory_cards WHERE trim(card_id) <> '') WHERE rn = 1)"""
L = """(SELECT trim(session_id) AS session_id, turn_index AS turn, min(raw_text) AS text, min(nullif(trim(entity_id), '')) AS entity_id, arg_min(source_type, raw_text) AS source_type
    FROM ledger_turns WHERE trim(session_id) <> '' AND turn_index IS NOT NULL AND raw_text IS NOT NULL GROUP BY 1, 2)"""
V = "epoch_us(ts) // 1000 AS ms, event_type, value, user_id FROM events WHERE value IS NOT NULL AND NOT isnan(value)"
S6 = "round(coalesce(sum(value), 0), 6) AS sum, count(value) AS count, round(coalesce(avg(value), 0), 6) AS avg, round(coalesce(min(value), 0), 6) AS min, round(coalesce(max(value), 0), 6) AS max, round(coalesce(stddev_pop(value), 0), 6) AS stddev"


def events(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "events", "ts", "event_type", "value", "user_id").select(F.unix_millis(F.col("ts").cast("timestamp")).alias("ms"), "event_type", "value", "user_id")


# ---- aggregation --------------------------------------------------------------------


@query(f"SELECT event_type, {S6} FROM (SELECT {V}) WHERE ms BETWEEN 1705000000000 AND 1715000000000 GROUP BY 1")
def metric_range(spark, d):
    return r6(metrics.aggregate_range(events(spark, d), ["event_type"], "ms", "value", 1_705_000_000_000, 1_715_000_000_000))


@query(f"SELECT event_type, ms // 86400000 * 86400000 AS bucket_start_ms, bucket_start_ms + 86400000 AS bucket_end_ms, {S6} FROM (SELECT {V}) GROUP BY 1, 2")
def metric_bucket_day(spark, d):
    return r6(metrics.aggregate_bucketed(events(spark, d), ["event_type"], "ms", "value", "day"))


@query(f"""SELECT event_type, b AS bucket_start_ms, b + 3600000 AS bucket_end_ms, {S6} FROM (SELECT *, ms // 3600000 * 3600000 AS b FROM (SELECT {V})
    UNION ALL SELECT *, ms - 3600000 AS b FROM (SELECT {V}) WHERE ms % 3600000 = 0) GROUP BY 1, 2""")
def metric_bucket_hour_both_ends(spark, d):
    return r6(metrics.aggregate_bucketed(events(spark, d), ["event_type"], "ms", "value", "hour", both_ends=True))


@query(f"""SELECT event_type, quantile_disc(value, 0.5) AS p50, quantile_disc(value, 0.95) AS p95, quantile_disc(value, 0.99) AS p99, count(*) AS count FROM (SELECT {V}) GROUP BY 1""")
def latency_percentile(spark, d):
    return metrics.nearest_rank(events(spark, d), "event_type", "value", [0.5, 0.95, 0.99])


@query("""SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS "view", count(*) FILTER (event_type = 'error') AS error,
    max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY 1""")
def usage_counters(spark, d):
    e = events(spark, d)
    return e.groupBy("user_id").agg(F.count("*").alias("requests"), *[F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in ("click", "view", "error")], F.max("ms").alias("last_ms"))


@query("""SELECT 'memories' AS name, count(*) AS n_rows, count(DISTINCT nullif(trim(entity_id), '')) AS n_entities FROM memories UNION ALL SELECT 'memory_cards', count(*), count(DISTINCT nullif(trim(entity_id), '')) FROM memory_cards
    UNION ALL SELECT 'metrics', count(*), count(DISTINCT nullif(trim(entity_id), '')) FROM metrics UNION ALL SELECT 'ledger_turns', count(*), count(DISTINCT nullif(trim(entity_id), '')) FROM ledger_turns""")
def storage_stats(spark, d):
    out = None
    for t in ("memories", "memory_cards", "metrics", "ledger_turns"):
        x = table(spark, d, t, "entity_id").agg(F.count("*").alias("n_rows"), F.countDistinct(clean_id("entity_id")).alias("n_entities")).select(F.lit(t).alias("name"), "n_rows", "n_entities")
        out = x if out is None else out.unionByName(x)
    return out


@query("""SELECT trim(entity_id) AS entity_id, count(DISTINCT vector_id) AS n_vectors FROM agent_observations WHERE len(embedding) = 64 AND trim(entity_id) <> '' GROUP BY 1""")
def entity_vector_counts(spark, d):
    o = table(spark, d, "agent_observations", "entity_id", "vector_id", "embedding").filter(F.size("embedding") == 64)
    return o.select(clean_id("entity_id").alias("entity_id"), "vector_id").filter("entity_id is not null").groupBy("entity_id").agg(F.countDistinct("vector_id").alias("n_vectors"))


# ---- lookups, filters, joins ---------------------------------------------------------


@query(f"""SELECT m.memory_id, m.created_at_ms, coalesce(v.vector_id, 0) AS vector_id FROM {M} m LEFT JOIN (SELECT trim(memory_id) AS memory_id, min(vector_id) AS vector_id FROM agent_observations WHERE trim(memory_id) <> '' GROUP BY 1) v USING (memory_id)""")
def memory_lookup(spark, d):
    v = table(spark, d, "agent_observations", "memory_id", "vector_id").select(clean_id("memory_id").alias("memory_id"), "vector_id").filter("memory_id is not null").groupBy("memory_id").agg(F.min("vector_id").alias("vector_id"))
    return memories(spark, d).join(v, "memory_id", "left").select("memory_id", "created_at_ms", F.coalesce("vector_id", F.lit(0)).alias("vector_id"))


@query(f"SELECT edge_id, weight FROM {E} WHERE weight IS NOT NULL ORDER BY weight DESC, edge_id LIMIT 1000")
def edges_top1000(spark, d):
    return edges(spark, d).filter("weight is not null").select("edge_id", "weight").orderBy(F.desc("weight"), "edge_id").limit(1000)


@query("""SELECT DISTINCT trim(tombstone_id) AS tombstone_id, trim(target_memory_id) AS target, json_extract_string(tombstone_json, '$.scope') AS scope FROM deletion_tombstones
    WHERE json_valid(tombstone_json) AND json_extract_string(tombstone_json, '$.target_id') = trim(target_memory_id)""")
def tombstones_valid(spark, d):
    t = table(spark, d, "deletion_tombstones", "tombstone_id", "target_memory_id", "tombstone_json")
    j = F.from_json("tombstone_json", "scope string, target_id string")
    return t.select(clean_id("tombstone_id").alias("tombstone_id"), clean_id("target_memory_id").alias("target"), j.alias("j")).filter("j.target_id = target").select("tombstone_id", "target", "j.scope").distinct()


@query(f"""SELECT session_id, turn, count(*) OVER w AS n_turns, string_agg(CAST(turn AS VARCHAR), ',') OVER w AS turns FROM {L} WINDOW w AS (PARTITION BY session_id ORDER BY turn RANGE BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def turn_window(spark, d):
    w = Window.partitionBy("session_id").orderBy("turn").rangeBetween(-2, 2)
    return ledger(spark, d).select("session_id", "turn", F.count("*").over(w).alias("n_turns"), F.array_join(F.array_sort(F.collect_list("turn").over(w)).cast("array<string>"), ",").alias("turns"))


@query(f"""SELECT session_id, turn, coalesce(lag(text) OVER w, '') AS prev_text, coalesce(lead(text) OVER w, '') AS next_text FROM {L} WINDOW w AS (PARTITION BY session_id ORDER BY turn)""")
def turn_context(spark, d):
    w = Window.partitionBy("session_id").orderBy("turn")
    return ledger(spark, d).select("session_id", "turn", F.lag("text", 1, "").over(w).alias("prev_text"), F.lead("text", 1, "").over(w).alias("next_text"))


@query(f"SELECT card_id, card_type FROM {C} WHERE is_latest = 1 AND (expires_at IS NULL OR expires_at > {NOW})")
def cards_live(spark, d):
    return cards(spark, d).filter(f"is_latest = 1 and (expires_at is null or expires_at > {NOW})").select("card_id", "card_type")


@query(f"SELECT card_id, CASE WHEN expires_at <= {NOW} THEN 'Expired' ELSE 'Active' END AS state FROM {C}")
def expiry_sweep(spark, d):
    return cards(spark, d).select("card_id", F.when(F.col("expires_at") <= NOW, "Expired").otherwise("Active").alias("state"))


# ---- facts ---------------------------------------------------------------------------

_FACTS = f"""WITH f AS (SELECT card_id, entity_id, lower(subject || '|' || predicate) AS fact_key, created_at_ms AS ts FROM {C} WHERE subject IS NOT NULL AND predicate IS NOT NULL AND created_at_ms IS NOT NULL AND entity_id IS NOT NULL),
p AS (SELECT *, max(ts) OVER (PARTITION BY fact_key, entity_id ORDER BY card_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS mx FROM f),
s AS (SELECT *, mx IS NULL OR ts > mx AS sets FROM p),
g AS (SELECT *, count(*) FILTER (sets) OVER (PARTITION BY fact_key, entity_id ORDER BY card_id) AS g FROM s),
v AS (SELECT a.card_id, a.entity_id, a.fact_key, a.ts AS valid_from_ms, b.card_id AS superseded_by, b.ts AS valid_to_ms, CASE WHEN b.card_id IS NULL THEN 'current' ELSE 'stale' END AS status
    FROM g a LEFT JOIN g b ON b.sets AND a.fact_key = b.fact_key AND a.entity_id = b.entity_id AND b.g = CASE WHEN a.sets THEN a.g + 1 ELSE a.g END)
"""


def _versions(spark, d):
    f = cards(spark, d).select("card_id", "entity_id", F.lower(F.concat_ws("|", "subject", "predicate")).alias("fact_key"), F.col("created_at_ms").alias("ts"), "subject", "predicate")
    f = f.filter("subject is not null and predicate is not null and entity_id is not null").drop("subject", "predicate")
    return temporal.supersede(f, ["fact_key", "entity_id"], "card_id", "ts", ["card_id"]).drop("ts")


@query(_FACTS + "SELECT card_id, entity_id, fact_key, status, valid_from_ms, coalesce(superseded_by, '') AS superseded_by, coalesce(valid_to_ms, 0) AS valid_to_ms FROM v")
def fact_supersession(spark, d):
    return _versions(spark, d).na.fill("", ["superseded_by"]).na.fill(0, ["valid_to_ms"])


@query(_FACTS + f"SELECT card_id, fact_key FROM v WHERE valid_from_ms <= {AS_OF} AND (valid_to_ms IS NULL OR valid_to_ms > {AS_OF})")
def facts_as_of(spark, d):
    return temporal.as_of(_versions(spark, d), AS_OF).select("card_id", "fact_key")


@query(_FACTS + "SELECT DISTINCT card_id FROM v WHERE status = 'stale'")
def stale_set(spark, d):
    return temporal.stale_at(_versions(spark, d), "card_id")


@query(_FACTS + f"SELECT DISTINCT card_id FROM v WHERE valid_to_ms <= {AS_OF} OR valid_from_ms > {AS_OF}")
def stale_set_at(spark, d):
    return temporal.stale_at(_versions(spark, d), "card_id", AS_OF)


# ---- text ----------------------------------------------------------------------------

_WORDS = "list_filter(regexp_split_to_array(lower({}), '[^\\p{{L}}\\p{{N}}]+'), lambda t: strlen(t) > 1)"
_ALNUM = "list_filter(regexp_split_to_array(lower({}), '[^a-z0-9]+'), lambda t: t <> '')"


@query(f"SELECT memory_id, len({_WORDS.format('content')}) AS n_tokens, len({_ALNUM.format('content')}) AS n_alpha, trim(regexp_replace(content, '[\\s\\p{{Z}}]+', ' ', 'g')) AS line FROM {M}")
def text_tokens(spark, d):
    return memories(spark, d).select("memory_id", F.size(text.similarity_tokens(F.col("content"))).alias("n_tokens"), F.size(text.alpha_tokens(F.col("content"))).alias("n_alpha"), text.one_line(F.col("content")).alias("line"))


_TIMES = ", ".join(f"'{w}'" for w in text.TIME_WORDS)


@query(f"""SELECT memory_id, array_to_string(list_sort(list_distinct(list_filter({_ALNUM.format('content')}, lambda t: regexp_matches(t, '^[0-9]{{4}}$')) || list_filter([{_TIMES}], lambda w: contains(lower(content), w)))), ',') AS terms FROM {M}""")
def temporal_terms(spark, d):
    return memories(spark, d).select("memory_id", F.array_join(F.array_sort(text.temporal_terms(F.col("content"))), ",").alias("terms"))


@query(f"""SELECT entity_id, term, n, rank FROM (SELECT entity_id, term, n, row_number() OVER (PARTITION BY entity_id ORDER BY n DESC, term) AS rank FROM (SELECT entity_id, term, count(*) AS n
    FROM (SELECT entity_id, unnest({_ALNUM.format('content')}) AS term FROM {M} WHERE entity_id IS NOT NULL) WHERE length(term) >= 4 GROUP BY 1, 2)) WHERE rank <= 12""")
def salient_terms(spark, d):
    t = memories(spark, d).filter("entity_id is not null").select("entity_id", F.explode(text.alpha_tokens(F.col("content"))).alias("term")).filter(F.length("term") >= 4)
    t = t.groupBy("entity_id", "term").agg(F.count("*").alias("n"))
    return t.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("n"), "term"))).filter("rank <= 12")


@query(f"""SELECT term, CASE WHEN term LIKE '%ies' AND length(term) > 3 THEN regexp_replace(term, 'ies$', 'y') WHEN term LIKE '%s' AND term NOT LIKE '%ss' AND length(term) > 2 THEN regexp_replace(term, 's$', '') ELSE term END AS singular, count(*) AS n
    FROM (SELECT unnest({_ALNUM.format('content')}) AS term FROM {M}) GROUP BY 1, 2""")
def singular_terms(spark, d):
    t = memories(spark, d).select(F.explode(text.alpha_tokens(F.col("content"))).alias("term"))
    return t.groupBy("term").agg(F.count("*").alias("n")).select("term", text.singular(F.col("term")).alias("singular"), "n")


@query(f"""SELECT memory_id, split_part(memory_id, '::', 1) AS entity_part, split_part(memory_id, '::', 2) AS session_part, coalesce(TRY_CAST(split_part(memory_id, '::', -1) AS INTEGER), 0) AS turn_part FROM {M} WHERE memory_id LIKE '%::%::%'""")
def memory_id_parts(spark, d):
    p = text.memory_id_parts(F.col("memory_id"))
    return memories(spark, d).filter("memory_id like '%::%::%'").select("memory_id", p["entity_id"].alias("entity_part"), p["session_id"].alias("session_part"), p["turn_index"].alias("turn_part"))


@query(f"SELECT memory_id, sha256(content || '::' || entity_id || '::' || kind) AS hash FROM {M} WHERE content IS NOT NULL AND entity_id IS NOT NULL AND kind IS NOT NULL")
def content_hash(spark, d):
    return memories(spark, d).filter("content is not null and entity_id is not null and kind is not null").select("memory_id", text.content_hash(F.col("content"), F.col("entity_id"), F.col("kind")).alias("hash"))


@query(f"""SELECT intent, count(*) AS n FROM (SELECT CASE WHEN num AND (mon OR contains(t, ' before ') OR contains(t, ' after ')) THEN 'temporal' WHEN num THEN 'numeric'
    WHEN regexp_matches(t, 'nickname|called|named|as a child|as a kid|childhood|middle name') THEN 'peripheral' WHEN regexp_matches(t, 'would|likely|might|considered|be open to|political leaning|more interested') THEN 'inference'
    WHEN starts_with(t, 'when ') OR mon OR regexp_matches(t, ' last month| this year| past | over the past| before | after ') THEN 'temporal' WHEN regexp_matches(t, 'recommend|suggest|advice|tips|ideas') THEN 'recommendation' ELSE 'general' END AS intent
    FROM (SELECT lower(text) AS t, regexp_matches(t, 'how many|number of|in total|total amount|total money|combined|average|altogether') AS num,
    regexp_matches(t, ' in (january|february|march|april|may|june|july|august|september|october|november|december)') AS mon FROM {L})) GROUP BY 1""")
def question_intents(spark, d):
    return ledger(spark, d).select(text.query_intent(F.col("text")).alias("intent")).groupBy("intent").agg(F.count("*").alias("n"))


@query()
def resolve_names(spark, d):
    """Each name in edges with the registry entity of the same owner it resolves to: exactly, else by phonetic key."""
    named = edges(spark, d).filter(F.col("edge_type").isin("prefers", "works_at", "lives_in", "caused_by", "leads_to", "default")).select("source").filter("source is not null").distinct()
    reg = table(spark, d, "entity_registry", "entity_id", "canonical_name").select(clean_id("entity_id").alias("entity_id"), clean_id("canonical_name").alias("name")).filter("entity_id is not null and name is not null").distinct()
    exact = named.join(reg.groupBy(F.lower("name").alias("k")).agg(F.min("name").alias("hit")), F.lower("source") == F.col("k"), "left").select("source", F.col("hit").alias("exact"))
    sound = reg.groupBy(text.phonetic_key(F.col("name")).alias("k")).agg(F.min("name").alias("near"))
    out = exact.withColumn("k", text.phonetic_key(F.col("source"))).join(sound, "k", "left")
    return out.select("source", F.coalesce("exact", "near").alias("resolved"), F.when(F.col("exact").isNotNull(), "exact").when(F.col("near").isNotNull(), "phonetic").otherwise("none").alias("method"),
                      F.when(F.col("exact").isNotNull(), 1.0).when(F.col("near").isNotNull(), 0.85).otherwise(0.0).alias("confidence"))


# ---- scores --------------------------------------------------------------------------


@query(f"""SELECT memory_id, round(CASE WHEN kind IN ('Decision', 'Preference') OR age <= 0 THEN 1.0 WHEN age <= ttl THEN greatest(pow(2.0, -age / half), 0.35) END, 6) AS score FROM (SELECT memory_id, kind, greatest({NOW} - created_at_ms, 0) / 86400000 AS age,
    CASE kind WHEN 'Conversational' THEN 30.0 WHEN 'Lesson' THEN 90.0 WHEN 'Fact' THEN 180.0 WHEN 'SessionSummary' THEN 14.0 END::DOUBLE AS half,
    CASE kind WHEN 'Conversational' THEN 90.0 WHEN 'Lesson' THEN 365.0 WHEN 'Fact' THEN 730.0 WHEN 'SessionSummary' THEN 60.0 END::DOUBLE AS ttl FROM {M} WHERE kind IS NOT NULL AND created_at_ms IS NOT NULL)""")
def decay_score(spark, d):
    m = memories(spark, d).filter("kind is not null and created_at_ms is not null")
    return m.select("memory_id", F.round(scoring.decay_with_policy(F.lit(1.0), F.col("created_at_ms"), F.col("kind"), NOW), 6).alias("score"))


def _cover(terms: list[str]) -> str:
    return "(" + " + ".join(f"contains(t, '{w}')::INT" for w in terms) + f") / {len(terms)}.0"


@query(f"""SELECT entity_id, card_id, score, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY score DESC, card_id) AS rank FROM (SELECT entity_id, card_id, round(0.42 * lx + 0.16 * tm + 0.24 * en +
    CASE card_type WHEN 'fact' THEN 0.10 WHEN 'preference' THEN 0.09 WHEN 'event' THEN 0.07 WHEN 'episode' THEN 0.07 WHEN 'decision' THEN 0.06 WHEN 'inference' THEN 0.04 ELSE 0.03 END + CASE WHEN is_latest = 1 THEN 0.04 ELSE -0.06 END
    + 0.08 * least(greatest(coalesce(confidence, 0), 0), 1), 6) AS score FROM (SELECT *, {_cover(LEXICAL)} AS lx, {_cover(WHEN)} AS tm, {_cover(WHO)} AS en FROM (SELECT *, lower(concat_ws(' ', subject, predicate, object, memory_text, card_type, source_session_id)) AS t FROM {C}))
    WHERE lx + tm + en > 0 AND entity_id IS NOT NULL)) WHERE rank <= 10""")
def card_score_topk(spark, d):
    t = F.concat_ws(" ", "subject", "predicate", "object", "memory_text", "card_type", "source_session_id")
    any_hit = scoring.coverage(t, LEXICAL) + scoring.coverage(t, WHEN) + scoring.coverage(t, WHO) > 0
    s = scoring.card_score(t, F.col("card_type"), F.col("is_latest"), F.col("confidence"), LEXICAL, WHEN, WHO, F.lit(False))
    c = cards(spark, d).filter(any_hit & F.col("entity_id").isNotNull()).select("entity_id", "card_id", F.round(s, 6).alias("score"))
    return c.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("score"), "card_id"))).filter("rank <= 10")


_BATCH = " UNION ALL ".join(f"SELECT '{q}' AS query, '{t}' AS term" for q, ts in QUESTIONS for t in ts)
_BM25 = f"""WITH t AS (SELECT memory_id AS doc, entity_id, {_WORDS.format('content')} AS w FROM {M} WHERE content IS NOT NULL), n AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t WHERE len(w) > 0),
p AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(w) AS len, unnest(w) AS term FROM t) GROUP BY ALL), q AS ({_BATCH}), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query, doc, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM p JOIN q USING (term) JOIN df USING (term), n GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s)
"""


_text_indexes: dict[str, search.TextIndex] = {}


def text_index(spark, d) -> search.TextIndex:
    """The stored postings of a folder's memories, written once in a session."""
    root = f"{scratch_root(spark)}/text-{spark.sparkContext.applicationId}-{uuid.uuid5(uuid.NAMESPACE_URL, d).hex[:12]}"
    if root not in _text_indexes:
        docs = memories(spark, d).filter("content is not null")
        _text_indexes[root] = search.TextIndex(spark, root).add(docs, "memory_id", "content").with_sizes()
    return _text_indexes[root]


def _bm25(spark, d, k):
    return text_index(spark, d).search(QUESTIONS, k)


@query(_BM25 + "SELECT query, doc, score, rank FROM r WHERE rank <= 10")
def fts_topk(spark, d):
    return _bm25(spark, d, 10)


@query(_BM25.replace("WHERE content IS NOT NULL)", "WHERE content IS NOT NULL AND memory_id NOT IN (SELECT trim(target_memory_id) FROM deletion_tombstones WHERE target_memory_id IS NOT NULL))", 1) + "SELECT query, doc, score, rank FROM r WHERE rank <= 10")
def text_index_updated(spark, d):
    """A text index of half of the memories, the other half and some of the first again added, the deleted ones taken away."""
    m = memories(spark, d).filter("content is not null")
    part = F.pmod(F.xxhash64("memory_id"), F.lit(4))
    index = search.TextIndex(spark, f"{scratch_root(spark)}/index-{uuid.uuid4().hex[:8]}").add(m.filter(part < 2), "memory_id", "content").add(m.filter(part >= 1), "memory_id", "content")
    return index.remove(_seeds(spark, d)).compacted().with_sizes().search(QUESTIONS, 10)


@query(_BM25 + "SELECT doc, round(sum(w / (60 + rank)), 6) AS score FROM (SELECT *, CASE query WHEN 'contract' THEN 1.0 WHEN 'audit' THEN 0.74 WHEN 'piano' THEN 0.6 ELSE 0 END AS w FROM r WHERE rank <= 100) WHERE w > 0 GROUP BY 1")
def weighted_rrf(spark, d):
    return r6(search.fuse(_bm25(spark, d, 100), "doc", "query", "rank", 60.0, {"contract": 1.0, "audit": 0.74, "piano": 0.6, "ramen": 0.0}))


@query(_BM25 + """SELECT query, CASE WHEN g IS NULL THEN 'missing' WHEN g <= 8 THEN '1-8' WHEN g <= 16 THEN '9-16' WHEN g <= 32 THEN '17-32' WHEN g <= 64 THEN '33-64' ELSE '65+' END AS bucket, count(*) AS n
    FROM (SELECT q.query, t.doc, r.rank AS g FROM t JOIN (SELECT query, min(term) AS term FROM q GROUP BY 1) q ON list_contains(t.w, q.term) LEFT JOIN (SELECT * FROM r WHERE rank <= 200) r ON r.query = q.query AND r.doc = t.doc) GROUP BY 1, 2""")
def gold_rank_histogram(spark, d):
    """Ranks at which the memories with a question's first term (in order of letters) come out."""
    m = memories(spark, d).filter("content is not null").select(F.col("memory_id").alias("doc"), text.similarity_tokens(F.col("content")).alias("w"))
    gold = None
    for q, ts in QUESTIONS:
        x = m.filter(F.array_contains("w", min(ts))).select(F.lit(q).alias("query"), "doc")
        gold = x if gold is None else gold.unionByName(x)
    g = F.col("rank")
    bucket = F.when(g.isNull(), "missing").when(g <= 8, "1-8").when(g <= 16, "9-16").when(g <= 32, "17-32").when(g <= 64, "33-64").otherwise("65+")
    return gold.join(_bm25(spark, d, 200), ["query", "doc"], "left").groupBy("query", bucket.alias("bucket")).agg(F.count("*").alias("n"))


@query(_BM25 + """SELECT query, round(sum(hit) / count(*), 6) AS precision, round(sum(hit / log2(greatest(rank, 2))) / sum(1 / log2(greatest(rank, 2))), 6) AS ndcg
    FROM (SELECT r.query, r.rank, list_contains(t.w, f.term)::INT AS hit FROM r JOIN t USING (doc) JOIN (SELECT query, min(term) AS term FROM q GROUP BY 1) f ON r.query = f.query WHERE r.rank <= 20) GROUP BY 1""")
def ranking_quality(spark, d):
    """Precision and normalised gain of the first twenty, a hit being a memory with the question's first term."""
    m = memories(spark, d).select(F.col("memory_id").alias("doc"), text.similarity_tokens(F.col("content")).alias("w"))
    first = F.broadcast(spark.createDataFrame([(q, min(ts)) for q, ts in QUESTIONS], "query string, first string"))
    hit = F.array_contains(F.col("w"), F.col("first")).cast("int")
    gain = 1 / F.log2(F.greatest(F.col("rank"), F.lit(2)).cast("double"))
    return r6(_bm25(spark, d, 20).join(m, "doc").join(first, "query").groupBy("query").agg(F.avg(hit).alias("precision"), (F.sum(hit * gain) / F.sum(gain)).alias("ndcg")))


_COS = "list_cosine_similarity(a.embedding::DOUBLE[], b.embedding::DOUBLE[])"


@query(f"""SELECT "query", near, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY cosine DESC, near) AS rank FROM (SELECT a.vec_id AS "query", b.vec_id AS near, round({_COS}, 6) AS cosine
    FROM embeddings a JOIN embeddings b ON a.label = b.label AND a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE rank <= 10""")
def ann_topk_scoped(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding", "label")
    return search.exact_topk(e, "vec_id", "embedding", "label", e.filter("vec_id % 50 = 0"), 64)


@query(f"""SELECT "query", near, cosine, rank FROM (SELECT *, row_number() OVER (PARTITION BY "query" ORDER BY cosine DESC, near) AS rank FROM (SELECT a.vec_id AS "query", b.vec_id AS near, round({_COS}, 6) AS cosine
    FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0)) WHERE rank <= 10""")
def ann_topk(spark, d):
    e = table(spark, d, "embeddings", "vec_id", "embedding")
    return search.exact_topk(e, "vec_id", "embedding", None, e.filter("vec_id % 50 = 0"), 64)


@query("SELECT label, dim, round(avg(v), 6) AS mean FROM (SELECT label, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM embeddings) GROUP BY 1, 2")
def label_centroids(spark, d):
    return table(spark, d, "embeddings", "label", "embedding").select("label", F.posexplode("embedding").alias("dim", "v")).groupBy("label", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


# ---- sessions and selection ------------------------------------------------------------

_SCORED = f"(SELECT session_id, turn, session_id || '#' || turn AS item, length(text)::DOUBLE AS score FROM {L})"


def _scored(spark, d):
    return ledger(spark, d).select("session_id", "turn", F.concat_ws("#", "session_id", "turn").alias("item"), F.length("text").cast("double").alias("score"))


@query(f"""SELECT item, session_id, score, row_number() OVER (ORDER BY r, best DESC, session_id) AS place FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, item) AS r, max(score) OVER (PARTITION BY session_id) AS best FROM {_SCORED})
    ORDER BY r, best DESC, session_id LIMIT 500""")
def session_roundrobin(spark, d):
    return search.round_robin(_scored(spark, d), "session_id", "item", "score", 500)


@query(f"""SELECT session_id, turn, score FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, turn) AS r FROM {_SCORED}) JOIN (SELECT session_id FROM {_SCORED} GROUP BY 1 ORDER BY max(score) DESC, session_id LIMIT 50) USING (session_id) WHERE r <= 3""")
def pack_sessions(spark, d):
    """The best turns, at most three each, of the fifty sessions with the highest score."""
    s = _scored(spark, d)
    top = s.groupBy("session_id").agg(F.max("score").alias("best")).orderBy(F.desc("best"), "session_id").limit(50).select("session_id")
    r = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "turn"))
    return s.join(F.broadcast(top), "session_id", "left_semi").withColumn("r", r).filter("r <= 3").select("session_id", "turn", "score")


@query(f"""SELECT session_id, round(0.68 * t1 + 0.22 * t2 + 0.10 * t3 + 0.02 * least(n - 1, 3), 6) AS score, n FROM (SELECT session_id, count(*) AS n, max(score) FILTER (r = 1) AS t1, coalesce(max(score) FILTER (r = 2), 0) AS t2, coalesce(max(score) FILTER (r = 3), 0) AS t3
    FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY score DESC, turn) AS r FROM {_SCORED}) GROUP BY 1)""")
def session_scores(spark, d):
    r = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc("score"), "turn"))
    top = lambda k: F.coalesce(F.max(F.when(F.col("r") == k, F.col("score"))), F.lit(0.0))
    s = _scored(spark, d).withColumn("r", r).groupBy("session_id").agg(F.count("*").alias("n"), top(1).alias("a"), top(2).alias("b"), top(3).alias("c"))
    return s.select("session_id", F.round(0.68 * F.col("a") + 0.22 * F.col("b") + 0.10 * F.col("c") + 0.02 * F.least(F.col("n") - 1, F.lit(3)), 6).alias("score"), "n")


@query(f"""SELECT session_id, entity_id, count(*) AS n_turns, array_to_string(list_sort(list(DISTINCT source_type)), ',') AS source_types, min(turn) AS first_turn, max(turn) AS last_turn FROM {L} WHERE entity_id IS NOT NULL AND source_type IS NOT NULL GROUP BY 1, 2""")
def router_merge(spark, d):
    t = ledger(spark, d).filter("entity_id is not null and source_type is not null")
    return t.groupBy("session_id", "entity_id").agg(F.count("*").alias("n_turns"), F.array_join(F.array_sort(F.collect_set("source_type")), ",").alias("source_types"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))


# ---- graph -----------------------------------------------------------------------------

_BOTH = f"(SELECT source AS node, target AS other, * FROM {E} UNION ALL SELECT target, source, * FROM {E})"
_SEEDS = "(SELECT DISTINCT trim(target_memory_id) AS node FROM deletion_tombstones WHERE trim(target_memory_id) <> '')"


def _seeds(spark, d):
    return table(spark, d, "deletion_tombstones", "target_memory_id").select(clean_id("target_memory_id").alias("node")).filter("node is not null").distinct()


@query(f"""SELECT node, other, edge_id, edge_type, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY timestamp_ms DESC NULLS LAST, edge_id, other) AS rank FROM {_BOTH} JOIN {_SEEDS} USING (node) WHERE edge_type <> 'default' AND other IS NOT NULL) WHERE rank <= 50""")
def graph_neighbours(spark, d):
    return graph.neighbours(edges(spark, d), _seeds(spark, d))


@query(f"""WITH b AS (SELECT node, other FROM {_BOTH} WHERE node IS NOT NULL AND other IS NOT NULL), w1 AS (SELECT s.node AS seed, b.other AS node, 0.6 AS score FROM {_SEEDS} s JOIN b ON s.node = b.node), w2 AS (SELECT seed, b.other, score * 0.6 FROM w1 JOIN b ON w1.node = b.node)
    SELECT seed, node, round(sum(score), 6) AS score FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2) GROUP BY 1, 2""")
def link_cluster_scores(spark, d):
    return r6(graph.cluster_scores(edges(spark, d), _seeds(spark, d)))


@query(f"""SELECT node, other, edge_type, weight, rank FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, other, edge_type) AS rank FROM (SELECT node, other, edge_type, max(weight) AS weight FROM {_BOTH}
    WHERE node IS NOT NULL AND other IS NOT NULL AND weight IS NOT NULL GROUP BY 1, 2, 3)) WHERE rank <= 5""")
def heavy_neighbours(spark, d):
    return graph.heavy_neighbours(edges(spark, d).filter("weight is not null"), 5)


@query(f"""SELECT DISTINCT a.source AS entity, a.target AS preferred, b.target AS cause, 0.6::DOUBLE AS confidence FROM {E} a JOIN {E} b ON a.source = b.source WHERE a.edge_type = 'prefers' AND b.edge_type = 'caused_by'""")
def preference_chains(spark, d):
    return graph.preference_chains(edges(spark, d)).withColumn("confidence", F.lit(0.60))


@query(f"""SELECT DISTINCT a.source AS root_cause, a.target AS intermediate, b.target AS final_effect, 0.55::DOUBLE AS confidence FROM {E} a JOIN {E} b ON a.target = b.source WHERE a.edge_type = 'leads_to' AND b.edge_type = 'leads_to'""")
def causal_sequences(spark, d):
    return graph.causal_sequences(edges(spark, d)).withColumn("confidence", F.lit(0.55))


@query(f"SELECT edge_id, CASE edge_type WHEN 'caused_by' THEN 1.4 WHEN 'prefers' THEN 1.2 WHEN 'derived_from' THEN 0.7 WHEN 'supersedes' THEN 0.3 ELSE 1.0 END::DOUBLE AS default_weight, coalesce(weight, default_weight) AS weight FROM {E}")
def edge_weights(spark, d):
    w = scoring.edge_weight(F.col("edge_type"))
    return edges(spark, d).select("edge_id", w.alias("default_weight"), F.coalesce("weight", w).alias("weight"))


# ---- changes ---------------------------------------------------------------------------


@query(f"SELECT card_id, card_type, created_at_ms FROM {C}")
def upsert_last_wins(spark, d):
    """Cards as first stored, with the last rows of those that were written again put in their place; the others stay."""
    raw = table(spark, d, "memory_cards", "card_id", "card_type", "created_at_ms", "updated_at_ms").withColumn("card_id", clean_id("card_id")).filter("card_id is not null")
    first = raw.groupBy("card_id").agg(F.min(F.struct("updated_at_ms", "created_at_ms", "card_type")).alias("r"), F.count("*").alias("n"))
    again = first.filter("n > 1").select("card_id")
    return changes.upsert(first.select("card_id", "r.card_type", "r.created_at_ms"), cards(spark, d).select("card_id", "card_type", "created_at_ms").join(again, "card_id", "left_semi"), ["card_id"])


@query("""SELECT trim(memory_id) AS memory_id, count(*) AS n FROM memories WHERE trim(memory_id) <> '' AND regexp_replace(trim(memory_id), '::ct[0-9]*$', '') NOT IN (SELECT trim(target_memory_id) FROM deletion_tombstones WHERE trim(target_memory_id) <> '') GROUP BY 1""")
def delete_cascade(spark, d):
    m = table(spark, d, "memories", "memory_id").select(clean_id("memory_id").alias("memory_id")).filter("memory_id is not null")
    return changes.delete_cascade(m, "memory_id", _seeds(spark, d)).groupBy("memory_id").agg(F.count("*").alias("n"))


@query(f"""SELECT entity_id, array_to_string(list(memory_id ORDER BY o, memory_id), ',') AS items, count(*) AS n FROM (SELECT entity_id, memory_id, created_at_ms AS o, row_number() OVER (PARTITION BY entity_id ORDER BY created_at_ms DESC, memory_id DESC) AS r FROM {M}
    WHERE entity_id IS NOT NULL AND created_at_ms IS NOT NULL) WHERE r <= 24 GROUP BY 1""")
def profile_latest24(spark, d):
    m = memories(spark, d).filter("entity_id is not null and created_at_ms is not null")
    return changes.newest_list(m, "entity_id", "memory_id", "created_at_ms", 24).select("entity_id", F.array_join("items", ",").alias("items"), "n")


# ---- table-generating text functions ------------------------------------------------------


@query("""SELECT doc_id, line_no, lower(regexp_extract(line, '^([A-Za-z]+): (.+)$', 1)) AS speaker, regexp_extract(line, '^([A-Za-z]+): (.+)$', 2) AS said
    FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1)::INT - 1 AS line_no FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL))
    WHERE regexp_matches(line, '^[A-Za-z]+: .+$')""")
def dialogue_lines(spark, d):
    return extract.dialogue_lines(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE WHEN regexp_matches(text, '(?m)^```|^\\s*(def|fn|class|function|impl) ') THEN 'code' WHEN regexp_matches(text, '(?m)^#{1,6} ') THEN 'markdown' WHEN regexp_matches(text, '(?im)^(from|subject): ') THEN 'email'
    WHEN regexp_matches(text, '(?m)^[^\\n]*\\|[^\\n]*\\|') THEN 'table' WHEN regexp_matches(text, '(?m)^[\\p{L}]+: ') THEN 'chat' ELSE 'plain' END AS kind FROM documents WHERE text IS NOT NULL) GROUP BY 1""")
def content_types(spark, d):
    return table(spark, d, "documents", "text").filter("text is not null").groupBy(extract.content_type(F.col("text")).alias("kind")).agg(F.count("*").alias("n"))


@query()
def chunk_documents(spark, d):
    """Chunks of all documents, by kind of text."""
    return extract.chunk_documents(table(spark, d, "documents", "doc_id", "text"), "doc_id", "text")


@query(f"""SELECT memory_id, array_to_string(list_sort(list_distinct(list_filter(regexp_extract_all(content, '((?:\\b[A-Z][A-Za-z''-]*[a-z][A-Za-z''-]*\\b)(?:[ \\t]+(?:[A-Z][A-Za-z''-]*[a-z][A-Za-z''-]*))*)', 1), lambda p: length(p) > 2))), '|') AS phrases FROM {M} WHERE content IS NOT NULL""")
def named_phrases(spark, d):
    return memories(spark, d).filter("content is not null").select("memory_id", F.array_join(F.array_sort(extract.named_phrases(F.col("content"))), "|").alias("phrases"))


@query("""SELECT name, label, n FROM (SELECT person AS name, 'person' AS label, count(DISTINCT session_id) AS n FROM (SELECT trim(session_id) AS session_id, unnest(regexp_extract_all(raw_text, '\\b([A-Z][a-z]+ [A-Z][a-z]+)\\b', 1)) AS person FROM ledger_turns WHERE trim(session_id) <> '' AND raw_text IS NOT NULL) GROUP BY 1
    UNION ALL SELECT code, 'code', count(DISTINCT session_id) FROM (SELECT trim(session_id) AS session_id, unnest(regexp_extract_all(raw_text, '\\b([A-Z]{3}-[0-9]{3,4})\\b', 1)) AS code FROM ledger_turns WHERE trim(session_id) <> '' AND raw_text IS NOT NULL) GROUP BY 1)""")
def facet_postings(spark, d):
    """Names and codes with the number of sessions that hold them."""
    t = table(spark, d, "ledger_turns", "session_id", "raw_text").select(clean_id("session_id").alias("session_id"), "raw_text").filter("session_id is not null and raw_text is not null")
    facets = F.concat(*[F.transform(F.regexp_extract_all("raw_text", F.lit(p), F.lit(1)), _labelled(k)) for k, p in (("person", "\\b([A-Z][a-z]+ [A-Z][a-z]+)\\b"), ("code", "\\b([A-Z]{3}-[0-9]{3,4})\\b"))])
    return t.select("session_id", F.explode(facets).alias("f")).groupBy("f.name", "f.label").agg(F.countDistinct("session_id").alias("n"))


def _labelled(label):
    return lambda v: F.struct(v.alias("name"), F.lit(label).alias("label"))


# ---- whole retrieval and streams -------------------------------------------------------------

_STALE = """, st AS (SELECT DISTINCT trim(target_memory_id) AS doc FROM deletion_tombstones WHERE trim(target_memory_id) <> '')"""


@query(_BM25 + _STALE + f"""SELECT query, doc, final, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY final DESC, doc) AS place FROM (SELECT r.query, r.doc, round((0.5 * r.score / mx + 0.2 * decay + 0.15 * least(1, len(w) / 60.0)) * CASE WHEN st.doc IS NULL THEN 1.0 ELSE 0.7 END, 6) AS final
    FROM (SELECT *, max(score) OVER (PARTITION BY query) AS mx FROM r WHERE rank <= 100) r JOIN t USING (doc) JOIN (SELECT memory_id AS doc, CASE WHEN kind IN ('Decision', 'Preference') OR age <= 0 THEN 1.0 WHEN age <= ttl THEN greatest(pow(2.0, -age / half), 0.35) END AS decay FROM (SELECT memory_id, kind,
    greatest({AS_OF} - created_at_ms, 0) / 86400000 AS age, CASE kind WHEN 'Conversational' THEN 30.0 WHEN 'Lesson' THEN 90.0 WHEN 'Fact' THEN 180.0 WHEN 'SessionSummary' THEN 14.0 END::DOUBLE AS half,
    CASE kind WHEN 'Conversational' THEN 90.0 WHEN 'Lesson' THEN 365.0 WHEN 'Fact' THEN 730.0 WHEN 'SessionSummary' THEN 60.0 END::DOUBLE AS ttl FROM {M})) USING (doc) LEFT JOIN st USING (doc) WHERE decay IS NOT NULL)) WHERE place <= 10""")
def hybrid_search(spark, d):
    """Lexical score, time decay by kind, and length support blended per question over the 100 best BM25 rows; deleted memories are faded. No vector or card lane."""
    hits = _bm25(spark, d, 100).drop("rank").withColumn("mx", F.max("score").over(Window.partitionBy("query")))
    m = memories(spark, d).select(F.col("memory_id").alias("doc"), F.size(text.similarity_tokens(F.col("content"))).alias("n"), scoring.decay_with_policy(F.lit(1.0), F.col("created_at_ms"), F.col("kind"), AS_OF).alias("decay"))
    gone = _seeds(spark, d).select(F.col("node").alias("doc"), F.lit(0.7).alias("fade"))
    x = hits.join(m.filter("decay is not null"), "doc").join(gone, "doc", "left")
    final = (0.5 * F.col("score") / F.col("mx") + 0.2 * F.col("decay") + 0.15 * F.least(F.lit(1.0), F.col("n") / 60.0)) * F.coalesce("fade", F.lit(1.0))
    x = x.select("query", "doc", F.round(final, 6).alias("final"))
    return x.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("final"), "doc"))).filter("place <= 10")


@query("""SELECT event_type, epoch_us(date_trunc('day', ts)) // 1000 AS bucket_start_ms, count(value) AS count, round(sum(value), 4) AS sum FROM events GROUP BY 1, 2""")
def stream_metric_windows(spark, d):
    """The day buckets again, by a stream over the events table."""
    s = spark.readStream.schema(table(spark, d, "events").schema).parquet(f"{d}/event[s].parquet").select(F.col("ts").cast("timestamp").alias("at"), "event_type", "value")
    out = pipelines.run_to_table(pipelines.metric_windows(s, ["event_type"], "at", "value"), f"{scratch_root(spark)}/windows-{uuid.uuid4().hex[:8]}", "complete")
    return out.withColumn("sum", F.round("sum", 4))


# ---- planned retrieval -----------------------------------------------------------------------

PLANNED = [planner.plan(q) for q in ("When did the contract with the studio start?", "How many ramen boxes were there in total?", "Would Jejen likely choose yoga?", "any tips for the piano")]
_TERMS = " UNION ALL ".join(f"SELECT '{p.intent}' AS intent, '{t}' AS term, {len(p.terms)} AS n_terms" for p in PLANNED for t in p.terms)


@query(f"""SELECT intent, session_id, hits FROM (SELECT *, row_number() OVER (PARTITION BY intent ORDER BY hits DESC, session_id) AS r FROM (SELECT intent, session_id, count(DISTINCT term) AS hits FROM {L} JOIN ({_TERMS}) q ON contains(lower(text), term) GROUP BY 1, 2)) WHERE r <= 20""")
def pivot_sessions(spark, d):
    """The twenty sessions with most of each planned question's terms."""
    out = None
    low = ledger(spark, d).select("session_id", F.lower("text").alias("t"))
    for p in PLANNED:
        x = low.select("session_id", F.filter(F.array(*[F.lit(w) for w in p.terms]), _in_text).alias("w")) if p.terms else None
        if x is not None:
            x = x.select("session_id", F.explode("w").alias("term")).groupBy("session_id").agg(F.countDistinct("term").alias("hits")).select(F.lit(p.intent).alias("intent"), "session_id", "hits")
            out = x if out is None else out.unionByName(x)
    return out.withColumn("r", F.row_number().over(Window.partitionBy("intent").orderBy(F.desc("hits"), "session_id"))).filter("r <= 20").drop("r")


def _in_text(w):
    return F.contains(F.col("t"), w)


@query(f"""SELECT entity_id, memory_id, strength, rank FROM (SELECT *, row_number() OVER (PARTITION BY entity_id ORDER BY strength DESC, memory_id) AS rank FROM (SELECT entity_id, memory_id, round(greatest(CASE WHEN regexp_matches(lower(content), 'love|favou?rite') THEN 0.9 ELSE 0 END,
    CASE WHEN regexp_matches(lower(content), 'prefers?') THEN 0.8 ELSE 0 END, CASE WHEN regexp_matches(lower(content), 'likes?|enjoys?') THEN 0.7 ELSE 0 END, CASE WHEN kind = 'Preference' THEN 0.6 ELSE 0 END), 2)::DOUBLE AS strength FROM {M} WHERE entity_id IS NOT NULL) WHERE strength > 0) WHERE rank <= 5""")
def preference_memories(spark, d):
    """The five strongest preferences of each entity, by the strongest phrase."""
    low = F.lower("content")
    weights = [(low.rlike("love|favou?rite"), 0.9), (low.rlike("prefers?"), 0.8), (low.rlike("likes?|enjoys?"), 0.7), (F.col("kind") == "Preference", 0.6)]
    strength = F.greatest(*[F.when(c, v).otherwise(0.0) for c, v in weights])
    m = memories(spark, d).filter("entity_id is not null").select("entity_id", "memory_id", strength.alias("strength")).filter("strength > 0")
    return m.withColumn("rank", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("strength"), "memory_id"))).filter("rank <= 5")


@query(_BM25 + """SELECT query, round(least(greatest(0.55 * t1 + 0.25 * greatest(t1 - t2, 0) + 0.20 * support, 0), 1), 6) AS confidence, confidence < 0.24 AS abstain FROM (SELECT query, max(s) FILTER (rank = 1) AS t1, coalesce(max(s) FILTER (rank = 2), 0) AS t2, count(*) FILTER (rank <= 6 AND n >= 2) / 6.0 AS support
    FROM (SELECT r.query, r.rank, r.score / (1 + r.score) AS s, len(list_filter(list_distinct(t.w), lambda x: list_contains(qs.terms, x))) AS n FROM r JOIN t USING (doc) JOIN (SELECT query, list(term) AS terms FROM q GROUP BY 1) qs ON qs.query = r.query WHERE rank <= 10) GROUP BY 1)""")
def evidence_confidence(spark, d):
    """Top score, its margin and the support of the first six, and whether to abstain."""
    m = memories(spark, d).select(F.col("memory_id").alias("doc"), text.similarity_tokens(F.col("content")).alias("w"))
    asked = F.broadcast(spark.createDataFrame(QUESTIONS, "query string, terms array<string>"))
    x = _bm25(spark, d, 10).join(m, "doc").join(asked, "query").withColumn("n", F.size(F.array_intersect("w", "terms"))).withColumn("s", F.col("score") / (1 + F.col("score")))
    top = lambda k: F.coalesce(F.max(F.when(F.col("rank") == k, F.col("s"))), F.lit(0.0))
    g = x.groupBy("query").agg(top(1).alias("t1"), top(2).alias("t2"), (F.count(F.when((F.col("rank") <= 6) & (F.col("n") >= 2), 1)) / 6.0).alias("support"))
    c = F.round(F.least(F.greatest(0.55 * F.col("t1") + 0.25 * F.greatest(F.col("t1") - F.col("t2"), F.lit(0.0)) + 0.20 * F.col("support"), F.lit(0.0)), F.lit(1.0)), 6)
    return g.select("query", c.alias("confidence"), (c < 0.24).alias("abstain"))


@query(f"""SELECT session_id, turn, answer, value FROM (SELECT session_id, turn, unnest(['count', 'sum', 'average', 'difference']) AS answer, unnest([len(v)::DOUBLE, round(list_sum(v), 4), round(list_avg(v), 4), round(list_max(v) - list_min(v), 4)]) AS value
    FROM (SELECT session_id, turn, list_transform(regexp_extract_all(text, '\\b(\\d+(?:\\.\\d+)?)\\b', 1), lambda x: x::DOUBLE) AS v FROM {L}) WHERE len(v) > 1)""")
def numeric_answers(spark, d):
    """Count, sum, average and difference of the numbers of every turn that has several."""
    v = F.transform(F.regexp_extract_all("text", F.lit("\\b(\\d+(?:\\.\\d+)?)\\b"), F.lit(1)), _double)
    t = ledger(spark, d).select("session_id", "turn", v.alias("v")).filter(F.size("v") > 1)
    total = F.aggregate("v", F.lit(0.0), _plus)
    made = F.create_map(F.lit("count"), F.size("v").cast("double"), F.lit("sum"), F.round(total, 4), F.lit("average"), F.round(total / F.size("v"), 4), F.lit("difference"), F.round(F.array_max("v") - F.array_min("v"), 4))
    return t.select("session_id", "turn", F.explode(made).alias("answer", "value"))


def _double(x):
    return x.cast("double")


def _plus(a, b):
    return a + b
