"""Queries of planned retrieval and of its scores, and their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from memspark.functions import text
from memspark.operators import graph, retrieval
from memspark.operators.rows import clean_id
from memspark.plans import planner
from memspark.plans.reference_queries import _WORDS, AS_OF, PLANNED, C, E, L, M, cards, edges, ledger, memories, registry
from memspark.plans.store_queries import _UNIT, T, _usable, tombstones
from memspark.sources.tables import table

QUERIES, SQL, query = registry()
PLANS = [(f"{i} {p.intent}", p) for i, p in enumerate(PLANNED)]
_BATCH = " UNION ALL ".join(f"SELECT '{n}' AS query, '{t}' AS term" for n, p in PLANS for t in p.terms)
_CONST = ", ".join(f"('{n}', {planner.RRF_K[p.intent]}, {retrieval.lane_weight(p.intent, 'lexical')!r}, {retrieval.lane_weight(p.intent, 'vector')!r}, {retrieval.lane_weight(p.intent, 'card')!r}, {', '.join(map(repr, planner.SIGNALS[p.intent]))}, {len(p.terms)})" for n, p in PLANS)
_SOURCES = "(SELECT trim(card_id) AS card_id, max(nullif(trim(source_memory_id), '')) AS doc FROM memory_cards GROUP BY 1)"
_DECAY = f"""CASE WHEN kind IN ('Decision', 'Preference') OR age <= 0 THEN 1.0 WHEN age <= ttl THEN greatest(pow(2.0, -age / half), 0.35) END FROM (SELECT memory_id AS doc, kind, greatest({AS_OF} - created_at_ms, 0) / 86400000 AS age,
    CASE kind WHEN 'Conversational' THEN 30.0 WHEN 'Lesson' THEN 90.0 WHEN 'Fact' THEN 180.0 WHEN 'SessionSummary' THEN 14.0 END::DOUBLE AS half, CASE kind WHEN 'Conversational' THEN 90.0 WHEN 'Lesson' THEN 365.0 WHEN 'Fact' THEN 730.0 WHEN 'SessionSummary' THEN 60.0 END::DOUBLE AS ttl
    FROM {M} WHERE created_at_ms <= {AS_OF})"""
_LANES = f"""WITH k(query, rrf, wl, wv, wc, s1, s2, s3, s4, nt) AS (VALUES {_CONST}), q AS ({_BATCH}),
t AS (SELECT memory_id AS doc, {_WORDS.format('content')} AS w FROM {M} WHERE content IS NOT NULL AND created_at_ms <= {AS_OF}), n AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM t WHERE len(w) > 0),
p AS (SELECT doc, len, term, count(*) AS tf FROM (SELECT doc, len(w) AS len, unnest(w) AS term FROM t) GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM p GROUP BY 1),
s AS (SELECT query, doc, round(sum(greatest(ln((docs - df + 0.5) / (df + 0.5)), 1e-6) * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * len / mean))), 6) AS score FROM p JOIN q USING (term) JOIN df USING (term), n GROUP BY 1, 2),
lx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM s) WHERE rank <= 50),
v AS (SELECT memory_id AS doc, arg_min(embedding, vector_id)::DOUBLE[] AS vec FROM {_UNIT} WHERE memory_id IS NOT NULL GROUP BY 1), m AS (SELECT query, list(m ORDER BY dim) AS qv FROM (SELECT query, dim, avg(x) AS m FROM (SELECT query, unnest(vec) AS x, generate_subscripts(vec, 1) AS dim FROM lx JOIN v USING (doc) WHERE rank <= 5) GROUP BY 1, 2) GROUP BY 1),
vx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, doc) AS rank FROM (SELECT query, doc, round(list_cosine_similarity(qv, vec), 6) AS cosine FROM v, m) WHERE cosine > 0 AND NOT isnan(cosine)) WHERE rank <= 50),
cd AS (SELECT card_id, src.doc, lower(concat_ws(' ', subject, predicate, object, memory_text)) AS txt, least(greatest(coalesce(confidence, 0), 0), 1) AS conf FROM {C} JOIN {_SOURCES} src USING (card_id) WHERE src.doc IS NOT NULL),
cx AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, doc) AS rank FROM (SELECT query, doc, max(round(0.42 * c + 0.08 * conf, 6)) AS score FROM (SELECT q.query, cd.doc, any_value(cd.conf) AS conf, count(*)::DOUBLE / any_value(k.nt) AS c FROM cd JOIN q ON contains(cd.txt, q.term) JOIN k ON k.query = q.query GROUP BY q.query, cd.card_id, cd.doc) GROUP BY 1, 2)) WHERE rank <= 50),
fz AS (SELECT query, doc, sum(part) AS fused FROM (SELECT lx.query, doc, wl / (rrf + rank) AS part FROM lx JOIN k USING (query) UNION ALL SELECT vx.query, doc, wv / (rrf + rank) FROM vx JOIN k USING (query) UNION ALL SELECT cx.query, doc, wc / (rrf + rank) FROM cx JOIN k USING (query)) GROUP BY 1, 2)
"""


@query(_LANES + f""", dg AS (SELECT node AS doc, count(*) AS n_links FROM (SELECT source AS node, target AS other FROM {E} UNION ALL SELECT target, source FROM {E}) WHERE node IS NOT NULL AND other IS NOT NULL GROUP BY 1), st AS (SELECT DISTINCT target AS doc FROM {T} WHERE target IS NOT NULL),
dc AS (SELECT doc, {_DECAY}), x AS (SELECT fz.query, fz.doc, fused / max(fused) OVER (PARTITION BY fz.query) AS sem, dc.decay, coalesce(n_links, 0) AS n_links, st.doc IS NOT NULL AS old FROM fz JOIN (SELECT doc, decay FROM (SELECT doc, {_DECAY.replace(' END FROM ', ' END AS decay FROM ', 1)}) WHERE decay IS NOT NULL) dc USING (doc) LEFT JOIN dg USING (doc) LEFT JOIN st USING (doc))
SELECT query, doc, final, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY final DESC, doc) AS place FROM (SELECT query, doc, round((s1 * sem + s2 * decay + s3 * CASE WHEN old THEN 0.35 ELSE 0.5 END + s4 * least(1.0, n_links / 4.0)) * CASE WHEN old THEN 0.7 ELSE 1.0 END, 6) AS final FROM x JOIN k USING (query))) WHERE place <= 10""")
def retrieve(spark, d):
    """The ten best memories of each planned question at a point in time: lexical, vector and card lanes, fused and blended."""
    vec = _usable(spark, d).filter("memory_id is not null").groupBy(F.col("memory_id").alias("doc")).agg(F.min_by("embedding", "vector_id").alias("vec"))
    src = table(spark, d, "memory_cards", "card_id", "source_memory_id").groupBy(clean_id("card_id").alias("card_id")).agg(F.max(clean_id("source_memory_id")).alias("doc")).filter("doc is not null")
    c = cards(spark, d).join(src, "card_id").select("doc", F.concat_ws(" ", "subject", "predicate", "object", "memory_text").alias("text"), "confidence")
    degree = graph.both_ways(edges(spark, d)).groupBy(F.col("node").alias("doc")).agg(F.count("*").alias("n_links"))
    stale = tombstones(spark, d).select(F.col("target").alias("doc")).filter("doc is not null").distinct()
    return retrieval.retrieve(PLANS, memories(spark, d).withColumnRenamed("memory_id", "doc"), vec, c, degree, stale, AS_OF)


@query(f"""SELECT l.session_id, t.name AS question, round(0.48 * lx + 0.18 * tm + 0.24 * en + 0.04 * least(n, 8) / 8.0, 6) AS score FROM (SELECT session_id, count(*) AS n, lower(string_agg(text, ' ' ORDER BY turn)) AS txt FROM {L} GROUP BY 1) l,
LATERAL (SELECT name, len(list_filter(lex, lambda w: contains(l.txt, w))) / len(lex) AS lx, len(list_filter(tim, lambda w: contains(l.txt, w))) / len(tim) AS tm, len(list_filter(ent, lambda w: contains(l.txt, w))) / len(ent) AS en FROM (VALUES ('contract', ['contract', 'studio'], ['september', 'friday'], ['vuma', 'jilu']), ('piano', ['piano', 'lesson'], ['june', 'spring'], ['harbour', 'square'])) q(name, lex, tim, ent)) t WHERE lx + tm + en > 0""")
def router_scores(spark, d):
    """Sessions scored by how much of a question's words, times and names their turns hold, and by their depth."""
    asked = [("contract", ["contract", "studio"], ["september", "friday"], ["vuma", "jilu"]), ("piano", ["piano", "lesson"], ["june", "spring"], ["harbour", "square"])]
    words = sorted({w for _, *ls in asked for x in ls for w in x})
    t = ledger(spark, d).select("session_id", *[F.contains(F.lower("text"), F.lit(w)).alias(w) for w in words])
    s = t.groupBy("session_id").agg(F.count("*").alias("n"), *[F.max(w).alias(w) for w in words])  # no session's text is ever put together
    out = None
    for name, lex, tim, ent in asked:
        cover = lambda ws: sum((F.col(w).cast("int") for w in ws), F.lit(0)) / float(len(ws))
        x = s.filter(cover(lex) + cover(tim) + cover(ent) > 0).select("session_id", F.lit(name).alias("question"), F.round(0.48 * cover(lex) + 0.18 * cover(tim) + 0.24 * cover(ent) + 0.04 * F.least(F.col("n"), F.lit(8)) / 8.0, 6).alias("score"))
        out = x if out is None else out.unionByName(x)
    return out


# Bonuses of kinds for questions that want distilled or episodic memories, and for inference.
KIND_BONUS = {"distilled": {"Fact": 0.12, "SessionSummary": 0.08, "Lesson": 0.04}, "episodic": {"Conversational": 0.08, "Fact": -0.06, "SessionSummary": -0.14, "Lesson": -0.05, "Decision": -0.02, "Preference": -0.02},
              "inference": {"Fact": 0.07, "SessionSummary": 0.05, "Conversational": 0.02, "Lesson": 0.03, "Decision": 0.03, "Preference": 0.03}}
# Order of kinds among equals, for distilled and other questions.
KIND_PRIORITY = {"distilled": {"Fact": 4, "SessionSummary": 3, "Lesson": 2, "Conversational": 1}, "other": {"Conversational": 4, "Fact": 3, "SessionSummary": 2, "Lesson": 1}}


def _case(values: dict, default="0") -> str:
    return "CASE kind " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in values.items()) + f" ELSE {default} END"


def _when(values: dict, default=0.0):
    out = F.lit(default)
    for k, v in values.items():
        out = F.when(F.col("kind") == k, v).otherwise(out)
    return out


@query(f"""SELECT memory_id, round({_case(KIND_BONUS['distilled'])} + CASE WHEN march THEN 0.05 ELSE 0 END, 4)::DOUBLE AS distilled, round({_case(KIND_BONUS['episodic'])} + CASE WHEN march THEN 0.05 ELSE 0 END, 4)::DOUBLE AS episodic, round({_case(KIND_BONUS['inference'])}, 4)::DOUBLE AS inference,
    CASE WHEN age <= 45 THEN 0.025 WHEN age > 365 THEN -0.03 ELSE 0 END::DOUBLE AS temporal, CASE WHEN kind = 'Fact' AND age <= 180 THEN 0.02 WHEN kind = 'Fact' AND age > 730 THEN -0.025 ELSE 0 END::DOUBLE AS numeric, {_case(KIND_PRIORITY['distilled'])} AS first_distilled, {_case(KIND_PRIORITY['other'])} AS first_other
    FROM (SELECT memory_id, kind, contains(lower(content), 'march') AS march, greatest({AS_OF} - created_at_ms, 0) / 86400000.0 AS age FROM {M} WHERE content IS NOT NULL AND kind IS NOT NULL AND created_at_ms IS NOT NULL)""")
def kind_bonuses(spark, d):
    """What a memory gains or loses by its kind and age for different classes of questions, here about March."""
    m = memories(spark, d).filter("content is not null and kind is not null and created_at_ms is not null")
    march, age = F.when(F.contains(F.lower("content"), F.lit("march")), 0.05).otherwise(0.0), F.greatest(F.lit(AS_OF) - F.col("created_at_ms"), F.lit(0)) / 86_400_000.0
    temporal = F.when(age <= 45, 0.025).when(age > 365, -0.03).otherwise(0.0)
    numeric = F.when((F.col("kind") == "Fact") & (age <= 180), 0.02).when((F.col("kind") == "Fact") & (age > 730), -0.025).otherwise(0.0)
    return m.select("memory_id", F.round(_when(KIND_BONUS["distilled"]) + march, 4).alias("distilled"), F.round(_when(KIND_BONUS["episodic"]) + march, 4).alias("episodic"), F.round(_when(KIND_BONUS["inference"]), 4).alias("inference"),
                    temporal.alias("temporal"), numeric.alias("numeric"), _when(KIND_PRIORITY["distilled"], 0).alias("first_distilled"), _when(KIND_PRIORITY["other"], 0).alias("first_other"))


NEEDS = [(["contract", "studio"], []), (["telescope", "dollar", "paid"], []), (["subscription"], ["may", "june"])]  # requirements: words, and times of which one is needed
_SING = "CASE WHEN x LIKE '%ies' AND length(x) > 3 THEN regexp_replace(x, 'ies$', 'y') WHEN x LIKE '%s' AND x NOT LIKE '%ss' AND length(x) > 2 THEN regexp_replace(x, 's$', '') ELSE x END"
_BITS = " + ".join(f"CASE WHEN len(list_filter({lex!r}, lambda y: list_contains(w, y))) >= {1 if len(lex) <= 2 else 2}" + (f" AND len(list_filter({tim!r}, lambda y: contains(low, y))) > 0" if tim else "") + f" THEN {1 << i} ELSE 0 END" for i, (lex, tim) in enumerate(NEEDS))


@query(f"""SELECT session_id, bit_or(mask) AS mask FROM (SELECT session_id, {_BITS} AS mask FROM (SELECT session_id, lower(string_agg(text, ' ')) AS low, list_transform(flatten(list({_WORDS.format('text')})), lambda x: {_SING}) AS w FROM (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY length(text) DESC, turn) AS r FROM {L}) WHERE r <= 4 GROUP BY 1)) GROUP BY 1""")
def requirement_masks(spark, d):
    """Which of a question's requirements the four longest turns of each session meet together, as bits."""
    r = F.row_number().over(Window.partitionBy("session_id").orderBy(F.desc(F.length("text")), "turn"))
    t = ledger(spark, d).withColumn("r", r).filter("r <= 4")
    t = t.select("session_id", F.transform(text.similarity_tokens(F.col("text")), text.singular).alias("w"), F.lower("text").alias("low"))
    words, times = sorted({w for lex, _ in NEEDS for w in lex}), sorted({w for _, tim in NEEDS for w in tim})
    s = t.groupBy("session_id").agg(*[F.max(F.array_contains("w", w)).alias(f"w_{w}") for w in words], *[F.max(F.contains("low", F.lit(w))).alias(f"t_{w}") for w in times])
    mask = F.lit(0)
    for i, (lex, tim) in enumerate(NEEDS):
        hits = sum((F.col(f"w_{w}").cast("int") for w in lex), F.lit(0))
        ok = hits >= (1 if len(lex) <= 2 else 2)
        for_time = F.lit(not tim)
        for w in tim:
            for_time = for_time | F.col(f"t_{w}")
        mask = mask + F.when(ok & for_time, 1 << i).otherwise(0)
    return s.select("session_id", mask.alias("mask"))


# ---- plans of questions, made on the driver ---------------------------------------------------------

# question -> (class, keyword query, entities, rank or 0, start of the time window in ms and its end or 0, rank constant), worked out by hand from the rules
EXPECTED = [
    ("How many trips did we book in Oct 2023?", "numeric", "many trip we book in oct 2023", "Oct", 0, 1696118400000, 1698796800000, 55),
    ("How many trips in October were made before winter 2022?", "temporal", "many trip in october made before winter 2022", "October", 0, 1669852800000, 1677628800000, 55),
    ("When was the third audit of Vuma Studio?", "temporal", "wa the third audit of vuma studio", "Vuma Studio", 3, 0, 0, 45),
    ("Would Jejen likely choose yoga?", "inference", "would jejen likely choose yoga", "Jejen", 0, 0, 0, 50),
    ("any tips for the piano", "recommendation", "any tip for the piano", "", 0, 0, 0, 60),
    ("What is the nickname of Sorat?", "peripheral", "the nickname of sorat", "Sorat", 0, 0, 0, 40),
    ("hello again", "general", "hello again", "", 0, 0, 0, 60),
]


def _lit(x) -> str:
    return f"'{x}'" if isinstance(x, str) else str(x)


@query("SELECT question, intent, keywords, entities, CAST(place AS INTEGER) AS place, CAST(start_ms AS BIGINT) AS start_ms, CAST(end_ms AS BIGINT) AS end_ms, CAST(rrf_k AS INTEGER) AS rrf_k FROM (VALUES " + ", ".join("(" + ", ".join(_lit(x) for x in r) + ")" for r in EXPECTED) + ") v(question, intent, keywords, entities, place, start_ms, end_ms, rrf_k)")
def planned_questions(spark, d):
    """Plans of fixed questions: class, keywords, entities, rank, time window, rank constant; the SQL holds what the rules give, worked out by hand."""
    rows = []
    for q, *_ in EXPECTED:
        p = planner.plan(q)
        a, b = p.window or (0, 0)
        rows.append((q, p.intent, planner.keyword_query(q), " | ".join(p.entities), p.ordinal or 0, a, b, planner.rank_constant(p.intent, p.ordinal)))
    return spark.createDataFrame(rows, "question string, intent string, keywords string, entities string, place int, start_ms long, end_ms long, rrf_k int")
