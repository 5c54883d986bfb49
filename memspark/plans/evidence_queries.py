"""Queries of evidence: sessions packed, ranks measured, proofs checked, seeds expanded; and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import claims, dates, scoring, text
from memspark.operators import graph, retrieval, search
from memspark.operators.lineage import materialise
from memspark.operators.rows import clean_id
from memspark.plans.reference_queries import _BM25, AS_OF, M, QUESTIONS, _bm25, edges, memories, registry
from memspark.plans.retrieval_queries import _LANES, PLANS
from memspark.plans.store_queries import E, T, _usable, tombstones
from memspark.plans.text_queries import _LIKED, _MOVED, _date_sql
from memspark.sources.tables import table

QUERIES, SQL, query = registry()
_SESSION = "split_part({}, '::', 2)"


def _hits(spark, d, k: int) -> DataFrame:
    """First k memories of each question with their session and turn."""
    part = F.split("doc", "::")
    return _bm25(spark, d, k).select("query", "doc", "score", "rank", F.get(part, F.lit(1)).alias("session_id"), F.element_at(part, -1).try_cast("int").alias("turn"))


def _gold(spark, d) -> DataFrame:
    """(query, doc): memories with a question's first term in order of letters."""
    m = memories(spark, d).filter("content is not null").select(F.col("memory_id").alias("doc"), text.similarity_tokens(F.col("content")).alias("w"))
    first = F.explode(F.filter(F.array(*[F.when(F.array_contains("w", min(ts)), q) for q, ts in QUESTIONS]), _there))
    return m.select("doc", first.alias("query"))


def _there(x):
    return x.isNotNull()


# ---- sessions of hits --------------------------------------------------------------------


@query(_BM25 + f"SELECT query, session_id, best, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY best) AS place FROM (SELECT query, {_SESSION.format('doc')} AS session_id, min(rank) AS best FROM r WHERE rank <= 200 GROUP BY 1, 2)) WHERE place <= 8")
def top_sessions(spark, d):
    """The first eight different sessions among each question's hits, in the order of the hits."""
    s = _hits(spark, d, 200).groupBy("query", "session_id").agg(F.min("rank").alias("best"))
    return s.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy("best"))).filter("place <= 8")


@query(_BM25 + f"""SELECT query, session_id, doc, turn FROM (SELECT *, lag(content) OVER (PARTITION BY query, session_id ORDER BY turn, doc) AS before FROM (SELECT h.*, m.content FROM (SELECT query, doc, {_SESSION.format('doc')} AS session_id, TRY_CAST(split_part(doc, '::', -1) AS INT) AS turn, rank,
    row_number() OVER (PARTITION BY query, session_id ORDER BY rank) AS k, dense_rank() OVER (PARTITION BY query ORDER BY b) AS s FROM (SELECT *, min(rank) OVER (PARTITION BY query, {_SESSION.format('doc')}) AS b FROM r WHERE rank <= 200)) h JOIN {M} m ON m.memory_id = h.doc WHERE k <= 4 AND s <= 8)) WHERE before IS DISTINCT FROM content""")
def packed_hits(spark, d):
    """Up to four hits of each of the first eight sessions, in order of turns, without repeats behind one another."""
    h = materialise(_hits(spark, d, 200), "hits")
    best = h.groupBy("query", "session_id").agg(F.min("rank").alias("b")).withColumn("s", F.dense_rank().over(Window.partitionBy("query").orderBy("b"))).filter("s <= 8")
    h = h.join(best, ["query", "session_id"]).withColumn("k", F.row_number().over(Window.partitionBy("query", "session_id").orderBy("rank"))).filter("k <= 4")
    h = h.join(memories(spark, d).select(F.col("memory_id").alias("doc"), "content"), "doc")
    before = F.lag("content").over(Window.partitionBy("query", "session_id").orderBy("turn", "doc"))
    return h.withColumn("before", before).filter(~F.col("before").eqNullSafe(F.col("content"))).select("query", "session_id", "doc", "turn")


@query(_BM25 + f"SELECT query, session_id, entity_id, count(*) AS n_hits, any_value(n_turns) AS n_turns FROM (SELECT query, doc, {_SESSION.format('doc')} AS session_id FROM r WHERE rank <= 200) h JOIN (SELECT memory_id AS doc, entity_id FROM {M}) m USING (doc) JOIN (SELECT trim(session_id) AS session_id, trim(entity_id) AS entity_id, count(*) AS n_turns FROM ledger_turns WHERE trim(session_id) <> '' AND trim(entity_id) <> '' GROUP BY 1, 2) s USING (session_id, entity_id) GROUP BY 1, 2, 3")
def hits_routed(spark, d):
    """Hits joined with the session router by session and entity."""
    s = table(spark, d, "ledger_turns", "session_id", "entity_id").select(clean_id("session_id").alias("session_id"), clean_id("entity_id").alias("entity_id")).filter("session_id is not null and entity_id is not null")
    h = _hits(spark, d, 200).join(memories(spark, d).select(F.col("memory_id").alias("doc"), "entity_id"), "doc")
    h = h.groupBy("query", "session_id", "entity_id").agg(F.count("*").alias("n_hits"))
    return h.join(s.groupBy("session_id", "entity_id").agg(F.count("*").alias("n_turns")), ["session_id", "entity_id"])


@query(_BM25 + f"""SELECT doc, round(greatest(max(1 / (60 + rank)), 0) + CASE WHEN any_value(st.target) IS NOT NULL THEN 0.01 ELSE 0 END, 6)::DOUBLE AS score FROM r LEFT JOIN (SELECT DISTINCT target FROM {T}) st ON st.target = r.doc WHERE rank <= 100 GROUP BY 1""")
def fused_with_boosts(spark, d):
    """The greatest reciprocal rank of a memory over all questions, with a boost where it is pinned (here: tombstoned)."""
    pinned = tombstones(spark, d).select(F.col("target").alias("doc"), F.lit(0.01).alias("boost")).filter("doc is not null").distinct()
    best = _bm25(spark, d, 100).groupBy("doc").agg(F.max(1 / (60 + F.col("rank"))).alias("m"))
    return best.join(pinned, "doc", "left").select("doc", F.round(F.col("m") + F.coalesce("boost", F.lit(0.0)), 6).alias("score"))


# ---- measures ------------------------------------------------------------------------------


@query(_BM25 + """, g AS (SELECT f.query, t.doc FROM t JOIN (SELECT query, min(term) AS term FROM q GROUP BY 1) f ON list_contains(t.w, f.term)), x AS (SELECT g.query, count(*) AS n_gold, count(*) FILTER (r.rank <= 8) AS in8, count(*) FILTER (r.rank <= 50) AS in50 FROM g LEFT JOIN r ON r.query = g.query AND r.doc = g.doc GROUP BY 1)
SELECT query, n_gold, round(in8 / n_gold, 6) AS recall_8, round(in50 / n_gold, 6) AS recall_50, in8 > 0 AS any_8, in50 = n_gold AS all_50 FROM x""")
def recall_measures(spark, d):
    """Recall of each question's first term at 8 and 50, and whether any or all gold memories are found."""
    x = _gold(spark, d).join(_bm25(spark, d, 50), ["query", "doc"], "left").groupBy("query").agg(F.count("*").alias("n_gold"), F.count(F.when(F.col("rank") <= 8, 1)).alias("in8"), F.count("rank").alias("in50"))
    return x.select("query", "n_gold", F.round(F.col("in8") / F.col("n_gold"), 6).alias("recall_8"), F.round(F.col("in50") / F.col("n_gold"), 6).alias("recall_50"), (F.col("in8") > 0).alias("any_8"), (F.col("in50") == F.col("n_gold")).alias("all_50"))


FACETS = [(["contract", "studio"], [], []), (["telescope", "dollars", "paid"], [], []), (["subscription"], ["may", "june"], []), (["remember"], [], ["allergic"])]  # words, times, names
_MASK = " + ".join(f"CASE WHEN len(list_filter({lex!r}, lambda y: list_contains(w, y))) >= {1 if len(lex) <= 2 else 2}" + (f" AND len(list_filter({tim!r}, lambda y: contains(low, y))) > 0" if tim else "") + (f" AND len(list_filter({ent!r}, lambda y: contains(low, y))) > 0" if ent else "") + f" THEN {1 << i} ELSE 0 END" for i, (lex, tim, ent) in enumerate(FACETS))
_TOK = "list_filter(regexp_split_to_array(lower(content), '[^\\p{L}\\p{N}]+'), lambda t: strlen(t) > 1)"


@query(f"SELECT memory_id, mask FROM (SELECT memory_id, {_MASK} AS mask FROM (SELECT memory_id, lower(content) AS low, {_TOK} AS w FROM {M} WHERE content IS NOT NULL)) WHERE mask > 0")
def facet_masks(spark, d):
    """Which facets of a question each memory meets, as bits; of more than two words two are needed, of times and names one."""
    m = memories(spark, d).filter("content is not null").select("memory_id", text.similarity_tokens(F.col("content")).alias("w"), F.lower("content").alias("low"))
    return m.select("memory_id", scoring.facet_mask(F.col("w"), F.col("low"), FACETS).alias("mask")).filter("mask > 0")


@query(f"""SELECT memory_id, source_ok, lexical_hits, facets, source_ok AND lexical_hits >= 1 AND facets >= 1 AS verified, round(least(greatest(least(lexical_hits, 5) * 0.055 + least(facets, 5) * 0.045 + CASE WHEN source_ok THEN 0.2 ELSE 0 END + CASE WHEN source_ok AND lexical_hits >= 1 AND facets >= 1 THEN 0.15 ELSE 0 END, 0.05), 0.99), 6)::DOUBLE AS confidence
    FROM (SELECT memory_id, memory_id IN (SELECT trim(turn_id) FROM ledger_turns) AS source_ok, len(list_filter(['contract', 'studio', 'paid', 'dollars'], lambda y: list_contains(w, y))) AS lexical_hits, bit_count({_MASK}) AS facets FROM (SELECT memory_id, lower(content) AS low, {_TOK} AS w FROM {M} WHERE content IS NOT NULL))""")
def proof_checks(spark, d):
    """Whether a memory is backed by a turn, by words and by facets of a question, and the confidence that gives."""
    turns = table(spark, d, "ledger_turns", "turn_id").select(clean_id("turn_id").alias("memory_id"), F.lit(True).alias("there")).filter("memory_id is not null").distinct()
    m = memories(spark, d).filter("content is not null").select("memory_id", text.similarity_tokens(F.col("content")).alias("w"), F.lower("content").alias("low")).join(turns, "memory_id", "left")
    words = F.array(*[F.lit(x) for x in ("contract", "studio", "paid", "dollars")])
    x = m.select("memory_id", F.coalesce("there", F.lit(False)).alias("source_ok"), F.size(F.array_intersect(words, "w")).alias("lexical_hits"), F.bit_count(scoring.facet_mask(F.col("w"), F.col("low"), FACETS)).alias("facets"))
    ok = F.col("source_ok") & (F.col("lexical_hits") >= 1) & (F.col("facets") >= 1)
    score = F.least(F.col("lexical_hits"), F.lit(5)) * 0.055 + F.least(F.col("facets"), F.lit(5)) * 0.045 + F.when(F.col("source_ok"), 0.2).otherwise(0.0) + F.when(ok, 0.15).otherwise(0.0)
    return x.select("memory_id", "source_ok", "lexical_hits", "facets", ok.alias("verified"), F.round(F.least(F.greatest(score, F.lit(0.05)), F.lit(0.99)), 6).alias("confidence"))


PROBE = "Which contract did Vuma Studio sign in March with the piano teacher?"
_PW = [w for w in dict.fromkeys("which contract did vuma studio sign in march with the piano teacher".split()) if len(w) >= 4]


@query(f"""SELECT memory_id, lex, ent, tim FROM (SELECT memory_id, len(list_filter({_PW!r}, lambda y: contains(low, y))) AS lex, len(list_filter(['which', 'vuma', 'studio', 'march'], lambda y: contains(low, y))) AS ent, len(list_filter(['march'], lambda y: contains(low, y))) AS tim FROM (SELECT memory_id, lower(content) AS low FROM {M} WHERE content IS NOT NULL)) WHERE lex + ent + tim > 0""")
def overlap_counts(spark, d):
    """How many long words, capitalised words and times of a question each memory holds."""
    low = F.lower("content")
    count = lambda ws: F.size(F.filter(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(low, w)))
    caps = list(dict.fromkeys(w.strip("?.,").lower() for w in PROBE.split() if w[0].isupper()))
    m = memories(spark, d).filter("content is not null").select("memory_id", count(_PW).alias("lex"), count(caps).alias("ent"), count([w for w in text.TIME_WORDS if w in PROBE.lower()]).alias("tim"))
    return m.filter(F.col("lex") + F.col("ent") + F.col("tim") > 0)


# ---- graph lanes -------------------------------------------------------------------------------

_BOTH = f"(SELECT source AS node, target AS other, * FROM {E} UNION ALL SELECT target, source, * FROM {E})"
_W = "weight IS NOT NULL AND NOT isnan(weight) AND node IS NOT NULL AND other IS NOT NULL"


@query(_BM25 + f""", seeds AS (SELECT DISTINCT doc AS node FROM r WHERE rank <= 24), b AS (SELECT node, other FROM {_BOTH} WHERE node IS NOT NULL AND other IS NOT NULL), a1 AS (SELECT s.node AS seed, b.other AS node, 0.6 AS w FROM seeds s JOIN b ON b.node = s.node), a2 AS (SELECT a1.seed, b.other, 0.36 FROM a1 JOIN b ON b.node = a1.node),
nb AS (SELECT node, other, weight AS w FROM (SELECT *, row_number() OVER (PARTITION BY node ORDER BY weight DESC, edge_id, other) AS k FROM {_BOTH} WHERE {_W}) WHERE k <= 50), f AS (SELECT s.node AS seed, nb.other AS node, nb.w FROM seeds s JOIN nb ON nb.node = s.node), g AS (SELECT v.seed, nb.other AS node, 0.6 * nb.w AS w FROM (SELECT DISTINCT seed, node FROM f) v JOIN nb ON nb.node = v.node)
SELECT node, round(sum(w), 5) AS boost FROM (SELECT * FROM a1 UNION ALL SELECT * FROM a2 UNION ALL SELECT * FROM f UNION ALL SELECT * FROM g) GROUP BY 1""")
def seed_expansion(spark, d):
    """What the links and edges around the first hits add to other memories."""
    seeds = materialise(_bm25(spark, d, 24).select(F.col("doc").alias("node")).distinct(), "seeds")
    e = materialise(edges(spark, d), "edges")
    links, near = graph.cluster_scores(e, seeds), graph.edge_cluster_scores(e.filter("weight is not null and not isnan(weight)"), seeds)
    return links.unionByName(near).groupBy("node").agg(F.round(F.sum("score"), 5).alias("boost"))


@query(f"""SELECT memory_id, round(sum(0.5 * weight), 5) AS boost FROM (SELECT memory_id, weight FROM (SELECT trim(ed.memory_id) AS memory_id, b.weight, row_number() OVER (PARTITION BY b.node ORDER BY b.timestamp_ms DESC NULLS LAST, b.edge_id, b.other) AS k FROM {_BOTH} b JOIN (SELECT trim(edge_id) AS edge_id, min(trim(memory_id)) AS memory_id FROM edges GROUP BY 1) ed USING (edge_id)
    WHERE b.node IN (SELECT name FROM (SELECT DISTINCT trim(canonical_name) AS name FROM entity_registry WHERE trim(canonical_name) <> '')) AND b.edge_type <> 'default' AND b.other IS NOT NULL) WHERE k <= 50 AND memory_id <> '' AND weight IS NOT NULL AND NOT isnan(weight)) GROUP BY 1""")
def entity_lane(spark, d):
    """What the fifty newest edges of every registered name add to the memories they come from."""
    names = table(spark, d, "entity_registry", "canonical_name").select(clean_id("canonical_name").alias("node")).filter("node is not null").distinct()
    e = materialise(edges(spark, d), "edges")
    near = graph.neighbours(e, names, 50).select("edge_id")
    of = table(spark, d, "edges", "edge_id", "memory_id").groupBy(clean_id("edge_id").alias("edge_id")).agg(F.min(clean_id("memory_id")).alias("memory_id")).filter("memory_id is not null")
    x = near.join(e.filter("weight is not null and not isnan(weight)").select("edge_id", "weight"), "edge_id").join(of, "edge_id")
    return x.groupBy("memory_id").agg(F.round(F.sum(F.col("weight") * 0.5), 5).alias("boost"))


# ---- prototypes, kinds, events, blocks ---------------------------------------------------------------

_V = "(SELECT vector_id, any_value(kind) AS kind, any_value(embedding)::DOUBLE[] AS e FROM agent_observations WHERE vector_id IS NOT NULL AND kind IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 GROUP BY 1)"


@query(f"""WITH v AS {_V}, c AS (SELECT kind, list(m ORDER BY dim) AS c FROM (SELECT kind, dim, avg(x) AS m FROM (SELECT kind, unnest(e) AS x, generate_subscripts(e, 1) AS dim FROM v) GROUP BY 1, 2) GROUP BY 1)
SELECT vector_id, kind AS nearest, score FROM (SELECT vector_id, c.kind, round((list_cosine_similarity(e, c) + 1) / 2, 5) AS score, row_number() OVER (PARTITION BY vector_id ORDER BY round((list_cosine_similarity(e, c) + 1) / 2, 5) DESC, c.kind) AS k FROM v, c) WHERE k = 1 AND score >= 0.38""")
def nearest_prototype(spark, d):
    """The kind whose mean vector an observation is most like, if it is like enough."""
    o = table(spark, d, "agent_observations", "vector_id", "kind", "embedding").filter("vector_id is not null and kind is not null").filter((F.size("embedding") == 64) & F.forall("embedding", _finite) & F.exists("embedding", _not_zero))
    o = materialise(o.groupBy("vector_id").agg(F.first("kind").alias("kind"), F.first("embedding").alias("e")), "vectors")
    mean = o.select("kind", F.posexplode("e").alias("dim", "x")).groupBy("kind", "dim").agg(F.avg(F.col("x").cast("double")).alias("m"))
    c = F.broadcast(mean.groupBy(F.col("kind").alias("proto")).agg(F.transform(F.array_sort(F.collect_list(F.struct("dim", "m"))), _mean_of).alias("c")))  # as many rows as kinds
    x = o.crossJoin(c).select("vector_id", "proto", F.round((scoring.cosine(F.col("e"), F.col("c")) + 1) / 2, 5).alias("score"))
    best = x.groupBy("vector_id").agg(F.min(F.struct((-F.col("score")).alias("s"), "proto")).alias("b"))
    return best.select("vector_id", F.col("b.proto").alias("nearest"), (-F.col("b.s")).alias("score")).filter("score >= 0.38")


def _finite(x):
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


def _not_zero(x):
    return x != 0


def _mean_of(x):
    return x["m"]


@query("""SELECT spelled, kind, count(*) AS n FROM (SELECT doc_kind AS spelled, CASE lower(doc_kind) WHEN 'decision' THEN 'Decision' WHEN 'lesson' THEN 'Lesson' WHEN 'preference' THEN 'Preference' WHEN 'fact' THEN 'Fact' WHEN 'session_summary' THEN 'SessionSummary' WHEN 'session-summary' THEN 'SessionSummary' WHEN 'sessionsummary' THEN 'SessionSummary' ELSE 'Conversational' END AS kind FROM documents
    UNION ALL SELECT upper(kind), kind FROM memories WHERE kind IS NOT NULL) GROUP BY 1, 2""")
def parsed_kinds(spark, d):
    """Kinds read from their spellings; unknown and absent ones are conversational."""
    docs = table(spark, d, "documents", "doc_kind").select(F.col("doc_kind").alias("spelled"))
    mem = table(spark, d, "memories", "kind").filter("kind is not null").select(F.upper("kind").alias("spelled"))
    return docs.unionByName(mem).select("spelled", text.parsed_kind(F.col("spelled")).alias("kind")).groupBy("spelled", "kind").agg(F.count("*").alias("n"))


@query(f"""SELECT memory_id || '::event' AS event_id, entity_id, event_ms, substr(trim(t), 1, 120) AS what FROM (SELECT memory_id, entity_id, t, coalesce(date_ms, {_MOVED}) AS event_ms FROM {_date_sql(f"(SELECT memory_id, entity_id, content AS t, created_at_ms AS ref FROM {M} WHERE content IS NOT NULL AND created_at_ms IS NOT NULL AND entity_id IS NOT NULL)", "memory_id, entity_id")}) WHERE event_ms IS NOT NULL""")
def temporal_events(spark, d):
    """An event row for every memory that tells a time."""
    m = memories(spark, d).filter("content is not null and created_at_ms is not null and entity_id is not null").select("memory_id", "entity_id", "content", "created_at_ms")
    m = materialise(dates.with_date_ms(m, "content", "created_at_ms").withColumn("event_ms", F.coalesce("date_ms", dates.moved_ms(F.col("content"), F.col("created_at_ms")))), "events")
    return m.filter("event_ms is not null").select(F.concat("memory_id", F.lit("::event")).alias("event_id"), "entity_id", "event_ms", F.substring(F.trim("content"), 1, 120).alias("what"))


@query(f"""SELECT entity_id, '## MEMORY CONTEXT' || chr(10) || '### Relevant Memories' || chr(10) || string_agg('- ' || content, chr(10) ORDER BY r) AS block FROM (SELECT entity_id, content, row_number() OVER (PARTITION BY entity_id ORDER BY created_at_ms DESC, memory_id) AS r FROM {M} WHERE content IS NOT NULL AND entity_id IS NOT NULL AND created_at_ms IS NOT NULL) WHERE r <= 5 GROUP BY 1""")
def observation_blocks(spark, d):
    """The five newest memories of each entity as a block of text."""
    m = memories(spark, d).filter("content is not null and entity_id is not null and created_at_ms is not null")
    m = m.withColumn("r", F.row_number().over(Window.partitionBy("entity_id").orderBy(F.desc("created_at_ms"), "memory_id"))).filter("r <= 5")
    lines = F.transform(F.array_sort(F.collect_list(F.struct("r", "content"))), _as_item)
    return m.groupBy("entity_id").agg(F.concat_ws("\n", F.lit("## MEMORY CONTEXT"), F.lit("### Relevant Memories"), lines).alias("block"))


def _as_item(x):
    return F.concat(F.lit("- "), x["content"])


# ---- JSON in texts ----------------------------------------------------------------------------------


@query("""SELECT doc_id, i - 1 AS place, json_extract_string(text, '$.turns[' || (i - 1) || '].role') AS role, trim(regexp_replace(json_extract_string(text, '$.turns[' || (i - 1) || '].text'), '[\\s\\p{Z}]+', ' ', 'g')) AS said
    FROM (SELECT doc_id, text, unnest(range(1, 1 + json_array_length(text, '$.turns')::BIGINT)) AS i FROM documents WHERE text IS NOT NULL AND starts_with(ltrim(text), '{') AND json_valid(text)) WHERE json_extract_string(text, '$.turns[' || (i - 1) || '].text') <> ''""")
def json_turns(spark, d):
    """Turns of documents that are JSON records; broken ones have none."""
    t = table(spark, d, "documents", "doc_id", "text").filter(F.ltrim("text").startswith("{"))
    t = t.select("doc_id", F.from_json("text", "turns array<struct<role: string, text: string>>").alias("j")).select("doc_id", F.posexplode("j.turns").alias("place", "t"))
    return t.filter("t.text <> ''").select("doc_id", F.col("place").cast("long").alias("place"), F.col("t.role").alias("role"), text.one_line(F.col("t.text")).alias("said"))


@query(f"SELECT tombstone_id, array_to_string(json_keys(tombstone_json)[1:2], ',') AS keys, len(json_keys(tombstone_json)) AS n FROM {T} WHERE json_valid(tombstone_json)")
def clipped_json(spark, d):
    """The first two keys of every tombstone's record, and how many it has."""
    keys = F.json_object_keys("tombstone_json")
    return tombstones(spark, d).filter(keys.isNotNull()).select("tombstone_id", F.array_join(F.slice(keys, 1, 2), ",").alias("keys"), F.size(keys).cast("long").alias("n"))


# ---- lanes by themselves ------------------------------------------------------------------------------


def _lanes(spark, d) -> tuple[DataFrame, DataFrame]:
    m = memories(spark, d).withColumnRenamed("memory_id", "doc").filter(F.col("content").isNotNull() & (F.col("created_at_ms") <= AS_OF))
    lexical = materialise(search.bm25(m, "doc", "content", [(n, p.terms) for n, p in PLANS], retrieval.DEPTH), "lexical")
    vec = _usable(spark, d).filter("memory_id is not null").groupBy(F.col("memory_id").alias("doc")).agg(F.min_by("embedding", "vector_id").alias("vec"))
    return lexical, materialise(retrieval.vector_lane(lexical.select("query", "doc", "rank"), vec), "vectors")


@query(_LANES + "SELECT query, doc, min(lane) AS lane, min(place) AS place FROM (SELECT query, doc, 'first' AS lane, rank AS place FROM vx WHERE rank <= 10 UNION ALL SELECT query, doc, 'second', 10 + rank FROM lx WHERE rank <= 10) GROUP BY 1, 2")
def combined_search(spark, d):
    """The ten most similar memories of each question, then the ten best by words, each once; scores of the two are not compared."""
    lexical, near = _lanes(spark, d)
    both = near.filter("rank <= 10").select("query", "doc", F.lit("first").alias("lane"), F.col("rank").alias("place")).unionByName(lexical.filter("rank <= 10").select("query", "doc", F.lit("second").alias("lane"), (F.col("rank") + 10).alias("place")))
    return both.groupBy("query", "doc").agg(F.min("lane").alias("lane"), F.min("place").alias("place"))


@query(_LANES + f", sm AS (SELECT memory_id AS doc, CAST({_LIKED.split(', CASE WHEN lower(trim(predicate))')[0].replace('memory_text', 'content')}) AS DOUBLE) AS strength FROM {M} WHERE content IS NOT NULL) SELECT query, doc, round(0.12 * cosine + 0.04 * strength, 6) AS boost FROM vx JOIN sm USING (doc) WHERE cosine >= 0.35 AND strength > 0")
def preference_boosts(spark, d):
    """What preferences among the most similar memories add: by how similar and how strong they are."""
    _, near = _lanes(spark, d)
    m = memories(spark, d).filter("content is not null").select(F.col("memory_id").alias("doc"), claims.preference_strength(F.col("content")).alias("strength")).filter("strength is not null")
    return near.filter("cosine >= 0.35").join(m, "doc").select("query", "doc", F.round(0.12 * F.col("cosine") + 0.04 * F.col("strength"), 6).alias("boost"))


@query(_LANES + f""", a AS (SELECT query, {_SESSION.format('doc')} AS session_id, min(rank) AS b FROM lx GROUP BY 1, 2), b AS (SELECT query, {_SESSION.format('doc')} AS session_id, min(rank) AS b FROM vx GROUP BY 1, 2),
u AS (SELECT query, session_id, row_number() OVER (PARTITION BY query ORDER BY b) AS r FROM a UNION ALL SELECT query, session_id, row_number() OVER (PARTITION BY query ORDER BY b) FROM b)
SELECT query, session_id, score, place FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, session_id) AS place FROM (SELECT query, session_id, round(sum(1 / (60 + r)), 6)::DOUBLE AS score FROM u GROUP BY 1, 2)) WHERE place <= 8""")
def routed_sessions(spark, d):
    """Eight sessions for each question, by the votes of its hits by words and by vectors."""
    out = None
    for name, lane in zip(("words", "vectors"), _lanes(spark, d), strict=True):
        s = lane.groupBy("query", F.get(F.split("doc", "::"), F.lit(1)).alias("session_id")).agg(F.min("rank").alias("b"))
        s = s.select("query", "session_id", F.row_number().over(Window.partitionBy("query").orderBy("b")).alias("r"), F.lit(name).alias("lane"))
        out = s if out is None else out.unionByName(s)
    votes = out.groupBy("query", "session_id").agg(F.round(F.sum(1 / (60 + F.col("r"))), 6).alias("score"))
    return votes.withColumn("place", F.row_number().over(Window.partitionBy("query").orderBy(F.desc("score"), "session_id"))).filter("place <= 8")
