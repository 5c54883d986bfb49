"""Queries of lookups, row changes, filters, joins and graph walks over the stored tables, and their SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators import changes, graph, search, temporal
from memspark.operators.lineage import materialise, scratch_root
from memspark.operators.ordered import dense_order
from memspark.operators.rows import clean_id
from memspark.plans.reference_queries import AS_OF, C, E, L, M, NOW, _versions, cards, edges, events, ledger, memories, registry
from memspark.sources.payloads import read_payloads, write_payloads
from memspark.sources.tables import table
from memspark.streaming import pipelines

QUERIES, SQL, query = registry()
SPLIT = 1_770_000_000_000  # rows before it stand for what is stored, later ones for what arrives
NAMED = ("prefers", "works_at", "lives_in", "caused_by", "leads_to", "default")
_NAMED = "('" + "', '".join(NAMED) + "')"
O = "(SELECT vector_id, min(trim(memory_id)) AS memory_id, min(trim(entity_id)) AS entity_id, any_value(embedding) AS embedding FROM agent_observations WHERE vector_id IS NOT NULL GROUP BY 1)"  # noqa: E741
T = "(SELECT DISTINCT trim(tombstone_id) AS tombstone_id, nullif(trim(target_memory_id), '') AS target, timestamp_ms, tombstone_json FROM deletion_tombstones)"
REG = "(SELECT nullif(trim(canonical_name), '') AS name, min(nullif(trim(entity_id), '')) AS entity_id FROM entity_registry WHERE trim(canonical_name) <> '' GROUP BY 1)"


def observations(spark, d) -> DataFrame:
    o = table(spark, d, "agent_observations", "vector_id", "memory_id", "entity_id", "embedding").filter("vector_id is not null")
    return o.select("vector_id", clean_id("memory_id").alias("memory_id"), clean_id("entity_id").alias("entity_id"), "embedding").groupBy("vector_id").agg(
        F.min("memory_id").alias("memory_id"), F.min("entity_id").alias("entity_id"), F.first("embedding").alias("embedding"))


def tombstones(spark, d) -> DataFrame:
    t = table(spark, d, "deletion_tombstones", "tombstone_id", "target_memory_id", "timestamp_ms", "tombstone_json")
    return t.select(clean_id("tombstone_id").alias("tombstone_id"), clean_id("target_memory_id").alias("target"), "timestamp_ms", "tombstone_json").distinct()


def registered(spark, d) -> DataFrame:
    r = table(spark, d, "entity_registry", "canonical_name", "entity_id").select(clean_id("canonical_name").alias("name"), clean_id("entity_id").alias("entity_id"))
    return r.filter("name is not null").groupBy("name").agg(F.min("entity_id").alias("entity_id"))


# ---- sources and lookups ---------------------------------------------------------------


@query(f"SELECT memory_id, entity_id, kind, length(content) AS n_chars, created_at_ms FROM {M} WHERE content IS NOT NULL AND entity_id IS NOT NULL")
def ingest_json(spark, d):
    """The memories sent as JSON payloads and read again with the payload schema."""
    m = memories(spark, d).filter("content is not null and entity_id is not null")
    sent = m.select("entity_id", "memory_id", F.col("created_at_ms").alias("timestamp"), F.col("content").alias("textual_content"), "kind")
    path = f"{scratch_root(spark)}/payloads-{uuid.uuid4().hex[:8]}"
    write_payloads(sent, path)
    return read_payloads(spark, path).select("memory_id", "entity_id", "kind", F.length("textual_content").alias("n_chars"), F.col("timestamp").alias("created_at_ms"))


@query(f"SELECT r.place, r.vector_id, o.memory_id FROM (SELECT vector_id AS place, vector_id + CASE WHEN vector_id % 3 = 0 THEN 1 ELSE 0 END AS vector_id FROM {O}) r LEFT JOIN {O} o ON o.vector_id = r.vector_id")
def observations_in_order(spark, d):
    """A list of vector ids looked up in its own order; one in three asks for the id behind, missing ones are null."""
    o = materialise(observations(spark, d).select("vector_id", "memory_id"), "observations")
    asked = o.select(F.col("vector_id").alias("place"), (F.col("vector_id") + F.when(F.col("vector_id") % 3 == 0, 1).otherwise(0)).alias("vector_id"))
    return asked.join(o, "vector_id", "left").select("place", "vector_id", "memory_id")


@query(f"SELECT memory_id, entity_id, kind, content, created_at_ms FROM {M} WHERE memory_id IN (SELECT trim(memory_id) FROM edges WHERE memory_id IS NOT NULL)")
def observations_by_memory(spark, d):
    """The memories edges name: entity, kind, text and time."""
    keys = table(spark, d, "edges", "memory_id").select(clean_id("memory_id").alias("memory_id")).filter("memory_id is not null").distinct()
    return memories(spark, d).join(keys, "memory_id", "left_semi").select("memory_id", "entity_id", "kind", "content", "created_at_ms")


@query(f"SELECT card_id, subject, predicate, object FROM {C} WHERE card_id IN (SELECT trim(parent_card_id) FROM memory_cards WHERE parent_card_id IS NOT NULL)")
def cards_by_key(spark, d):
    """The cards other cards name as their parents."""
    keys = table(spark, d, "memory_cards", "parent_card_id").select(clean_id("parent_card_id").alias("card_id")).filter("card_id is not null").distinct()
    return cards(spark, d).join(keys, "card_id", "left_semi").select("card_id", "subject", "predicate", "object")


@query("""SELECT DISTINCT trim(turn_id) AS turn_id, turn_index, raw_text FROM ledger_turns WHERE trim(turn_id) IN (SELECT trim(source_memory_id) FROM memory_cards WHERE source_memory_id IS NOT NULL)""")
def turns_by_id(spark, d):
    """The ledger turns cards were taken from."""
    keys = table(spark, d, "memory_cards", "source_memory_id").select(clean_id("source_memory_id").alias("turn_id")).filter("turn_id is not null").distinct()
    return table(spark, d, "ledger_turns", "turn_id", "turn_index", "raw_text").withColumn("turn_id", clean_id("turn_id")).distinct().join(keys, "turn_id", "left_semi")


_ARTIFACTS = "(SELECT source_session_id AS artifact_id, list(DISTINCT trim(source_memory_id)) AS ids FROM memory_cards WHERE source_session_id IS NOT NULL AND trim(source_memory_id) <> '' GROUP BY 1)"


@query(f"SELECT t.target AS memory_id, a.artifact_id, len(a.ids) AS n_sources FROM (SELECT DISTINCT target FROM {T} WHERE target IS NOT NULL) t JOIN {_ARTIFACTS} a ON list_contains(a.ids, t.target)")
def artifacts_of_memory(spark, d):
    """Artifacts (a session's cards together) that hold a deleted memory among their sources; an exact member test, by exploded keys."""
    c = table(spark, d, "memory_cards", "source_session_id", "source_memory_id").select(F.col("source_session_id").alias("artifact_id"), clean_id("source_memory_id").alias("memory_id"))
    a = c.filter("artifact_id is not null and memory_id is not null").distinct()
    n = a.groupBy("artifact_id").agg(F.count("*").alias("n_sources"))
    gone = tombstones(spark, d).select(F.col("target").alias("memory_id")).filter("memory_id is not null").distinct()
    return a.join(gone, "memory_id", "left_semi").join(n, "artifact_id").select("memory_id", "artifact_id", "n_sources")


@query("""SELECT card_id, updated_at_ms, place FROM (SELECT card_id, updated_at_ms, row_number() OVER (PARTITION BY card_id ORDER BY updated_at_ms DESC) AS place
    FROM (SELECT DISTINCT trim(card_id) AS card_id, updated_at_ms FROM memory_cards WHERE trim(card_id) <> '' AND updated_at_ms IS NOT NULL)) WHERE place <= 3""")
def artifact_versions(spark, d):
    """The three newest stored versions of every card."""
    v = table(spark, d, "memory_cards", "card_id", "updated_at_ms").select(clean_id("card_id").alias("card_id"), "updated_at_ms").filter("card_id is not null and updated_at_ms is not null").distinct()
    return v.withColumn("place", F.row_number().over(Window.partitionBy("card_id").orderBy(F.desc("updated_at_ms")))).filter("place <= 3")


@query(f"""SELECT target, tombstone_id, place FROM (SELECT target, tombstone_id, row_number() OVER (PARTITION BY target ORDER BY timestamp_ms DESC NULLS LAST, tombstone_id) AS place FROM {T} WHERE target IS NOT NULL AND json_valid(tombstone_json)) WHERE place <= 5""")
def tombstones_of_target(spark, d):
    """Up to five newest tombstones of every target; rows with broken JSON are skipped."""
    t = tombstones(spark, d).filter(F.col("target").isNotNull() & F.from_json("tombstone_json", "map<string,string>").isNotNull())
    place = F.row_number().over(Window.partitionBy("target").orderBy(F.desc_nulls_last("timestamp_ms"), "tombstone_id"))
    return t.withColumn("place", place).filter("place <= 5").select("target", "tombstone_id", "place")


@query(f"""SELECT e.entity_id, coalesce(n, 0) AS n_notes, coalesce(first_ms, 0) AS first_ms, coalesce(last_ms, 0) AS last_ms FROM (SELECT DISTINCT trim(entity_id) AS entity_id FROM metrics WHERE trim(entity_id) <> '') e
    LEFT JOIN (SELECT entity_id, count(*) AS n, min(created_at_ms) AS first_ms, max(created_at_ms) AS last_ms FROM {M} WHERE entity_id IS NOT NULL GROUP BY 1) p USING (entity_id)""")
def profile_reads(spark, d):
    """Profiles of the entities metrics name, with defaults where there is none."""
    asked = table(spark, d, "metrics", "entity_id").select(clean_id("entity_id").alias("entity_id")).filter("entity_id is not null").distinct()
    p = memories(spark, d).groupBy("entity_id").agg(F.count("*").alias("n_notes"), F.min("created_at_ms").alias("first_ms"), F.max("created_at_ms").alias("last_ms"))
    return asked.join(p, "entity_id", "left").na.fill(0)


_UNIT = f"(SELECT * FROM {O} WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64 AND entity_id IS NOT NULL)"


def _usable(spark, d) -> DataFrame:
    return observations(spark, d).filter(F.col("entity_id").isNotNull() & (F.size("embedding") == 64) & F.forall("embedding", _finite))


def _finite(x):
    return x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))


@query(f"SELECT entity_id, dim, round(avg(v), 6) AS mean FROM (SELECT entity_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM {_UNIT}) GROUP BY 1, 2")
def entity_centroids(spark, d):
    """Mean vector of each entity's usable observations, one row per dimension."""
    x = _usable(spark, d).select("entity_id", F.posexplode("embedding").alias("dim", "v"))
    return x.groupBy("entity_id", F.col("dim").cast("long").alias("dim")).agg(F.round(F.avg(F.col("v").cast("double")), 6).alias("mean"))


@query(f"""WITH x AS (SELECT entity_id, unnest(embedding)::DOUBLE AS v, generate_subscripts(embedding, 1) - 1 AS dim FROM {_UNIT}), a AS (SELECT dim, avg(v) AS m FROM x GROUP BY 1), c AS (SELECT entity_id, dim, avg(v) AS m FROM x GROUP BY 1, 2),
g AS (SELECT entity_id, dim, c.m - a.m AS diff FROM c JOIN a USING (dim)), n AS (SELECT entity_id, sqrt(sum(diff * diff)) AS norm FROM g GROUP BY 1) SELECT entity_id, dim, round(diff / norm, 5) + 0.0 AS direction FROM g JOIN n USING (entity_id) WHERE norm > 0""")
def centroid_direction(spark, d):
    """Direction of length one from the centroid of all observations to each entity's."""
    x = _usable(spark, d).select("entity_id", F.posexplode("embedding").alias("dim", "v")).withColumn("dim", F.col("dim").cast("long"))
    c = materialise(x.groupBy("entity_id", "dim").agg(F.sum(F.col("v").cast("double")).alias("s"), F.count("*").alias("n")), "centroids")
    a = F.broadcast(c.groupBy("dim").agg((F.sum("s") / F.sum("n")).alias("m")))  # one row per dimension
    g = c.join(a, "dim").select("entity_id", "dim", (F.col("s") / F.col("n") - F.col("m")).alias("diff"))
    n = g.groupBy("entity_id").agg(F.sqrt(F.sum(F.col("diff") * F.col("diff"))).alias("norm")).filter("norm > 0")
    return g.join(n, "entity_id").select("entity_id", "dim", (F.round(F.col("diff") / F.col("norm"), 5) + 0.0).alias("direction"))


@query(f"""SELECT m.memory_id, coalesce(v.vector_id, 0) AS vector_id, coalesce(c.n, 0) AS n_cards, coalesce(l.n, 0) AS n_turns, t.target IS NOT NULL AS deleted, coalesce(c.lifecycle, l.lifecycle, '') AS lifecycle, coalesce(w.n, 0) AS n_around
FROM {M} m LEFT JOIN (SELECT memory_id, min(vector_id) AS vector_id FROM {O} GROUP BY 1) v USING (memory_id)
LEFT JOIN (SELECT trim(source_memory_id) AS memory_id, count(DISTINCT trim(card_id)) AS n, max(lifecycle) AS lifecycle FROM memory_cards GROUP BY 1) c USING (memory_id)
LEFT JOIN (SELECT trim(turn_id) AS memory_id, count(*) AS n, max(lifecycle) AS lifecycle FROM ledger_turns GROUP BY 1) l USING (memory_id)
LEFT JOIN (SELECT DISTINCT target FROM {T}) t ON t.target = m.memory_id
LEFT JOIN (SELECT a.memory_id, least(count(*), 8) AS n FROM {M} a JOIN {L} b ON b.session_id = split_part(a.memory_id, '::', 2) AND b.turn BETWEEN TRY_CAST(split_part(a.memory_id, '::', -1) AS INT) - 2 AND TRY_CAST(split_part(a.memory_id, '::', -1) AS INT) + 2 GROUP BY 1) w USING (memory_id)""")
def memory_inspect(spark, d):
    """All that is stored about each memory: vector, cards, turns, deletion, first lifecycle of card and ledger, and how many turns lie around it."""
    m = materialise(memories(spark, d).select("memory_id"), "memories")
    v = observations(spark, d).groupBy("memory_id").agg(F.min("vector_id").alias("vector_id"))
    c = table(spark, d, "memory_cards", "source_memory_id", "card_id", "lifecycle").groupBy(clean_id("source_memory_id").alias("memory_id")).agg(F.count_distinct(clean_id("card_id")).alias("n_cards"), F.max("lifecycle").alias("c_life"))
    t = table(spark, d, "ledger_turns", "turn_id", "lifecycle").groupBy(clean_id("turn_id").alias("memory_id")).agg(F.count("*").alias("n_turns"), F.max("lifecycle").alias("t_life"))
    gone = tombstones(spark, d).select(F.col("target").alias("memory_id"), F.lit(True).alias("deleted")).distinct()
    part = F.split("memory_id", "::")
    at = m.select("memory_id", F.get(part, F.lit(1)).alias("session_id"), F.element_at(part, -1).try_cast("int").alias("t")).filter("session_id is not null")
    wanted = at.select("memory_id", "session_id", F.explode(F.sequence(F.col("t") - 2, F.col("t") + 2)).alias("turn"))  # an equality join instead of a range
    around = wanted.join(ledger(spark, d).select("session_id", "turn"), ["session_id", "turn"]).groupBy("memory_id").agg(F.least(F.count("*"), F.lit(8)).alias("n_around"))
    x = m.join(v, "memory_id", "left").join(c, "memory_id", "left").join(t, "memory_id", "left").join(gone, "memory_id", "left").join(around, "memory_id", "left")
    return x.na.fill(0, ["vector_id", "n_cards", "n_turns", "n_around"]).select("memory_id", "vector_id", "n_cards", "n_turns", F.coalesce("deleted", F.lit(False)).alias("deleted"), F.coalesce("c_life", "t_life", F.lit("")).alias("lifecycle"), "n_around")


# ---- row changes ---------------------------------------------------------------------------


@query(f"""WITH old AS (SELECT memory_id, min(vector_id) AS vector_id FROM {O} WHERE memory_id IS NOT NULL GROUP BY 1)
SELECT memory_id, coalesce(old.vector_id, (SELECT max(vector_id) FROM agent_observations) + row_number() OVER (PARTITION BY old.vector_id IS NULL ORDER BY memory_id)) AS vector_id FROM {M} LEFT JOIN old USING (memory_id)""")
def vector_ids_allocated(spark, d):
    """Memories with their stored vector id, or a new one behind the greatest in order of memory id; numbered by ranges, not in one task."""
    o = observations(spark, d).filter("memory_id is not null").groupBy("memory_id").agg(F.min("vector_id").alias("vector_id"))
    top = F.broadcast(table(spark, d, "agent_observations", "vector_id").agg(F.max("vector_id").alias("top")))
    m = materialise(memories(spark, d).select("memory_id").join(o, "memory_id", "left"), "ids")
    fresh, _ = dense_order(m.filter("vector_id is null").select("memory_id"), "memory_id")
    new = fresh.crossJoin(top).select("memory_id", (F.col("top") + F.col("pos") + 1).alias("vector_id"))
    return m.filter("vector_id is not null").unionByName(new)


@query(f"""WITH base AS (SELECT name FROM {REG}), new AS (SELECT source AS name, min(edge_id) AS origin FROM {E} WHERE edge_type IN {_NAMED} AND source IS NOT NULL GROUP BY 1)
SELECT name, 'registry' AS origin FROM base UNION ALL SELECT name, origin FROM new WHERE name NOT IN (SELECT name FROM base)""")
def names_registered(spark, d):
    """Names of edges added to the registry where they are absent; the first edge is kept, stored names stay."""
    base = registered(spark, d).select("name", F.lit("registry").alias("origin"))
    new = edges(spark, d).filter(F.col("edge_type").isin(*NAMED) & F.col("source").isNotNull()).select(F.col("source").alias("name"), F.col("edge_id").alias("origin"))
    return changes.insert_if_absent(base, new, ["name"], ["origin"])


_ROUTER = f"(SELECT session_id, entity_id, source_type, turn, text FROM {L} WHERE entity_id IS NOT NULL AND source_type IS NOT NULL)"


@query(f"""SELECT session_id, entity_id, count(*) AS n_turns, array_to_string(list_sort(list(DISTINCT source_type)), ',') AS source_types, min(turn) AS first_turn, max(turn) AS last_turn FROM {_ROUTER} GROUP BY 1, 2""")
def router_merged(spark, d):
    """Session routers of even turns stored, those of odd turns merged into them: lists appended without repeats, counts added."""
    t = ledger(spark, d).filter("entity_id is not null and source_type is not null")

    def router(x: DataFrame) -> DataFrame:
        return x.groupBy("session_id", "entity_id").agg(F.count("*").alias("n_turns"), F.sort_array(F.collect_set("source_type")).alias("types"), F.min("turn").alias("first_turn"), F.max("turn").alias("last_turn"))

    stored, new = materialise(router(t.filter("turn % 2 = 0")), "router"), router(t.filter("turn % 2 = 1"))
    out = changes.merge_lists(stored, new, ["session_id", "entity_id"], {"n_turns": F.sum, "first_turn": F.min, "last_turn": F.max}, ["types"])
    return out.select("session_id", "entity_id", "n_turns", F.array_join(F.array_sort("types"), ",").alias("source_types"), "first_turn", "last_turn")


@query(f"SELECT card_id, CASE WHEN card_id IN (SELECT parent_card_id FROM {C} WHERE parent_card_id IS NOT NULL) THEN 0 ELSE 1 END AS is_latest FROM {C}")
def latest_flags(spark, d):
    """is_latest set anew: 0 for cards that another one follows."""
    c = materialise(cards(spark, d).select("card_id", "parent_card_id"), "cards")
    up = c.select(F.col("parent_card_id").alias("card_id"), F.lit(0).alias("off")).filter("card_id is not null").distinct()
    return c.join(up, "card_id", "left").select("card_id", F.coalesce("off", F.lit(1)).alias("is_latest"))


@query("""SELECT timestamp_ms, entity_id, label, max(h) AS h FROM (SELECT timestamp_ms, trim(entity_id) AS entity_id, label, sha256(timestamp_ms || '|' || trim(entity_id) || '|' || label || '|' || CAST(round(value * 1000) AS BIGINT)) AS h
    FROM metrics WHERE timestamp_ms IS NOT NULL AND trim(entity_id) <> '' AND label IS NOT NULL AND value IS NOT NULL AND NOT isnan(value) AND abs(value) < 1e12) GROUP BY 1, 2, 3""")
def metric_upsert(spark, d):
    """Readings keyed by time, entity and label: equal hashes are skipped, of others the greatest stays."""
    x = table(spark, d, "metrics", "timestamp_ms", "entity_id", "label", "value").withColumn("entity_id", clean_id("entity_id"))
    x = x.filter("timestamp_ms is not null and entity_id is not null and label is not null and value is not null and not isnan(value) and abs(value) < 1e12")
    h = F.sha2(F.concat_ws("|", "timestamp_ms", "entity_id", "label", F.round(F.col("value") * 1000).cast("long")), 256)
    return x.select("timestamp_ms", "entity_id", "label", h.alias("h")).groupBy("timestamp_ms", "entity_id", "label").agg(F.max("h").alias("h"))


_DEL = {"memories": (M, "memory_id"), "memory_cards": ("(SELECT DISTINCT trim(card_id) AS id, trim(source_memory_id) AS memory_id FROM memory_cards WHERE trim(card_id) <> '')", "memory_id"), "edges": ("(SELECT DISTINCT trim(edge_id) AS id, trim(memory_id) AS memory_id FROM edges WHERE trim(edge_id) <> '')", "memory_id"),
        "agent_observations": (O, "memory_id")}


@query(" UNION ALL ".join(f"SELECT '{t}' AS name, count(*) FILTER (k NOT IN (SELECT target FROM {T} WHERE target IS NOT NULL) OR k IS NULL) AS kept, count(*) FILTER (k IN (SELECT target FROM {T} WHERE target IS NOT NULL)) AS removed FROM (SELECT {k} AS k FROM {src})" for t, (src, k) in _DEL.items())
       + f" UNION ALL SELECT 'deletion_tombstones', (SELECT count(*) FROM {T}) + (SELECT count(*) FROM {M} WHERE memory_id IN (SELECT target FROM {T} WHERE target IS NOT NULL)), 0")
def memory_delete(spark, d):
    """Deletion of all tombstoned memories from memories, cards, edges and vectors, each deletion leaving a tombstone."""
    gone = materialise(tombstones(spark, d).select(F.col("target").alias("memory_id")).filter("memory_id is not null").distinct(), "gone")
    at = {"memories": memories(spark, d).select("memory_id"), "memory_cards": table(spark, d, "memory_cards", "card_id", "source_memory_id").select(clean_id("card_id").alias("id"), clean_id("source_memory_id").alias("memory_id")).filter("id is not null").distinct(),
          "edges": table(spark, d, "edges", "edge_id", "memory_id").select(clean_id("edge_id").alias("id"), clean_id("memory_id").alias("memory_id")).filter("id is not null").distinct(), "agent_observations": observations(spark, d).select("memory_id")}
    out = None
    for name, rows in at.items():
        x = changes.marked_deleted(rows, "memory_id", gone).agg(F.count(F.when(~F.col("deleted"), 1)).alias("kept"), F.count(F.when(F.col("deleted"), 1)).alias("removed")).select(F.lit(name).alias("name"), "kept", "removed")
        out = x if out is None else out.unionByName(x)
    written = changes.tombstones_for(changes.marked_deleted(at["memories"], "memory_id", gone).filter("deleted"), "memory_id", NOW)
    after = tombstones(spark, d).select("tombstone_id", "target", "timestamp_ms").unionByName(written.select("tombstone_id", "target", "timestamp_ms"))
    return out.unionByName(after.agg(F.count("*").alias("kept")).select(F.lit("deletion_tombstones").alias("name"), "kept", F.lit(0).cast("long").alias("removed")))


@query("SELECT 'memories' AS name, 0::BIGINT AS n_rows UNION ALL SELECT 'edges', 0 UNION ALL SELECT 'memory_cards', 0")
def reset_tables(spark, d):
    """Stored copies of three tables emptied after the confirming phrase; their schemas stay."""
    root = f"{scratch_root(spark)}/reset-{uuid.uuid4().hex[:8]}"
    out = None
    for name in ("memories", "edges", "memory_cards"):
        table(spark, d, name).write.parquet(f"{root}/{name}")
        changes.reset(spark, f"{root}/{name}", confirm="delete everything")
        x = spark.read.parquet(f"{root}/{name}").agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = x if out is None else out.unionByName(x)
    return out


@query(f"""WITH n AS (SELECT 'edge::' || source_memory_id || '::' || subject || '::' || predicate AS edge_id, subject || ' ' || predicate || ' ' || object AS label, 1.0 AS weight FROM (SELECT DISTINCT trim(source_memory_id) AS source_memory_id, c.subject, c.predicate, c.object
    FROM {C} c JOIN (SELECT trim(card_id) AS card_id, max(source_memory_id) AS source_memory_id FROM memory_cards GROUP BY 1) s USING (card_id)) WHERE source_memory_id <> '' AND subject IS NOT NULL AND predicate IS NOT NULL AND object IS NOT NULL)
SELECT edge_id, '' AS label, coalesce(weight, 1.0)::DOUBLE AS weight FROM {E} e WHERE edge_id NOT IN (SELECT edge_id FROM n) AND NOT coalesce(isnan(weight), false) UNION ALL SELECT edge_id, max(label), 1.0 FROM n GROUP BY 1""")
def edges_from_cards(spark, d):
    """An edge for every card with a source, put in place of stored ones with the same id."""
    s = table(spark, d, "memory_cards", "card_id", "source_memory_id").groupBy(clean_id("card_id").alias("card_id")).agg(F.max("source_memory_id").alias("m"))
    c = cards(spark, d).join(s, "card_id").withColumn("m", clean_id("m")).filter("m is not null and subject is not null and predicate is not null and object is not null")
    new = c.select(F.concat(F.lit("edge::"), "m", F.lit("::"), "subject", F.lit("::"), "predicate").alias("edge_id"), F.concat_ws(" ", "subject", "predicate", "object").alias("label"))
    new = new.groupBy("edge_id").agg(F.max("label").alias("label")).withColumn("weight", F.lit(1.0))
    stored = edges(spark, d).filter(~F.coalesce(F.isnan("weight"), F.lit(False))).select("edge_id", F.lit("").alias("label"), F.coalesce("weight", F.lit(1.0)).alias("weight"))
    return changes.upsert(stored, new, ["edge_id"])


@query(f"""SELECT entity_id, count(*) AS n_vectors FROM {_UNIT} WHERE memory_id IS NULL OR memory_id NOT IN (SELECT target FROM {T} WHERE target IS NOT NULL) GROUP BY 1""")
def vector_index_counts(spark, d):
    """A stored vector table: filled, deleted memories removed, loaded again; vectors per entity."""
    gone = tombstones(spark, d).select(F.col("target").alias("memory_id")).filter("memory_id is not null").distinct()
    path = f"{scratch_root(spark)}/vectors-{uuid.uuid4().hex[:8]}"
    search.write_vectors(_usable(spark, d).select("vector_id", "memory_id", "entity_id", "embedding"), path, "entity_id")
    kept = changes.marked_deleted(search.load_vectors(spark, path), "memory_id", gone).filter("not deleted").drop("deleted")
    search.write_vectors(kept, path + "-2", "entity_id")
    return search.load_vectors(spark, path + "-2").groupBy("entity_id").agg(F.count("*").alias("n_vectors"))


@query(f"""SELECT entity_id, list_kind, count(*) AS n, min(o) AS oldest_ms FROM (SELECT entity_id, CASE WHEN kind IN ('Fact', 'Preference') THEN 'stable' ELSE 'activity' END AS list_kind, created_at_ms AS o,
    row_number() OVER (PARTITION BY entity_id, list_kind ORDER BY created_at_ms DESC, memory_id DESC) AS r FROM {M} WHERE entity_id IS NOT NULL AND created_at_ms IS NOT NULL AND kind IN ('Fact', 'Preference', 'Conversational')) WHERE r <= CASE list_kind WHEN 'stable' THEN 64 ELSE 120 END GROUP BY 1, 2""")
def profile_lists(spark, d):
    """Per entity the newest 64 stable and 120 activity notes."""
    m = memories(spark, d).filter(F.col("entity_id").isNotNull() & F.col("created_at_ms").isNotNull() & F.col("kind").isin("Fact", "Preference", "Conversational"))
    m = m.withColumn("list_kind", F.when(F.col("kind") == "Conversational", "activity").otherwise("stable"))
    r = F.row_number().over(Window.partitionBy("entity_id", "list_kind").orderBy(F.desc("created_at_ms"), F.desc("memory_id")))
    kept = m.withColumn("r", r).filter("r <= 120").filter("list_kind = 'activity' or r <= 64")
    return kept.groupBy("entity_id", "list_kind").agg(F.count("*").alias("n"), F.min("created_at_ms").alias("oldest_ms"))


@query("""SELECT user_id, count(*) AS requests, count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'error') AS error, max(epoch_us(ts) // 1000) AS last_ms FROM events GROUP BY 1""")
def usage_added(spark, d):
    """Stored usage counters of the first half of the events, those of the second added."""
    e = events(spark, d)
    mid = F.lit(1_710_000_000_000)

    def counters(x: DataFrame) -> DataFrame:
        return x.groupBy("user_id").agg(F.count("*").alias("requests"), *[F.count(F.when(F.col("event_type") == k, 1)).alias(k) for k in ("click", "error")], F.max("ms").alias("last_ms"))

    stored = materialise(counters(e.filter(F.col("ms") < mid)), "usage")
    return changes.merge_lists(stored, counters(e.filter(F.col("ms") >= mid)), ["user_id"], {"requests": F.sum, "click": F.sum, "error": F.sum, "last_ms": F.max}, [])


@query(f"SELECT edge_id, source, target, edge_type FROM {E} WHERE source IS NOT NULL AND target IS NOT NULL")
def jsonl_round_trip(spark, d):
    """Edges written as JSON lines and read again."""
    path = f"{scratch_root(spark)}/jsonl-{uuid.uuid4().hex[:8]}"
    e = edges(spark, d).filter("source is not null and target is not null").select("edge_id", "source", "target", "edge_type")
    e.write.json(path)
    return spark.read.schema(e.schema).json(path)


@query(f"SELECT 'facts' AS name, count(*) AS n_rows FROM {C} WHERE card_type = 'fact' UNION ALL SELECT 'preferences', count(*) FROM {C} WHERE card_type = 'preference' UNION ALL SELECT 'links', count(*) FROM {C} WHERE parent_card_id IS NOT NULL")
def combined_write(spark, d):
    """One pass over cards that fills three secondary tables, read again."""
    c = materialise(cards(spark, d).select("card_id", "card_type", "parent_card_id", "subject", "object"), "cards")
    root = f"{scratch_root(spark)}/secondary-{uuid.uuid4().hex[:8]}"
    changes.write_tables({"facts": c.filter("card_type = 'fact'"), "preferences": c.filter("card_type = 'preference'"), "links": c.filter("parent_card_id is not null").select("card_id", "parent_card_id")}, root)
    out = None
    for name in ("facts", "preferences", "links"):
        x = spark.read.parquet(f"{root}/{name}").agg(F.count("*").alias("n_rows")).select(F.lit(name).alias("name"), "n_rows")
        out = x if out is None else out.unionByName(x)
    return out


# ---- filters and joins ------------------------------------------------------------------------

ASKED = [("now", False), ("before", True)]  # a question about the present, and one whose words allow history


@query(f"SELECT q.name AS question, c.card_id FROM {C} c, (VALUES ('now', false), ('before', true)) q(name, history) WHERE q.history OR c.is_latest = 1")
def history_filter(spark, d):
    """Cards each question may see: without a word for the past only latest ones."""
    q = F.explode(F.array(*[F.struct(F.lit(n).alias("question"), F.lit(h).alias("history")) for n, h in ASKED]))
    return cards(spark, d).select("card_id", "is_latest", q.alias("q")).filter("q.history or is_latest = 1").select("q.question", "card_id")


@query(f"SELECT memory_id, entity_id FROM {M} WHERE entity_id IS NOT NULL AND starts_with(memory_id, entity_id || '::')")
def id_prefix_scope(spark, d):
    """Memories whose id begins with their entity."""
    return memories(spark, d).filter(F.col("entity_id").isNotNull() & F.startswith(F.col("memory_id"), F.concat("entity_id", F.lit("::")))).select("memory_id", "entity_id")


@query(f"""SELECT session_id, needle, count(*) AS n FROM {L} JOIN (VALUES ('piano'), ('contract'), ('ramen'), ('of')) v(needle) ON length(needle) >= 3 AND contains(lower(text), needle) GROUP BY 1, 2""")
def like_backstop(spark, d):
    """Sessions whose turns hold a needle of three or more characters anywhere, words or not."""
    needles = [n for n in ("piano", "contract", "ramen", "of") if len(n) >= 3]
    t = ledger(spark, d).select("session_id", F.filter(F.array(*[F.lit(n) for n in needles]), _within).alias("n"))
    return t.select("session_id", F.explode("n").alias("needle")).groupBy("session_id", "needle").agg(F.count("*").alias("n"))


def _within(n):
    return F.contains(F.lower("text"), n)


@query(f"""SELECT coalesce(f, 'any') AS asked, edge_id FROM {E} e, (VALUES (NULL), ('caused_by')) v(f) WHERE (f IS NULL OR e.edge_type = f) AND edge_type <> 'default'""")
def edges_of_type(spark, d):
    """Edges with the optional filter on their type: without one, and for caused_by."""
    e = edges(spark, d).filter("edge_type <> 'default'")
    return graph.of_type(e, None).select(F.lit("any").alias("asked"), "edge_id").unionByName(graph.of_type(e, "caused_by").select(F.lit("caused_by").alias("asked"), "edge_id"))


_BOTH = f"(SELECT source AS node, target AS other, * FROM {E} UNION ALL SELECT target, source, * FROM {E})"
_SEEDS = f"(SELECT DISTINCT target AS node FROM {T} WHERE target IS NOT NULL)"


def _seeds(spark, d) -> DataFrame:
    return tombstones(spark, d).select(F.col("target").alias("node")).filter("node is not null").distinct()


@query(f"""SELECT node, other, edge_id, weight FROM {_BOTH} JOIN {_SEEDS} USING (node) WHERE other IS NOT NULL AND weight IS NOT NULL AND NOT isnan(weight) ORDER BY weight DESC, edge_id, node, other LIMIT 200""")
def seed_edges_top(spark, d):
    """The two hundred heaviest ends of edges at the seeds; an edge between two seeds comes twice."""
    e = graph.both_ways(edges(spark, d).filter("weight is not null and not isnan(weight)"), "edge_id", "weight").join(_seeds(spark, d), "node", "left_semi")
    return e.select("node", "other", "edge_id", "weight").orderBy(F.desc("weight"), "edge_id", "node", "other").limit(200)


@query("""SELECT DISTINCT trim(memory_id) AS memory_id FROM memories WHERE trim(memory_id) <> '' AND content_hash <> '' AND content_hash NOT IN (SELECT content_hash FROM agent_observations WHERE content_hash IS NOT NULL)""")
def hashes_not_stored(spark, d):
    """Memories whose content hash no observation has."""
    m = table(spark, d, "memories", "memory_id", "content_hash").select(clean_id("memory_id").alias("memory_id"), "content_hash").filter("memory_id is not null and content_hash <> ''")
    return m.join(table(spark, d, "agent_observations", "content_hash").filter("content_hash is not null").distinct(), "content_hash", "left_anti").select("memory_id").distinct()


_ENT = r"""(SELECT session_id, turn, row_number() OVER (PARTITION BY session_id, turn ORDER BY p) AS pos, name, CASE WHEN regexp_matches(name, ' (Studio|Labs|Logistics|Bakery)$') THEN 'ORG' WHEN regexp_matches(name, ' (Square|Harbour)$') THEN 'LOC' ELSE 'PER' END AS label
    FROM (SELECT session_id, turn, unnest(n) AS name, generate_subscripts(n, 1) AS p FROM (SELECT session_id, turn, regexp_extract_all(text, '\b([A-Z][a-z]+ [A-Z][a-z]+)\b', 1) AS n FROM """ + L + ")))"


@query(f"""SELECT a.session_id, a.turn, a.name AS source, r.predicate, b.name AS target, count(*) AS n FROM {_ENT} a JOIN {_ENT} b ON a.session_id = b.session_id AND a.turn = b.turn AND a.pos < b.pos
    JOIN (VALUES ('PER', 'ORG', 'associated_with'), ('PER', 'LOC', 'located_in'), ('ORG', 'LOC', 'headquartered_in'), ('PER', 'PER', 'knows')) r(x, y, predicate) ON r.x = a.label AND r.y = b.label GROUP BY ALL""")
def cooccurrence_pairs(spark, d):
    """Names of one turn, each with those behind it, related by their kinds."""
    names = F.regexp_extract_all("text", F.lit("\\b([A-Z][a-z]+ [A-Z][a-z]+)\\b"), F.lit(1))
    t = ledger(spark, d).select("session_id", "turn", graph.related_pairs(names).alias("p"))
    return t.select("session_id", "turn", F.explode("p").alias("p")).groupBy("session_id", "turn", "p.source", "p.predicate", "p.target").agg(F.count("*").alias("n"))


@query(f"""SELECT alias, name FROM (SELECT a.alias, r.name, row_number() OVER (PARTITION BY a.alias ORDER BY r.name) AS k FROM (SELECT DISTINCT split_part(source, ' ', 1) AS alias FROM {E} WHERE edge_type IN {_NAMED} AND source IS NOT NULL) a
    JOIN {REG} r ON list_contains(string_split(lower(r.name), ' '), lower(a.alias))) WHERE k = 1""")
def alias_canonical(spark, d):
    """First words of edge names with the least registered name that holds them as a word; by word keys, without a cross join."""
    a = edges(spark, d).filter(F.col("edge_type").isin(*NAMED) & F.col("source").isNotNull()).select(F.substring_index("source", " ", 1).alias("alias")).distinct()
    r = registered(spark, d).select("name", F.explode(F.array_distinct(F.split(F.lower("name"), " "))).alias("w"))
    return a.join(r.groupBy("w").agg(F.min("name").alias("name")), F.lower("alias") == F.col("w")).select("alias", "name")


@query(f"""SELECT session_id, turn, string_agg(text, chr(10)) OVER w AS around FROM {L} WINDOW w AS (PARTITION BY session_id ORDER BY turn ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING)""")
def turn_text_window(spark, d):
    """Each turn's text with those of the turns before and behind it."""
    w = Window.partitionBy("session_id").orderBy("turn")
    return ledger(spark, d).select("session_id", "turn", F.concat_ws("\n", F.lag("text").over(w), "text", F.lead("text").over(w)).alias("around"))


# ---- time ---------------------------------------------------------------------------------------


@query(f"""SELECT session_id, min_ms AS first_ms FROM (SELECT trim(session_id) AS session_id, min(document_time_ms) AS min_ms FROM ledger_turns WHERE trim(session_id) <> '' GROUP BY 1) WHERE min_ms >= {SPLIT - 30 * 86_400_000} AND min_ms < {SPLIT}""")
def sessions_in_window(spark, d):
    """Sessions that began within thirty days before a time."""
    s = table(spark, d, "ledger_turns", "session_id", "document_time_ms").select(clean_id("session_id").alias("session_id"), "document_time_ms").filter("session_id is not null")
    return s.groupBy("session_id").agg(F.min("document_time_ms").alias("first_ms")).filter((F.col("first_ms") >= SPLIT - 30 * 86_400_000) & (F.col("first_ms") < SPLIT))


def _effects_sql() -> str:
    from memspark.plans.reference_queries import _FACTS

    return _FACTS + """SELECT card_id AS source, superseded_by AS target, 'superseded_by' AS edge_type FROM v WHERE status = 'stale' UNION ALL SELECT superseded_by, card_id, 'supersedes' FROM v WHERE status = 'stale'"""


@query(_effects_sql())
def supersession_edges(spark, d):
    """Both status edges of every superseded fact."""
    return temporal.status_edges(_versions(spark, d), "card_id")


# ---- measures --------------------------------------------------------------------------------------


BOUNDS = [0.005, 0.01, 0.025, 0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0]  # fixed values: upper bounds in seconds


@query("SELECT le, count(*) AS n FROM (SELECT CASE " + " ".join(f"WHEN value / 1000 <= {b} THEN '{b}'" for b in BOUNDS) + " ELSE '+Inf' END AS le FROM events WHERE value IS NOT NULL AND NOT isnan(value)) GROUP BY 1")
def duration_histogram(spark, d):
    """Events by duration, their values taken for milliseconds."""
    le = F.lit("+Inf")
    for b in reversed(BOUNDS):
        le = F.when(F.col("value") / 1000 <= b, str(b)).otherwise(le)
    return events(spark, d).filter("value is not null and not isnan(value)").groupBy(le.alias("le")).agg(F.count("*").alias("n"))


# ---- graph ------------------------------------------------------------------------------------------


@query(f"""WITH b AS (SELECT DISTINCT node, other FROM {_BOTH} WHERE node IS NOT NULL AND other IS NOT NULL AND edge_type <> 'default'), n AS (SELECT node, other, row_number() OVER (PARTITION BY node ORDER BY other) AS r FROM b),
w1 AS (SELECT s.node AS seed, n.other AS node, 1 AS depth FROM {_SEEDS} s JOIN n ON s.node = n.node WHERE r <= 4), w2 AS (SELECT DISTINCT seed, n.other AS node, 2 AS depth FROM w1 JOIN n ON w1.node = n.node WHERE r <= 4), w3 AS (SELECT DISTINCT seed, n.other AS node, 3 AS depth FROM w2 JOIN n ON w2.node = n.node WHERE r <= 4)
SELECT seed, node, min(depth) AS depth FROM (SELECT * FROM w1 UNION ALL SELECT * FROM w2 UNION ALL SELECT * FROM w3) WHERE seed <> node GROUP BY 1, 2""")
def graph_walk(spark, d):
    """Nodes within three links of each seed, up to four neighbours of a node being followed, with the least depth."""
    return graph.bounded_walk(edges(spark, d).filter("edge_type <> 'default'"), _seeds(spark, d), depth=3, breadth=4)


_MULT = "CASE WHEN edge_type IN ('caused_by', 'leads_to', 'prefers') THEN 1.5 ELSE 1.0 END"


@query(f"""WITH n AS (SELECT node, other, w FROM (SELECT node, other, weight * {_MULT} AS w, row_number() OVER (PARTITION BY node ORDER BY weight DESC, edge_id, other) AS r FROM {_BOTH} WHERE node IS NOT NULL AND other IS NOT NULL AND weight IS NOT NULL AND NOT isnan(weight)) WHERE r <= 50),
f AS (SELECT s.node AS seed, n.other AS node, n.w FROM {_SEEDS} s JOIN n ON n.node = s.node), v AS (SELECT DISTINCT seed, node FROM f), g AS (SELECT v.seed, n.other AS node, 0.6 * n.w AS w FROM v JOIN n ON n.node = v.node)
SELECT seed, node, round(sum(w), 5) AS score FROM (SELECT * FROM f UNION ALL SELECT * FROM g) GROUP BY 1, 2""")
def edge_cluster_scores(spark, d):
    """Weights of edges one and two links from each seed, the fifty heaviest of a node, causes and preferences raised as for inference."""
    e = edges(spark, d).filter("weight is not null and not isnan(weight)")
    s = graph.edge_cluster_scores(e, _seeds(spark, d), raised=("caused_by", "leads_to", "prefers"))
    return s.select("seed", "node", F.round("score", 5).alias("score"))


@query(f"""SELECT seed AS node, other AS linked FROM (SELECT DISTINCT s.node AS seed, b.other FROM {_SEEDS} s JOIN {_BOTH} b ON b.node = s.node WHERE b.other IS NOT NULL AND edge_type IN ('derived_from', 'updates', 'supersedes', 'superseded_by'))""")
def linked_memories(spark, d):
    """Memories linked to the seeds in either direction."""
    e = edges(spark, d).filter(F.col("edge_type").isin("derived_from", "updates", "supersedes", "superseded_by"))
    return graph.both_ways(e).join(_seeds(spark, d), "node", "left_semi").select("node", F.col("other").alias("linked")).distinct()


@query("""SELECT edge_type, count(DISTINCT trim(edge_id)) AS n, count(DISTINCT label) AS n_labels FROM edges WHERE contains(lower(label), 'square') AND trim(edge_id) <> '' GROUP BY 1""")
def label_summaries(spark, d):
    """Edges whose label holds a word, summed up by type."""
    e = table(spark, d, "edges", "edge_id", "label", "edge_type").withColumn("edge_id", clean_id("edge_id")).filter(F.contains(F.lower("label"), F.lit("square")) & F.col("edge_id").isNotNull())
    return e.groupBy("edge_type").agg(F.count_distinct("edge_id").alias("n"), F.count_distinct("label").alias("n_labels"))


@query(f"""SELECT node, string_agg(line, chr(10) ORDER BY line) AS lines FROM (SELECT DISTINCT node, node || ' -[' || edge_type || ']-> ' || other AS line FROM {_BOTH} JOIN {_SEEDS} USING (node) WHERE other IS NOT NULL) GROUP BY 1""")
def graph_render(spark, d):
    """The links of each seed as lines of text; seeds have few links, hubs would be cut by `graph.neighbours` first."""
    x = graph.both_ways(edges(spark, d), "edge_type").join(_seeds(spark, d), "node", "left_semi")
    line = F.concat("node", F.lit(" -["), "edge_type", F.lit("]-> "), "other")
    return x.select("node", line.alias("line")).distinct().groupBy("node").agg(F.array_join(F.array_sort(F.collect_list("line")), "\n").alias("lines"))


# ---- entity resolution --------------------------------------------------------------------------------


@query(f"""SELECT r.name, r.entity_id, count(DISTINCT e.edge_id) AS n_edges FROM {REG} r LEFT JOIN (SELECT source AS name, edge_id FROM {E} WHERE edge_type IN {_NAMED} UNION ALL SELECT target, edge_id FROM {E} WHERE edge_type IN {_NAMED}) e USING (name) GROUP BY 1, 2""")
def resolution_candidates(spark, d):
    """Registered names with their entity and the number of edges that use them."""
    used = graph.both_ways(edges(spark, d).filter(F.col("edge_type").isin(*NAMED)), "edge_id").select(F.col("node").alias("name"), "edge_id")
    alone = edges(spark, d).filter(F.col("edge_type").isin(*NAMED) & (F.col("source").isNull() | F.col("target").isNull())).select(F.coalesce("source", "target").alias("name"), "edge_id")
    n = used.unionByName(alone).filter("name is not null").distinct().groupBy("name").agg(F.count("*").alias("n_edges"))
    return registered(spark, d).join(n, "name", "left").na.fill(0, ["n_edges"])


# ---- streams ---------------------------------------------------------------------------------------------


def _stream(spark, d, name: str, schema=None) -> DataFrame:
    return spark.readStream.schema(schema or table(spark, d, name).schema).parquet(f"{d}/{name[:-1]}[{name[-1]}].parquet")


def _run(spark, df: DataFrame, mode: str) -> DataFrame:
    return pipelines.run_to_table(df, f"{scratch_root(spark)}/stream-{uuid.uuid4().hex[:8]}", mode)


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_usage_buffer(spark, d):
    """Usage events coalesced by user and type and flushed batch by batch."""
    s = _stream(spark, d, "events").groupBy("user_id", "event_type").agg(F.count("*").alias("n"))
    return _run(spark, s, "complete")


@query(f"SELECT DISTINCT trim(card_id) AS card_id, expires_at FROM memory_cards WHERE expires_at <= {NOW} AND trim(card_id) <> ''")
def stream_expiry(spark, d):
    """Cards found expired as they stream by; each once."""
    s = _stream(spark, d, "memory_cards").select(clean_id("card_id").alias("card_id"), "expires_at").filter((F.col("expires_at") <= NOW) & F.col("card_id").isNotNull())
    return _run(spark, s.dropDuplicates(["card_id", "expires_at"]), "append")


@query("""SELECT trim(session_id) AS session_id, count(*) AS n_rows, min(turn_index) AS first_turn, max(turn_index) AS last_turn FROM ledger_turns WHERE trim(session_id) <> '' GROUP BY 1""")
def stream_router_merge(spark, d):
    """Session routers kept up as turns stream in."""
    s = _stream(spark, d, "ledger_turns").select(clean_id("session_id").alias("session_id"), "turn_index").filter("session_id is not null")
    return _run(spark, s.groupBy("session_id").agg(F.count("*").alias("n_rows"), F.min("turn_index").alias("first_turn"), F.max("turn_index").alias("last_turn")), "complete")


@query("SELECT DISTINCT content_hash FROM memories WHERE content_hash <> ''")
def stream_dedupe(spark, d):
    """Content hashes, each kept when it comes first."""
    s = _stream(spark, d, "memories").select("content_hash").filter("content_hash <> ''")
    return _run(spark, s.dropDuplicates(["content_hash"]), "append")


@query(f"SELECT card_id, entity_id FROM {C} WHERE created_at_ms <= {AS_OF} AND entity_id IS NOT NULL")
def cards_visible_at(spark, d):
    """Cards a question asked at a past time may see: those created by then."""
    return cards(spark, d).filter((F.col("created_at_ms") <= AS_OF) & F.col("entity_id").isNotNull()).select("card_id", "entity_id")
