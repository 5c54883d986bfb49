"""Queries of the general training-data operators (p2, p4, p5, p7) and their SQL."""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from memspark.operators.hierarchy import ancestor_pairs, hierarchy
from memspark.operators.history import attribute_history
from memspark.operators.lineage import materialise
from memspark.operators.references import OrphanState
from memspark.operators.rows import clean_id, epoch_ms, latest, one_per_key
from memspark.operators.units import MULTIPLIERS, UNITS, common_readings, solve_units
from memspark.sources.tables import table

# Edge types whose ends are names; the other types' ends are memory ids.
NAMED_EDGES = ["prefers", "works_at", "lives_in", "caused_by", "leads_to", "default"]


def current_cards(spark: SparkSession, d: str, *cols: str) -> DataFrame:
    """One row per card_id, the last update; ids without outer blanks, created_at_ms in milliseconds."""
    ids = {"card_id", "parent_card_id", "entity_id", "source_memory_id"}
    raw = table(spark, d, "memory_cards", *dict.fromkeys(["card_id", "updated_at_ms", *cols]))
    raw = raw.select(*[clean_id(c).alias(c) if c in ids else epoch_ms(c).alias(c) if c == "created_at_ms" else F.col(c) for c in raw.columns])
    return latest(raw.filter("card_id is not null"), "card_id", "updated_at_ms", *cols)


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Every version of every attribute of `memory_cards`."""
    cards = materialise(current_cards(spark, d, "parent_card_id", "entity_id", "subject", "predicate", "object", "card_type", "is_inference", "created_at_ms"), "cards")
    counted = F.col("card_type").isin("fact", "preference", "decision") & (F.col("is_inference") == 0) & F.col("predicate").isNotNull()
    links = cards.select(F.col("card_id").alias("row"), F.col("parent_card_id").alias("up"))
    cards = cards.filter(counted)
    predicate = F.trim(F.translate(F.lower("predicate"), "_-", "  "))
    value = F.trim(F.regexp_replace(F.lower("object"), "\\s+", " "))
    out = attribute_history(cards, [F.col("entity_id"), clean_id("subject"), predicate], value, "created_at_ms", "card_id", [], links)
    return out.select("card_id", "valid_from_ms", "valid_to_ms")


def _card_tree(spark: SparkSession, d: str, with_path: bool) -> DataFrame:
    return hierarchy(current_cards(spark, d, "parent_card_id"), "card_id", "parent_card_id", with_path)


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    """Root and depth of every card; '' and -1 where the links upward never end."""
    return _card_tree(spark, d, False).select(F.col("node").alias("card_id"), "root_id", "depth")


def p4_paths(spark: SparkSession, d: str) -> DataFrame:
    """Path from the root of every card, joined by ' > ', and its number of descendants."""
    tree = materialise(_card_tree(spark, d, True), "tree")
    below = ancestor_pairs(tree).groupBy(F.col("ancestor").alias("node")).agg(F.count("*").alias("n_descendants"))
    return tree.join(below, "node", "left").select(
        F.col("node").alias("card_id"), "root_id", "depth", F.coalesce(F.array_join("path", " > "), F.lit("")).alias("path"), F.coalesce("n_descendants", F.lit(0)).alias("n_descendants"))


def p4_descendants(spark: SparkSession, d: str) -> DataFrame:
    """All (card, descendant, distance)."""
    return ancestor_pairs(_card_tree(spark, d, True)).select(F.col("ancestor").alias("card_id"), F.col("descendant").alias("descendant_id"), "distance")


def _references(spark: SparkSession, d: str) -> OrphanState:
    cards = current_cards(spark, d, "source_memory_id", "created_at_ms").select(
        F.lit("memory_cards").alias("ref_table"), F.col("card_id").alias("ref_row"), F.lit("source_memory_id").alias("ref_field"), F.lit("memory").alias("kind"),
        F.col("source_memory_id").alias("key"), F.col("created_at_ms").alias("ref_ms"))
    e = table(spark, d, "edges", "edge_id", "source", "target", "edge_type", "timestamp_ms", "memory_id")
    e = one_per_key(e.select(*[clean_id(c).alias(c) if c not in ("edge_type", "timestamp_ms") else F.col(c) for c in e.columns]).filter("edge_id is not null"),
                    "edge_id", "source", "target", "edge_type", "timestamp_ms", "memory_id")
    kind = F.when(F.col("edge_type").isin(NAMED_EDGES), "name").otherwise("memory")
    fields = F.array(F.struct(F.lit("memory_id").alias("f"), F.lit("memory").alias("k"), F.col("memory_id").alias("v")),
                     *[F.struct(F.lit(c).alias("f"), kind.alias("k"), F.col(c).alias("v")) for c in ("source", "target")])
    edges = e.select("edge_id", "timestamp_ms", F.explode(fields).alias("r")).select(
        F.lit("edges").alias("ref_table"), F.col("edge_id").alias("ref_row"), F.col("r.f").alias("ref_field"), F.col("r.k").alias("kind"), F.col("r.v").alias("key"), F.col("timestamp_ms").alias("ref_ms"))
    names = table(spark, d, "entity_registry", "canonical_name").select(F.lit("name").alias("kind"), clean_id("canonical_name").alias("key"), F.lit(None).cast("long").alias("arrived_ms"))
    memories = table(spark, d, "memories", "memory_id", "created_at_ms").select(F.lit("memory").alias("kind"), clean_id("memory_id").alias("key"), F.col("created_at_ms").alias("arrived_ms"))
    gone = table(spark, d, "deletion_tombstones", "target_memory_id").select(F.lit("memory").alias("kind"), clean_id("target_memory_id").alias("key"))
    # Memories are there when references come; names arrive afterwards and resolve what waits, deletions reopen it.
    return OrphanState.empty(spark).advance(cards.unionByName(edges), memories).advance(parents=names, deleted=gone)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reference to a record that is missing, deleted or younger."""
    return _references(spark, d).orphans()


def p5_counts(spark: SparkSession, d: str) -> DataFrame:
    """Orphans per table, field, month of the referring row and status."""
    return _references(spark, d).snapshot()


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    """Every reading with a value and a known unit, in the common unit of its quantity."""
    return common_readings(table(spark, d, "metrics", "content_hash", "label", "unit", "value")).select("content_hash", "quantity", "common_int")


# Units in which the derived loads below are told: names and factors to kilogram, kilogram per litre and litre.
LOAD_UNITS = {"mass": [("kg", 1.0), ("lb", 0.453592), ("cwt", 50.802345)], "density": [("kg/l", 1.0), ("lb/gal", 0.119826)], "volume": [("l", 1.0), ("gal", 3.785412), ("ft3", 28.316847)]}


def _loads(spark: SparkSession, d: str) -> DataFrame:
    """Order lines as loads of tied columns: volume from the quantity, density from the part, mass their product.

    Each column of a line is told in a unit of LOAD_UNITS picked by its keys; one line in
    eleven has a mass that fits no units.
    """
    rows = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_quantity")
    litres, dense = F.col("l_quantity").cast("double") * 7, 0.6 + (F.col("l_partkey") % 97) / 61.0
    pick = lambda c, k: F.element_at(F.array(*[F.lit(s) for _, s in LOAD_UNITS[c]]), (k % len(LOAD_UNITS[c]) + 1).cast("int"))
    odd = F.when(F.col("l_orderkey") % 11 == 0, 1.7).otherwise(1.0)
    return rows.select("l_orderkey", "l_linenumber", (litres * dense * odd / pick("mass", F.col("l_orderkey"))).alias("mass"),
                       (dense / pick("density", F.col("l_partkey"))).alias("density"), (litres / pick("volume", F.col("l_linenumber"))).alias("volume"))


def p7_identity(spark: SparkSession, d: str) -> DataFrame:
    """Units of loads found from mass = density * volume; where several combinations fit, all but the status is null."""
    out = solve_units(_loads(spark, d), {"mass": 1, "density": -1, "volume": -1}, LOAD_UNITS, tolerance=0.001)
    sure = F.col("unit_status") == "solved"
    return out.select("l_orderkey", "l_linenumber", "unit_status", *[F.when(sure, F.col(f"{c}_unit")).alias(f"{c}_unit") for c in LOAD_UNITS], F.when(sure, F.round("mass_common", 3)).alias("mass_kg"))


QUERIES = {f.__name__: f for f in (p2_found, p4_found, p4_paths, p4_descendants, p5_found, p5_counts, p7_found, p7_identity)}

_CARDS = """
one AS (SELECT * FROM (SELECT trim(card_id) AS card_id, nullif(trim(parent_card_id), '') AS parent_card_id, nullif(trim(entity_id), '') AS entity_id,
    nullif(trim(source_memory_id), '') AS source_memory_id, nullif(trim(subject), '') AS subject, predicate, object, card_type, is_inference,
    CASE WHEN created_at_ms < 100000000000 THEN created_at_ms * 1000 ELSE created_at_ms END AS created_at_ms,
    row_number() OVER (PARTITION BY trim(card_id) ORDER BY updated_at_ms DESC NULLS LAST) AS rn FROM memory_cards) WHERE rn = 1 AND card_id <> ''),
up AS (SELECT c.card_id, p.card_id AS parent_id FROM one c LEFT JOIN one p ON c.parent_card_id = p.card_id),
walk AS (SELECT card_id, card_id AS root_id, CAST(0 AS BIGINT) AS depth, card_id AS path FROM up WHERE parent_id IS NULL
    UNION ALL SELECT u.card_id, w.root_id, w.depth + 1, w.path || ' > ' || u.card_id FROM walk w JOIN up u ON u.parent_id = w.card_id),
tree AS (SELECT * FROM walk UNION ALL SELECT card_id, '', CAST(-1 AS BIGINT), '' FROM up WHERE card_id NOT IN (SELECT card_id FROM walk))
"""
_PAIRS = """, pairs AS (SELECT parent_id AS card_id, card_id AS descendant_id, CAST(1 AS BIGINT) AS distance FROM up JOIN walk USING (card_id) WHERE parent_id IS NOT NULL
    UNION ALL SELECT u.parent_id, p.descendant_id, p.distance + 1 FROM pairs p JOIN up u ON u.card_id = p.card_id WHERE u.parent_id IS NOT NULL)
"""
_ORPHANS = f"""WITH RECURSIVE {_CARDS},
e AS (SELECT DISTINCT trim(edge_id) AS edge_id, edge_type, timestamp_ms, nullif(trim(source), '') AS source, nullif(trim(target), '') AS target, nullif(trim(memory_id), '') AS memory_id FROM edges),
refs AS (SELECT 'memory_cards' AS ref_table, card_id AS ref_row, 'source_memory_id' AS ref_field, 'memory' AS kind, source_memory_id AS k, created_at_ms AS ref_ms FROM one
    UNION ALL SELECT 'edges', edge_id, 'memory_id', 'memory', memory_id, timestamp_ms FROM e
    UNION ALL SELECT 'edges', edge_id, f, CASE WHEN edge_type IN ('prefers','works_at','lives_in','caused_by','leads_to','default') THEN 'name' ELSE 'memory' END, v, timestamp_ms
        FROM (SELECT edge_id, edge_type, timestamp_ms, 'source' AS f, source AS v FROM e UNION ALL SELECT edge_id, edge_type, timestamp_ms, 'target', target FROM e)),
mem AS (SELECT trim(memory_id) AS k, min(created_at_ms) AS ms FROM memories GROUP BY 1),
gone AS (SELECT DISTINCT trim(target_memory_id) AS k FROM deletion_tombstones WHERE target_memory_id IS NOT NULL),
names AS (SELECT DISTINCT trim(canonical_name) AS k FROM entity_registry WHERE canonical_name IS NOT NULL),
judged AS (SELECT r.*, CASE WHEN kind = 'name' THEN CASE WHEN n.k IS NULL THEN 'missing' END WHEN g.k IS NOT NULL THEN 'deleted' WHEN m.k IS NULL THEN 'missing' WHEN m.ms > ref_ms THEN 'late' END AS ref_status
    FROM refs r LEFT JOIN mem m ON r.k = m.k LEFT JOIN gone g ON r.k = g.k LEFT JOIN names n ON r.k = n.k WHERE r.k IS NOT NULL)
"""
_UNIT_ROWS = ", ".join(f"('{q}', '{n}', {s}::DOUBLE, {o}::DOUBLE)" for q, rows in UNITS.items() for names, s, o in rows for n in names)
_TIMES = " ".join(f"WHEN '{w}' THEN {m}" for w, m in MULTIPLIERS.items())
_COMBOS = ", ".join(f"({i}, '{m}', {a}::DOUBLE, '{n}', {b}::DOUBLE, '{v}', {c}::DOUBLE)" for i, ((m, a), (n, b), (v, c)) in enumerate(itertools.product(*LOAD_UNITS.values())))
_PICK = {c: "[" + ", ".join(f"{s}::DOUBLE" for _, s in u) + "]" for c, u in LOAD_UNITS.items()}
SQL = {
    "p7_identity": f"""WITH x AS (SELECT row_number() OVER () AS line, l_orderkey, l_linenumber, l_partkey, l_quantity::DOUBLE * 7 AS litres, 0.6 + (l_partkey % 97) / 61.0::DOUBLE AS dense, CASE WHEN l_orderkey % 11 = 0 THEN 1.7 ELSE 1.0 END::DOUBLE AS odd FROM lineitem),
y AS (SELECT line, l_orderkey, l_linenumber, litres * dense * odd / ({_PICK['mass']})[l_orderkey % 3 + 1] AS mass, dense / ({_PICK['density']})[l_partkey % 2 + 1] AS density, litres / ({_PICK['volume']})[l_linenumber % 3 + 1] AS volume FROM x),
f AS (SELECT y.*, c.*, abs(ln(mass) - ln(density) - ln(volume) + ln(a) - ln(b) - ln(v)) AS r FROM y CROSS JOIN (VALUES {_COMBOS}) c(i, mu, a, du, b, vu, v)),
g AS (SELECT *, min(r) OVER w AS best, row_number() OVER (PARTITION BY line ORDER BY r, i) AS k FROM f WINDOW w AS (PARTITION BY line)),
s AS (SELECT line, any_value(l_orderkey) AS l_orderkey, any_value(l_linenumber) AS l_linenumber, CASE WHEN any_value(best) > 0.001 THEN 'unsolved' WHEN count(*) FILTER (r <= best + 0.001) > 1 THEN 'ambiguous' ELSE 'solved' END AS unit_status, max(mu) FILTER (k = 1) AS mu, max(du) FILTER (k = 1) AS du, max(vu) FILTER (k = 1) AS vu, max(mass * a) FILTER (k = 1) AS kg FROM g GROUP BY line)
SELECT l_orderkey, l_linenumber, unit_status, CASE unit_status WHEN 'solved' THEN mu END AS mass_unit, CASE unit_status WHEN 'solved' THEN du END AS density_unit, CASE unit_status WHEN 'solved' THEN vu END AS volume_unit, CASE unit_status WHEN 'solved' THEN round(kg, 3) END AS mass_kg FROM s""",
    "p7_found": f"""WITH one AS (SELECT trim(content_hash) AS content_hash, min(label) AS label, arg_min(coalesce(unit, ''), label) AS unit, arg_min(value, label) AS value FROM metrics WHERE trim(content_hash) <> '' GROUP BY 1),
q AS (SELECT *, regexp_extract(lower(trim(label)), '^([^\\s_]+)', 1) AS quantity, CASE WHEN trim(unit) = '' THEN regexp_extract(trim(label), '[\\s_]([^\\s_]+)$', 1) ELSE unit END AS t FROM one WHERE value IS NOT NULL AND NOT isnan(value)),
w AS (SELECT *, list_filter(regexp_split_to_array(trim(regexp_replace(lower(translate(t, '()[]{{}}.,;°_~', '            ')), '\\b(deg(ree|rees)?|approx(imately)?)\\b', ' ', 'g')), '\\s+'), lambda x: x <> '') AS w0 FROM q),
x AS (SELECT *, CASE WHEN len(w0) > 1 AND w0[1] = 'in' THEN w0[2:] ELSE w0 END AS w1 FROM w),
y AS (SELECT *, CASE WHEN len(w1) > 1 THEN CASE w1[1] {_TIMES} END END AS many FROM x)
SELECT content_hash, y.quantity, CAST(round(value * coalesce(many, 1) * scale + offs) AS BIGINT) AS common_int
FROM y JOIN (VALUES {_UNIT_ROWS}) u(quantity, name, scale, offs) ON y.quantity = u.quantity AND u.name = array_to_string(CASE WHEN many IS NULL THEN w1 ELSE w1[2:] END, '')""",
    "p2_found": f"""WITH RECURSIVE {_CARDS},
n AS (SELECT card_id, entity_id, subject, trim(translate(lower(predicate), '_-', '  ')) AS predicate, trim(regexp_replace(lower(object), '\\s+', ' ', 'g')) AS val, created_at_ms AS t, depth
    FROM one JOIN tree USING (card_id) WHERE card_type IN ('fact', 'preference', 'decision') AND is_inference = 0 AND predicate IS NOT NULL AND object IS NOT NULL AND created_at_ms IS NOT NULL),
near AS (SELECT b.card_id AS parent_id FROM n a JOIN up ON up.card_id = a.card_id JOIN n b ON b.card_id = up.parent_id AND b.t = a.t AND b.predicate = a.predicate AND b.subject IS NOT DISTINCT FROM a.subject AND b.entity_id IS NOT DISTINCT FROM a.entity_id),
s AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY entity_id, subject, predicate, t ORDER BY depth DESC, depth < 0 AND card_id IN (SELECT parent_id FROM near), card_id DESC) = 1),
v AS (SELECT *, lag(val) OVER (PARTITION BY entity_id, subject, predicate ORDER BY t) AS before FROM s)
SELECT card_id, t AS valid_from_ms, coalesce(lead(t) OVER (PARTITION BY entity_id, subject, predicate ORDER BY t), 0) AS valid_to_ms FROM v WHERE before IS DISTINCT FROM val""",
    "p4_found": f"WITH RECURSIVE {_CARDS} SELECT card_id, root_id, depth FROM tree",
    "p4_paths": f"""WITH RECURSIVE {_CARDS}{_PAIRS}
SELECT t.card_id, root_id, depth, path, coalesce(n, 0) AS n_descendants FROM tree t LEFT JOIN (SELECT card_id, count(*) AS n FROM pairs GROUP BY 1) USING (card_id)""",
    "p4_descendants": f"WITH RECURSIVE {_CARDS}{_PAIRS} SELECT card_id, descendant_id, distance FROM pairs",
    "p5_found": _ORPHANS + "SELECT DISTINCT ref_table, ref_row, ref_field, ref_status FROM judged WHERE ref_status IS NOT NULL",
    "p5_counts": _ORPHANS + """SELECT ref_table, ref_field, coalesce(strftime(make_timestamp(ref_ms * 1000), '%Y-%m'), '') AS ref_month, ref_status, count(*) AS n_refs
FROM (SELECT DISTINCT ref_table, ref_row, ref_field, ref_ms, ref_status FROM judged WHERE ref_status IS NOT NULL) GROUP BY ALL""",
}
