"""Queries of text, date and fact functions and of the rows made from texts, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions import claims, dates, extract, text
from memspark.operators import resolve
from memspark.operators.rows import clean_id
from memspark.plans.reference_queries import _ALNUM, _TIMES, C, E, L, M, cards, edges, ledger, memories, registry
from memspark.sources.tables import table

QUERIES, SQL, query = registry()


def _sql_list(words) -> str:
    return "[" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + "]"


def _any_in(text_sql: str, words) -> str:
    """SQL: whether any of the words is part of the text."""
    return f"len(list_filter({_sql_list(words)}, lambda x: contains({text_sql}, x))) > 0"


_LINE = "trim(regexp_replace({}, '[\\s\\p{{Z}}]+', ' ', 'g'))"
_STRIP = "regexp_replace({}, '^[\\s\\p{{Z}}]*(\\[[^\\]]*\\][\\s\\p{{Z}}]*)*', '')"
_NAMED = "list_filter(regexp_extract_all({}, '((?:\\b[A-Z][A-Za-z''-]*[a-z][A-Za-z''-]*\\b)(?:[ \\t]+(?:[A-Z][A-Za-z''-]*[a-z][A-Za-z''-]*))*)', 1), lambda p: length(p) > 2)"
_CLAIMS = f"""(SELECT doc_id, unnest(list_filter(list_transform(regexp_split_to_array(text, '[.!?;]'), lambda p: {_LINE.format(_STRIP.format('p'))}), lambda p: strlen(p) >= 12)) AS claim FROM documents WHERE text IS NOT NULL)"""


def documents(spark, d, *cols: str) -> DataFrame:
    return table(spark, d, "documents", "doc_id", "text", *cols).filter("text is not null")


def _claims(spark, d) -> DataFrame:
    return documents(spark, d).select("doc_id", F.explode(claims.claims(F.col("text"))).alias("claim"))


# ---- claims, facts, preferences ----------------------------------------------------------


@query(f"SELECT doc_id, claim, count(*) AS n FROM {_CLAIMS} GROUP BY 1, 2")
def atomic_claims(spark, d):
    """Claims of all documents."""
    return _claims(spark, d).groupBy("doc_id", "claim").agg(F.count("*").alias("n"))


_SIGNAL = f"""(len(list_filter({_ALNUM.format('claim')}, lambda t: regexp_matches(t, '^[0-9]{{4}}$'))) > 0 OR {_any_in('lower(claim)', text.TIME_WORDS)} OR len({_NAMED.format('claim')}) > 0 OR {_any_in("' ' || lower(claim) || ' '", claims.PERSONAL)}) AND {_any_in('lower(claim)', claims.RELATING)}"""


@query(f"SELECT doc_id, count(*) AS n_claims, count(*) FILTER ({_SIGNAL}) AS n_signal, count(*) FILTER ({_any_in(chr(39) + ' ' + chr(39) + ' || lower(claim) || ' + chr(39) + ' ' + chr(39), claims.FACT_LIKE)}) AS n_personal FROM {_CLAIMS} GROUP BY 1")
def signal_claims(spark, d):
    """Per document its claims, those of high signal and those in the first person."""
    c = F.col("claim")
    return _claims(spark, d).groupBy("doc_id").agg(F.count("*").alias("n_claims"), F.count(F.when(claims.high_signal(c), 1)).alias("n_signal"), F.count(F.when(claims.fact_like(c), 1)).alias("n_personal"))


def _key_sql(source: str, keep: str) -> str:
    """SQL for the fact key of column t of `source`, with the columns `keep`."""
    isin = lambda words: "t IN (" + ", ".join(f"'{w}'" for w in words if w != "0") + ")" + (" OR regexp_matches(t, '^[0-9]+$')" if "0" in words else "")
    first = lambda arr, words: f"coalesce(list_position(list_transform({arr}, lambda t: {isin(words)}), true), 0)"
    plain = lambda arr: f"list_filter({arr}, lambda t: NOT regexp_matches(t, '^[0-9]+$'))"
    sing = "CASE WHEN x LIKE '%ies' AND length(x) > 3 THEN regexp_replace(x, 'ies$', 'y') WHEN x LIKE '%s' AND x NOT LIKE '%ss' AND length(x) > 2 THEN regexp_replace(x, 's$', '') ELSE x END"
    base = lambda arr: f"(CASE WHEN len({arr}) > 0 THEN list_concat({arr}[1:len({arr}) - 1], list_transform({arr}[len({arr}):], lambda x: {sing})) ELSE [] END)"
    key = lambda arr: f"nullif(array_to_string(list_filter({arr}, lambda t: NOT regexp_matches(t, '^[0-9]+$') AND NOT list_contains({_sql_list(claims.KEY_DROP)}, t)), '_'), '')"
    rules = []
    for name, rule in claims.FACT_RULES:
        have = lambda words: f"list_has_any(w, {_sql_list(words)})"
        every = " AND ".join([have(x) for x in rule.get("all", [])] + [f"contains(low, '{p}')" for p in rule.get("in_and", [])])
        some = [f"({every})"] if "all" in rule else []
        some += [have(rule["any"])] if "any" in rule else []
        some += [_any_in("low", rule["in"])] if "in" in rule else []
        some += ["(" + " AND ".join(have(x) for x in rule["or_all"]) + ")"] if "or_all" in rule else []
        rules.append(f"WHEN {' OR '.join(some)} THEN '{name}'")
    after = " ".join(f"WHEN array_to_string(bi[1:2], ' ') IN ({', '.join(repr(x) for x in starts)}) THEN '{k}'" for k, starts in claims.AFTER_I)
    return f"""(WITH a AS (SELECT {keep}, lower(trim(regexp_replace(trim(t), '^User fact:', ''))) AS low FROM {source}), b AS (SELECT *, {_ALNUM.format('low')} AS w FROM a WHERE low <> ''),
c AS (SELECT *, w[{first('w', ['spent', 'paid', 'cost'])} + 1:] AS bs, {first('w', ['spent', 'paid', 'cost'])} AS ps, {first('w', ['i'])} AS pi, w[{first('w', ['i'])} + 1:] AS bi, {first('w', ['my'])} AS pm, w[{first('w', ['my'])} + 1:] AS bm FROM b),
e AS (SELECT *, CASE WHEN ps > 0 AND {first('bs', ['on'])} > 0 THEN {plain(f"bs[{first('bs', ['on'])} + 1:]")} ELSE [] END AS price, CASE WHEN pi > 0 THEN {first('bi', claims.HAVE_VERBS)} ELSE 0 END AS ph, CASE WHEN pm > 0 THEN {first('bm', claims.MY_VERBS)} ELSE 0 END AS pv FROM c),
f AS (SELECT *, CASE WHEN ph > 0 THEN bi[ph + 1:] ELSE [] END AS rest FROM e), g AS (SELECT *, coalesce(list_position(list_transform(rest, lambda t: NOT ({isin(claims.BEFORE)})), true), 0) AS st FROM f),
h AS (SELECT *, CASE WHEN st > 0 THEN rest[st:] ELSE [] END AS body FROM g), i AS (SELECT *, {first('body', claims.NAMING + claims.ENDING)} AS en FROM h),
j AS (SELECT *, {plain('(CASE WHEN en > 0 THEN body[1:en - 1] ELSE body END)')} AS head, en > 0 AND body[en] IN ('called', 'named', 'titled') AS naming FROM i),
k AS (SELECT *, {first('head[2:]', claims.WHERE)} AS tu FROM j), l AS (SELECT *, CASE WHEN tu > 0 THEN head[1:tu] ELSE head END AS things, CASE WHEN tu > 0 THEN list_filter(head[tu + 2:], lambda t: NOT ({isin(claims.WHERE)})) ELSE [] END AS places FROM k)
SELECT {keep}, CASE {' '.join(rules)} ELSE coalesce(CASE WHEN len(price) > 0 THEN {key(f"list_append({base('price')}, 'price')")} END,
    CASE WHEN ph > 0 AND (naming OR len(things) > 0) THEN {key(f"list_concat(list_concat(places, {base('things')}), CASE WHEN naming THEN ['name'] WHEN {first('rest', ['0'])} > 0 THEN ['count'] ELSE [] END)")} END,
    CASE WHEN pi > 0 THEN CASE {after} END END, CASE WHEN pv > 1 THEN {key(base('bm[1:pv - 1]'))} END) END AS fact_key FROM l)"""


@query(f"SELECT fact_key, count(*) AS n, min(claim) AS example FROM {_key_sql(f'(SELECT claim, claim AS t FROM {_CLAIMS})', 'claim')} WHERE fact_key IS NOT NULL GROUP BY 1")
def fact_keys(spark, d):
    """Fact keys of the claims of all documents, how often each is told, and the least claim that tells it."""
    c = claims.with_fact_key(_claims(spark, d).select("claim"), "claim")
    return c.groupBy("fact_key").agg(F.count("*").alias("n"), F.min("claim").alias("example"))


@query(f"SELECT memory_id, fact_key FROM {_key_sql(f'(SELECT memory_id, content AS t FROM {M} WHERE content IS NOT NULL)', 'memory_id')} WHERE fact_key IS NOT NULL")
def memory_fact_keys(spark, d):
    """Memories with a fact key."""
    return claims.with_fact_key(memories(spark, d).filter("content is not null").select("memory_id", "content"), "content").select("memory_id", "fact_key")


_LIKED = "greatest(" + ", ".join(f"CASE WHEN contains(lower(memory_text), '{p}') THEN {w} ELSE 0 END" for p, w in claims.LIKING.items()) + ", " + ", ".join(
    f"CASE WHEN lower(trim(predicate)) IN ({', '.join(repr(x) for x in ws)}) THEN {w} ELSE 0 END" for w, ws in claims.LIKING_PREDICATES.items()) + ")"


@query(f"SELECT card_id, CAST({_LIKED} AS DOUBLE) AS strength FROM {C} WHERE memory_text IS NOT NULL AND {_LIKED} > 0")
def preference_strengths(spark, d):
    """Cards that tell a liking or disliking, by their text or predicate, and how strong it is."""
    return cards(spark, d).filter("memory_text is not null").select("card_id", claims.preference_strength(F.col("memory_text"), F.coalesce("predicate", F.lit(""))).alias("strength")).filter("strength is not null")


_BACK = "CASE " + " ".join(f"WHEN contains(lower(text), '{p}') AND strlen(trim(regexp_extract(trim(substr(text, instr(lower(text), '{p}') + {len(p)})), '^([^.!?]*)', 1))) >= 12 THEN trim(regexp_extract(trim(substr(text, instr(lower(text), '{p}') + {len(p)})), '^([^.!?]*)', 1))" for p in claims.LOOKING_BACK) + " END"


@query(f"SELECT session_id, turn, refers_to FROM (SELECT session_id, turn, {_BACK} AS refers_to FROM {L}) WHERE refers_to IS NOT NULL")
def retrospective_references(spark, d):
    """What turns refer back to."""
    return ledger(spark, d).select("session_id", "turn", claims.looking_back(F.col("text")).alias("refers_to")).filter("refers_to is not null")


_LOW = _sql_list(claims.LOW_SIGNAL)


@query(f"""SELECT session_id, turn, array_to_string(CASE WHEN len(k) > 0 THEN k ELSE list_filter(string_split({_LINE.format('text')}, ' '), lambda t: strlen(t) > 1) END, ' ') AS terms FROM (SELECT session_id, turn, text, list_filter(w, lambda t: NOT list_contains({_LOW}, t)) AS k
    FROM (SELECT session_id, turn, text, list_filter(regexp_split_to_array(lower(regexp_replace(text, '[^\\p{{L}}\\p{{N}} ]', ' ', 'g')), ' +'), lambda t: strlen(t) > 1) AS w FROM {L}))""")
def search_terms(spark, d):
    """Each turn as a search: its terms without words of little meaning."""
    return ledger(spark, d).select("session_id", "turn", F.array_join(claims.query_terms(F.col("text")), " ").alias("terms"))


# ---- headers, truncation, sentences, profiles ------------------------------------------------


@query(f"SELECT doc_id, {_LINE.format(_STRIP.format('text'))} AS line, CASE WHEN strlen({_LINE.format('text')}) <= 80 THEN {_LINE.format('text')} ELSE trim(substr({_LINE.format('text')}, 1, 80)) END AS short FROM documents WHERE text IS NOT NULL")
def stripped_and_truncated(spark, d):
    """Documents without bracketed prefixes, and cut to eighty characters."""
    return documents(spark, d).select("doc_id", text.one_line(claims.without_prefixes(F.col("text"))).alias("line"), claims.truncated(F.col("text"), 80).alias("short"))


@query("""SELECT doc_id, v AS session_date FROM (SELECT doc_id, trim(regexp_extract(regexp_replace(regexp_replace(text, '\\r\\n?', chr(10), 'g'), '(?m)^(Session date): *(.*)$', '[\\1: \\2]', 'g'), '(?im)^[ \\t]*\\[session date:[ \\t]*([^\\]\\n]*[^\\]\\s])[ \\t]*\\]+[ \\t]*\\r?$', 1)) AS v FROM documents WHERE text IS NOT NULL) WHERE v <> ''""")
def session_dates(spark, d):
    """Dates in the header of session summaries; their "Session date: ..." is put into brackets first."""
    bracketed = F.regexp_replace(F.regexp_replace("text", "\r\n?", "\n"), r"(?m)^(Session date): *(.*)$", "[$1: $2]")
    return documents(spark, d).select("doc_id", claims.header_value(bracketed, "session date").alias("session_date")).filter("session_date is not null")


_SENT = "(SELECT memory_id, entity_id, unnest(list_filter(list_transform(regexp_split_to_array(content, '[.!?\\n]'), lambda p: trim(p)), lambda p: p <> '')) AS s FROM " + M + " WHERE content IS NOT NULL AND entity_id IS NOT NULL)"
# Marks of sentences about what a person is and about what they did, and the lengths such sentences may have.
FIRST_PERSON = [" i ", " i'm ", " i’m ", " i am ", " i'd ", " i’d ", " i have ", " i’ve ", " i've ", " my "]
STABLE = ["i am", "i'm", "i’m", "i have", "i've", "i’ve", "i use", "i prefer", "i like", "i love", "i work", "i live", "i own", "usually", "typically", "currently"]
ACTIVE = ["today", "yesterday", "last ", "this ", *[f"in {m}" for m in text.TIME_WORDS[:12]], "i went", "i bought", "i attended", "i started", "i finished", "i did"]
SHORTEST, LONGEST = 12, 280
_LOWSENT = f"' ' || lower({_LINE.format('s')}) || ' '"


@query(f"""SELECT entity_id, count(*) AS n_sentences, count(*) FILTER (p AND {_any_in('l', STABLE)}) AS n_stable, count(*) FILTER (p AND {_any_in('l', ACTIVE)}) AS n_active FROM (SELECT *, {_any_in('l', FIRST_PERSON)} AND strlen(l) - 2 BETWEEN {SHORTEST} AND {LONGEST} AS p FROM (SELECT entity_id, {_LOWSENT} AS l FROM {_SENT})) GROUP BY 1""")
def profile_sentences(spark, d):
    """Per entity its sentences, and those in the first person about what it is and what it did."""
    s = memories(spark, d).filter("content is not null and entity_id is not null").select("entity_id", F.explode(claims.sentences(F.col("content"))).alias("s"))
    s = s.select("entity_id", F.concat(F.lit(" "), F.lower(text.one_line(F.col("s"))), F.lit(" ")).alias("l"))
    own = claims.contains_any(F.col("l"), FIRST_PERSON) & (F.octet_length("l") - 2).between(SHORTEST, LONGEST)
    return s.groupBy("entity_id").agg(F.count("*").alias("n_sentences"), F.count(F.when(own & claims.contains_any(F.col("l"), STABLE), 1)).alias("n_stable"), F.count(F.when(own & claims.contains_any(F.col("l"), ACTIVE), 1)).alias("n_active"))


# ---- dates ---------------------------------------------------------------------------------------


def _date_sql(source: str, keep: str) -> str:
    """SQL for the date of column t, with column ref as the reference time."""
    num = lambda e, a, b: f"(CASE WHEN regexp_matches({e}, '^[0-9]{{1,4}}$') AND TRY_CAST({e} AS INT) BETWEEN {a} AND {b} THEN TRY_CAST({e} AS INT) END)"
    v = lambda y, m, dd: f"(CAST(epoch(make_date({y}, {m}, 1)) AS BIGINT) + ({dd} - 1) * 86400) * 1000"
    ms = lambda y, m, dd: f"CASE WHEN {v(y, m, dd)} >= 0 THEN {v(y, m, dd)} END"
    month_of = "(CASE w[mp] " + " ".join(f"WHEN '{k}' THEN {m}" for k, m in dates.MONTHS.items()) + " END)"
    return f"""(WITH a AS (SELECT {keep}, t, ref, list_filter(list_transform(regexp_split_to_array(t, '\\s+'), lambda x: regexp_extract(x, '^[^A-Za-z0-9-]*([0-9]{{4}}-[0-9]{{1,2}}-[0-9]{{1,2}})[^A-Za-z0-9-]*$', 1)), lambda x: x <> '') AS isos,
    list_filter(regexp_split_to_array(lower(t), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM {source}),
b AS (SELECT *, list_filter(list_transform(isos, lambda x: list_transform(string_split(x, '-'), lambda y: TRY_CAST(y AS INT))), lambda x: x[1] BETWEEN 1900 AND 2200 AND x[2] BETWEEN 1 AND 12 AND x[3] BETWEEN 1 AND 31)[1] AS iso,
    list_filter(range(1, len(w) + 1), lambda i: list_contains({_sql_list(dates.MONTHS)}, w[i]) AND (w[i] <> 'may' OR {num('w[i + 1]', 1, 31)} IS NOT NULL OR {num('w[i + 1]', 1900, 2200)} IS NOT NULL OR (i > 1 AND {num('w[i - 1]', 1, 31)} IS NOT NULL)))[1] AS mp,
    list_filter(list_transform(w, lambda x: CASE WHEN length(x) = 4 THEN {num('x', 1900, 2200)} END), lambda x: x IS NOT NULL)[1] AS yr FROM a),
c AS (SELECT *, {num('w[mp + 1]', 1, 31)} AS nxt, CASE WHEN mp > 1 THEN {num('w[mp - 1]', 1, 31)} END AS prv FROM b),
d AS (SELECT *, coalesce(CASE WHEN nxt IS NOT NULL THEN {num('w[mp + 2]', 1900, 2200)} ELSE {num('w[mp + 1]', 1900, 2200)} END, year(make_timestamp(ref * 1000))) AS y FROM c)
SELECT {keep}, t, ref, CASE WHEN iso IS NOT NULL THEN {ms('iso[1]', 'iso[2]', 'iso[3]')} WHEN mp IS NOT NULL THEN {ms('y', month_of, 'coalesce(prv, nxt, 1)')} WHEN yr IS NOT NULL THEN {ms('yr', '1', '1')} END AS date_ms FROM d)"""


_MOVED = "CASE " + " ".join(f"WHEN contains(lower(t), '{w}') THEN ref + {n} * 86400000" for w, n in dates.MOVES) + " END"


@query(f"""SELECT memory_id, date_ms, coalesce(date_ms, {_MOVED}) AS event_ms FROM {_date_sql(f"(SELECT memory_id, content AS t, created_at_ms AS ref FROM {M} WHERE content IS NOT NULL AND created_at_ms IS NOT NULL)", "memory_id")}""")
def event_times(spark, d):
    """The date a memory tells, and the time of its event, also told by words like yesterday."""
    m = memories(spark, d).filter("content is not null and created_at_ms is not null")
    m = dates.with_date_ms(m.select("memory_id", "content", "created_at_ms"), "content", "created_at_ms")
    return m.select("memory_id", "date_ms", F.coalesce("date_ms", dates.moved_ms(F.col("content"), F.col("created_at_ms"))).alias("event_ms"))


@query(f"""SELECT doc_id, coalesce(date_ms, ref) AS document_ms FROM {_date_sql("(SELECT doc_id, coalesce(regexp_extract(text, '(?m)^Session date: *([^\\r\\n]*)', 1), '') AS t, epoch_us(created_at) // 1000 AS ref FROM documents WHERE text IS NOT NULL AND created_at IS NOT NULL)", "doc_id")}""")
def document_times(spark, d):
    """The time of a document: the date of its header, else when it was created."""
    x = documents(spark, d, "created_at").filter("created_at is not null").select("doc_id", F.unix_millis(F.col("created_at").cast("timestamp")).alias("ref"), F.regexp_extract("text", r"(?m)^Session date: *([^\r\n]*)", 1).alias("t"))
    return dates.with_date_ms(x, "t", "ref").select("doc_id", F.coalesce("date_ms", "ref").alias("document_ms"))


# ---- quantities ---------------------------------------------------------------------------------------


def _quantity_sql() -> str:
    edge = lambda p: p.replace(r"\b", r"(?:$|[^\p{L}\p{N}_])")  # noqa: E731  (there a word's edge is one of ASCII letters)
    parts = [f"SELECT doc_id, 'money' AS label, TRY_CAST(replace(CASE WHEN a <> '' THEN a ELSE b END, ',', '') AS DOUBLE) AS value, 'USD' AS unit FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{text.MONEY_PATTERN}', 1)) AS a, unnest(regexp_extract_all(text, '{text.MONEY_PATTERN}', 2)) AS b FROM documents)"]
    for k, p in text.QUANTITY_PATTERNS.items():
        p = edge(p)
        label, unit = ("'percentage'", "'%'") if k == "percentage" else (f"'{k}_' || lower(u)", "u")
        parts.append(f"SELECT doc_id, {label}, TRY_CAST(v AS DOUBLE), {unit} FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{p}', 1)) AS v, unnest(regexp_extract_all(text, '{p}', 2)) AS u FROM documents)")
    kind = "CASE " + " ".join(f"WHEN regexp_matches(u, '{p}') THEN '{k}'" for k, p in text.ROUGH_KINDS.items()) + " ELSE 'count' END"
    r, a = edge(text.RANGE_PATTERN), edge(text.ROUGH_PATTERN)
    parts.append(f"SELECT doc_id, {kind} || '_range', (TRY_CAST(lo AS DOUBLE) + TRY_CAST(hi AS DOUBLE)) / 2, nullif(u, '') FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{r}', 1)) AS lo, unnest(regexp_extract_all(text, '{r}', 2)) AS hi, unnest(regexp_extract_all(text, '{r}', 3)) AS u FROM documents)")
    parts.append(f"SELECT doc_id, {kind} || '_approx', TRY_CAST(v AS DOUBLE), nullif(u, '') FROM (SELECT doc_id, unnest(regexp_extract_all(text, '{a}', 1)) AS v, unnest(regexp_extract_all(text, '{a}', 2)) AS u FROM documents)")
    return " UNION ALL ".join(parts)


@query(f"SELECT label, coalesce(unit, '') AS unit, count(*) AS n, count(DISTINCT doc_id) AS n_docs, round(sum(value), 4) AS total FROM ({_quantity_sql()}) GROUP BY 1, 2")
def quantity_families(spark, d):
    """Quantities of all ten kinds found in documents, by label and unit."""
    q = documents(spark, d).select("doc_id", F.explode(text.quantities(F.col("text"))).alias("q"))
    return q.groupBy("q.label", F.coalesce("q.unit", F.lit("")).alias("unit")).agg(F.count("*").alias("n"), F.count_distinct("doc_id").alias("n_docs"), F.round(F.sum("q.value"), 4).alias("total"))


_ONE = "(SELECT trim(entity_id) AS entity_id, split_part(replace(lower(trim(label)), '_', ' '), ' ', 1) AS kind, value + 0.0 AS value, source FROM metrics WHERE value IS NOT NULL AND NOT isnan(value) AND trim(entity_id) <> '' AND trim(label) <> '')"


@query(f"""WITH x AS (SELECT DISTINCT entity_id, kind, value, source IS NOT DISTINCT FROM 'deterministic' AS det FROM {_ONE}), dt AS (SELECT * FROM x WHERE det), nl AS (SELECT * FROM x WHERE NOT det)
SELECT entity_id, kind, value, 'deterministic' AS origin, 1.0::DOUBLE AS confidence FROM dt UNION ALL SELECT entity_id, kind, value, CASE WHEN has THEN 'merged' ELSE 'neural' END, CASE WHEN has THEN 0.6 ELSE 0.7 END
FROM (SELECT nl.*, EXISTS (SELECT 1 FROM dt WHERE dt.entity_id = nl.entity_id AND dt.kind = nl.kind) AS has FROM nl WHERE NOT EXISTS (SELECT 1 FROM dt WHERE dt.entity_id = nl.entity_id AND dt.kind = nl.kind AND dt.value = nl.value))""")
def extractions_merged(spark, d):
    """Readings of two extractors merged by entity and kind: what the first found counts most, what only the second found less, its repeats not."""
    m = table(spark, d, "metrics", "entity_id", "label", "value", "source").withColumn("entity_id", clean_id("entity_id")).filter("value is not null and not isnan(value) and entity_id is not null and trim(label) <> ''")
    kind = F.substring_index(F.replace(F.lower(F.trim("label")), F.lit("_"), F.lit(" ")), " ", 1)
    m = m.select("entity_id", kind.alias("kind"), (F.col("value") + 0.0).alias("value"), F.col("source").eqNullSafe("deterministic").alias("det"))
    per = m.groupBy("entity_id", "kind", "value").agg(F.max("det").alias("det"))
    has = per.groupBy("entity_id", "kind").agg(F.max("det").alias("has"))
    x = per.join(has, ["entity_id", "kind"])
    origin = F.when(F.col("det"), "deterministic").when(F.col("has"), "merged").otherwise("neural")
    return x.select("entity_id", "kind", "value", origin.alias("origin"), F.when(F.col("det"), 1.0).when(F.col("has"), 0.6).otherwise(0.7).alias("confidence"))


@query(r"""SELECT unit, kind, answer, count(*) AS n FROM (SELECT unit, CASE WHEN regexp_matches(unit, 'mile|km') THEN 'distance' WHEN regexp_matches(unit, 'dollar|^[$]$') THEN 'money' WHEN regexp_matches(unit, '^%$') THEN 'percentage' WHEN regexp_matches(unit, 'hour|minute|day') THEN 'duration' WHEN regexp_matches(unit, 'lb|kg') THEN 'weight' ELSE 'count' END AS kind,
    CASE WHEN value < 0 AND n > 0 THEN '-' ELSE '' END || n // 100 || CASE WHEN n % 100 = 0 THEN '' WHEN n % 10 = 0 THEN '.' || n % 100 // 10 ELSE '.' || lpad((n % 100)::VARCHAR, 2, '0') END || ' ' || unit AS answer FROM (SELECT *, CAST(floor(abs(value) * 100 + 0.5) AS BIGINT) AS n FROM metrics WHERE NOT isnan(value)) WHERE value IS NOT NULL AND NOT isnan(value) AND abs(value) < 1e9 AND trim(unit) <> '') GROUP BY 1, 2, 3""")
def formatted_answers(spark, d):
    """Readings as answers: whole numbers without a point, others with up to two decimals, and the kind their unit tells."""
    m = table(spark, d, "metrics", "value", "unit").filter("value is not null and not isnan(value) and abs(value) < 1e9 and trim(unit) <> ''")
    n = F.floor(F.abs("value") * 100 + 0.5).cast("long")
    cents = F.when(n % 100 == 0, "").when(n % 10 == 0, F.concat(F.lit("."), (n % 100 / 10).cast("int"))).otherwise(F.concat(F.lit("."), F.lpad((n % 100).cast("string"), 2, "0")))
    number = F.concat(F.when((F.col("value") < 0) & (n > 0), "-").otherwise(""), F.floor(n / 100).cast("long"), cents)
    return m.select("unit", text.rough_kind(F.col("unit")).alias("kind"), F.concat(number, F.lit(" "), "unit").alias("answer")).groupBy("unit", "kind", "answer").agg(F.count("*").alias("n"))


# ---- dialogue, companions, rows made from texts -------------------------------------------------------------

# Labels that are no speakers.
NO_SPEAKER = ["system", "session id", "session date", "session focus", "window turns"]
_ROLE_SQL = """regexp_replace(trim({}), '^["''\\[\\]*• -]+|["''\\[\\]*• -]+$', '', 'g')"""


def _turns(spark, d) -> DataFrame:
    """(doc_id, speaker, said, place): turns of every document, each once, from lines and from JSON turns."""
    t = documents(spark, d)
    lines = t.select("doc_id", F.posexplode(F.split(F.regexp_replace("text", "\r\n?", "\n"), "\n")).alias("place", "line"))
    out = lines.select("doc_id", "place", extract.role_line(F.col("line"), NO_SPEAKER).alias("r")).filter("r is not null").select("doc_id", F.col("r.speaker").alias("speaker"), F.col("r.said").alias("said"), "place")
    return out.groupBy("doc_id", "speaker", "said").agg(F.min("place").alias("place"))


def _turn_sql() -> str:
    body = "regexp_replace(trim(line), '^[-*•> ]+', '')"
    pieces = []
    for k, sep in enumerate((":", "=>", " - ")):
        role, rest = f"split_part(x, '{sep}', 1)", f"substr(x, instr(x, '{sep}') + {len(sep)})"
        role = _ROLE_SQL.format(role)
        said = _LINE.format(_STRIP.format(rest))
        ok = f"contains(x, '{sep}') AND {role} <> '' AND lower({role}) NOT IN ({', '.join(repr(w) for w in NO_SPEAKER)}) AND NOT starts_with(lower({role}), 'session ') AND NOT starts_with(lower({role}), 'window ') AND {said} <> ''"
        pieces.append(f"WHEN {ok} THEN {{'speaker': {role}, 'said': {said}}}")
    return f"""(SELECT doc_id, r.speaker AS speaker, r.said AS said, min(place) AS place FROM (SELECT doc_id, place, CASE WHEN x = '' OR (starts_with(x, '[') AND ends_with(x, ']')) THEN NULL {' '.join(pieces)} END AS r
    FROM (SELECT doc_id, place, {body} AS x FROM (SELECT doc_id, unnest(l) AS line, generate_subscripts(l, 1)::INT - 1 AS place FROM (SELECT doc_id, string_split(replace(replace(text, chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)) AS l FROM documents WHERE text IS NOT NULL)))) WHERE r IS NOT NULL GROUP BY 1, 2, 3)"""


@query(f"SELECT doc_id, speaker, said, place FROM {_turn_sql()}")
def dialogue_turns(spark, d):
    """Turns of lines "speaker: said", "speaker => said" or "speaker - said", behind bullets, headers aside, each once."""
    return _turns(spark, d)


_FIRSTS = f"(SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY place, speaker, said) AS k, row_number() OVER (PARTITION BY doc_id, {_any_in(chr(39) + ' ' + chr(39) + ' || lower(said) || ' + chr(39) + ' ' + chr(39), claims.FACT_LIKE)} ORDER BY place, speaker, said) AS kf, {_any_in(chr(39) + ' ' + chr(39) + ' || lower(said) || ' + chr(39) + ' ' + chr(39), claims.FACT_LIKE)} AS own FROM {_turn_sql()})"


@query(f"""SELECT doc_id, 'Session gist: ' || string_agg(speaker || ': ' || said, ' | ' ORDER BY k) FILTER (k <= 3) AS gist, coalesce(string_agg(speaker || ': ' || said, ' | ' ORDER BY k) FILTER (own AND kf <= 2), '') AS facts FROM {_FIRSTS} GROUP BY 1""")
def companion_texts(spark, d):
    """The gist of each document's dialogue, its first three turns, and its first two turns in the first person."""
    t = _turns(spark, d).withColumn("own", claims.fact_like(F.col("said")))
    order = ["place", "speaker", "said"]
    t = t.withColumn("k", F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))).withColumn("kf", F.row_number().over(Window.partitionBy("doc_id", "own").orderBy(*order)))
    t = t.filter("k <= 3 or (own and kf <= 2)").withColumn("line", F.concat("speaker", F.lit(": "), "said"))
    joined = lambda keep: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(keep, F.struct("k", "line")))), lambda x: x["line"]), " | ")
    return t.groupBy("doc_id").agg(F.concat(F.lit("Session gist: "), joined(F.col("k") <= 3)).alias("gist"), joined(F.col("own") & (F.col("kf") <= 2)).alias("facts"))


@query(f"""SELECT memory_id, claim, place, 'Atomic memory card: ' || claim AS card_text, CASE WHEN regexp_matches(lower(claim), '{'|'.join(claims.LIKING)}') THEN 'preference' ELSE 'fact' END AS card_kind FROM (SELECT memory_id, claim, row_number() OVER (PARTITION BY memory_id ORDER BY p) AS place
    FROM (SELECT memory_id, min(p) AS p, arg_min(claim, p) AS claim FROM (SELECT memory_id, unnest(c) AS claim, generate_subscripts(c, 1) AS p FROM (SELECT memory_id, list_filter(list_transform(regexp_split_to_array(content, '[.!?;]'), lambda p: {_LINE.format(_STRIP.format('p'))}), lambda p: strlen(p) >= 12) AS c FROM {M} WHERE content IS NOT NULL)) WHERE {_SIGNAL} GROUP BY memory_id, lower(claim))) WHERE place <= 4""")
def atomic_cards(spark, d):
    """Up to four cards of each memory: its first different claims of high signal, told to be a preference or a fact."""
    c = memories(spark, d).filter("content is not null").select("memory_id", F.posexplode(claims.claims(F.col("content"))).alias("p", "claim")).filter(claims.high_signal(F.col("claim")))
    c = c.groupBy("memory_id", F.lower("claim").alias("_l")).agg(F.min(F.struct("p", "claim")).alias("r"))
    c = c.withColumn("place", F.row_number().over(Window.partitionBy("memory_id").orderBy("r.p"))).filter("place <= 4").select("memory_id", "r.claim", "place")
    return c.select("memory_id", "claim", "place", F.concat(F.lit("Atomic memory card: "), "claim").alias("card_text"), F.when(claims.preference_strength(F.col("claim")).isNotNull(), "preference").otherwise("fact").alias("card_kind"))


_PH = _NAMED.format("text") + "[1:4]"


@query(f"""SELECT session_id, turn, 'before: ' || coalesce(array_to_string(lag(p) OVER w, ', '), '') || ' | behind: ' || coalesce(array_to_string(lead(p) OVER w, ', '), '') AS header FROM (SELECT session_id, turn, {_NAMED.format('text')}[1:4] AS p FROM {L}) WINDOW w AS (PARTITION BY session_id ORDER BY turn)""")
def context_headers(spark, d):
    """The first names of the turns before and behind each turn."""
    w = Window.partitionBy("session_id").orderBy("turn")
    pattern = "((?:\\b[A-Z][A-Za-z'-]*[a-z][A-Za-z'-]*\\b)(?:[ \\t]+(?:[A-Z][A-Za-z'-]*[a-z][A-Za-z'-]*))*)"
    names = F.slice(F.filter(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), _longer_than_two), 1, 4)
    t = ledger(spark, d).select("session_id", "turn", F.array_join(names, ", ").alias("p"))
    return t.select("session_id", "turn", F.concat(F.lit("before: "), F.coalesce(F.lag("p").over(w), F.lit("")), F.lit(" | behind: "), F.coalesce(F.lead("p").over(w), F.lit(""))).alias("header"))


def _longer_than_two(p: Column) -> Column:
    return F.length(p) > 2


# Weights of facets.
FACETS = {"person": 0.95, "activity": 0.58, "preference": 0.88, "decision": 0.82, "number": 0.70, "date": 0.78}


@query(f"""SELECT facet, value, count(DISTINCT memory_id) AS n, max(w) AS weight FROM (SELECT memory_id, 'person' AS facet, unnest({_NAMED.format('content')}) AS value, 0.95::DOUBLE AS w FROM {M} WHERE content IS NOT NULL
    UNION ALL SELECT memory_id, 'number', unnest(regexp_extract_all(content, '\\b(\\d+(?:\\.\\d+)?)\\b', 1)), 0.70 FROM {M} WHERE content IS NOT NULL
    UNION ALL SELECT memory_id, 'date', unnest(list_filter([{_TIMES}], lambda w: contains(lower(content), w))), 0.78 FROM {M} WHERE content IS NOT NULL
    UNION ALL SELECT memory_id, CASE kind WHEN 'Preference' THEN 'preference' WHEN 'Decision' THEN 'decision' ELSE 'activity' END, kind, CASE kind WHEN 'Preference' THEN 0.88 WHEN 'Decision' THEN 0.82 ELSE 0.58 END FROM {M} WHERE content IS NOT NULL AND kind IN ('Preference', 'Decision', 'Conversational')) GROUP BY 1, 2""")
def facet_weights(spark, d):
    """Facets of memories of all six kinds with their weight and the number of memories that have them."""
    low = F.lower("content")
    label = lambda k: lambda v: F.struct(F.lit(k).alias("facet"), v.alias("value"), F.lit(FACETS[k]).alias("w"))
    kind = F.when(F.col("kind") == "Preference", "preference").when(F.col("kind") == "Decision", "decision").when(F.col("kind") == "Conversational", "activity")
    weight = F.when(kind == "preference", FACETS["preference"]).when(kind == "decision", FACETS["decision"]).otherwise(FACETS["activity"])
    own = F.filter(F.array(F.struct(kind.alias("facet"), F.col("kind").alias("value"), weight.alias("w"))), _has_facet)
    times = F.filter(F.array(*[F.when(F.contains(low, F.lit(w)), w) for w in text.TIME_WORDS]), lambda x: x.isNotNull())
    found = F.concat(F.transform(extract.named_phrases(F.col("content")), label("person")), F.transform(F.array_distinct(F.regexp_extract_all("content", F.lit("\\b(\\d+(?:\\.\\d+)?)\\b"), F.lit(1))), label("number")), F.transform(times, label("date")), own)
    m = memories(spark, d).filter("content is not null").select("memory_id", F.explode(found).alias("f"))
    return m.groupBy("f.facet", "f.value").agg(F.count_distinct("memory_id").alias("n"), F.max("f.w").alias("weight"))


def _has_facet(x: Column) -> Column:
    return x["facet"].isNotNull()


@query(f"""SELECT memory_id, CASE kind WHEN 'Preference' THEN 'preference' WHEN 'Decision' THEN 'decision' WHEN 'SessionSummary' THEN 'episode' WHEN 'Lesson' THEN 'fact' WHEN 'Fact' THEN 'fact' ELSE 'event' END AS card_type, kind IN ('Preference', 'Decision') AS is_static, content AS memory_text, created_at_ms FROM {M} WHERE content IS NOT NULL AND kind IS NOT NULL""")
def cards_from_memories(spark, d):
    """A card row for every memory, its type and whether it stays told by its kind."""
    m = memories(spark, d).filter("content is not null and kind is not null")
    kind = F.col("kind")
    card_type = F.when(kind == "Preference", "preference").when(kind == "Decision", "decision").when(kind == "SessionSummary", "episode").when(kind.isin("Lesson", "Fact"), "fact").otherwise("event")
    return m.select("memory_id", card_type.alias("card_type"), kind.isin("Preference", "Decision").alias("is_static"), F.col("content").alias("memory_text"), "created_at_ms")


@query(f"""SELECT session_id, entity_id, 'session: ' || session_id || chr(10) || 'turns: ' || count(*) || chr(10) || 'sources: ' || array_to_string(list_sort(list(DISTINCT source_type)), ', ') AS router_text FROM {L} WHERE entity_id IS NOT NULL AND source_type IS NOT NULL GROUP BY 1, 2""")
def router_texts(spark, d):
    """The text a session is routed by."""
    t = ledger(spark, d).filter("entity_id is not null and source_type is not null").groupBy("session_id", "entity_id").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("source_type")), ", ").alias("s"))
    return t.select("session_id", "entity_id", F.concat_ws("\n", F.concat(F.lit("session: "), "session_id"), F.concat(F.lit("turns: "), "n"), F.concat(F.lit("sources: "), "s")).alias("router_text"))


@query(f"""SELECT session_id, substr(string_agg(text, ' ' ORDER BY turn), 1, 320) AS focus FROM (SELECT trim(t.session_id) AS session_id, t.turn_index AS turn, min(t.raw_text) AS text FROM ledger_turns t WHERE lower(trim(speaker)) IN ('user', 'human', 'usr') AND trim(session_id) <> '' AND turn_index IS NOT NULL AND raw_text IS NOT NULL GROUP BY 1, 2) GROUP BY 1""")
def session_focus(spark, d):
    """What a session's user says, cut to 320 characters. Only as many turns are joined as can be seen in them."""
    t = table(spark, d, "ledger_turns", "session_id", "turn_index", "speaker", "raw_text").filter(F.lower(F.trim("speaker")).isin("user", "human", "usr") & F.col("turn_index").isNotNull() & F.col("raw_text").isNotNull())
    t = t.select(clean_id("session_id").alias("session_id"), F.col("turn_index").alias("turn"), "raw_text").filter("session_id is not null").groupBy("session_id", "turn").agg(F.min("raw_text").alias("text"))
    first = F.row_number().over(Window.partitionBy("session_id").orderBy("turn"))  # each turn adds at least a blank
    t = t.withColumn("k", first).filter("k <= 321").groupBy("session_id").agg(F.array_sort(F.collect_list(F.struct("k", F.substring("text", 1, 320).alias("text"), (F.length("text") > 320).alias("cut")))).alias("x"))
    return t.select("session_id", F.substring(F.array_join(F.transform("x", _text_of), " "), 1, 320).alias("focus"))


def _text_of(x: Column) -> Column:
    return x["text"]


@query(f"""SELECT card_id, array_to_string(list_transform(list_filter(range(1, len(v) + 1), lambda i: list_position(list_transform(v, lambda x: lower(x)), lower(v[i])) = i), lambda i: v[i]), '|') AS items FROM (SELECT card_id, list_filter([subject, predicate, object, card_type], lambda x: x IS NOT NULL) AS v FROM {C})""")
def items_without_repeats(spark, d):
    """The words of a card in order, repeats in other letters' case left out."""
    return cards(spark, d).select("card_id", F.array_join(extract.distinct_ignoring_case(F.filter(F.array("subject", "predicate", "object", "card_type"), _present)), "|").alias("items"))


def _present(x: Column) -> Column:
    return x.isNotNull()


# ---- names -----------------------------------------------------------------------------------------------


def _soundex_sql(c: str) -> str:
    low = f"regexp_replace(lower({c}), '[^a-z]', '', 'g')"
    code = "translate({}, 'abcdefghijklmnopqrstuvwxyz', '01230120022455012623010202')"
    codes = code.format(low)
    rest = f"array_to_string(list_filter(list_transform(range(2, length({low}) + 1), lambda i: CASE WHEN substr({codes}, i, 1) <> substr({codes}, i - 1, 1) THEN substr({codes}, i, 1) ELSE '0' END), lambda x: x <> '0')[1:3], '')"
    return f"CASE WHEN {low} = '' THEN '' ELSE rpad(substr({low}, 1, 1) || {rest}, 4, '0') END"


_PHON = "translate(replace(replace(replace(replace(lower({}), 'ph', chr(57344)), 'ck', chr(57345)), 'kn', chr(57346)), 'wr', chr(57347)), chr(57344) || chr(57345) || chr(57346) || chr(57347), 'fknr')"
_REGN = "(SELECT DISTINCT trim(canonical_name) AS name FROM entity_registry WHERE trim(canonical_name) <> '')"


@query(f"SELECT name, {_soundex_sql('name')} AS soundex, {_soundex_sql(_PHON.format('name'))} AS phonetic FROM {_REGN}")
def phonetic_names(spark, d):
    """Distinct names of the registry with their phonetic keys."""
    n = table(spark, d, "entity_registry", "canonical_name").select(clean_id("canonical_name").alias("name")).filter("name is not null").distinct()
    return n.select("name", text.soundex_variant(F.col("name")).alias("soundex"), text.phonetic_key(F.col("name")).alias("phonetic"))


_EN = "('prefers', 'works_at', 'lives_in', 'caused_by', 'leads_to', 'default')"
_RESOLVED = f"""WITH asked AS (SELECT DISTINCT trim(target) AS name FROM {E} WHERE edge_type IN {_EN} AND length(trim(target)) >= 2), ex AS (SELECT a.name, min(r.name) AS hit FROM asked a JOIN {_REGN} r ON lower(a.name) = lower(r.name) GROUP BY 1),
op AS (SELECT name FROM asked WHERE name NOT IN (SELECT name FROM ex)), nr AS (SELECT name, hit, s FROM (SELECT o.name, r.name AS hit, jaro_winkler_similarity(lower(r.name), lower(o.name)) AS s, row_number() OVER (PARTITION BY o.name ORDER BY jaro_winkler_similarity(lower(r.name), lower(o.name)) DESC, r.name) AS k
    FROM op o JOIN {_REGN} r ON jaro_winkler_similarity(lower(r.name), lower(o.name)) >= 0.92) WHERE k = 1), sd AS (SELECT {_soundex_sql(_PHON.format('name'))} AS k, min(name) AS hit FROM {_REGN} GROUP BY 1)
SELECT name, hit AS resolved, 'exact' AS method, 1.0::DOUBLE AS confidence FROM ex UNION ALL SELECT name, hit, 'similar', round(s, 4) FROM nr
UNION ALL SELECT o.name, sd.hit, CASE WHEN sd.hit IS NULL THEN 'none' ELSE 'phonetic' END, CASE WHEN sd.hit IS NULL THEN 0.0 ELSE 0.85 END FROM op o LEFT JOIN sd ON {_soundex_sql(_PHON.format('o.name'))} = sd.k WHERE o.name NOT IN (SELECT name FROM nr)"""


def _resolved(spark, d) -> DataFrame:
    named = edges(spark, d).filter(F.col("edge_type").isin("prefers", "works_at", "lives_in", "caused_by", "leads_to", "default"))
    out = resolve.resolve(named.filter("target is not null"), "target", table(spark, d, "entity_registry"), "entity_id", "canonical_name")
    return out.withColumn("confidence", F.round("confidence", 4))


@query(_RESOLVED)
def resolve_similar(spark, d):
    """Names of edges resolved exactly, by similarity, or by sound."""
    return _resolved(spark, d)


@query(f"SELECT name, resolved, method, confidence, CASE method WHEN 'similar' THEN 3 ELSE 2 END AS priority FROM ({_RESOLVED}) WHERE method IN ('similar', 'phonetic') AND name <> resolved")
def merge_proposals(spark, d):
    """Names that resolve to another name, neither exactly nor to themselves, as proposals to merge, exact ones (4) aside."""
    x = _resolved(spark, d).filter(F.col("method").isin("similar", "phonetic") & (F.col("name") != F.col("resolved")))
    return x.withColumn("priority", F.when(F.col("method") == "similar", 3).otherwise(2))


SQL["resolve_names"] = f"""WITH named AS (SELECT DISTINCT source FROM {E} WHERE edge_type IN {_EN} AND source IS NOT NULL), r AS (SELECT DISTINCT trim(canonical_name) AS name FROM entity_registry WHERE trim(canonical_name) <> '' AND trim(entity_id) <> ''),
ex AS (SELECT lower(name) AS k, min(name) AS hit FROM r GROUP BY 1), sd AS (SELECT {_soundex_sql(_PHON.format('name'))} AS k, min(name) AS near FROM r GROUP BY 1)
SELECT source, coalesce(hit, near) AS resolved, CASE WHEN hit IS NOT NULL THEN 'exact' WHEN near IS NOT NULL THEN 'phonetic' ELSE 'none' END AS method, CASE WHEN hit IS NOT NULL THEN 1.0 WHEN near IS NOT NULL THEN 0.85 ELSE 0.0 END::DOUBLE AS confidence
FROM named LEFT JOIN ex ON lower(source) = ex.k LEFT JOIN sd ON {_soundex_sql(_PHON.format('source'))} = sd.k"""
