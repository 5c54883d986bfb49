"""Claims, fact keys, preferences and headers in texts: Column in, Column out, all inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from memspark.functions.extract import named_phrases
from memspark.functions.text import alpha_tokens, one_line, singular, temporal_terms

# Words of little meaning of their own.
LOW_SIGNAL = ("what when where who why how would could should did does do is are was were be been being likely might will can have has had the this that these those their there them they his her him she you your our "
              "for from with than then kind kinds type types really still just some many more very also about around into over under after before today tomorrow yesterday thing things people person "
              "went going got make made take took doing done want wanted joined started looking working").split()
# Verbs that relate, and words around a person, blanks included.
RELATING = ("volunteer work worked works study studied lives live likes loves prefers prefer enjoys joined went visited watched bought started finished won plays played learned teaches taught plans planned wants wanted has have had is was are were").split()
PERSONAL = [" i ", " my ", " me ", " we ", " our ", " he ", " she ", " his ", " her ", " they "]
FACT_LIKE = [" i ", " my ", " me ", " i'm ", " i'", " we ", " our "]
# Phrases of liking and disliking, and predicates, with their strength.
LIKING = {"love ": 1.0, "loves ": 1.0, "favorite": 0.95, "prefer ": 0.9, "prefers ": 0.9, "enjoy ": 0.8, "enjoys ": 0.8, "like ": 0.7, "likes ": 0.7, "hate ": 0.85, "hates ": 0.85, "avoid ": 0.8, "avoids ": 0.8}
LIKING_PREDICATES = {1.0: ["love", "loves", "favorite"], 0.9: ["prefer", "prefers"], 0.8: ["enjoy", "enjoys", "likes", "like"], 0.85: ["hate", "hates", "avoid", "avoids", "dislikes"]}
LOOKING_BACK = ["remember when ", "remember that time ", "last time we ", "back in ", "that time at ", "that trip when "]
# Keys of facts by what a text holds, in this order. "in": parts of the text; "any": words, "all": one word of each list.
FACT_RULES: list[tuple[str, dict[str, list]]] = [
    ("relationship_status", {"in": ["married", "single", "divorced", "engaged", "dating"]}),
    ("children_count", {"all": [["children", "child", "kids", "kid"], ["have", "has", "had"]]}),
    ("nickname", {"any": ["nickname", "called"]}),
    ("research_topic", {"any": ["research", "researched"]}),
    ("certificate", {"any": ["certificate", "certified"]}),
    ("favorite_team", {"all": [["team"], ["favorite", "support"]]}),
    ("hobbies", {"any": ["hobby", "hobbies"]}),
    ("purchase", {"any": ["bought", "buy", "purchased", "acquired"], "or_all": [["got"], ["new"]]}),
    ("recipe", {"any": ["recipe"]}),
    ("martial_arts", {"any": ["karate", "judo", "taekwondo"], "in": ["martial art"]}),
    ("degree", {"all": [["graduated"], ["degree"]]}),
    ("previous_last_name", {"in": ["last name before", "old name"]}),
    ("previous_occupation", {"in": ["previous occupation"]}),
    ("commute_duration", {"all": [["commute"], ["take", "takes"]]}),
    ("internet_plan_speed", {"in_and": ["internet plan"], "all": [["mbps", "speed", "upgraded"]]}),
    ("spotify_playlist_name", {"all": [["spotify"], ["playlist", "playlists"], ["created", "called", "named"]]}),
]
# What follows the first "i" of a text, and the key it tells.
AFTER_I = [("residence", ["live in", "moved to"]), ("employer", ["work at"]), ("occupation", ["work as", "am a", "am an"]), ("school", ["study at", "studied at", "graduated from"])]
# Verbs behind "my ..." and "i ...", and words that are no part of a key.
MY_VERBS = "is was are were takes take costs cost equals measures lasts lasted called named uses use prefers prefer".split()
HAVE_VERBS = "have has had own owned keep kept".split()
KEY_DROP = "my the a an to of for and new current daily local now currently really very just that this".split()


def contains_any(c: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | F.contains(c, F.lit(w))
    return out


def _has(tokens: Column, words: list[str]) -> Column:
    return F.arrays_overlap(tokens, F.array(*[F.lit(w) for w in words]))


def header_value(c: Column, label: str) -> Column:
    """Value of the first line "[label: value]", null if there is none."""
    v = F.trim(F.regexp_extract(c, rf"(?im)^[ \t]*\[{label}:[ \t]*([^\]\n]*[^\]\s])[ \t]*\]+[ \t]*\r?$", 1))
    return F.when(v != "", v)


def without_prefixes(c: Column) -> Column:
    """The text without bracketed prefixes at its start."""
    return F.regexp_replace(c, r"^[\s\p{Z}]*(\[[^\]]*\][\s\p{Z}]*)*", "")


def truncated(c: Column, most: int) -> Column:
    """On one line; texts of more bytes are cut to so many characters."""
    t = one_line(c)
    return F.when(F.octet_length(t) <= most, t).otherwise(F.trim(F.substring(t, 1, most)))


def claims(c: Column) -> Column:
    """Parts between full stops, question and exclamation marks and semicolons, without prefixes, of twelve bytes or more."""
    return F.filter(F.transform(F.split(c, "[.!?;]"), lambda p: one_line(without_prefixes(p))), lambda p: F.octet_length(p) >= 12)


def sentences(c: Column) -> Column:
    """Trimmed, non-empty parts between sentence ends and line ends."""
    return F.filter(F.transform(F.split(c, "[.!?\n]"), lambda p: F.regexp_replace(p, r"^[\s\p{Z}]+|[\s\p{Z}]+$", "")), lambda p: p != "")


def high_signal(c: Column) -> Column:
    """A claim with a time, a name or a person, and a verb that relates."""
    low = F.lower(c)
    told = (F.size(temporal_terms(c)) > 0) | (F.size(named_phrases(c)) > 0) | contains_any(F.concat(F.lit(" "), low, F.lit(" ")), PERSONAL)
    return told & contains_any(low, RELATING)


def fact_like(c: Column) -> Column:
    """A message in the first person."""
    return contains_any(F.concat(F.lit(" "), F.lower(c), F.lit(" ")), FACT_LIKE)


def preference_strength(c: Column, predicate: Column | None = None) -> Column:
    """Greatest strength of a phrase of liking in the text, or of the predicate; null without any."""
    low = F.lower(c)
    found = [F.when(F.contains(low, F.lit(p)), w).otherwise(0.0) for p, w in LIKING.items()]
    if predicate is not None:
        p = F.lower(F.trim(predicate))
        found += [F.when(p.isin(words), w).otherwise(0.0) for w, words in LIKING_PREDICATES.items()]
    best = F.greatest(*found)
    return F.when(best > 0, best)


def looking_back(c: Column) -> Column:
    """What a text refers to behind the first phrase of looking back that leads to twelve bytes or more."""
    out = F.lit(None).cast("string")
    low = F.lower(c)
    for p in reversed(LOOKING_BACK):
        at = F.locate(p, low)
        rest = F.trim(F.regexp_extract(F.trim(F.substring(c, at + len(p), F.length(c))), "^([^.!?]*)", 1))
        out = F.when((at > 0) & (F.octet_length(rest) >= 12), rest).otherwise(out)
    return out


def key_of(base: Column, suffix: Column | None = None, context: Column | None = None) -> Column:
    """Context, then base with its last token in the singular, then suffix, joined by "_"; numbers and words that are no part of a key are left out; null if none is left."""
    parts = F.concat(F.slice(base, 1, F.greatest(F.size(base) - 1, F.lit(0))), F.transform(F.slice(base, -1, 1), singular))
    parts = F.when(F.size(base) > 0, parts).otherwise(base)
    parts = parts if context is None else F.concat(context, parts)
    parts = parts if suffix is None else F.concat(parts, F.filter(F.array(suffix), lambda t: t.isNotNull()))
    kept = F.filter(parts, lambda t: ~t.rlike("^[0-9]+$") & ~t.isin(KEY_DROP))
    return F.when(F.size(kept) > 0, F.array_join(kept, "_"))


def _first(tokens: Column, words: list[str], other: bool = False) -> Column:
    """Place, from 1, of the first token that is (with `other`, is not) one of the words or, for "0", a number; 0 if there is none."""
    plain = [w for w in words if w != "0"]
    hit = lambda t: t.isin(plain) | (t.rlike("^[0-9]+$") if "0" in words else F.lit(False))
    return F.array_position(F.transform(tokens, lambda t: ~hit(t) if other else hit(t)), F.lit(True)).cast("int")


def _behind(tokens: Column, place: Column) -> Column:
    """Tokens behind a place; none for place 0."""
    none = F.array().cast("array<string>")
    return F.when(place > 0, F.slice(tokens, place + 1, F.size(tokens) + 1)).otherwise(none)


def _plain(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.rlike("^[0-9]+$"))


# Words that end the thing had, words of a place or purpose, words before the thing.
NAMING, ENDING, WHERE, BEFORE = ["called", "named", "titled"], ["is", "was", "are", "were", "that", "which"], ["on", "at", "in", "for", "with"], ["0", "a", "an", "the", "my", "now", "currently"]


def with_fact_key(df: DataFrame, c: str, out: str = "fact_key") -> DataFrame:
    """`df` with the key of the fact its text `c` tells, by FACT_RULES, else by its form: spent ... on, I have ..., I live in ..., my ... is; rows without one are left out.

    Of "I have ..." what stands before "on", "at", "in", "for" or "with" names the thing, what
    stands behind comes first in the key; a number adds count, a name behind "called" name.
    The steps are columns, so that each is worked out once.
    """
    none, keep = F.array().cast("array<string>"), df.columns
    col = lambda x: F.col(f"_{x}")
    steps = [
        {"low": F.lower(F.trim(F.regexp_replace(F.trim(F.col(c)), "^User fact:", "")))}, {"w": alpha_tokens(col("low"))},
        {"spent": _behind(col("w"), _first(col("w"), ["spent", "paid", "cost"])), "i": _behind(col("w"), _first(col("w"), ["i"])), "my": _behind(col("w"), _first(col("w"), ["my"]))},
        {"price": _plain(_behind(col("spent"), _first(col("spent"), ["on"]))), "had": _first(col("i"), HAVE_VERBS), "verb": _first(col("my"), MY_VERBS)},
        {"rest": _behind(col("i"), col("had"))}, {"start": _first(col("rest"), BEFORE, other=True)},
        {"body": F.when(col("start") > 0, F.slice(col("rest"), F.greatest(col("start"), F.lit(1)), F.size(col("rest")) + 1)).otherwise(none)}, {"end": _first(col("body"), NAMING + ENDING)},
        {"head": _plain(F.when(col("end") > 0, F.slice(col("body"), 1, F.greatest(col("end") - 1, F.lit(0)))).otherwise(col("body"))), "naming": (col("end") > 0) & F.get(col("body"), F.greatest(col("end") - 1, F.lit(0))).isin(NAMING)},
        {"turn": _first(F.slice(col("head"), 2, F.size(col("head")) + 1), WHERE)},
        {"things": F.when(col("turn") > 0, F.slice(col("head"), 1, F.greatest(col("turn"), F.lit(0)))).otherwise(col("head")), "where": F.filter(_behind(col("head"), F.when(col("turn") > 0, col("turn") + 1).otherwise(0)), lambda t: ~t.isin(WHERE)),
         "suffix": F.when(col("naming"), "name").when(_first(col("rest"), ["0"]) > 0, "count")},
        {"owned": F.when((col("had") > 0) & (col("naming") | (F.size(col("things")) > 0)), key_of(col("things"), col("suffix"), col("where"))), "paid": F.when(F.size(col("price")) > 0, key_of(col("price"), F.lit("price"))),
         "mine": F.when(col("verb") > 1, key_of(F.slice(col("my"), 1, F.greatest(col("verb") - 1, F.lit(0))))), "told": F.array_join(F.slice(col("i"), 1, 2), " ")},
    ]
    for step in steps:
        df = df.withColumns({f"_{k}": v for k, v in step.items()})
    after = F.lit(None).cast("string")
    for key, starts in reversed(AFTER_I):
        after = F.when(col("told").isin(starts), key).otherwise(after)
    found = F.when(F.lit(False), "")
    for key, rule in FACT_RULES:
        every = F.lit(True)
        for words in rule.get("all", []):
            every = every & _has(col("w"), words)
        for part in rule.get("in_and", []):
            every = every & F.contains(col("low"), F.lit(part))
        some = every if "all" in rule else F.lit(False)
        if "any" in rule:
            some = some | _has(col("w"), rule["any"])
        if "in" in rule:
            some = some | contains_any(col("low"), rule["in"])
        if "or_all" in rule:
            some = some | (_has(col("w"), rule["or_all"][0]) & _has(col("w"), rule["or_all"][1]))
        found = found.when(some, key)
    key = F.when(col("low") != "", F.coalesce(found, col("paid"), col("owned"), after, col("mine")))
    # Rows without a key go by an explode: a filter would be pushed below all steps and work them out again.
    return df.select(*keep, F.explode(F.filter(F.array(key), lambda k: k.isNotNull())).alias(out))


def query_terms(c: Column) -> Column:
    """Terms a text is searched by: alphanumeric words of more than one byte, without words of little meaning; all words if none is left."""
    words = F.filter(F.split(F.lower(F.regexp_replace(c, r"[^\p{L}\p{N} ]", " ")), " +"), lambda t: F.octet_length(t) > 1)
    kept = F.filter(words, lambda t: ~t.isin(LOW_SIGNAL))
    return F.when(F.size(kept) > 0, kept).otherwise(F.filter(F.split(one_line(c), " "), lambda t: F.octet_length(t) > 1))
