"""Scores: decay, blends, boosts; Column in, Column out."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
# Half-life and time to live in days by kind (None: never), and the floor of the decay.
DECAY = {"Conversational": (30.0, 90.0), "Lesson": (90.0, 365.0), "Fact": (180.0, 730.0), "SessionSummary": (14.0, 60.0), "Decision": (None, None), "Preference": (None, None)}
DECAY_FLOOR = 0.35
# Default weights of edge types, and boosts of card types.
EDGE_WEIGHTS = {"caused_by": 1.4, "prefers": 1.2, "derived_from": 0.7, "supersedes": 0.3}
TYPE_BOOSTS = {"fact": 0.10, "preference": 0.09, "profile": 0.09, "event": 0.07, "episode": 0.07, "decision": 0.06, "inference": 0.04}


def _by_kind(kind: Column, place: int) -> Column:
    out = F.lit(None).cast("double")
    for k, v in DECAY.items():
        out = F.when(kind == k, F.lit(v[place]).cast("double")).otherwise(out)
    return out


def decay_with_policy(base: Column, created_ms: Column, kind: Column, now_ms: int) -> Column:
    """base * max(2^(-age/half-life), floor); null once the time to live of the kind has passed."""
    age = F.greatest(F.lit(now_ms) - created_ms, F.lit(0)) / DAY_MS
    half, ttl = _by_kind(kind, 0), _by_kind(kind, 1)
    faded = base * F.greatest(F.pow(F.lit(2.0), -age / half), F.lit(DECAY_FLOOR))
    return F.when(half.isNull() | (age <= 0), base).when(age <= ttl, faded)


def edge_weight(edge_type: Column) -> Column:
    out = F.lit(1.0)
    for k, v in EDGE_WEIGHTS.items():
        out = F.when(edge_type == k, v).otherwise(out)
    return out


def coverage(text: Column, terms: list[str]) -> Column:
    """Share of `terms` contained in the text (lower case); 0 without terms."""
    if not terms:
        return F.lit(0.0)
    return F.size(F.filter(F.array(*[F.lit(t.lower()) for t in terms]), lambda t: F.contains(F.lower(text), t))) / float(len(terms))


def card_score(text: Column, card_type: Column, is_latest: Column, confidence: Column, lexical: list[str], temporal: list[str], entities: list[str], routed: Column) -> Column:
    """Weighted coverages plus boosts by route, type, currency and confidence."""
    boost = F.lit(0.03)
    for k, v in TYPE_BOOSTS.items():
        boost = F.when(card_type == k, v).otherwise(boost)
    conf = F.least(F.greatest(F.coalesce(confidence, F.lit(0.0)), F.lit(0.0)), F.lit(1.0))
    return (0.42 * coverage(text, lexical) + 0.16 * coverage(text, temporal) + 0.24 * coverage(text, entities) + F.when(routed, 0.12).otherwise(0.0) + boost
            + F.when(is_latest == 1, 0.04).otherwise(-0.06) + 0.08 * conf)


def cosine(a: Column, b: Column) -> Column:
    """Cosine of two arrays; 0 for different lengths or a zero norm."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    return F.when(F.size(a) == F.size(b), F.coalesce(F.try_divide(dot(a, b), F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))), F.lit(0.0))).otherwise(0.0)


def facet_mask(tokens: Column, low: Column, facets: list[tuple[list[str], list[str], list[str]]]) -> Column:
    """Bits of the facets (words, times, names) a text meets: one word of up to two, else two of them, and of times and names one, if there are any."""
    out = F.lit(0)
    some = lambda ws: F.exists(F.array(*[F.lit(w) for w in ws]), lambda w: F.contains(low, w)) if ws else F.lit(True)
    for i, (words, times, names) in enumerate(facets):
        hits = F.size(F.array_intersect(F.array(*[F.lit(w) for w in words]), tokens))
        out = out + F.when((hits >= (1 if len(words) <= 2 else 2)) & some(times) & some(names), 1 << i).otherwise(0)
    return out
