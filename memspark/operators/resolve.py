"""Entity resolution: exact, near and phonetic matches of names."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.functions.text import phonetic_key
from memspark.operators.lineage import materialise

NEAR = 0.92
#: By equal leading characters, up to four: m / a + m / b of names of lengths a and b with m matched letters and similarity 0.92 or more.
MATCHED = np.array([3 * (NEAR - 0.1 * k) / (1 - 0.1 * k) - 1 for k in range(5)])
OWN, SHARED = 56, 8  # frequent letters with a column of their own; columns that all others share
ASKED, KNOWN = 32_768, 65_536  # names in a block
CELLS = 1_000_000  # pairs of names counted at once
LONG = 256  # characters; letter_keys pairs names beyond by length alone


def jaro_winkler(a: str, b: str) -> float:
    """Jaro similarity raised by a tenth per equal leading character, up to four."""
    if a == b:
        return 1.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    free = [True] * len(b)
    left = []
    for i, x in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if free[j] and b[j] == x:
                free[j] = False
                left.append(x)
                break
    if not left:
        return 0.0
    right = [y for y, f in zip(b, free, strict=True) if not f]
    m, moved = len(left), sum(x != y for x, y in zip(left, right, strict=True)) // 2  # whole transpositions
    jaro = (m / len(a) + m / len(b) + (m - moved) / m) / 3
    lead = 0
    while lead < min(4, len(a), len(b)) and a[lead] == b[lead]:
        lead += 1
    return jaro + lead * 0.1 * (1 - jaro)


def common_letters(a: int, b: int) -> int:
    """How many letters names of lengths a and b have in common at least, if their similarity is
    0.92 or more and they differ within the first three letters.

    At most two leading letters are equal then, so Jaro is 0.9 or more; its last term is at
    most 1, so m / a + m / b is 1.7 or more for m matched letters.
    """
    return -(-17 * a * b // (10 * (a + b)))


def letters(name: str) -> list[tuple[str, int]]:
    """A name's letters, each with how many equal ones stand before it: a set whose overlaps count common letters."""
    seen: Counter[str] = Counter()
    out = []
    for x in name:
        out.append((x, seen[x]))
        seen[x] += 1
    return out


def letter_keys(name: str, rank: dict[tuple[str, int], int], wide: bool) -> set[str]:
    """Keys of which two names share one if their lengths allow for enough common letters and they have them.

    For every length b of the other name, of the letters ordered from rare to frequent the
    first len - common + k hold the k rarest common ones, whichever those are; the keys are all
    k of them (k = 3, fewer for long names). Names beyond LONG have bands of lengths as
    keys; of two names one has to be `wide`, which gives the bands next to its own too.
    `resolve` counts letters instead (`near_pairs`): a name has about a hundred keys.
    """
    a = len(name)
    order = sorted(letters(name), key=lambda x: (rank.get(x, -1), x))
    out = set()
    for b in range(-(-7 * a // 10), min(10 * a // 7, LONG) + 1) if a <= LONG else ():
        need = common_letters(a, b)
        if need > min(a, b):
            continue
        k = min(need, 3 if max(a, b) <= 24 else 2 if max(a, b) <= 64 else 1)
        lengths = f"{a} {b} " if wide else f"{b} {a} "
        out |= {lengths + "".join(f"{x}{i or ''}" for x, i in c) for c in combinations(order[: a - need + k], k)}
    if 10 * a > 7 * LONG:
        band = (a * 10).bit_length()  # a length differs from 0.7 of it by one band at most
        out |= {f"band {x}" for x in ((band - 1, band, band + 1) if wide else (band,))}
    return out


def numbered_letters(names: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """`letters` of all names as (row, letter with its number)."""
    letter = np.frombuffer("".join(names).encode("utf-32-le"), np.uint32).astype(np.int64)
    key = np.sort(np.repeat(np.arange(len(names)), [len(x) for x in names]) << 21 | letter)
    at = np.arange(len(key))
    nth = at - np.maximum.accumulate(np.where(np.r_[True, key[1:] != key[:-1]], at, 0))
    return key >> 21, key & (1 << 21) - 1 | nth << 21


def letter_counts(asked: list[str], known: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Matrices, a row per name, whose product has at least as many as the common letters of each pair."""
    of = [numbered_letters(x) for x in (asked, known)]
    seen, n = np.unique(of[1][1], return_counts=True)
    own = np.sort(seen[np.argsort(-n, kind="stable")[:OWN]])
    out = []
    for (row, letter), names in zip(of, (asked, known), strict=True):
        at = np.minimum(np.searchsorted(own, letter), len(own) - 1)
        at = np.where(own[at] == letter, at, len(own) + (letter ^ letter >> 21) % SHARED)
        out.append(np.bincount(row * (OWN + SHARED) + at, minlength=len(names) * (OWN + SHARED)).reshape(len(names), -1).astype(np.float32))
    used = out[1].any(axis=0)
    return out[0][:, used], out[1][:, used]


def leads(names: list[str], fill: str) -> np.ndarray:
    """The first four characters of each name."""
    return np.frombuffer("".join(x[:4].ljust(4, fill) for x in names).encode("utf-32-le"), np.uint32).reshape(-1, 4)


def near_pairs(asked: list[str], known: list[str]) -> Iterator[tuple[str, str, float]]:
    """All pairs of similarity 0.92 or more, with it.

    Matched letters are common letters, and Jaro's last term is at most 1. So letters are
    counted first, for all pairs at once, then bounded by the leading characters that the
    pair has in common; few pairs are left to compare.
    """
    asked, known = sorted((x for x in asked if x), key=len), sorted((x for x in known if x), key=len)
    if not asked or not known:
        return
    a_len, k_len = np.array([len(x) for x in asked]), np.array([len(x) for x in known])
    a_lead, k_lead = leads(asked, "\0"), leads(known, "\1")
    of_asked, of_known = letter_counts(asked, known)
    of_known = np.ascontiguousarray(of_known.T)
    for n in np.unique(a_len):
        lo, hi = np.searchsorted(k_len, (MATCHED[4] - 1) * n - 1e-6), np.searchsorted(k_len, n / (MATCHED[4] - 1) + 1e-6, "right")
        if lo == hi:
            continue
        shares = 1 / n + 1 / k_len[lo:hi]
        need = np.ceil(MATCHED[4] / shares - 1e-6).astype(np.float32)
        first, end = np.searchsorted(a_len, n), np.searchsorted(a_len, n, "right")
        step = max(1, CELLS // int(hi - lo))
        for at in range(first, end, step):
            common = of_asked[at : min(at + step, end)] @ of_known[:, lo:hi]
            i, j = np.divmod(np.flatnonzero(common >= need), hi - lo)
            lead = np.cumprod(a_lead[at + i] == k_lead[lo + j], axis=1).sum(axis=1)
            ok = common[i, j] * shares[j] >= MATCHED[lead] - 1e-6
            for x, y in zip((at + i[ok]).tolist(), (lo + j[ok]).tolist(), strict=True):
                if (s := jaro_winkler(asked[x], known[y])) >= NEAR:
                    yield asked[x], known[y], s


def similar(asked: DataFrame, known: DataFrame) -> DataFrame:
    """(low, low_hit, confidence): pairs of similarity 0.92 or more of two written tables of distinct names, each block of `asked` with each of `known`."""
    n_asked, n_known = asked.count(), known.count()
    a, k = -(-n_asked // ASKED) or 1, max(-(-n_known // KNOWN), min(24, -(-n_known // 4096))) or 1

    def found(t: pa.Table) -> pa.Table:
        is_asked = t.column("is_asked").combine_chunks()
        rows = list(near_pairs(*(t.column("low").filter(x).to_pylist() for x in (is_asked, pc.invert(is_asked)))))
        return pa.table({c: pa.array([r[i] for r in rows], kind) for i, (c, kind) in enumerate((("low", pa.string()), ("low_hit", pa.string()), ("confidence", pa.float64())))})

    block = lambda c, n: F.pmod(F.xxhash64(c), F.lit(n))
    each = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    left = asked.withColumn("j", each(k)).select((block("low", a) * k + F.col("j")).alias("p"), F.lit(True).alias("is_asked"), "low")
    right = known.withColumn("i", each(a)).select((F.col("i") * k + block("low_hit", k)).alias("p"), F.lit(False).alias("is_asked"), F.col("low_hit").alias("low"))
    # The number of partitions is given, since few bytes are much work here and would be put into one task.
    return left.unionByName(right).repartition(min(3 * a * k, 2048), "p").groupBy("p").applyInArrow(found, "low string, low_hit string, confidence double")


def resolve(names: DataFrame, name: str, registry: DataFrame, entity: str, canonical: str) -> DataFrame:
    """(name, resolved, method, confidence): what each distinct name resolves to in the registry.

    The first tier that finds something wins: equal names (1.0), names of similarity 0.92 or
    more (their similarity), equal phonetic keys (0.85). Similarity is found for all pairs of
    a name without an equal one and a name of the registry. Names shorter than two
    characters resolve to nothing. Of equally good candidates the least name is taken.
    No table is sent to all tasks: the planner judges names by the size of their compressed
    files, and what they take in the driver has no bound.
    """
    merged = lambda x: x.hint("merge")
    asked = names.select(F.trim(name).alias("name")).filter(F.length("name") >= 2).distinct()
    known = registry.select(F.trim(canonical).alias("hit"), F.col(entity)).filter(F.length("hit") > 0).groupBy("hit").agg(F.min(entity).alias("entity"))
    known = materialise(known.select("hit", F.lower("hit").alias("low_hit")), "known")
    least = materialise(known.groupBy("low_hit").agg(F.min("hit").alias("hit")), "least")
    asked = materialise(asked.withColumn("low", F.lower("name")).join(merged(least.withColumnRenamed("low_hit", "low")), "low", "left").select("name", "low", "hit"), "asked")
    exact = asked.filter("hit is not null").select("name", F.col("hit").alias("resolved"), F.lit("exact").alias("method"), F.lit(1.0).alias("confidence"))
    open_ = asked.filter("hit is null").select("name", "low")
    best = Window.partitionBy("low").orderBy(F.desc("confidence"), "resolved")
    near = similar(open_.select("low").distinct(), least.select("low_hit")).join(merged(least), "low_hit").select("low", F.col("hit").alias("resolved"), "confidence")
    near = near.withColumn("r", F.row_number().over(best)).filter("r = 1").drop("r")
    near = materialise(open_.join(merged(near), "low", "left").select("name", "resolved", "confidence"), "near")
    sound = known.groupBy(phonetic_key(F.col("hit")).alias("k")).agg(F.min("hit").alias("resolved"))
    heard = near.filter("resolved is null").select("name", phonetic_key(F.col("name")).alias("k")).join(merged(sound), "k", "left")
    heard = heard.select("name", "resolved", F.when(F.col("resolved").isNull(), "none").otherwise("phonetic").alias("method"), F.when(F.col("resolved").isNull(), 0.0).otherwise(0.85).alias("confidence"))
    near = near.filter("resolved is not null").select("name", "resolved", F.lit("similar").alias("method"), "confidence")
    return exact.unionByName(near).unionByName(heard)
