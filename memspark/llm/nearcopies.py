"""Near-duplicate records with small edits: trie self-join on parity sketches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from memspark.operators.lineage import materialise, release
from memspark.operators.rows import clean_id

MAX_WORDS = 4_000_000  # repeated words whose counts (64 MB) are sent to tasks; of more, the counts are joined
HOT = 2048  # documents of a word above which its group is split by further words
SLICE = 8192  # rows of a group above which it is split into slices
BAND = 0.06  # lengths of one root differ by so much of their logarithm
LEAF_PAIRS = 4096  # node pairs with at most so many row pairs are walked on row by row
DENSE_PAIRS = 400  # from so many on as a block
STRIP = 65536  # row pairs looked at together
_GOLD = np.uint64(0x9E3779B97F4A7C15)
KEYS = "key long, big boolean, rid long, n int, err int, s0 long, s1 long, s2 long, s3 long"


def _mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, so that every bit of the result depends on all of `x`."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
        return x ^ (x >> np.uint64(33))


def _least_common(n: np.ndarray, share: float) -> np.ndarray:
    return np.ceil(n * share - 1e-9).astype(np.int64)


def _ordered_tokens(counts=None):
    """rid, class_id, h (word hashes), load (documents of each; looked up in `counts` if absent) -> rid, class_id, n, toks, seen.

    A word's repeats are tokens of their own (word, which repeat), so common words with
    repetition are common tokens. The order, (documents of the word, token), is the same in
    every document; `seen` is the first part of it.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            lists = b.column("h")
            offs = np.asarray(lists.offsets, dtype=np.int64)
            h = np.asarray(lists.flatten()).view(np.uint64)
            n = np.diff(offs)
            doc = np.repeat(np.arange(len(n)), n)
            if counts is None:
                load = np.asarray(b.column("load").flatten())
            else:
                words, docs = counts.value
                at = np.minimum(np.searchsorted(words, h.view(np.int64)), max(len(words) - 1, 0))
                load = np.where(words[at] == h.view(np.int64), docs[at], 1) if len(words) else np.ones(len(h), np.int64)
            o = np.lexsort((h, doc))
            h, load = h[o], load[o]
            fresh = np.r_[True, (h[1:] != h[:-1]) | (doc[1:] != doc[:-1])] if len(h) else np.zeros(0, bool)
            start = np.maximum.accumulate(np.where(fresh, np.arange(len(h)), 0)) if len(h) else np.zeros(0, np.int64)
            with np.errstate(over="ignore"):
                tok = _mix(h + (np.arange(len(h)) - start).astype(np.uint64) * _GOLD)
            o = np.lexsort((tok, load, doc))
            base = pa.array((offs - offs[0] if len(offs) else offs).astype(np.int32))
            yield pa.RecordBatch.from_arrays([b.column("rid"), b.column("class_id"), pa.array(n), pa.ListArray.from_arrays(base, pa.array(tok[o].view(np.int64))),
                                              pa.ListArray.from_arrays(base, pa.array(np.minimum(load[o], 1 << 30).astype(np.int32)))], names=["rid", "class_id", "n", "toks", "seen"])

    return run


def _prefix_keys(toks: np.ndarray, seen: np.ndarray, p: int, hot: int, docs: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, place of its last token, tokens in it) of one document: groups in which every partner is met.

    Two documents with enough tokens in common have k of them among the first p - 1 + k of
    each, p being n - least common + 1. Both have a key made of their first common token, or,
    if it is hot, of their first two, or three where two would still be found together in
    more than `hot` documents if words were independent. In that key's group all tokens that
    stand before its last one, but for those of the key, are not common.
    """
    cold = int(np.searchsorted(seen[:p], hot, "right"))
    lone = int(np.searchsorted(seen[:cold], 1, "right"))  # words of one document meet nobody
    keys, last, size = [toks[lone:cold]], [np.arange(lone, cold)], [np.ones(cold - lone, np.int64)]
    if cold < p:
        end = min(p + 1, len(toks))
        i, j = np.triu_indices(end - cold, 1)
        i, j = i + cold, j + cold
        with np.errstate(over="ignore"):
            two = _mix(toks[i] * np.uint64(3) + (toks[j] ^ _GOLD))
        many = seen[i].astype(np.float64) * seen[j] > float(hot) * docs
        keys.append(two[~many]), last.append(j[~many]), size.append(np.full(int((~many).sum()), 2))
        if many.any():
            end = min(p + 2, len(toks))
            rep = np.maximum(end - 1 - j[many], 0)
            at = np.repeat(np.flatnonzero(many), rep)
            k = j[at] + 1 + np.arange(len(at)) - np.repeat(np.cumsum(rep) - rep, rep)
            with np.errstate(over="ignore"):
                keys.append(_mix(two[at] * np.uint64(5) + (toks[k] ^ _GOLD)))
            last.append(k), size.append(np.full(len(k), 3))
    return np.concatenate(keys), np.concatenate(last), np.concatenate(size)


def _emit_keys(share: float, hot: int, slice_rows: int, docs: int, only_big: bool):
    """KEYS of every document; err: its tokens before the key's last one that the group's pairs don't share; s: parity sketch of those behind.

    A sketch has 256 bits and each token flips one, so two sketches differ in at most as many
    bits as tokens that only one of the documents has. `big`: even the key's rarest word is in
    more than `slice_rows` documents, else the group can't be larger.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                offs = np.asarray(b.column("toks").offsets, dtype=np.int64)
                offs = offs - offs[0]
                toks, seen = np.asarray(b.column("toks").flatten()).view(np.uint64), np.asarray(b.column("seen").flatten())
                n = np.diff(offs)
                p = n - _least_common(n, share) + 1
                bit = (toks >> np.uint64(20)) & np.uint64(255)
                upto = np.zeros((len(toks), 4), np.uint64)
                upto[np.arange(len(toks)), (bit >> np.uint64(6)).astype(np.int64)] = np.uint64(1) << (bit & np.uint64(63))
                upto = np.bitwise_xor.accumulate(upto, axis=0) if len(toks) else upto
                row, key, last, size = [], [], [], []
                for r in range(len(n)):
                    k, j, m = _prefix_keys(toks[offs[r] : offs[r + 1]], seen[offs[r] : offs[r + 1]], int(p[r]), hot, docs)
                    row.append(np.full(len(k), r)), key.append(k), last.append(j), size.append(m)
                row, key, last, size = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (row, key, last, size))
                # The rarest of a hot key's words is at least as frequent as the first hot one of the document.
                big = (size > 1) & (seen[offs[row] + np.maximum(last - size + 1, 0)] > slice_rows) if len(row) else np.zeros(0, bool)
                if only_big:
                    row, key, last, size, big = (x[big] for x in (row, key, last, size, big))
                sk = upto[offs[row] + last] ^ upto[offs[row + 1] - 1]
                yield pa.RecordBatch.from_arrays([
                    pa.array(key.astype(np.uint64).view(np.int64)), pa.array(big), pa.array(np.asarray(b.column("rid"))[row]), pa.array(n[row].astype(np.int32)), pa.array((last - size + 1).astype(np.int32)),
                    *[pa.array(np.ascontiguousarray(sk[:, i]).view(np.int64)) for i in range(4)]], names=["key", "big", "rid", "n", "err", "s0", "s1", "s2", "s3"])

    return run


def trie_join(key: np.ndarray, side: np.ndarray, n: np.ndarray, err: np.ndarray, sk: np.ndarray, share: float, told: dict[str, int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of the same key whose tokens differ within the pair's error budget, as far as sketches can tell.

    Budget: the tokens two records may not share, n1 + n2 - 2 ceil(share max(n1, n2)). Below
    each key stand binary tries, one for each range of lengths and of `err`, the differing
    tokens known before the first bit, over the sketch folded to 64 bits, so that bits are
    balanced. All tries are walked together, level by level: a pair of nodes carries the
    differences so far and splits into four (three for a node with itself); it is dropped
    once they exceed the greatest budget of a pair of its rows. Node pairs of few row pairs are walked on row by
    row, all other levels of the folded sketch at once and then the whole sketch, each
    against the pair's own budget. `told` counts row pairs: all, and those dropped at nodes
    and rows.
    """
    nobody = np.zeros(0, np.int64), np.zeros(0, np.int64)
    if len(key) < 2:
        return nobody
    fold = sk[:, 0] ^ sk[:, 1] ^ sk[:, 2] ^ sk[:, 3]
    band = np.floor(np.log(np.maximum(n, 1)) / BAND).astype(np.int64)
    o = np.lexsort((fold, err >> 1, band, key))
    key, side, n, err, sk, fold, band = key[o], side[o], n[o].astype(np.int64), err[o].astype(np.int64), sk[o], fold[o], band[o]
    need = _least_common(n, share)
    cuts = np.flatnonzero(np.r_[True, key[1:] != key[:-1], True])
    lo, hi = cuts[:-1], cuts[1:]
    rows = hi - lo
    every = int((rows * (rows - 1) // 2).sum())
    leaves: list[tuple[np.ndarray, ...]] = []  # first and last row of both nodes, whether they are the same
    few = (rows > 1) & (rows * (rows - 1) // 2 <= LEAF_PAIRS)
    leaves.append((lo[few], hi[few], lo[few], hi[few], np.ones(few.sum(), bool)))
    # Roots: the rows of one key, of about one length and err. Every two of a key are a node pair to begin with.
    cuts = np.flatnonzero(np.r_[True, (key[1:] != key[:-1]) | (band[1:] != band[:-1]) | (err[1:] >> 1 != err[:-1] >> 1), True])
    kept = np.repeat(rows * (rows - 1) // 2 > LEAF_PAIRS, rows)[cuts[:-1]]
    if kept.any():
        short, long_, known = (f.reduceat(v, cuts[:-1])[kept] for f, v in ((np.minimum, n), (np.maximum, n), (np.minimum, err)))
        root, stop = cuts[:-1][kept], cuts[1:][kept]
        group = np.cumsum(np.r_[0, key[root[1:]] != key[root[:-1]]])
        per = np.bincount(group)
        behind = np.repeat(np.cumsum(per), per) - np.arange(len(root))  # roots of the key from this one on
        x = np.repeat(np.arange(len(root)), behind)
        y = x + np.arange(len(x)) - np.repeat(np.cumsum(behind) - behind, behind)
        # Roots are in order of length. The budget falls with the longer record's length and rises with the other's.
        longer = np.maximum(short[y], np.minimum(long_[x], long_[y]))
        bud = np.minimum(long_[x], longer) + longer - 2 * _least_common(longer, share) + 1
        a0, a1, b0, b1, twin, bits = root[x], stop[x], root[y], stop[y], x == y, known[x] + known[y]
        bud = np.where(long_[x] >= _least_common(short[y], share), bud, -1)
        ok = bits <= bud
        a0, a1, b0, b1, twin, bits, bud = (v[ok] for v in (a0, a1, b0, b1, twin, bits, bud))
        for level in range(65):
            small = ((a1 - a0) * (b1 - b0) <= LEAF_PAIRS) | (level == 64)
            leaves.append((a0[small], a1[small], b0[small], b1[small], twin[small]))
            a0, a1, b0, b1, twin, bits, bud = (v[~small] for v in (a0, a1, b0, b1, twin, bits, bud))
            if not len(a0):
                break
            ones = np.r_[0, np.cumsum((fold >> np.uint64(63 - level)) & np.uint64(1))].astype(np.int64)
            am, bm = a1 - (ones[a1] - ones[a0]), b1 - (ones[b1] - ones[b0])
            parts = [(a0, am, b0, bm, twin, bits, bud), (am, a1, bm, b1, twin, bits, bud), (a0, am, bm, b1, twin & False, bits + 1, bud), tuple(v[~twin] for v in (am, a1, b0, bm, twin, bits + 1, bud))]
            a0, a1, b0, b1, twin, bits, bud = (np.concatenate([q[i] for q in parts]) for i in range(7))
            ok = (a0 < a1) & (b0 < b1) & (bits <= bud) & ~(twin & (a1 - a0 < 2))
            a0, a1, b0, b1, twin, bits, bud = (v[ok] for v in (a0, a1, b0, b1, twin, bits, bud))
    a0, a1, b0, b1, twin = (np.concatenate([x[i] for x in leaves]) for i in range(5))
    size = (a1 - a0) * (b1 - b0)
    wide = np.flatnonzero(size > STRIP)
    if len(wide):  # nodes of many equal sketches: in strips of rows
        cut = [(s, min(s + max(1, STRIP // int(b1[w] - b0[w])), int(a1[w])), b0[w], b1[w], twin[w]) for w in wide.tolist() for s in range(int(a0[w]), int(a1[w]), max(1, STRIP // int(b1[w] - b0[w])))]
        rest = np.delete(np.arange(len(size)), wide)
        a0, a1, b0, b1, twin = (np.concatenate([v[rest], np.array([c[i] for c in cut], v.dtype)]) for i, v in enumerate((a0, a1, b0, b1, twin)))
        size = (a1 - a0) * (b1 - b0)
    got_i, got_j, looked, folded = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], 0, 0

    def walk_on(i: np.ndarray, j: np.ndarray) -> None:
        """Row pairs whose folded sketches are within their budget: the whole sketch, 64 bits at a time."""
        nonlocal folded
        folded += len(i)
        longer = np.maximum(need[i], need[j])
        ok = (np.minimum(n[i], n[j]) >= longer) & ((side[i] == 2) | (side[i] != side[j]))
        i, j, longer = i[ok], j[ok], longer[ok]
        budget = n[i] + n[j] - 2 * longer - err[i] - err[j]
        diff = np.zeros(len(i), np.int64)
        for w in range(4):
            diff += np.bitwise_count(sk[i, w] ^ sk[j, w])
            ok = diff <= budget
            i, j, diff, budget = i[ok], j[ok], diff[ok], budget[ok]
        got_i.append(o[i]), got_j.append(o[j])

    room, least = (n - err).astype(np.int32), (2 * need).astype(np.int32)
    dense = size >= DENSE_PAIRS
    for x0, x1, y0, y1, t in zip(*(v[dense].tolist() for v in (a0, a1, b0, b1, twin)), strict=True):
        budget = room[x0:x1, None] + room[None, y0:y1]
        budget -= np.maximum(least[x0:x1, None], least[None, y0:y1])
        i, j = np.nonzero(np.bitwise_count(fold[x0:x1, None] ^ fold[None, y0:y1]) <= budget)
        i, j = i + x0, j + y0
        looked += int((np.arange(x0, x1)[:, None] < np.arange(y0, y1)[None, :]).sum()) if t else (x1 - x0) * (y1 - y0)
        walk_on(*((i[i < j], j[i < j]) if t else (i, j)))
    a0, a1, b0, b1, twin, size = (v[~dense] for v in (a0, a1, b0, b1, twin, size))
    ends, at = np.cumsum(size), 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + 16 * STRIP)))
        s, w = size[at:to], (b1 - b0)[at:to]
        within = np.arange(s.sum()) - np.repeat(np.cumsum(s) - s, s)
        across = np.repeat(w, s)
        i, j = np.repeat(a0[at:to], s) + within // across, np.repeat(b0[at:to], s) + within % across
        at, ok = to, ~np.repeat(twin[at:to], s) | (i < j)
        i, j = i[ok], j[ok]
        looked += len(i)
        ok = np.bitwise_count(fold[i] ^ fold[j]) <= room[i] + room[j] - np.maximum(least[i], least[j])
        walk_on(i[ok], j[ok])
    if told is not None:
        for k, v in (("pairs", every), ("at_nodes", every - looked), ("at_rows", looked - folded), ("left", sum(map(len, got_i)))):
            told[k] = told.get(k, 0) + v
    return np.concatenate(got_i), np.concatenate(got_j)


def _join_groups(share: float, rows: int = 60_000):
    """Candidate pairs of partitions sorted by key; a group may run over several batches."""

    def pairs(b: pa.Table) -> pa.RecordBatch:
        col = lambda c: np.asarray(b.column(c).combine_chunks() if b.column(c).num_chunks != 1 else b.column(c).chunk(0))
        rid = col("rid")
        sk = np.stack([col(f"s{i}").view(np.uint64) for i in range(4)], axis=1)
        i, j = trie_join(col("key"), col("side"), col("n"), col("err"), sk, share)
        x, y = np.minimum(rid[i], rid[j]), np.maximum(rid[i], rid[j])
        differ = x != y
        both = np.unique(np.stack([x[differ], y[differ]], axis=1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(both[:, 0]), pa.array(both[:, 1])], names=["ra", "rb"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        count = 0
        for b in batches:
            if b.num_rows:
                held.append(b)
                count += b.num_rows
            if count >= rows:
                t = pa.Table.from_batches(held)
                key = t.column("key").to_numpy()
                cut = int(np.searchsorted(key, key[-1]))
                if cut:
                    yield pairs(t.slice(0, cut))
                held = t.slice(cut).to_batches()
                count = sum(x.num_rows for x in held)
        if held:
            yield pairs(pa.Table.from_batches(held))

    return run


def word_hashes(text: str):
    """Sorted 64-bit hashes of the text's words (runs of letters and digits, lower case), with repeats."""
    return F.array_sort(F.transform(F.regexp_extract_all(F.lower(text), F.lit("([\\p{L}\\p{N}]+)"), F.lit(1)), lambda w: F.xxhash64(w)))


def ordered_tokens(bags: DataFrame) -> DataFrame:
    """(rid, class_id, n, toks, seen) of `bags`: tokens from the rarest word on.

    The counts of words of several documents are sent to tasks if there are no more than
    MAX_WORDS of them; else the bags' words are joined with them, hot words on the left of
    one row per word.
    """
    spark = bags.sparkSession
    words = materialise(bags.select(F.explode(F.array_distinct("h")).alias("w")).groupBy("w").count().filter("count > 1"), "words")
    schema = "rid long, class_id string, n long, toks array<long>, seen array<int>"
    if words.count() <= MAX_WORDS:
        t = words.toArrow()
        w, c = t.column("w").to_numpy(), t.column("count").to_numpy()
        o = np.argsort(w)
        return bags.select("rid", "class_id", "h").mapInArrow(_ordered_tokens(spark.sparkContext.broadcast((w[o], c[o]))), schema)
    each = bags.select("rid", "class_id", F.explode("h").alias("w")).join(words, "w", "left")
    back = each.groupBy("rid").agg(F.min("class_id").alias("class_id"), F.collect_list(F.struct("w", F.coalesce("count", F.lit(1)).alias("c"))).alias("x"))
    return back.select("rid", "class_id", F.col("x.w").alias("h"), F.col("x.c").alias("load")).mapInArrow(_ordered_tokens(), schema)


def grouped_keys(toks: DataFrame, share: float) -> DataFrame:
    """The rows of all groups, with `side` (0: joins within its group and with 1; 1: only with 0; 2: within).

    Groups of more than SLICE rows, counted, are cut into slices, every two of which are a
    group of their own. Only keys all of whose words are in more than SLICE documents can have
    so many rows, so only these are counted.
    """
    docs = toks.count()
    keys = toks.select("rid", "n", "toks", "seen")
    emit = lambda t, only: t.mapInArrow(_emit_keys(share, HOT, SLICE, docs, only), KEYS)
    frequent = keys.filter(F.exists(F.slice("seen", 1, (F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 3).cast("int")), lambda c: c > SLICE))
    big = materialise(emit(frequent, True).groupBy("key").count().filter(F.col("count") > SLICE).select("key", F.ceil(F.col("count") / SLICE).cast("int").alias("parts")), "big")
    rows = emit(keys, False).drop("big")
    if big.isEmpty():
        return rows.withColumn("side", F.lit(2))
    cut = rows.join(big, "key", "left").withColumn("own", F.pmod("rid", "parts").cast("int"))
    cut = cut.withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(-1))).otherwise(F.sequence(F.lit(0), F.col("parts") - 1))))
    lo, hi = F.least("own", "other"), F.greatest("own", "other")
    key = F.when(F.col("parts").isNull(), F.col("key")).otherwise(F.xxhash64("key", lo, hi))
    side = F.when(F.col("parts").isNull() | (F.col("own") == F.col("other")), 2).when(F.col("own") == lo, 0).otherwise(1)
    return cut.withColumn("side", side).withColumn("key", key).drop("parts", "own", "other")


def near_copies(df: DataFrame, id_col: str, text_col: str, share: float = 0.8, least_words: int = 24) -> tuple[DataFrame, DataFrame]:
    """(classes, pairs) of texts with at least `least_words` words.

    classes: one row per id: id, class_id, the least id with the same words (order aside).
    pairs: class_a < class_b whose common words, with repetition and in any order, are at
    least `share` of the words of the longer one, with `common`, their number. Null and
    shorter texts are in neither; rows with the same id are one (the least text); an empty
    table gives two empty ones; other columns are ignored. No pair is lost: grouping by
    rare words and the sketches' error budget are necessary conditions, and words are
    compared exactly at the end.

    Hot words' groups are split by further words and then into slices, so the group a task
    joins is bounded; copies are one class before anything is joined. How hot a word or a
    group is comes from counts of all rows.
    """
    spark = df.sparkSession
    rows = df.select(clean_id(id_col).alias("id"), F.col(text_col).alias("text")).filter("id is not null and text is not null").groupBy("id").agg(F.min("text").alias("text"))
    rows = rows.select("id", word_hashes("text").alias("h")).filter(F.size("h") >= least_words)
    bag = ["b0", "b1"]  # 128 bits of the sorted words
    rows = materialise(rows.select("id", F.xxhash64("h").alias("b0"), F.xxhash64(F.lit(1), "h").alias("b1"), "h"), "bags")
    bags = rows.groupBy(*bag).agg(F.min("id").alias("class_id"), F.first("h").alias("h")).withColumn("rid", F.monotonically_increasing_id())
    bags = materialise(bags, "classes")
    toks = materialise(ordered_tokens(bags), "tokens")
    classes = materialise(rows.join(bags.select(*bag, "class_id"), bag).select("id", "class_id"), "members")
    release(rows), release(bags)
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    pairs = grouped_keys(toks, share).repartition(n, "key").sortWithinPartitions("key").mapInArrow(_join_groups(share), "ra long, rb long").distinct()
    side = lambda r, c: toks.select(F.col("rid").alias(r), F.col("toks").alias(f"t{r}"), F.col("n").alias(f"n{r}"), F.col("class_id").alias(c))
    both = pairs.join(side("ra", "ca"), "ra").join(side("rb", "cb"), "rb").withColumn("common", F.size(F.array_intersect("tra", "trb")))
    both = both.filter(F.col("common") >= F.ceil(F.greatest("nra", "nrb") * share - 1e-9))
    pairs = materialise(both.select(F.least("ca", "cb").alias("class_a"), F.greatest("ca", "cb").alias("class_b"), "common"), "pairs")
    return classes, pairs


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, group_id): connected components of undirected edges, named by their least node.

    Stars by turns: every node links its greater neighbours to its least one, then its
    lesser ones; the edges shrink to one star per component in about log(n) rounds.
    """
    e = materialise(edges.select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).filter("u <> v").distinct(), "edges")
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(low.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        new = materialise(small, "edges")
        moved = new.exceptAll(e).isEmpty() and e.exceptAll(new).isEmpty()
        e = new
        if moved:
            break
    star = e.groupBy("u").agg(F.min("v").alias("group_id")).select(F.col("u").alias("node"), "group_id")
    return star.unionByName(star.select(F.col("group_id").alias("node"), "group_id").distinct())
