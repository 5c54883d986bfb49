"""Evaluation texts inside training text: an FM-index per shard, searched backward."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_WORD = re.compile(r"[^\W_]+")
SEED = 6  # a stretch of 20 words with 2 of them changed has 6 unchanged ones in a row
LEAST = 20
SHARD_WORDS = 1_000_000
SAMPLE_EVERY = 16
MAX_PROBE_WORDS = 20_000_000


class FMIndex:
    """FM-index of a sequence of codes >= 1, with a wavelet matrix over its Burrows-Wheeler transform."""

    def __init__(self, seq: np.ndarray):
        s = np.r_[seq.astype(np.int64), 0]
        n = len(s)
        rank = np.unique(s, return_inverse=True)[1].astype(np.int64)
        step = 1
        while True:  # prefix doubling: ranks by 1, 2, 4, ... codes until all suffixes differ
            later = np.r_[rank[step:] + 1, np.zeros(min(step, n), np.int64)][:n]
            key = rank * (n + 1) + later
            sa = np.argsort(key, kind="stable")
            fresh = np.r_[0, np.cumsum(key[sa][1:] != key[sa][:-1])]
            rank = np.empty(n, np.int64)
            rank[sa] = fresh
            if fresh[-1] == n - 1:
                break
            step *= 2
        bwt = s[sa - 1]
        self.n, self.codes = n, int(s.max()) + 1
        self.first = np.r_[0, np.cumsum(np.bincount(s, minlength=self.codes))]
        self.bits = max(1, int(self.codes - 1).bit_length())
        self.ones, self.zeros, cur = [], [], bwt
        for level in range(self.bits - 1, -1, -1):
            bit = (cur >> level) & 1
            self.ones.append(np.r_[0, np.cumsum(bit)].astype(np.int32))
            self.zeros.append(n - int(self.ones[-1][-1]))
            cur = np.r_[cur[bit == 0], cur[bit == 1]]
        start = np.zeros(self.codes, np.int64)
        self.start = self._down(np.arange(self.codes), start)
        self.bwt = bwt
        kept = sa % SAMPLE_EVERY == 0
        self.kept = np.r_[0, np.cumsum(kept)]
        self.samples = sa[kept]

    def _down(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        for i, level in enumerate(range(self.bits - 1, -1, -1)):
            r = self.ones[i][at]
            at = np.where((code >> level) & 1, self.zeros[i] + r, at - r)
        return at

    def rank(self, code: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Occurrences of `code` before `at` in the transform, read off the wavelet matrix."""
        return self._down(code, at) - self.start[code]

    def search(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Suffix ranges [lo, hi) of phrases (rows of codes), all searched backward together."""
        lo, hi = np.zeros(len(phrases), np.int64), np.full(len(phrases), self.n, np.int64)
        live = np.flatnonzero((phrases < self.codes).all(1))
        dead = np.ones(len(phrases), bool)
        dead[live] = False
        for k in range(phrases.shape[1] - 1, -1, -1):
            c = phrases[live, k]
            lo[live], hi[live] = self.first[c] + self.rank(c, lo[live]), self.first[c] + self.rank(c, hi[live])
            gone = lo[live] >= hi[live]
            dead[live[gone]] = True
            live = live[~gone]
        lo[dead] = hi[dead] = 0
        return lo, hi

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Text positions of suffix rows, by walking to the next sampled position."""
        out, walk, at, todo = np.zeros(len(rows), np.int64), np.zeros(len(rows), np.int64), rows.copy(), np.arange(len(rows))
        while len(todo):
            r = at[todo]
            there = self.kept[r + 1] > self.kept[r]
            done = todo[there]
            out[done] = self.samples[self.kept[at[done]]] + walk[done]
            todo = todo[~there]
            c = self.bwt[at[todo]]
            at[todo] = self.first[c] + self.rank(c, at[todo])
            walk[todo] += 1
        return out


@dataclass(frozen=True)
class Probes:
    """The held-out items as codes, and their phrases of SEED words."""

    ids: np.ndarray
    words: dict[str, int]
    codes: np.ndarray
    bounds: np.ndarray
    phrases: np.ndarray
    phrase_of: np.ndarray  # phrase of each place, ordered by phrase
    place: np.ndarray
    pairs: np.ndarray  # sorted codes of neighbouring words

    @staticmethod
    def of(items: list[tuple[int, str]]) -> Probes:
        words: dict[str, int] = {}
        codes, bounds, ids, places = [], [0], [], []
        for item, text in items:
            ws = _WORD.findall((text or "").lower())
            if len(ws) < LEAST:
                continue
            ids.append(item)
            places.append(np.arange(len(ws) - SEED + 1) + bounds[-1])
            codes += [words.setdefault(w, len(words) + 2) for w in ws]
            bounds.append(len(codes))
        c = np.array(codes, np.int64)
        place = np.concatenate(places) if places else np.zeros(0, np.int64)
        grams = c[place[:, None] + np.arange(SEED)[None, :]] if len(place) else np.zeros((0, SEED), np.int64)
        phrases, of = np.unique(grams, axis=0, return_inverse=True) if len(grams) else (grams, np.zeros(0, np.int64))
        o = np.argsort(of, kind="stable")
        inner = np.setdiff1d(np.arange(1, len(c)), np.array(bounds)) if len(c) else np.zeros(0, np.int64)
        return Probes(np.array(ids), words, c, np.array(bounds), phrases, of[o], place[o], np.unique(c[inner - 1] << 32 | c[inner]))


def _reach(w: np.ndarray, q: np.ndarray, t: np.ndarray, p: np.ndarray, t_room: np.ndarray, p_room: np.ndarray, sign: int, edits: int) -> tuple[np.ndarray, np.ndarray]:
    """Furthest item words reached from (t, p) with 0..edits edits in direction `sign`, and the document words they cover.

    Per number of edits the furthest place on each diagonal is kept; a word changed, added
    or left out costs one, equal words nothing.
    """
    a, far = len(t), -(1 << 30)
    best, cover = np.zeros((a, edits + 1), np.int64), np.zeros((a, edits + 1), np.int64)
    prev = np.full((a, 2 * edits + 3), far, np.int64)
    mid = edits + 1
    prev[:, mid] = 0
    for e in range(1, edits + 1):
        cur = np.full_like(prev, far)
        for d in range(-e, e + 1):
            x = np.maximum(np.maximum(prev[:, mid + d] + 1, prev[:, mid + d - 1]), prev[:, mid + d + 1] + 1)
            x = np.where((x < 0) | (x > p_room) | (x + d < 0) | (x + d > t_room), far, x)
            run = np.flatnonzero(x >= 0)
            while len(run):
                y = x[run]
                run = run[(y < p_room[run]) & (y + d < t_room[run])]
                y = x[run]
                run = run[w[t[run] + sign * (y + d)] == q[p[run] + sign * y]]
                x[run] += 1
            cur[:, mid + d] = x
        top = cur.argmax(1)
        reach = cur[np.arange(a), top]
        further = reach > best[:, e - 1]
        best[:, e] = np.where(further, reach, best[:, e - 1])
        cover[:, e] = np.where(further, reach + top - mid, cover[:, e - 1])
        prev = cur
    return best, cover


def find_passages(w: np.ndarray, doc_bounds: np.ndarray, probes: Probes) -> tuple[np.ndarray, ...]:
    """(document, item, first word, word after the last) of every passage in documents given as codes (0: word of no item)."""
    nothing = tuple(np.zeros(0, np.int64) for _ in range(4))
    if len(w) < SEED or not len(probes.phrases):
        return nothing
    # Only runs of SEED or more words whose neighbouring pairs all occur in items can hold a
    # phrase; everything else is one separator (code 1) in the indexed sequence.
    pair = w[:-1] << 32 | w[1:]
    at = np.minimum(np.searchsorted(probes.pairs, pair), len(probes.pairs) - 1)
    linked = (probes.pairs[at] == pair) & (w[:-1] > 0)
    linked[doc_bounds[1:-1][(doc_bounds[1:-1] > 0) & (doc_bounds[1:-1] < len(w))] - 1] = False
    edge = np.flatnonzero(np.diff(np.r_[0, linked.astype(np.int8), 0]))
    start, end = edge[::2], edge[1::2] + 1
    long = end - start >= SEED
    start, size = start[long], (end - start)[long]
    if not len(start):
        return nothing
    head = np.cumsum(size + 1) - size - 1
    run_of = np.repeat(np.arange(len(size)), size)
    inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
    seq, back = np.ones(int((size + 1).sum()), np.int64), np.zeros(int((size + 1).sum()), np.int64)
    seq[head[run_of] + inside], back[head[run_of] + inside] = w[start[run_of] + inside], start[run_of] + inside
    index = FMIndex(seq)
    lo, hi = index.search(probes.phrases)
    n = hi - lo
    found = np.repeat(np.arange(len(n)), n)
    pos = back[index.locate(np.repeat(lo, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n))]
    first, last = np.searchsorted(probes.phrase_of, found), np.searchsorted(probes.phrase_of, found, "right")
    rep = np.repeat(np.arange(len(found)), last - first)
    place = probes.place[np.repeat(first, last - first) + np.arange(len(rep)) - np.repeat(np.cumsum(last - first) - (last - first), last - first)]
    t = pos[rep]
    if not len(t):
        return nothing
    doc, item = np.searchsorted(doc_bounds, t, "right") - 1, np.searchsorted(probes.bounds, place, "right") - 1
    o = np.lexsort((t, t - place, item, doc))
    t, place, doc, item = t[o], place[o], doc[o], item[o]
    fresh = np.r_[True, (np.diff(t) != 1) | (np.diff(place) != 1) | (np.diff(doc) != 0) | (np.diff(item) != 0)]
    at = np.flatnonzero(fresh)
    run = np.diff(np.r_[at, len(t)]) + SEED - 1
    t, place, doc, item = t[at], place[at], doc[at], item[at]
    group = np.cumsum(np.r_[True, (np.diff(doc) != 0) | (np.diff(item) != 0)]) - 1
    sure = np.bincount(group[run >= LEAST], minlength=group[-1] + 1)[group] > 0
    many = np.bincount(group)[group] > 1
    longest = int(np.diff(probes.bounds).max())
    got = [np.zeros((0, 4), np.int64)]
    # With five edits or more, a passage whose runs are all shorter than LEAST has two runs of
    # SEED words, so a pair with one run needs no look at more than four edits.
    for edits, part in ((4, ~sure & ~many), (max(4, longest // 10), sure | many)):
        part = np.flatnonzero(part)
        if not len(part):
            continue
        tt, pp, rr, dd, ii = t[part], place[part], run[part], doc[part], item[part]
        right, r_cover = _reach(w, probes.codes, tt + rr, pp + rr, doc_bounds[dd + 1] - tt - rr, probes.bounds[ii + 1] - pp - rr, 1, edits)
        left, l_cover = _reach(w, probes.codes, tt - 1, pp - 1, tt - doc_bounds[dd], pp - probes.bounds[ii], -1, edits)
        best, span = np.zeros(len(part), np.int64), np.stack([tt, tt + rr], axis=1)
        for x in range(edits + 1):
            for y in range(edits + 1 - x):
                length = rr + left[:, x] + right[:, y]
                good = (length >= max(LEAST, 10 * (x + y))) & (length > best)
                best = np.where(good, length, best)
                span = np.where(good[:, None], np.stack([tt - l_cover[:, x], tt + rr + r_cover[:, y]], axis=1), span)
        hit = best > 0
        got.append(np.stack([dd[hit], ii[hit], span[hit, 0] - doc_bounds[dd[hit]], span[hit, 1] - doc_bounds[dd[hit]]], axis=1))
    got = np.concatenate(got)
    return tuple(got[:, i] for i in range(4))


def merge_spans(rows: np.ndarray) -> np.ndarray:
    """Rows (document, item, from, to), those of the same document and item that touch made one."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))]
    out: list[list[int]] = []
    for d, i, a, b in rows.tolist():
        if out and out[-1][0] == d and out[-1][1] == i and a <= out[-1][3]:
            out[-1][3] = max(out[-1][3], b)
        else:
            out.append([d, i, a, b])
    return np.array(out, np.int64).reshape(-1, 4)


def word_places(text: str) -> np.ndarray:
    """(first character, character behind the last) of every word of a text, also where lower case has other lengths."""
    low = text.lower()
    at = np.array([m.span() for m in _WORD.finditer(low)], np.int64).reshape(-1, 2)
    if len(low) == len(text) or not len(at):
        return at
    made = np.repeat(np.arange(len(text)), [len(c.lower()) for c in text])  # which character each one of `low` comes from
    return np.stack([made[at[:, 0]], made[at[:, 1] - 1] + 1], axis=1)


def removal_spans(rows: np.ndarray) -> np.ndarray:
    """Rows (document, from, to, items) from rows (document, item, from, to): spans of a document that touch, of whatever items, made one."""
    out: list[list] = []
    for d, i, a, b in rows[np.lexsort((rows[:, 2], rows[:, 0]))].tolist():
        if out and out[-1][0] == d and a <= out[-1][2]:
            out[-1][2] = max(out[-1][2], b)
            out[-1][3].add(i)
        else:
            out.append([d, a, b, {i}])
    return np.array([[d, a, b, len(items)] for d, a, b, items in out], np.int64).reshape(-1, 4)


def _search_shards(probes: Probes, by_item: bool):
    def shard(ids: list[int], words: list[list[int]], texts: list[str]) -> pa.RecordBatch:
        bounds = np.r_[0, np.cumsum([len(x) for x in words])].astype(np.int64)
        w = np.concatenate([np.array(x, np.int64) for x in words]) if words else np.zeros(0, np.int64)
        rows = merge_spans(np.stack(find_passages(w, bounds, probes), axis=1))
        extra = rows[:, 1]
        if not by_item:
            merged = removal_spans(rows)
            rows, extra = np.stack([merged[:, 0], merged[:, 0], merged[:, 1], merged[:, 2]], axis=1), merged[:, 3]
        else:
            extra = probes.ids[extra] if len(rows) else np.zeros(0, np.int64)
        places = {d: word_places(texts[d]) for d in np.unique(rows[:, 0]).tolist()}
        first = np.array([places[d][a, 0] for d, a in zip(rows[:, 0].tolist(), rows[:, 2].tolist(), strict=True)], np.int64)
        last = np.array([places[d][b - 1, 1] for d, b in zip(rows[:, 0].tolist(), rows[:, 3].tolist(), strict=True)], np.int64)
        return pa.RecordBatch.from_arrays([pa.array(np.array(ids, np.int64)[rows[:, 0]]), pa.array(extra), pa.array(rows[:, 2]), pa.array(rows[:, 3]), pa.array(first), pa.array(last)],
                                          names=["doc_id", "item_id" if by_item else "n_items", "from_word", "to_word", "from_char", "to_char"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        get = probes.words.get
        ids: list[int] = []
        words: list[list[int]] = []
        texts: list[str] = []
        count = 0
        for b in batches:
            for i, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                x = [get(v, 0) for v in _WORD.findall(text.lower())]
                ids.append(i), words.append(x), texts.append(text)
                count += len(x)
                if count >= SHARD_WORDS:
                    yield shard(ids, words, texts)
                    ids, words, texts, count = [], [], [], 0
        if ids:
            yield shard(ids, words, texts)

    return run


def leaked_passages(docs: DataFrame, doc_id: str, text: str, items: DataFrame, item_id: str, item_text: str, by_item: bool = True) -> DataFrame:
    """(doc_id, item_id, from_word, to_word, from_char, to_char): passages of held-out items inside documents.

    A passage is a stretch of at least 20 consecutive words of the item (lower case runs of
    letters and digits) of which the document holds a copy with at most one word in ten
    changed, added or left out; overlapping passages of one item are one span, told
    in words and in characters of the text as it is stored (the last one aside). Without
    `by_item` the spans of all items are merged, to cut them out: n_items in place of item_id.
    Null texts, ids and items give no row; shorter items can't leak; a document is searched
    as a whole, however long, and rows with the same id are separate documents; empty
    tables give an empty result; other columns are ignored.

    Each task cuts its documents into shards of about SHARD_WORDS words, builds an FM-index
    of each (of the runs of words whose neighbouring pairs occur in items: others can't hold a
    phrase, and stand in the index as separators), searches all phrases of SEED words backward and looks at what stands around
    the hits. No shuffle; only the items, of a checked number of words, are sent to tasks.
    """
    total = items.agg(F.sum(F.length(item_text))).first()[0] or 0
    if total > 8 * MAX_PROBE_WORDS:
        raise ValueError("too many held-out items for one pass: search them in blocks")
    rows = items.select(F.col(item_id).cast("long"), item_text).filter(F.col(item_id).isNotNull() & F.col(item_text).isNotNull()).distinct().collect()
    probes = Probes.of(sorted((r[0], r[1]) for r in rows))
    texts = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    return texts.mapInArrow(_search_shards(probes, by_item), f"doc_id long, {'item_id' if by_item else 'n_items'} long, from_word long, to_word long, from_char long, to_char long")
