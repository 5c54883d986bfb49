"""Text cut off by field limits: censored lengths per source combined with ending evidence."""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators.lineage import materialise, release

CELL_BITS = 44  # of a count's key, below the number of its table
ORDERS = (1, 2, 3, 4)
FLUSH_TOKENS = 1_500_000
SPIKE = 5.0  # a length is a candidate limit if so many times as frequent as those around it
LEAST_AT_LIMIT = 8
# Marks that are set behind a cut.
MARKS = re.compile(r"(?:\s*(?:\[(?:truncated|\.\.\.|…|more|cut)\]|\((?:more|truncated|cut|continued)\)|<(?:truncated|more)>|�+))+\s*$", re.I)
_DOTS = re.compile(r"\s*(?:…|\.\.\.)\s*$")
_TOKEN = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*|\d+|\n\s*|[^\w\s]|_")
_STOPS = frozenset(".!?")
_ENTRY = re.compile(r"[-*•] ")  # a list entry
_M = np.uint64(0x9E3779B97F4A7C15)
_NONE, _LINE, _TEXT = np.uint64(7), np.uint64(11), np.uint64(13)
TABLES = {"word": 0, "dots": 1, "named": 2, "shaped": 3, "head": 4, "place": 5, "spot": 6} | {k: 6 + k for k in ORDERS}
ASKED = (*ORDERS, "head", "shaped", "named", "word", "dots", "spot", "place")  # the counts an ending is judged by


def source_name(c: Column) -> Column:
    """Source names brought to one spelling: lower case, blanks and hyphens as '_'; null is ''."""
    return F.coalesce(F.regexp_replace(F.lower(F.trim(c)), "[-\\s]+", "_"), F.lit(""))


def _hash(s: str) -> int:
    h = 1469598103934665603
    for x in s.encode():
        h = ((h ^ x) * 1099511628211) & 0xFFFFFFFFFFFFFFFF
    return h


def _kind(token: str) -> str:
    """What a token counts as in a context: numbers and capitalised words are classes."""
    return "0" if token[0].isdigit() else "N" if token[0].isupper() else token


def _mix_in(*hs: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = np.asarray(hs[0], np.uint64) * _M
        for h in hs[1:]:
            x = (x ^ (x >> np.uint64(29)) ^ h) * _M
        return x ^ (x >> np.uint64(32))


def _cell(*hs: np.ndarray) -> np.ndarray:
    return (_mix_in(*hs) >> np.uint64(64 - CELL_BITS)).astype(np.int64)


class Counts:
    """(n, hit) of the asked cells of each text, a row per text and a column per table of ASKED; what has no count has 0."""

    def __init__(self, rows: int, row: np.ndarray, pos: np.ndarray, n: np.ndarray, hit: np.ndarray) -> None:
        self.n, self.hit = (np.zeros((rows, len(ASKED)), np.int64) for _ in range(2))
        self.n[row, pos], self.hit[row, pos] = n, hit

    def of(self, table: int | str) -> tuple[np.ndarray, np.ndarray]:
        at = ASKED.index(table)
        return self.n[:, at], self.hit[:, at]


def without_mark(text: str) -> tuple[str, bool]:
    """(text without a mark of a cut at its very end, whether there was one)."""
    at = max(0, len(text) - 200)  # no mark is longer
    m = MARKS.search(text, at)
    return (text[: m.start()], True) if m else (text, False)


def ending_of(text: str) -> tuple[str, str]:
    """(text without the marks and line ends set behind it, mark: '', 'cut' or 'dots')."""
    t = text.replace("\r\n", "\n").replace("\r", "\n") if "\r" in text else text
    t, marked = without_mark(t.rstrip(" \t\n\u00a0\u200b"))
    if marked:
        return t.rstrip(), "cut"
    m = _DOTS.search(t, max(0, len(t) - 100)) if t[-1:] in ("…", ".") else None
    return (t[: m.start()], "dots") if m else (t, "")


def is_markup(t: str) -> bool:
    return t[:1] in ("{", "[") and '"' in t


class Tokens:
    """Hashes and flags of a token sequence of one or more texts."""

    def __init__(self, toks: list[str]) -> None:
        d = pa.array(toks).dictionary_encode()
        names, code = d.dictionary.to_pylist(), np.asarray(d.indices)
        flag = lambda f: np.array([f(x) for x in names], bool)[code]
        self.eof, self.dots = flag(lambda x: x[0] == "\x00"), flag(lambda x: x == "\x00d")
        self.brk = flag(lambda x: x[0] in "\n\x00")
        self.stop, self.colon, self.alpha = flag(lambda x: x in _STOPS), flag(lambda x: x == ":"), flag(lambda x: x[0].isalpha())
        self.capital = flag(lambda x: x[0].isupper())
        special = {"\n": int(_LINE), "\x00": int(_TEXT)}
        self.word = np.array([special.get(x[0]) or _hash(x) for x in names], np.uint64)[code]
        self.kind = np.array([special.get(x[0]) or _hash(_kind(x)) for x in names], np.uint64)[code]
        self.shape = np.where(self.alpha & ~self.capital, np.uint64(17), self.kind)
        i = np.arange(len(code))
        self.since = i - np.maximum.accumulate(np.where(np.r_[True, self.eof[:-1]], i, 0))  # tokens before it in the text

    def context(self, at: np.ndarray, k: int) -> np.ndarray:
        return _cell(*[np.where(self.since[at] >= j, self.kind[np.maximum(at - j, 0)], _NONE) for j in range(k)])

    def labels(self, start: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """What kind of line it is: its first token (as itself; as what it counts as), and the classes of
        the next three, behind the colon of a leading "Word:"."""
        said = self.alpha[start] & (start + 2 <= last) & self.colon[np.minimum(start + 1, len(self.kind) - 1)]
        a = np.where(said, start + 2, start + 1)
        shape = _mix_in(said.astype(np.uint64), *[np.where(a + j <= last, self.shape[np.minimum(a + j, last)], _NONE) for j in range(3)])
        return _mix_in(shape, self.word[start]), _mix_in(shape, self.kind[start])

    def places(self, at: np.ndarray, start: np.ndarray, label: np.ndarray) -> np.ndarray:
        """Cells of (kind of line, place in the line, word, name, number or the mark itself)."""
        return _cell(label, np.minimum(at - start, 40).astype(np.uint64), self.shape[at])

    def heads(self, start: np.ndarray, last: np.ndarray) -> np.ndarray:
        """Cells of a line's first two tokens behind a leading "Word:", and for lines of up to three
        tokens their number and the end of the line before."""
        said = self.alpha[start] & (start + 2 <= last) & self.colon[np.minimum(start + 1, len(self.kind) - 1)]
        a = np.where(said, start + 2, start)
        n = np.minimum(last - a + 1, 4)
        before = np.where((n <= 3) & ~said & (self.since[start] >= 2), self.kind[np.maximum(start - 2, 0)], _NONE)
        two = np.where(a < last, self.kind[np.minimum(a + 1, last)], np.uint64(9))
        return _cell(self.kind[a], two, said.astype(np.uint64), n.astype(np.uint64), before)


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(cell, hit, n) of all count tables, over whole texts.

    word: words inside texts. dots: words before final dots. 1..4: contexts of so many
    tokens, and how often a sentence, line or text ends behind them. named, shaped, head:
    lines by how they begin, and how often they end without a full stop. place, spot: places in
    lines that are named or shaped alike, and how often the line ends there.
    """
    toks: list[str] = []
    out: list[pa.RecordBatch] = []

    def put(table: int, cell: np.ndarray, good: np.ndarray | None = None) -> None:
        marked = np.sort(cell << 1 | (0 if good is None else good))
        first = np.flatnonzero(np.r_[True, marked[1:] >> 1 != marked[:-1] >> 1]) if len(marked) else np.zeros(0, np.int64)
        ends = np.r_[0, np.cumsum(marked & 1)]
        last = np.r_[first[1:], len(marked)].astype(np.int64)
        key = marked[first] >> 1 | table << CELL_BITS
        out.append(pa.RecordBatch.from_arrays([pa.array(key), pa.array((ends[last] - ends[first]).astype(np.int64)), pa.array(last - first)], names=["cell", "hit", "n"]))

    def flush() -> None:
        t = Tokens(toks)
        at = np.flatnonzero(~t.brk)
        nxt = at + 1
        put(TABLES["word"], _cell(t.word[at[~t.eof[nxt]]]))
        put(TABLES["dots"], _cell(t.word[at[t.dots[nxt]]]))
        ends = (t.brk[nxt] & ~t.dots[nxt]) | t.stop[nxt]
        for k in ORDERS:  # behind a full stop a sentence ends if a capital or a break follows; the longest contexts ask for a break
            put(TABLES[k], t.context(at, k), np.where(t.stop[at], t.brk[nxt] | (t.capital[nxt] & (k < 4)), ends))
        start = at[np.r_[True, t.brk[at[1:] - 1]]] if len(at) else at
        last = at[np.r_[t.brk[nxt[:-1]], True]] if len(at) else at
        ok = ~t.dots[last + 1]
        quiet, line = ~t.stop[last[ok]], np.searchsorted(start, at, "right") - 1
        put(TABLES["head"], t.heads(start[ok], last[ok]), quiet)
        for table, place, label in zip(("named", "shaped"), ("place", "spot"), t.labels(start, last), strict=True):
            put(TABLES[table], _cell(label[ok]), quiet)
            put(TABLES[place], t.places(at, start[line], label[line]), t.brk[nxt] & ~t.dots[nxt])

    for b in batches:
        for text in b.column(0).to_pylist():
            t, mark = ending_of(text)
            if t and not is_markup(t):
                toks += _TOKEN.findall(t)
                toks.append("\x00d" if mark else "\x00")
                if len(toks) > FLUSH_TOKENS:
                    flush()
                    yield from out
                    toks, out[:] = [], []
    if toks:
        flush()
        yield from out


def ask_endings(texts: list[str]) -> pa.RecordBatch:
    """(settled, stop, alpha, capital, dots, entry, cells) of each text's ending.

    settled is the evidence where no counts are needed, else null; cells are then the keys of
    the counts to look up, in the order of ASKED.
    """
    settled: list[float | None] = [None] * len(texts)
    toks: list[str] = []
    rows, marks, entries = [], [], []
    for i, text in enumerate(texts):
        t, mark = ending_of(text)
        if not t:
            settled[i] = 6.0 if mark == "cut" else -7.0
        elif mark == "cut":
            settled[i] = 7.0
        elif is_markup(t):
            settled[i] = -7.0 if t[-1] in "}]" and t.count("{") <= t.count("}") and t.count("[") <= t.count("]") else 7.0
        elif t.count("```") % 2:
            settled[i] = 7.0
        else:
            line = t.rfind("\n") + 1  # the last line, and what stands just before it, is what is judged
            toks += _TOKEN.findall(t[t.rfind("\n", 0, max(0, line - 60)) + 1 :])
            toks.append("\x00d" if mark else "\x00")
            rows.append(i), marks.append(mark == "dots"), entries.append(_ENTRY.match(t, line) is not None)
    flags = np.zeros((5, len(texts)), bool)
    cells = np.zeros((0, len(ASKED)), np.int64)
    if rows:
        t = Tokens(toks)
        last = np.flatnonzero(t.eof) - 1
        i = np.arange(len(toks))
        start = np.maximum.accumulate(np.where(np.r_[True, t.brk[:-1]], i, 0))[last]
        named, shaped = t.labels(start, last)
        word = _cell(t.word[last])
        cell = {k: t.context(last, k) for k in ORDERS} | {"head": t.heads(start, last), "shaped": _cell(shaped), "named": _cell(named), "word": word, "dots": word,
                                                        "spot": t.places(last, start, shaped), "place": t.places(last, start, named)}
        cells = np.stack([cell[k] | TABLES[k] << CELL_BITS for k in ASKED], 1)
        flags[:, rows] = t.stop[last], t.alpha[last], t.capital[last], marks, entries
    of = np.zeros(len(texts) + 1, np.int32)
    of[1:][rows] = len(ASKED)
    keys = pa.ListArray.from_arrays(pa.array(np.cumsum(of, dtype=np.int32)), pa.array(cells.ravel()))
    return pa.RecordBatch.from_arrays([pa.array(settled, pa.float64()), *map(pa.array, flags), keys], names=["settled", "stop", "alpha", "capital", "dots", "entry", "cells"])


def ending_evidence(stop: np.ndarray, alpha: np.ndarray, capital: np.ndarray, dots: np.ndarray, entry: np.ndarray, counts: Counts) -> np.ndarray:
    """Log likelihood ratio, cut against complete, of endings; own counts are left out."""
    own = (~dots).astype(np.int64)
    p = np.full(len(stop), 0.5)
    for k in ORDERS:  # shorter contexts are what longer ones start from
        n, hit = counts.of(k)
        p = (np.maximum(hit - own, 0) + p) / (np.maximum(n - 1, 0) + 1)

    def rate(table: str, least: int) -> np.ndarray:
        m, h = counts.of(table)
        return np.where(m - own >= least, np.maximum(h - own, 0) / np.maximum(m - own, 1), np.nan)

    # How often lines that begin so do without a full stop: the most particular cell with enough lines counts.
    q = np.full(len(stop), 0.5)
    for table, least in (("head", 3), ("shaped", 20), ("named", 20)):
        r = rate(table, least)
        q = np.where(np.isnan(r), q, r)
    q = np.where(entry, np.maximum(q, 0.5), q)  # a list entry may do without a full stop, whatever it says
    seen, _ = counts.of("word")
    # A word that hardly occurs inside texts is a piece of one, unless other texts end with it in the same way.
    n3, h3 = counts.of(3)
    closing = ~capital & (n3 - own >= 20) & (h3 - own >= 0.9 * (n3 - own))
    known = np.where(alpha & ~closing, np.where(seen < 1, 0.02, np.where(seen < 3, 0.3, 1.0)), 1.0)
    dotted = counts.of("dots")[0] - 1
    # Lines of a kind that does without full stops (lists, tags, signatures) end at their own places.
    place = np.zeros(len(stop))
    for table in ("spot", "place"):
        r = rate(table, 3)
        place = np.where(np.isnan(r) | (q <= 0.9), place, r)
    p = np.where(place > 0.2, np.maximum(p, place), p)
    whole = np.clip(q, 0.01, 0.998) * np.clip(p, 0, 0.998) * known
    # A full stop ends a sentence unless sentences go on behind its context ("e.g.", ordinals).
    (n3, h3), (n4, h4) = counts.of(3), counts.of(4)
    n3, h3, n4, h4 = n3 - 1, h3 - 1, n4 - 1, h4 - 1
    open_stop = ((n3 >= 20) & (h3 <= 0.02 * n3)) | ((n4 >= 200) & (h4 <= 0.001 * n4))
    whole = np.where(stop, np.where(open_stop, 0.01, 0.999), whole)
    whole = np.where(dots, np.where((dotted >= 2) & (dotted > 0.02 * seen), 0.95, 0.01), whole)
    return np.clip(np.log((1 - whole) / np.maximum(whole, 1e-4)), -7, 7)


def _ask_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, src, chars, bytes) of rows and what `ask_endings` gives for them."""
    for b in batches:
        texts = b.column("text").to_pylist()
        bare = []
        for t in texts:  # the length of what stood before marks and line ends were set behind it
            cut, _ = without_mark(t)
            stripped = cut.rstrip("\r\n")
            bare.append(stripped if stripped else cut)
        asked = ask_endings(texts)
        yield pa.RecordBatch.from_arrays([
            b.column("doc_id"), b.column("src"), pa.array([len(t) for t in bare], pa.int64()), pa.array([len(t.encode()) for t in bare], pa.int64()), *asked.columns], names=["doc_id", "src", "chars", "bytes", *asked.schema.names])


def _judge_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc_id, src, chars, bytes, evidence) from the flags of endings and their counts."""
    for b in batches:
        found = b.column("found")
        sizes = np.asarray(found.value_lengths().fill_null(0))
        pos, n, hit = (np.asarray(x) for x in found.flatten().flatten())
        counts = Counts(b.num_rows, np.repeat(np.arange(b.num_rows), sizes), pos, n, hit)
        flags = [b.column(c).to_numpy(zero_copy_only=False) for c in ("stop", "alpha", "capital", "dots", "entry")]
        settled = b.column("settled").to_numpy(zero_copy_only=False)
        evidence = np.where(np.isnan(settled), ending_evidence(*flags, counts), settled)
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("doc_id", "src", "chars", "bytes")), pa.array(evidence)], names=["doc_id", "src", "chars", "bytes", "evidence"])


def judge_endings(rows: DataFrame) -> DataFrame:
    """(doc_id, src, chars, bytes, evidence) of every row of (doc_id, src, text), as a written table.

    All counts stay in a written table; each text asks for a dozen of its keys. Frequent
    keys stand on the left of that join, whose right side has one row per key.
    """
    counts = rows.select("text").mapInArrow(_count_batches, "cell long, hit long, n long").groupBy("cell").agg(F.sum("hit").alias("hit"), F.sum("n").alias("n"))
    # A single count, words aside, is the asking text's own, which is left out.
    counts = materialise(counts.filter((F.shiftright("cell", CELL_BITS) == TABLES["word"]) | (F.col("n") > 1)), "counts")
    asked = rows.mapInArrow(_ask_batches, "doc_id long, src string, chars long, bytes long, settled double, stop boolean, alpha boolean, capital boolean, dots boolean, entry boolean, cells array<long>")
    asked = materialise(asked.withColumn("row", F.monotonically_increasing_id()), "asked")
    found = asked.select("row", F.posexplode("cells").alias("pos", "cell")).join(counts, "cell")
    found = found.groupBy("row").agg(F.collect_list(F.struct("pos", "n", "hit")).alias("found"))
    judged = asked.drop("cells").join(found, "row", "left").mapInArrow(_judge_batches, "doc_id long, src string, chars long, bytes long, evidence double")
    judged = materialise(judged, "endings")
    release(counts), release(asked)
    return judged


@dataclass(frozen=True)
class SourceFit:
    """Log-normal length distribution of a source, right-censored at its limits, and posteriors by length."""

    mean: float
    sd: float
    limits: dict[tuple[str, int], float]


def fit_lengths(n: int, total: float, squares: float, at_limit: dict[tuple[str, int], int]) -> SourceFit:
    """Maximum likelihood by EM: values at a candidate limit are known to be at least as long.

    n, total, squares: number, sum and sum of squares of log lengths of the other values.
    The posterior of being cut at a limit is the share of the values there that the fitted
    distribution doesn't put at that very length.
    """
    censored = [(math.log(length), count) for (_, length), count in at_limit.items()]
    all_n = n + sum(c for _, c in censored)
    s0, s1 = total + sum(a * c for a, c in censored), squares + sum(a * a * c for a, c in censored)
    mu, sd = s0 / max(all_n, 1), math.sqrt(max(s1 / max(all_n, 1) - (s0 / max(all_n, 1)) ** 2, 1e-4))
    for _ in range(60):
        e1, e2 = total, squares
        for a, c in censored:
            z = (a - mu) / sd
            tail = max(0.5 * math.erfc(z / math.sqrt(2)), 1e-12)
            haz = math.exp(-z * z / 2) / math.sqrt(2 * math.pi) / tail
            m = mu + sd * haz
            e1 += c * m
            e2 += c * (sd * sd * (1 + z * haz - haz * haz) + m * m)
        mu, sd = e1 / max(all_n, 1), math.sqrt(max(e2 / max(all_n, 1) - (e1 / max(all_n, 1)) ** 2, 1e-4))
    post = {}
    for (kind, length), count in at_limit.items():
        z = (math.log(length) - mu) / sd
        here = all_n * math.exp(-z * z / 2) / (math.sqrt(2 * math.pi) * sd * length)
        post[kind, length] = min(0.99, max(0.02, 1 - here / count))
    return SourceFit(mu, sd, post)


def candidate_limits(lengths: DataFrame) -> DataFrame:
    """(src, kind, len, n): lengths, in characters or bytes, far more frequent in their source than those around."""
    per = lengths.select("src", F.explode(F.array(F.struct(F.lit("c").alias("kind"), F.col("chars").alias("len")), F.struct(F.lit("b").alias("kind"), F.col("bytes").alias("len")))).alias("x"))
    per = per.groupBy("src", "x.kind", "x.len").agg(F.count("*").alias("n"))
    near = Window.partitionBy("src", "kind", F.floor(F.col("len") / 64))
    return per.withColumn("rest", (F.sum("n").over(near) - F.col("n")) / 63).filter((F.col("n") >= LEAST_AT_LIMIT) & (F.col("n") > SPIKE * F.col("rest")) & (F.col("len") >= 64)).select("src", "kind", "len", "n")


def cut_texts(docs: DataFrame, doc_id: str, text: str, source: str, base_rate: float = 0.1) -> DataFrame:
    """(doc_id, src, chars, censoring, evidence, posterior, cut) of every record with a text.

    Per source (one spelling) a log-normal length distribution is fitted by maximum
    likelihood, right-censored at candidate limits: lengths in characters or bytes, marks
    and line ends set behind the text aside, at which values pile up. A value's prior odds
    of being cut are those of the censoring posterior at its length, elsewhere of
    `base_rate`; the ending multiplies them by its likelihood ratio, from counts over all
    texts: whether the last word is a whole one, whether sentences and lines go on behind
    its last tokens, whether lines that begin so end without a full stop, and open quotes
    of markup and code. `cut` is posterior > 0.5.

    Null texts and ids give no row, blank texts are complete; rows with the same id are
    judged apart; an empty table gives an empty result; other columns are ignored. Whole
    texts are counted, and no count is dropped, however large the table. A source with few
    rows has no limits and keeps the base rate.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), source_name(F.col(source)).alias("src"), F.col(text).alias("text")).filter("doc_id is not null and text is not null")
    judged = judge_endings(rows)
    limits: dict[str, dict[tuple[str, int], int]] = {}
    for r in candidate_limits(judged).collect():
        limits.setdefault(r.src, {})[r.kind, r.len] = r.n
    flat = [(s, k, length) for s, x in limits.items() for k, length in x]
    schema = "src string, kind string, len long"
    lim = F.broadcast(spark.createDataFrame(flat, schema))
    at = judged.join(lim.filter("kind = 'c'").select("src", F.col("len").alias("chars"), F.lit("c").alias("_c")), ["src", "chars"], "left")
    at = at.join(lim.filter("kind = 'b'").select("src", F.col("len").alias("bytes"), F.lit("b").alias("_b")), ["src", "bytes"], "left")
    free = F.col("_c").isNull() & F.col("_b").isNull() & (F.col("chars") > 0)
    log = F.when(free, F.log("chars"))
    fits = []
    for r in at.groupBy("src").agg(F.count(log).alias("n"), F.sum(log).alias("s1"), F.sum(log * log).alias("s2")).collect():
        fit = fit_lengths(r.n, r.s1 or 0.0, r.s2 or 0.0, limits.get(r.src, {}))
        fits += [(r.src, k, length, p) for (k, length), p in fit.limits.items()]
    post = F.broadcast(spark.createDataFrame(fits, schema + ", p double"))
    at = at.join(post.select("src", F.col("kind").alias("_c"), F.col("len").alias("chars"), F.col("p").alias("_pc")), ["src", "chars", "_c"], "left")
    at = at.join(post.select("src", F.col("kind").alias("_b"), F.col("len").alias("bytes"), F.col("p").alias("_pb")), ["src", "bytes", "_b"], "left")
    prior = F.coalesce(F.greatest("_pc", "_pb"), F.lit(base_rate))
    odds = F.log(prior / (1 - prior)) + F.col("evidence")
    return at.withColumn("censoring", prior).withColumn("posterior", 1 / (1 + F.exp(-odds))).select(
        "doc_id", "src", "chars", "censoring", "evidence", "posterior", (F.col("posterior") > 0.5).alias("cut"))


def cut_rates(judged: DataFrame) -> DataFrame:
    """(source, n_records, n_cut, cut_rate) per source."""
    return judged.groupBy(F.col("src").alias("source")).agg(F.count("*").alias("n_records"), F.count(F.when(F.col("cut"), 1)).alias("n_cut"), F.avg(F.col("cut").cast("int")).alias("cut_rate"))
