"""Most similar vectors for every vector: inverted lists scanned dimension block by block."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from memspark.operators.lineage import materialise

SAMPLE = 32768  # rows the index is fitted on, at most
MAX_LISTS = 2048
LIST_ROWS = 200  # rows of a list aimed at; beyond MAX_LISTS lists, of a list's sublists
SUB_PROBES = 6  # sublists a query asks of each of its lists, at least
PROBED_OF = 500  # lists up to which a number of probes is kept; beyond, probes grow with the lists
GROUP_ROWS = 12000  # rows of a group of neighbouring lists aimed at
SLICE_ROWS = 48000  # a group with more rows, or as many queries, is held by several tasks
STRICT = 2.1  # the larger, the fewer true neighbours an early test abandons


@dataclass(frozen=True)
class ListIndex:
    """Rotation, list centres (rotated), the group of each list, and the slices of each group."""

    rotation: np.ndarray
    centres: np.ndarray
    group: np.ndarray
    slices: np.ndarray


def _spherical_means(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int = 8) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        near = np.concatenate([(x[i : i + 4096] @ c.T).argmax(1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        norm = np.linalg.norm(total, axis=1, keepdims=True)
        c = np.where(norm > 0, total / np.maximum(norm, 1e-12), c).astype(np.float32)
    return c


def fit_index(sample: np.ndarray, n_rows: int, seed: int = 7) -> ListIndex:
    """Index for `n_rows` unit vectors, fitted on `sample` (at most SAMPLE rows of them)."""
    rng = np.random.default_rng(seed)
    dim = sample.shape[1]
    rotation = np.linalg.qr(rng.standard_normal((dim, dim)))[0].astype(np.float32)
    x = sample @ rotation
    k = int(np.clip(n_rows // LIST_ROWS, 1, min(MAX_LISTS, max(1, len(x) // 8))))
    centres = _spherical_means(x, k, rng)
    load = np.bincount((x @ centres.T).argmax(1), minlength=k) / len(x) * n_rows
    g = int(np.clip(round(n_rows / GROUP_ROWS), 1, k))
    # Neighbouring lists share a group, so that a query's probes meet few groups: the lists are
    # split by the median, weighted by rows, along their widest direction, again and again.
    group, todo, made = np.zeros(k, np.int64), [(np.arange(k), g)], 0
    while todo:
        own, parts = todo.pop()
        if parts <= 1 or len(own) <= 1:
            group[own], made = made, made + 1
            continue
        c = centres[own] - centres[own].mean(0)
        axis = np.linalg.svd(c, full_matrices=False)[2][0]
        own = own[np.argsort(c @ axis, kind="stable")]
        left = parts // 2
        rows = np.cumsum(load[own] + 1e-9)
        cut = int(np.clip(np.searchsorted(rows, rows[-1] * left / parts) + 1, 1, len(own) - 1))
        todo += [(own[cut:], parts - left), (own[:cut], left)]
    rows = np.bincount(group, weights=load, minlength=made)
    return ListIndex(rotation, centres, group, np.maximum(1, np.ceil(rows / SLICE_ROWS)).astype(np.int64))


def probes_of(probes: int, lists: int) -> int:
    """Lists a query asks: at least `probes`, and no smaller share of the lists than `probes` of PROBED_OF."""
    return min(lists, max(probes, -(-probes * lists // PROBED_OF)))


def _vectors(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    x = np.asarray(col.flatten(), dtype=np.float64).reshape(-1, dim)
    return (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)


SENT = "part int, list int, probes array<int>, id long, vec binary"


def _send(index: ListIndex, dim: int, probes: int):
    """Rows for each block: `list` is the row's own list there (-1: it is only a query there), `probes` the lists it asks there.

    A group of s slices has s x s blocks, one for each slice of its rows and slice of its
    queries, so neither grows beyond what a task can hold.
    """
    starts = np.concatenate([[0], np.cumsum(index.slices**2)])
    k = len(index.centres)
    probes = probes_of(probes, k)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 8192):
                s = b.slice(at, 8192)
                x = _vectors(s.column("vec"), dim) @ index.rotation
                ids, asks = np.asarray(s.column("id")), np.asarray(s.column("ask"))
                near = x @ index.centres.T
                top = np.argpartition(-near, probes - 1, axis=1)[:, :probes] if probes < k else np.tile(np.arange(k), (len(x), 1))
                home = near.argmax(1)
                place = ids % 1_000_003
                groups = np.where(asks[:, None], index.group[top], -1)
                order = np.argsort(groups, axis=1, kind="stable")
                groups, top = np.take_along_axis(groups, order, 1), np.take_along_axis(top, order, 1)
                out_part, out_list, out_row, out_probes = [], [], [], []
                for i in range(len(x)):
                    hg = index.group[home[i]]
                    cuts = np.flatnonzero(np.diff(groups[i])) + 1 if asks[i] else ()
                    mine = set(range(index.slices[hg]))  # slices of queries its own row has to meet alone
                    slot = place[i] % index.slices[hg]
                    for lists, g in zip(np.split(top[i], cuts), groups[i][np.concatenate([[0], cuts]).astype(int)], strict=True) if asks[i] else ():
                        n = index.slices[g]
                        q = place[i] // 1009 % n
                        for sl in range(n):
                            own = g == hg and sl == slot
                            if own:
                                mine.discard(q)
                            out_part.append(starts[g] + sl * n + q), out_list.append(home[i] if own else -1), out_row.append(i), out_probes.append(lists)
                    for q in mine:
                        out_part.append(starts[hg] + slot * index.slices[hg] + q), out_list.append(home[i]), out_row.append(i), out_probes.append(())
                rows = np.array(out_row, np.int64)
                sizes = np.array([len(p) for p in out_probes], np.int32)
                flat = np.concatenate([np.asarray(p, np.int32) for p in out_probes]) if len(out_probes) else np.zeros(0, np.int32)
                vec = pa.FixedSizeBinaryArray.from_buffers(pa.binary(4 * dim), len(rows), [None, pa.py_buffer(np.ascontiguousarray(x[rows], np.float32))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([
                    pa.array(np.array(out_part, np.int32)), pa.array(np.array(out_list, np.int32)),
                    pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)), pa.array(flat)), pa.array(ids[rows]), vec],
                    names=["part", "list", "probes", "id", "vec"])

    return run


def scan_lists(q: np.ndarray, q_ids: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], x: np.ndarray, x_ids: np.ndarray, x_list: np.ndarray, k: int, least: float | None,
               strict: float = STRICT, blocks: tuple[int, ...] = (8, 16, 32)) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Adaptive dimension scan: (query place, neighbour id, cosine), up to k per query.

    `pairs` are (query place, probed list). Vectors are unit and rotated, so the squared
    distance over the first t of D dimensions, times D/t, estimates the whole: a candidate
    is abandoned once it exceeds the query's bound times (1 + strict/sqrt(t))^2, the
    hypothesis that it is still within the bound being rejected. The bound is the k-th best
    distance so far, and at most that of cosine `least`.
    """
    dim = x.shape[1]
    edges = sorted({min(b, dim) for b in blocks} | {dim})
    cap = np.float32(2 - 2 * least + 1e-6) if least is not None else np.float32(4.1)
    best_d, best_i = np.full((len(q), k), np.inf, np.float32), np.full((len(q), k), -1, np.int64)
    order = np.argsort(x_list, kind="stable")
    x, x_ids, x_list = x[order], x_ids[order], x_list[order]
    by_list = np.argsort(pairs[1], kind="stable")
    asking, lists = pairs[0][by_list], pairs[1][by_list]
    qn = [np.einsum("ij,ij->i", q[:, a:b], q[:, a:b]) for a, b in zip([0, *edges], edges)]
    xn = [np.einsum("ij,ij->i", x[:, a:b], x[:, a:b]) for a, b in zip([0, *edges], edges)]
    for li in np.unique(lists):
        a, b = np.searchsorted(x_list, li), np.searchsorted(x_list, li, "right")
        if a == b:
            continue
        who = asking[np.searchsorted(lists, li) : np.searchsorted(lists, li, "right")]
        for at in range(0, len(who), 512):
            for lo in range(a, b, 4096):
                hi = min(b, lo + 4096)
                w = who[at : at + 512]
                bound = np.minimum(best_d[w, k - 1], cap)
                t = edges[0]
                part = qn[0][w][:, None] + xn[0][lo:hi][None, :] - 2 * (q[w, :t] @ x[lo:hi, :t].T)
                qi, xi = np.nonzero(part <= (bound * np.float32(t / dim * (1 + strict / np.sqrt(t)) ** 2))[:, None])
                d = part[qi, xi]
                for n, (s, t) in enumerate(zip(edges, edges[1:]), 1):
                    d = d + qn[n][w[qi]] + xn[n][lo + xi] - 2 * np.einsum("ij,ij->i", q[w[qi], s:t], x[lo + xi, s:t])
                    keep = d <= bound[qi] * np.float32(t / dim * (1 + strict / np.sqrt(t)) ** 2 if t < dim else 1) + (1e-6 if t == dim else 0)
                    qi, xi, d = qi[keep], xi[keep], d[keep]
                keep = x_ids[lo + xi] != q_ids[w[qi]]
                qi, xi, d = w[qi[keep]], lo + xi[keep], d[keep]
                if not len(qi):
                    continue
                touched = np.unique(qi)
                all_q = np.concatenate([qi, np.repeat(touched, k)])
                all_d, all_i = np.concatenate([d, best_d[touched].ravel()]), np.concatenate([x_ids[xi], best_i[touched].ravel()])
                o = np.lexsort((all_i, all_d, all_q))
                all_q, all_d, all_i = all_q[o], all_d[o], all_i[o]
                first = np.searchsorted(all_q, touched)
                take = first[:, None] + np.arange(k)[None, :]
                best_d[touched], best_i[touched] = all_d[take], all_i[take]
    got = np.nonzero(best_i >= 0)
    return got[0], best_i[got], 1 - best_d[got].astype(np.float64) / 2


def split_lists(q: np.ndarray, pairs: tuple[np.ndarray, np.ndarray], x: np.ndarray, x_list: np.ndarray, sub: int = SUB_PROBES, seed: int = 7) -> tuple[tuple[np.ndarray, np.ndarray], np.ndarray]:
    """(pairs, list of each row) after lists of more than two times LIST_ROWS rows are cut into sublists.

    A list's sublists are fitted on at most 64 of its rows for each; each of its queries asks
    the `sub` nearest of them and, like among lists, a share of them that doesn't shrink
    before PROBED_OF.
    """
    big = [(li, n) for li, n in zip(*np.unique(x_list, return_counts=True), strict=True) if n > 2 * LIST_ROWS]
    if not big:
        return pairs, x_list
    rng = np.random.default_rng(seed)
    out, made = x_list.astype(np.int64), int(x_list.max()) + 1
    asking, lists = [pairs[0][~np.isin(pairs[1], [li for li, _ in big])]], [pairs[1][~np.isin(pairs[1], [li for li, _ in big])]]
    for li, n in big:
        own, who = np.flatnonzero(x_list == li), pairs[0][pairs[1] == li]
        k = int(n // LIST_ROWS)
        fit = own if n <= 64 * k else own[rng.choice(n, 64 * k, replace=False)]
        c = _spherical_means(x[fit], k, rng, 4)
        out[own] = made + np.concatenate([(x[own[i : i + 4096]] @ c.T).argmax(1) for i in range(0, n, 4096)])
        p = probes_of(min(sub, k), k)
        for i in range(0, len(who), 4096):
            w = who[i : i + 4096]
            top = np.argpartition(-(q[w] @ c.T), p - 1, axis=1)[:, :p]
            asking.append(np.repeat(w, p)), lists.append(made + top.ravel())
        made += k
    return (np.concatenate(asking), np.concatenate(lists)), out


def _scan(dim: int, k: int, least: float | None):
    def run(key, table):
        table = table.combine_chunks()
        col = lambda c: table.column(c).chunk(0) if table.column(c).num_chunks else pa.array([], table.schema.field(c).type)
        x = np.frombuffer(b"".join(table.column("vec").to_pylist()), np.float32).reshape(-1, dim)
        ids, lists, probes = np.asarray(col("id")), np.asarray(col("list")), col("probes")
        asked = np.diff(np.asarray(probes.offsets))
        own = np.flatnonzero(lists >= 0)
        own = own[np.unique(ids[own], return_index=True)[1]]
        ask = np.flatnonzero(asked > 0)
        place = np.full(len(ids), -1)
        place[ask] = np.arange(len(ask))
        flat = np.asarray(probes.flatten())
        pairs = (np.repeat(place[ask], asked[ask]), flat)
        pairs, owned = split_lists(x[ask], pairs, x[own], lists[own]) if len(own) and len(ask) else (pairs, lists[own])
        qi, nb, cos = scan_lists(x[ask], ids[ask], pairs, x[own], ids[own], owned, k, least)
        return pa.table({"id": ids[ask][qi], "near": nb, "cosine": cos})

    return run


def nearest(df: DataFrame, id_col: str, vec_col: str, dim: int = 64, k: int = 10, probes: int = 12, least: float | None = None, ask_every: int = 1, seed: int = 7) -> DataFrame:
    """(id, near, cosine, rank): the k most similar other vectors of every vector, by cosine.

    Every usable row is indexed; with `ask_every` only ids divisible by it are asked for
    (a stated query set), with `least` only neighbours of at least that cosine are wanted.
    Usable are vectors of exactly `dim` finite numbers, not all zero; others, and null ids,
    are neither asked for nor found. Rows with the same id are one. Equal vectors, however
    many rows hold them, are one class, represented by its least id: neighbours are sought
    between classes and then given to members, of whom the k + 1 least ids can be
    neighbours. Ties go to the lesser id. An empty table gives an empty result; other
    columns are ignored.

    Inverted lists: centres are fitted on a sample of at most SAMPLE rows; rows of
    neighbouring lists share a group, and a query is sent once to each group that holds one
    of its nearest lists: `probes` of them, more beyond PROBED_OF lists. Beyond MAX_LISTS
    lists each task cuts its lists into sublists, so that a query looks at as many rows as
    before; a group with more rows or queries than SLICE_ROWS is cut into slices. Within each
    probed list candidates are abandoned by `scan_lists`.
    """
    spark = df.sparkSession
    v = F.col(vec_col).cast("array<float>")
    finite = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    ok = F.col(id_col).isNotNull() & (F.size(v) == dim) & F.forall(v, finite) & F.exists(v, lambda x: x != 0)
    rows = df.select(F.col(id_col).cast("long").alias("id"), v.alias("vec"), ok.alias("ok")).filter("ok").select("id", "vec")
    wanted = F.col("id") % ask_every == 0
    classes = materialise(rows.groupBy("vec").agg(F.min("id").alias("id"), F.max("id").alias("last"), F.max(wanted).alias("ask")).withColumn("h", F.xxhash64("vec")), "vectors")
    n = classes.count()
    if n == 0:
        return spark.createDataFrame([], "id long, near long, cosine double, rank int")
    sample = classes.select("vec") if n <= SAMPLE else classes.select("vec").sample(fraction=SAMPLE / n, seed=seed)
    index = fit_index(_vectors(sample.limit(SAMPLE).toArrow().column("vec"), dim), n, seed)
    sent = classes.select("id", "vec", "ask").mapInArrow(_send(index, dim, probes), SENT)
    found = sent.groupBy("part").applyInArrow(_scan(dim, k, least), "id long, near long, cosine double")
    top = lambda key, *tie: Window.partitionBy(key).orderBy(F.desc("cosine"), *tie)
    found = found.withColumn("rank", F.row_number().over(top("id", "near"))).filter(F.col("rank") <= k)
    many = classes.filter("last > id").select("h", "vec", F.col("id").alias("rep"))
    if many.isEmpty():
        return found
    # Members of classes with several ids; the first k + 1 stand for the class as neighbours.
    members = rows.withColumn("h", F.xxhash64("vec")).join(many, ["h", "vec"]).select("rep", "id").distinct()
    members = materialise(members, "members")
    least_ids = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("id"))
    spread = members.withColumn("s", F.pmod(F.xxhash64("id"), F.lit(64)))  # a class may hold a third of all rows
    firsts = spread.withColumn("r", least_ids("rep", "s")).filter(F.col("r") <= k + 1).withColumn("r", least_ids("rep")).filter(F.col("r") <= k + 1).select("rep", F.col("id").alias("near"))
    found = materialise(found, "found")
    wide = found.select(F.col("id").alias("asker"), F.col("near").alias("rep"), "cosine").join(firsts, "rep", "left")
    wide = wide.select("asker", F.coalesce("near", "rep").alias("near"), "cosine").unionByName(firsts.select(F.col("rep").alias("asker"), "near", F.lit(1.0).alias("cosine")))
    wide = wide.withColumn("r", F.row_number().over(top("asker", "near"))).filter(F.col("r") <= k + 1).drop("r")
    asking = members.select(F.col("rep").alias("asker"), "id")
    alone = wide.join(many.select(F.col("rep").alias("asker")), "asker", "left_anti").select(F.col("asker").alias("id"), "near", "cosine")
    out = asking.join(wide, "asker").select("id", "near", "cosine").unionByName(alone).filter((F.col("id") != F.col("near")) & wanted)
    return out.withColumn("rank", F.row_number().over(top("id", "near"))).filter(F.col("rank") <= k)
