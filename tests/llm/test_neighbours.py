import numpy as np

from memspark.llm import neighbours
from memspark.llm.neighbours import nearest


def brute(ids, x, k, least=-2.0, ask=lambda i: True):
    x = x / np.linalg.norm(x, axis=1, keepdims=True)
    out = {}
    for a in range(len(ids)):
        if ask(ids[a]):
            c = sorted((-round(float(x[a] @ x[b]), 5), ids[b]) for b in range(len(ids)) if ids[b] != ids[a] and x[a] @ x[b] >= least)
            out[ids[a]] = [i for _, i in c[:k]]
    return out


def data(n=1500, seed=0):
    rng = np.random.default_rng(seed)
    centres = rng.standard_normal((20, 64))
    x = centres[rng.integers(0, 20, n)] + 0.8 * rng.standard_normal((n, 64))
    x[1::40] = x[0::40][: len(x[1::40])] + 0.05 * rng.standard_normal((len(x[1::40]), 64))
    return np.arange(n) * 3, x


def frame(spark, ids, x, extra=()):
    rows = [(int(i), [float(v) for v in r], "clash", 7) for i, r in zip(ids, x, strict=True)]
    return spark.createDataFrame(rows + list(extra), "vector_id long, embedding array<float>, id string, h int")


def test_recall_and_pairs(spark):
    ids, x = data()
    bad = [(-1, None, "x", 0), (-2, [], "x", 0), (-3, [1.0] * 63, "x", 0), (-4, [0.0] * 64, "x", 0), (-5, [float("nan")] + [1.0] * 63, "x", 0), (None, [1.0] * 64, "x", 0)]
    df = frame(spark, ids, x, bad)
    df = df.unionByName(df.filter("vector_id % 9 = 0"))
    got = {}
    for r in nearest(df, "vector_id", "embedding", probes=6).collect():
        got.setdefault(r.id, []).append(r.near)
    want = brute(ids, x, 10)
    assert set(got) == set(want) and all(len(v) == 10 for v in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / (10 * len(want)) >= 0.9
    near = {(min(r.id, r.near), max(r.id, r.near)) for r in nearest(df, "vector_id", "embedding", least=0.9).filter("cosine >= 0.9").collect()}
    assert near == {(min(i, j), max(i, j)) for i, v in brute(ids, x, 10, 0.9).items() for j in v}


def test_sublists_and_blocks(spark, monkeypatch):
    """As beyond MAX_LISTS lists and SLICE_ROWS rows: sublists inside tasks, slices of rows and of queries."""
    monkeypatch.setattr(neighbours, "MAX_LISTS", 6)
    monkeypatch.setattr(neighbours, "LIST_ROWS", 40)
    monkeypatch.setattr(neighbours, "GROUP_ROWS", 600)
    monkeypatch.setattr(neighbours, "SLICE_ROWS", 250)
    ids, x = data(2000, 3)
    got = {}
    for r in nearest(frame(spark, ids, x), "vector_id", "embedding", probes=4).collect():
        got.setdefault(r.id, []).append(r.near)
    want = brute(ids, x, 10)
    assert set(got) == set(want) and all(len(v) == len(set(v)) == 10 for v in got.values())
    assert sum(len(set(got[i]) & set(want[i])) for i in want) / (10 * len(want)) >= 0.9


def test_classes_of_equal_vectors(spark):
    ids, x = data(200, 1)
    x[50:80] = x[50]  # a class larger than k
    x[90:92] = x[90]
    got = {}
    for r in nearest(frame(spark, ids, x), "vector_id", "embedding", probes=50).collect():
        got.setdefault(r.id, []).append((r.rank, r.near))
    x = np.float32(x).astype(np.float64)
    want = brute(ids, x, 10)
    assert {i: [b for _, b in sorted(v)] for i, v in got.items() if i in (150, 153, 237, 270)} == {i: want[i] for i in (150, 153, 237, 270)}
    assert len(got) == 200


def test_query_set_and_empty(spark):
    ids, x = data(120, 2)
    df = frame(spark, ids, x)
    assert {r.id for r in nearest(df, "vector_id", "embedding", ask_every=50).collect()} == {i for i in ids.tolist() if i % 50 == 0}
    assert nearest(df.limit(0), "vector_id", "embedding").count() == 0
    assert nearest(df.limit(1), "vector_id", "embedding").count() == 0
