import itertools
import random
import re
from collections import Counter

import numpy as np

from memspark.llm import nearcopies
from memspark.llm.nearcopies import components, near_copies, trie_join


def texts(seed=0, n=160):
    rnd = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)] + ["the", "and", "of"] * 30
    out = []
    for _ in range(n):
        if out and rnd.random() < 0.5:
            w = rnd.choice(out)[:]
            for _ in range(rnd.randrange(0, 12)):
                i = rnd.randrange(len(w))
                op = rnd.randrange(4)
                if op == 0:
                    w[i] = rnd.choice(vocab)
                elif op == 1:
                    w.insert(i, rnd.choice(vocab))
                elif op == 2 and len(w) > 5:
                    del w[i]
                else:
                    rnd.shuffle(w)
        else:
            w = [rnd.choice(vocab) for _ in range(rnd.randrange(18, 70))]
        out.append(w)
    return [" ".join(w) for w in out]


def brute(rows):
    bags = {i: Counter(re.findall(r"[^\W_]+", t.lower())) for i, t in rows}
    bags = {i: b for i, b in bags.items() if sum(b.values()) >= 24}
    return {(a, b) for a, b in itertools.combinations(sorted(bags), 2) if sum((bags[a] & bags[b]).values()) >= 0.8 * max(sum(bags[a].values()), sum(bags[b].values())) - 1e-9}


def pairs_of(classes, pairs):
    members = {}
    for r in classes.collect():
        members.setdefault(r.class_id, []).append(r.id)
    out = {(a, b) for m in members.values() for a, b in itertools.combinations(sorted(m), 2)}
    for r in pairs.collect():
        out |= {(min(a, b), max(a, b)) for a in members[r.class_a] for b in members[r.class_b]}
    return out


def check(spark):
    rows = [(f"m{i:03}", t) for i, t in enumerate(texts())]
    rows += [("long1", "big " * 3000 + texts()[0]), ("long2", "big " * 2900 + texts()[0]), ("one", "x " * 24), ("two", "x " * 29), ("three", "x " * 40)]
    extra = [("null", None), (None, "x " * 30), ("empty", ""), rows[3], (" m004 ", dict(rows)["m004"])]
    df = spark.createDataFrame([(*r, "clash", 1) for r in rows + extra], "memory_id string, content string, id string, h int")
    classes, pairs = near_copies(df, "memory_id", "content")
    assert pairs_of(classes, pairs) == brute(rows)


def test_no_pair_is_lost(spark, monkeypatch):
    check(spark)
    monkeypatch.setattr(nearcopies, "LEAF_PAIRS", 3)
    check(spark)


def test_hot_words_and_slices(spark, monkeypatch):
    monkeypatch.setattr(nearcopies, "HOT", 3)
    monkeypatch.setattr(nearcopies, "SLICE", 4)
    check(spark)
    monkeypatch.setattr(nearcopies, "MAX_WORDS", 1)  # counts joined instead of sent
    check(spark)


def test_trie_against_all_pairs(monkeypatch):
    monkeypatch.setattr(nearcopies, "LEAF_PAIRS", 1)
    rng = np.random.default_rng(5)
    n = rng.integers(24, 60, 400)
    sk = rng.integers(0, 2**63, (400, 4)).astype(np.uint64)
    for i in range(0, 400, 2):  # near partners
        sk[i + 1] = sk[i]
        for b in rng.integers(0, 256, rng.integers(0, 24)):
            sk[i + 1, b // 64] ^= np.uint64(1) << np.uint64(b % 64)
    key = rng.integers(0, 3, 400).repeat(1)
    key[1::2] = key[::2]
    err = rng.integers(0, 6, 400)
    err[1::2] = err[::2]
    told = {}
    i, j = trie_join(key, np.full(400, 2, np.int8), n, err, sk, 0.8, told)
    assert told["pairs"] > told["at_nodes"] > 0 and told["at_nodes"] + told["at_rows"] > 0.9 * told["pairs"]
    got = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist(), strict=True)}
    want = set()
    for a, b in itertools.combinations(range(400), 2):
        need = int(np.ceil(0.8 * max(n[a], n[b]) - 1e-9))
        if key[a] == key[b] and min(n[a], n[b]) >= need and int(np.bitwise_count(sk[a] ^ sk[b]).sum()) <= n[a] + n[b] - 2 * need - err[a] - err[b] and int(np.bitwise_count(np.bitwise_xor.reduce(sk[a] ^ sk[b]))) <= n[a] + n[b] - 2 * need - err[a] - err[b]:
            want.add((a, b))
    assert got == want and want


def test_components_and_empty(spark, rows):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "y"), ("d", "e"), ("a", "b"), ("q", "q")], "a string, b string")
    assert rows(components(e, "a", "b")) == [*((n, "a") for n in "abcde"), ("x", "x"), ("y", "x")]
    assert components(e.limit(0), "a", "b").count() == 0
    classes, pairs = near_copies(spark.createDataFrame([], "id string, t string"), "id", "t")
    assert classes.count() == 0 and pairs.count() == 0
