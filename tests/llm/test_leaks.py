import random

import numpy as np

from memspark.llm.leaks import FMIndex, leaked_passages


def test_index_counts_and_locates():
    rng = np.random.default_rng(0)
    seq = rng.integers(1, 5, 3000)
    seq[1000:1500] = seq[:500]  # a long repeat
    f = FMIndex(seq)
    phrases = np.array([seq[i : i + 6] for i in rng.integers(0, 2990, 200)] + [[4, 4, 4, 4, 4, 9]])
    lo, hi = f.search(phrases)
    for p, a, b in zip(phrases, lo, hi, strict=True):
        want = [i for i in range(len(seq) - 5) if (seq[i : i + 6] == p).all()]
        assert sorted(f.locate(np.arange(a, b)).tolist()) == want


def holds(doc, item):
    """Some stretch of 20 or more words of the item is in the document with at most one word in ten edited."""
    for i in range(len(item) - 19):
        d = np.zeros(len(doc) + 1, int)
        for j in range(i, len(item)):
            new = d + 1
            new[1:] = np.minimum(new[1:], d[:-1] + (np.array(doc, object) != item[j]))
            d = np.minimum.accumulate(new - np.arange(len(new))) + np.arange(len(new))
            if j - i + 1 >= 20 and d.min() * 10 <= j - i + 1:
                return True
    return False


def test_edited_passages_against_alignment(spark):
    rnd = random.Random(7)
    words = [f"w{i}" for i in range(60)]
    items = [[rnd.choice(words) for _ in range(rnd.randrange(24, 70))] for _ in range(6)]
    docs = []
    for n in range(90):
        item = rnd.choice(items)
        a = rnd.randrange(0, len(item) - 20)
        part = item[a : a + rnd.randrange(18, 50)]
        for _ in range(rnd.randrange(0, 6)):
            i = rnd.randrange(len(part))
            part = rnd.choice([part[:i] + ["zz"] + part[i + 1 :], part[:i] + ["zz"] + part[i:], part[:i] + part[i + 1 :]])
        docs.append((n, [rnd.choice(words) for _ in range(rnd.randrange(30))] + part + ["end"] * rnd.randrange(9)))
    df = spark.createDataFrame([(n, "; ".join(w).upper(), 1) for n, w in docs] + [(1000, None, 1), (None, " ".join(items[0]), 1), (1001, "", 1)], "doc_id long, text string, item_id int")
    it = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(items)] + [(99, "too short"), (98, None)], "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in leaked_passages(df, "doc_id", "text", it, "item_id", "text").collect()}
    want = {(n, i) for n, w in docs for i, item in enumerate(items) if holds(w, item)}
    assert got == want and len(want) > 30


def test_spans_shards_and_empty(spark, monkeypatch):
    item = " ".join(f"i{k}" for k in range(40))
    docs = spark.createDataFrame([(k, f"a b c {item} x y" if k % 2 else "nothing here") for k in range(20)], "doc_id long, text string").coalesce(1)
    it = spark.createDataFrame([(5, item)], "item_id long, text string")
    got = leaked_passages(docs, "doc_id", "text", it, "item_id", "text")
    assert sorted(tuple(r) for r in got.collect()) == [(k, 5, 3, 43, 6, 6 + len(item)) for k in range(1, 20, 2)]
    assert leaked_passages(docs, "doc_id", "text", it.limit(0), "item_id", "text").count() == 0
    assert leaked_passages(docs.limit(0), "doc_id", "text", it, "item_id", "text").count() == 0


def test_removals_in_characters(spark):
    """Spans of two items that touch are cut out together; places are those of the stored text, whatever its lower case."""
    a, b = (" ".join(f"{x}{k}" for k in range(30)) for x in "ab")
    both = "İİ ß. " + a.upper() + " " + b + "! end"
    apart = a + " and" * 30 + " " + b  # too far apart for the item that holds parts of both
    over = " ".join(f"a{k}" for k in range(10, 30)) + " " + " ".join(f"b{k}" for k in range(20))
    docs = spark.createDataFrame([(1, both), (2, apart), (3, "x " + over)], "doc_id long, text string")
    it = spark.createDataFrame([(1, a), (2, b), (3, over)], "item_id long, text string")
    got = {}
    for r in leaked_passages(docs, "doc_id", "text", it, "item_id", "text", by_item=False).collect():
        got.setdefault(r.doc_id, []).append(r)
    cut = {d: [t[r.from_char : r.to_char] for r in sorted(got[d], key=lambda r: r.from_char)] for d, t in ((1, both), (2, apart), (3, "x " + over))}
    assert cut[1] == [a.upper() + " " + b] and got[1][0].n_items == 3
    assert cut[2] == [a, b] and cut[3] == [over]
