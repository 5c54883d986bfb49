import random

from memspark.operators.hierarchy import ancestor_pairs, hierarchy


def brute(parent):
    out = {}
    for n in parent:
        path, x = [n], n
        while parent.get(x) in parent and parent.get(x) is not None and len(path) <= len(parent):
            x = parent[x]
            path.append(x)
        out[n] = ("", -1, None) if len(path) > len(parent) else (x, len(path) - 1, path[::-1])
    return out


def test_random_forest_with_rings_and_deep_chain(spark):
    rnd = random.Random(4)
    names = [f"n{i}" for i in range(120)]
    parent = {n: (rnd.choice(names[:i]) if i and rnd.random() < 0.8 else None) for i, n in enumerate(names)}
    parent |= {f"c{i}": f"c{i - 1}" if i else "n3" for i in range(40)}  # a deep chain
    parent |= {"r0": "r2", "r1": "r0", "r2": "r1", "below": "r1", "self": "self", "lost": "gone"}
    df = spark.createDataFrame([(n, p, 1, "x") for n, p in parent.items()], "node string, parent string, up int, root_id string")
    got = {r.node: (r.root_id, r.depth, r.path) for r in hierarchy(df, "node", "parent").collect()}
    assert got == brute(parent)
    flat = {r.node: (r.root_id, r.depth) for r in hierarchy(df, "node", "parent", with_path=False).collect()}
    assert flat == {k: v[:2] for k, v in got.items()}


def test_pairs_nulls_repeats_and_empty(spark, rows):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("b", "a"), (None, "a"), ("c", "b")], "id string, p string")
    tree = hierarchy(df, "id", "p")
    assert rows(ancestor_pairs(tree)) == [("a", "b", 1), ("a", "c", 2), ("b", "c", 1)]
    assert hierarchy(df.limit(0), "id", "p").count() == 0


def test_hot_parent(spark):
    df = spark.createDataFrame([("root", None)] + [(f"k{i}", "root") for i in range(3000)], "id string, p string")
    assert hierarchy(df, "id", "p", with_path=False).filter("depth = 1 and root_id = 'root'").count() == 3000
