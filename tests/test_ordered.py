from pyspark.sql import functions as F

from memspark.operators.ordered import dense_order, neighbour


def test_dense_order_and_neighbours_over_block_edges(spark):
    df = spark.range(0, 500).select((F.col("id") * 7919 % 500).alias("v"))
    t, n = dense_order(df, "v")
    assert n == 500 and {(r.v, r.pos) for r in t.collect()} == {(i, i) for i in range(500)}
    for after, d in ((True, 1), (False, -1)):
        got = {r.v: r.x.v if r.x else None for r in neighbour(t, "pos", n, ["v"], "x", after, block=8).collect()}
        assert got == {i: i + d if 0 <= i + d < 500 else None for i in range(500)}
    sparse = t.filter("v % 37 = 0")
    got = {r.v: r.x.v if r.x else None for r in neighbour(sparse, "pos", n, ["v"], "x", block=8).collect()}
    assert got == {v: v + 37 if v + 37 < 500 else None for v in range(0, 500, 37)}
    assert dense_order(df.limit(0), "v")[1] == 0
