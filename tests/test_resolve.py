import random

import pytest

from memspark.operators import resolve
from memspark.plans import text_queries


def invented(n: int, seed: int) -> list[str]:
    rnd = random.Random(seed)
    return sorted({"".join(rnd.choice("bdfgklmnprstvz") + rnd.choice("aeiou") for _ in range(7)) for _ in range(n)})


@pytest.fixture()
def little_to_the_driver(spark):
    """No table of more than 40 MB may be sent to all tasks; Spark counts any as 32 MB or more."""
    limit = "spark.sql.maxBroadcastTableSize"
    spark.conf.set(limit, "40m")
    yield
    spark.conf.unset(limit)


def stored(spark, folder, names: list[str], targets: list[str]) -> str:
    spark.createDataFrame([(f"e{i}", x) for i, x in enumerate(names)], "entity_id string, canonical_name string").write.parquet(f"{folder}/entity_registry.parquet")
    spark.createDataFrame([(f"k{i}", "a", x, "leads_to", 1.0, 1) for i, x in enumerate(targets)], "edge_id string, source string, target string, edge_type string, weight double, timestamp_ms long").write.parquet(f"{folder}/edges.parquet")
    return str(folder)


def test_proposals_send_no_names_with_their_keys_to_the_driver(spark, tmp_path, little_to_the_driver):
    names = invented(6000, 3)
    got = text_queries.merge_proposals(spark, stored(spark, tmp_path, names, ["x" + x for x in names])).collect()
    assert {(r.name, r.resolved, r.method, r.priority) for r in got} == {("x" + x, x, "similar", 3) for x in names}


def test_names_resolve_with_little_sent_to_the_driver(spark, tmp_path, little_to_the_driver):
    names = invented(6000, 5)
    got = text_queries.resolve_similar(spark, stored(spark, tmp_path, names, [*names[:9], "qq", *("x" + x for x in names)])).collect()
    assert {(r.name, r.resolved, r.method) for r in got} == {*((x, x, "exact") for x in names[:9]), ("qq", None, "none"), *(("x" + x, x, "similar") for x in names)}
    assert len(got) == len(names) + 10


def test_names_resolve_with_no_table_sent_to_all_tasks(spark, tmp_path):
    names = invented(300, 9)
    folder = stored(spark, tmp_path, [*names, "Robert"], [*names[:9], "qq", "Rupert", *("x" + x for x in names)])
    limits = {"spark.sql.maxBroadcastTableSize": "1k", "spark.sql.autoBroadcastJoinThreshold": "1g"}
    for k, v in limits.items():
        spark.conf.set(k, v)
    try:
        got = text_queries.resolve_similar(spark, folder).collect()
    finally:
        for k in limits:
            spark.conf.unset(k)
    assert {(r.name, r.resolved, r.method) for r in got} == {*((x, x, "exact") for x in names[:9]), ("qq", None, "none"), ("Rupert", "Robert", "phonetic"), *(("x" + x, x, "similar") for x in names)}
    assert len(got) == len(names) + 11


def test_counted_letters_lose_no_pair(monkeypatch):
    rnd = random.Random(11)
    known = ["".join(rnd.choice("aabcdeeilnorst é猫") for _ in range(rnd.choice([*range(1, 30), 70, 280]))) for _ in range(250)]
    asked = []
    for x in known:
        y = list(x)
        for _ in range(1 + len(y) // 8):
            i = rnd.randrange(len(y))
            y[i : i + 1] = rnd.choice([[], [y[i], rnd.choice("aeinxz🙂")], [y[-1]]])
            y = y or ["a"]
        asked.append("".join(y))
    want = {(a, k, resolve.jaro_winkler(a, k)) for a in asked for k in known if resolve.jaro_winkler(a, k) >= resolve.NEAR}
    assert len(want) > 100
    for own, cells in ((resolve.OWN, resolve.CELLS), (3, 100)):
        monkeypatch.setattr(resolve, "OWN", own)
        monkeypatch.setattr(resolve, "CELLS", cells)
        assert set(resolve.near_pairs(asked, known)) == want


def test_similar_names_beyond_the_first_three_letters(spark):
    long = "".join(random.Random(1).choice("abcdefghij ") for _ in range(300))
    reg = spark.createDataFrame([(str(i), x) for i, x in enumerate(["Catherine", "Jonathan", "Zejadire", "Medor Latimeji", "ab" + long, "Quentin"])], "entity_id string, canonical_name string")
    asked = spark.createDataFrame([("katherine",), ("jnoathan",), ("zeejadire",), ("meedor latimeji",), ("ba" + long,), ("quintilian",)], "n string")
    got = {r.name[:9]: (r.resolved[:9], r.method) for r in resolve.resolve(asked, "n", reg, "entity_id", "canonical_name").collect() if r.method == "similar"}
    assert got == {"katherine": ("Catherine", "similar"), "jnoathan": ("Jonathan", "similar"), "zeejadire": ("Zejadire", "similar"), "meedor la": ("Medor Lat", "similar"), ("ba" + long)[:9]: (("ab" + long)[:9], "similar")}


def test_letter_keys_lose_no_pair():
    rnd = random.Random(7)
    names = ["".join(rnd.choice("aabcdeeilnorst é") for _ in range(rnd.choice([*range(2, 30), 70, 250, 280]))) for _ in range(600)]
    rank = {x: i for i, x in enumerate([(c, k) for k in (2, 1, 0) for c in "bcdlnorstiae"])}
    found = 0
    for name in names:
        for _ in range(12):
            x = list(name)
            for _ in range(rnd.randrange(1, 2 + len(x) // 5)):
                i = rnd.randrange(len(x))
                if rnd.random() < 0.4:
                    x.insert(i, rnd.choice("aeinxz"))
                elif rnd.random() < 0.5 and len(x) > 2:
                    x.pop(i)
                else:
                    j = min(i + 1, len(x) - 1)
                    x[i], x[j] = x[j], x[i]
            other = "".join(x)
            if name[:3] != other[:3] and resolve.jaro_winkler(name, other) >= resolve.NEAR:
                found += 1
                assert resolve.letter_keys(name, rank, True) & resolve.letter_keys(other, rank, False)
    assert found > 300
