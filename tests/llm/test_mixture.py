import os

import pytest

from memspark.llm.mixture import budget_report, mixture, plan_budgets, shares_report, token_counts

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"


def test_budgets_go_to_siblings_first():
    leaves = [(("a", "x"), 100), (("a", "y"), 1000), (("b", "x"), 1000)]
    out = plan_budgets(leaves, {("a",): 0.5, ("b",): 0.5, ("a", "x"): 0.5, ("a", "y"): 0.5}, {}, 800)
    assert out == {("a", "x"): 100, ("a", "y"): 300, ("b", "x"): 400}
    out = plan_budgets(leaves, {("a",): 0.9, ("b",): 0.1}, {}, 2000)  # all of a is too little: b makes up for it
    assert sum(out.values()) == pytest.approx(2000) and out[("a", "x")] == 100 and out[("a", "y")] == 1000
    out = plan_budgets(leaves, {("a",): 0.5, ("b",): 0.5}, {"b": 2})
    assert out[("b", "x")] == pytest.approx(1100) and sum(out.values()) == pytest.approx(2200)
    assert plan_budgets([], {}, {}) == {(): 0.0}


def test_small_domains_run_short_and_their_siblings_take_over(spark):
    """source > domain > language: a shortage stays below the domain, then below the source."""
    rows = [("s", "web", "en", 900), ("s", "web", "de", 25), ("s", "web", "fr", 75), ("s", "book", "en", 36), ("t", "web", "en", 4000)]
    leaves = [(r[:3], r[3]) for r in rows]
    out = plan_budgets(leaves, {("s",): 0.5, ("t",): 0.5}, {}, 800, temper=0.5)
    assert out[("s", "book", "en")] == 36 and out[("s", "web", "de")] == 25  # both short
    assert sum(v for k, v in out.items() if k[0] == "s") == pytest.approx(400) and out[("t", "web", "en")] == pytest.approx(400)
    flat = plan_budgets(leaves, {("s",): 0.5, ("t",): 0.5}, {}, 800)
    assert flat[("s", "web", "de")] < 25 and flat != out
    counted = spark.createDataFrame([(*r, "x") for r in rows] + [("none", "a", "b", 9, "x"), ("s", None, None, 0, "x")], "source string, doc_kind string, lang string, n_tokens long, level string")
    rep = {r.path: r for r in budget_report(counted, ["source", "doc_kind", "lang"], {("s",): 0.5, ("t",): 0.5}, {}, 3000, 0.5).collect()}
    assert rep["s"].short == pytest.approx(464) and rep["t"].taken_over == pytest.approx(464) and rep["s > web > de"].budget == 25 and "none" not in rep


def test_shares_caps_and_seed(spark):
    rows = [(i, "big" if i % 3 else "small", "en" if i % 2 else None, 10 + i % 50, "clash") for i in range(3000)] + [(9001, "other", "en", 50, ""), (None, "big", "en", 50, ""), (9002, "big", "en", 0, ""), (9003, None, "en", 7, "")]
    df = spark.createDataFrame(rows, "doc_id long, source string, lang string, n_tokens long, rest string")
    args = (df, "doc_id", ["source", "lang"], {("big",): 0.3, ("small",): 0.7}, {"big": 1, "small": 3})
    a = sorted(tuple(r) for r in mixture(*args).collect())
    assert a == sorted(tuple(r) for r in mixture(*args).collect())
    assert a != sorted(tuple(r) for r in mixture(*args, seed=12).collect())
    tokens = {s: sum(r[3] * r[4] for r in a if r[1] == s) for s in ("big", "small")}
    assert abs(tokens["big"] / sum(tokens.values()) - 0.3) < 0.005
    assert max(r[4] for r in a if r[1] == "big") == 1 and max(r[4] for r in a if r[1] == "small") <= 3 and {r[0] for r in a} <= set(range(3000))
    w = spark.createDataFrame([("big", 0.4, 1), ("small", 0.6, 3), ("none", 0.0, 1)], "source string, target_share double, max_repeats int")
    rep = {r.source: r for r in shares_report(mixture(*args), "source", w).collect()}
    assert rep["none"].tokens == 0 and rep["small"].actual_share == pytest.approx(tokens["small"] / sum(tokens.values()))
    assert mixture(df.limit(0), *args[1:]).count() == 0


@pytest.mark.skipif(not os.path.exists(TOKENIZER), reason="no tokenizer file")
def test_tokens_of_whole_texts(spark):
    df = spark.createDataFrame([(1, "Hello world"), (2, None), (3, ""), (4, "ab " * 50_000)], "doc_id long, t string")
    got = {r.doc_id: r.n_tokens for r in token_counts(df, ["doc_id"], "t", TOKENIZER).collect()}
    assert got[1] == 2 and got[2] == got[3] == 0 and got[4] >= 50_000
