import random

import pytest

from memspark.llm.cutoffs import cut_rates, cut_texts, ending_of, fit_lengths


def corpus(n=3000, seed=3):
    rnd = random.Random(seed)
    names = ["".join(rnd.choice("bdfgklmn") + rnd.choice("aeiou") for _ in range(3)).capitalize() for _ in range(60)]
    things = [f"{a}{b}" for a in ("red", "blue", "old", "new", "warm") for b in ("lamp", "table", "garden", "ticket", "violin", "bridge")]
    say = [lambda: f"{rnd.choice(names)} bought the {rnd.choice(things)} near {rnd.choice(names)} before lunch.", lambda: f"The {rnd.choice(things)} costs approx. {rnd.randrange(99)} dollars at {rnd.choice(names)}.",
           lambda: f"Everyone in {rnd.choice(names)} knows {rnd.choice(names)} for the {rnd.choice(things)}."]
    end = ["", "\n\nCheers,\n{}", "\n\nTerms: {}, {}", "\n- ask {}"]
    rows, cut = [], set()
    for i in range(n):
        t = " ".join(rnd.choice(say)() for _ in range(rnd.randrange(2, 14)))
        t += rnd.choice(end).format(*[rnd.choice(names) for _ in range(2)])
        src = ["Limit", "limit ", "free"][i % 3]
        if src != "free" and len(t) > 400:
            if t[399].isalpha() or t[398].isalpha() and t[399] == " ":
                cut.add(i)
            t = t[:400]
            if not (t.rstrip()[-1:].isalpha()):
                cut.discard(i)
                t = t.rstrip()[:-1] + "."
        elif rnd.random() < 0.05:
            k = rnd.randrange(10, len(t) // 2)
            while not t[k - 1].isalpha() or not t[k].isalpha():
                k += 1
            t = t[:k] + rnd.choice(["", "…", " [truncated]", "\n"])
            cut.add(i)
        rows.append((i, t, src, "clash"))
    return rows, cut


def test_held_out_accuracy(spark):
    rows, cut = corpus()
    df = spark.createDataFrame(rows + [(9001, None, "free", ""), (None, "x", "free", ""), (9002, "", "free", ""), (9003, " \n", None, "")], "doc_id long, text string, source string, src string")
    out = cut_texts(df, "doc_id", "text", "source")
    got = {r.doc_id for r in out.filter("cut").collect()}
    assert not got & {9001, 9002, 9003}
    assert len(got & cut) / len(cut) > 0.93 and len(got & cut) / len(got) > 0.93
    rates = {r.source: r.cut_rate for r in cut_rates(out).collect()}
    assert set(rates) == {"", "free", "limit"} and rates["limit"] > 2 * rates["free"]


def test_censored_fit_beats_the_plain_mean():
    import math

    rnd = random.Random(0)
    logs = [rnd.gauss(6.5, 0.6) for _ in range(20_000)]
    limit = math.log(800)
    free = [x for x in logs if x < limit]
    fit = fit_lengths(len(free), sum(free), sum(x * x for x in free), {("c", 800): len(logs) - len(free)})
    assert fit.mean == pytest.approx(6.5, abs=0.03) and fit.sd == pytest.approx(0.6, abs=0.03)
    assert fit.limits["c", 800] > 0.95


def test_marks():
    assert ending_of("and then [truncated]\n\n") == ("and then", "cut") and ending_of("well…\r\n") == ("well", "dots")
    assert ending_of("fine.") == ("fine.", "") and ending_of("f�")[1] == "cut" and ending_of("") == ("", "")


def test_empty(spark):
    assert cut_texts(spark.createDataFrame([], "doc_id long, text string, source string"), "doc_id", "text", "source").count() == 0


def test_rare_words_and_contexts_count_on_large_input(spark):
    from pyspark.sql import functions as F

    rows, _ = corpus(1500)
    rows += [(8000 + i, "We met Quorvabel, Tamsiwick and Odrenhal there. Everyone knows Quorvabel, Tamsiwick and Odrenhal, and we wrote to Quorvabel.\n\nCheers,\nQuorvabel", "free", "") for i in range(2)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, src string").select("doc_id", "text", "source")
    blank = spark.range(64).select((F.col("id") + 10_000).alias("doc_id"), F.expr("repeat(' ', 1000000)").alias("text"), F.lit("blank").alias("source"))
    small, large = ({r.doc_id: r.evidence for r in cut_texts(x, "doc_id", "text", "source").collect()} for x in (df, df.unionByName(blank)))
    assert {i: e for i, e in large.items() if i < 10_000} == pytest.approx(small)
    assert small[8000] < 0 and large[8000] < 0
