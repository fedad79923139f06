import os
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from touchline.llm import gam, outliers, toxicity

W = re.compile(r"[^\x20\x09-\x0D]+")


def _counts(t):
    w, seen, cover = W.findall(t or ""), {}, set()
    for i in range(len(w) - 4):
        seen.setdefault(tuple(w[i : i + 5]), []).append(i)
    for v in seen.values():
        if len(v) > 1:
            cover.update(p for i in v for p in range(i, i + 5))
    lines = [x for x in (t or "").split("\n") if W.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t or "")), len(lines) - len(set(lines)), len(cover)


def test_base_counts_equal_brute_force(spark, docs, corpus, nothing):
    extra = [(900, "a b c d e a b c d e x a b c d e", "en", "a", 0, "", 0.0, ""), (901, "a a a a a a a a a a a a", None, None, 0, "", 0.0, ""), (902, "#*$ %&|<> l\nl\n\nl", "en", "a", 0, "", 0.0, "")]
    rows = outliers.judge(docs.unionByName(spark.createDataFrame(extra, docs.schema)), ["doc_id", "score"]).collect()
    got = sorted((str(r["doc_id"]), r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows)
    assert got == sorted((str(r[0]), *_counts(r[1])) for r in corpus + extra)
    for r in rows:
        assert r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"])
    assert outliers.judge(nothing, ["doc_id"]).isEmpty() and outliers.clean(nothing).columns == nothing.columns


def test_outliers_go_and_clean_texts_stay(spark):
    rng = np.random.default_rng(0)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    clean = [(i, " ".join(word() for _ in range(rng.integers(40, 300))), "en", "a") for i in range(300)]
    junk = [(1000 + i, " ".join(word() + "***" for _ in range(80)), "en", "a") for i in range(15)]
    got = outliers.clean(spark.createDataFrame(clean + junk, "doc_id long, text string, lang string, source string"))
    kept = {r["doc_id"] for r in got.select("doc_id").collect()}
    assert kept == {r[0] for r in clean}


def _mcd(x, share, cov):
    """Concentration steps with exact quantiles, in numpy, until nothing changes: location, scatter, log-determinant."""
    mean = np.median(x, axis=0)
    h = max(int(np.ceil(share * len(x))), (len(x) + x.shape[1] + 1) // 2)
    for _ in range(100):
        d = np.einsum("ij,jk,ik->i", x - mean, np.linalg.inv(cov), x - mean)
        near = x[d <= np.sort(d)[h - 1]]
        mean, cov = near.mean(axis=0), np.cov(near.T, bias=True) * outliers.consistency(share, x.shape[1])
    return mean, cov, np.linalg.slogdet(cov)[1]


def test_estimates_equal_concentration_steps_in_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.multivariate_normal([1, 2], [[1, 0.6], [0.6, 2]], 4000)
    x[:400] += 30
    df = spark.createDataFrame([("g", 1.0, float(a), float(b)) for a, b in x], "_group string, _weight double, p double, q double")
    r = outliers.estimates(df, {"p": 1e-4, "q": 1e-4}).first()
    found = r["_model"]
    spread = 1.4826 * np.median(np.abs(x - np.median(x, axis=0)), axis=0)
    starts = [np.array([[1, c], [c, 1]]) * np.outer(spread, spread) for c in (0.0, 0.3, -0.3, 0.6, 0.9)]
    mean, cov, logdet = min((_mcd(x, outliers.SHARE, s) for s in starts), key=lambda m: m[2])
    assert r["_n"] == 4000 and r["_h"] == 3000
    assert np.allclose(found["mean"], mean, atol=0.02) and np.allclose(np.linalg.inv(np.array(found["inv"])), cov, rtol=0.05)
    assert found["logdet"] <= logdet + 0.02  # no numpy start finds a lesser determinant
    assert np.allclose(mean, [1, 2], atol=0.1)  # the outliers don't shift it
    again = outliers.estimates(df.repartition(5), {"p": 1e-4, "q": 1e-4}).first()["_model"]
    assert np.allclose(again["mean"], found["mean"], rtol=1e-9)  # nor does the way that rows are dealt


def test_estimates_of_small_and_constant_groups(spark):
    rows = [("one", 1.0, 5.0, 5.0)] + [("two", 1.0, float(i), 0.0) for i in range(2)] + [("flat", 1.0, 1.0, 1.0)] * 40
    got = {r["_group"]: r for r in outliers.estimates(spark.createDataFrame(rows, "_group string, _weight double, p double, q double"), {"p": 0.1, "q": 0.1}).collect()}
    assert {k: (r["_n"], r["_h"]) for k, r in got.items()} == {"one": (1, 1), "two": (2, 2), "flat": (40, 30)}
    assert got["one"]["_model"]["mean"] == [5.0, 5.0] and got["two"]["_model"]["mean"] == [0.5, 0.0]
    assert np.isfinite(np.array(got["flat"]["_model"]["inv"])).all()


def test_cutoff_is_a_quantile():
    assert outliers.cutoff(0.05, 2) == pytest.approx(5.991, abs=1e-3) and outliers.cutoff(0.001, 6) == pytest.approx(22.458, abs=1e-3)


def _labelled(spark):
    rng = np.random.default_rng(2)
    word = lambda: "".join(rng.choice(["ta", "lo", "mi", "ne", "ru"], rng.integers(1, 4)))
    rows, bad = [], ("vilthing", "foulness")
    for i in range(400):
        ws = [word() for _ in range(rng.integers(20, 60))]
        toxic = int(i % 4 == 0)
        if toxic:
            ws[3], ws[9] = (b + word() for b in bad)
        rows.append((i, " ".join(ws), toxic))
    return spark.createDataFrame(rows, "doc_id long, text string, toxic int")


def test_toxicity_learns_stems_and_folds(spark, docs, nothing):
    df = _labelled(spark)
    lex = toxicity.learn(df, df.select("doc_id", F.col("toxic").alias("label")))
    probe = [(1, "ta lo vilthingne foulnesslo ta lo mi ne"), (2, "ta lo VILTH1NG f0uln355ta ta lo mi ne"), (3, "ta lo vіlthіng fоulness ta lo mi ne"), (4, "ta lo mi ne ru ta lo mi"), (5, None), (6, ""), (7, "ta " * 5000)]
    got = {r["doc_id"]: r["score"] for r in toxicity.score(spark.createDataFrame(probe, "doc_id long, text string"), lex, ["doc_id"]).collect()}
    assert all(got[i] >= 0.7 for i in (1, 2, 3)) and all(got[i] < 0.3 for i in (4, 5, 6, 7))
    spared = toxicity.Lexicon(lex.weights, ["vilthing box"], lex.curve)
    assert toxicity.hits(toxicity.fold("a vilthing box"), spared.automaton()) == (0, 0)
    assert toxicity.hits(toxicity.fold("a vilthing boxes"), spared.automaton())[1] == 1
    assert toxicity.score(docs, lex, ["doc_id", "n_chars"]).count() == docs.count()
    none = toxicity.learn(nothing, spark.createDataFrame([], "doc_id long, label int"))
    assert {r["score"] < 0.01 for r in toxicity.score(docs, none, ["doc_id"]).collect()} == {True}
    assert toxicity.clean(docs, spark.createDataFrame([(None, 1), (1, None)], "doc_id long, label int")).columns == docs.columns


def test_only_texts_go_through_python(spark, capsys):
    """Other columns may be of kinds that Arrow has not, and don't fill the batches that Python gets."""
    df = _labelled(spark).withColumn("doc", F.col("doc_id")).withColumn("apart", F.make_interval(F.lit(1)))
    kept = toxicity.clean(df, df.select("doc_id", F.col("toxic").alias("label")))
    assert kept.columns == df.columns and {r["toxic"] for r in kept.select("toxic").collect()} == {0} and kept.count() == 300
    kept.explain()
    assert capsys.readouterr().out.count("EvalPython [run(text#") == 1


def test_hits_equal_brute_force():
    rng = np.random.default_rng(9)
    words = ["bad", "badly", "worse", "worst", "box", "fine", "badge"]
    weights = {"badl": 2.0, "wors": 1.5, "worst": 3.0, "bad ": 1.0, "badg": 0.5}
    exceptions = ["bad box", "worse fine", "fine badge"]
    a = toxicity.Lexicon(weights, exceptions).automaton()
    for _ in range(200):
        text = f" {' '.join(rng.choice(words, rng.integers(1, 12)))} "
        best = {}
        for stem, w in weights.items():
            for at in range(len(text)):
                if text.startswith(f" {stem}", at):
                    best[at] = max(w, best.get(at, 0.0))
        spans = [(at, at + len(p) + 1) for p in exceptions for at in range(len(text)) if text.startswith(f" {p} ", at)]
        left = {s: w for s, w in best.items() if not any(x <= s < y for x, y in spans)}
        assert toxicity.hits(text, a) == (pytest.approx(sum(left.values())), len(left))


def test_short_words_are_learned_and_samples_bounded(spark):
    rows = [(i, f"ta lo {'xy' if i % 3 == 0 else 'xyz'} mi ne ru{i % 7}", int(i % 3 == 0)) for i in range(90)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    labels = df.select("doc_id", F.col("toxic").alias("label"))
    lex = toxicity.learn(df, labels)
    assert set(lex.weights) == {"xy "}
    many = df.unionByName(df).unionByName(df.withColumn("text", F.lit("zz")))
    got = toxicity.sample(many, labels, 50)
    assert got.count() == 50
    assert toxicity.sample(many, labels.unionByName(labels), 500).count() == 90


DATA = "/root/testdata/sf0.01"


@pytest.mark.skipif(not os.path.isdir(DATA), reason="the test tables aren't here")
@pytest.mark.parametrize("query, column, least", [(gam.query, "quality", (0.95, 0.95)), (toxicity.query, "toxic", (0.95, 0.8))])
def test_held_out_precision_and_recall(spark, query, column, least):
    """Of the rows that are marked 1; always answering the commoner label would reach neither."""
    rows = query(spark, DATA).where("held_out").join(spark.read.parquet(f"{DATA}/labels.parquet").where(f"{column} is not null"), "doc_id").select("predicted", column).collect()
    both = sum(p == y == 1 for p, y in rows)
    assert sum(y for _, y in rows) > 10 and both >= least[0] * sum(p for p, _ in rows) and both >= least[1] * sum(y for _, y in rows)


def test_words_longer_than_a_stem_are_told_apart(spark):
    head = "q" * toxicity.LONG
    rows = [(i, f"ta lo mi {head}{'bad' if i % 2 else 'fine'} ru", i % 2) for i in range(80)]
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    lex = toxicity.learn(df, df.select("doc_id", F.col("toxic").alias("label")))
    assert set(lex.weights) == {f"{head}bad "}


def test_additive_model_learns_an_interaction():
    rng = np.random.default_rng(3)
    x = rng.uniform(0, 1, (3000, 4))
    y = ((x[:, 0] > 0.5) ^ (x[:, 1] > 0.5)).astype(float)
    m = gam.fit(x[:2000], y[:2000])
    assert (1, 0) in [(i, j) for i, j, _ in m.pairs]
    assert np.mean((m.score(x[2000:]) > 0.5) == y[2000:]) > 0.9
    s = m.score(x)
    assert ((s >= 0) & (s <= 1)).all()
    assert gam.fit(x[:0], y[:0]).score(x).tolist() == pytest.approx([0.5] * len(x))


def test_quality_scores_every_row(spark, docs, nothing):
    labels = spark.createDataFrame([(i, i % 2) for i in range(50)] + [(None, 1), (999, 0), (3, None)], "doc_id long, label int")
    m = gam.learn(docs, labels)
    rows = gam.score(docs, m, ["doc_id", "text"]).collect()
    assert len(rows) == docs.count() and all(0 <= r["score"] <= 1 for r in rows)
    assert gam.score(nothing, m, ["doc_id"]).isEmpty()
    by_text = Counter((r["text"], r["score"]) for r in rows)
    assert len(by_text) == len({t for t, _ in by_text})  # a score is of the text alone
