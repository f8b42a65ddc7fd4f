import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillon.llm import quality


def brute(text):
    t = text or ""
    w = [x for x in re.split("[\x20\x09-\x0d]+", t) if x]
    lines = [x for x in t.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    grams = {}
    for i in range(len(w) - 2):
        grams.setdefault(tuple(w[i : i + 3]), []).append(i)
    covered = {i + j for at in grams.values() if len(at) > 1 for i in at for j in range(3)}
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered)


def texts():
    rng = random.Random(1)
    out = [None, "", " \n\t", "a", "a b c a b c", "a a a a a", "x\ny\nx\n \nx", "é𝕏 #$ é𝕏\x0bq", "w " * 20000]
    return out + [" ".join(rng.choice(["a", "b", "cc", "d\n", "#*"]) for _ in range(rng.randrange(1, 80))) for _ in range(80)]


def test_features(spark):
    rows = list(enumerate(texts()))
    df = spark.createDataFrame([*rows, rows[4]], "doc_id long, text string").withColumn("n_lines", F.lit("clash"))
    for r in quality.features(df).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == brute(r.text), repr(r.text)[:60]


def test_binomial_tail(spark):
    cases = [(n, k, 0.0125) for n in (0, 1, 7, 40, 300, 5000, 200_000) for k in (0, 1, 3, 20, 60, 2400) if k <= n]
    df = spark.createDataFrame([c[:2] for c in cases], "n long, k long")
    for r in df.withColumn("t", quality.binomial_tail(F.col("n"), F.col("k"), 0.0125)).collect():
        terms = [math.exp(math.lgamma(r.n + 1) - math.lgamma(i + 1) - math.lgamma(r.n - i + 1) + i * math.log(0.0125) + (r.n - i) * math.log1p(-0.0125)) for i in range(r.k + 1)]
        assert r.t == pytest.approx(min(1.0, sum(terms)), rel=1e-8, abs=1e-250)


def corpus(spark):
    rng = random.Random(2)
    rows = []
    for i in range(1600):
        bad = i % 8 == 0
        words = [f"w{rng.randrange(4000)}" + ("***" if bad else "") for _ in range(60)]
        rows.append((i, " ".join(words), "hot" if i % 3 else "rare" if i % 50 else None, int(not bad)))
    docs = spark.createDataFrame([r[:3] for r in rows] + [(5000, None, "hot"), (5001, "few words", None)], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(r[0], r[3], 0) for r in rows] + [(9999, 1, 0), (3, None, 0), (None, 1, 1)], "doc_id long, quality int, toxic int")
    return rows, docs, labels


def test_cutoffs_keep_the_good(spark):
    rows, docs, labels = corpus(spark)
    out = {r.doc_id: r for r in quality.quality_rules(docs, labels).collect()}
    assert all(out[i].kept for i, _, _, good in rows if good)
    # The large stratum has enough labels for a cutoff, the small ones may not.
    assert not any(out[i].kept for i, _, lang, good in rows if lang == "hot" and not good)
    assert out[5000].base_failed and not out[5000].kept and out[5001].base_failed


def test_guarantee_needs_labels(spark):
    rows, docs, labels = corpus(spark)
    few = labels.where("doc_id < 60")
    out = quality.quality_rules(docs, few).where("NOT base_failed").collect()
    assert all(r.kept for r in out)


def test_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert quality.quality_rules(docs, labels).collect() == []
