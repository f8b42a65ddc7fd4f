"""The pipeline's stages against brute force, on planted documents."""

import random

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")


def words(rng, n):
    return " ".join(f"w{rng.randrange(30000)}" for _ in range(n))


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    rng = random.Random(3)
    clean = [(i, "\n".join(words(rng, 40) for _ in range(3))) for i in range(40)]
    passage = words(rng, 60)
    rows = list(clean)
    rows += [(100, clean[0][1]), (101, "\n".join(words(rng, 40) for _ in range(2)) + "\n" + passage), (102, "\n".join(words(rng, 40) for _ in range(2)) + "\n" + passage)]
    base = words(rng, 300)
    rows += [(110, base), (111, base.replace("w1", "x1", 3)), (120, words(rng, 60) + " password=abcdef0123456789 " + words(rng, 5)), (130, "few"), (131, None), (132, "a b c " * 40)]
    path = tmp_path_factory.mktemp("sf")
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.repartition(3).write.parquet(str(path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i, _ in clean], "doc_id long, quality int, toxic int").write.parquet(str(path / "labels.parquet"))
    return str(path), dict(rows), {i for i, _ in clean}


def test_stages(spark, folder):
    path, rows, clean = folder
    docs = spark.read.parquet(f"{path}/documents.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, path)
        assert out.columns == docs.columns and out.dtypes == docs.dtypes
        docs = corpus_pipeline.written(out, name)
        seen[name] = {r.doc_id: r.text for r in docs.collect()}
        assert docs.count() == len(seen[name])
        assert all(r.n_chars == len(r.text) for r in docs.collect())
        assert clean <= set(seen[name]) and all(seen[name][i] == rows[i] for i in clean)
    assert not {130, 131, 132} & set(seen["quality"]) and {100, 101, 110, 111, 120} <= set(seen["quality"])
    # The copy loses all its lines, the repeated passage goes once, the near line goes.
    assert not {100, 111} & set(seen["lines"])
    assert seen["lines"][101] == rows[101] and seen["lines"][102] == "\n".join(rows[102].split("\n")[:2])
    assert "[secret]" in seen["secrets"][120] and "abcdef" not in seen["secrets"][120]
    pieces = corpus_pipeline.packing(spark, docs, path).collect()
    assert {r.doc_id for r in pieces} == set(seen["secrets"])
    for i in seen["secrets"]:
        own = sorted((r.start, r.length, r.doc_tokens) for r in pieces if r.doc_id == i)
        assert sum(n for _, n, _ in own) == own[0][2]


def test_near_duplicates_stage(spark):
    rng = random.Random(5)
    a, b = words(rng, 200), words(rng, 200)
    near = a.split(" ")
    near[50] = "other"
    rows = [(3, a, "en", "s", 1), (1, " ".join(near), "en", "s", 1), (2, b, "en", "s", 1), (5, b, "en", "s", 1), (4, "", "en", "s", 0), (6, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    assert sorted(r.doc_id for r in corpus_pipeline.near_duplicates(spark, docs, "").collect()) == [1, 2, 4, 6]


def test_names_that_clash(spark, folder):
    from pyspark.sql import functions as F

    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").withColumns({c: F.col("doc_id") for c in ("n_words", "removed", "base_spans", "kept", "set", "shingle")})
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, folder[0])
        assert out.columns == docs.columns and out.where("n_words <> doc_id OR removed <> doc_id OR base_spans <> doc_id OR kept <> doc_id").count() == 0
        docs = corpus_pipeline.written(out, "clash")


def test_run(spark, folder):
    assert corpus_pipeline.run(spark, folder[0]).count() > 0


def test_near_duplicates_with_repeated_and_null_ids(spark):
    rng = random.Random(6)
    a, b, c, d = (words(rng, 200) for _ in range(4))
    near = a.split(" ")
    near[50] = "other"
    rows = [(1, a, "en", "s", 1), (1, a, "en", "r", 1), (1, a, "en", "s", 1), (2, b, "en", "s", 1), (2, " ".join(near), "en", "s", 1)]
    rows += [(None, c, "en", "s", 1), (None, c, "en", "s", 1), (7, c, "en", "s", 1), (None, d, "en", "s", 1), (8, "", "en", "s", 0), (8, "", "en", "s", 0), (9, None, "en", "s", 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    got = corpus_pipeline.near_duplicates(spark, docs, "")
    assert got.dtypes == docs.dtypes
    # The row of id 2 that is like nothing stays although its namesake goes.
    want = [(1, a, "en", "r", 1), (2, b, "en", "s", 1), (None, c, "en", "s", 1), (None, d, "en", "s", 1), (8, "", "en", "s", 0), (8, "", "en", "s", 0), (9, None, "en", "s", 0)]
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str)


def test_empty_tables(spark, folder):
    docs = spark.read.parquet(f"{folder[0]}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs, folder[0]).collect() == []


def test_packing_keeps_ids_and_takes_clashing_columns(spark):
    import numpy as np
    from pyspark.sql import functions as F
    from tokenizers import Tokenizer

    from quillon.llm import tokens

    rows = [(1, "some words here"), (1, "some words here"), (2, None), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(7) for c in ("start", "length", "sequence_id", "offset", "ids", "ids_crc32")})
    out = corpus_pipeline.packing(spark, docs, "").collect()
    whole = Tokenizer.from_file(tokens.default_path())
    got = sorted((str(r.doc_id), np.frombuffer(bytes(r.ids), "<u4").tolist()) for r in out)
    assert got == sorted((str(i), whole.encode(t or "", add_special_tokens=False).ids + [1]) for i, t in rows)


def test_repeated_rows_through_all_stages(spark, folder):
    rng = random.Random(8)
    a, b = words(rng, 120), words(rng, 120)
    rows = [(1, a), (1, a), (2, a), (2, b), (None, b), (None, b)]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.written(stage(spark, docs, folder[0]), name)
    assert sorted((str(r.doc_id), r.text) for r in docs.collect()) == sorted([("1", a), ("None", b)])
