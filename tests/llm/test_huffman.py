import heapq
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import huffman, tokens


def optimal_cost(counts):
    heap = [c for c in counts if c]
    heapq.heapify(heap)
    cost = 0
    while len(heap) > 1:
        x = heapq.heappop(heap) + heapq.heappop(heap)
        cost += x
        heapq.heappush(heap, x)
    return cost


def test_lengths():
    rng = random.Random(1)
    for n in (2, 3, 50, 700):
        counts = np.array([int(rng.paretovariate(0.7)) % 10**6 if rng.random() < 0.9 else 0 for _ in range(n)])
        counts[:2] += 1
        for limit in (10, 20):
            lengths = huffman.code_lengths(counts, limit)
            assert lengths.max() <= limit and ((lengths > 0) == (counts > 0)).all()
            assert sum(2.0 ** -int(x) for x in lengths if x) == 1.0
        assert int((counts * huffman.code_lengths(counts, 20)).sum()) == optimal_cost(counts.tolist())


def test_limit_binds():
    counts = np.array([1, 1, 2, 3, 5, 8, 13, 21, 34, 55])
    # By hand: with four bits at most, the eight rarest take four bits.
    assert sorted(huffman.code_lengths(counts, 4).tolist())[-1] == 4
    assert (huffman.code_lengths(np.array([0, 7, 0])) == [0, 1, 0]).all()


def test_streams():
    rng = np.random.default_rng(3)
    for n in (0, 1, 255, 256, 257, 5000):
        ids = (rng.pareto(0.5, n) * 3).astype(np.int64) % 3000
        lengths = huffman.code_lengths(np.bincount(ids, minlength=3000))
        payload, bits, at = huffman.encode(ids, huffman.canonical(lengths), lengths)
        assert bits == int(lengths[ids].sum()) and len(payload) == (bits + 7) // 8
        assert (huffman.decode(payload, n, at, huffman.decoding_table(lengths)) == ids).all()


def test_documents(spark, monkeypatch, tmp_path):
    monkeypatch.setattr(huffman, "SEGMENT_IDS", 500)
    rng = random.Random(1)
    rows = [(i * 3 % 80, " ".join(rng.choice(["the", "of", "andere", "xyzzy"]) for _ in range(rng.randrange(0, 90)))) for i in range(80)]
    rows += [(80, None), (81, ""), (82, "word " * 3000), (None, "no id"), (83, "again"), (83, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("ids", F.lit("clash")).repartition(3)
    folder = str(tmp_path / "corpus")
    huffman.write_corpus(df, folder)
    whole = Tokenizer.from_file(tokens.default_path())
    at, want = 0, []
    for i, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or "")):
        ids = np.array(whole.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        want.append((i, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    # A reader has the folder alone, whatever the constants of its own time are.
    with monkeypatch.context() as other:
        other.setattr(huffman, "LIMIT", 12)
        other.setattr(huffman, "STRIDE", 7)
        back = huffman.read_corpus(spark.newSession(), folder)
        got = [(r.doc_id, r.start, r.n_tokens, zlib.crc32(r.ids)) for r in sorted(back.collect(), key=lambda r: r.start)]
    assert got == want
    assert spark.read.parquet(f"{folder}/segments").count() > 3
    head = huffman.read_header(spark, folder)
    assert (head.documents, head.ids, head.tokenizer) == (len(rows), at, "word_bpe_49k.json")


def test_segments_of_another_header(spark, tmp_path):
    for name, text in (("a", "one two three"), ("b", "quite other words")):
        huffman.write_corpus(spark.createDataFrame([(1, text)], "doc_id long, text string"), str(tmp_path / name))
    (tmp_path / "b" / "header").rename(tmp_path / "b" / "was")
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        huffman.read_corpus(spark, str(tmp_path / "b"))
    (tmp_path / "a" / "header").rename(tmp_path / "b" / "header")
    with pytest.raises(Exception, match="another header"):
        huffman.read_corpus(spark, str(tmp_path / "b")).collect()


def test_no_documents(spark):
    assert huffman.roundtrip(spark.createDataFrame([], "doc_id long, text string")).collect() == []
