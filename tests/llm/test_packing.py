import random
import sys
import zlib

import numpy as np
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from quillon.llm import packing, tokens


def test_differencing_is_a_partition():
    rng = random.Random(2)
    for k in (1, 2, 3, 7, 20):
        for n in (0, 1, 5, 60):
            sizes = [rng.randrange(1, 100) for _ in range(n)]
            windows = packing.difference(sizes, k)
            assert len(windows) <= k and sorted(i for w in windows for i in w) == list(range(n))


def test_differencing_example():
    # The two-way differences of 8, 7, 6, 5, 4 end in one of 2.
    sums = sorted(sum([8, 7, 6, 5, 4][i] for i in w) for w in packing.difference([8, 7, 6, 5, 4], 2))
    assert sums == [14, 16]


def test_count_rises_when_over_capacity():
    windows = packing.pack([6, 6, 6], 10)
    assert sorted(map(len, windows)) == [1, 1, 1]


def test_near_equal():
    rng = random.Random(4)
    sizes = [rng.randrange(1, 50) for _ in range(800)]
    sums = [sum(sizes[i] for i in w) for w in packing.pack(sizes, 1000)]
    assert max(sums) <= 1000 and max(sums) - min(sums) <= 20


def test_words_give_the_ids_of_texts():
    whole = Tokenizer.from_file(tokens.default_path())
    by_word = tokens.WordTokenizer(tokens.default_path(), most_words=5)
    for t in ["", "a  b\n\tc", "it's I'LL we've", "é é ́x", "<|endoftext|> y<|endoftext|>", "ΟΔΟΣ İ̇ ẞ ﬁ①", "x*** ÉÀß&&& (z) don't. rock'll! e<|endoftext|> f<. g|> h\"\\]", "x\x85y\x1c z　w", "q" * 300 + " " + "q" * 300]:
        assert by_word.ids(t) == np.array(whole.encode(t, add_special_tokens=False).ids, "<u4").tobytes()


def test_every_id_once(spark):
    rng = random.Random(1)
    rows = [(i, " ".join(rng.choice(["the", "of", "andere", "xyzzy"]) for _ in range(rng.randrange(0, 900)))) for i in range(60)]
    rows += [(60, None), (61, ""), (62, "word " * 9000), (None, "null id"), (3, "again"), (3, "again")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("start", F.lit("clash")).repartition(2)
    out = packing.pack_documents(df).collect()
    whole = Tokenizer.from_file(tokens.default_path())
    want = sorted(zlib.crc32(np.array(whole.encode(t or "", add_special_tokens=False).ids + [1], "<u4").tobytes()) for _, t in rows if _ != 3)
    docs, windows = {}, {}
    for r in out:
        assert len(r.ids) == 4 * r.length and r.length > 0
        windows.setdefault(r.sequence_id, []).append(r)
        if r.doc_id != 3:
            docs.setdefault(r.doc_id, []).append(r)
    got = []
    for pieces in docs.values():
        pieces.sort(key=lambda r: r.start)
        assert [r.start for r in pieces] == [sum(p.length for p in pieces[:i]) for i in range(len(pieces))]
        assert sum(p.length for p in pieces) == pieces[0].doc_tokens
        got.append(zlib.crc32(b"".join(p.ids for p in pieces)))
    assert sorted(got) == want
    for w in windows.values():
        w.sort(key=lambda r: r.offset)
        assert [r.offset for r in w] == [sum(p.length for p in w[:i]) for i in range(len(w))] and sum(p.length for p in w) <= 2048
    total = sum(r.length for r in out)
    assert len(windows) * 2048 < 1.12 * total + 4096


def test_no_rows(spark):
    assert packing.pack_documents(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_merges_sort_without_a_call_for_each_window():
    """Sorts by a Python function cost some 2 of 5 seconds of packing."""
    rng = random.Random(5)
    sizes = [rng.randrange(1, 1025) for _ in range(600)]
    calls = 0

    def count(frame, event, _):
        nonlocal calls
        calls += event == "call"

    sys.setprofile(count)
    try:
        windows = packing.pack(sizes)
    finally:
        sys.setprofile(None)
    assert sorted(i for w in windows for i in w) == list(range(600))
    assert calls < 20 * len(sizes)
