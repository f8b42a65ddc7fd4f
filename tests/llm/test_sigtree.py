import random
import re
import tracemalloc

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import sigtree
from quillon.llm.common import Scratch
from quillon.llm.shingles import overlap, shingle_set


def words(text):
    return re.findall("[^\x20\x09-\x0d]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def shingles(text):
    w = words(text)
    return {tuple(w[i : i + 5]) for i in range(max(len(w) - 4, 1))} if w else set()


def brute(rows, num=3, den=4):
    sets = [(i, shingles(t)) for i, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(sets)):
        for y in range(x):
            a, b = sets[x][1], sets[y][1]
            if a and b and len(a & b) * den >= num * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    k = lambda i: -(2**63) if i is None else i
    for x, (i, _) in enumerate(sets):
        least[find(x)] = min(least.get(find(x), 2**63), k(i))
    back = lambda i: None if i == -(2**63) else i
    return [(i, len(s), back(least[find(x)])) for x, (i, s) in enumerate(sets)]


def test_shingle_sets():
    rng = random.Random(1)
    for t in ["", "  ", "One", "a b c d", "A  b\tc\nd\x0be", "é É x y z w", "a\x85b c d e f g"] + [" ".join(rng.choices("abc", k=40)) for _ in range(20)]:
        assert len(shingle_set(t.encode())) == len(shingles(t)), t
    x, y = " ".join(rng.choices("abcdef", k=60)), " ".join(rng.choices("abcdef", k=60))
    assert overlap(shingle_set(x.encode()), shingle_set(y.encode())) == len(shingles(x) & shingles(y))
    assert overlap(shingle_set((x + "\n" + y).encode()), shingle_set(x.upper().encode())) == len(shingles(x))


def test_tree_drops_no_similar_pair():
    rng = np.random.default_rng(4)
    base = [rng.integers(0, 2**63, 300).astype(np.uint64) for _ in range(4)]
    sets = []
    for _ in range(150):
        b = base[rng.integers(4)].copy()
        b[rng.random(300) < rng.choice([0.02, 0.1, 0.3])] = rng.integers(0, 2**63)
        sets.append(np.unique(b[: rng.integers(60, 300)]))
    n, comp = np.array([len(s) for s in sets]), np.array([i // 3 for i in range(150)])
    got = set(sigtree.tree_pairs(np.arange(150), n, comp, np.stack([sigtree.bitmap(s) for s in sets]), 3, 4))
    for i in range(150):
        for j in range(i):
            both = overlap(sets[i], sets[j])
            if comp[i] != comp[j] and both * 4 >= 3 * (n[i] + n[j] - both):
                assert (j, i) in got
    assert len(got) < 150 * 149 / 4


def corpus(seed):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    common = rng.choices(vocabulary, k=60)
    texts = []
    for _ in range(12):
        base = rng.choices(vocabulary, k=rng.randrange(8, 160))
        for _ in range(rng.randrange(1, 9)):
            t = list(base)
            for _ in range(rng.randrange(0, 1 + len(t) // 30)):
                t[rng.randrange(len(t))] = rng.choice(vocabulary)
            if rng.random() < 0.3:
                t += common
            texts.append(" ".join(t[: len(t) - rng.randrange(0, 1 + len(t) // 6)]))
    rows = list(enumerate(texts))
    n = len(rows)
    rows += [(n, None), (n + 1, ""), (n + 2, " \n"), (n + 3, "One two"), (n + 4, "one  TWO"), (n + 5, "one two three"), (None, texts[0]), (3, texts[3])]
    return rows


def test_against_all_pairs(spark, monkeypatch):
    monkeypatch.setattr(sigtree, "CELLS", 1 << 10)
    monkeypatch.setattr(sigtree, "CHUNK", 1 << 8)
    for seed, posting in ((1, 2048), (2, 4)):
        monkeypatch.setattr(sigtree, "POSTING", posting)
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("set", F.lit("clash")).withColumn("n", F.lit(0))
        got = [(r.doc_id, r.n_shingles, r.component_id) for r in sigtree.near_classes(df).collect()]
        assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 101)], "a long, b long")
    with Scratch(spark, "test") as scratch:
        got = {r.set: r.component for r in sigtree.components(links, scratch).collect()}
    assert got == {i: 0 for i in range(41)} | {100: 100, 101: 100}


def test_no_rows(spark):
    assert sigtree.near_classes(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_shared_postings(spark):
    rng = random.Random(3)
    for size in (3, 7, 10_000):
        rows = [(rng.randrange(12), rng.randrange(6)) for _ in range(60)] + [(50, 1), (51, 2), (51, 2), (52, 3), (52, 4)]
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
        df = spark.createDataFrame([(h, s, 10 * s) for h, s in rows], "shingle long, set long, n long")
        got = sorted(tuple(r) for r in sigtree.shared_postings(df).collect())
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
        by = {}
        for h, s in rows:
            by.setdefault(h, set()).add(s)
        assert got == sorted((h, s, 10 * s, min(ss), 10 * min(ss)) for h, ss in by.items() if len(ss) > 1 for s in ss)


def test_classes_take_little_of_the_driver():
    rng = np.random.default_rng(3)
    counts = np.minimum(rng.pareto(0.5, sigtree.CELLS) * 3, 2**32 - 1).astype(np.uint32)
    chunks = {i: b"W" + counts[i : i + sigtree.CHUNK].astype("<u4").tobytes() for i in range(0, sigtree.CELLS, sigtree.CHUNK)}
    tracemalloc.start()
    got = sigtree.levels(chunks)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    times = counts / max(4.0, 2 * float(counts.mean(dtype=float)))
    want = np.where(times >= 1, np.minimum(np.log2(np.maximum(times, 1)).astype(np.uint8) + 1, 60), 0).astype(np.uint8)
    assert got == want.tobytes() and peak < 16 << 20
    assert sigtree.levels({}) == bytes(sigtree.CELLS)
