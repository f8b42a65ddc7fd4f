import numpy as np
from pyspark.sql import functions as F

from quillon.llm import topk


def test_bounds_hold():
    rng = np.random.default_rng(1)
    for dim in (1, 3, 16, 50):
        q, d = rng.integers(-64, 64, (20, dim)).astype(float), rng.integers(-64, 64, (30, dim)).astype(float)
        exact, last = q @ d.T, np.inf
        for s in topk.LEVELS:
            bound = np.hstack(topk.statistics(q, s)) @ np.hstack(topk.statistics(d, s)).T
            assert (bound >= exact - 1e-6).all()
            assert bound.sum() <= last + 1e-6  # finer levels are no looser
            last = bound.sum()


def test_groups_bound_their_vectors():
    rng = np.random.default_rng(4)
    for dim in (1, 5, 16, 40):
        q, parts = rng.normal(0, 3, (20, dim)), [rng.normal(rng.normal(), 2, (9, dim)) for _ in range(4)]
        rows = []
        for g, x in enumerate(parts):
            mean, dev = topk.statistics(x, topk.LEVELS[-1])
            rows.append((g, mean.min(0).tobytes(), mean.max(0).tobytes(), dev.max(0).tobytes()))
        bounds = topk.Groups(rows).bounds(q)
        for g, x in enumerate(parts):
            assert (bounds[:, g] >= (q @ x.T).max(1) - 1e-9).all()


def test_thresholds_leave_ties():
    rng = np.random.default_rng(5)
    q, x = rng.integers(-3, 3, (6, 8)).astype(float), rng.integers(-3, 3, (400, 8)).astype(float)
    ids, names = np.arange(400), np.arange(6) * 50
    for least in (np.full(6, -np.inf), np.sort(q @ x.T, axis=1)[:, -30]):
        who, which, score = topk.block_top(names, q, least, ids, x, 10)
        want = [(int(a), int(j), float(v)) for a, row in zip(names, q @ x.T) for v, j in sorted(((v, j) for j, v in enumerate(row) if j != a), key=lambda p: (-p[0], p[1]))[:10]]
        assert list(zip(who.tolist(), which.tolist(), score.tolist())) == want


def test_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(topk, "VECTOR_BLOCK", 37)
    monkeypatch.setattr(topk, "QUERY_BLOCK", 3)
    monkeypatch.setattr(topk, "SMALL", 20)
    rng = np.random.default_rng(2)
    centres = rng.normal(0, 1, (5, 24))
    rows = [(i, [float(x) for x in (centres[i % 5] + rng.normal(0, 0.3, 24))]) for i in range(200)]
    rows += [(200, rows[0][1]), (40, rows[7][1]), (220, None), (240, []), (260, [None] * 24), (280, [float("nan")] * 24), (300, [float("inf")] * 24), (320, [1.0, 2.0]), (321, [0.5, 0.25]), (None, rows[1][1])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("v", F.lit("clash")).repartition(3)
    vectors = df.where(topk.usable(F.col("vec_id"), F.col("embedding"))).select(F.col("vec_id").alias("id"), topk.whole_numbers(F.col("embedding")).alias("v"))
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(vectors, vectors.where("id % 20 = 0"), 6).collect())
    good = [(i, np.floor(np.array(v) * 64)) for i, v in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    want = []
    for q, a in [g for g in good if g[0] % 20 == 0]:
        best = sorted((-int(a @ b), i) for i, b in good if i != q and len(a) == len(b))
        # A repeated query asks twice for the same and shares its ranks.
        want.append((q, best[:6]))
    flat = sorted((q, k + 1, i, -s) for q, best in want if q != 40 for k, (s, i) in enumerate(best))
    assert [g for g in got if g[0] != 40] == flat
    assert len([g for g in got if g[0] == 320]) == 1


def test_numbers_are_packed_exactly():
    rng = np.random.default_rng(6)
    for data, width in ((rng.integers(-127, 128, (5, 3)), 1), (rng.integers(-300, 300, (5, 3)) + 256, 2), (np.full((5, 3), 1 << 20), 4), (np.full((5, 3), 0.5), 8), (np.full((5, 3), 2.0**40), 8)):
        raw = topk.packed(data.astype(float))
        assert len(raw) == 15 * width and (topk.unpacked(raw, 5, 3) == data).all()


def test_dense_blocks_and_repeated_ids():
    rng = np.random.default_rng(7)
    for top in (60, 100_000):  # products that 32 bits hold, and others
        q, x = rng.integers(-top, top, (9, 16)), rng.integers(-top, top, (700, 16))
        x[300:340] = x[0]
        ids, names = np.arange(700) // 2, np.arange(9) * 10
        who, which, score = topk.block_top(names, q, np.full(9, -np.inf), ids, x, 5)
        want = []
        for a, row in zip(names, q @ x.T):
            want += [(int(a), int(j), float(v)) for v, j in sorted(((v, j) for v, j in zip(row, ids) if j != a), key=lambda p: (-p[0], p[1]))[:5]]
        assert list(zip(who.tolist(), which.tolist(), score.tolist())) == want


def test_no_block_goes_through_the_driver(spark):
    # Copies are small on disk, and as queries to every group large in memory.
    blocks = spark.range(8).selectExpr("1 dim", "cast(id as int) grp", "binary('') ids", "binary('') data")
    asked = spark.range(8).selectExpr("1 dim", "cast(id as int) grp", "binary('') q_ids", "binary('') q_data", "binary('') q_t")
    assert "Broadcast" not in topk.met(asked, blocks, 2)._jdf.queryExecution().executedPlan().toString()


def test_queries_go_in_turns(spark, monkeypatch):
    rng = np.random.default_rng(8)
    rows = [(i, [float(v) for v in rng.integers(-50, 50, 8)]) for i in range(300)]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    monkeypatch.setattr(topk, "SMALL", 20)
    monkeypatch.setattr(topk, "SENT", 0.01)
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in topk.top_k(df, df.where("id % 20 = 0"), 4).collect())
    x = np.array([v for _, v in rows])
    want = []
    for a in range(0, 300, 20):
        best = sorted((-int(x[a] @ x[j]), j) for j in range(300) if j != a)[:4]
        want += [(a, n + 1, j, -s) for n, (s, j) in enumerate(best)]
    assert got == want


def test_no_rows(spark):
    vectors = spark.createDataFrame([], "id long, v array<double>")
    assert topk.top_k(vectors, vectors, 5).collect() == []
