import random
import zlib

from pyspark.sql import functions as F

from quillon.llm import sharding


def brute(groups, shards):
    """The least capacity by trying each sum of neighbours."""
    sums = sorted({sum(groups[i:j]) for i in range(len(groups)) for j in range(i + 1, len(groups) + 1)})
    for c in sums:
        used, room = 0, 0
        for g in groups:
            if g > c:
                break
            if g > room:
                used, room = used + 1, c
            room -= g
        else:
            if used <= shards:
                return c


def check(rows, out, shards):
    first, size = {}, {}
    k = lambda i: -(2**63) if i is None else i
    for i, t in rows:
        first[t] = min(first.get(t, 2**63), k(i))
        size[t] = size.get(t, 0) + len((t or "").encode()) + 8
    order = [size[t] for t in sorted(first, key=lambda t: first[t])]
    by = {}
    for r in out:
        by.setdefault(r.shard, []).append(r)
    assert sorted((r.doc_id if r.doc_id is not None else -1, r.text_crc32) for r in out) == sorted((i if i is not None else -1, zlib.crc32((t or "").encode())) for i, t in rows)
    for rs in by.values():
        assert sorted(r.slot for r in rs) == list(range(len(rs)))
    assert max(sum(r.size for r in rs) for rs in by.values()) == brute(order, shards)
    home = {}
    for r in out:
        home.setdefault(r.text_crc32, set()).add(r.shard)
    assert all(len(s) == 1 for s in home.values())


def test_least_capacity(spark, monkeypatch):
    monkeypatch.setattr(sharding, "CELLS", 8)  # so that the index is refined
    rng = random.Random(3)
    for case in range(3):
        texts = ["x" * rng.randrange(1, 60) + str(rng.randrange(30)) for _ in range(60)]
        rows = [(i, rng.choice(texts)) for i in range(90 + case)] + [(200, None), (None, "n"), (201, "")]
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("size", F.lit(1)).withColumn("group", F.lit("g"))
        null_and_empty = [(i, t) for i, t in rows if t is not None and t != ""]
        assert null_and_empty
        out = sharding.shard(df, 5).collect()
        # A null text and an empty one are one group: both have no bytes.
        check([(i, t or "") for i, t in rows], out, 5)


def test_hot_group_and_repeats(spark):
    rows = [(i, "copy") for i in range(50)] + [(i, f"t{i}" * 3) for i in range(50, 100)] + [(60, "t60" * 3)] * 2
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 4).collect()
    check(rows, out, 4)


def test_empty(spark):
    assert sharding.shard(spark.createDataFrame([], "doc_id long, text string"), 4).collect() == []


def test_ids_shared_by_texts(spark):
    rows = [(1, "a"), (1, "b"), (None, "c"), (None, "d"), (1, "a"), (2, "b")]
    out = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string"), 2).collect()
    assert len(out) == 6 and max(sum(r.size for r in out if r.shard == s) for s in (0, 1)) <= 36
