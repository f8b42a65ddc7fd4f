import random

from pyspark.sql import functions as F

from quillon.llm import lines


def brute(rows, similar):
    places = sorted(((-(2**63) if i is None else i), n, x) for i, t in rows if t is not None for n, x in enumerate(t.split("\n")))
    sets = [(i, n, s) for i, n, x in places if len(s := set(x.lower().split())) >= similar.min_tokens]
    kept = set()
    for k, (i, n, s) in enumerate(sets):
        if not any((j, m) < (i, n) and len(s & t) * similar.den >= len(s | t) * similar.num for j, m, t in sets[:k]):
            kept.add((i, n))
    out = {}
    for i, t in rows:
        if t is not None:
            key = -(2**63) if i is None else i
            out[i] = "\n".join(x for n, x in enumerate(t.split("\n")) if len(set(x.lower().split())) < similar.min_tokens or (key, n) in kept)
    return out


def near(rng, words, n):
    """A line, and variants of it in which some words differ."""
    base = [rng.choice(words) for _ in range(n)]
    while True:
        out = list(base)
        for _ in range(rng.randrange(0, 5)):
            out[rng.randrange(n)] = rng.choice(words)
        yield " ".join(out)


def corpus(seed):
    rng = random.Random(seed)
    words = [f"w{int(rng.paretovariate(0.6)) % 400}" for _ in range(600)]
    sources = [near(rng, words, rng.randrange(5, 40)) for _ in range(25)]
    rows = [(i, "\n".join(rng.choice([next(rng.choice(sources)), " ".join(rng.choices(words, k=rng.randrange(0, 30)))]) for _ in range(rng.randrange(1, 6)))) for i in range(60)]
    return rows + [(60, None), (61, ""), (62, "The Quick  brown\tfox jumps"), (63, "the quick brown fox JUMPS"), (None, "the quick brown fox jumps"), (64, "short line\nshort line")]


def test_against_all_pairs(spark):
    similar = lines.Similar()
    for seed in (1, 2):
        rows = corpus(seed)
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).withColumn("id", F.lit("clash")).withColumn("word", F.lit(1))
        got = {r.doc_id: r for r in lines.dedup_lines(df).collect()}
        want = brute(rows, similar)
        assert {i: r.text for i, r in got.items() if r.text is not None} == want
        assert got[60].n_lines == 0 and not got[60].removed and got[63].removed == [0] and not got[None].removed


def test_hot_words(spark, monkeypatch):
    monkeypatch.setattr(lines, "LARGE", 3)
    monkeypatch.setattr(lines, "LEADERS", 2)
    monkeypatch.setattr(lines, "SLOTS", 64)
    rng = random.Random(9)
    words = [f"v{i}" for i in range(40)]
    source = near(rng, words, 30)
    rows = [(i, next(source)) for i in range(120)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute(rows, lines.Similar())


def test_repeated_rows_and_none(spark):
    rows = [(1, "one two three four five"), (1, "one two three four five"), (2, "one two three four five\nx")]
    got = sorted((r.doc_id, r.text) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(1, ""), (1, "one two three four five"), (2, "x")]
    rows = [(1, "alpha beta gamma delta epsilon"), (5, "alpha beta gamma delta epsilon"), (5, "other words stay here"), (5, None), (None, "\n"), (None, "\n")]
    got = lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id or 0, r.text or "", r.removed) for r in got) == [(0, "\n", []), (0, "\n", []), (1, rows[0][1], []), (5, "", []), (5, "", [0]), (5, rows[2][1], [])]
    assert lines.dedup_lines(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_short_lines_take_part(spark):
    rows = [(1, "All rights reserved.\n\nmenu"), (2, "all RIGHTS  reserved.\nMenu\n \nfour words are here"), (3, "here are words four\n\nreserved. all\nrights reserved. all all"), (4, None)]
    got = {r.doc_id: (r.text, r.removed) for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[1] == (rows[0][1], []) and got[2] == (" \nfour words are here", [0, 1]) and got[3] == ("\nreserved. all", [0, 3])
    assert {i: t for i, (t, _) in got.items() if t is not None} == brute(rows, lines.Similar(min_tokens=1))
    spared = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string"), lines.Similar(min_tokens=5)).collect()}
    assert spared == dict(rows)


def test_sets_that_only_equal_ones_are_like(spark):
    for num, den in ((17, 20), (1, 2), (1, 1), (9, 10)):
        s = lines.Similar(num, den)
        got = {r.n: r.e for r in spark.range(1, 60).select(F.col("id").cast("int").alias("n")).withColumn("e", s.by_equality(F.col("n"))).collect()}
        for n, e in got.items():
            # A set within the other is most like it; of equal sizes, one that differs in one word.
            sizes = [m for m in range(1, 200) if m != n and min(n, m) * den >= max(n, m) * num]
            assert e == (not sizes and (n - 1) * den < (n + 1) * num), (num, den, n)


def test_what_stays_is_not_joined(spark):
    rows = spark.range(20_000).withColumnRenamed("id", "p").withColumn("x", F.col("p") * 2)
    keys = spark.range(0, 20_000, 10).withColumnRenamed("id", "p")
    out = lines._without(rows, keys, "p")
    assert sorted(r.p for r in out.collect()) == [i for i in range(20_000) if i % 10] and out.columns == ["p", "x"]
    assert lines._without(rows, keys.limit(0), "p").count() == 20_000
    # Of 18000 rows that stay, the join meets those alone that the bitmap can not tell.
    assert lines._marked(rows, keys, ["p"]).where("__may").count() < 2_000 + 18_000 // 8


def test_unlike_long_lines_are_no_candidates(spark):
    from quillon.llm.common import Scratch

    # All share their rarest word, and are long enough to fill a bitmap of 64 bits.
    rng = random.Random(3)
    rows = [(i, "rarest " + " ".join(f"w{rng.randrange(10**6)}" for _ in range(150))) for i in range(40)]
    rows += [(100 + i, t.rpartition(" ")[0] + " other") for i, t in rows[:5]]
    df = spark.createDataFrame(rows, "doc long, text string")
    with Scratch(spark, "test") as scratch:
        words_of = scratch.written(lines.word_sets(lines.lines_of(df)), "words")
        sets = lines._first_sets(words_of, bytes(lines.SLOTS), lines.Similar(1, 2), scratch)
        postings = lines._postings(sets)
        pairs = lines._candidates(postings, postings, lines.Similar(), scratch).collect()
    assert sorted((r.a >> lines.LINE_BITS, r.b >> lines.LINE_BITS) for r in pairs) == [(100 + i, i) for i in range(5)]


def test_postings_are_dealt_out_once(spark):
    plain = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    was = {k: spark.conf.get(k) for k in plain}
    class Planned:
        def written(self, df, *_):
            out = df.localCheckpoint()
            self.plan = df._jdf.queryExecution().executedPlan().toString()
            return out

    sets = spark.createDataFrame([(1, 9, 3, 0, [5, 6]), (2, 9, 3, 0, [5, 7])], "p long, n int, low long, high long, prefix array<long>")
    try:
        for k, v in plain.items():
            spark.conf.set(k, v)
        for x in (sets, sets.withColumn("look", F.col("p") > 0)):
            planned = Planned()
            postings = lines._postings(x)
            assert [tuple(r) for r in lines._candidates(postings, postings, lines.Similar(), planned, 1).collect()] == [(2, 1)]
            assert "ReusedExchange" in planned.plan
    finally:
        for k, v in was.items():
            spark.conf.set(k, v)


def test_ids_far_apart_and_repeated(spark):
    rng = random.Random(4)
    source = near(rng, [f"u{i}" for i in range(60)], 25)
    rows = [(rng.choice([-1, 1]) * rng.randrange(2**62) if i else 2**63 - 1, next(source) + "\n" + next(source)) for i in range(40)] + [(None, next(source)), (-(2**63) + 1, next(source))]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(rows, lines.Similar())
    near_ids = [(i + 2**62, t) for i, (_, t) in enumerate(rows)]
    got = {r.doc_id: r.text for r in lines.dedup_lines(spark.createDataFrame(near_ids, "doc_id long, text string").repartition(3)).collect()}
    assert got == brute(near_ids, lines.Similar())


def test_what_has_a_match_looks_no_more(spark):
    from quillon.llm.common import Scratch

    sets = spark.range(60_000).select(F.col("id").alias("p"), F.array(F.col("id")).alias("prefix"))
    gone = spark.range(0, 60_000, 2).withColumnRenamed("id", "p")
    with Scratch(spark, "test") as scratch:
        got = lines._looking(sets, gone, scratch)
        assert got.columns == ["p", "prefix", "look"] and got.count() == 60_000
        assert got.where(F.col("look") != (F.col("p") % 2 == 1)).isEmpty()
