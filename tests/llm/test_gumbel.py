import math
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from quillon.llm import gumbel

V = gumbel.vocabulary(gumbel.default_path())


def segmentations(text):
    """All segmentations of an escaped text with log weights."""
    by_text = {p: i for i, p in V.text.items() if isinstance(p, str)}
    if not text:
        return [((), 0.0)]
    out = []
    for n in range(1, min(len(text), 16) + 1):
        if text[:n] in by_text:
            i = by_text[text[:n]]
            out += [((i, *rest), V.log_w[i] + w) for rest, w in segmentations(text[n:])]
    if text[0] not in by_text:
        raw = [int(V.byte[b]) for b in text[0].encode()]
        out += [((*raw, *rest), len(raw) * V.log_byte + w) for rest, w in segmentations(text[1:])]
    return out


def exact(text):
    found = segmentations(gumbel.SPACE + text.replace(" ", gumbel.SPACE)) if text else [((), 0.0)]
    total = math.log(sum(math.exp(w) for _, w in found))
    return {ids: w - total for ids, w in found}


def test_probabilities_are_exact():
    for text in ["abc", "the cat", "  a b ", "x①y", "a"]:
        want = exact(text)
        samples = gumbel.sample_batch([text], gumbel.row_keys([5], 1), 50, V)[0]
        seen = [tuple(s[3].tolist()) for s in samples]
        assert len(set(seen)) == len(seen) == min(50, len(want))
        for s, ids in zip(samples, seen):
            assert abs(s[0] - want[ids]) < 1e-9
            assert gumbel.decode(s[3], V) == text
        assert [s[1] for s in samples] == sorted((s[1] for s in samples), reverse=True)
        if len(want) <= 50:
            assert all(s[2] == 1.0 for s in samples)


def test_regions_of_tiny_shares_are_found():
    for text in ["Bank", "Clark", "Dark", "the Bank"]:
        want = exact(text)
        for key in range(8):
            samples = gumbel.sample_batch([text], gumbel.row_keys([key], 1), len(want) + 1, V)[0]
            assert {tuple(s[3].tolist()) for s in samples} == set(want)
            assert all(s[2] == 1.0 and abs(s[0] - want[tuple(s[3].tolist())]) < 1e-9 for s in samples)
            # With one left out, it is the reason why no score is 1.
            fewer = gumbel.sample_batch([text], gumbel.row_keys([key], 1), len(want) - 1, V)[0]
            kappa = min(s[1] for s in samples)
            assert all(abs(s[2] + math.expm1(-math.exp(min(s[0] - kappa, 700)))) < 1e-6 for s in fewer)


def test_draws_follow_probabilities():
    text, n = "the", 4000
    want = exact(text)
    got = gumbel.sample_batch([text] * n, gumbel.row_keys(list(range(n)), 7), 2, V)
    first = Counter(tuple(s[0][3].tolist()) for s in got)
    pairs = Counter((tuple(s[0][3].tolist()), tuple(s[1][3].tolist())) for s in got)
    for ids, log_p in want.items():
        p = math.exp(log_p)
        assert abs(first[ids] / n - p) < 5 * math.sqrt(p * (1 - p) / n) + 1e-3
        for other, log_q in want.items():
            if other != ids:
                q = p * math.exp(log_q) / (1 - p)
                assert abs(pairs[ids, other] / n - q) < 5 * math.sqrt(q * (1 - q) / n) + 1e-3
    # Weighted by inclusion, samples estimate sums over all segmentations.
    total = np.mean([sum(math.exp(r[0]) / r[2] for r in s) for s in got])
    assert abs(total - 1) < 0.1


def test_the_first_look_at_a_path_changes_no_sample(monkeypatch):
    texts = ["word " * 300, "x" * 700, "Some words here, " * 40 + "qqqqqqqq" * 60, "a b", "", " lead", "two  spaces and an end "]
    found = []
    for first in (gumbel.FIRST, 4, 1 << 30):
        monkeypatch.setattr(gumbel, "FIRST", first)
        found.append([[(*s[:3], s[3].tolist()) for s in samples] for samples in gumbel.sample_batch(texts, gumbel.row_keys(list(range(len(texts))), 3), 6, V)])
    assert found[0] == found[1] == found[2]


def test_walks_take_the_edges_that_their_noise_asks_for():
    chunks = [gumbel.SPACE + w for w in ("the", "transformation", "é𝕏", "qqqq")]
    lattice = gumbel.Lattice(chunks, V)
    keys = np.arange(1, 5, dtype=np.uint64)
    edges, steps = lattice.walk(lattice.start, lattice.end, keys)
    want = []
    for c, k in enumerate(keys):
        node, t = int(lattice.start[c]), 0
        while node < lattice.end[c]:
            u = gumbel._uniform(np.array([k]) + np.array([t], np.uint64) * gumbel._STEP[0])[0]
            e = int(lattice.first[node])
            while u >= lattice.upto[e]:
                e += 1
            want.append(e)
            node, t = int(lattice.target[e]), t + 1
        assert steps[c] == t
        assert lattice.ends[node]
    assert edges.tolist() == want


def test_later_tables_of_beginnings_stay_in_cache():
    assert all(keys.nbytes + ids.nbytes <= 1 << 19 for *_, keys, ids in V.tables[1:])


def test_documents(spark):
    rows = [(1, "Some words here, and more."), (2, None), (3, ""), (None, "null key"), (4, "long " * 3000 + "é\U0001d54f\n\ttail"), (1, "Some words here, and more."), (5, "q" * 3000), (6, "a▁b")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("sample", F.lit("clash")).repartition(3)
    out = gumbel.sample_segmentations(df, 3).collect()
    again = gumbel.sample_segmentations(df.repartition(2), 3, batch_chars=50).collect()
    key = lambda r: (r.doc_id is None, r.doc_id or 0, r.sample)
    assert [(r.doc_id, r.sample, bytes(r.ids)) for r in sorted(out, key=key)] == [(r.doc_id, r.sample, bytes(r.ids)) for r in sorted(again, key=key)]
    texts = {(r.doc_id, r.sample): r.text for r in gumbel.decode_segmentations(gumbel.sample_segmentations(df, 3)).collect()}
    for i, t in rows:
        n = sum(1 for d, _ in texts if d == i)
        assert n == (1 if not t else 3)
        assert all(x == (t or "").replace("▁", " ") for (d, _), x in texts.items() if d == i)
    for i in (1, 4, 5, None):
        got = [bytes(r.ids) for r in out if r.doc_id == i]
        assert len(set(got)) == 3


def test_no_rows(spark):
    assert gumbel.sample_segmentations(spark.createDataFrame([], "doc_id long, text string")).collect() == []
