import gzip
import random

from pyspark.sql import functions as F

from quillon.llm import revisits


def test_canonical_urls(spark):
    cases = {
        "HTTP://www.Example.com:80/a/b/?utm_source=x&z=1&a=2#top": "example.com/a/b?a=2&z=1",
        "https://example.com": "example.com/",
        "https://user@example.com:443/?ref=x": "example.com/",
        "example.com/x//": "example.com/x",
        "": "/",
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in cases], "url string").select("url", revisits.canonical_url(F.col("url")).alias("c"))
    assert {r.url: r.c for r in df.collect()} == cases


def brute(rows):
    out = []
    for i, u, ts, rev, h in rows:
        if not rev:
            continue
        h = {k.lower(): v for k, v in (h or {}).items()}
        if u is None or ts is None:
            out.append((i, None, "no_url" if u is None else "no_time", h))
            continue
        past = [(t, j, g) for j, v, t, r, g in rows if not r and v == u and t is not None and t < ts]
        if not past:
            out.append((i, None, "no_earlier", h))
            continue
        _, j, g = max(past, key=lambda p: p[:2])
        g = {k.lower(): v for k, v in (g or {}).items()}
        names = [n for n in ("etag", "last-modified") if n in g and n in h]
        same = names and g[names[0]].removeprefix("W/") == h[names[0]].removeprefix("W/")
        status = "no_validator" if not names else "resolved" if same else "mismatch"
        if same:
            out.append((i, j, status, g | {k: v for k, v in h.items() if k in revisits.PERMITTED}))
        else:
            out.append((i, None, status, h))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    rows = []
    for i in range(400):
        h = {}
        if rng.random() < 0.7:
            h["ETag"] = rng.choice(["", "W/"]) + rng.choice("ab")
        if rng.random() < 0.6:
            h["Last-Modified"] = rng.choice("xy")
        if rng.random() < 0.5:
            h["Content-Type"] = rng.choice("tu")
        url = rng.choice(["hot.com/"] * 6 + [f"h{k}.com/p" for k in range(20)] + [None])
        rows.append((i, url, rng.choice([rng.randrange(150)] * 20 + [None]), rng.choice([True, False, None]), h or None))
    rows.append(rows[3])
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, revisit boolean, headers map<string,string>").withColumn("part", F.lit("clash")).repartition(4)
    got = [(r.record_id, r.refers_to, r.status, {e.name: e.value for e in r.headers}) for r in revisits.resolve(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def test_one_url_over_many_ranges(spark):
    rows = [(i, "hot.com/", i, i % 37 != 0, {"ETag": "a"} if i % 74 else {"ETag": "b"}) for i in range(600)]
    df = spark.createDataFrame(rows, "record_id long, url string, ts long, revisit boolean, headers map<string,string>").repartition(5)
    got = [(r.record_id, r.refers_to, r.status, {e.name: e.value for e in r.headers}) for r in revisits.resolve(df).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


def archive(records):
    out = []
    for named, block in records:
        head = "".join(f"{k}: {v}\r\n" for k, v in named.items())
        out.append(f"WARC/1.0\r\n{head}Content-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n")
    return out


def test_archives(spark, tmp_path):
    def record(kind, i, day, answer, **more):
        named = {"WARC-Type": kind, "WARC-Record-ID": f"<urn:{i}>", "WARC-Target-URI": "http://Example.com/a", "WARC-Date": f"2020-01-0{day}T00:00:00Z"} | {k.replace("_", "-"): v for k, v in more.items()}
        return named, answer

    page = b'HTTP/1.1 200 OK\r\nETag: "x"\r\nX-Long: one\r\n  two\r\n\r\n<pre>\r\n\r\nWARC/1.0\r\nWARC-Type: response\r\n\r\n</pre>\x00\xff'
    records = [
        record("warcinfo", 0, 1, b"software: none"),
        record("response", 1, 1, page, WARC_Payload_Digest="sha1:A"),
        record("request", 2, 1, b"GET / HTTP/1.1\r\n\r\n"),
        record("revisit", 3, 2, b'HTTP/1.1 304 Not Modified\r\nETag: W/"x"\r\nDate: now\r\n\r\n', WARC_Refers_To="<urn:1>"),
        record("revisit", 4, 3, b"", WARC_Payload_Digest="sha1:A", WARC_Profile="identical-payload-digest"),
        record("revisit", 5, 4, b"", WARC_Payload_Digest="sha1:B"),
        ({"WARC-Type": "revisit", "WARC-Record-ID": "<urn:6>"}, b""),
    ]
    parts = archive(records)
    (tmp_path / "plain.warc").write_bytes(b"".join(parts) + b"WARC/1.0\r\nWARC-Type: response\r\nContent-Length: 99\r\n\r\ncut short")
    (tmp_path / "packed.warc.gz").write_bytes(b"".join(gzip.compress(p) for p in parts))
    (tmp_path / "empty.warc").write_bytes(b"")
    for name in ("plain.warc", "packed.warc.gz"):
        found = revisits.read_warc(spark, str(tmp_path / name))
        rows = {r.record_id: r for r in found.collect()}
        assert set(rows) == {f"<urn:{i}>" for i in (1, 3, 4, 5, 6)}
        assert rows["<urn:1>"].headers["x-long"] == "one two" and rows["<urn:1>"].status == 200 and rows["<urn:1>"].length == len(page)
        got = {r.record_id: (r.status, r.refers_to, {e.name: e.value for e in r.headers}) for r in revisits.resolve(found).collect()}
        assert got["<urn:3>"] == ("resolved", "<urn:1>", {"date": "now", "etag": 'W/"x"', "x-long": "one two"})
        assert got["<urn:4>"][:2] == ("resolved", "<urn:1>") and got["<urn:5>"][:2] == ("mismatch", None) and got["<urn:6>"][:2] == ("no_url", None)
    assert revisits.read_warc(spark, str(tmp_path / "empty.warc")).collect() == []


def test_no_rows(spark):
    assert revisits.resolve(spark.createDataFrame([], "record_id long, url string, ts long, revisit boolean, headers map<string,string>")).collect() == []
