"""Not-modified revisit resolution for web archives.

A revisit record says that a page had not changed.  It is joined as of its time
to the latest earlier full response of its canonical URL; if the validators
agree, the response stands in for it, with the headers that a not-modified
answer may update taken from the revisit.  ``read_warc`` gives the records of
archive files as ``resolve`` takes them.

Status of a revisit: ``resolved``; ``no_earlier`` (no full response before it);
``mismatch`` (validators of the latest one differ); ``no_validator`` (nothing
to check); ``no_url`` or ``no_time``.  Entity tags are compared weakly, and
before dates, which are asked only if an entity tag is missing on either side;
digests of payloads, where records have them, are asked after both.

Scale.  Records are dealt by ranges of (URL, time), so captures of one URL, be
they a third of all, spread over many tasks in order of time.  Within a range a
running maximum finds the latest response; what a range needs from those before
it is the latest response of its first URL.  That is a running maximum again,
over two rows for each range: what its first URL asks for, and what its last
URL hands on.  Payloads stay where they are: the result refers to the
response's id.

Edge cases: null urls and times get their status.  A response at the same time
is not earlier.  Of responses at one time the greatest id counts.  Rows may
repeat.  Null headers are none; names are compared in lower case, of repeated
names the greatest value counts.  An empty table gives no rows.
"""

from __future__ import annotations

import gzip
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm.common import partitions, written

#: Headers that a not-modified answer updates.
PERMITTED = ("cache-control", "content-location", "date", "etag", "expires", "last-modified", "vary")
#: Query parameters that do not select content.
TRACKING = r"(utm_[^=]*|ref|gclid|fbclid|sessionid)(=.*)?"
_URL = r"^(?:[A-Za-z][A-Za-z0-9+.-]*://)?(?:[^/?#@]*@)?([^/?#]*)([^?#]*)(?:\?([^#]*))?"


def canonical_url(url: Column) -> Column:
    """Host in lower case without ``www.`` and default port; path without a
    final slash; other parameters than tracking ones, sorted; no scheme, no
    fragment."""
    host = F.regexp_replace(F.lower(F.regexp_extract(url, _URL, 1)), r"^www\.|:(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(url, _URL, 2), "/+$", "")
    parts = F.filter(F.split(F.regexp_extract(url, _URL, 3), "&"), lambda p: (p != "") & ~p.rlike("^" + TRACKING + "$"))
    query = F.array_join(F.sort_array(parts), "&")
    return F.when(url.isNotNull(), F.concat(host, F.when(path == "", "/").otherwise(path), F.when(query == "", "").otherwise(F.concat(F.lit("?"), query))))


def _headers(h: Column) -> Column:
    """Headers as an ordered list, names in lower case."""
    listed = F.sort_array(F.transform(F.map_entries(h), lambda e: F.struct(F.lower(e["key"]).alias("name"), F.coalesce(e["value"], F.lit("")).alias("value"))))
    unique = F.filter(F.transform(listed, lambda e, i: F.struct(e["name"].alias("name"), e["value"].alias("value"), i.alias("i"))), lambda e: (F.coalesce(F.get(listed, e["i"] + 1)["name"], F.lit("")) != e["name"]))
    out = F.transform(unique, lambda e: F.struct(e["name"].alias("name"), e["value"].alias("value")))
    return F.coalesce(out, F.array().cast("array<struct<name:string,value:string>>"))


def header(listed: Column, name: str) -> Column:
    return F.get(F.filter(listed, lambda e: e["name"] == name), 0)["value"]


def merged(response: Column, revisit: Column) -> Column:
    """The response's headers with the permitted ones of the revisit, sorted."""
    new = F.filter(revisit, lambda e: e["name"].isin(*PERMITTED))
    return F.sort_array(F.concat(F.filter(response, lambda e: ~F.exists(new, lambda x: x["name"] == e["name"])), new))


def _weak(tag: Column) -> Column:
    return F.regexp_replace(tag, "^W/", "")


def resolve(records: DataFrame) -> DataFrame:
    """Revisits with record_id, canonical_url, ts, refers_to, status and headers.

    ``records``: record_id (any type with an order), url string, ts long,
    revisit boolean (null counts as false), headers map<string, string>, and,
    if at hand, digest string, the payload's."""
    spark = records.sparkSession
    digest = F.col("digest") if "digest" in records.columns else F.lit(None)
    rows = records.select("record_id", canonical_url(F.col("url")).alias("canonical_url"), F.col("ts").cast("long"), F.coalesce("revisit", F.lit(False)).alias("revisit"), _headers(F.col("headers")).alias("headers"), digest.cast("string").alias("digest"))
    usable = F.col("canonical_url").isNotNull() & F.col("ts").isNotNull()
    rows = written(rows, "records")
    part = rows.where(usable).repartitionByRange(partitions(spark), "canonical_url", "ts").withColumn("part", F.spark_partition_id())
    dealt = written(part, "dealt")
    full = F.when(~F.col("revisit"), F.struct("ts", "record_id", "headers", "digest"))
    within = Window.partitionBy("part", "canonical_url").orderBy("ts").rangeBetween(Window.unboundedPreceding, -1)
    near = dealt.withColumn("latest", F.max(full).over(within)).where("revisit")
    # A row for each range, of its last URL, and one of its first.
    bounds = dealt.groupBy("part").agg(F.min("canonical_url").alias("first"), F.max("canonical_url").alias("last"))
    ends = dealt.join(F.broadcast(bounds.select("part", F.col("last").alias("canonical_url"))), ["part", "canonical_url"], "left_semi").groupBy("part", "canonical_url").agg(F.max(full).alias("end"))
    asks = bounds.select("part", F.col("first").alias("canonical_url"), F.lit(False).alias("hands"))
    steps = asks.unionByName(ends.withColumn("hands", F.lit(True)), allowMissingColumns=True)
    earlier = Window.partitionBy("canonical_url").orderBy("part", "hands").rowsBetween(Window.unboundedPreceding, -1)
    carried = steps.withColumn("carried", F.max("end").over(earlier)).where(~F.col("hands") & F.col("carried").isNotNull()).select("part", "canonical_url", "carried")
    found = near.join(F.broadcast(carried), ["part", "canonical_url"], "left").withColumn("response", F.coalesce("latest", "carried"))
    old, new = F.col("response.headers"), F.col("headers")
    tag_old, tag_new = _weak(header(old, "etag")), _weak(header(new, "etag"))
    date_old, date_new = header(old, "last-modified"), header(new, "last-modified")
    digest_old, digest_new = F.col("response.digest"), F.col("digest")
    status = (
        F.when(F.col("response").isNull(), "no_earlier")
        .when(tag_old.isNotNull() & tag_new.isNotNull(), F.when(tag_old == tag_new, "resolved").otherwise("mismatch"))
        .when(date_old.isNotNull() & date_new.isNotNull(), F.when(date_old == date_new, "resolved").otherwise("mismatch"))
        .when(digest_old.isNotNull() & digest_new.isNotNull(), F.when(digest_old == digest_new, "resolved").otherwise("mismatch"))
        .otherwise("no_validator")
    )
    done = found.withColumn("status", status).select(
        "record_id",
        "canonical_url",
        "ts",
        F.when(F.col("status") == "resolved", F.col("response.record_id")).alias("refers_to"),
        "status",
        F.when(F.col("status") == "resolved", merged(old, new)).otherwise(new).alias("headers"),
    )
    rest = rows.where(~usable & F.col("revisit")).select(
        "record_id", "canonical_url", "ts", F.lit(None).cast(records.schema["record_id"].dataType).alias("refers_to"), F.when(F.col("canonical_url").isNull(), "no_url").otherwise("no_time").alias("status"), "headers"
    )
    return done.unionByName(rest)


WARC = "record_id string, type string, url string, ts long, refers_to string, digest string, profile string, status int, headers map<string,string>, path string, offset long, length long"


def warc_records(raw: bytes) -> Iterator[dict]:
    """The records of an archive, plain or compressed, one after the other.

    A record is taken by its length, whatever its block holds.  ``offset`` is
    the place of the block in the plain file.  The headers are those of the
    HTTP answer.  What follows a record that is cut short is not read."""
    source = io.BytesIO(raw)
    stream = gzip.GzipFile(fileobj=source) if raw[:2] == b"\x1f\x8b" else source
    while True:
        try:
            line = stream.readline()
            while line in (b"\r\n", b"\n"):
                line = stream.readline()
            if not line.startswith(b"WARC/"):
                return
            named = _fields(stream)
            offset, length = stream.tell(), int(named.get("content-length", "0"))
            block = stream.read(length)
        except (EOFError, OSError, ValueError):
            return
        if len(block) < length:
            return
        out = {"named": named, "offset": offset, "length": length, "status": None, "headers": {}}
        if block.startswith(b"HTTP/"):
            answer = io.BytesIO(block)
            first = answer.readline().split()
            out["status"] = int(first[1]) if len(first) > 1 and first[1].isdigit() else None
            out["headers"] = _fields(answer)
        yield out


def _fields(stream: io.BufferedIOBase) -> dict[str, str]:
    """Header lines up to the empty one: names in lower case, values joined
    where a line goes on."""
    out: dict[str, str] = {}
    name = ""
    while (line := stream.readline()).strip():
        text = line.decode("utf-8", "replace").rstrip("\r\n")
        if text[0] in " \t" and name:
            out[name] += " " + text.strip()
        elif ":" in text:
            name, _, value = text.partition(":")
            name = name.strip().lower()
            out[name] = max(out.get(name, ""), value.strip())
    return out


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """Responses and revisits of the archives at ``path``, for ``resolve``.

    An archive is one row to Spark and one task's work, so its size (2 GB at
    most) bounds memory; archives are made in pieces of about 1 GB."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from datetime import datetime

        names = [f.split()[0] for f in WARC.split(", ")]
        types = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.map_(pa.string(), pa.string()), pa.string(), pa.int64(), pa.int64()]
        for batch in batches:
            for file, raw in zip(batch.column(0), batch.column(1)):
                rows = []
                for r in warc_records(raw.as_py()):
                    h = r["named"]
                    if h.get("warc-type") not in ("response", "revisit"):
                        continue
                    try:
                        ts = int(datetime.fromisoformat(h["warc-date"].replace("Z", "+00:00")).timestamp())
                    except (KeyError, ValueError):
                        ts = None
                    url = h.get("warc-target-uri")
                    rows.append((h.get("warc-record-id"), h["warc-type"], url.strip("<>") if url else None, ts, h.get("warc-refers-to"), h.get("warc-payload-digest"), h.get("warc-profile"), r["status"], list(r["headers"].items()), file.as_py(), r["offset"], r["length"]))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)
                        rows = []
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(run, WARC).withColumn("revisit", F.col("type") == "revisit")
