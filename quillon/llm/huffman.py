"""Token files by canonical length-limited Huffman coding.

Counts over all ids of the corpus give code lengths of at most ``LIMIT`` bits
(package-merge); codes follow from lengths alone (canonical), so the lengths
are all that a reader needs.

Format.  A corpus is a folder of two Parquet tables, and all that a reader needs.
``header`` has one row: ``format`` (a name with a version), ``vocabulary``,
``limit``, ``stride``, ``end_id``, ``tokenizer`` (the file's name), the
``lengths`` of codes by id, a byte each, and ``documents`` and ``ids``, the
corpus's counts.  ``segments`` come in ascending document order, each with
``lengths_crc32``, which ties it to its header, and:

* ``file``, ``in_file``: order of the segments; those of a file follow each other,
  and ``in_file`` is the number of ids of its file before it.
* ``documents``: list of (doc_id, n_tokens), in order.
* ``bits``: length of the code stream; ``payload``: the stream, first bit highest.
* ``checkpoints``: the bit offset of every ``STRIDE``-th id.

Segments are coded independently and within one at each checkpoint, so a
reader can start anywhere, and all strides of a segment are decoded side by
side by table: the next ``LIMIT`` bits index a table of (id, length).

Spark's commit protocol leaves whole segments only, whatever executors are lost,
and the header is written last: a folder without one is no corpus.

Edge cases: a null or empty text has only the end id.  Null document ids sort
first.  Rows may repeat and keep one entry each.  An empty table gives an empty
corpus.  A corpus of one distinct id has a code of one bit.
"""

from __future__ import annotations

import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import PurePath

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillon.llm import tokens
from quillon.llm.common import Scratch, clean_shuffles, partitions, shared_folder

LIMIT = 20
STRIDE = 256
SEGMENT_IDS = 1 << 19
FORMAT = "canonical-huffman-segments/1"
HEADER_SCHEMA = "format string, vocabulary long, limit int, stride int, end_id long, tokenizer string, lengths binary, documents long, ids long"
SEGMENT_SCHEMA = "lengths_crc32 long, file int, in_file long, documents array<struct<doc_id:bigint,n_tokens:bigint>>, n_ids long, bits long, payload binary, checkpoints array<bigint>"


def code_lengths(counts: np.ndarray, limit: int = LIMIT) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits; 0 for ids without counts.

    Package-merge: from the longest length to the shortest, pairs of the list
    so far are packaged and merged with the symbols; of the last list, the
    2n - 2 lightest are taken, and each one that holds a symbol adds a bit."""
    used = np.flatnonzero(counts)
    lengths = np.zeros(len(counts), np.uint8)
    if len(used) < 2:
        lengths[used] = 1
        return lengths
    if len(used) > 1 << limit:
        raise ValueError("more ids than codes of that length")
    used = used[np.argsort(counts[used], kind="stable")]
    weights = counts[used].astype(np.int64)
    n, current, is_leaf = len(used), weights, [np.ones(len(used), bool)]
    for _ in range(limit - 1):
        pairs = len(current) // 2
        packages = current[0 : 2 * pairs : 2] + current[1 : 2 * pairs : 2]
        merged = np.concatenate([weights, packages])
        order = np.argsort(merged, kind="stable")
        current = merged[order]
        is_leaf.append(order < n)
    # Back through the lists: the lightest ``take`` hold the lightest symbols.
    take = 2 * n - 2
    depth = np.zeros(n + 1, np.int64)
    for leaf in reversed(is_leaf):
        symbols = int(leaf[:take].sum())
        depth[0] += 1
        depth[symbols] -= 1
        take = 2 * (take - symbols)
    lengths[used] = np.cumsum(depth[:-1])
    return lengths


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes in order of length, then id."""
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    codes = np.zeros(len(lengths), np.uint64)
    ls = lengths[order].astype(np.int64)
    # The code of each is the sum of the shares of the code space before it.
    share = np.left_shift(1, LIMIT - ls)
    codes[order] = ((np.cumsum(share) - share) >> (LIMIT - ls)).astype(np.uint64)
    return codes


def decoding_table(lengths: np.ndarray, limit: int = LIMIT) -> tuple[np.ndarray, np.ndarray]:
    """Id and length by the next ``limit`` bits."""
    ids, size = np.zeros(1 << limit, np.uint32), np.ones(1 << limit, np.uint8)
    order = np.lexsort((np.arange(len(lengths)), lengths))
    order = order[lengths[order] > 0]
    if len(order):
        span = np.left_shift(1, limit - lengths[order].astype(np.int64))
        end = int(span.sum())
        ids[:end], size[:end] = np.repeat(order, span), np.repeat(lengths[order], span)
    return ids, size


def encode(ids: np.ndarray, codes: np.ndarray, lengths: np.ndarray) -> tuple[bytes, int, np.ndarray]:
    """The code stream, its bits, and the bit offset of every STRIDE-th id."""
    n = lengths[ids].astype(np.int64)
    ends = np.cumsum(n)
    starts = ends - n
    bits = int(ends[-1]) if len(ids) else 0
    # Each code lies in four bytes; codes share no bit, so sums are unions.
    word = codes[ids] << (32 - n - (starts & 7)).astype(np.uint64)
    byte, size = starts >> 3, (bits >> 3) + 5
    out = np.zeros(size, np.float64)
    for i in range(4):
        part = ((word >> np.uint64(24 - 8 * i)) & np.uint64(255)).astype(np.float64)
        out += np.bincount(byte + i, part, size)
    return out.astype(np.uint8)[: (bits + 7) // 8].tobytes(), bits, starts[::STRIDE]


def decode(payload: bytes, n_ids: int, checkpoints: np.ndarray, table: tuple[np.ndarray, np.ndarray], stride: int = STRIDE) -> np.ndarray:
    """The ids of a stream, all strides side by side."""
    table_ids, table_size = table
    raw = np.frombuffer(payload + bytes(8), np.uint8).astype(np.uint32)
    windows = (raw[:-3] << 24) | (raw[1:-2] << 16) | (raw[2:-1] << 8) | raw[3:]
    last = len(windows) - 1
    at = np.array(checkpoints, np.int64)
    out = np.zeros((len(at), stride), np.uint32)
    unused = np.uint32(33 - len(table_ids).bit_length())
    for i in range(min(stride, n_ids)):
        index = (windows[np.minimum(at >> 3, last)] << (at & 7).astype(np.uint32)) >> unused
        out[:, i] = table_ids[index]
        at += table_size[index]
    return out.reshape(-1)[:n_ids]


def id_type(vocabulary: int) -> str:
    """How ids are held between passes: two bytes do for most vocabularies."""
    return "<u2" if vocabulary <= 1 << 16 else "<u4"


def tokenize(docs: DataFrame, path: str, end_id: int, held_as: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_tokens and ids (held as ``held_as``, with the end id)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer, end = tokens.tokenizer(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids = [np.frombuffer(tokenizer.ids(t.as_py()) + end, "<u4").astype(held_as).tobytes() for t in batch.column(1)]
            columns = list(zip(batch.column(0).to_pylist(), [len(i) // int(held_as[-1]) for i in ids], ids))
            for part in tokens.chunks(columns, [c[1] for c in columns], 1 << 20):
                a, b, c = zip(*part)
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["doc_id", "n_tokens", "ids"])

    return docs.select(F.col(id_col).cast("long"), F.col(text)).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def id_counts(coded: DataFrame, held_as: str) -> DataFrame:
    """How often each id occurs: id, n.  A task sends a row for each id at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0, np.int64)
        for batch in batches:
            one = np.bincount(np.frombuffer(b"".join(batch.column(0).to_pylist()), held_as))
            if len(one) > len(total):
                total, one = one, total
            total[: len(one)] += one
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["id", "n"])

    return coded.select("ids").mapInArrow(run, "id long, n long").groupBy("id").agg(F.sum("n").alias("n"))


def global_lengths(coded: DataFrame, vocabulary: int) -> np.ndarray:
    """Code lengths from counts over the whole corpus; the counts that reach
    the driver are one number for each id of the vocabulary."""
    counts = np.zeros(vocabulary, np.int64)
    for r in id_counts(coded, id_type(vocabulary)).collect():
        counts[r.id] = r.n
    return code_lengths(counts)


def segments_of(coded: DataFrame, lengths: np.ndarray, held_as: str) -> DataFrame:
    """The corpus in ascending doc_id order as segments.

    Ranges of doc_id are one file each.  Documents of one id follow by their ids."""
    packed = lengths.tobytes()
    tied = zlib.crc32(packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = np.frombuffer(packed, np.uint8)
        codes = canonical(own)
        before, docs, parts, held = 0, [], [], 0

        def segment(file: int) -> pa.RecordBatch:
            ids = np.frombuffer(b"".join(parts), held_as)
            payload, bits, at = encode(ids, codes, own)
            row = {"lengths_crc32": tied, "file": file, "in_file": before, "documents": [{"doc_id": d, "n_tokens": n} for d, n in docs], "n_ids": len(ids), "bits": bits, "payload": payload, "checkpoints": at}
            types = [pa.int64(), pa.int32(), pa.int64(), pa.list_(pa.struct([("doc_id", pa.int64()), ("n_tokens", pa.int64())])), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64())]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(row.values(), types)], names=list(row))

        file = 0
        for batch in batches:
            for f, d, n, ids in zip(*(batch.column(i) for i in range(4))):
                file = f.as_py()
                docs.append((d.as_py(), n.as_py()))
                parts.append(ids.as_py())
                held += docs[-1][1]
                if held >= SEGMENT_IDS:
                    yield segment(file)
                    before, docs, parts, held = before + held, [], [], 0
        if docs:
            yield segment(file)

    n = partitions(coded.sparkSession)
    ordered = coded.repartitionByRange(n, F.col("doc_id").asc_nulls_first(), "n_tokens").sortWithinPartitions(F.col("doc_id").asc_nulls_first(), "n_tokens", "ids")
    return ordered.select(F.spark_partition_id().alias("file"), "doc_id", "n_tokens", "ids").mapInArrow(run, SEGMENT_SCHEMA)


def write_corpus(docs: DataFrame, folder: str, path: str | None = None, end_id: int = 2, id_col: str = "doc_id", text: str = "text", vocabulary: int | None = None) -> None:
    """Tokenizes ``docs`` and writes them as a corpus at ``folder``, which must not exist."""
    from tokenizers import Tokenizer

    spark = docs.sparkSession
    path = path or tokens.default_path()
    vocabulary = max(vocabulary or Tokenizer.from_file(path).get_vocab_size(), end_id + 1)
    held_as = id_type(vocabulary)
    with Scratch(spark, "tokens") as scratch:
        coded = scratch.written(tokenize(docs, path, end_id, held_as, id_col, text), "ids")
        lengths = global_lengths(coded, vocabulary)
        with clean_shuffles(spark):
            segments_of(coded, lengths, held_as).write.parquet(f"{folder}/segments")
        n = coded.agg(F.count("*"), F.coalesce(F.sum("n_tokens"), F.lit(0))).first()
    row = (FORMAT, vocabulary, LIMIT, STRIDE, end_id, PurePath(path).name, bytearray(lengths.tobytes()), *n)
    spark.createDataFrame([row], HEADER_SCHEMA).coalesce(1).write.parquet(f"{folder}/header")


@dataclass(frozen=True)
class Header:
    vocabulary: int
    limit: int
    stride: int
    end_id: int
    tokenizer: str
    lengths: bytes
    documents: int
    ids: int


def read_header(spark: SparkSession, folder: str) -> Header:
    rows = spark.read.schema(HEADER_SCHEMA).parquet(f"{folder}/header").collect()
    if len(rows) != 1 or rows[0].format != FORMAT:
        raise ValueError(f"{folder} is no corpus of {FORMAT}")
    r = rows[0]
    return Header(r.vocabulary, r.limit, r.stride, r.end_id, r.tokenizer, bytes(r.lengths), r.documents, r.ids)


def read_corpus(spark: SparkSession, folder: str) -> DataFrame:
    """The documents of a corpus: doc_id, start, n_tokens and ids.  Nothing but
    the folder is needed.

    ``start`` is the number of ids of all documents before."""
    head = read_header(spark, folder)
    segments = spark.read.schema(SEGMENT_SCHEMA).parquet(f"{folder}/segments")
    tied = zlib.crc32(head.lengths)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = decoding_table(np.frombuffer(head.lengths, np.uint8), head.limit)
        for batch in batches:
            for row in range(batch.num_rows):
                of, before, docs, n_ids, payload, checkpoints = (batch.column(i)[row].as_py() for i in range(6))
                if of != tied:
                    raise ValueError("a segment of another header")
                ids = decode(payload, n_ids, np.array(checkpoints, np.int64), table, head.stride)
                at = np.cumsum([0] + [d["n_tokens"] for d in docs])
                rows = [(d["doc_id"], before + int(s), d["n_tokens"], ids[s : s + d["n_tokens"]].astype("<u4").tobytes()) for d, s in zip(docs, at)]
                for part in tokens.chunks(rows, [r[2] for r in rows], 1 << 19):
                    types = [pa.int64()] * 3 + [pa.binary()]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*part), types)], names=["doc_id", "start", "n_tokens", "ids"])

    # One row for each file, and there is a file for each partition of the write.
    files = segments.groupBy("file").agg(F.sum("n_ids").alias("n"))
    files = files.select("file", F.coalesce(F.sum("n").over(Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("file_start"))
    placed = segments.join(F.broadcast(files), "file").withColumn("before", F.col("file_start") + F.col("in_file"))
    return placed.select("lengths_crc32", "before", "documents", "n_ids", "payload", "checkpoints").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def roundtrip(docs: DataFrame, **options: object) -> DataFrame:
    """The documents, written as a corpus to the shared folder and read back from it."""
    folder = f"{shared_folder(docs.sparkSession)}/corpus-{uuid.uuid4().hex}"
    write_corpus(docs, folder, **options)
    return read_corpus(docs.sparkSession, folder)
