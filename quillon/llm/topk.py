"""Exact top-k by inner product with multi-resolution segment statistics.

A vector is cut into 1, 4 and 16 segments of near equal width.  With the mean m
and deviation s of each, the product of q and x is at most the sum of
``w (mq mx + sq sx)`` over segments of width w (Cauchy-Schwarz within each), so
minus that sum is a lower bound on the distance ``-q.x``.

Plan.  (1) Vectors are put in order of a coarse code of their segment means and
cut into groups, and those into blocks, so that what lies together is alike.  A
group has the least and greatest mean and the greatest deviation of each of 16
segments, which bound the product of a query with any of its vectors.  (2) Each
query goes to the group of greatest bound; its k-th best product there is its
threshold, for all that follows.  (3) A query goes on only to groups whose bound
reaches its threshold.  There, vectors whose bound does not reach it are dropped
from coarse to fine, and for survivors alone the exact product is taken.

Groups are keys of the join, so there are as many tasks' worth of keys as the
data ask for, and memory is bounded by a block of queries and one of vectors.
A group has ``GROUP`` vectors at most, or more once there would be over
``GROUPS`` groups: their statistics (400 bytes each) go to the driver and to
all tasks.  Nothing else does: blocks are met by a sort-merge join whatever
their size is taken for, as tables of vectors may be small on disk and large in
memory.  Queries go on in turns by their home, so that what is sent at once is
in proportion to the table.  Whole numbers are kept in the fewest bytes.

Edge cases: vectors that are null, empty, or hold null or non-finite components
take no part, nor do rows with a null id.  Vectors of different lengths are not
compared.  Repeated rows are candidates each; none with the query's own id is.
Query rows that share an id are ranked as one.  An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, partitions, written

LEVELS = (1, 4, 16)
VECTOR_BLOCK = 4096
QUERY_BLOCK = 512
GROUP = 1 << 16
GROUPS = 1 << 14
SMALL = 1 << 10
#: Of the exact products of a block, the share from which on a whole product of
#: matrices is less work than one for each survivor.
DENSE = 0.02
#: Queries of a block by which that share is told, and of vectors 64 times as many.
TRIED = 8
#: Vectors that are sent in a turn, as a multiple of the table's.
SENT = 2
FOUND = "query_id long, vec_id long, score double"


def segments(dim: int, n: int) -> np.ndarray:
    return np.unique(np.linspace(0, dim, min(n, dim) + 1).astype(int))


def statistics(data: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of segments, scaled so that the product of two rows
    of both is the bound."""
    edges = segments(data.shape[1], n)
    means, deviations = [], []
    for a, b in zip(edges, edges[1:]):
        part, w = data[:, a:b].astype(np.float64), np.sqrt(b - a)
        mean = part.mean(1)
        means.append(w * mean)
        deviations.append(w * np.sqrt(((part - mean[:, None]) ** 2).mean(1)))
    return np.stack(means, 1), np.stack(deviations, 1)


def codes(data: np.ndarray) -> np.ndarray:
    """A number that is close for vectors of like direction: the bits of four
    segments' means in turn, in parts of the vector's length."""
    mean, _ = statistics(data, 4)
    length = np.sqrt((data**2).sum(1, keepdims=True))
    level = np.clip((mean / np.where(length > 0, length, 1) + 1) * 128, 0, 255).astype(np.int64)
    out = np.zeros(len(data), np.int64)
    for bit in range(7, -1, -1):
        for j in range(level.shape[1]):
            out = out * 2 + (level[:, j] >> bit & 1)
    return out


def _rows(batch: pa.RecordBatch, at: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """dim, row numbers and matrix of the lists of each length in a batch."""
    lists = batch.column(at)
    sizes = np.array(lists.value_lengths().to_numpy(zero_copy_only=False), np.int64)
    for dim in np.unique(sizes):
        rows = np.flatnonzero(sizes == dim)
        flat = lists.take(pa.array(rows)).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
        yield int(dim), rows, flat.reshape(-1, dim)


def packed(data: np.ndarray) -> bytes:
    """Numbers in the fewest bytes each that hold them all exactly."""
    top = np.abs(data).max(initial=0)
    for kind in ("<i1", "<i2", "<i4"):
        if top <= np.iinfo(kind).max:
            small = data.astype(kind)
            if (small == data).all():
                return small.tobytes()
    return data.astype("<f8").tobytes()


def unpacked(raw: pa.Buffer, rows: int, dim: int) -> np.ndarray:
    kind = {1: "<i1", 2: "<i2", 4: "<i4", 8: "<f8"}[len(raw) // (rows * dim)]
    return np.frombuffer(raw, kind).reshape(rows, dim)


def coded(vectors: DataFrame) -> DataFrame:
    """``vectors`` (id, v) with their length and code."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                dims, found = np.zeros(batch.num_rows, np.int32), np.zeros(batch.num_rows, np.int64)
                for dim, rows, data in _rows(batch, 1):
                    dims[rows], found[rows] = dim, codes(data)
                yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(dims), pa.array(found)], names=["id", "v", "dim", "code"])

    return vectors.select("id", "v").mapInArrow(run, "id long, v array<double>, dim int, code long")


def grouped(vectors: DataFrame, groups: int) -> DataFrame:
    """Blocks of vectors, in order of their codes: dim, grp, ids, data, and the
    block's least and greatest means and greatest deviations."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        group = TaskContext.get().partitionId()
        held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}

        def blocks(dim: int, last: bool) -> Iterator[pa.RecordBatch]:
            ids, data = (np.concatenate(x) for x in zip(*held.pop(dim)))
            while len(ids) >= VECTOR_BLOCK or (last and len(ids)):
                part, ids = np.split(ids, [VECTOR_BLOCK])
                rows, data = np.split(data, [VECTOR_BLOCK])
                mean, deviation = statistics(rows, LEVELS[-1])
                ends = [x.astype("<f8").tobytes() for x in (mean.min(0), mean.max(0), deviation.max(0))]
                values = [dim, group, part.astype("<i8").tobytes(), packed(rows), *ends]
                types = [pa.int32(), pa.int32(), *[pa.binary()] * 5]
                yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types)], names=["dim", "grp", "ids", "data", "low", "high", "dev"])
            if len(ids):
                held[dim] = [(ids, data)]

        for batch in batches:
            if batch.num_rows:
                number = batch.column(0).to_numpy()
                for dim, rows, data in _rows(batch, 1):
                    held.setdefault(dim, []).append((number[rows], data))
                    if sum(len(i) for i, _ in held[dim]) >= VECTOR_BLOCK:
                        yield from blocks(dim, False)
        for dim in list(held):
            yield from blocks(dim, True)

    # Ids part what is of one code, however many vectors are equal.
    dealt = vectors.repartitionByRange(groups, "dim", "code", F.xxhash64("id"), "id").sortWithinPartitions("dim", "code")
    return dealt.select("id", "v").mapInArrow(run, "dim int, grp int, ids binary, data binary, low binary, high binary, dev binary")


class Groups:
    """Statistics of the groups of vectors of one length."""

    def __init__(self, rows: list[tuple[int, bytes, bytes, bytes]]) -> None:
        self.number = np.array([r[0] for r in rows])
        self.low, self.high, self.dev = (np.stack([np.frombuffer(r[i], "<f8") for r in rows]) for i in (1, 2, 3))

    def bounds(self, queries: np.ndarray) -> np.ndarray:
        """What the product of each query with a vector of each group is at most."""
        mean, deviation = statistics(queries, LEVELS[-1])
        return np.maximum(mean, 0) @ self.high.T + np.minimum(mean, 0) @ self.low.T + deviation @ self.dev.T


def group_statistics(blocks: DataFrame) -> dict[int, Groups]:
    found: dict[tuple[int, int], list[np.ndarray]] = {}
    for r in blocks.select("dim", "grp", "low", "high", "dev").toLocalIterator():
        low, high, dev = (np.frombuffer(bytes(x), "<f8") for x in (r.low, r.high, r.dev))
        have = found.get((r.dim, r.grp))
        found[r.dim, r.grp] = [low, high, dev] if have is None else [np.minimum(have[0], low), np.maximum(have[1], high), np.maximum(have[2], dev)]
    dims: dict[int, list] = {}
    for (dim, grp), x in found.items():
        dims.setdefault(dim, []).append((grp, *(y.tobytes() for y in x)))
    return {dim: Groups(rows) for dim, rows in dims.items()}


def homed(queries: DataFrame, groups: dict[int, Groups]) -> DataFrame:
    """``queries`` (id, v) in order of their codes, with the group of greatest
    bound.  Queries of no vector's length are left out."""
    held = queries.sparkSession.sparkContext.broadcast(groups)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            home = np.full(batch.num_rows, -1, np.int32)
            for dim, rows, data in _rows(batch, 1) if batch.num_rows else ():
                if dim in held.value:
                    home[rows] = held.value[dim].number[held.value[dim].bounds(data).argmax(1)]
            found = pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(home)], names=["id", "v", "home"])
            yield found.filter(pa.array(home >= 0))

    return queries.select("id", "v").mapInArrow(run, "id long, v array<double>, home int")


def sent(queries: DataFrame, groups: dict[int, Groups], first: bool) -> DataFrame:
    """Blocks of ``queries`` (id, v, home, t) by the groups that they go to: at
    first to their home, then to the others that reach the threshold ``t``."""
    held = queries.sparkSession.sparkContext.broadcast(groups)
    names = ["dim", "grp", "q_ids", "q_data", "q_t"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, home, t = (batch.column(i).to_numpy(zero_copy_only=False) for i in (0, 2, 3))
            for dim, rows, data in _rows(batch, 1):
                stats = held.value[dim]
                for at in range(0, len(rows), QUERY_BLOCK):
                    own, q = rows[at : at + QUERY_BLOCK], data[at : at + QUERY_BLOCK]
                    goes = home[own][:, None] == stats.number
                    if not first:
                        goes = ~goes & (stats.bounds(q) >= (t[own] - _slack(t[own], q))[:, None])
                    for g in np.flatnonzero(goes.any(0)):
                        i = np.flatnonzero(goes[:, g])
                        values = [dim, int(stats.number[g]), ids[own[i]].astype("<i8").tobytes(), packed(q[i]), t[own[i]].astype("<f8").tobytes()]
                        yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(values, [pa.int32(), pa.int32(), *[pa.binary()] * 3])], names=names)

    return queries.select("id", "v", "home", "t").mapInArrow(run, "dim int, grp int, q_ids binary, q_data binary, q_t binary")


def _slack(t: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Room for the rounding of bounds; exact products of integers are not rounded."""
    return 1e-9 * (1 + np.where(np.isfinite(t), np.abs(t), 0) + np.sqrt((queries.astype(np.float64) ** 2).sum(1)) * 64)


def block_top(query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query ids, ids and products of the k best of a block for each query, of
    those that reach the query's threshold ``least``."""
    open_ = np.flatnonzero(np.isneginf(least))
    if len(open_) and len(ids) > k:
        # The k of best coarse bound set a first threshold where there is none.
        bound = np.hstack(statistics(queries[open_], LEVELS[0])) @ np.hstack(statistics(data, LEVELS[0])).T
        bound[query_ids[open_][:, None] == ids] = -np.inf
        seed = np.argpartition(-bound, k - 1, axis=1)[:, :k]
        exact = np.einsum("qd,qkd->qk", queries[open_].astype(np.float64), data[seed].astype(np.float64))
        least = least.copy()
        least[open_] = np.where(np.isneginf(np.take_along_axis(bound, seed, 1)).any(1), -np.inf, exact.min(1))
    least = least - _slack(least, queries)
    some, few = (np.arange(0, n, -(-n // most)) for n, most in ((len(queries), TRIED), (len(ids), 64 * TRIED)))
    bound = np.hstack(statistics(queries[some], LEVELS[-1])) @ np.hstack(statistics(data[few], LEVELS[-1])).T
    if (bound >= least[some][:, None]).mean() > DENSE:
        i, j, scores = _reaching(query_ids, queries, least, ids, data, k)
    else:
        queries, data = queries.astype(np.float64), data.astype(np.float64)
        alive = np.ones((len(queries), len(ids)), bool)
        for level in LEVELS:
            i, j = np.flatnonzero(alive.any(1)), np.flatnonzero(alive.any(0))
            if not len(i):
                break
            alive[np.ix_(i, j)] &= np.hstack(statistics(queries[i], level)) @ np.hstack(statistics(data[j], level)).T >= least[i][:, None]
        i, j = np.nonzero(alive)
        scores = np.concatenate([np.empty(0), *(np.einsum("nd,nd->n", queries[i[a : a + 65536]], data[j[a : a + 65536]]) for a in range(0, len(i), 65536))])
    good = (scores >= least[i]) & (query_ids[i] != ids[j])
    i, j, scores = i[good], j[good], scores[good]
    order = np.lexsort((ids[j], -scores, i))
    i, j, scores = i[order], j[order], scores[order]
    place = np.arange(len(i)) - np.searchsorted(i, i)
    best = place < k
    return query_ids[i[best]], ids[j[best]], scores[best]


def _reaching(query_ids: np.ndarray, queries: np.ndarray, least: np.ndarray, ids: np.ndarray, data: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows of both and their products, of those that reach ``least`` and, where
    these are many, the k-th best of their row."""
    whole = all(x.dtype.kind == "i" or not (x % 1).any() for x in (queries, data))
    most = float(np.abs(queries).max(initial=0)) * float(np.abs(data).max(initial=0)) * data.shape[1]
    if whole and most < 1 << 24:
        # All sums on the way are whole numbers that a float of 32 bits holds.
        products = queries.astype(np.float32) @ data.astype(np.float32).T
        least = np.clip(np.ceil(least), -(1 << 24), 1 << 24).astype(np.float32)
    else:
        products = queries.astype(np.float64) @ data.astype(np.float64).T
    good = products >= least[:, None]
    if len(ids) > k and np.count_nonzero(good) > 8 * k * len(good):
        products[query_ids[:, None] == ids] = -np.inf
        best = np.partition(products, len(ids) - k, axis=1)[:, len(ids) - k]
        good = products >= np.maximum(least, best)[:, None]
    i, j = np.nonzero(good)
    return i, j, products[i, j].astype(np.float64)


def met(asked: DataFrame, blocks: DataFrame, k: int) -> DataFrame:
    """query_id, vec_id and score of the best of each block for each query sent to it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                dim = batch.column(0)[row].as_py()
                q_ids, t, ids = (np.frombuffer(batch.column(c)[row].as_buffer(), kind) for c, kind in ((1, "<i8"), (3, "<f8"), (4, "<i8")))
                q, data = (unpacked(batch.column(c)[row].as_buffer(), len(of), dim) for c, of in ((2, q_ids), (5, ids)))
                found = block_top(q_ids, q, t, ids, data, k)
                if len(found[0]):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in found], names=["query_id", "vec_id", "score"])

    # Else blocks that are taken for small would go through the driver.
    # The number of parts is given, or small ones with much work would be joined.
    parts = 2 * partitions(asked.sparkSession)
    left, right = (x.repartition(parts, "dim", "grp").hint("merge") for x in (asked, blocks.select("dim", "grp", "ids", "data")))
    pairs = left.join(right, ["dim", "grp"])
    return pairs.select("dim", "q_ids", "q_data", "q_t", "ids", "data").mapInArrow(run, FOUND)


def top_k(vectors: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id and score of the ``k`` vectors of largest
    inner product with each query.  Both inputs: id long, v array<double>."""
    spark = vectors.sparkSession
    with Scratch(spark, "top-k") as scratch:
        rows = scratch.written(coded(vectors), "vectors")
        n = rows.count()
        # Where there are few vectors, twice as many groups as tasks at once, but
        # none so small that its k best make a poor threshold.
        groups = min(GROUPS, max(1, -(-n // GROUP), min(2 * partitions(spark), n // SMALL)))
        blocks = scratch.written(grouped(rows, groups), "blocks")
        stats = group_statistics(blocks)
        # Queries of a block are alike, and go to the same groups.
        order = ["dim", "code", F.xxhash64("id"), "id"]
        asked = scratch.written(homed(coded(queries).repartitionByRange(partitions(spark), *order).sortWithinPartitions(*order), stats), "queries")
        seeds = scratch.written(met(sent(asked.withColumn("t", F.lit(float("-inf"))), stats, True), blocks, k), "seeds")
        least = seeds.groupBy("query_id").agg(F.sort_array(F.collect_list("score"), False).alias("s")).select("query_id", F.get("s", F.lit(k - 1)).alias("least"))
        known = asked.join(least, F.col("id") == F.col("query_id"), "left").select("id", "v", "home", F.coalesce("least", F.lit(float("-inf"))).alias("t"))
        known = scratch.written(known.repartition(partitions(spark), "home").sortWithinPartitions("home"), "thresholds")
        turns = max(1, math.ceil(known.count() * groups / (SENT * max(1, n))))
        found = seeds
        for turn in range(turns):
            own = known.where(F.pmod("home", F.lit(turns)) == turn)
            found = found.unionByName(scratch.written(met(sent(own, stats, False), blocks, k), "found"))
        rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
        return written(found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", F.col("score").cast("long")), "top-k")


def whole_numbers(v: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, as double."""
    return F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("double"))


def usable(id_column: Column, v: Column) -> Column:
    """Whether a row takes part."""
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < F.lit(float("inf"))))
    return id_column.isNotNull() & v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False))
