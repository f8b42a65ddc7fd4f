"""N-gram Jaccard join by signature trees.

Documents are sets of word shingles; two are linked if their Jaccard similarity
is at least the threshold.  The join returns the classes that links connect,
and the links that join them, without making all pairs of a class.

Plan.
1. Equal sets become one (their documents are linked by equality).
2. Shingles are counted in a table of ``CELLS`` cells, which tells the very
   frequent ones; sets order their shingles by class of frequency, then hash.
3. A similar pair shares a shingle of both prefixes (the first n - tn + 1), so
   each set is posted under its prefix, and besides under all shingles of a fixed
   share of the hash range.  Postings of one set alone are dropped.  Of the
   range, m of a set's n shingles are posted and s of these have company: it can
   share at most s + n - m with any other, and is dropped if that is under tn.
   Passages that many documents share alone are dropped so.
4. In a few turns, each set is compared with a hub of its postings: one pair for
   each set.  Links so far give components, into which groups of copies fall.
5. Postings that still hold several components get a signature tree each: sets
   by size and component are leaves; a node holds the OR of its sets' bitmaps,
   the range of sizes and the component if there is but one.  A traversal of
   pairs of nodes drops those of one component, those whose sizes cannot go
   together, and those whose bitmaps share too few bits for the overlap needed.
   Large postings are cut into chunks, and pairs of chunks spread over tasks.
   At first only each set's most promising pair is taken and verified, so that
   the last traversal, which takes all, meets few components.
6. Pairs that are left are verified on whole sets.

A pair is dropped only if it cannot be linked or if its ends are in one
component already, so no link between components is lost.  Sets are compared by
64-bit hashes of shingles and known by a 64-bit digest; sets that clash in that
are found by a second one, and known by it.

Edge cases: a null, empty or blank text has an empty set, linked with nothing;
a text of fewer words than a shingle is one shingle.  Null ids sort before all
others.  Rows that share an id keep a row each; a class is named by its least
id.  An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.common import Scratch, key, unkey, written
from quillon.llm.shingles import overlap, shingle_set

CELLS = 1 << 22
CHUNK = 1 << 16
#: 64-bit words of bitmaps in trees in turns of best mates.
WIDE = 8
#: In the last turn, and of those by which pairs are told apart.
FINE = 64
LEAF = 16
POSTING = 2048
#: Turns in which sets are compared with a hub, and with their best mate by tree.
TURNS = 1
BEST = 2
#: The share of the hash range that is posted whole, in 32-bit steps.
RANGE = int(0.36 * 2**32)


def least_overlap(n: np.ndarray | int, m: np.ndarray | int, num: int, den: int) -> np.ndarray | int:
    """Overlap of sets of n and m that num / den asks for at least."""
    return -(-num * (n + m) // (num + den))


def prefix_length(n: int, num: int, den: int) -> int:
    return n - -(-num * n // den) + 1


def _texts(batch: pa.RecordBatch) -> Iterator[memoryview | None]:
    for t in batch.column(1):
        b = t.as_buffer()
        yield memoryview(b) if b is not None else None


def surveyed(docs: DataFrame, width: int) -> DataFrame:
    """One pass: a row (id, n, m, set, other) for each document, where m counts
    the shingles in the posted range and ``other`` is a second digest, and rows
    (chunk, g, counts) with each task's counts of shingles by cell, at most 255.
    Of a chunk, a task gives the cells that it has counted, or all if those are
    many, so its rows are in proportion to its texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        names = ["id", "n", "m", "set", "other", "chunk", "g", "counts"]
        total, held, size = np.zeros(CELLS, np.uint32), [], 0
        shift = np.uint64(64 - (CELLS.bit_length() - 1))
        for batch in batches:
            codes, others, sizes, ranged = [], [], [], []
            for t in _texts(batch):
                s = shingle_set(t, width)
                codes.append(_digest(s))
                others.append(_digest(s, 1))
                sizes.append(len(s))
                ranged.append(_in_range(s))
                held.append((s >> shift).astype(np.int64))
                size += len(s)
                if size > 1 << 21:
                    total += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
                    held, size = [], 0
            n = len(codes)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (sizes, ranged, codes, others)), pa.nulls(n, pa.int32()), pa.nulls(n, pa.int32()), pa.nulls(n, pa.binary())], names=names)
        if held:
            total += np.bincount(np.concatenate(held), minlength=CELLS).astype(np.uint32)
        # A count of 255 in one task is frequent in any case.
        small = np.minimum(total, 255).astype(np.uint8)
        group = TaskContext.get().partitionId() // 256
        for i in range(0, CELLS, CHUNK):
            raw = _packed(small[i : i + CHUNK])
            if raw:
                one = [pa.nulls(1, pa.int64())] * 5 + [pa.array([i], pa.int32()), pa.array([group], pa.int32()), pa.array([raw], pa.binary())]
                yield pa.RecordBatch.from_arrays(one, names=names)

    return docs.mapInArrow(run, "id long, n long, m long, set long, other long, chunk int, g int, counts binary")


def _packed(counts: np.ndarray) -> bytes:
    """Counts of a byte: the cells above 0 and their counts, or else all counts."""
    at = np.flatnonzero(counts)
    if not len(at):
        return b""
    if len(at) * 5 >= len(counts):
        return b"A" + counts.tobytes()
    return b"S" + at.astype("<u4").tobytes() + counts[at].tobytes()


def _unpacked(raw: bytes, size: int) -> np.ndarray:
    if raw[:1] == b"W":
        return np.frombuffer(raw, "<u4", offset=1).astype(np.uint64)
    if raw[:1] == b"A":
        return np.frombuffer(raw, np.uint8, offset=1).astype(np.uint64)
    n = (len(raw) - 1) // 5
    out = np.zeros(size, np.uint64)
    out[np.frombuffer(raw, "<u4", n, 1)] = np.frombuffer(raw, np.uint8, n, 1 + 4 * n)
    return out


def _in_range(s: np.ndarray) -> int:
    """How many of an ascending set lie in the posted range."""
    return int(np.searchsorted(s, np.uint64(RANGE << 32)))


def frequency_classes(survey: DataFrame) -> bytes:
    """A byte for each cell: 0 for cells near the mean, else how many times the
    mean doubles into its count.  Only these CELLS bytes reach the driver."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, chunk = np.zeros(min(CHUNK, CELLS), np.uint64), None
        for batch in batches:
            for c, x in zip(batch.column(0), batch.column(2)):
                chunk, raw = c.as_py(), x.as_py()
                total += _unpacked(raw, len(total))
        yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int32()), pa.array([0], pa.int32()), pa.array([b"W" + np.minimum(total, 2**32 - 1).astype("<u4").tobytes()], pa.binary())], names=["chunk", "g", "counts"])

    schema = "chunk int, g int, counts binary"
    parts = survey.where("chunk IS NOT NULL").select("chunk", "g", "counts").groupBy("chunk", "g").applyInArrow(add, schema).groupBy("chunk").applyInArrow(add, schema)
    return levels({r.chunk: bytes(r.counts) for r in parts.collect()})


def levels(chunks: dict[int, bytes]) -> bytes:
    """The classes of packed counts by the first cell of their chunk, chunk by
    chunk, so that the driver holds little more than the counts."""
    total = sum(int(_unpacked(raw, CHUNK).sum()) for raw in chunks.values())
    unit = max(4.0, 2 * (total / CELLS))
    out = np.zeros(CELLS, np.uint8)
    for at, raw in chunks.items():
        times = _unpacked(raw, CHUNK) / unit
        found = np.where(times >= 1, np.minimum(np.log2(np.maximum(times, 1)).astype(np.uint8) + 1, 60), 0)
        out[at : at + CHUNK] = found[: CELLS - at]
    return out.tobytes()


def _digest(shingles: np.ndarray, seed: int = 0) -> int:
    import xxhash

    x = xxhash.xxh3_64_intdigest(shingles.tobytes(), seed)
    return x - (1 << 64) if x >> 63 else x


def _name(shingles: np.ndarray, clashes: frozenset[int]) -> int:
    """What a set goes by: its digest, or where sets clash in that, the other."""
    code = _digest(shingles)
    return _digest(shingles, 1) if code in clashes else code


def clashing(survey: DataFrame) -> frozenset[int]:
    """Digests that different sets have, told by their other digests.  Among
    10^10 sets some three are expected, so they fit the driver."""
    both = survey.where("chunk IS NULL").groupBy("set").agg(F.min("other").alias("x"), F.max("other").alias("y"))
    return frozenset(r.set for r in both.where("x <> y").select("set").collect())


#: Digests that a task remembers, so that it posts copies once.
REMEMBERED = 100_000


def entries(docs: DataFrame, classes: bytes, num: int, den: int, width: int, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """Rows (shingle, set, n) of prefixes and of the posted range; n is negative
    for shingles that are not of the prefix.  A set may come from several tasks."""
    held = docs.sparkSession.sparkContext.broadcast(classes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell_class = np.frombuffer(held.value, np.uint8)
        shift = np.uint64(64 - (CELLS.bit_length() - 1))
        seen: set[int] = set()

        def rows(parts: list[tuple[int, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
            sets, sizes, prefixes = zip(*parts)
            n = [len(p) for p in prefixes]
            columns = [np.concatenate(prefixes).view(np.int64), np.repeat(np.array(sets, np.int64), n), np.concatenate(sizes)]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["shingle", "set", "n"])

        parts, size = [], 0
        for batch in batches:
            for t in _texts(batch):
                s = shingle_set(t, width)
                code = _name(s, clashes)
                if not len(s) or code in seen:
                    continue
                if len(seen) >= REMEMBERED:
                    seen.clear()
                seen.add(code)
                order = np.argsort(cell_class[(s >> shift).astype(np.int64)], kind="stable")
                prefix = order[: prefix_length(len(s), num, den)]
                cut = _in_range(s)
                inside = np.zeros(len(s), bool)
                inside[prefix] = True
                posted = np.concatenate([np.arange(cut), prefix[prefix >= cut]])
                parts.append((code, np.where(inside[posted], len(s), -len(s)), s[posted]))
                size += len(posted)
                if size > 1 << 18:
                    yield rows(parts)
                    parts, size = [], 0
        if parts:
            yield rows(parts)

    return docs.mapInArrow(run, "shingle long, set long, n long")


def shared_postings(posted: DataFrame) -> DataFrame:
    """Of postings with several sets, a row for each: shingle, set, n, and the
    least set and its size.  Postings pass by in order, so a posting of any
    length takes the memory of one row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # the last row, with the first row of its posting and whether that is out
        for batch in batches:
            if not batch.num_rows:
                continue
            h, s, n = (batch.column(i).to_numpy() for i in range(3))
            if last is not None:
                h, s, n = (np.concatenate([[x], y]) for x, y in zip(last[:3], (h, s, n)))
            new = np.concatenate([[True], np.diff(h) != 0])
            fresh = new | np.concatenate([[True], np.diff(s) != 0])
            first = np.flatnonzero(new)
            group = np.cumsum(new) - 1
            low, low_n = s[first][group], n[first][group]
            if last is not None:
                own = group == 0
                low, low_n = np.where(own, last[3], low), np.where(own, last[4], low_n)
            # Rows after the least set, and the least set's row once one follows.
            later = fresh & (s != low)
            if last is not None:
                later[0] = False
            out = np.flatnonzero(later)
            opened = np.unique(group[out])
            if last is not None and last[5]:
                opened = opened[opened != 0]
            at = first[opened]
            rows = [np.concatenate([h[at], h[out]]), np.concatenate([low[at], s[out]]), np.concatenate([low_n[at], n[out]]), np.concatenate([low[at], low[out]]), np.concatenate([low_n[at], low_n[out]])]
            done = bool((group[out] == group[-1]).any()) or (last is not None and group[-1] == 0 and last[5])
            last = (h[-1], s[-1], n[-1], low[-1], low_n[-1], done)
            if len(rows[0]):
                yield pa.RecordBatch.from_arrays([pa.array(r, pa.int64()) for r in rows], names=["shingle", "set", "n", "low", "low_n"])

    dealt = posted.repartition("shingle").sortWithinPartitions("shingle", "set")
    return dealt.mapInArrow(run, "shingle long, set long, n long, low long, low_n long")


#: Bits of the map that tells which documents' sets are asked for: for each, and
#: at least and at most (powers of 2).
SHARE, LEAST, MOST = 16, 15, 28


def whole_sets(docs: DataFrame, wanted: DataFrame, width: int, clashes: frozenset[int] = frozenset()) -> DataFrame:
    """set, n and shingles (bytes) of the documents ``wanted`` (id, set).

    A bitmap of bounded size goes to the tasks, so texts need no shuffle; what
    it lets through besides has no partner in later joins.  Past its bound it
    lets more through, and the table grows to that of all sets at most."""
    asked_for = 1 << min(MOST, max(LEAST, (wanted.count() * SHARE).bit_length()))
    h = F.col("set").bitwiseXOR(F.col("id")).bitwiseAND(asked_for - 1) + 1  # buckets hold numbers from 1
    maps = wanted.groupBy(F.bitmap_bucket_number(h).alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("bits"))
    bits = bytearray(asked_for // 8)
    for r in maps.collect():
        at = (r.bucket - 1) * (1 << 12)
        bits[at : at + (1 << 12)] = r.bits
    held = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = held.value
        for batch in batches:
            out, size = [], 0
            for i, t in zip(batch.column(0), _texts(batch)):
                s = shingle_set(t, width)
                code = _name(s, clashes)
                at = (code ^ i.as_py()) & (asked_for - 1)
                if not len(s) or not asked[at >> 3] >> (at & 7) & 1:
                    continue
                out.append((code, len(s), s.tobytes()))
                size += len(s)
                if size > 1 << 18:
                    yield _set_rows(out)
                    out, size = [], 0
            if out:
                yield _set_rows(out)

    return docs.mapInArrow(run, "set long, n long, shingles binary")


def _set_rows(out: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    a, b, c = zip(*out)
    return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array(c, pa.binary())], names=["set", "n", "shingles"])


def verified(pairs: DataFrame, sets: DataFrame, fine: DataFrame, num: int, den: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of sets that are similar."""
    # Sizes that do not go together leave no room for the overlap needed either.
    fit = scratch.written(_close(pairs, fine, num, den), "close")
    left = sets.select(F.col("set").alias("a"), F.col("shingles").alias("s_a"))
    right = sets.select(F.col("set").alias("b"), F.col("shingles").alias("s_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                p, q = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = overlap(p, q)
                keep.append(both * den >= num * (len(p) + len(q) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in (batch.column(0), batch.column(1))], names=["a", "b"])

    return fit.join(left, "a").join(right, "b").select("a", "b", "s_a", "s_b").mapInArrow(run, "a long, b long")


def _close(pairs: DataFrame, bits: DataFrame, num: int, den: int) -> DataFrame:
    """Pairs whose fine bitmaps allow the overlap needed.  They are a tenth of
    whole sets, and tell nearly all pairs that are not similar."""
    left = bits.select(F.col("set").alias("a"), F.col("n").alias("n_a"), F.col("bits").alias("bits_a"))
    right = bits.select(F.col("set").alias("b"), F.col("n").alias("n_b"), F.col("bits").alias("bits_b"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n, m = batch.column(2).to_numpy(), batch.column(3).to_numpy()
            x, y = (np.frombuffer(b"".join(batch.column(i).to_pylist()), np.uint64).reshape(-1, FINE) for i in (4, 5))
            # A bit of one set alone is a shingle that the other does not have.
            alone = [np.bitwise_count(u & ~v).sum(axis=1).astype(np.int64) for u, v in ((x, y), (y, x))]
            room = np.minimum(n - alone[0], m - alone[1])
            keep = pa.array(room >= least_overlap(n, m, num, den))
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in (0, 1)], names=["a", "b"])

    return pairs.join(left, "a").join(right, "b").select("a", "b", "n_a", "n_b", "bits_a", "bits_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """set and component (its least set) of every set with a link.

    Each round takes the least label around and then follows labels of labels,
    so long chains fold in few rounds.  Rounds are written, so each starts from
    files; nothing but the number of changes reaches the driver."""
    edges = scratch.written(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = scratch.written(edges.groupBy(F.col("a").alias("set")).agg(F.least(F.min("b"), F.first("a")).alias("component")), "labels")
    while True:
        around = edges.join(labels.select(F.col("set").alias("b"), "component"), "b").groupBy(F.col("a").alias("set")).agg(F.min("component").alias("near"))
        nearer = labels.join(around, "set").select("set", F.least("component", "near").alias("next"), F.col("component").alias("was"))
        nearer = scratch.written(nearer, "nearer")
        jump = nearer.select(F.col("set").alias("next"), F.col("next").alias("further"))
        after = scratch.written(nearer.join(jump, "next").select("set", F.least("next", "further").alias("component"), "was"), "labels")
        changed = after.where("component <> was").limit(1).count()
        labels = after.select("set", "component")
        if not changed:
            return labels


def bitmap(shingles: np.ndarray, wide: int = WIDE) -> np.ndarray:
    """64 x wide bits of which each shingle sets one."""
    out = np.zeros(64 * wide, bool)
    out[(shingles % np.uint64(64 * wide)).astype(np.int64)] = True
    return np.packbits(out).view(np.uint64)


class Node:
    """A node of a signature tree over rows first to last of sorted arrays."""

    __slots__ = ("bits", "children", "component", "extra", "first", "last", "most", "least")

    def __init__(self, first: int, last: int, n: np.ndarray, component: np.ndarray, extra: np.ndarray, bits: np.ndarray) -> None:
        self.first, self.last = first, last
        part = slice(first, last)
        self.least, self.most = int(n[part].min()), int(n[part].max())
        self.extra = int(extra[part].max())
        c = component[part]
        self.component = int(c[0]) if (c == c[0]).all() else None
        self.children: list[Node] = []
        if last - first <= LEAF:
            self.bits = np.bitwise_or.reduce(bits[part], axis=0)
        else:
            mid = (first + last) // 2
            self.children = [Node(first, mid, n, component, extra, bits), Node(mid, last, n, component, extra, bits)]
            self.bits = self.children[0].bits | self.children[1].bits


def _may_meet(x: Node, y: Node, num: int, den: int) -> bool:
    """Whether some set of x may be similar to one of y of another component."""
    if x.component is not None and x.component == y.component:
        return False
    if x.most * den < y.least * num or y.most * den < x.least * num:
        return False
    # Shared shingles set shared bits; at most ``extra`` of a set's shingles
    # fall on bits that others of it set too.
    room = int(np.bitwise_count(x.bits & y.bits).sum()) + min(x.extra, y.extra)
    return room >= least_overlap(x.least, y.least, num, den)


def tree_pairs(sets: np.ndarray, n: np.ndarray, component: np.ndarray, bits: np.ndarray, num: int, den: int, cut: np.ndarray | None = None, best: bool = False) -> list[tuple[int, int]]:
    """Pairs of different components that may be similar, by dual traversal.

    ``cut``: if given, whether a row is of the left of two chunks; then only
    pairs across are wanted.  ``best``: only each set's most promising pair."""
    if len(sets) <= FEW:
        return _few_pairs(sets, n, component, bits, num, den, cut, best)
    order = np.lexsort((n, component))
    sets, n, component, bits = sets[order], n[order], component[order], bits[order]
    side = cut[order] if cut is not None else None
    extra = n - np.bitwise_count(bits).sum(axis=1).astype(np.int64)
    root = Node(0, len(sets), n, component, extra, bits)
    out, todo = [], [(root, root)]
    top, mate = np.full(len(sets), -1.0), np.zeros(len(sets), np.int64)
    while todo:
        x, y = todo.pop()
        if not _may_meet(x, y, num, den):
            continue
        if x.children or y.children:
            xs, ys = x.children or [x], y.children or [y]
            if x is y:
                todo += [(a, b) for i, a in enumerate(xs) for b in xs[i:]]
            else:
                todo += [(a, b) for a in xs for b in ys]
            continue
        i, j = np.arange(x.first, x.last), np.arange(y.first, y.last)
        room = np.bitwise_count(bits[i][:, None] & bits[j][None]).sum(axis=2).astype(np.int64) + np.minimum(extra[i][:, None], extra[j][None])
        good = (room >= least_overlap(n[i][:, None], n[j][None], num, den)) & (component[i][:, None] != component[j][None])
        if x is y:
            good &= i[:, None] < j[None]
        if side is not None:
            good &= side[i][:, None] != side[j][None]
        if best:
            chance = np.where(good, room / (n[i][:, None] + n[j][None]), -1.0)
            for rows, others, c in ((i, j, chance), (j, i, chance.T)):
                at = c.argmax(axis=1)
                value = c[np.arange(len(rows)), at]
                better = value > top[rows]
                top[rows[better]], mate[rows[better]] = value[better], others[at[better]]
            continue
        out += [(i[p], j[q]) for p, q in zip(*np.nonzero(good))]
    if best:
        out = [(i, mate[i]) for i in np.flatnonzero(top >= 0)]
    return [(min(a, b), max(a, b)) for a, b in ((int(sets[i]), int(sets[j])) for i, j in out)]


#: A tree of so few sets is its leaf: pairs are taken one by one.
FEW = 8


def _few_pairs(sets: np.ndarray, n: np.ndarray, component: np.ndarray, bits: np.ndarray, num: int, den: int, cut: np.ndarray | None, best: bool) -> list[tuple[int, int]]:
    maps = [int.from_bytes(b.tobytes(), "little") for b in bits]
    sets, n, component = sets.tolist(), n.tolist(), component.tolist()
    extra = [x - b.bit_count() for x, b in zip(n, maps)]
    out, top = [], {}
    for i in range(len(sets)):
        for j in range(i):
            if component[i] == component[j] or (cut is not None and cut[i] == cut[j]):
                continue
            room = (maps[i] & maps[j]).bit_count() + min(extra[i], extra[j])
            if room < least_overlap(n[i], n[j], num, den):
                continue
            pair = (min(sets[i], sets[j]), max(sets[i], sets[j]))
            out.append(pair)
            chance = room / (n[i] + n[j])
            for k in (i, j):
                if chance > top.get(k, (0.0, pair))[0]:
                    top[k] = (chance, pair)
    return list({p for _, p in top.values()}) if best else out


def tree_candidates(postings: DataFrame, num: int, den: int, best: bool = False) -> DataFrame:
    """Distinct pairs (a, b) from ``postings`` (shingle, set, n, component, bits).

    A posting of over POSTING sets is cut into chunks by hash, and each pair of
    chunks is a task's unit: no unit is larger than two chunks."""
    sizes = postings.groupBy("shingle").count().select("shingle", F.ceil(F.col("count") / POSTING).cast("int").alias("chunks"))
    own = F.pmod(F.xxhash64("set"), F.col("chunks")).cast("int")
    other = F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))
    units = postings.join(sizes, "shingle").withColumn("own", own).withColumn("other", other)
    units = units.select("shingle", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "set", "n", "component", "bits")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, ...]] = []
        seen: set[tuple[int, int]] = set()

        def finish(rows: tuple[np.ndarray, ...]) -> None:
            _, i, j, own, sets, n, component, bits = rows
            if len(sets) > 1 and (component != component[0]).any():
                cut = own == i if i[0] != j[0] else None
                seen.update(tree_pairs(sets, n, component, bits, num, den, cut, best))

        def pairs() -> pa.RecordBatch:
            a, b = zip(*seen)
            seen.clear()
            return pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(7)]
            bits = np.frombuffer(b"".join(batch.column(7).to_pylist()), np.uint64).reshape(batch.num_rows, -1)
            rows = (*columns, bits)
            change = np.flatnonzero((np.diff(columns[0]) != 0) | (np.diff(columns[1]) != 0) | (np.diff(columns[2]) != 0)) + 1
            edges = [0, *change.tolist(), len(bits)]
            for a, b in zip(edges, edges[1:]):
                part = tuple(c[a:b] for c in rows)
                if held and any(held[-1][k][-1] != part[k][0] for k in range(3)):
                    finish(tuple(np.concatenate(c) for c in zip(*held)))
                    held = []
                held.append(part)
                if len(seen) > 1 << 17:
                    yield pairs()
        if held:
            finish(tuple(np.concatenate(c) for c in zip(*held)))
        if seen:
            yield pairs()

    dealt = units.repartition("shingle", "i", "j").sortWithinPartitions("shingle", "i", "j")
    return dealt.mapInArrow(run, "a long, b long").distinct()


def _with_bits(sets: DataFrame, wide: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = [bitmap(np.frombuffer(s.as_buffer(), np.uint64), wide).tobytes() for s in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(bits, pa.binary())], names=["set", "n", "bits"])

    return sets.select("set", "n", "shingles").mapInArrow(run, "set long, n long, bits binary")


def _open(shared: DataFrame, labels: DataFrame | None) -> DataFrame:
    """Postings that hold several components: shingle, set, n, component."""
    if labels is None:
        return shared.select("shingle", "set", "n", F.col("set").alias("component"))
    known = shared.join(labels, "set", "left").select("shingle", "set", "n", F.coalesce("component", "set").alias("component"))
    mixed = known.groupBy("shingle").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("shingle")
    return known.join(mixed, "shingle", "left_semi")


def _stars(known: DataFrame, turn: int) -> DataFrame:
    """One pair (a, b) for each set at most: with the hub of one of its postings,
    if that is of another component.  Hubs are first by a hash that turns change."""
    hub = F.min(F.struct(F.xxhash64(F.lit(turn), "component").alias("h"), F.xxhash64(F.lit(turn), "set").alias("g"), "set", "component", "n")).alias("hub")
    hubs = known.groupBy("shingle").agg(hub)
    met = known.join(hubs, "shingle").where(F.col("component") != F.col("hub.component"))
    own = met.groupBy("set").agg(F.min("hub").alias("hub"))
    return own.select(F.least("set", "hub.set").alias("a"), F.greatest("set", "hub.set").alias("b")).distinct()


def _telling(shared: DataFrame) -> DataFrame:
    """``shared`` without postings of one set alone, and with one of those that
    hold the same sets, as all shingles of a passage do that the same documents
    share: others would give the same pairs again."""
    same = [F.bit_xor(F.xxhash64(F.lit(i), "set")).alias(f"x{i}") for i in (0, 1)]
    kinds = shared.groupBy("shingle").agg(F.min("set").alias("low"), F.max("set").alias("high"), F.count(F.lit(1)).alias("c"), *same).where("low <> high")
    chosen = kinds.groupBy("low", "high", "c", "x0", "x1").agg(F.min("shingle").alias("shingle")).select("shingle")
    return shared.join(chosen, "shingle", "left_semi")


def link(docs: DataFrame, num: int, den: int, width: int, id_col: str, text: str, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """Documents (id as ``key`` gives it, n, set) and components of linked sets
    (set, component)."""
    put = scratch.written
    plain = docs.select(key(id_col).alias("id"), F.col(text).cast("string").alias("text"))
    survey = put(surveyed(plain, width), "survey")
    clashes = clashing(survey)
    name = F.when(F.col("set").isin(list(clashes)), F.col("other")).otherwise(F.col("set")) if clashes else F.col("set")
    documents = survey.where("chunk IS NULL").select("id", "n", "m", name.alias("set"))
    met = put(shared_postings(entries(plain, frequency_classes(survey), num, den, width, clashes)).select("shingle", "set", "n"), "met")
    # What of a set's posted range has company bounds what it shares with any.
    ranged = F.shiftrightunsigned("shingle", 32) < RANGE
    company = met.groupBy("set").agg(F.count(F.when(ranged, 1)).alias("s"))
    first = documents.where("n > 0").groupBy("set").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("m").alias("m"))
    able = company.join(first, "set").where((F.col("s") + F.col("n") - F.col("m")) * den >= F.col("n") * num).select("set")
    shared = put(_telling(put(met.where("n > 0").join(put(able, "able"), "set", "left_semi"), "able-postings")), "shared")
    wanted = first.select("set", "id").join(shared.select("set").distinct(), "set", "left_semi")
    # Copies of a set may pass the bitmap too, and each row of it would join.
    sets = put(whole_sets(plain, put(wanted, "wanted"), width, clashes).dropDuplicates(["set"]), "sets", "zstd")
    fine = put(_with_bits(sets, FINE), "fine")
    links = None
    labels = None
    for turn in range(TURNS):
        known = _open(shared, labels)
        stars = put(_stars(known, turn), "stars")
        found = put(verified(stars, sets, fine, num, den, scratch), "links")
        links = found if links is None else links.unionByName(found)
        labels = components(links, scratch)
    for turn in range(BEST + 1):
        last = turn == BEST
        open_postings = _open(shared, labels).join((fine if last else put(_with_bits(sets, WIDE), "bits")).drop("n"), "set")
        candidates = put(tree_candidates(open_postings, num, den, best=not last), "candidates")
        links = links.unionByName(put(verified(candidates, sets, fine, num, den, scratch), "more-links"))
        labels = components(links, scratch)
    return documents.select("id", "n", "set"), labels


def near_classes(docs: DataFrame, num: int = 3, den: int = 4, width: int = 5, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id (the least id that links reach) of
    every document."""
    with Scratch(docs.sparkSession, "ngrams") as scratch:
        documents, labels = link(docs, num, den, width, id_col, text, scratch)
        first = documents.where("n > 0").groupBy("set").agg(F.min("id").alias("least"))
        named = first.join(labels, "set", "left").withColumn("component", F.coalesce("component", "set"))
        least = named.groupBy("component").agg(F.min("least").alias("component_id"))
        names = named.join(least, "component").select(F.col("set").alias("__set"), "component_id")
        out = documents.join(names, (F.col("set") == F.col("__set")) & (F.col("n") > 0), "left")
        return written(out.select(unkey(F.col("id")).alias("doc_id"), F.col("n").alias("n_shingles"), unkey(F.coalesce("component_id", "id")).alias("component_id")), "classes")
