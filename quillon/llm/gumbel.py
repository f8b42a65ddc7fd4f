"""Gumbel top-k segmentations of texts over a piece lattice, without replacement.

A text's lattice has a node at each character and an edge for each vocabulary
piece; a character that is no piece has one edge for its bytes.  Pieces have
probabilities by their rank (Zipf's law with an offset), which gives every
segmentation a probability.  Adding independent Gumbel noise to the log
probability of each and taking the k largest draws k distinct segmentations in
order, each next in proportion to probability among the rest.

That is done by perturbed A-star search.  A region of the search space is what
agrees with a sample up to some node and then takes none of some edges.  Its
log mass is exact (by sums over the lattice from the end), and the maximum of
its perturbed log probabilities is one Gumbel, bounded by its parent's.  The
region of largest bound is popped, a segmentation is drawn from it, which is
its maximum, and what is left of it is split along the new path.

Samples carry ``log_p``, the perturbed ``key``, and the inclusion score ``1 -
exp(-exp(log_p - kappa))``, where kappa is the largest key that was left out;
``1 / inclusion`` weighs a sample in sums over segmentations.

Noise comes from a hash of (seed, row key, place), so a row's samples do not
depend on partitions, batches or retries.

Pieces hold a space (shown as U+2581) only at their start, so the lattice falls
into chunks at spaces: chunks that repeat in a batch are built once, and all
walks of a batch are taken side by side.

What a node has besides an excluded edge is summed over its other edges, never
taken as 1 less the edge, so a region of any share is found.

Edge cases: a null text is an empty one.  An empty text has one segmentation,
without pieces, of probability 1.  Texts with fewer than k segmentations give
all.  Null keys hash as such.  Rows that share a key share their noise.
"""

from __future__ import annotations

import heapq
import re
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillon.llm.shingles import _mix

SPACE = "▁"
SCHEMA = "doc_id long, sample int, log_p double, key double, inclusion double, ids binary"
_CHUNK = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")
#: Noise of doubles spans under 41 nats, so a region of a mass this far below
#: another's never has the greater key.
WINDOW = 45.0
#: Edges of a path that are looked at first: mostly what follows is below that.
FIRST = 128
_STEP = [np.uint64(c) for c in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """Pieces, and tables that find them by hashes of code points."""

    def __init__(self, path: str, offset: float = 10.0) -> None:
        from sentencepiece import SentencePieceProcessor

        m = SentencePieceProcessor(model_file=path)
        n = m.get_piece_size()
        pieces = [(m.id_to_piece(i), i) for i in range(n) if not (m.is_byte(i) or m.is_control(i) or m.is_unknown(i) or m.is_unused(i))]
        self.byte = np.array([m.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.uint32)
        self.text = {i: p for p, i in pieces} | {int(i): bytes([b]) for b, i in enumerate(self.byte)}
        rank = {i: r for r, (_, i) in enumerate(sorted(pieces, key=lambda p: (-m.get_score(p[1]), p[1])))}
        weight = np.zeros(n)
        for _, i in pieces:
            weight[i] = 1 / (rank[i] + offset)
        byte_weight = weight[weight > 0].min()
        total = weight.sum() + 256 * byte_weight
        self.log_w = np.log(np.maximum(weight, byte_weight) / total)
        self.log_byte = float(np.log(byte_weight / total))
        # All beginnings of pieces, with the piece that one is, or -1.
        begun = {_hash_text(p[:n]): -1 for p, _ in pieces for n in range(1, len(p))}
        begun |= {_hash_text(p): i for p, i in pieces}
        self.longest = max(len(p) for p, _ in pieces)
        self.tables = _tables(begun)

    def look(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether hashes are of beginnings of pieces, and of which pieces."""
        found, piece, rest = np.zeros(len(h), bool), np.full(len(h), -1, np.int32), None
        for times, shift, keys, ids in self.tables:
            left = h if rest is None else h[rest]
            at = (left * times) >> shift
            hit = keys[at] == left
            to = np.flatnonzero(hit) if rest is None else rest[hit]
            found[to] = True
            piece[to] = ids[at[hit]]
            rest = np.flatnonzero(~hit) if rest is None else rest[~hit]
        return found, piece


#: Bits of the index into the first table of beginnings, and into later ones,
#: which hold few and stay in a core's cache.
_BITS, _LATER_BITS = 20, 15


def _tables(entries: dict[int, int]) -> list[tuple[np.uint64, np.uint64, np.ndarray, np.ndarray]]:
    """Tables of one entry for each slot; what a slot has no room for goes on to
    the next table."""
    out, left, turn = [], entries, 0
    while left:
        turn += 1
        bits = _BITS if turn == 1 else _LATER_BITS
        times = (0x9E3779B97F4A7C15 * (2 * turn + 1)) & ((1 << 64) - 1)
        keys, ids, next_ = np.zeros(1 << bits, np.uint64), np.full(1 << bits, -1, np.int32), {}
        for h, i in left.items():
            at = ((h * times) & ((1 << 64) - 1)) >> (64 - bits)
            if keys[at]:
                next_[h] = i
            else:
                keys[at], ids[at] = h, i
        out.append((np.uint64(times), np.uint64(64 - bits), keys, ids))
        left = next_
    return out


_BASE = 0x9E3779B97F4A7C15 | 1


def _hash_text(text: str) -> int:
    h = 0
    for c in text:
        h = (h * _BASE + ord(c) + 1) & ((1 << 64) - 1)
    return h


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Lattice:
    """The lattices of distinct chunks side by side.

    Node j of chunk c is ``start[c] + j``; edges of a node are ``first[node]``
    to ``first[node + 1]``, with target, piece (negative: code point as bytes),
    and the cumulative probability among the node's edges.  ``ends`` tells of
    nodes whether they are a chunk's last."""

    def __init__(self, chunks: list[str], v: Vocabulary) -> None:
        size = np.array([len(c) for c in chunks], np.int64)
        self.start = np.cumsum(size + 1) - (size + 1)
        self.end = self.start + size
        # Code points with a mark after each chunk, one node for each.
        points = np.frombuffer("\0".join([*chunks, ""]).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
        nodes = len(points)
        left = np.repeat(self.end, size + 1) - np.arange(nodes)
        a, b, ids, logs = [], [], [], []
        covered = np.zeros(nodes, bool)
        self.ends = left == 0
        at = np.flatnonzero(left > 0)
        state = np.zeros(len(at), np.uint64)
        for length in range(1, v.longest + 1):
            state = state * np.uint64(_BASE) + points[at + length - 1] + np.uint64(1)
            begun, piece = v.look(state)
            hit = piece >= 0
            where = at[hit]
            a.append(where)
            b.append(where + length)
            ids.append(piece[hit])
            logs.append(v.log_w[ids[-1]])
            if length == 1:
                covered[where] = True
            # Only what begins a longer piece goes on.
            go = begun & (left[at] > length)
            at, state = at[go], state[go]
            if not len(at):
                break
        bare = np.flatnonzero((left > 0) & ~covered)
        code = points[bare].astype(np.int64)
        n_bytes = 1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF)
        a.append(bare)
        b.append(bare + 1)
        ids.append(-1 - code)
        logs.append(n_bytes * v.log_byte)
        # A node has at most one edge of each length, and lengths come in order:
        # places of edges follow from counts, without a sort.
        degree = np.zeros(nodes, np.int16)
        for x in a:
            degree[x] += 1
        self.first = np.concatenate([[0], np.cumsum(degree, dtype=np.int64)])
        edges = int(self.first[-1])
        small = np.int32 if nodes < 1 << 31 else np.int64
        source, self.target, self.piece, logs_of = np.empty(edges, small), np.empty(edges, small), np.empty(edges, np.int32), np.empty(edges)
        # Sorts of one byte are the quickest.
        turn, ranked = np.zeros(nodes, np.int16), np.empty(edges, np.uint8 if v.longest < 1 << 8 else np.uint16)
        for x, y, i, w in zip(a, b, ids, logs):
            r = turn[x]
            e = self.first[x] + r
            source[e], self.target[e], self.piece[e], logs_of[e], ranked[e] = x, y, i, w, r
            turn[x] = r + 1
        logs = logs_of
        # Sums from the end: all nodes with as many characters left at once.
        beta = np.zeros(nodes)
        most = int(left.max(initial=0))
        of_edge = left.astype(np.uint8 if most < 1 << 8 else np.uint16 if most < 1 << 16 else np.int64)[source]
        by_left = np.argsort(of_edge, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(of_edge, minlength=most + 1))])[1:]
        for lo, hi in zip(bounds, bounds[1:]):
            e = by_left[lo:hi]
            x = logs[e] + beta[self.target[e]]
            s = source[e]
            head = np.flatnonzero(np.concatenate([[True], s[1:] != s[:-1]]))
            top = np.maximum.reduceat(x, head)
            total = np.add.reduceat(np.exp(x - np.repeat(top, np.diff(head, append=len(s)))), head)
            beta[s[head]] = top + np.log(total)
        self.log_p = logs + beta[self.target] - beta[source]
        self.p = np.exp(self.log_p)
        # Sums up to an edge, and of what its node has besides it: from both ends,
        # so that a share near 1 leaves no rounding in place of the rest.
        self.upto, after = self.p.copy(), np.zeros(edges)
        by_rank = np.argsort(ranked, kind="stable")
        bounds = np.concatenate([[0], np.cumsum(np.bincount(ranked))])
        for lo, hi in zip(bounds[1:], bounds[2:]):
            e = by_rank[lo:hi]
            self.upto[e] += self.upto[e - 1]
        for lo, hi in reversed(list(zip(bounds[1:], bounds[2:]))):
            e = by_rank[lo:hi]
            after[e - 1] = self.p[e] + after[e]
        before = np.where(ranked > 0, np.roll(self.upto, 1), 0.0)
        with np.errstate(divide="ignore"):
            self.log_rest = np.log(before + after)
        # Rounding must not let a draw pass a node's last edge.
        last = self.first[1:][degree > 0] - 1
        self.upto[last] = 2.0

    def walk(self, node: np.ndarray, end: np.ndarray, key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Edges drawn from ``node`` to ``end``, one walk after the other, and
        how many each has.  ``key``: 64-bit keys of noise."""
        steps = np.zeros(len(node), np.int64)
        # What is of the walks that go on; all of them have gone as far.
        alive, taken = np.flatnonzero(node < end), []
        at, stop, key = node[alive], end[alive], key[alive]
        while len(alive):
            u = _uniform(key + np.array([len(taken)], np.uint64) * _STEP[0])
            edge = self.first[at]
            wait = np.flatnonzero(u >= self.upto[edge])
            u, after = u[wait], edge[wait]
            while len(wait):
                after += 1
                edge[wait] = after
                on = u >= self.upto[after]
                wait, u, after = wait[on], u[on], after[on]
            taken.append((alive, edge))
            steps[alive] = len(taken)
            at = self.target[edge]
            on = at < stop
            alive, at, stop, key = alive[on], at[on], stop[on], key[on]
        offset = np.cumsum(steps) - steps
        out = np.zeros(int(steps.sum()), np.int64)
        for i, (who, edge) in enumerate(taken):
            out[offset[who] + i] = edge
        return out, steps


def _uniform(x: np.ndarray) -> np.ndarray:
    """Numbers over (0, 1) from 64-bit keys."""
    return ((_mix(x) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _chunks(text: str) -> list[str]:
    """The chunks of a text, each without the space that it begins with."""
    if not text:
        return []
    if "  " not in text and SPACE not in text and text[-1] != " ":
        if text[0] != " ":
            return text.split(" ")
        first, *others = text[1:].split(" ")
        return [SPACE + first, *others]
    return [c[1:] for c in _CHUNK.findall(SPACE + text.replace(" ", SPACE))]


class _Search:
    """The queue of one text.  Samples are lists of edges with log probabilities."""

    __slots__ = ("count", "key", "queue", "samples")

    def __init__(self, key: np.uint64) -> None:
        self.key, self.queue, self.samples, self.count = key, [], [], 0

    def noise(self, n: int) -> np.ndarray:
        """Exponential noise for n regions."""
        at = np.arange(self.count, self.count + n, dtype=np.uint64)
        self.count += n
        return -np.log(_uniform((self.key ^ _STEP[1]) + at * _STEP[2]))

    def add(self, lattice: Lattice, edges: np.ndarray, key: float, start: int, out: tuple[int, ...], k: int) -> None:
        """A sample, and the regions that its path from ``start`` splits off.

        ``out``: the edges already excluded at ``start``."""
        logs = lattice.log_p[edges]
        self.samples.append((edges, float(logs.sum()), key))
        at = float(logs[:start].sum())
        rest = -np.inf if out else None
        if out:
            node = int(np.searchsorted(lattice.first, edges[start], side="right")) - 1
            left = sum(lattice.p[i] for i in range(lattice.first[node], lattice.first[node + 1]) if i not in out and i != edges[start])
            rest = float(np.log(left)) if left else -np.inf
        for n in (FIRST, 256, len(edges)):
            part = logs[start : start + n]
            before = at + part.cumsum() - part
            mass = before + lattice.log_rest[edges[start : start + n]]
            if rest is not None and len(mass):
                mass[0] = before[0] + rest
            best = mass.max(initial=-np.inf)
            good = (mass > best - WINDOW).nonzero()[0]
            if len(part) < n or (len(good) >= k and best - before[-1] > WINDOW):
                break
        if len(good) < k:  # all are wanted, however small
            good = np.flatnonzero(mass > -np.inf)
        if not len(good):
            return
        # Gumbels of that mass, of which the k largest, then at most the sample's key.
        low = np.log(self.noise(len(good))) - mass[good]
        top = low.argpartition(k - 1)[:k] if len(low) > k else np.arange(len(low))
        for t, bound in zip(good[top].tolist(), np.logaddexp(-key, low[top]).tolist()):
            shut = (*(out if t == 0 else ()), int(edges[start + t]))
            heapq.heappush(self.queue, (bound, len(self.samples) - 1, start + t, shut))


def sample_batch(texts: list[str], keys: np.ndarray, k: int, v: Vocabulary) -> list[list[tuple[float, float, float, np.ndarray]]]:
    """For each text up to k samples (log_p, key, inclusion, ids)."""
    split = [_chunks(t) for t in texts]
    counts = np.array([len(cs) for cs in split], np.int64)
    number: defaultdict[str, int] = defaultdict(count().__next__)
    flat = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(counts.sum()))
    lattice = Lattice([SPACE + c for c in number], v)
    begin = np.cumsum(counts) - counts
    text_of = np.repeat(np.arange(len(texts)), counts)
    place = np.arange(len(flat)) - begin[text_of]
    noise = _mix(keys[text_of] + place.astype(np.uint64) * _STEP[1])
    start, end = lattice.start[flat], lattice.end[flat]
    edges, steps = lattice.walk(start, end, noise)
    text_steps = np.bincount(text_of, steps, len(texts)).astype(np.int64)
    at = np.cumsum(text_steps) - text_steps
    searches = [_Search(x) for x in _mix(keys ^ _STEP[0])]
    roots = -np.log(-np.log(_uniform(keys ^ _STEP[2])))
    for i, s in enumerate(searches):
        s.add(lattice, edges[at[i] : at[i] + text_steps[i]], float(roots[i]), 0, (), k)
    for j in range(1, k):
        jobs = []
        for i, s in enumerate(searches):
            if s.queue:
                g, parent, t, shut = heapq.heappop(s.queue)
                old = s.samples[parent][0]
                node = int(np.searchsorted(lattice.first, old[t], side="right")) - 1
                chosen = _other(lattice, node, shut, s)
                # Chunks that the path has closed before, by the nodes it has come to.
                closed = int(np.count_nonzero(lattice.ends[lattice.target[old[:t]]]))
                jobs.append((i, s, -g, old[:t], t, shut, chosen, closed))
        if not jobs:
            break
        # The chunk of the new edge goes on from its target, later ones anew.
        spans = [np.arange(begin[i] + c, begin[i] + counts[i]) for i, *_, c in jobs]
        who = np.concatenate(spans)
        first = np.cumsum([len(x) for x in spans]) - [len(x) for x in spans]
        from_node = start[who].copy()
        from_node[first] = [lattice.target[job[6]] for job in jobs]
        fresh, n = lattice.walk(from_node, end[who], _mix(noise[who] + np.array([j], np.uint64) * _STEP[2]))
        ends = np.cumsum(np.add.reduceat(n, first))
        for (_, s, g, head, t, shut, chosen, _), lo, hi in zip(jobs, [0, *ends[:-1]], ends):
            s.add(lattice, np.concatenate([head, [chosen], fresh[lo:hi]]), g, t, shut, k)
    out = []
    for s in searches:
        kappa = -s.queue[0][0] if s.queue else -np.inf
        rows = []
        for e, log_p, g in s.samples:
            inclusion = 1.0 if kappa == -np.inf else float(-np.expm1(-np.exp(min(log_p - kappa, 700.0))))
            rows.append((log_p, g, inclusion, _ids(lattice.piece[e], v)))
        out.append(rows)
    return out


def _other(lattice: Lattice, node: int, shut: tuple[int, ...], s: _Search) -> int:
    """An edge of a node that is not shut, by probability."""
    low, high = lattice.first[node : node + 2].tolist()
    own = [(i, p) for i, p in enumerate(lattice.p[low:high].tolist(), low) if i not in shut]
    s.count += 1
    u = float(_uniform(np.array([s.key]) + np.array([s.count], np.uint64) * _STEP[0])[0]) * sum(p for _, p in own)
    for i, p in own:
        u -= p
        if u < 0:
            break
    return i


def _ids(pieces: np.ndarray, v: Vocabulary) -> np.ndarray:
    """Piece ids, with characters that are no piece as the ids of their bytes."""
    bare = np.flatnonzero(pieces < 0)
    if not len(bare):
        return pieces.astype(np.uint32)
    out = pieces.copy()
    code = -1 - pieces[bare]
    out[bare] = v.byte[np.minimum(code, 255)]
    wide = bare[code > 127]
    if not len(wide):
        return out.astype(np.uint32)
    parts, last = [], 0
    for i in wide.tolist():
        parts += [out[last:i], v.byte[list(chr(-1 - int(pieces[i])).encode("utf-8", "surrogatepass"))]]
        last = i + 1
    return np.concatenate([*parts, out[last:]]).astype(np.uint32)


def decode(ids: np.ndarray, v: Vocabulary) -> str:
    """The text of ids: pieces joined, bytes as UTF-8, the first space dropped."""
    raw = b"".join(p if isinstance(p := v.text[i], bytes) else p.encode() for i in ids.tolist())
    return raw.decode("utf-8", "replace").replace(SPACE, " ")[1:]


def row_keys(ids: list[int | None], seed: int) -> np.ndarray:
    plain = np.array([0 if i is None else i & ((1 << 64) - 1) for i in ids], np.uint64)
    null = np.array([i is None for i in ids], np.uint64)
    return _mix(_mix(plain + _STEP[0]) ^ (null * _STEP[1]) ^ _mix(np.full(1, seed, np.uint64)))


def sample_segmentations(docs: DataFrame, k: int = 3, seed: int = 1, path: str | None = None, id_col: str = "doc_id", text: str = "text", batch_chars: int = 1 << 21) -> DataFrame:
    """doc_id, sample (from 0, by falling key), log_p, key, inclusion and ids
    (little-endian unsigned 32-bit).  ``batch_chars`` bounds what is built at
    once, and memory with it, but for single texts."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from quillon.llm.tokens import chunks

        v = vocabulary(path)
        for batch in batches:
            rows = list(zip(batch.column(0).to_pylist(), (t or "" for t in batch.column(1).to_pylist())))
            for part in chunks(rows, [len(t) + 1 for _, t in rows], batch_chars):
                ids, texts = zip(*part)
                found = sample_batch(list(texts), row_keys(list(ids), seed), k, v)
                flat = [(d, n, *s[:3], s[3].tobytes()) for d, samples in zip(ids, found) for n, s in enumerate(samples)]
                types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.float64(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*flat), types)], names=["doc_id", "sample", "log_p", "key", "inclusion", "ids"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, SCHEMA)


def decode_segmentations(samples: DataFrame, path: str | None = None) -> DataFrame:
    """``samples`` (doc_id, sample, ids) as doc_id, sample and text."""
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            texts = [decode(np.frombuffer(i.as_py(), "<u4"), v) for i in batch.column(2)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "sample", "text"])

    return samples.select("doc_id", "sample", "ids").mapInArrow(run, "doc_id long, sample int, text string")
