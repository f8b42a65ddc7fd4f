"""Line deduplication by an exact set-similarity join.

A line's set is its distinct lower-case words.  A line goes if an earlier line
(by document id, then line number) has a set whose Jaccard similarity with its
own is at least the threshold.  Lines without a word stay.  So do those with
fewer than ``min_tokens`` distinct words where a caller sets such a minimum.

Plan.  (1) Texts are split into words once: a table holds each line's sorted
64-bit hashes by a number that rises with its place, and all that follows reads
it.  The number is the document's, which comes from the id or, where ids repeat
or span over 2^32, from the order of documents, and the line's.  (2) Words are counted by
``SLOTS`` cells of their hashes, which gives each a class of rarity, four to a
doubling.  (3) Each line orders its words by class, then hash, and keeps the
prefix without which no line that is similar enough can do.  (4) Equal sets
become one, at the place of their first line; all others of them go.  Those so short that only an equal set is similar
(at 0.85, up to 5 words) are decided by that.  (5) Sets that share a prefix
word are candidates if sizes allow it (length filter), if enough words are left
after the shared one (positional filter) and if bitmaps of 128 bits do; with 64,
lines of a hundred words fill theirs, and most candidates are unlike.
(6) Candidates are verified on all hashes.

Near-equal lines by the thousand share their prefix, and all pairs among them
must not be made.  The sets of a posting of over ``LARGE`` are therefore first
compared with ``LEADERS`` sets of that posting only, the earliest of each of as
many hash classes; lines that match are decided and no longer look for a match.

Everything is DataFrame functions.  What reaches the driver is the class table,
``SLOTS`` bytes in rows of ``CHUNK``.  What is broadcast are bitmaps that choose
rows without a shuffle (``_among``), of at most ``2 ** MOST`` bits; beyond that
more rows pass them than need to, and the joins that follow still decide.
Postings are joined, and pairs verified, in ``ROUNDS`` parts by hash, each of
which frees its shuffle, and tables go when their last reader has run.

Edge cases: a null text has no lines.  A null document id comes first (and
-2^63 with it).  Of rows that share an id, those with another text are apart,
in the order of a hash of their texts; of rows equal in id and text one counts
as the first, and all lines with a word of the others go.  An empty table gives
no rows.  Other columns are left alone.
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import NULL_ID, Scratch, key, partitions, words, written

SLOTS = 1 << 19
CHUNK = 1 << 12
LARGE = 256
LEADERS = 4
ROUNDS = 2
#: Bits of bitmaps that choose rows: for each key, and at most (a power of 2).
SHARE, MOST = 16, 28
#: A number p is the document's, then these bits for the line's.
LINE_BITS = 31


@dataclass(frozen=True)
class Similar:
    """Jaccard of at least ``num / den``."""

    num: int = 17
    den: int = 20
    min_tokens: int = 1

    def prefix(self, n: Column) -> Column:
        """n - ceil(t n) + 1 words, of which any similar set has one."""
        return (n - F.ceil(n * self.num / F.lit(self.den)) + 1).cast("int")

    def by_equality(self, n: Column) -> Column:
        """Whether only an equal set is similar to a set of n words."""
        return (F.floor(n * self.den / F.lit(self.num)) == n) & (F.ceil(n * self.num / F.lit(self.den)) == n) & (self.overlap(n, n) >= n)

    def overlap(self, n: Column, m: Column) -> Column:
        """The least overlap of sets of n and m words: t / (1 + t) (n + m)."""
        return F.ceil((n + m) * self.num / F.lit(float(self.num + self.den)) - 1e-9)


def repeated(docs: DataFrame, id_col: str = "doc_id") -> bool:
    """Whether rows share an id; then their texts tell them apart."""
    return not docs.groupBy(key(id_col)).count().where("count > 1").isEmpty()


def row_of(text: str, shared: bool) -> Column:
    return F.xxhash64(text) if shared else F.lit(0).cast("long")


def numbered(docs: DataFrame, shared: bool, scratch: Scratch, id_col: str = "doc_id", text: str = "text") -> tuple[DataFrame, Callable[[DataFrame], DataFrame]]:
    """``doc`` and text of all rows, where ``doc`` is of 32 bits and rises with id
    and row; and what gives rows with ``doc`` their id and row."""
    lo, hi = docs.agg(F.min(F.col(id_col).cast("long")), F.max(F.col(id_col).cast("long"))).first()
    if not shared and (lo is None or hi - lo < (1 << 32) - 2):
        low = F.lit(lo or 0).cast("long")
        doc = F.coalesce(F.col(id_col).cast("long") - low + 1, F.lit(0).cast("long"))
        back = F.when(F.col("doc") > 0, F.col("doc") - 1 + low).otherwise(F.lit(NULL_ID))
        return docs.select(doc.alias("doc"), F.col(text).alias("text")), lambda x: x.withColumns({"id": back, "row": F.lit(0).cast("long")})
    rows = docs.select(key(id_col).alias("id"), row_of(text, shared).alias("row"), F.col(text).alias("text"))
    order = rows.select("id", "row").distinct().repartitionByRange(partitions(docs.sparkSession), "id", "row").sortWithinPartitions("id", "row")
    order = scratch.written(order.select("id", "row", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1).alias("i")), "order")
    counts = {r["part"]: r["count"] for r in order.groupBy("part").count().collect()}
    starts = [sum(counts.get(k, 0) for k in range(part)) for part in range(max(counts, default=-1) + 1)]
    start = F.from_json(F.lit(str(starts)), "array<bigint>")
    order = order.select("id", "row", (F.get(start, F.col("part")) + F.col("i")).alias("doc"))
    return rows.join(order, ["id", "row"]).select("doc", "text"), lambda x: x.join(order, "doc")


def lines_of(docs: DataFrame) -> DataFrame:
    """p and line of every line of ``docs`` (doc, text) that is not null, with a
    space for any white space."""
    plain = F.when(F.col("text").rlike(r"[\x09\x0B-\x0D]"), F.translate("text", "\t\x0b\x0c\r", "    ")).otherwise(F.col("text"))
    lines = docs.select("doc", F.posexplode(F.split(plain, "\n", -1)).alias("i", "line"))
    return lines.select(F.call_function("shiftleft", "doc", F.lit(LINE_BITS)).bitwiseOR(F.col("i").cast("long")).alias("p"), "line")


def word_sets(lines: DataFrame, min_tokens: int = 1) -> DataFrame:
    """The lines' numbers, ``words``, the ascending hashes of distinct words, and
    two hashes of those, k1 and k2."""
    hashes = F.transform(F.split(F.lower("line"), " ", -1), lambda w: F.xxhash64(w))
    # Whether a line has a word is asked of its text: a filter on the hashes would have them made twice.
    some = lines.where(F.ltrim("line") != "")
    sets = some.select("p", F.sort_array(F.array_except(hashes, F.array(F.xxhash64(F.lit(""))))).alias("words"))
    sets = sets if min_tokens <= 1 else sets.where(F.size("words") >= min_tokens)
    return sets.select("p", "words", F.xxhash64("words").alias("k1"), F.xxhash64(F.lit(1), "words").alias("k2"))


def rarity_table(sets: DataFrame, slots: int = SLOTS) -> bytes:
    """A byte for each cell of hashes: its class, which rises by one each time
    that the count of the cell's words rises by a fourth root of 2."""
    cell = F.col("h").bitwiseAND(slots - 1).cast("int")
    counts = sets.select(F.explode("words").alias("h")).groupBy(cell.alias("cell")).count()
    # 32 doublings fit 127 classes; whatever is more frequent is of the last.
    level = F.least(F.floor(4 * F.log2("count")).cast("int") + 1, F.lit(127))
    pairs = counts.select((F.col("cell") / CHUNK).cast("int").alias("chunk"), F.struct((F.col("cell") % CHUNK).alias("i"), level.alias("v")).alias("e"))
    # Characters stand for classes; cells without words are filled in below.
    row = F.transform(F.sort_array(F.collect_list("e")), lambda e: F.concat(F.format_string("%03x", e["i"]), F.format_string("%02x", e["v"])))
    table = bytearray(slots)
    for r in pairs.groupBy("chunk").agg(F.array_join(row, "").alias("s")).collect():
        raw = r.s
        for j in range(0, len(raw), 5):
            table[r.chunk * CHUNK + int(raw[j : j + 3], 16)] = int(raw[j + 3 : j + 5], 16)
    return bytes(table)


def _class(n: int) -> int:
    return min(127, math.floor(4 * math.log2(n)) + 1)


def _rank(h: Column, table: Column, slots: int) -> Column:
    """A long that rises with the class of frequency, then by hash."""
    level = F.get(table, h.bitwiseAND(slots - 1).cast("int")).cast("long")
    return F.call_function("shiftleft", level, F.lit(56)).bitwiseOR(F.shiftrightunsigned(h, 8))


def _bits(hashes: Column) -> dict[str, Column]:
    """A bitmap of 128 bits, in two columns, of which each hash sets one."""
    one, none = F.lit(1).cast("long"), F.lit(0).cast("long")
    bit = lambda h: F.call_function("shiftleft", one, h.bitwiseAND(63).cast("int"))
    of = lambda half: F.aggregate(hashes, none, lambda acc, h: F.when(h.bitwiseAND(64) == half, acc.bitwiseOR(bit(h))).otherwise(acc))
    return {"low": of(0), "high": of(64)}


def line_sets(sets: DataFrame, table: bytes, similar: Similar) -> DataFrame:
    """p, n, low, high (a bitmap) and prefix of ``sets``, and its other columns."""
    classes = F.from_json(F.lit(str(list(table)).replace(" ", "")), "array<tinyint>")
    ranks = F.sort_array(F.transform("words", lambda h: _rank(h, classes, len(table))))
    n = F.size("words")
    return sets.withColumns({"n": n, **_bits(F.col("words")), "prefix": F.slice(ranks, 1, similar.prefix(n))}).drop("words", "k1", "k2")


def _repeats(words_of: DataFrame, scratch: Scratch) -> DataFrame:
    """The lines p whose set an earlier line has."""
    of_one = words_of.groupBy("k1", "k2").agg(F.min("p").alias("first"), F.count(F.lit(1)).alias("copies"))
    groups = scratch.written(of_one.where("copies > 1").select("k1", "k2", "first"), "groups")
    rows = _among(words_of.select("p", "k1", "k2"), groups, ["k1", "k2"])
    return scratch.written(rows.join(groups, ["k1", "k2"]).where("p > first").select("p"), "repeats")


def _first_sets(words_of: DataFrame, table: bytes, similar: Similar, scratch: Scratch) -> DataFrame:
    """The sets of lines that repeat none.  They are made in one pass, and only
    those that a bitmap takes for repeats are joined."""
    again = _repeats(words_of, scratch)
    every = scratch.written(line_sets(_marked(words_of.select("p", "words"), again, ["p"]), table, similar), "sets")
    told = scratch.written(every.where("__may").join(again, "p", "left_anti"), "told")
    return every.where("NOT __may").unionByName(told).drop("__may")


def _postings(sets: DataFrame) -> DataFrame:
    return sets.select(*[c for c in sets.columns if c != "prefix"], F.posexplode("prefix").alias("pos", "word"))


def _looking(sets: DataFrame, gone: DataFrame, scratch: Scratch) -> DataFrame:
    """``sets`` with ``look``: false for those among ``gone`` (written).  This is
    exact: of a large group, each that looks in vain meets all earlier ones."""
    marked = _marked(sets, gone, ["p"])
    known = marked.where("__may").join(gone.withColumn("__gone", F.lit(True)), "p", "left")
    known = scratch.written(known.select(*sets.columns, F.col("__gone").isNull().alias("look")), "known")
    return marked.where("NOT __may").select(*sets.columns, F.lit(True).alias("look")).unionByName(known)


def _candidates(later: DataFrame, earlier: DataFrame, similar: Similar, scratch: Scratch, rounds: int = 1) -> DataFrame:
    """Pairs (a, b), b the earlier, that the filters let through.

    ``look`` tells of either which sets look for a match.  Where ``later`` is
    ``earlier``, its rows are dealt out once: what holds of one side is asked
    in terms of both, or it would be a filter that sets the sides apart."""
    a, b = (x.select(*[F.col(c).alias(f"{c}_{k}") for c in x.columns]) for x, k in ((later, "a"), (earlier, "b")))
    most = F.least(F.col("n_a") - F.col("pos_a"), F.col("n_b") - F.col("pos_b"))
    least = similar.overlap(F.col("n_a"), F.col("n_b"))
    fits = (
        (F.col("word_a") == F.col("word_b"))
        & (F.col("p_b") < F.col("p_a"))
        & (F.col("n_a") * similar.num <= F.col("n_b") * similar.den)
        & (F.col("n_b") * similar.num <= F.col("n_a") * similar.den)
        # True of similar sets at the first word that they share.
        & (most >= least)
        # Each bit that differs is a word in one set alone.
        & (F.bit_count(F.col("low_a").bitwiseXOR(F.col("low_b"))) + F.bit_count(F.col("high_a").bitwiseXOR(F.col("high_b"))) <= F.col("n_a") + F.col("n_b") - 2 * least)
    )
    if "look" in later.columns:
        fits &= F.col("look_a") | (F.col("look_b") & (F.col("p_b") >= F.col("p_a")))
    out = None
    for i in range(rounds):
        part = F.pmod(F.col("word_a"), F.lit(rounds)) == i, F.pmod(F.col("word_b"), F.lit(rounds)) == i
        one = scratch.written(a.where(part[0]).join(b.where(part[1]), fits).select(F.col("p_a").alias("a"), F.col("p_b").alias("b")).distinct(), "pairs")
        out = one if out is None else out.unionByName(one)
    return out.distinct() if rounds > 1 else out


#: Bits of one map of Spark's bitmap functions.
MAP = 1 << 15


def _marked(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """``rows`` with ``__may``: true if ``columns`` are among ``keys`` (written),
    and for few others, by a broadcast bitmap."""
    width = 1 << min(MOST, max(15, math.ceil(math.log2(max(1, keys.count()) * SHARE))))
    h = F.xxhash64(*columns).bitwiseAND(width - 1) + 1
    maps = keys.groupBy(F.bitmap_bucket_number(h).alias("__map")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(h)).alias("__bits"))
    at = F.bitmap_bit_position(h).cast("int")
    byte = F.conv(F.hex(F.substring(F.col("__bits"), F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    is_set = byte.bitwiseAND(F.call_function("shiftleft", F.lit(1), (at % 8).cast("int"))) != 0
    marked = rows.join(F.broadcast(maps), F.bitmap_bucket_number(h) == F.col("__map"), "left")
    return marked.withColumn("__may", F.coalesce(is_set, F.lit(False))).drop("__map", "__bits")


def _among(rows: DataFrame, keys: DataFrame, columns: list[str]) -> DataFrame:
    """The rows whose ``columns`` are among ``keys`` (written), and few others."""
    return _marked(rows, keys, columns).where("__may").drop("__may")


def _without(rows: DataFrame, keys: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is not among ``keys`` (written).  Only those that
    the bitmap takes for one of them are joined, so what stays is not dealt out."""
    marked = _marked(rows, keys, [column])
    told = marked.where("__may").join(keys, column, "left_anti")
    return marked.where("NOT __may").unionByName(told).drop("__may")


def _verified(words_of: DataFrame, pairs: DataFrame, similar: Similar, scratch: Scratch) -> DataFrame:
    """The sets a of pairs (a, b) that are similar, by all hashes of their words."""
    numbers = scratch.written(pairs.select(F.explode(F.array("a", "b")).alias("p")).distinct(), "numbers")
    asked = scratch.written(_among(words_of.select("p", "words"), numbers, ["p"]), "asked", "zstd")
    a, b = (asked.select(F.col("p").alias(x), F.col("words").alias(f"w_{x}")) for x in "ab")
    both = F.size(F.array_intersect("w_a", "w_b"))
    union = F.size("w_a") + F.size("w_b") - both
    found = None
    for i in range(ROUNDS):
        part = pairs.where(F.pmod(F.xxhash64("a"), F.lit(ROUNDS)) == i)
        one = part.join(a, "a").join(b, "b").where(both * similar.den >= union * similar.num)
        one = scratch.written(one.select(F.col("a").alias("p")).distinct(), "found")
        found = one if found is None else found.unionByName(one)
    scratch.drop(numbers, asked)
    return found


def kept_places(docs: DataFrame, similar: Similar = Similar(), id_col: str = "doc_id", text: str = "text", shared: bool | None = None) -> DataFrame:
    """id, row and ``kept``, the numbers of eligible lines that stay; an id is as
    ``key`` gives it."""
    shared = repeated(docs, id_col) if shared is None else shared
    with Scratch(docs.sparkSession, "lines") as scratch:
        put = scratch.written
        of, named = numbered(docs, shared, scratch, id_col, text)
        words_of = put(word_sets(lines_of(of), similar.min_tokens), "words", "zstd")
        sets = _first_sets(words_of, rarity_table(words_of), similar, scratch)
        joined = sets.where(~similar.by_equality(F.col("n")))
        postings = _postings(joined)
        # A word's cell counts all lines that have it, so it is in no lower class.
        frequent = F.shiftrightunsigned("word", 56) >= _class(LARGE)
        hot = put(postings.where(frequent).groupBy("word").count().where(F.col("count") > LARGE).select("word"), "hot-words")
        gone = []
        if not hot.isEmpty():
            near = put(_among(postings.where(frequent), hot, ["word"]), "hot-postings")
            leader = near.groupBy("word", F.pmod(F.xxhash64("p"), F.lit(LEADERS)).alias("c")).agg(F.min(F.struct(*[c for c in near.columns if c != "word"])).alias("l")).select("word", "l.*")
            gone.append(put(_verified(words_of, _candidates(near, leader, similar, scratch), similar, scratch).distinct(), "near-leaders"))
            scratch.drop(near)
            postings = _postings(_looking(joined, gone[0], scratch))
        gone.append(_verified(words_of, _candidates(postings, postings, similar, scratch, ROUNDS), similar, scratch))
        every = gone[0] if len(gone) == 1 else gone[0].unionByName(gone[1])
        left = _without(sets.select("p"), put(every.distinct(), "all-gone"), "p")
        line = F.col("p").bitwiseAND((1 << LINE_BITS) - 1).cast("int")
        kept = left.groupBy(F.shiftrightunsigned("p", LINE_BITS).alias("doc")).agg(F.sort_array(F.collect_list(line)).alias("kept"))
        return written(named(kept).select("id", "row", "kept"), "kept")


def dedup_lines(docs: DataFrame, similar: Similar = Similar(), id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with ``text`` without the lines that go, and the columns
    ``n_lines``, ``removed`` (line numbers, ascending) and ``n_left``, how many
    lines of those that could go are left."""
    shared = repeated(docs, id_col)
    kept = kept_places(docs, similar, id_col, text, shared).select(F.col("id").alias("__id"), F.col("row").alias("__row"), F.col("kept").alias("__kept"))
    rows = docs.withColumns({"__key": key(id_col), "__of": row_of(text, shared)})
    rows = rows.withColumn("__copy", F.row_number().over(Window.partitionBy("__key", "__of").orderBy(F.lit(1))) if shared else F.lit(1))
    none = F.array().cast("array<int>")
    lines = F.coalesce(F.split(F.col(text), "\n", -1), F.array().cast("array<string>"))
    every = F.when(F.size("__lines") > 0, F.sequence(F.lit(0), F.size("__lines") - 1)).otherwise(none)
    line = lambda i: F.get("__lines", i)
    if similar.min_tokens > 1:
        able = F.filter("__every", lambda i: F.size(F.array_distinct(words(F.lower(line(i))))) >= similar.min_tokens)
    else:
        able = F.filter("__every", lambda i: F.ltrim(line(i), F.lit(" \t\x0b\x0c\r")) != "")
    stays = F.when(F.col("__copy") == 1, F.coalesce("__kept", none)).otherwise(none)
    return (
        rows.join(kept.hint("shuffle_hash"), (F.col("__key") == F.col("__id")) & (F.col("__of") == F.col("__row")), "left")
        .withColumn("__lines", lines)
        .withColumn("__every", every)
        .withColumn("n_left", F.size(stays).cast("long"))
        .withColumn("removed", F.array_except(able, stays))
        .withColumn("n_lines", F.size("__lines").cast("long"))
        .withColumn(text, F.when(F.size("removed") > 0, F.array_join(F.transform(F.array_except("__every", "removed"), line), "\n")).otherwise(F.col(text)))
        .drop("__key", "__of", "__copy", "__id", "__row", "__kept", "__lines", "__every")
    )
