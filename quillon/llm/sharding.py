"""Minimax contiguous sharding of atomic groups.

Documents with equal texts form a group that is never parted.  Groups are
ordered by their smallest id.  The smallest capacity ``C`` is searched by
bisection such that the ordered groups fill at most ``shards`` shards of at
most ``C`` bytes, checked greedily; then the order is cut there.

Scale.  Neither the groups nor their sizes reach the driver.  What does is an
index of prefix sums: for each of ``CELLS`` equal ranges of bytes, the smallest
and the largest group end in it and how many there are.  A greedy check on the
index is exact where a range holds at most two group ends; elsewhere it gives a
pessimistic answer (only known ends can be cut) and an optimistic one (any
place in between can).  The search is run under both.  While the two smallest
capacities differ, the ranges around the cuts are split finer by another pass
over the group ends, so the bounded index comes to the exact answer in a few
passes, one more for each factor of about 100 in the input.

Among cuts that keep to ``C``, those nearest to equal shares are taken, so that
slack does not gather in the last shard.

Edge cases: a null text has no bytes and is in one group with empty texts.
Null ids sort first.  Rows may repeat; each copy takes its own slot.  An empty table
gives no rows.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.llm.common import NULL_ID, key, partitions, unkey, written

CELLS = 1 << 15


@dataclass
class Ends:
    """Group ends as far as they are known.

    ``known``: ends, ascending.  ``hidden``: open ranges (a, b) between known
    ends that hold others, ascending and disjoint."""

    known: list[int] = field(default_factory=lambda: [0])
    hidden: list[tuple[int, int]] = field(default_factory=list)

    def last(self, x: int, hopeful: bool) -> int:
        """The largest end that is at most x."""
        at = self.known[bisect_right(self.known, x) - 1]
        if hopeful and self.hidden:
            i = bisect_left(self.hidden, (x, -1)) - 1
            if i >= 0:
                a, b = self.hidden[i]
                at = max(at, min(x, b - 1))
        return at

    def walk(self, capacity: int, shards: int, hopeful: bool) -> list[int]:
        """Greedy cuts; short of the total if ``shards`` do not do."""
        cuts = [0]
        for _ in range(shards):
            cuts.append(self.last(cuts[-1] + capacity, hopeful))
        return cuts

    def least(self, shards: int, hopeful: bool) -> int:
        """The smallest capacity whose greedy cuts reach the total."""
        total = self.known[-1]
        low, high = -(-total // shards), total
        while low < high:
            mid = (low + high) // 2
            if self.walk(mid, shards, hopeful)[-1] >= total:
                high = mid
            else:
                low = mid + 1
        return low


def _spans(ends: Ends, shards: int, low: int, high: int) -> list[tuple[int, int]]:
    """Hidden ranges that a cut of a capacity from low to high may fall into."""
    a, b = ends.walk(low, shards, False), ends.walk(high, shards, True)
    return [h for h in ends.hidden if any(h[0] < y and h[1] > x for x, y in zip(a, b))]


def _cell(spans: list[tuple[int, int]], at: Column) -> Column:
    """The cell of a group end: the spans are dealt CELLS cells by length."""
    whole = sum(b - a for a, b in spans)
    width = max(1, -(-whole // CELLS))
    starts = F.lit([a for a, _ in spans]) if len(spans) > 1 else None
    if starts is None:
        return F.floor((at - spans[0][0]) / width).cast("long")
    return F.struct(F.size(F.filter(starts, lambda s: s < at)).alias("span"), F.floor(at / width).cast("long").alias("cell"))


def _look(ends_df: DataFrame, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """Smallest and largest group end and their number in each cell."""
    inside = None
    for a, b in spans:
        one = (F.col("end") > a) & (F.col("end") < b)
        inside = one if inside is None else inside | one
    cells = ends_df.where(inside).groupBy(_cell(spans, F.col("end")).alias("cell")).agg(F.min("end").alias("a"), F.max("end").alias("b"), F.count_distinct("end").alias("n"))
    return sorted((r.a, r.b, r.n) for r in cells.collect())


def capacity_and_ends(ends_df: DataFrame, total: int, shards: int) -> tuple[int, Ends]:
    """The exact minimax capacity, and an index on which it can be reached.

    ``ends_df``: a column ``end``, the bytes up to the end of each group."""
    known, hidden = {0, total}, [(0, total)]
    while True:
        ends = Ends(sorted(known), sorted(hidden))
        low, high = ends.least(shards, True), ends.least(shards, False)
        if low == high:
            return low, ends
        # A run of few spans keeps the filter small; the widest go first.
        spans = sorted(_spans(ends, shards, low, high), key=lambda s: s[0] - s[1])[:256]
        for s in spans:
            hidden.remove(s)
        for a, b, n in _look(ends_df, spans):
            known |= {a, b}
            if n > 2:
                hidden.append((a, b))


def balanced_cuts(ends: Ends, capacity: int, shards: int) -> list[int]:
    """Cuts among known ends, near equal shares, that keep to the capacity."""
    total, known = ends.known[-1], ends.known
    # The earliest place of each cut from which the rest still fits.
    earliest = [total]
    for _ in range(shards):
        earliest.append(known[bisect_left(known, earliest[-1] - capacity)] if earliest[-1] > capacity else 0)
    earliest = earliest[::-1]
    cuts = [0]
    for s in range(1, shards):
        ideal = total * s // shards
        i = bisect_left(known, ideal)
        near = min(known[max(i - 1, 0) : i + 1] or [total], key=lambda k: abs(k - ideal))
        most = known[bisect_right(known, cuts[-1] + capacity) - 1]
        cuts.append(min(max(near, earliest[s], cuts[-1]), most))
    return [*cuts, total]


def shard(docs: DataFrame, shards: int = 24, id_col: str = "doc_id", text: str = "text", overhead: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot of each document.

    ``size`` is the UTF-8 bytes of the text plus ``overhead``.  ``slot`` counts
    a shard's documents from 0 by group and id."""
    spark = docs.sparkSession
    n = partitions(spark)
    rows = docs.select(
        key(id_col).alias("id"),
        (F.coalesce(F.octet_length(text), F.lit(0)) + overhead).cast("long").alias("size"),
        F.crc32(F.coalesce(F.col(text), F.lit(""))).alias("crc"),
        F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)).alias("group"),
    )
    rows = written(rows, "sizes")
    # Combined before the shuffle: a group of any size is one row from a task.
    groups = rows.groupBy("group").agg(F.min("id").alias("first"), F.sum("size").alias("group_size"), F.count("*").alias("copies"))
    many = written(groups.where("copies > 1").select(F.col("group").alias("g"), "first", "group_size", "copies"), "groups")
    # Groups of over a quarter of a partition's rows are fewer than four for each
    # partition, so they can be broadcast; others do not fill one.
    large = F.col("copies") * (4 * n) > rows.count()
    met = rows.join(F.broadcast(many.where(large)), F.col("group") == F.col("g"), "left")
    columns = ["id", "size", "crc", F.coalesce("first", "id").alias("first"), F.coalesce("group_size", "size").alias("group_size"), "group"]
    others = met.where("g IS NULL").select("id", "size", "crc", "group").join(many.where(~large), F.col("group") == F.col("g"), "left")
    placed = met.where("g IS NOT NULL").select(*columns).unionByName(others.select(*columns))
    # Groups whose smallest id is the same (null, or repeated with other texts) are told apart by a hash.
    placed = placed.withColumn("group", F.xxhash64("group"))
    # Ranges of (first, id) part even a group of copies over many tasks.  Its
    # first row stands for the group; equal rows are never parted.
    dealt = written(placed.repartitionByRange(n, "first", "group", "id").withColumn("part", F.spark_partition_id()), "dealt")
    order = Window.partitionBy("part").orderBy("first", "group", "id", "crc", "size")
    this, before = F.struct("first", "group", "id"), F.lag(F.struct("first", "group", "id")).over(order)
    head = (F.col("id") == F.col("first")) & ~this.eqNullSafe(before)
    local = dealt.withColumn("weight", F.when(head, F.col("group_size")).otherwise(0)).withColumn("local_rank", F.row_number().over(order))
    local = local.withColumn("local_end", F.sum("weight").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    local = written(local.select("id", "size", "crc", "part", "local_rank", "local_end"), "local")
    # One row for each range: as many as there are partitions.
    parts = local.groupBy("part").agg(F.max("local_end").alias("bytes"), F.max("local_rank").alias("rows"))
    before_it = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = parts.select("part", F.coalesce(F.sum("bytes").over(before_it), F.lit(0)).alias("bytes_before"), F.coalesce(F.sum("rows").over(before_it), F.lit(0)).alias("rows_before"))
    ranked = local.join(F.broadcast(starts), "part").select("id", "size", "crc", (F.col("local_end") + F.col("bytes_before")).alias("end"), (F.col("local_rank") + F.col("rows_before") - 1).alias("rank"))
    ranked = written(ranked, "ranked")
    total = ranked.agg(F.max("end")).first()[0] or 0
    capacity, ends = capacity_and_ends(ranked.select("end"), total, shards)
    cuts = balanced_cuts(ends, capacity, shards)
    number = F.size(F.filter(F.lit(cuts[1:-1]), lambda c: c < F.col("end"))) if shards > 1 else F.lit(0)
    ranked = ranked.withColumn("shard", number)
    # One row for each shard.
    first = F.broadcast(ranked.groupBy("shard").agg(F.min("rank").alias("first_rank")))
    return ranked.join(first, "shard").select(unkey(F.col("id")).alias("doc_id"), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("rank") - F.col("first_rank")).cast("long").alias("slot"))
