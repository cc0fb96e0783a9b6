"""Sharding by best-fit decreasing bin packing of indivisible groups (operator 8).

Groups of equal texts never part. They are taken by size, the largest first, and each enters the tightest shard that has room for
it, found through a balanced tree of the shards by remaining capacity. Groups of one size are alike, so the packing runs over the sizes
and their counts, and puts as many groups of a size at once as the tightest shard takes: what comes out is that of group by
group. A size of over EXACT bytes is rounded up by less than one part in EXACT for the packing (not in what it returns), so that there are only a few hundred
thousand sizes at any size of input. Each group then finds its shard from its rank among the groups of its size.

With a fixed capacity the packing opens the shards of best-fit decreasing. With a fixed number of
shards the capacity is the smallest found with which that number suffices (as in MULTIFIT); a group
larger than an even share gets a shard of its own first, and the others share the rest evenly.

Null text counts as no bytes and is equal to empty text. Rows with equal doc_id are separate rows. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from parchmill.llm.common import stored, with_rank

#: Sizes up to this many bytes are packed as they are.
EXACT = 1 << 15
#: Groups of over one part in this many of all rows are sent around when rows look for their group's shard.
HOT = 1_000
#: Capacities that are tried between one that suffices and one that doesn't.
TRIES = 8


class Tree:
    """A treap of distinct keys: the balanced tree of open bins by (remaining capacity, bin)."""

    def __init__(self) -> None:
        self.root: list | None = None
        self.seed = 1

    def _split(self, t, key):
        if t is None:
            return None, None
        if t[0] < key:
            a, b = self._split(t[3], key)
            t[3] = a
            return t, b
        a, b = self._split(t[2], key)
        t[2] = b
        return a, t

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, key: tuple[int, int]) -> None:
        self.seed = self.seed * 6364136223846793005 + 1442695040888963407 & (1 << 64) - 1
        a, b = self._split(self.root, key)
        self.root = self._merge(self._merge(a, [key, self.seed >> 20, None, None]), b)

    def take_from(self, need: int) -> tuple[int, int] | None:
        """Removes and returns the least key whose capacity is at least `need`."""
        a, b = self._split(self.root, (need, -1))
        if b is None:
            self.root = a
            return None
        least = b
        while least[2] is not None:
            least = least[2]
        _, b = self._split(b, (least[0][0], least[0][1] + 1))
        self.root = self._merge(a, b)
        return least[0]


def best_fit_decreasing(counts: dict[int, int], capacity: int, most: int | None = None) -> dict[int, list[tuple[int, int, int, int]]] | None:
    """For each size the segments (first rank, end rank, first bin, groups a bin) of its groups; None if more than `most` bins would
    be needed. Bins of one remaining capacity are a run in the tree: (remaining, first bin), and how many."""
    tree, opened = Tree(), 0
    runs: dict[tuple[int, int], int] = {}
    plan: dict[int, list[tuple[int, int, int, int]]] = {}

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            tree.add((left, first))
            runs[left, first] = n

    for size in sorted(counts, reverse=True):
        n, done, segments = counts[size], 0, []
        while done < n:
            found = tree.take_from(size)
            (left, first), many = (found, runs.pop(found)) if found else ((max(capacity, size), opened), -1)
            each = left // size
            used = -(-(n - done) // each)
            if many < 0:
                many = used
                opened += used
                if most is not None and opened > most:
                    return None
            used = min(used, many)
            placed = min(n - done, used * each)
            full, over = divmod(placed, each)
            segments.append((done, done + placed, first, each))
            put(left - each * size, first, full)
            if over:
                put(left - over * size, first + full, 1)
            put(left, first + used, many - used)
            done += placed
        plan[size] = segments
    return plan


def even(counts: dict[int, int], shards: int) -> dict[int, list[tuple[int, int, int, int]]]:
    """The same for a number of shards, and sizes as even as best-fit decreasing gets them: the first shards hold a group alone."""
    total, alone, rest, plan = sum(s * n for s, n in counts.items()), 0, dict(counts), {}
    for size in sorted(counts, reverse=True):
        n = 0
        while n < counts[size] and alone < shards - 1 and size * (shards - alone) > total:
            total -= size
            alone, n = alone + 1, n + 1
        if n:
            plan[size] = [(0, n, alone - n, 1)]
        rest[size] -= n
        if n < counts[size]:
            break
    rest = {s: n for s, n in rest.items() if n}
    if not rest:
        return plan
    left = shards - alone
    lo, step = max(max(rest), -(-total // left)), 1
    best, hi = best_fit_decreasing(rest, lo, left), lo
    while best is None:
        lo, hi, step = hi + 1, hi + step, 4 * step
        best = best_fit_decreasing(rest, hi, left)
    for _ in range(TRIES):
        if lo >= hi:
            break
        mid = (lo + hi) // 2
        got = best_fit_decreasing(rest, mid, left)
        if got is None:
            lo = mid + 1
        else:
            best, hi = got, mid
    for size, segments in best.items():
        before = sum(end - lo for lo, end, _, _ in plan.get(size, []))
        plan[size] = plan.get(size, []) + [(lo + before, end + before, first + alone, each) for lo, end, first, each in segments]
    return plan


def rounded(size: Column) -> Column:
    """The size that a group is packed by."""
    unit = F.pow(F.lit(2.0), F.greatest(F.lit(0), F.floor(F.log2(size.cast("double")) + F.lit(1e-9)) - F.lit(EXACT.bit_length() - 1))).cast("long")
    return F.when(size <= EXACT, size).otherwise(F.ceil(size / unit).cast("long") * unit)


def shard(docs: DataFrame, shards: int | None = 24, capacity: int | None = None) -> DataFrame:
    """Puts every row of (doc_id, text) into a shard: doc_id, size, text_crc32, shard, slot.

    Give either the number of shards or the capacity of each in bytes (UTF-8 bytes of the text plus 8 a row).
    """
    spark = docs.sparkSession
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = stored(docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(text) + F.lit(8)).cast("long").alias("size"), F.crc32(text).alias("text_crc32"), F.unhex(F.sha2(text, 256)).alias("_group")))
    groups = stored(rows.groupBy("_group").agg(F.sum("size").alias("_bytes"), F.count(F.lit(1)).alias("_rows")).withColumn("_packed", rounded(F.col("_bytes"))))
    counts = {r["_packed"]: r["n"] for r in groups.groupBy("_packed").agg(F.count(F.lit(1)).alias("n")).collect()}  # EXACT rows an octave at most
    plan = even(counts, shards) if shards else best_fit_decreasing(counts, capacity)
    segments = spark.createDataFrame(list(plan.items()), "_packed long, _segments array<struct<lo:long,hi:long,first:long,each:long>>")
    ranked = with_rank(groups, ["_packed"], ["_group"], "_rank", F.col("_group")).join(F.broadcast(segments), "_packed")
    mine = F.filter("_segments", lambda s: (s["lo"] <= F.col("_rank")) & (F.col("_rank") < s["hi"]))[0]
    homes = stored(ranked.withColumn("_s", mine).select("_group", "_rows", (F.col("_s.first") + F.expr("(_rank - _s.lo) div _s.each")).cast("int").alias("shard")))
    # The rows of a group of very many meet its shard where they are; the others meet by the group.
    hot = homes.filter(F.col("_rows") > max(1, rows.count() // HOT)).select("_group", F.col("shard").alias("_hot"))
    known = rows.join(F.broadcast(hot), "_group", "left")
    out = known.filter("_hot is not null").withColumnRenamed("_hot", "shard").unionByName(known.filter("_hot is null").drop("_hot").join(homes.drop("_rows"), "_group"))
    return with_rank(stored(out.select("doc_id", "size", "text_crc32", "shard")), ["shard"], ["doc_id", "text_crc32"], "slot", F.col("doc_id"))
