import random
import zlib

import pytest
from helpers import ODD, frame, real

from parchmill.llm import sharding


def brute(sizes, capacity):
    left, out = [], []
    for size in sizes:
        fits = [i for i, x in enumerate(left) if x >= size]
        if fits:
            i = min(fits, key=lambda i: (left[i], i))
        else:
            left.append(max(capacity, size))
            i = len(left) - 1
        left[i] -= size
        out.append(i)
    return out


def bins(counts, plan):
    """The bin of each group, the largest size first, in the order of ranks."""
    out = []
    for size in sorted(counts, reverse=True):
        at = [None] * counts[size]
        for lo, hi, first, each in plan[size]:
            for r in range(lo, hi):
                assert at[r] is None
                at[r] = first + (r - lo) // each
        assert None not in at
        out += at
    return out


def test_best_fit_matches_brute_force():
    """Groups of a size are alike, so bins are the same up to the order of bins that are alike."""
    rng = random.Random(5)
    for _ in range(200):
        counts = {rng.randint(1, 50): rng.randint(1, 9) for _ in range(rng.randint(0, 25))}
        sizes = sorted((s for s, n in counts.items() for _ in range(n)), reverse=True)
        capacity = rng.randint(20, 90)
        got, want = bins(counts, sharding.best_fit_decreasing(counts, capacity)), brute(sizes, capacity)

        def contents(b):
            held = {}
            for s, i in zip(sizes, b, strict=True):
                held.setdefault(i, []).append(s)
            return sorted(held.values())

        assert contents(got) == contents(want) and sorted(set(got)) == list(range(len(set(want))))
        n = len(set(want))
        assert n == 0 or sharding.best_fit_decreasing(counts, capacity, n) is not None and sharding.best_fit_decreasing(counts, capacity, n - 1) is None


@pytest.mark.parametrize("counts", [{}, {5: 1}, {100: 1, 1: 3}, {7: 10}, {50: 1, 40: 1, 3: 1, 2: 1, 1: 2}, {100: 3, 1: 1}, {9: 4}, {9: 5}])
def test_even_uses_no_more_shards_than_asked(counts):
    got = bins(counts, sharding.even(counts, 4)) if counts else []
    assert len(got) == sum(counts.values()) and all(0 <= b < 4 for b in got)


def test_sizes_are_rounded_up_a_little(spark):
    from pyspark.sql import functions as F

    sizes = [1, 8, 32767, 32768, 32769, 65535, 65536, 65537, 99_999_999, 2**40 + 1]
    got = [r.x for r in spark.createDataFrame([(s,) for s in sizes], "s long").select(sharding.rounded(F.col("s")).alias("x")).collect()]
    assert got[:4] == sizes[:4] and all(s <= x < s * (1 + 2 / sharding.EXACT) for s, x in zip(sizes, got, strict=True))


def check(docs, rows, n):
    assert sorted(r.doc_id for r in rows) == sorted(r.doc_id for r in docs.collect())
    text = {r.doc_id: r.text or "" for r in docs.collect()}
    shards, places = {}, {}
    for r in rows:
        assert r.size == len(text[r.doc_id].encode()) + 8 and r.text_crc32 == zlib.crc32(text[r.doc_id].encode())
        assert shards.setdefault(text[r.doc_id], r.shard) == r.shard and 0 <= r.shard < n
        places.setdefault(r.shard, []).append(r.slot)
    assert all(sorted(x) == list(range(len(x))) for x in places.values())


def test_documents(spark):
    docs = real(spark)
    rows = sharding.shard(docs, 24).collect()
    check(docs, rows, 24)
    sums = [sum(r.size for r in rows if r.shard == s) for s in range(24)]
    assert max(sums) - min(sums) < 0.01 * max(sums)


def test_odd_texts_and_a_hot_group(spark):
    docs = frame(spark, [*ODD, *["copy " * 400] * 30])
    check(docs, sharding.shard(docs, 4).collect(), 4)
    assert sharding.shard(docs.limit(0), 4).collect() == []


def test_capacity(spark):
    docs = frame(spark, ["x" * n for n in range(1, 200)])
    rows = sharding.shard(docs, None, capacity=4000).collect()
    sums = {}
    for r in rows:
        sums[r.shard] = sums.get(r.shard, 0) + r.size
    assert max(sums.values()) <= 4000 and len(sums) <= -(-sum(sums.values()) // 4000) + 1
