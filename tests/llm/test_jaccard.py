import random

import numpy as np
import pytest
from helpers import ODD, frame, real, spaced

from parchmill.llm import jaccard


def sets(texts, k):
    out = []
    for t in texts:
        w = spaced(t)
        out.append({tuple(w[i : i + k]) for i in range(max(1, len(w) - k + 1))} if w else set())
    return out


def brute(ids, texts, k, num, den):
    s = sets(texts, k)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, x in zip(ids, s, strict=True):
        for e in x:
            where.setdefault(e, []).append(i)
    at = dict(zip(ids, s, strict=True))
    pairs = {(a, b) for v in where.values() if len(v) < 3000 for n, a in enumerate(v) for b in v[:n]}
    for a, b in pairs:
        x, y = at[a], at[b]
        if 0.7 < len(x) / len(y) < 1.5 and den * len(x & y) >= num * len(x | y):
            i, j = sorted((find(a), find(b)))
            root[j] = i
    return {i: (len(at[i]), find(i)) for i in ids}


def rows(df):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in df.collect()}


@pytest.mark.parametrize(("k", "num"), [(3, 90), (5, 80)])
def test_documents(spark, k, num):
    docs = real(spark)
    want = brute(*zip(*[(r.doc_id, r.text) for r in docs.collect()], strict=True), k, num, 100)
    assert len({c for _, c in want.values()}) < len(want) - 20
    assert rows(jaccard.near_duplicates(docs, k, num, 100)) == want


def made(seed, n):
    """Chains of ever more edited copies, so that links, near misses and steps over several texts all occur."""
    rng = random.Random(seed)
    out = []
    while len(out) < n:
        size = rng.choice([1, 2, 3, 5, 9, 12, 14, 17, 20, 25, 33, 48, 80, 150])
        base = [f"w{rng.randint(0, 400)}" for _ in range(size)]
        for _ in range(rng.randint(1, 30)):
            out.append(" ".join(base))
            for _ in range(rng.randint(0, 1 + size // 40)):
                p = rng.randrange(len(base) + 1)
                base[p : p + rng.randint(0, 1)] = [f"w{rng.randint(0, 400)}"] * rng.randint(0, 1)
            base = base or ["w"]
    rng.shuffle(out)
    return out[:n]


@pytest.mark.parametrize("k", [1, 3])
@pytest.mark.parametrize("num", [80, 90])
def test_chains(spark, k, num):
    texts = made(k, 500)
    docs = frame(spark, texts)
    assert rows(jaccard.near_duplicates(docs, k, num, 100)) == brute(list(range(500)), texts, k, num, 100)


def test_odd_texts(spark):
    texts = [*ODD, *ODD, "A b", "a B", "a b c d", "a b c d e"]
    got = rows(jaccard.near_duplicates(frame(spark, texts), 3, 90, 100))
    assert got == brute(list(range(len(texts))), texts, 3, 90, 100)
    assert got[0] == (0, 0) and got[len(ODD)] == (0, len(ODD))
    assert rows(jaccard.near_duplicates(frame(spark, ["a"]).limit(0))) == {}


def test_rows_that_share_an_id(spark):
    docs = spark.createDataFrame([(5, "a b c"), (5, "x y z"), (7, "x y z"), (3, "a b c"), (None, "q")], "doc_id long, text string")
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.near_duplicates(docs, 3, 90, 100).collect())
    assert got == [(-1, -1), (3, 3), (5, 3), (5, 3), (7, 3)]


@pytest.mark.parametrize("boundary", [0, 6, 1 << 30])
@pytest.mark.parametrize(("num", "den"), [(9, 10), (8, 10), (1, 2)])
def test_linked_sets_share_a_key(num, den, boundary):
    rng = np.random.default_rng(7)
    schemes = jaccard.Schemes(num, den, boundary)
    tested = 0
    for _ in range(1500):
        n = int(rng.integers(1, 120))
        base = rng.integers(0, 1 << 63, n).astype(np.uint64)
        drop, add = (int(rng.integers(0, 2 + n // 8)) for _ in range(2))
        other = np.unique(np.concatenate([base[min(drop, n - 1) :], rng.integers(0, 1 << 63, add).astype(np.uint64)]))
        base = np.unique(base)
        if jaccard.linked(base, other, num, den):
            tested += 1
            both = np.concatenate([base, other])
            key, owner = schemes.keys(both, np.array([0, len(base), len(both)]), np.ones(2, bool))
            assert set(key[owner == 0]) & set(key[owner == 1])
    assert tested > 200


@pytest.mark.parametrize("at", [0, 4, 1 << 30])
def test_the_boundary_changes_no_result(spark, monkeypatch, at):
    monkeypatch.setattr(jaccard, "boundary", lambda plain: at)
    texts = made(11, 300)
    assert rows(jaccard.near_duplicates(frame(spark, texts), 2, 80, 100)) == brute(list(range(300)), texts, 2, 80, 100)


def test_the_boundary_is_where_lists_cost_least(spark, monkeypatch):
    """Small sets that share most of their blocks make long lists of blocks; without such, lists are cheap and subsets are not."""
    rng = random.Random(3)
    words = [f"w{i}" for i in range(14)]
    alike = [" ".join(rng.sample(words, 7)) for _ in range(4000)]
    apart = [" ".join(f"v{rng.randrange(10**9)}" for _ in range(9)) for _ in range(900)]
    monkeypatch.setattr(jaccard, "PROBED", 1)
    found = []
    for texts in (alike, apart):
        data = np.frombuffer("".join(texts).encode(), np.uint8)
        values, first = jaccard.shingles(data, np.cumsum([0, *map(len, texts)]), 1)
        d1, d2 = jaccard.digests(values, first)
        made_ = [(int(a), int(b), p) for a, b, p in zip(d1.view(np.int64), d2.view(np.int64), jaccard.probes(values, first, 80, 100), strict=True)]
        found.append(jaccard.boundary(spark.createDataFrame(made_, "d1 long, d2 long, probes array<struct<kind:int,key:long>>")))
    schemes = jaccard.Schemes(80, 100)
    assert found[0] > schemes.band(7) and found[1] <= schemes.band(9)


def test_null_ids_hide_no_links(spark):
    text = " ".join(f"w{i}" for i in range(60))
    rows_ = [(None, text), (5, text), (7, text + " more"), (None, "x y z"), (None, text + " other")]
    docs = spark.createDataFrame(rows_, "doc_id long, text string").coalesce(1)
    got = sorted((r.doc_id or -1, r.component_id or -1) for r in jaccard.near_duplicates(docs, 3, 90, 100).collect())
    assert got == [(-1, -1), (-1, -1), (-1, 5), (5, 5), (7, 5)]


def test_blocks_of_a_long_list_meet(spark, monkeypatch):
    """The only list that the two linked sets share begins with one that is near neither of them."""
    monkeypatch.setattr(jaccard, "MOST_IN_LIST", 1)
    texts = ["a b c d g h", "a b c d e", "a b c d"]
    assert rows(jaccard.near_duplicates(frame(spark, texts), 1, 80, 100)) == brute(list(range(3)), texts, 1, 80, 100) == {0: (6, 0), 1: (5, 1), 2: (4, 1)}
