import numpy as np
from helpers import ODD, frame, real, spaced

from parchmill.llm import quality

SMALL = "/root/testdata/sf0.1"


def test_held_out_labels(spark):
    """Fitted on half of the labels, held against the other half."""
    docs, labels = spark.read.parquet(f"{SMALL}/documents.parquet"), spark.read.parquet(f"{SMALL}/labels.parquet")
    fit, held = labels.filter("doc_id % 2 = 0"), labels.filter("doc_id % 2 = 1")
    rows = quality.select(docs, fit).join(held, "doc_id").collect()
    bad = [r.kept for r in rows if r.quality == 0]
    good = [r.kept for r in rows if r.quality == 1 and r.toxic == 0]
    assert len(bad) > 200 and np.mean(bad) < 0.02
    assert len(good) > 1000 and np.mean(good) > 0.998


def brute(docs, marks, cost, seed=quality.SEED):
    """The whole selection by plain loops: models, weights, threshold, keys and the k largest."""
    import math

    def grams(text):
        w = spaced(text)
        data = np.frombuffer((text or "").encode(), np.uint8)
        h, s, e, _ = quality.words(data, np.array([0, len(data)]), quality.SPACED)
        shape = [int(x) for x in quality.shapes(data, s, e)]
        shape = [x ^ int(quality.AGAIN) if i and w[i] == w[i - 1] else x for i, x in enumerate(shape)]
        m, mix = (1 << 64) - 1, lambda x: int(quality.mix(np.array([x & ((1 << 64) - 1)], np.uint64))[0])
        h = [int(x) for x in h]
        found = [*h, *(mix(3 * a + b) for a, b in zip(h, h[1:], strict=False)), *(mix(x + 1) for x in shape), *(mix(5 * a + b) for a, b in zip(shape, shape[1:], strict=False))]
        return [(x & m) >> 40 for x in found]

    bags = [[g % quality.BUCKETS for g in grams(t)] for _, t in docs]
    raw, target = np.zeros(quality.BUCKETS), np.zeros(quality.BUCKETS)
    for (i, _), bag in zip(docs, bags, strict=True):
        for g in bag:
            raw[g] += 1
            target[g] += marks.get(i) == 1
    share = (raw + 1) / (raw.sum() + len(raw))
    mass = 0.02 * target.sum() + 1
    weight = [round(sum(math.log((target[g] + mass * share[g]) / (target.sum() + mass)) - math.log(share[g]) for g in bag), 6) for bag in bags]
    rates = sorted((w / max(1, len(bag)), marks[i]) for (i, _), bag, w in zip(docs, bags, weight, strict=True) if i in marks)
    best = min(range(len(rates) + 1), key=lambda at: cost * sum(g for _, g in rates[:at]) + sum(not g for _, g in rates[at:]))
    cut = (rates[best - 1][0] + rates[best][0]) / 2
    return {i: (len(bag), w, w - cut * len(bag)) for (i, _), bag, w in zip(docs, bags, weight, strict=True)}


def test_selection_equals_brute_force(spark):
    from pyspark.sql import functions as F

    docs, labels = real(spark, 250).select("doc_id", "text"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    marks = quality.sampled_labels(labels, 20_000)
    rows = quality.select(docs, labels).collect()
    want = brute([(r.doc_id, r.text) for r in docs.collect()], {i: g for i, g in marks.items() if i in {r.doc_id for r in rows}}, quality.COST)
    u = {r.doc_id: r.u for r in docs.select("doc_id", ((F.pmod(F.xxhash64("doc_id", F.lit(quality.SEED)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))).alias("u")).collect()}
    keys = {i: above - np.log(-np.log(u[i])) for i, (_, _, above) in want.items()}
    k = sum(above >= 0 for _, _, above in want.values())
    kept = set(sorted(keys, key=lambda i: (-keys[i], i))[:k])
    assert 0 < k < len(rows)
    for r in rows:
        n, w, _ = want[r.doc_id]
        assert r.n_grams == n and abs(r.weight - w) < 1e-5 and abs(r.key - keys[r.doc_id]) < 1e-4 and r.kept == (r.doc_id in kept)


def test_noise_draws_in_proportion(spark):
    """Rows of little evidence are drawn, rows of much are not left to chance."""
    good = [f"clean words of an ordinary kind number {i % 7} here" for i in range(400)]
    bad = ["zzq 9x9 ;;;; qqq"] * 100
    docs = frame(spark, [*good, *bad, *["clean"] * 300])
    labels = spark.createDataFrame([(i, 1, 0) for i in range(200)] + [(i, 0, 0) for i in range(400, 450)], "doc_id long, quality int, toxic int")
    cold, warm = ({r.doc_id for r in quality.select(docs, labels, k=600, temperature=t).filter("kept").collect()} for t in (1e-9, 50.0))
    assert not cold & set(range(400, 500)) and len(warm & set(range(400, 500))) > 10


def test_words_of_one_shape_share_a_hash():
    def shape(text):
        data = np.frombuffer(text.encode(), np.uint8)
        h, s, e, _ = quality.words(data, np.array([0, len(data)]), quality.SPACED)
        return quality.shapes(data, s, e).tolist()

    a, b, c, d = shape("Hello World, Xy x9")
    assert shape("Ab cd")[0] == a and b != a and d not in (a, b, c)
    assert shape("abc")[0] == shape("z")[0] and shape("a1b")[0] != shape("ab")[0]


def brute_top(rows, k):
    order = sorted(rows, key=lambda r: (-r[1], r[0]))
    cut = order[k - 1]
    return {r[0] for r in rows if (-r[1], r[0]) <= (-cut[1], cut[0])}


def test_top_k_is_exact(spark):
    rng = np.random.default_rng(2)
    for values in (rng.normal(size=300), rng.integers(0, 3, 300).astype(float), np.full(300, 1.5), rng.normal(size=300) * 1e-9 + 1e6):
        rows = list(zip(range(300), map(float, values), strict=True))
        df = spark.createDataFrame(rows, "doc_id long, key double")
        for k in (1, 2, 57, 299):
            assert {r.doc_id for r in quality.top_k(df, k).filter("kept").collect()} == brute_top(rows, k)
        assert quality.top_k(df, 0).filter("kept").count() == 0 and quality.top_k(df, 300).filter("kept").count() == 300


def test_k_is_kept_and_weights_do_not_depend_on_rows(spark):
    docs, labels = real(spark), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    rows = quality.select(docs, labels, k=400).collect()
    assert sum(r.kept for r in rows) == 400 and len(rows) == docs.count()
    assert min(r.key for r in rows if r.kept) >= max(r.key for r in rows if not r.kept)


def test_odd_texts(spark):
    docs = frame(spark, ODD)
    some = spark.createDataFrame([(4, 1, 0), (5, 0, 1), (None, 1, 0), (7, None, None), (9, 1, None), (9, 1, 0)], "doc_id long, quality int, toxic int")
    assert len(quality.select(docs, some).collect()) == len(ODD)
    assert all(r.kept and r.weight == 0 for r in quality.select(docs, some.limit(0)).collect())
    assert quality.select(docs.limit(0), some).collect() == []
