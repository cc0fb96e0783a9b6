import math
import zlib
from collections import Counter

import numpy as np
import pytest
from helpers import ODD, frame, real, spaced

from parchmill.llm import lm


def brute(rows):
    tokens = [[*spaced(t), None] for _, t in rows]
    train = [zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1 for i, _ in rows]
    c = Counter(w for t, x in zip(tokens, train, strict=True) if x for w in t)
    n, v = sum(c.values()), len(c)
    return [(not x, len(t), sum(c[w] > 0 for w in t), n, sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in t)) for t, x in zip(tokens, train, strict=True)]


@pytest.mark.parametrize("most", [lm.MOST_WORDS, 0])
def test_base(spark, most):
    texts = [r.text for r in real(spark, 300).collect()] + ODD
    docs = frame(spark, texts)
    got = {r.doc_id: r for r in lm.score(docs, most_words=most).collect()}
    want = brute(list(enumerate(texts)))
    assert len(got) == len(want)
    for i, (held, n, known, total, base) in enumerate(want):
        r = got[i]
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held, n, known, total)
        assert abs(r.base_score - base) < 1e-6 * max(1, abs(base)) and r.score < 0


def test_equal_rows_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "a b"), (1, "a b"), (None, None), (2, "c")], "doc_id long, text string")
    for most in (lm.MOST_WORDS, 0):
        assert len(lm.score(docs, most_words=most).collect()) == 4
        assert lm.score(docs.limit(0), most_words=most).collect() == []


def test_levels_stand_for_their_counts():
    rng = np.random.default_rng(1)
    c = np.concatenate([np.arange(1, 300), rng.integers(1, 10**7, 200)])
    for base, first in lm.SCALES:
        q = lm.levels(c, base, first)
        assert q[0] == first and (np.diff(lm.levels(np.arange(1, 5000), base, first)) >= 0).all()
        ratio = lm.count_at(q, base, first)[q > 0] / c[q > 0]
        assert ratio.min() > 1 / base - 1e-9 and ratio.max() < base + 1e-9


def test_levels_are_read_back(spark):
    texts = ["a b " * n for n in (1, 1, 3, 40)] + ["c d", "e f", "e f", "z"] * 3
    docs = frame(spark, texts, [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1][: len(texts)])
    counted = lm.stored(lm.added_up(lm.gathered(docs, 4)))
    words_in, pairs_in = lm.filter_of(counted, 0, 4), lm.filter_of(counted, 1, 4)
    data = np.frombuffer(b"a b c e q", np.uint8)
    t, toff = lm.tokens(data, np.array([0, len(data)]))
    assert words_in.read(t[:5]).tolist() == [*lm.levels(np.array([45, 45, 3, 6]), *lm.SCALES[0]).tolist(), 0]
    two = lm.pairs(t, toff, 4)
    assert pairs_in.read(two).tolist()[1] == 5 and pairs_in.read(two).tolist()[2] == -1


def test_probabilities_after_a_word_sum_to_one_at_most(spark):
    docs = real(spark, 200)
    counted = lm.stored(lm.added_up(lm.gathered(docs.select("doc_id", "text"), 8)))
    pairs_in = lm.filter_of(counted, 1, 8)
    pairs_in.bits = pairs_in.bits | np.random.default_rng(1).integers(0, 256, len(pairs_in.bits), np.uint8)  # as of a filter far too small
    assert pairs_in.false_count() > 0.001
    vocabulary = sorted({w for r in docs.collect() for w in spaced(r.text)})
    data = " ".join(vocabulary).encode()
    t, _ = lm.tokens(np.frombuffer(data, np.uint8), np.array([0, len(data)]))
    c = Counter(w for r in docs.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 != 1 for w in spaced(r.text))
    extra = pairs_in.false_count() * len(vocabulary)
    sums = []
    for word, h in list(zip(vocabulary, t, strict=False))[::97]:
        two = np.ravel([np.full(len(t), h), t], "F")
        mass = pairs_in.count(lm.pairs(two, np.array([0, len(two)]), 8)[1::2]).sum()
        sums.append(mass / max(1.0, c[word] + extra))
    assert np.mean(sums) < 1.2


def test_held_out_text_is_likelier_than_under_the_base(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    rows = lm.score(docs).filter("held_out").collect()
    assert sum(r.score for r in rows) > sum(r.base_score for r in rows)


def test_filters_that_are_not_broadcast_score_alike(spark):
    docs = real(spark, 300).select("doc_id", "text").union(spark.createDataFrame([(None, "a b"), (None, None), (1, "zzz yyy")], "doc_id long, text string"))

    def rows(**most):
        return sorted((-1 if r.doc_id is None else r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6), round(r.score, 6)) for r in lm.score(docs, **most).collect())

    want = rows()
    assert rows(most_bits=1 << 10) == want and rows(most_words=0) == want


def counts(rows):
    kept = [(i, [*spaced(t), None]) for i, t in rows]
    train = [t for i, t in kept if zlib.crc32(b"" if i is None else str(i).encode()) % 5 != 1]
    return kept, Counter(w for t in train for w in t), Counter(p for t in train for p in zip(["<s>", *t], t, strict=False))


def read_back(spark, docs, texts):
    """What the filters return for each token, the one before it and the pair of each text, and what false pairs add after a word."""
    counted = lm.stored(lm.added_up(lm.gathered(docs.select("doc_id", "text"), 32)))
    words_in, pairs_in = lm.filter_of(counted, 0, 32), lm.filter_of(counted, 1, 32)
    out = []
    for text in texts:
        data = np.frombuffer((text or "").encode(), np.uint8)
        t, toff = lm.tokens(data, np.array([0, len(data)]))
        one = words_in.count(t)
        out.append((one, [words_in.count(t[-1:])[0], *one[:-1]], pairs_in.count(lm.pairs(t, toff, 32))))
    return out, pairs_in.false_count()


def test_filters_stand_for_the_counts(spark):
    texts = [*(r.text for r in real(spark, 120).collect()), *ODD]
    got, false = read_back(spark, frame(spark, texts), texts)
    kept, one, two = counts(list(enumerate(texts)))
    off, n, absent, wrong = 0, 0, 0, 0
    for (_, t), (c_one, _, c_two) in zip(kept, got, strict=True):
        for kind, true, read in ((0, [one[w] for w in t], c_one), (1, [two[p] for p in zip(["<s>", *t], t, strict=False)], c_two)):
            true = np.array(true)
            stands = lm.count_at(lm.levels(np.maximum(true, 1), *lm.SCALES[kind]), *lm.SCALES[kind])
            assert (read[true > 0] >= stands[true > 0] - 1e-9).all()  # a count is never lowered
            off, n = off + int((read[true > 0] > stands[true > 0] + 1e-9).sum()), n + int((true > 0).sum())
            absent, wrong = absent + int((true == 0).sum()), wrong + int((read[true == 0] > 0).sum())
    assert off < 0.05 * n and absent > 100 and wrong <= 2 + 1e-3 * absent and 0 < false < 1e-4


@pytest.mark.parametrize("most", [1 << 27, 0])
def test_scores_equal_brute_force(spark, most):
    texts = [*(r.text for r in real(spark, 120).collect()), *ODD]
    docs = frame(spark, texts)
    read, false = read_back(spark, docs, texts)
    _, one, _ = counts(list(enumerate(texts)))
    n, v = sum(one.values()), len(one)
    got = {r.doc_id: r.score for r in lm.score(docs, most_bits=most).collect()}
    for i, (c_one, c_before, c_two) in enumerate(read):
        logs = []
        for a in lm.WEIGHTS:
            logs.append(sum(math.log10(a * min(1.0, p / max(b + false * v, 1.0)) + (1 - a) * (w + 0.5) / (n + 0.5 * (v + 1))) for w, b, p in zip(c_one, c_before, c_two, strict=True)))
        want = max(logs) + math.log10(sum(10 ** (x - max(logs)) for x in logs) / len(logs))
        assert abs(got[i] - want) < 1e-6 * max(1.0, abs(want))


def test_parts_are_folded_chunk_by_chunk(spark, monkeypatch):
    docs = real(spark, 100).select("doc_id", "text")
    want = sorted(map(tuple, lm.added_up(lm.gathered(docs, 3)).drop("segment").collect()), key=str)
    monkeypatch.setattr(lm, "FOLD", 10)
    monkeypatch.setattr(lm, "TOGETHER", 500)
    assert sorted(map(tuple, lm.added_up(lm.gathered(docs, 3)).drop("segment").collect()), key=str) == want


def test_pairs_seen_once_count(spark):
    ids = [i for i in range(200) if zlib.crc32(str(i).encode()) % 5 != 1]
    counted = lm.stored(lm.added_up(lm.gathered(frame(spark, ["a b", "c d", "c d", "e"], ids[:4]), 4)))
    pairs_in = lm.filter_of(counted, 1, 4)
    data = np.frombuffer(b"a b c d e", np.uint8)
    two = lm.pairs(*lm.tokens(data, np.array([0, len(data)])), 4)
    assert pairs_in.count(two)[[1, 2, 4]].tolist() == [1.0, 0.0, 0.0] and pairs_in.count(two)[3] > 1  # a b, b c, d e; c d
