import hashlib
import random

import numpy as np
import pytest
from helpers import ODD, frame, real

from parchmill.llm import suffixes


def brute(rows):
    """rows in the order that decides what is earlier."""
    seen, out = set(), []
    for text in rows:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for s in range(len(b) - 99):
            x = b[s : s + 100]
            if x in seen:
                gone[s] += 1
                gone[s + 100 if s + 100 <= len(b) else len(b)] -= 1
            seen.add(x)
        gone = np.cumsum(gone)[:-1] > 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone]) if b else b""
        out.append((len(b), int(gone.sum()), int((np.diff(np.concatenate([[0], gone.astype(int)])) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def rows(df):
    return {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in df.collect()}


def check(spark, texts):
    got = rows(suffixes.removal_digests(frame(spark, texts)))
    assert [got[i] for i in range(len(texts))] == brute(texts)


def test_documents(spark):
    texts = [r.text for r in real(spark, 500).collect()]
    assert sum(x[1] for x in brute(texts)) > 1000
    check(spark, texts)


def made(seed, n):
    rng = random.Random(seed)
    passages = ["".join(rng.choices("abcd é", k=rng.choice([99, 100, 101, 130, 400]))) for _ in range(12)]
    out = []
    for _ in range(n):
        bits = [rng.choice(passages)[rng.choice([0, 0, 1, 30]) :] if rng.random() < 0.6 else "".join(rng.choices("abcd é", k=rng.randint(0, 150))) for _ in range(rng.randint(0, 5))]
        out.append("".join(bits))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_passages(spark, seed, monkeypatch):
    check(spark, made(seed, 150))


def test_many_small_parts(spark, monkeypatch):
    """Parts of a few entries, so that the strings of most passages lie across borders."""
    monkeypatch.setattr(suffixes, "PART_BYTES", 10_000)
    monkeypatch.setattr(suffixes, "PART_ENTRIES", 7)
    monkeypatch.setattr(suffixes, "MOST_IDS", 3)
    monkeypatch.setattr(suffixes, "TOGETHER", 4_000)
    check(spark, made(5, 120))


def test_a_passage_in_every_document(spark, monkeypatch):
    monkeypatch.setattr(suffixes, "PART_BYTES", 20_000)
    monkeypatch.setattr(suffixes, "PART_ENTRIES", 25)
    rng = random.Random(8)
    common = "".join(rng.choices("abcdefgh ", k=180))
    texts = ["".join(rng.choices("xyz ", k=rng.randint(0, 90))) + common[rng.choice([0, 0, 0, 20, 70]) :] + "".join(rng.choices("xyz ", k=rng.randint(0, 90))) for _ in range(250)]
    check(spark, texts)


def test_multikey_quicksort_sorts_bytes():
    rng = np.random.default_rng(4)
    for n, width, letters in ((0, 100, 2), (1, 100, 2), (500, 100, 2), (3000, 100, 256), (2000, 64, 1), (4000, 13, 3)):
        rows = rng.integers(0, letters, (n, width)).astype(np.uint8)
        if n > 100:
            rows[: n // 2] = rows[rng.integers(0, 20, n // 2)]
            rows[: n // 2, -1] = rng.integers(0, 3, n // 2)
        order = suffixes.multikey_order(rows)
        assert sorted(order.tolist()) == list(range(n))
        assert [bytes(r) for r in rows[order]] == sorted(bytes(r) for r in rows)
        if n:
            agree = suffixes.Agreement(rows)
            for m in (0, 1, width // 2, width):
                of = {}
                for r, c in zip(rows, agree.classes(m).tolist(), strict=True):
                    of.setdefault(c, set()).add(bytes(r[:m]))
                assert all(len(x) == 1 for x in of.values()) and len(of) == len({bytes(r[:m]) for r in rows})


def test_borders_lose_nothing():
    """The entries of a part, and the same cut in two at any suffix and compared across the border, give the same spans."""
    texts = made(9, 60)
    e = np.concatenate([suffixes.with_reach(i, d, suffixes.anchors(d, np.array([0, len(d)]))[0]) for i, t in enumerate(texts) for d in [np.frombuffer(t.encode(), np.uint8)]])

    def run(parts, borders):
        spans, strings = {}, {}
        for part, own in zip(parts, borders, strict=True):
            if not len(part):
                continue
            for batch in suffixes.second_sort([part.tobytes()], own):
                for i, sp, string, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                    if string is None:
                        spans.setdefault(i, []).extend(sp)
                    else:
                        strings.setdefault(string, []).append((i, start))
        for places in strings.values():
            for i, start in sorted(places)[1:]:
                spans.setdefault(i, []).extend([start, start + 100])
        return {i: suffixes.merged(1 << 20, [], [np.array(x)]) for i, x in spans.items() if x}

    want = run([e], [()])
    keys = suffixes.suffixes(e)
    for cut in np.sort(keys)[:: max(1, len(keys) // 25)]:
        low = keys < cut
        assert run([e[low], e[~low]], [(bytes(cut),), (bytes(cut),)]) == want


def test_odd_texts(spark):
    check(spark, [*ODD, *ODD, "a" * 99, "a" * 100, "a" * 101, "ab" * 300, "é" * 50, "é" * 51])
    assert rows(suffixes.removal_digests(frame(spark, ["a"]).limit(0))) == {}


def test_a_long_text_is_hashed_in_chunks(spark, monkeypatch):
    rng = random.Random(3)
    text = "".join(rng.choices("abcdefgh ", k=30_000))
    for chunk in (1000, 1 << 20):
        monkeypatch.setattr(suffixes, "CHUNK", chunk)
        data = np.frombuffer((text + text[5000:9000]).encode(), np.uint8)
        p, h = suffixes.anchors(data, np.array([0, 12_000, len(data)]))
        if chunk == 1000:
            first = p, h
    assert (first[0] == p).all() and (first[1] == h).all()


def test_repeated_and_null_ids(spark):
    t = made(4, 1)[0] * 3 + "x" * 150
    docs = spark.createDataFrame([(2, t), (2, t), (None, t), (1, "y" * 120)], "doc_id long, text string")
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.n_removed) for r in suffixes.removal_digests(docs).collect())
    alone = brute([t])[0][1]
    assert got == [(-1, alone), (1, brute(["y" * 120])[0][1]), (2, len(t.encode())), (2, len(t.encode()))]


def test_whole_characters_are_kept():
    text = "éé".encode()
    assert suffixes.kept_text(text, [(1, 3)]) == ("éé", 0)
    assert suffixes.kept_text(text, [(0, 3)]) == ("é", 2)
