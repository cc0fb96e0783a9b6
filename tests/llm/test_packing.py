import random
import zlib

import numpy as np
import public_tokenizers
from helpers import ODD, frame, real
from tokenizers import Tokenizer

from parchmill.llm import packing
from parchmill.llm.queries import BYTE_BPE


def brute(counts, capacity):
    """Best-fit decreasing, one piece after the other; the number of windows and what is left in each."""
    left = []
    for size in sorted((s for s, n in counts.items() for _ in range(n)), reverse=True):
        fits = [i for i, x in enumerate(left) if x >= size]
        if fits:
            left[min(fits, key=lambda i: left[i])] -= size
        else:
            left.append(capacity - size)
    return sorted(left)


def test_plan_is_best_fit_decreasing():
    rng = random.Random(3)
    for capacity in (1, 7, 16, 100):
        for _ in range(30):
            counts = {rng.randint(1, capacity): rng.randint(1, 40) for _ in range(rng.randint(1, 12))}
            plan = packing.best_fit_decreasing(counts, capacity)
            used, places = {}, set()
            for length, segments in plan.items():
                assert segments[0][0] == 0 and segments[-1][1] == counts[length]
                for lo, hi, first, each, at in segments:
                    for t in range(hi - lo):
                        seq, offset = first + t // each, at + t % each * length
                        used[seq] = used.get(seq, 0) + length
                        places |= {(seq, offset + i) for i in range(length)}
            assert sorted(used) == list(range(len(used)))
            assert len(places) == sum(k * v for k, v in counts.items())
            assert all((s, i) in places for s, n in used.items() for i in range(n))
            assert sorted(capacity - n for n in used.values()) == brute(counts, capacity)


def check(spark, docs):
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rows = packing.pack(docs, BYTE_BPE).collect()
    want = {}
    for r in docs.collect():
        ids = tok.encode(r.text or "", add_special_tokens=False).ids + [0]
        want[r.doc_id] = np.array(ids, "<u4")
    seen, fill = {k: 0 for k in want}, {}
    for r in sorted(rows, key=lambda r: (r.doc_id, r.start)):
        ids = want[r.doc_id]
        assert r.start == seen[r.doc_id] and r.doc_tokens == len(ids)
        seen[r.doc_id] += r.length
        assert r.ids_crc32 == zlib.crc32(ids[r.start : r.start + r.length].tobytes())
    assert all(seen[k] == len(v) for k, v in want.items())
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == fill.get(r.sequence_id, 0)
        fill[r.sequence_id] = r.offset + r.length
    assert sorted(fill) == list(range(len(fill))) and max(fill.values(), default=0) <= 1024
    return rows, fill


def test_documents(spark):
    rows, fill = check(spark, real(spark, 150))
    assert sum(fill.values()) > 0.97 * 1024 * (len(fill) - 1)


def test_odd_texts(spark):
    check(spark, frame(spark, [*ODD, "a<|endoftext|>b", "<|endoftext|><|endoftext|> is one id", "<|endoftext|", " " * 5000, "\n" * 3000 + "x"]))


def test_equal_rows_null_ids_and_no_rows(spark):
    docs = spark.createDataFrame([(1, "same"), (1, "same"), (None, "x"), (1, "other")], "doc_id long, text string")
    rows = packing.pack(docs, BYTE_BPE).collect()
    assert len(rows) == 4 and len({(r.sequence_id, r.offset) for r in rows}) == 4
    assert packing.pack(docs.limit(0), BYTE_BPE).collect() == []


def test_ids_are_returned_on_request(spark):
    row = packing.pack(frame(spark, ["hello there"]), BYTE_BPE, with_ids=True).first()
    assert zlib.crc32(np.array(row.ids, "<u4").tobytes()) == row.ids_crc32
