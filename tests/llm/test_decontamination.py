import hashlib

import pytest
from helpers import ODD, SF, alnum, frame, real

from parchmill.llm import decontamination
from parchmill.llm.queries import decontaminated


def brute(docs, items):
    windows = {}
    for item, text in items:
        w = alnum(text)
        size = min(10, len(w))
        for a in range(len(w) - size + 1 if w else 0):
            windows.setdefault(tuple(w[a : a + size]), set()).add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = {}
    for doc, text in docs:
        w = alnum(text)
        hit, found = set(), set()
        for n in sizes:
            for a in range(len(w) - n + 1):
                if items_of := windows.get(tuple(w[a : a + n])):
                    hit |= set(range(a, a + n))
                    found |= items_of
        out[doc] = (len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit))
    return out


def rows_of(df):
    return {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in df.collect()}


@pytest.mark.parametrize("most", [decontamination.MOST_INDEXED, 0])
def test_documents(spark, most):
    docs, items = real(spark, 400 if most else 120), spark.read.parquet(f"{SF}/benchmark.parquet")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert sum(x[4] for x in want.values())
    assert rows_of(decontaminated(docs, items, most)) == want


@pytest.mark.parametrize("most", [decontamination.MOST_INDEXED, 0])
def test_odd_texts(spark, most):
    passage = "One two three four five six seven eight nine ten eleven twelve."
    items = [(1, passage), (2, passage), (3, "short item"), (4, None), (5, " ."), (6, "a"), (7, "five six seven eight nine ten eleven"), (10, "again and again the same words again and again the")]
    texts = [*ODD, passage, passage.upper(), "x " + passage * 3, passage.replace("six", "sex"), "SHORT, item!", "one two three four five six seven eight nine", "nothing here"]
    docs = frame(spark, texts)
    want = brute(list(enumerate(texts)), items)
    made = spark.createDataFrame(items, "item_id long, text string")
    assert rows_of(decontaminated(docs, made, most)) == want
    assert rows_of(decontaminated(docs.limit(0), made, most)) == {}
    assert not any(x[4] for x in rows_of(decontaminated(docs, made.limit(0), most)).values())


def test_spans_are_bytes_of_the_text(spark):
    text = "Ünrelated: one two three four five six seven eight nine ten! End"
    items = spark.createDataFrame([("q", "ONE two three four five six seven eight nine ten")], "item_id string, text string")
    (span,) = decontamination.find(frame(spark, [text]), items).first().spans
    assert text.encode()[span.start : span.end].decode() == "one two three four five six seven eight nine ten"


@pytest.mark.parametrize("most", [decontamination.MOST_INDEXED, 0])
def test_null_ids(spark, most):
    passage = "One two three four five six seven eight nine ten eleven twelve"
    docs = spark.createDataFrame([(None, passage), (None, "nothing here"), (3, f"x {passage} short item")], "doc_id long, text string")
    items = spark.createDataFrame([(None, passage), ("b", passage), (None, "short item")], "item_id string, text string")
    got = sorted((r.n_words, r.doc_id, r.n_hit, r["items"]) for r in decontamination.find(docs, items, most).collect())
    assert got == [(2, None, 0, []), (12, None, 12, [None, "b"]), (15, 3, 14, [None, "b"])]
