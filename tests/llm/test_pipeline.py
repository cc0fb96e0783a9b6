import numpy as np
import pytest
from helpers import ODD
from test_decontamination import brute as leaks
from test_jaccard import brute as near

import corpus_pipeline
from parchmill.llm.queries import table

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted((tuple(r) for r in df.select(*corpus_pipeline.COLUMNS).collect()), key=str)


def cut(texts):
    """The texts without bytes of 100-byte strings that start earlier; characters cut into stay whole."""
    seen, out = set(), []
    for text in texts:
        b = (text or "").encode()
        gone = np.zeros(len(b) + 101, bool)
        for s in range(len(b) - 99):
            if b[s : s + 100] in seen:
                gone[s : s + 100] = True
            seen.add(b[s : s + 100])
        kept, at = "", 0
        for ch in text or "":
            n = len(ch.encode())
            kept += "" if gone[at : at + n].all() else ch
            at += n
        out.append(kept)
    return out


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = table(spark, SF, "documents"), []
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF).cache()
        out.append(docs)
    return out


def test_names_and_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_classifier", "near_duplicates", "suffix_dedup", "benchmark_decontamination", "packing"]


def test_quality_keeps_clean_documents(spark, stages):
    kept = {r.doc_id for r in stages[0].collect()}
    labels = table(spark, SF, "labels").collect()
    assert all(r.doc_id in kept for r in labels if r.quality == 1 and not r.toxic)
    assert not any(r.doc_id in kept for r in labels if r.quality == 0)


def test_one_document_of_each_group_stays(stages):
    before = sorted(stages[0].collect(), key=lambda r: r.doc_id)
    found = near([r.doc_id for r in before], [r.text for r in before], 5, 80, 100)
    assert rows(stages[1]) == sorted((tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in before if found[r.doc_id][1] == r.doc_id), key=str)


def test_repeats_are_cut_out(stages):
    before = sorted(stages[1].collect(), key=lambda r: r.doc_id)
    want = [(r.doc_id, t, r.lang, r.source, len(t)) for r, t in zip(before, cut([r.text for r in before]), strict=True) if t == r.text or t.strip(" ")]
    assert rows(stages[2]) == sorted(want, key=str)
    assert any(t != r.text for r, t in zip(before, cut([r.text for r in before]), strict=True))


def test_leaks_go(spark, stages):
    before = stages[2].collect()
    hit = leaks([(r.doc_id, r.text) for r in before], [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()])
    assert rows(stages[3]) == sorted((tuple(r[c] for c in corpus_pipeline.COLUMNS) for r in before if not hit[r.doc_id][4]), key=str)


def test_every_kept_document_is_packed(stages):
    assert {r.doc_id for r in stages[4].collect()} == {r.doc_id for r in stages[3].collect()}


def test_run_is_the_stages(spark, stages):
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, stages[4].collect()))


def test_copies_that_share_an_id_or_have_none(spark):
    text, other = " ".join(f"w{i}" for i in range(80)), " ".join(f"v{i}" for i in range(80))
    rows_ = [(4, text), (4, text), (None, other), (None, other + " more"), (9, other), (7, text + " more"), (4, "quite another text of its own"), (None, None), (None, None)]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows_], "doc_id long, text string, lang string, source string, n_chars long")
    got = corpus_pipeline.near_duplicates(spark, docs, SF).collect()
    near_ones = [r for r in got if r.text and "w1 " in r.text]
    assert len(near_ones) == 1 and near_ones[0].doc_id == 4
    assert [r.doc_id for r in got if r.text and "v1 " in r.text] == [None]
    assert sum(r.text is None for r in got) == 2 and sum(r.text == "quite another text of its own" for r in got) == 1 and len(got) == 5


def test_odd_rows_pass_through(spark):
    docs = spark.createDataFrame([(i, t, None, "s", None, "x") for i, t in enumerate(ODD)] + [(None, "null id", "en", "s", 7, "x"), (3, None, None, None, None, "x")], "doc_id long, text string, lang string, source string, n_chars long, kept string")
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), SF).collect() == []
        docs = stage(spark, docs, SF).cache()
        docs.collect()
