import random

import numpy as np
import pyarrow as pa
import pytest
from helpers import ODD, alnum, spaced
from pyspark.sql import functions as F

from parchmill.llm import common
from parchmill.sources import tables


@pytest.mark.parametrize(("table", "split"), [(common.SPACED, spaced), (common.ALNUM, alnum)])
def test_words_are_those_of_the_patterns(table, split):
    texts = [t or "" for t in ODD]
    raw = [t.encode() for t in texts]
    off = np.cumsum([0, *map(len, raw)])
    data = np.frombuffer(b"".join(raw), np.uint8)
    h, s, e, woff = common.words(data, off, table)
    low = common.LOWER[data]
    seen = {}
    for d, text in enumerate(texts):
        got = [low[s[i] : e[i]].tobytes().decode() for i in range(woff[d], woff[d + 1])]
        assert got == split(text)
        for i, w in zip(range(woff[d], woff[d + 1]), got, strict=True):
            assert seen.setdefault(w, h[i]) == h[i]
    assert len(set(seen.values())) == len(seen)


def test_a_long_text_is_cut_between_words(monkeypatch):
    rng = random.Random(2)
    text = " ".join("".join(rng.choices("abcde", k=rng.choice([1, 5, 40, 3000]))) for _ in range(400)).encode()
    data, off = np.frombuffer(text, np.uint8), np.array([0, 1000, len(text)])
    want = common.words(data, off, common.SPACED)
    monkeypatch.setattr(common, "BLOCK", 700)
    for a, b in zip(common.words(data, off, common.SPACED), want, strict=True):
        assert (a == b).all()


def test_blocks_hold_every_row_once(monkeypatch):
    monkeypatch.setattr(common, "BLOCK", 50)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(ODD))), pa.array(ODD, pa.string())], ["doc_id", "text"])
    got = []
    for part, data, off in common.blocks([batch.slice(0, 3), batch.slice(3), batch.slice(0, 0)]):
        got += [(i, data[a:b].tobytes().decode()) for i, a, b in zip(part.column(0).to_pylist(), off[:-1], off[1:], strict=True)]
    assert got == [(i, t or "") for i, t in enumerate(ODD)]


def test_ranks_are_gapless_in_a_hot_class(spark):
    df = common.stored(spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, 0).otherwise(F.col("id") % 7).alias("c")))
    rows = common.with_rank(df, ["c"], ["id"], "rank", F.col("id")).collect()
    by = {}
    for r in rows:
        by.setdefault(r.c, []).append(r["rank"])
    assert len(rows) == 3000 and all(sorted(x) == list(range(len(x))) for x in by.values())


def test_grams_stay_in_their_document():
    off = np.array([0, 3, 3, 5, 9])
    assert [i for i, x in enumerate(common.within(off, 3, 7)) if x] == [0, 5, 6]
    assert [i for i, x in enumerate(common.within(off, 1, 9)) if x] == list(range(9))


def test_the_shared_folder_is_read_from_the_session(spark):
    class Session:
        def __init__(self, **conf):
            self.conf = conf

    assert tables.scratch(Session(**{"spark.checkpoint.dir": "hdfs://shared/x"})) == "hdfs://shared/x"
    assert tables.scratch(Session(**{"spark.master": "local[4]"})).startswith("file:///")
    with pytest.raises(ValueError):
        tables.scratch(Session(**{"spark.master": "spark://host:7077"}))


def test_stored_tables_are_dropped(spark):
    kept = common.stored(spark.range(5))
    assert kept.count() == 5 and tables.drop_stored(spark) > 0
    with pytest.raises(Exception):
        kept.count()
