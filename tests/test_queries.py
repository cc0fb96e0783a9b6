import decimal
import glob
import os
import shutil
import subprocess
import sys
from pathlib import Path

import duckdb
import pytest

from parchmill.plans import queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def db():
    con = duckdb.connect()
    for f in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"create view {os.path.basename(f)[:-8]} as select * from '{f}'")
    return con


def plain(x):
    if x is None or x != x:
        return "null"
    if isinstance(x, (bytes, bytearray)):
        return bytes(x).hex()
    if isinstance(x, (int, float, decimal.Decimal)) and not isinstance(x, bool):
        return repr(round(float(x), 6))
    return str(x)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


@pytest.mark.parametrize("name", sorted(queries.ORACLES))
def test_query_equals_its_sql(spark, db, name):
    df = queries.QUERIES[name](spark, SF)
    result = db.sql(queries.ORACLES[name])
    assert sorted(df.columns) == sorted(result.columns)
    assert rows(df.columns, df.collect()) == rows(result.columns, result.fetchall())


def test_fuzzed_files_each_give_a_row(spark):
    assert queries.QUERIES["pdf_fuzz"](spark, SF).count() == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_the_rest_works_without_the_training_data_operators(tmp_path):
    root = Path(__file__).resolve().parent.parent
    for part in ("parchmill", "__spark_entry__.py"):
        source = root / part
        shutil.copytree(source, tmp_path / part, ignore=shutil.ignore_patterns("llm", "__pycache__")) if source.is_dir() else shutil.copy(source, tmp_path)
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pdf_pages' in q and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"})


def test_ranks_of_large_groups_and_ties(spark):
    from pyspark.sql import functions as F

    from parchmill.operators import scoring

    rows = spark.range(30_000).select((F.col("id") % 3).alias("word"), F.when(F.col("id") % 3 == 0, F.col("id") % 2).otherwise(F.pmod(F.xxhash64("id"), F.lit(5000))).cast("double").alias("_v"))
    rows = rows.union(spark.createDataFrame([(None, 2.0), (None, 1.0), (7, None)], "word long, _v double"))
    for p in (0.0, 0.37, 0.9, 1.0):
        for accuracy in (100, 10_000):
            got = {r.word: r.at for r in scoring.percentile_rank(rows, ["word"], "_v", p, "at", accuracy).collect()}
            values = {}
            for r in rows.collect():
                if r["_v"] is not None:
                    values.setdefault(r.word, []).append(r["_v"])
            assert got == {k: sorted(v)[int((len(v) - 1) * p)] for k, v in values.items()}


def test_page_trees(spark):
    from parchmill.operators import lookups

    rows = [(d, 0, -1, 0, "Pages", f"top {d}") for d in (1, 2)] + [(1, 1, 0, 0, "Pages", None), (1, 2, 1, 0, "Page", None), (1, 3, 1, 1, "Page", "own"), (2, 1, 0, 3, "Page", None), (1, 1, 1, 9, "Pages", None)]
    nodes = spark.createDataFrame(rows, "node_of long, node int, parent int, place int, kind string, resources string")
    got = sorted(tuple(r) for r in lookups.page_tree(nodes, 0, ["node_of"]).collect())
    assert got == [(1, 2, "0/0/0", "top 1"), (1, 3, "0/0/1", "own"), (2, 1, "0/3", "top 2")]
    assert lookups.page_tree(nodes.limit(0), 0, ["node_of"]).collect() == []


def test_pages_are_ordered_by_numbers(spark):
    from pyspark.sql import functions as F

    from parchmill.operators import lookups

    nodes = spark.createDataFrame([(0, -1, 0, "Pages", "r")] + [(i, 0, i, "Page", None) for i in range(1, 13)], "node int, parent int, place int, kind string, resources string")
    got = lookups.page_tree(nodes, 0).orderBy(F.split("path", "/").cast("array<int>")).collect()
    assert [r.node for r in got] == list(range(1, 13))


@pytest.mark.parametrize("most", [0, 65_536])
def test_widths_of_texts(spark, monkeypatch, most):
    from parchmill.operators import lookups

    monkeypatch.setattr(lookups, "MOST_WIDTHS", most)
    strings = spark.createDataFrame([(1, "a b"), (2, ""), (3, None), (4, "zz"), (None, " ")], "id int, text string")
    widths = spark.createDataFrame([("a", 5.0), ("b", 7.0), (" ", 2.0)], "ch string, w double")
    got = {r.id: tuple(r)[1:] for r in lookups.string_widths(strings, widths, 10.0).collect()}
    assert got == {1: (14.0, 3, 1), 2: (0.0, 0, 0), 3: (0.0, 0, 0), 4: (20.0, 2, 0), None: (2.0, 1, 1)}


def test_wide_ranges_touch_two_bins(spark):
    from parchmill.operators import lookups

    ranges = spark.createDataFrame([(0.0, 1e12, 3, "all"), (5.0, 6.0, 1, "small"), (-1e15, -2.0, 2, "low"), (9.0, 8.0, 0, "none")], "lo double, hi double, list_pos int, payload string")
    codes = spark.createDataFrame([(5.5, "x"), (7.0, "y"), (-3.0, "z"), (-1.0, None), (None, "n"), (5.5, "x")], "code double, payload string")
    got = sorted((r.code or -9, r.payload) for r in lookups.range_lookup(codes, ranges, 0.5).collect())
    assert got == [(-9, None), (-3.0, "low"), (-1.0, None), (5.5, "small"), (5.5, "small"), (7.0, "all")]


def test_texts_that_must_be_normalised_are(spark):
    import unicodedata

    from pyspark.sql import functions as F

    from parchmill.functions import text as T
    from parchmill.operators import scoring

    odd = ["ﬁne ﬁne", "１２ full width", "été", "plain words", "été", None, "漢字 かな", "a²b"]
    df = spark.createDataFrame([(t, t, i) for i, t in enumerate(odd)], "text string, word string, n int")
    got = sorted((r.n0, r.word, r.n) for r in scoring.tokens(df.withColumnRenamed("n", "n0"), ["n0"]).collect())
    assert (0, "fine", 2) in got and (1, "12", 1) in got and (2, "été", 1) in got and (4, "été", 1) in got and (7, "a2b", 1) in got
    kept = "".join(chr(c) for c in range(0x20, 0x10000) if not 0xD800 <= c < 0xE000)
    stable = [r.ch for r in spark.createDataFrame([(ch,) for ch in kept], "ch string").filter(T.is_normal(F.col("ch"))).collect()]
    assert len(stable) > 20_000 and all(unicodedata.normalize("NFKC", ch) == ch and not unicodedata.combining(ch) for ch in stable)
    assert all(unicodedata.normalize("NFKC", "".join(stable[i : i + 50])) == "".join(stable[i : i + 50]) for i in range(0, len(stable), 50))


def equal_over(spark, folder, name, texts):
    """Whether a query equals its SQL over documents of these texts."""
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1).write.parquet(f"{folder}/documents.parquet")
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{folder}/documents.parquet/*.parquet'")
    df, result = queries.QUERIES[name](spark, str(folder)), con.sql(queries.ORACLES[name])
    got = rows(df.columns, df.collect())
    assert got and got == rows(result.columns, result.fetchall())


#: Words beside letters past ASCII, digits and signs, in NFKC form, as the SQL doesn't normalise: what the SQL takes for the edge of a word.
EDGES = ["Émentêde&&& eu", "èmentçde. Éont", "élder der de_ 4the", "dé deß die漢de the the", "Ωde øder_der x"]


@pytest.mark.parametrize("name", ["recall_precision", "word_diff"])
def test_edges_of_words_are_those_of_the_sql(spark, tmp_path, name):
    equal_over(spark, tmp_path, name, EDGES)


#: Words with characters that normalisation would change: accents of their own, ligatures, wide letters, small digits.
UNNORMALISED = ["de\u0301 the\u0301se de der", "the\ufb01 \ufb01ne the", "\uff54\uff48\uff45 the de", "the\u00b2 der\u00bd x the"]


def test_word_diff_takes_texts_as_they_are(spark, tmp_path):
    equal_over(spark, tmp_path, "word_diff", UNNORMALISED)


def drawn_as(said):
    """A text whose second line is drawn as these bytes: its letter k in order is code k of its font."""
    letters = [chr(0x4E00 + k) for k in range(126)]
    return "".join(letters) + "\n" + "".join(letters[ord(c) - 1] for c in said)


#: Texts of which nothing is drawn, and texts that are drawn as what a search of a damaged file looks for.
MISLEADING = ["", "\n\n", *map(drawn_as, ("2 0 obj x", "endobj 5 0 obj", "endstream", "endobj", "trailer << /Root 3 0 R >>", "/Length 55", "BI /W 1 ID x EI"))]


def test_damage_is_told_and_mended_whatever_the_text(spark, tmp_path):
    equal_over(spark, tmp_path, "pdf_damaged", [t for t in MISLEADING for _ in range(6)])
