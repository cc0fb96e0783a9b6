"""Brute-force versions that the operators are held against."""

import re

SF = "/root/testdata/sf0.01"
#: Texts that every operator must take: null, empty, blanks, repeats, ties, many bytes a character, a long one.
ODD = [None, "", " ", "\n\n", "a", "A a A a", "x" * 70_000, "ß" * 300, "wörd ñ 漢字 " * 40, "the same words again and again " * 30, "\x00\x01 \t", "tail "]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def spaced(text):
    return re.findall(r"[^\x20\x09-\x0D]+", lower(text))


def alnum(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))


def frame(spark, texts, ids=None):
    rows = [(i, t, "en", "s", 0, "clash") for i, t in zip(ids or range(len(texts)), texts, strict=True)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, start string")


def real(spark, n=None):
    df = spark.read.parquet(f"{SF}/documents.parquet")
    return df if n is None else df.orderBy("doc_id").limit(n)
