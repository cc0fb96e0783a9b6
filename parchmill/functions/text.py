"""Text expressions. All are built-in functions, but for those that Spark has no function for, which are pandas UDFs."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Ligatures and spaces, and what they become.
LIGATURES = {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st", "­": "", " ": " ", " ": " ", "​": ""}
#: Single characters that are words by themselves; elsewhere one letter is noise.
CJK = r"\p{IsHan}\p{IsHiragana}\p{IsKatakana}"


def expand_ligatures(text: Column) -> Column:
    for key, value in LIGATURES.items():
        text = F.replace(text, F.lit(key), F.lit(value))
    return text


def clean_text(text: Column, ligatures: bool = True) -> Column:
    """Ligatures out, control characters to spaces, runs of spaces to one, none around line ends, at most one empty line."""
    text = expand_ligatures(text) if ligatures else text
    for pattern, new in (("[\\x00-\\x09\\x0B-\\x1F\\x7F]+", " "), (" {2,}", " "), (" *\n *", "\n"), ("\n{3,}", "\n\n")):
        text = F.regexp_replace(text, pattern, new)
    return F.btrim(text, F.lit(" \n\r\t\x0b\x00"))


def dehyphenate(text: Column) -> Column:
    """Joins what a hyphen at a line's end parts, between ASCII letters and before a small one."""
    return F.regexp_replace(text, "(?<=[A-Za-z])-\n(?=[a-z])", "")


def strip_subset_tag(name: Column) -> Column:
    return F.regexp_replace(name, r"^[A-Z]{6}\+", "")


def has_right_to_left(text: Column) -> Column:
    return text.rlike("[\\x{0590}-\\x{08FF}\\x{FB1D}-\\x{FDFF}\\x{FE70}-\\x{FEFC}]")


def hex_string(body: Column) -> Column:
    """The bytes of a hex string: other characters are passed over, an odd digit is followed by 0."""
    digits = F.regexp_replace(body, "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))


#: Characters that compatibility normalisation leaves alone whatever stands beside them but a combining mark: ASCII, letters of Latin, Cyrillic,
#: kana and Han, and common signs.
NORMAL = r"\x00-\x7F\u00A1-\u00A7\u00A9\u00AB\u00AC\u00AE\u00B0\u00B1\u00B6\u00B7\u00BB\u00BF-\u0131\u0134-\u013E\u0141-\u0148\u014A-\u017E\u0400-\u0482\u048A-\u052F\u2010\u2012-\u2016\u2018-\u2023\u3041-\u3096\u30A1-\u30FA\u4E00-\u9FFF"


def is_normal(text: Column) -> Column:
    """Whether a text surely is its own NFKC form."""
    return text.isNull() | ~text.rlike(f"[^{NORMAL}]")


def words(text: Column, normalised: bool = False) -> Column:
    """Words as the scoring counts them: lower case, letters and digits, CJK characters one by one, no other single characters."""
    lower = F.lower(text if normalised else nfkc_udf()(text))
    found = F.regexp_extract_all(lower, F.lit(rf"([{CJK}]|[\p{{L}}\p{{N}}]+)"), F.lit(1))
    return F.filter(found, lambda w: (F.length(w) >= 2) | w.rlike(f"[{CJK}]"))


def size_label(n: Column) -> Column:
    return F.when(n >= 1 << 20, F.format_string("%.1f MB", n / float(1 << 20))).when(n >= 1024, F.format_string("%.1f KB", n / 1024.0)).otherwise(F.concat(n.cast("string"), F.lit(" bytes")))


def nfkc_udf():
    import unicodedata

    @F.pandas_udf("string")
    def nfkc(text: pd.Series) -> pd.Series:
        return text.map(lambda t: None if t is None else t if t.isascii() else unicodedata.normalize("NFKC", t))

    return nfkc


def bidi_udf():
    @F.pandas_udf("string")
    def logical(line: pd.Series) -> pd.Series:
        from parchmill.kernel.bidi import logical as turn

        return line.map(lambda t: None if t is None else turn(t))

    return logical


def compose_udf():
    @F.pandas_udf("string")
    def composed(text: pd.Series) -> pd.Series:
        import unicodedata

        return text.map(lambda t: None if t is None else unicodedata.normalize("NFC", t))

    return composed


def glyph_udf():
    @F.pandas_udf("string")
    def character(name: pd.Series) -> pd.Series:
        from parchmill.kernel.glyphs import known

        return name.map(lambda n: None if n is None else known(n))

    return character
