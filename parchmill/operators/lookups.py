"""Look-ups with precedence, as joins and windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from parchmill.sources.tables import stored

#: Widths that are sent around (under 100 bytes each); a simple font has 256.
MOST_WIDTHS = 65_536


def range_lookup(codes: DataFrame, ranges: DataFrame, bins: float) -> DataFrame:
    """Each code with the payload of the first range in the list (list_pos) that holds it, null for none.

    ranges: (lo, hi, list_pos, payload). An equi-join, not a nested loop: a range is entered into bins about as wide as itself, of
    `bins` times a power of two, so it touches two at most however wide it is; a code looks into one bin of each width that
    occurs. The first match is a grouped minimum. A column payload of codes is replaced.
    """
    level = F.greatest(F.lit(0), F.ceil(F.log2(F.greatest(F.col("hi") - F.col("lo"), F.lit(bins)) / F.lit(bins)))).cast("int")
    entered = ranges.filter("lo <= hi").select("lo", "hi", "list_pos", "payload", level.alias("_level"))
    levels = [r[0] for r in entered.select("_level").distinct().collect()]  # powers of two: about 2,000 at most, and a few in practice
    place = lambda c: F.floor(F.col(c) / (F.lit(bins) * F.pow(F.lit(2.0), F.col("_level"))))
    entered = entered.withColumn("_bin", F.explode(F.array_distinct(F.array(place("lo"), place("hi")))))
    asked = codes.select("code").distinct().withColumn("_level", F.explode(F.array(*map(F.lit, levels)).cast("array<int>"))).withColumn("_bin", place("code"))
    near = asked.join(entered, ["_level", "_bin"]).filter("code between lo and hi")
    first = near.groupBy("code").agg(F.min_by("payload", "list_pos").alias("payload"))
    return codes.drop("payload").join(first, "code", "left")


def newest_wins(rows: DataFrame, keys: list[str], newest: str) -> DataFrame:
    """One row of each key, that of the greatest `newest`: the others are older definitions."""
    names = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*names), newest).alias("_r")).select(*keys, "_r.*")


def reverse_map(cmap: DataFrame) -> DataFrame:
    """(font, glyph, code): for each glyph the best code point, ordinary before private, then the lowest."""
    private = F.col("code").between(0xE000, 0xF8FF)
    return cmap.groupBy("font", "glyph").agg(F.min(F.struct(private.alias("private"), F.col("code"))).alias("_c")).select("font", "glyph", F.col("_c.code").alias("code"))


def distinct_warnings(rows: DataFrame, keys: list[str], most: int = 100) -> DataFrame:
    """The first `most` different warnings of each key in order, and one line more where there are more."""
    first = rows.groupBy(*keys, "warning").agg(F.min("seq").alias("seq"))
    ranked = first.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("seq", "warning")))
    return ranked.filter(F.col("place") <= most + 1).select(*keys, "place", F.when(F.col("place") > most, F.lit("Further warnings of this file are not kept")).otherwise(F.col("warning")).alias("warning"))


def string_widths(strings: DataFrame, widths: DataFrame, default: float) -> DataFrame:
    """(id, width, glyphs, spaces) of (id, text): character widths added up; widths: (ch, w), a font's table, joined if it is a large one. Null and
    empty texts have width 0."""
    letters = strings.select("id", F.explode_outer(F.filter(F.split("text", ""), lambda c: c != "")).alias("ch")).groupBy("id", "ch").agg(F.count("ch").alias("n"))
    few = widths.limit(MOST_WIDTHS + 1).count() <= MOST_WIDTHS
    found = letters.join(F.broadcast(widths) if few else widths, "ch", "left")
    return found.groupBy("id").agg(F.sum(F.col("n") * F.coalesce("w", F.lit(default))).alias("width"), F.sum("n").alias("glyphs"), F.sum(F.when(F.col("ch") == " ", F.col("n")).otherwise(0)).alias("spaces"))


def page_tree(nodes: DataFrame, root: int, keys: list[str] | None = None, deepest: int = 100) -> DataFrame:
    """(keys, node, path, resources) of the leaves of the tree of each key; a circle isn't walked. Pages are in the order of path, compared
    number by number: split(path, '/') as an array of ints, not the string, in which 10 stands before 2.

    nodes: (keys, node, parent, place, kind, resources). A leaf without resources has those of the nearest node above. One join a level,
    each written before the next, so trees of any number and breadth are walked.
    """
    keys = keys or []
    below = nodes.select(*keys, F.col("node").alias("_node"), F.col("parent").alias("node"), F.col("place").alias("_place"), F.col("kind").alias("_kind"), F.col("resources").alias("_own"))
    at = stored(nodes.filter(F.col("node") == root).select(*keys, "node", "kind", F.array(F.lit(0)).alias("_path"), F.array("node").alias("_seen"), "resources"))
    levels = [at]
    for _ in range(deepest - 1):
        down = at.filter("kind <> 'Page'").drop("kind").join(below, [*keys, "node"]).filter(~F.array_contains("_seen", F.col("_node")))
        at = stored(down.select(*keys, F.col("_node").alias("node"), F.col("_kind").alias("kind"), F.concat("_path", F.array("_place")).alias("_path"), F.concat("_seen", F.array("_node")).alias("_seen"), F.coalesce("_own", "resources").alias("resources")))
        if at.isEmpty():
            break
        levels.append(at)
    return reduce(DataFrame.union, levels).filter("kind = 'Page'").select(*keys, "node", F.array_join("_path", "/").alias("path"), "resources")
