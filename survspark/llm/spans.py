"""Match positions from Spark's own regular-expression functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string>"


def match_spans(text: Column, pattern: str) -> Column:
    """array<struct<start, end, value>> of the leftmost non-overlapping matches, in code points.

    The text between matches (``split``) and the matches (``regexp_extract_all``) alternate, so the
    running length of both gives each place.  The second pass is made only where something matched.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast(f"array<{SPAN}>")
    start = F.struct(F.lit(0).alias("at"), none.alias("out"))

    def step(acc: Column, x: Column) -> Column:
        a = acc["at"] + F.length(x["gap"])
        b = a + F.length(x["hit"])
        return F.struct(b.alias("at"), F.concat(acc["out"], F.array(F.struct(
            a.alias("start"), b.alias("end"), x["hit"].alias("value")))).alias("out"))

    def locate(hits: Column) -> Column:
        gaps = F.slice(F.split(text, pattern, -1), 1, F.size(hits))
        pairs = F.zip_with(gaps, hits, lambda g, h: F.struct(g.alias("gap"), h.alias("hit")))
        return F.aggregate(pairs, start, step, lambda acc: acc["out"])

    # the match list is named once: transform over a one-element array binds it
    return F.flatten(F.transform(F.filter(F.array(found), lambda h: F.size(h) > 0), locate))
