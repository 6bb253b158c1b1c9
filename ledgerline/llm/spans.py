"""Where a pattern matches in a text, with DataFrame functions alone.

A span is a struct of ``start`` and ``end`` (code points, end exclusive), the
matched ``value`` and the text ``before`` it since the last match.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space is the ASCII kind in all contracts of these operators.
SPACE = r"\x20\x09-\x0D"
#: Matches that are summed up in one go; a longer list is cut into so many.
BLOCK = 128
SPAN = "array<struct<start:int,end:int,value:string,before:string>>"
MARK = "struct<start:int,order:int,end:int,kind:string>"


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def located(text: Column, pattern: str, likely: Column) -> Column:
    """The leftmost non-overlapping matches of ``pattern``, none where ``likely`` is false or the text null."""
    parts = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("hit"))

    def spans_of(z: Column) -> Column:
        return let(blocks_of(z), lambda bs: F.flatten(F.zip_with(bs, _starts(bs), _block_spans)))

    whole = let(parts, lambda z: let(F.filter(z, lambda x: x["hit"].isNotNull()), lambda h: F.when(F.size(h) > 0, spans_of(h)).otherwise(F.array().cast(SPAN))))
    return F.when(likely, whole).otherwise(F.array().cast(SPAN))


def _width(x: Column) -> Column:
    return F.length(x["gap"]) + F.length(x["hit"])


def _starts(blocks: Column) -> Column:
    """Where each block's text begins."""
    return F.aggregate(
        F.transform(blocks, lambda b: F.aggregate(b, F.lit(0), lambda n, x: n + _width(x))),
        F.array(F.lit(0)),
        lambda found, n: F.concat(found, F.array(F.element_at(found, -1) + n)),
        lambda found: F.slice(found, 1, F.size(found) - 1),
    )


def _block_spans(block: Column, start: Column) -> Column:
    first = F.struct(start.alias("at"), F.array().cast(SPAN).alias("out"))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + F.length(x["gap"])
        span = F.struct(begin.alias("start"), (begin + F.length(x["hit"])).alias("end"), x["hit"].alias("value"), x["gap"].alias("before"))
        return F.struct((acc["at"] + _width(x)).alias("at"), F.concat(acc["out"], F.array(span)).alias("out"))

    return F.aggregate(block, first, step, lambda acc: acc["out"])


def marks(spans: Column, kind: str, order: int) -> Column:
    """Spans as marks of a kind, to be sorted with those of other kinds."""
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(order).alias("order"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def spelled(found: Column) -> Column:
    """``kind:start:end`` of all marks, by start and then kind, joined by commas."""
    return F.array_join(F.transform(F.array_sort(found), lambda m: F.concat_ws(":", m["kind"], m["start"].cast("string"), m["end"].cast("string"))), ",")


def blocks_of(values: Column) -> Column:
    """An array in slices of BLOCK."""
    return F.transform(F.sequence(F.lit(0), F.greatest(F.floor((F.size(values) - 1) / BLOCK).cast("int"), F.lit(0))), lambda b: F.slice(values, b * BLOCK + 1, BLOCK))


def merged(found: Column) -> Column:
    """Marks in order without those that overlap one before them. What grows is a list of places."""

    def kept(marks: Column) -> Column:
        empty = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))

        def step(acc: Column, i: Column) -> Column:
            m = F.get(marks, i)
            return F.when(m["start"] >= acc["at"], F.struct(m["end"].alias("at"), F.array_append(acc["out"], i).alias("out"))).otherwise(acc)

        places = F.aggregate(F.sequence(F.lit(0), F.size(marks) - 1), empty, step, lambda acc: acc["out"])
        return F.when(F.size(marks) > 0, F.transform(places, lambda i: F.get(marks, i))).otherwise(marks)

    return let(F.array_sort(found), kept)


def redacted(text: Column, found: Column) -> Column:
    """``text`` with each mark replaced by its kind in angle brackets."""

    def whole(marks: Column) -> Column:
        end = lambda i: F.coalesce(F.get(marks, i)["end"], F.lit(0))
        parts = F.transform(marks, lambda m, i: F.concat(F.substring(text, end(i - 1) + 1, m["start"] - end(i - 1)), F.lit("<"), F.upper(m["kind"]), F.lit(">")))
        return F.concat(F.array_join(parts, ""), F.substring(text, end(F.size(marks) - 1) + 1, F.length(text)))

    return F.when(F.size(found) > 0, let(merged(found), whole)).otherwise(text)
