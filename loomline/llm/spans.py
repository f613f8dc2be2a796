"""Spans of regular-expression matches with DataFrame functions only.

Matches come from regexp_extract_all and the text between them from split with the same pattern, so
offsets are running sums of lengths: code points, end exclusive, leftmost, non-overlapping.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string,before:string,after:string>>"


def pieces(text: Column, pattern: str, may: Column, group: int = 0) -> Column:
    """struct(found, part, gaps): all matches, their `group`, and the stretches around them; null unless `may` holds.

    `may` is a cheap necessary condition, so that texts without a match are scanned once and not split.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else F.lit(None).cast("array<string>")
    return F.when(may, F.struct(found.alias("found"), part.alias("part"), F.split(text, pattern, -1).alias("gaps")))


def block_size(n: Column) -> Column:
    """The root of a number of elements, 1 at least: work by blocks of so many is n * sqrt(n) for n elements, where a fold that appends to an array is n * n."""
    return F.greatest(F.lit(1), F.ceil(F.sqrt(n)).cast("int"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once: what stands inside a lambda is computed anew for each element."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _running(values: Column, step: Callable[[Column, Column], Column]) -> Column:
    """What all values before each element come to, from 0: a fold over blocks, then one inside each element's block."""
    fold = lambda part, first: F.aggregate(part, first, step)
    block = lambda i, size: F.floor(i / size).cast("int")

    def made(v: Column, size: Column) -> Column:
        bases = F.aggregate(F.sequence(F.lit(0), block(F.size(v) - 1, size)), F.array(F.lit(0)), lambda acc, b: F.array_append(acc, fold(F.slice(v, b * size + 1, size), F.element_at(acc, -1))))
        return let(bases, lambda known: F.transform(v, lambda _, i: fold(F.slice(v, block(i, size) * size + 1, i % size), F.get(known, block(i, size)))))

    return let(values, lambda v: F.when(F.size(v) > 0, let(block_size(F.size(v)), lambda size: made(v, size))).otherwise(F.slice(v, 1, 0)))


def running_sums(values: Column) -> Column:
    """array<int>: the sum of all elements before each one."""
    return _running(values, lambda acc, x: acc + x)


def running_maxima(values: Column) -> Column:
    """array<int>: the largest of all elements before each one, 0 at least."""
    return _running(values, lambda acc, x: F.greatest(acc, x))


def touched(sorted_spans: Column, start: Column, end: Column) -> Column:
    """Does [start, end) overlap one of a kind's spans? They are in order and apart, so only the last one that begins before `end` can."""
    size = block_size(F.size(sorted_spans))
    heads = F.transform(F.sequence(F.lit(0), F.floor((F.size(sorted_spans) - 1) / size).cast("int")), lambda b: F.get(sorted_spans, b * size)["start"])
    block = F.size(F.filter(heads, lambda h: h < end)) - 1
    last = F.element_at(F.filter(F.slice(sorted_spans, block * size + 1, size), lambda s: s["start"] < end), -1)
    return F.when((F.size(sorted_spans) > 0) & (block >= 0), last["end"] > start).otherwise(False)


def located(p: Column, context: int = 32, marks: tuple[str, str] = ("", "")) -> Column:
    """Array of (start, end, value, before, after) of a pieces() column; value is the group, if one was asked for. marks: characters that stand for others in it, and those others."""
    plain = lambda c: F.translate(c, *marks) if marks[0] else c
    lengths = F.transform(p["found"], lambda m, i: F.length(F.get(p["gaps"], i)) + F.length(m))
    spans = F.transform(
        F.arrays_zip(running_sums(lengths).alias("at"), p["found"].alias("found")),
        lambda x, i: F.struct(
            (x["at"] + F.length(F.get(p["gaps"], i))).alias("start"),
            (x["at"] + F.length(F.get(p["gaps"], i)) + F.length(x["found"])).alias("end"),
            plain(F.coalesce(F.get(p["part"], i), x["found"])).alias("value"),
            plain(F.right(F.get(p["gaps"], i), F.lit(context))).alias("before"),
            plain(F.left(F.get(p["gaps"], i + 1), F.lit(context))).alias("after"),
        ),
    )
    return F.coalesce(F.when(F.size(p["found"]) > 0, spans), F.array().cast(SPAN))


def joined(spans: Column) -> Column:
    """'kind:start:end,...' of an array of structs with kind, start and end."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
