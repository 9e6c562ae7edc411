"""Places of pattern matches in a text as DataFrame columns.

The matches and the gaps between them come from two passes of the same pattern; running sums of their lengths are the places, in
code points. The sums are taken within short blocks and then over the blocks, as a fold copies what it has gathered at each step.
Patterns must be such that a failing attempt costs no more than its run of characters: possessive quantifiers, and
a start only where a run starts or where the last match ended.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,end:int,value:string,before:string>"
#: Characters before a match that may be its context.
CONTEXT_CHARS = 64
#: Numbers that are summed in one fold.
BLOCK = 64


def bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def sums_before(values: Column) -> Column:
    """For each of an array of integers the sum of those before it, in time proportional to their number."""

    def within(b):
        start = F.struct(F.lit(0).alias("total"), F.array().cast("array<int>").alias("out"))
        return F.aggregate(b, start, lambda a, x: F.struct((a["total"] + x).alias("total"), F.concat(a["out"], F.array(a["total"])).alias("out")))

    def shifted(blocks, starts):
        return F.flatten(F.zip_with(blocks, starts, lambda b, s: F.transform(b["out"], lambda x: x + s)))

    def of_blocks(blocks):
        totals = F.transform(blocks, lambda b: b["total"])
        return bound(within(totals)["out"], lambda starts: shifted(blocks, starts))

    def cut(v):
        n = F.floor((F.size(v) - 1) / BLOCK).cast("int")
        blocks = F.transform(F.sequence(F.lit(0), n), lambda i: within(F.slice(v, i * BLOCK + 1, F.lit(BLOCK))))
        return F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(bound(blocks, of_blocks))

    return bound(values, cut)


def count_below(ascending: Column, x: Column) -> Column:
    """How many of an ascending array of integers are less than ``x``, by halving."""
    n = F.size(ascending)
    rounds = F.sequence(F.lit(0), F.floor(F.log2(F.greatest(n, F.lit(1)).cast("double"))).cast("int"))

    def halve(a, _):
        mid = F.floor((a["low"] + a["high"]) / 2).cast("int")
        less = F.get(ascending, mid) < x
        halved = F.when(less, F.struct((mid + 1).alias("low"), a["high"].alias("high"))).otherwise(F.struct(a["low"].alias("low"), mid.alias("high")))
        return F.when(a["low"] >= a["high"], a).otherwise(halved)

    return F.aggregate(rounds, F.struct(F.lit(0).alias("low"), n.alias("high")), halve, lambda a: a["low"])


def apart(spans: Column, others: Column) -> Column:
    """Those of ``spans`` that overlap none of ``others``; both are arrays of structs with start and end."""

    def by_place(starts, ends):
        # of the others that begin before the end, all must end by the start
        return F.filter(spans, lambda t: count_below(starts, t["end"]) == count_below(ends, t["start"] + 1))

    starts = F.array_sort(F.transform(others, lambda b: b["start"]))
    ends = F.array_sort(F.transform(others, lambda b: b["end"]))
    return F.when(F.size(others) == 0, spans).otherwise(bound(starts, lambda s: bound(ends, lambda e: by_place(s, e))))


def matches(text: Column, pattern: str, ok: Callable[[Column], Column] | None = None, context: bool = False) -> Column:
    """Array of (start, end, value, before) of the leftmost non-overlapping matches for whose value ``ok`` holds.

    ``before``: the last characters between the match before, or the start of the text, and this one, if ``context``; else null.
    """
    p = F.lit(pattern)
    none = F.array().cast(f"array<{SPAN}>")
    both = F.zip_with(
        F.regexp_extract_all(text, p, F.lit(0)), F.split(text, pattern, -1),
        lambda m, g: F.struct(m.alias("m"), F.char_length(g).alias("g"), F.char_length(m).alias("n"), (F.right(g, F.lit(CONTEXT_CHARS)) if context else F.lit(None).cast("string")).alias("before")),
    )

    def placed(x, before):
        first = before + x["g"]
        return F.struct(first.alias("start"), (first + x["n"]).alias("end"), x["m"].alias("value"), x["before"].alias("before"))

    def found(b):
        return F.zip_with(b, sums_before(F.transform(b, lambda x: x["g"] + x["n"])), placed)

    spans = bound(F.filter(both, lambda x: x["m"].isNotNull()), found)  # the last gap has no match after it
    if ok is not None:
        spans = F.filter(spans, lambda s: ok(s["value"]))
    return F.when(text.rlike(pattern), spans).otherwise(none)


def written(spans: Column) -> Column:
    """(kind, start, end) structs as kind:start:end, comma-joined in their order."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
