"""Positions of pattern matches, in code points, with SQL functions only.

Every step is linear in a text and its matches, or nearly: running sums are formed in
chunks, so that no growing array is copied for each element, and pieces of a text are cut
from blocks, so that none is counted off from the start of the text.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "struct<start:int,ord:int,kind:string,end:int,value:string>"
EMPTY = f"CAST(array() AS array<{SPAN}>)"
CHUNK = 128
BLOCK = 4096
FAR = 2**31 - 1


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def running(values: Column, combine: Callable[[Column, Column], Column], zero: int) -> Column:
    """For each element of an int array, all up to it combined. ``combine`` is associative, ``zero`` neutral."""
    none = F.expr("CAST(array() AS array<int>)")

    def walk(own: Column, start: Column, inclusive: bool) -> Column:
        def step(acc: Column, x: Column) -> Column:
            now = combine(acc["now"], x)
            return F.struct(now.alias("now"), F.array_append(acc["out"], now if inclusive else acc["now"]).alias("out"))

        return F.aggregate(own, F.struct(start.alias("now"), none.alias("out")), step, lambda acc: acc["out"])

    def chunked(v: Column) -> Column:
        last = F.floor((F.size(v) - 1) / CHUNK).cast("int")
        chunks = F.transform(F.sequence(F.lit(0), last), lambda i: F.slice(v, i * CHUNK + 1, F.lit(CHUNK)))
        return let(chunks, joined_up)

    def joined_up(chunks: Column) -> Column:
        totals = F.transform(chunks, lambda c: F.aggregate(c, F.lit(zero), combine))
        return F.flatten(F.zip_with(chunks, walk(totals, F.lit(zero), False), lambda c, start: walk(c, start, True)))

    return let(values, lambda v: F.when(F.size(v) > 0, chunked(v)).otherwise(none))


def find(text: Column, pattern: Column | str, kind: str | Column, order: int, keep=None) -> Column:
    """All leftmost non-overlapping matches of ``pattern``, as an array of SPAN.

    ``split`` gives the text between matches and ``regexp_extract_all`` the
    matches, so a running sum of lengths gives every end. ``keep`` drops
    matches (a function of the matched string) after positions are known.
    """
    rx = F.lit(pattern) if isinstance(pattern, str) else pattern
    label = F.lit(kind) if isinstance(kind, str) else kind

    def placed(values: Column) -> Column:
        gaps = F.slice(F.split(text, rx, -1), F.lit(1), F.size(values))
        ends = running(F.zip_with(gaps, values, lambda gap, value: F.length(gap) + F.length(value)), lambda a, x: a + x, 0)

        def span(value: Column, end: Column) -> Column:
            start = end - F.length(value)
            return F.struct(start.alias("start"), F.lit(order).alias("ord"), label.alias("kind"), end.alias("end"), value.alias("value"))

        return F.zip_with(values, ends, span)

    spans = let(F.regexp_extract_all(text, rx, F.lit(0)), placed)
    if keep is not None:
        spans = F.filter(spans, lambda s: keep(s["value"]))
    return F.when(F.regexp_like(text, rx), spans).otherwise(F.expr(EMPTY))


def later(a: Column, b: Column) -> Column:
    return F.greatest(a, b)


def sooner(a: Column, b: Column) -> Column:
    return F.least(a, b)


def counts_below(starts: Column, places: Column) -> Column:
    """For each of ``places``, how many of ``starts`` are smaller; both int arrays. One sort of both."""
    own = F.transform(starts, lambda p: F.struct(p.alias("p"), F.lit(1).alias("one"), F.lit(-1).alias("i")))
    asked = F.transform(places, lambda p, i: F.struct(p.alias("p"), F.lit(0).alias("one"), i.alias("i")))

    def ranked(both: Column) -> Column:
        upto = running(F.transform(both, lambda x: x["one"]), lambda a, x: a + x, 0)
        found = F.filter(F.zip_with(both, upto, lambda x, n: F.struct(x["i"].alias("i"), n.alias("n"))), lambda x: x["i"] >= 0)
        return F.transform(F.array_sort(found), lambda x: x["n"])

    return let(F.array_sort(F.concat(own, asked)), ranked)


def outside(spans: Column, base: int) -> Column:
    """``spans`` by start, without those of order ``base`` and over that overlap one of a lower order."""

    def kept(own: Column) -> Column:
        ends = running(F.transform(own, lambda s: F.when(s["ord"] < base, s["end"]).otherwise(0)), later, 0)
        starts = F.reverse(running(F.reverse(F.transform(own, lambda s: F.when(s["ord"] < base, s["start"]).otherwise(FAR))), sooner, FAR))
        bounds = F.zip_with(own, F.zip_with(ends, starts, lambda a, b: F.struct(a.alias("a"), b.alias("b"))), lambda s, x: F.struct(s.alias("s"), x["a"].alias("a"), x["b"].alias("b")))
        good = F.filter(bounds, lambda x: (x["s"]["ord"] < base) | (x["a"] <= x["s"]["start"]) & (x["b"] >= x["s"]["end"]))
        return F.transform(good, lambda x: x["s"])

    return let(F.array_sort(spans), kept)


def replaced(text: Column, spans: Column, label: Callable[[Column], Column]) -> Column:
    """``text`` with each span replaced by its label; of overlapping spans the first by start gives the label of all."""

    def with_blocks(blocks: Column) -> Column:
        def piece(a: Column, b: Column) -> Column:
            first = F.floor(a / BLOCK).cast("int")
            near = F.array_join(F.slice(blocks, first + 1, F.floor(b / BLOCK).cast("int") - first + 1), "")
            return F.substring(near, (a % BLOCK + 1).cast("int"), (b - a).cast("int"))

        def cut(own: Column) -> Column:
            def around(ends: Column) -> Column:
                def one(s: Column, i: Column) -> Column:
                    before = F.when(i > 0, F.element_at(ends, F.greatest(i, F.lit(1)))).otherwise(0)
                    return F.when(s["start"] >= before, F.concat(piece(before, s["start"]), label(s))).otherwise(F.lit(""))

                return F.concat(F.array_join(F.transform(own, one), ""), piece(F.element_at(ends, -1), F.length(text)))

            return let(running(F.transform(own, lambda s: s["end"]), later, 0), around)

        return let(F.array_sort(spans), cut)

    last = F.floor(F.length(text) / BLOCK).cast("int")
    blocks = F.transform(F.sequence(F.lit(0), last), lambda i: F.substring(text, i * BLOCK + 1, F.lit(BLOCK)))
    return F.when(F.size(spans) > 0, let(blocks, with_blocks)).otherwise(text)


def joined(spans: Column) -> Column:
    """``kind:start:end`` by start, then kind order, comma-joined."""
    return F.array_join(
        F.transform(
            F.array_sort(spans),
            lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")),
        ),
        ",",
    )


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
