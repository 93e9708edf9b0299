"""Regular-expression spans with code-point positions, as column expressions only.

``split`` with limit -1 gives the text between the leftmost non-overlapping matches and
``regexp_extract_all`` the matches; running lengths of both give each match's start and end. The time hardly grows
faster than the number of matches, so that texts with hundreds of thousands of them are worked off too.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,value:string>>"


def matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def pieces(text: Column, pattern: str) -> Column:
    return F.split(text, pattern, -1)


def named(x: Column, f: Callable[[Column], Column]) -> Column:
    """f(x), with x worked out once."""
    return F.transform(F.array(x), f)[0]


def scan(items: Column, state: Column, out: str, step: Callable[[Column, Column], tuple[Column, Column, Column]]) -> Column:
    """Array (of type ``out``) of what step emits, item by item, with a state that goes along.

    step(state, item) gives the next state, whether to emit, and what. Arrays cannot be added to without a copy, so items
    are taken in blocks of about the square root of their number: n items take n ** 1.5 copied references, not n ** 2.
    """
    none = F.array().cast(out)

    def block(s: Column, some: Column) -> Column:
        def add(acc, item):
            after, emit, value = step(acc["s"], item)
            return F.struct(after.alias("s"), F.when(emit, F.concat(acc["out"], F.array(value))).otherwise(acc["out"]).alias("out"))

        return F.aggregate(some, F.struct(s.alias("s"), none.alias("out")), add)

    def whole(them: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(them))).cast("int"), F.lit(32))
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(them) - 1) / width).cast("int")), lambda i: F.slice(them, i * width + 1, width))

        def add(acc, some):
            return named(block(acc["s"], some), lambda r: F.struct(r["s"].alias("s"), F.concat(acc["out"], F.array(r["out"])).alias("out")))

        return F.aggregate(blocks, F.struct(state.alias("s"), F.array().cast(f"array<{out}>").alias("out")), add, lambda acc: F.flatten(acc["out"]))

    return F.coalesce(F.when(F.size(items) > 0, named(items, whole)), none)


def located(found: Column, between: Column) -> Column:
    """Array of (start, end, value) from the matches and the pieces between them; empty for no match or null."""

    def step(at, pair):
        start = at + pair["gap"]
        end = start + F.length(pair["value"])
        return end, F.lit(True), F.struct(start.alias("start"), end.alias("end"), pair["value"].alias("value"))

    pairs = F.zip_with(
        F.slice(between, F.lit(1), F.size(found)), found, lambda g, v: F.struct(F.length(g).alias("gap"), v.alias("value"))
    )
    return F.when(F.size(found) > 0, scan(pairs, F.lit(0), SPAN, step)).otherwise(F.array().cast(SPAN))


def rendered(kind: str, spans: Column) -> Column:
    """Array of strings kind:start:end."""
    return F.transform(
        spans, lambda s: F.concat(F.lit(kind + ":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))
    )


TAGGED = "array<struct<start:int,end:int,kind:string>>"


def tagged(kind: str, spans: Column) -> Column:
    return F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), F.lit(kind).alias("kind")))


def replaced(text: Column, spans: Column) -> Column:
    """text with each (start, end, kind) span replaced by [KIND]; of overlapping spans the first stays."""

    def first(at, s):
        fits = s["start"] >= at
        return F.when(fits, s["end"]).otherwise(at), fits, s

    def put(kept: Column) -> Column:
        width = F.greatest(F.ceil(F.sqrt(F.size(kept))).cast("int"), F.lit(32))
        last = F.floor((F.size(kept) - 1) / width).cast("int")

        def block(i: Column) -> Column:
            begin = F.when(i == 0, 0).otherwise(F.get(kept, i * width - 1)["end"])
            end = F.when(i == last, F.length(text)).otherwise(F.get(kept, (i + 1) * width - 1)["end"])
            return named(F.struct(F.slice(kept, i * width + 1, width).alias("spans"), begin.alias("begin"), end.alias("end")), lambda b: named(F.substr(text, b["begin"] + 1, b["end"] - b["begin"]), lambda part: said(b, part)))

        def said(b: Column, part: Column) -> Column:
            def each(s: Column, j: Column) -> Column:
                before = F.when(j == 0, b["begin"]).otherwise(F.get(b["spans"], j - 1)["end"])
                return F.concat(F.substr(part, before - b["begin"] + 1, s["start"] - before), F.lit("["), F.upper(s["kind"]), F.lit("]"))

            rest = F.get(b["spans"], F.size(b["spans"]) - 1)["end"]
            return F.concat(F.transform(b["spans"], each), F.array(F.substr(part, rest - b["begin"] + 1, b["end"] - rest)))

        return F.array_join(F.flatten(F.transform(F.sequence(F.lit(0), last), block)), "")

    return F.when(F.size(spans) == 0, text).otherwise(named(scan(F.array_sort(spans), F.lit(0), TAGGED, first), put))


def outside(spans: Column, others: Column) -> Column:
    """spans (start, end, value), in order, that overlap none of others: scanned from both ends of what both hold."""
    kind = "array<struct<start:int,own:int,end:int,value:string>>"
    both = F.array_sort(
        F.concat(
            F.transform(spans, lambda s: F.struct(s["start"].alias("start"), F.lit(1).alias("own"), s["end"].alias("end"), s["value"].alias("value"))),
            F.transform(others, lambda s: F.struct(s["start"].alias("start"), F.lit(0).alias("own"), s["end"].alias("end"), F.lit(None).cast("string").alias("value"))),
        )
    )
    after = scan(both, F.lit(0), kind, lambda end, x: (F.when(x["own"] == 0, F.greatest(end, x["end"])).otherwise(end), (x["own"] == 0) | (end <= x["start"]), x))
    before = scan(F.reverse(after), F.lit(2**31 - 1), kind, lambda start, x: (F.when(x["own"] == 0, x["start"]).otherwise(start), (x["own"] == 1) & (start >= x["end"]), x))
    clear = F.transform(F.reverse(before), lambda x: F.struct(x["start"].alias("start"), x["end"].alias("end"), x["value"].alias("value")))
    return F.when((F.size(spans) == 0) | (F.size(others) == 0), spans).otherwise(clear)
