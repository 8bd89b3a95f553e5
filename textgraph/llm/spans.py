"""Matches of regular expressions with their places, in built-in functions.

``split`` gives the text between matches and ``regexp_extract_all`` the matches;
their lengths in code points add up to the places. Both find matches from left to
right without overlap. Patterns are Java's.

The places of one text are added up inside its row: in chunks of ``CHUNK`` matches,
whose sums are added up in turn, since an array that grows by one is copied each
time. Text at a place is cut from pieces of ``PIECE`` characters, since a place is
counted from the start of a text. So time follows the text and its matches. What
is used more than once inside a lambda is bound to a variable by ``bound``.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, functions as F

CHUNK, PIECE = 1024, 1024
PLACE = "array<struct<start:long,end:long,text:string,before:string>>"
SPAN = "array<struct<start:long,rank:int,end:long,kind:string,score:double>>"


def matches(text: Column, pattern: str, where: Column | None = None) -> Column:
    """Array of ``start, end, text``, end exclusive, in code points.

    ``where`` is a cheap condition that every text with a match meets.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    if where is not None:
        found = F.when(where, found)
    return F.coalesce(found, F.array().cast("array<string>"))


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of a value that is computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def chunks(z: Column, use: Callable[[Column], Column]) -> Column:
    """``use`` of the first index of each chunk of an array that is not empty."""
    return F.transform(F.sequence(F.lit(0), F.floor((F.size(z) - 1) / CHUNK).cast("int")), lambda j: use(j * CHUNK))


def places(text: Column, pattern: str, found: Column, near: int = 0) -> Column:
    """The places of matches that ``matches`` has found in the text, each with the ``near`` characters before it."""
    gaps = F.slice(F.split(text, pattern, -1), 1, F.size(found))
    items = F.zip_with(gaps, found, lambda g, m: F.struct(
        F.length(g).cast("long").alias("gap"), _last(g, near).alias("tail"), m.alias("text")))

    def step(acc: Column, x: Column) -> Column:
        begin = acc["at"] + x["gap"]
        end, before = begin + F.length(x["text"]), _last(F.concat(acc["before"], x["tail"]), near)
        place = F.struct(begin.alias("start"), end.alias("end"), x["text"].alias("text"), before.alias("before"))
        return F.struct(
            end.alias("at"), _last(F.concat(before, x["text"]), near).alias("before"), F.array_append(acc["done"], place).alias("done"))

    def chunk(z: Column, first: Column) -> Column:
        # A match has a character at least, so so many matches before hold what is near.
        back = F.greatest(first - near, F.lit(0))
        lead = F.aggregate(F.slice(z, back + 1, first - back), F.lit(""), lambda t, x: _last(F.concat(t, x["tail"], x["text"]), near))
        start = F.struct(F.lit(0).cast("long").alias("at"), lead.alias("before"), F.array().cast(PLACE).alias("done"))
        return F.aggregate(F.slice(z, first + 1, CHUNK), start, step, lambda acc: F.struct(acc["at"].alias("size"), acc["done"].alias("done")))

    def moved(acc: Column, c: Column) -> Column:
        done = F.transform(c["done"], lambda p: F.struct(
            (p["start"] + acc["at"]).alias("start"), (p["end"] + acc["at"]).alias("end"), p["text"].alias("text"), p["before"].alias("before")))
        return F.struct((acc["at"] + c["size"]).alias("at"), F.array_append(acc["done"], done).alias("done"))

    none = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast(f"array<{PLACE}>").alias("done"))
    whole = bound(items, lambda z: F.flatten(F.aggregate(chunks(z, lambda first: chunk(z, first)), none, moved, lambda acc: acc["done"])))
    return F.when(F.size(found) > 0, whole).otherwise(F.array().cast(PLACE))


def _last(text: Column, n: int) -> Column:
    return F.substring(text, -n, n) if n else F.lit("")


def as_spans(found: Column, kind: str, rank: int, score=lambda place: F.lit(1.0)) -> Column:
    return F.transform(found, lambda p: F.struct(
        p["start"].alias("start"), F.lit(rank).alias("rank"), p["end"].alias("end"), F.lit(kind).alias("kind"),
        score(p).cast("double").alias("score"),
    )).cast(SPAN)


def in_order(spans: list[Column]) -> Column:
    """One array of spans, by start and then by rank of the kind."""
    return F.array_sort(F.concat(*spans))


def listed(spans: Column) -> Column:
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(
        spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def of_kinds(spans: Column, kinds: list[str]) -> Column:
    return F.filter(spans, lambda s: s["kind"].isin(kinds))


def count_kind(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")


def covered_before(spans: Column) -> Column:
    """For each span by start the largest end of those before it, 0 for the first; and that of all behind them."""
    def chunk(first: Column) -> Column:
        start = F.array(F.lit(0).cast("long"))
        return F.aggregate(
            F.slice(spans, first + 1, CHUNK), start, lambda acc, s: F.array_append(acc, F.greatest(F.element_at(acc, -1), s["end"])))

    def joined(acc: Column, ends: Column) -> Column:
        so_far = F.element_at(F.element_at(acc, -1), -1)
        return F.array_append(acc, F.transform(F.slice(ends, 2, CHUNK), lambda e: F.greatest(e, so_far)))

    return F.flatten(F.aggregate(chunks(spans, chunk), F.array(F.array(F.lit(0).cast("long"))), joined))


def masked(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; what overlaps becomes one mask."""
    pieces = F.regexp_extract_all(text, F.lit(rf"(?s).{{1,{PIECE}}}"), F.lit(0))

    def cut(v: Column, a: Column, b: Column) -> Column:
        first, last = F.floor(a / PIECE).cast("int"), F.floor((b - 1) / PIECE).cast("int")
        several = F.array_join(F.slice(v["pieces"], first + 1, last - first + 1), "")
        near = F.when(first == last, F.get(v["pieces"], first)).otherwise(several)
        return F.when(b > a, F.substring(near, (a - first * PIECE + 1).cast("int"), (b - a).cast("int"))).otherwise("")

    def done(v: Column) -> Column:
        parts = F.zip_with(v["spans"], F.slice(v["before"], 1, F.size(v["spans"])), lambda s, at: F.when(
            s["start"] >= at, F.concat(cut(v, at, s["start"]), F.lit("["), F.upper(s["kind"]), F.lit("]"))).otherwise(""))
        return F.concat(F.array_join(parts, ""), cut(v, F.element_at(v["before"], -1), F.length(text).cast("long")))

    held = bound(spans, lambda z: F.struct(pieces.alias("pieces"), z.alias("spans"), covered_before(z).alias("before")))
    return F.when(F.size(spans) > 0, bound(held, done)).otherwise(text)


def any_of(conditions: list[Column]) -> Column:
    return reduce(lambda a, b: a | b, conditions)
