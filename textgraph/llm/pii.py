"""Personal data: expressions propose spans, checksums confirm, context scores.

Kinds and their checks: e-mail addresses, IPv4 addresses (parts up to 255),
payment cards (14 to 19 digits, Luhn), phone numbers (10 to 15 digits), and
added by the method IBANs (mod-97) and US social security numbers, the latter
only beside a context word. A span's score starts at its kind's confidence and
rises with a context word among the ``NEAR`` characters before it; spans of the
method under ``THRESHOLD`` are dropped, base spans stay.

Everything is built-in functions, one pass, no shuffle. The patterns match what
the plain ones match, but are written with possessive quantifiers and
look-behinds, so long runs of digits or letters cost no more than their length.

Defined results: a null text counts as empty and stays null when masked; places
are code points, end exclusive; rows are judged one by one, so repeated ids and
rows and extra columns make no difference.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from textgraph.llm import spans as S

NEAR = 40
RAISED = 0.3
THRESHOLD = 0.7


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a text of digits passes the Luhn sum."""
    back = F.reverse(digits)
    total = F.aggregate(F.sequence(F.lit(1), F.length(digits)), F.lit(0), lambda acc, i: acc + _luhn_part(back, i))
    return (F.length(digits) > 0) & (F.when(F.length(digits) > 0, total) % 10 == 0)


def _luhn_part(back: Column, i: Column) -> Column:
    d = F.ascii(F.substring(back, i, 1)) - 48
    twice = F.when(d > 4, d * 2 - 9).otherwise(d * 2)
    return F.when(i % 2 == 0, twice).otherwise(d).cast("int")


def mod97(iban: Column) -> Column:
    """Whether an IBAN without spaces leaves 1: the first four characters last, letters as 10 to 35."""
    turned = F.concat(F.substring(iban, 5, 100), F.substring(iban, 1, 4))

    def step(acc: Column, i: Column) -> Column:
        c = F.ascii(F.substring(turned, i, 1))
        return F.when(c >= 65, (acc * 100 + c - 55) % 97).otherwise((acc * 10 + c - 48) % 97).cast("int")

    return F.aggregate(F.sequence(F.lit(1), F.length(turned)), F.lit(0), step) == 1


def _count_within(text: Column, low: int, high: int) -> Column:
    return F.length(_digits(text)).between(low, high)


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    check: Callable[[Column], Column] | None
    confidence: float
    context: str  # words that raise the score, as an expression
    needs: str = ""  # text that every match holds
    base: bool = True


_PART = "0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
# The kinds and their forms.
KINDS = [
    Kind("email", r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
         None, 0.9, "mail|contact|write|kontakt|correo|courriel", "@"),
    Kind("ip", r"(?:(?<![0-9])|\G)[0-9]++(?:\.[0-9]++)(?:\.[0-9]++)(?:\.[0-9]++)",
         lambda m: m.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.7, "ip|host|server|address|adresse", "."),
    Kind("card", r"(?<![0-9])(?<![0-9][\x20-])[0-9](?:[\x20-]?[0-9]){13,18}+(?![\x20-]?[0-9])",
         lambda m: luhn(_digits(m)), 0.8, "card|visa|credit|karte|carte|tarjeta"),
    Kind("phone", r"\+[0-9][\x20().0-9-]+[0-9]",
         lambda m: _count_within(m, 10, 15), 0.8, "phone|call|tel|mobile|fax", "+"),
    Kind("iban", r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]){11,30}+(?![A-Za-z0-9])",
         lambda m: mod97(F.replace(m, F.lit(" "), F.lit(""))), 0.9, "iban|account|bank|konto|compte|cuenta", base=False),
    Kind("ssn", r"(?<![0-9-])(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)[0-9]{4}(?![0-9-])",
         None, 0.4, "ssn|social|security", "-", base=False),
]


def find_pii(documents: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """The input's columns and ``spans``, by start and kind; an input column of that name is replaced."""
    rows = documents.drop("spans", *(f"_m{n}" for n in range(len(kinds))))
    text = F.coalesce(F.col("text"), F.lit(""))
    found = []
    for n, kind in enumerate(kinds):
        rows = rows.withColumn(f"_m{n}", S.matches(text, kind.pattern, F.contains(text, F.lit(kind.needs)) if kind.needs else None))
    for n, kind in enumerate(kinds):
        found.append(_confirmed(S.places(text, kind.pattern, F.col(f"_m{n}"), NEAR), kind, n))
    return rows.withColumn("spans", S.in_order(found)).drop(*(f"_m{n}" for n in range(len(kinds))))


def _confirmed(places: Column, kind: Kind, rank: int) -> Column:
    if kind.check is not None:
        places = F.filter(places, lambda p: kind.check(p["text"]))
    spans = S.as_spans(places, kind.name, rank, lambda p: _score(p, kind))
    return spans if kind.base else F.filter(spans, lambda s: s["score"] >= THRESHOLD)


def _score(place: Column, kind: Kind) -> Column:
    raised = F.lower(place["before"]).rlike(rf"(?:^|[^a-z])(?:{kind.context})")
    return F.least(F.lit(1.0), F.lit(kind.confidence) + F.when(raised, RAISED).otherwise(0.0))


def masked(documents: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    """The input's columns with every span of a text replaced by its kind."""
    found = find_pii(documents.select("text", F.struct("*").alias("row")), kinds)
    text = S.masked(F.col("text"), F.col("spans"))
    return found.select(*(text.alias("text") if c == "text" else F.col("row")[c].alias(c) for c in documents.columns))


def summary(found: DataFrame, kinds: list[Kind] = KINDS) -> DataFrame:
    base = [k.name for k in kinds if k.base]
    return found.select(
        "doc_id", *(S.count_kind(F.col("spans"), k).alias(f"n_{k}") for k in base),
        F.sha2(S.listed(S.of_kinds(F.col("spans"), base)), 256).alias("base_sha256"), S.listed(F.col("spans")).alias("spans"),
        F.array_max(F.transform("spans", lambda s: s["score"])).alias("top_score"),
    )
