"""Column functions on text: strip, sections, rows, templates, list literals."""

from __future__ import annotations

from string import Formatter

import pandas as pd
from pyspark.sql import Column, functions as F

from textgraph.functions import fixed

LABELS = "array<string>"


def strip(c: Column) -> Column:
    """Both ends without any white space, also beyond the blank."""
    return F.btrim(c, F.lit(fixed.SPACE))


def section(c: Column, tag: str) -> Column:
    """First text between the tags, each on a line of its own; '' if absent."""
    return F.regexp_extract(c, f"(?s)<{tag}>\n(.*?)\n</{tag}>", 1)


def rows_of_three(body: Column, names: list[str]) -> Column:
    """Rows of a section as an array of structs with ``pos`` and three fields.

    One cell in, one array out: no shuffle, and the order is the text's.
    """
    lines = F.filter(F.split(strip(body), "\n"), lambda line: strip(line) != "")
    fields = F.transform(lines, lambda line: F.transform(F.split(line, r" \| "), strip))
    whole = F.filter(fields, lambda f: F.size(f) >= 3)
    return F.transform(
        whole,
        lambda f, i: F.struct(
            i.cast("long").alias("pos"),
            *[F.get(f, F.lit(k)).alias(n) for k, n in enumerate(names)],
        ),
    )


def has_rows(body: Column) -> Column:
    """Whether a section has a row: two separators in one line."""
    return strip(body).rlike(r" \| [^\n]*? \| ")


def fill(template: str, **fields: Column) -> Column:
    """Put columns into a template in one pass, so inserted text stays as is."""
    parts = []
    for text, name, _, _ in Formatter().parse(template):
        if text:
            parts.append(F.lit(text))
        if name is not None:
            parts.append(F.coalesce(fields[name], F.lit("")))
    return F.concat(*parts)


def json_object(c: Column) -> Column:
    """Text from the first ``{`` to the last ``}``; NULL if there is none."""
    return F.nullif(F.regexp_extract(c, r"(?s)(\{.*\})", 1), F.lit(""))


# A list of quoted texts without escapes, or None: what nearly all cells are.
_WS, _ITEM = r"[ \t\r\n]*+", r"""(?:'[^'\\\r\n\x00]*+'|"[^"\\\r\n\x00]*+"|None)"""
PLAIN_LIST = rf"\A{_WS}\[{_WS}(?:{_ITEM}{_WS}(?:,{_WS}{_ITEM}{_WS})*+(?:,{_WS})?)?\]{_WS}\z"
PLAIN_CHARS = 4000  # longer lists go to Python, since the expression descends per item


def plain_list(c: Column) -> Column:
    """Whether a cell is such a list, of moderate length."""
    return F.coalesce((F.length(c) <= PLAIN_CHARS) & c.rlike(PLAIN_LIST), F.lit(False))


def read_literal(c: Column) -> Column:
    """A list written as a Python literal: ``labels``, NULL where the text is no list.

    Quotes, escapes, trailing commas and None are read as Python writes them,
    which no JSON reader does. Plain lists are read by built-in functions, only
    the others are handed to Python. Other plain values among the labels become
    text.
    """
    def run(cells: pd.Series) -> pd.Series:
        import ast

        import pandas

        def labels(cell):
            try:
                found = ast.literal_eval(cell.strip())
            except (ValueError, SyntaxError, TypeError, MemoryError, RecursionError, AttributeError):
                return None
            return [v if v is None else str(v) for v in found] if isinstance(found, list) else None

        return pandas.Series([None if cell is None else labels(cell) for cell in cells], dtype=object)

    items = F.transform(
        F.regexp_extract_all(c, F.lit(_ITEM), F.lit(0)), lambda x: F.when(x != "None", F.substring(x, F.lit(2), F.length(x) - 2)))
    return F.when(plain_list(c), items).otherwise(F.pandas_udf(run, LABELS)(F.when(~plain_list(c), c)))


def label_literal(c: Column) -> Column:
    """Labels of a list written as text; anything else is the empty list."""
    return F.coalesce(read_literal(c), F.array().cast(LABELS))


def label_cell(c: Column) -> Column:
    """Labels of a spreadsheet cell, separated by ``; ``."""
    return F.when(c.isNull(), F.array().cast(LABELS)).otherwise(F.split(c, "; "))


def general_number(c: Column) -> Column:
    """A number as C's ``%g`` prints it: 6 digits, no trailing zeros."""
    rounded = F.format_string("%.5e", c)
    power = F.regexp_extract(rounded, "e(.*)$", 1).try_cast("int")
    plain = F.regexp_replace(rounded.try_cast("decimal(20,10)").cast("string"), r"\.?0+$", "")
    digits = F.regexp_replace(F.regexp_extract(rounded, "^(.*)e", 1), r"\.?0+$", "")
    marked = F.concat(digits, F.regexp_extract(rounded, "(e.*)$", 1))
    return F.when(power.between(-4, 5), plain).when(power.isNotNull(), marked)
