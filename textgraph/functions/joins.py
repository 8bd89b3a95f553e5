"""Joins against lookup tables, with the size of what is broadcast checked.

A lookup table (taxonomy, vocabulary, candidates of texts) is broadcast only
after it has been measured. Beyond the bound it is one shuffle join, in which the
left side stands once: frequent keys are split by Spark's own skew join, and rows
without a key, which match nothing, are spread by a salt.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, functions as F

BROADCAST_BYTES = 32 * 1024 * 1024
SALTS = 1024


def row_join(left: DataFrame, right: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Rows of two tables that both grow with the texts: a merge join, never a broadcast.

    Left to itself Spark broadcasts by the size of files, and a stage table whose texts
    repeat is a hundred times that in memory.
    """
    return left.join(right.hint("merge"), on, how)


def table_bytes(df: DataFrame) -> int:
    """Size of a table as JSON text, summed on the executors."""
    if not df.columns:
        return 0
    row = df.agg(F.sum(F.octet_length(F.to_json(F.struct(*df.columns)))).alias("b")).first()
    return int(row["b"] or 0)


def lookup_join(
    left: DataFrame,
    lookup: DataFrame,
    on: list[str],
    how: str = "left",
    limit: int = BROADCAST_BYTES,
    size: int | None = None,
) -> DataFrame:
    """Join rows with a lookup table; inner, left, left_semi or left_anti.

    ``size`` is the size of the lookup table where it was measured before.
    """
    if (table_bytes(lookup) if size is None else size) <= limit:
        return left.join(F.broadcast(lookup), on, how)
    whole = reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in on])
    if how in ("inner", "left_semi"):
        return row_join(left.filter(whole), lookup, on, how)
    # The salt is a hash of the row and not a random number, so a lost task that
    # runs again puts its rows where it put them before.
    plain = [
        f.name for f in left.schema.fields
        if "map<" not in f.dataType.simpleString() and "variant" not in f.dataType.simpleString()
    ]
    salted = left.withColumn("_salt", F.when(whole, 0).otherwise(F.pmod(F.xxhash64(*plain), F.lit(SALTS))).cast("int"))
    return row_join(salted, lookup.withColumn("_salt", F.lit(0)), [*on, "_salt"], how).drop("_salt")
