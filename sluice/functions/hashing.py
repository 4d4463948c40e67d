"""Canonical row hashes and order-independent fingerprints of tables."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import ShapeError

KEY, VALUE = "_eng_hash_key", "_eng_hash_value"
#: Text of a missing value and the separator (fixed by the hash standard).
NULL_TEXT, SEPARATOR = "__NULL__", "||"
#: A digest of 32 bytes is folded as so many 64-bit integers.
SLICES = 4


def normalised(column: Column) -> Column:
    return F.coalesce(F.trim(F.lower(column.cast("string"))), F.lit(NULL_TEXT))


def row_hash(columns: Sequence[str]) -> Column:
    """SHA-256 of the columns in the order given."""
    if not columns:
        raise ShapeError("a row hash needs at least one column")
    return F.sha2(F.concat_ws(SEPARATOR, *[normalised(F.col(c)) for c in columns]), 256)


def with_hashes(df: DataFrame, keys: Sequence[str], compared: Sequence[str]) -> DataFrame:
    """Key hash in declared order; value hash over sorted columns, null where nothing is compared."""
    value = row_hash(sorted(compared)) if compared else F.lit(None).cast("string")
    return df.withColumns({KEY: row_hash(keys), VALUE: value})


def folded(digest: Column) -> list[Column]:
    """XOR over all rows of each 8-byte slice of a hex digest; 0 where there is no digest."""
    text = lambda i: F.substring(digest, 16 * i + 1, 16)
    # conv reads 64 bits without a sign; the bits are those of the signed integer.
    number = lambda i: F.conv(text(i), 16, -10).cast("bigint")
    return [F.coalesce(F.bit_xor(number(i)), F.lit(0).cast("bigint")) for i in range(SLICES)]


def unfolded(values: Sequence[Column]) -> Column:
    """The hex digits of slices."""
    return F.concat(*[F.lower(F.lpad(F.hex(v), 16, "0")) for v in values])


@dataclass(frozen=True)
class Fingerprint:
    rows: int
    keys: str
    values: str


def fingerprint_frame(df: DataFrame) -> DataFrame:
    """One row: row count and the XOR of all key and value hashes. A map-side sum, so only one row per task moves."""
    made = df.agg(F.count(F.lit(1)).alias("rows"), F.struct(*folded(F.col(KEY))).alias("k"), F.struct(*folded(F.col(VALUE))).alias("v"))
    slices = lambda n: [F.col(f"{n}.col{i + 1}") for i in range(SLICES)]
    return made.select("rows", unfolded(slices("k")).alias("keys"), unfolded(slices("v")).alias("values"))


def fingerprint(df: DataFrame) -> Fingerprint:
    return Fingerprint(**fingerprint_frame(df).first().asDict())


def compared_columns(columns: Sequence[str], keys: Sequence[str], check: Sequence[str] | None = None, exclude: Sequence[str] = ()) -> list[str]:
    """(checked or all) minus excluded, keys and reserved columns; sorted, distinct."""
    out = set(check or columns) - set(exclude) - set(keys)
    return sorted(c for c in out if not c.startswith("_eng_"))
