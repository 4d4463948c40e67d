"""AES column encryption and decryption."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import ShapeError

MODES = ("GCM", "CBC", "ECB")


@dataclass(frozen=True)
class Crypt:
    column: str
    key: str
    mode: str = "GCM"
    output: str | None = None
    declared: str | None = None  # encrypt: the type the column must have; decrypt: the type to cast to


def encrypt(df: DataFrame, columns: Sequence[Crypt]) -> DataFrame:
    """Values are cast to text and encrypted; another output column leaves the plain one in place."""
    for c in columns:
        if c.mode not in MODES:
            raise ShapeError(f"{c.column}: AES mode {c.mode} is not one of {MODES}")
        found = dict(df.dtypes).get(c.column)
        if found is None or (c.declared and found != c.declared):
            raise ShapeError(f"{c.column} is {found}, not {c.declared or 'there'}")
        df = df.withColumn(c.output or c.column, F.aes_encrypt(F.col(c.column).cast("string"), F.lit(c.key), F.lit(c.mode)))
    return df


def decrypt(df: DataFrame, columns: Sequence[Crypt]) -> DataFrame:
    for c in columns:
        if not c.declared:
            raise ShapeError(f"{c.column}: decryption needs the type to cast to")
        plain = F.aes_decrypt(F.col(c.column), F.lit(c.key), F.lit(c.mode)).cast("string")
        df = df.withColumn(c.output or c.column, plain.cast(c.declared))
    return df
