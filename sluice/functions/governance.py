"""Governance: tags, row filters, column masks, user functions, and joins that name people only to those allowed."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DataType

from ..errors import ShapeError
from ..sources.store import Store

TAGS = "_tags"


def with_tags(df: DataFrame, tags: Mapping[str, Mapping[str, str]]) -> DataFrame:
    """df with tags in its columns' metadata; other metadata stays."""
    if absent := sorted(set(tags) - set(df.columns)):
        raise ShapeError(f"tagged columns are not there: {absent}")
    tagged = lambda c: {**df.schema[c].metadata, "tags": {**df.schema[c].metadata.get("tags", {}), **tags[c]}}
    return df.select(*[F.col(f"`{c}`").alias(c, metadata=tagged(c)) if c in tags else F.col(f"`{c}`") for c in df.columns])


def record_tags(store: Store, table: str, tags: Mapping[str, str] | None = None, columns: Mapping[str, Mapping[str, str]] | None = None) -> int:
    """Puts a table's and its columns' tags into the tag table; a tag that is there gets the new value."""
    rows = [(table, "", k, v) for k, v in (tags or {}).items()] + [(table, c, k, v) for c, named in (columns or {}).items() for k, v in named.items()]
    keys = ["table_name", "column_name", "tag"]
    frame = store.spark.createDataFrame(rows, "table_name string, column_name string, tag string, value string")
    return store.merge(TAGS, frame, keys, lambda old, new: new if old is None else old.join(new.select(*keys), keys, "left_anti").unionByName(new), "TAGS", buckets=4)


def allowed_rows(df: DataFrame, entitlements: DataFrame, on: Sequence[str], user: str | Column) -> DataFrame:
    """Rows that the user has an entitlement (user and the columns `on`) for."""
    mine = entitlements.filter(F.col("user") == user).select(*on)
    return df.join(mine, list(on), "left_semi")


def masked(column: str, shown: int = 4, fill: str = "#") -> Column:
    """The last characters of a text behind a fill; a text that is no longer than those is hidden whole."""
    c = F.col(column).cast("string")
    return F.when(c.isNull(), None).when(F.length(c) <= shown, F.lit(fill)).otherwise(F.concat(F.lit(fill), F.right(c, F.lit(shown))))


def mask(df: DataFrame, columns: Sequence[str], unmasked: Column | bool = False) -> DataFrame:
    """df with the columns masked unless the condition holds."""
    keep = F.lit(unmasked) if isinstance(unmasked, bool) else unmasked
    return df.withColumns({c: F.when(keep, F.col(c).cast("string")).otherwise(masked(c)) for c in columns})


def privacy_join(left: DataFrame, right: DataFrame, keys: tuple[str, str], consent: str) -> DataFrame:
    """Rows of both sides that agree on two keys, where the right side consents. Null keys agree with nothing."""
    return left.join(right.filter(F.coalesce(F.col(consent).cast("boolean"), F.lit(False))), list(keys))


def register_function(spark: SparkSession, name: str, function: Callable, returns: DataType | str = "string") -> None:
    """A user's function under a name for SQL."""
    spark.udf.register(name, function, returns)
