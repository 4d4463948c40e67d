"""Control tables: upserts that keep when a row was made, pruning, layered session settings."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DEFAULTS = {"spark.sql.adaptive.enabled": "true"}


def upsert(table: DataFrame, rows: DataFrame, keys: Sequence[str], now) -> DataFrame:
    """Rows replace or join the table's; created_at stays that of the first time, updated_at is now."""
    values = [c for c in rows.columns if c not in (*keys, "created_at", "updated_at")]
    old = table.select(*keys, F.struct(*table.columns).alias("o"))
    new = rows.select(*keys, F.struct(*values).alias("n"))
    both = old.join(new, list(keys), "full_outer")
    pick = [F.when(F.col("n").isNotNull(), F.col(f"n.{c}")).otherwise(F.col(f"o.{c}")).alias(c) for c in values]
    return both.select(
        *keys, *pick, F.coalesce("o.created_at", now).alias("created_at"), F.when(F.col("n").isNotNull(), now).otherwise(F.col("o.updated_at")).alias("updated_at")
    )


def prune(table: DataFrame, group: str, present: Sequence[str]) -> DataFrame:
    """Flows of the group that the spec no longer names become inactive; nothing is deleted."""
    absent = (F.col("group_id") == group) & ~F.col("flow_id").isin(*present)
    return table.withColumn("is_active", F.when(absent, False).otherwise(F.col("is_active")))


def active(table: DataFrame, group: str) -> DataFrame:
    return table.filter((F.col("group_id") == group) & F.col("is_active"))


def apply_settings(spark: SparkSession, *layers: Mapping[str, object] | None) -> list[str]:
    """Sets the layers' settings on the session; returns what could not be set, one text each."""
    problems = [f"a layer of settings is no mapping: {layer!r}" for layer in layers if layer is not None and not isinstance(layer, Mapping)]
    for key, value in settings(*layers).items():
        try:
            spark.conf.set(key, value)
        except Exception as e:  # noqa: BLE001  Spark tells static and unknown settings apart only here
            problems.append(f"{key} was not set: {str(e).strip().splitlines()[0]}")
    return problems


def settings(*layers: Mapping[str, object] | None) -> dict[str, str]:
    """Later layers win over earlier ones and the defaults; a layer that is no mapping is left out."""
    out = dict(DEFAULTS)
    for layer in layers:
        if isinstance(layer, Mapping):
            out |= {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in layer.items()}
    return out
