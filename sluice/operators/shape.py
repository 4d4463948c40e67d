"""Column shaping, in the order flows apply it: rename and cast, names, lineage, JSON, explode, dedup, SQL."""

from __future__ import annotations

import json
import re
import warnings
from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, StringType, StructType

from ..errors import ShapeError

RESERVED = "_eng_"


def apply_schema(df: DataFrame, columns: Sequence[Mapping[str, str]]) -> DataFrame:
    """Casts, renames and comments the listed columns (name, rename, data_type, comment); others follow."""
    listed, missing = [c["name"] for c in columns], [c["name"] for c in columns if c["name"] not in df.columns]
    if missing:
        raise ShapeError(f"columns not found: {', '.join(missing)}")
    out = []
    for c in columns:
        col = F.col(f"`{c['name']}`")
        col = col.cast(c["data_type"]) if c.get("data_type") else col
        out.append(col.alias(c.get("rename") or c["name"], metadata={"comment": c["comment"]}) if c.get("comment") else col.alias(c.get("rename") or c["name"]))
    return df.select(*out, *[F.col(f"`{c}`") for c in df.columns if c not in listed])


def normal_name(name: str, case: str = "lower") -> str:
    """Trimmed, in the case asked for, with one underscore for each run of other characters (fixed by the naming rule)."""
    text = name.strip()
    text = {"lower": text.lower(), "upper": text.upper(), "preserve": text}[case]
    return re.sub(r"_+", "_", re.sub(r"[^A-Za-z0-9_]", "_", text)).strip("_") or "_"


def normalise_names(df: DataFrame, case: str = "lower") -> DataFrame:
    names = [c if c.startswith(RESERVED) else normal_name(c, case) for c in df.columns]
    twice = sorted({n for n in names if [x.lower() for x in names].count(n.lower()) > 1})
    if twice:
        raise ShapeError(f"column names collide: {', '.join(twice)}")
    return df.toDF(*names)


def with_lineage(df: DataFrame) -> DataFrame:
    """Source file name, size and time where the source has them, else typed nulls."""
    has = "_metadata" in df.columns or _resolves(df, "_metadata.file_name")
    pick = lambda field, kind: (F.col(f"_metadata.{field}") if has else F.lit(None)).cast(kind)
    return df.select(
        "*", pick("file_name", "string").alias("_eng_source_file"), pick("file_size", "bigint").alias("_eng_source_size"),
        pick("file_modification_time", "timestamp").alias("_eng_source_time"),
    )


def with_hidden_metadata(df: DataFrame) -> DataFrame:
    """df with a file source's hidden metadata as a column of its own, which functions over partitions keep."""
    return df.withColumn("_metadata", F.col("_metadata")) if "_metadata" not in df.columns and _resolves(df, "_metadata.file_name") else df


def _resolves(df: DataFrame, name: str) -> bool:
    from pyspark.errors import AnalysisException

    try:
        df.select(name).schema  # noqa: B018
    except AnalysisException:
        return False
    return True


def with_ingestion_time(df: DataFrame) -> DataFrame:
    return df if "_eng_ingested_at" in df.columns else df.withColumn("_eng_ingested_at", F.current_timestamp())


def parse_json(df: DataFrame, columns: Mapping[str, str | None]) -> DataFrame:
    """JSON text columns to structs by DDL; without DDL (batch only) by the schema that holds the fields of all rows.

    A column without a value that tells fields becomes a struct without fields.
    """
    for name, ddl in columns.items():
        if not isinstance(df.schema[name].dataType, StringType):
            raise ShapeError(f"{name} is no string column")
        if ddl is None:
            if df.isStreaming:
                raise ShapeError(f"{name}: a stream needs the JSON schema")
            ddl = _json_schema(df, name)
        df = df.withColumn(name, F.from_json(F.col(name), ddl))
    return df


def _json_schema(df: DataFrame, name: str) -> StructType:
    """One pass of Spark's own inference over every value of the column."""
    texts = df.select(F.col(f"`{name}`").alias("value")).filter("value IS NOT NULL")
    spark = df.sparkSession
    rows = spark._jvm.org.apache.spark.sql.Encoders.STRING()
    schema = spark._jsparkSession.read().json(getattr(texts._jdf, "as")(rows)).schema()
    return StructType.fromJson(json.loads(schema.json()))


def flatten_struct(df: DataFrame, name: str) -> DataFrame:
    fields = df.schema[name].dataType.fieldNames()
    return df.select(*[F.col(f"`{c}`") for c in df.columns if c != name], *[F.col(f"`{name}`.`{f}`").alias(f"{name}_{f}") for f in fields])


def explode_outer(df: DataFrame, name: str) -> DataFrame:
    """One row per element; a row with a null or empty array stays."""
    return df.select(*[F.explode_outer(name).alias(name) if c == name else F.col(f"`{c}`") for c in df.columns])


def explode_columns(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """Arrays are exploded, their structs flattened one level; an empty list flattens everything."""
    if not names:
        return flatten_all(df)
    for name in names:
        kind = df.schema[name].dataType
        if not isinstance(kind, ArrayType | StructType):
            raise ShapeError(f"{name} is neither array nor struct")
        if isinstance(kind, ArrayType):
            df, kind = explode_outer(df, name), kind.elementType
        if isinstance(kind, StructType):
            df = flatten_struct(df, name)
    return df


def flatten_all(df: DataFrame) -> DataFrame:
    """All arrays exploded and all structs opened, to any depth; several arrays of a row give all combinations.

    Plain columns come first, then those of nested ones, each named after its path. The schema is walked once per
    level of arrays: one select opens all structs, and each array that it meets is exploded for the next one.
    """
    while True:
        leaves = [leaf for f in df.schema.fields if not _nested(f.dataType) for leaf in _leaves(F.col(f"`{f.name}`"), f.name, f.dataType)]
        leaves += [leaf for f in df.schema.fields if _nested(f.dataType) for leaf in _leaves(F.col(f"`{f.name}`"), f.name, f.dataType)]
        arrays = [name for name, _, kind in leaves if isinstance(kind, ArrayType)]
        df = df.select(*[column.alias(name) for name, column, _ in leaves])
        if not arrays:
            return df
        for name in arrays:
            df = explode_outer(df, name)


def _nested(kind: DataType) -> bool:
    return isinstance(kind, ArrayType | StructType)


def _leaves(column: Column, name: str, kind: DataType) -> list[tuple[str, Column, DataType]]:
    """(name, column, type) of everything below a column that is no struct."""
    if not isinstance(kind, StructType):
        return [(name, column, kind)]
    return [leaf for f in kind.fields for leaf in _leaves(column.getField(f.name), f"{name}_{f.name}", f.dataType)]


def standardise(df: DataFrame, expressions: Sequence[str]) -> DataFrame:
    """Scalar SQL expressions, each ending in AS name; later ones see what earlier ones made."""
    for text in expressions:
        m = re.fullmatch(r"(?is)\s*(.+?)\s+as\s+`?([A-Za-z_]\w*)`?\s*", text)
        if not m:
            raise ShapeError(f"standardisation must end in AS name: {text}")
        check_scalar(df.sparkSession, m[1])
        df = df.withColumn(m[2], F.expr(m[1]))
    return df


def check_scalar(spark: SparkSession, text: str) -> None:
    """Raises unless the text is one expression, by Spark's own parser, that holds no query."""
    try:
        tree = spark._jsparkSession.sessionState().sqlParser().parseExpression(text)
    except Exception as e:
        raise ShapeError(f"not a scalar expression: {text}") from e
    nodes = [tree]
    while nodes:
        node = nodes.pop()
        if "Subquery" in node.getClass().getSimpleName() or node.getClass().getSimpleName() in ("Exists", "ListQuery"):
            raise ShapeError(f"must be a scalar expression without a query: {text}")
        children = node.children()
        nodes += [children.apply(i) for i in range(children.size())]


def dedup(df: DataFrame, watermark: tuple[str, str] | None = None) -> DataFrame:
    """Drops repeated rows, compared on all but reserved columns; streams with a watermark (column, delay) are
    bounded by it, and others keep every row in their state, of which a warning tells."""
    columns = [c for c in df.columns if not c.startswith(RESERVED) and c not in ("_rescued_data", "_metadata")]
    if df.isStreaming and watermark:
        return df.withColumn(watermark[0], F.col(watermark[0]).cast("timestamp")).withWatermark(*watermark).dropDuplicatesWithinWatermark(columns)
    if df.isStreaming:
        warnings.warn("dedup of a stream without a watermark keeps every distinct row in its state", stacklevel=2)
    return df.dropDuplicates(columns)


def front_columns(df: DataFrame, first: Sequence[str]) -> DataFrame:
    """Keys, clustering and hash columns first, so that file statistics cover them."""
    lower = {c.lower(): c for c in df.columns}
    lead = list(dict.fromkeys(lower[c.lower()] for c in first if c.lower() in lower))
    return df.select(*lead, *[c for c in df.columns if c not in lead])


def strip_reserved(df: DataFrame) -> DataFrame:
    return df.drop(*[c for c in df.columns if c.startswith(RESERVED)])
