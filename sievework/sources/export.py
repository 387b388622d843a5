"""Reports as files: nested values flattened for CSV, kept for JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def flat_columns(schema: T.StructType, parent: Column | None = None, prefix: str = "") -> list[Column]:
    """Leaves of a nested schema as columns named by their path, joined with ``_``.

    Lists and maps become JSON text.
    """
    leaves: list[Column] = []
    for entry in schema.fields:
        value = F.col(f"`{entry.name}`") if parent is None else parent.getField(entry.name)
        label = f"{prefix}_{entry.name}" if prefix else entry.name
        if isinstance(entry.dataType, T.StructType):
            leaves += flat_columns(entry.dataType, value, label)
        elif isinstance(entry.dataType, (T.ArrayType, T.MapType)):
            leaves.append(F.to_json(value).alias(label))
        else:
            leaves.append(value.alias(label))
    return leaves


def flattened(df: DataFrame) -> DataFrame:
    return df.select(*flat_columns(df.schema))


def export_report(df: DataFrame, path: str, layout: str = "json") -> None:
    """Write a report frame as ``json`` (nested) or ``csv`` (flattened, with header)."""
    if layout == "json":
        df.write.mode("overwrite").json(path)
    elif layout == "csv":
        flattened(df).write.mode("overwrite").options(header=True, escape='"').csv(path)
    else:
        raise ValueError(f"Unknown report layout: {layout}")
