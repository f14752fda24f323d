"""Nested event rows from flat expressions."""

from __future__ import annotations

from functools import cache

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from secflow.schema import event_schema


@cache
def _schema() -> T.StructType:
    return event_schema()


def _texts(paths: frozenset[str], schema: T.StructType, prefix: str = "") -> list[tuple[str, str]]:
    """(field, SQL text) per field; given leaves are columns named like their path."""
    out = []
    for field in schema.fields:
        path, kind = prefix + field.name, field.dataType
        if path in paths:
            text = f"CAST(`{path}` AS {kind.simpleString()})"
        elif isinstance(kind, T.StructType) and any(p.startswith(path + ".") for p in paths):
            text = "named_struct(" + ", ".join(f"'{n}', {t}" for n, t in _texts(paths, kind, path + ".")) + ")"
        else:
            text = f"CAST(NULL AS {kind.simpleString()})"
        out.append((field.name, text))
    return out


def assemble(df: DataFrame, leaves: dict[str, Column], keep: tuple[str, ...] = ()) -> DataFrame:
    """``df`` as rows of the event schema, built from dotted-path ``leaves``.

    Paths that are not given are null, and a struct without any given leaf is null as a whole.
    """
    flat = df.select(*keep, *[c.alias(path) for path, c in leaves.items()])
    return flat.selectExpr(*keep, *[f"{text} AS `{name}`" for name, text in _texts(frozenset(leaves), _schema())])


def identity_leaves(class_uid: Column, activity_id: Column) -> dict[str, Column]:
    """The derived class columns: they are never set by hand."""
    return {
        "class_uid": class_uid, "activity_id": activity_id,
        "category_uid": F.floor(class_uid / F.lit(1000)), "type_uid": class_uid * 100 + activity_id,
    }
