"""Metrics as rows: one (collector, type, metric_key) with a number, a text or a flag.

``label`` keeps the data-derived name a key was built from. Two labels can give one key;
``seq`` says which of them a document keeps (the highest).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import types as T

METRIC_SCHEMA = (
    "collector string, type string, metric_key string, label string, seq double, "
    "value_double double, value_string string, value_bool boolean"
)


def _entry(kind: T.DataType, key: str, column: str) -> str:
    number = text = flag = "null"
    if isinstance(kind, T.BooleanType):
        flag = f"`{column}`"
    elif isinstance(kind, T.StringType):
        text = f"`{column}`"
    else:
        number = f"`{column}`"
    return f"{key}, cast({number} as double), cast({text} as string), cast({flag} as boolean)"


def metric_rows(
    df: DataFrame,
    collector: str,
    doc_type: str,
    entries: Sequence[tuple[str, str]],
    label: str = "cast(null as string)",
    seq: str = "0",
) -> DataFrame:
    """Unpivot ``df`` into metric rows; entries pair a key, as SQL text, with the column of its value."""
    kinds = {field.name: field.dataType for field in df.schema.fields}
    listed = ", ".join(_entry(kinds[column], key, column) for key, column in entries)
    return df.selectExpr(
        f"'{collector}' as collector",
        f"'{doc_type}' as type",
        f"stack({len(entries)}, {listed}) as (metric_key, value_double, value_string, value_bool)",
        f"{label} as label",
        f"cast({seq} as double) as seq",
    ).filter(
        "length(trim(metric_key)) > 0 "
        "and (value_double is not null or value_string is not null or value_bool is not null)"
    )


def plain_entries(df: DataFrame, prefix: str = "") -> list[tuple[str, str]]:
    """Every column under its own name, with a prefix."""
    return [(f"'{prefix}{name}'", name) for name in df.columns]


def constant_metrics(spark, collector: str, doc_type: str, values: dict[str, object]) -> DataFrame:
    rows = []
    for key, value in values.items():
        is_flag, is_text = isinstance(value, bool), isinstance(value, str)
        rows.append((
            collector, doc_type, key, None, 0.0,
            None if is_flag or is_text else float(value),
            value if is_text else None,
            value if is_flag else None,
        ))
    return spark.createDataFrame(rows, METRIC_SCHEMA)
