"""Replacing codes with labels.

A code map is metadata.  Its labels become one row, a map per coded column, that a
scalar subquery attaches: all columns of a table are decoded in one narrow step,
the facts are not moved, and it does not matter how the code map was made.  The
query stops if that row would hold more than ``IN_ONE_ROW`` codes; whoever has such
a code map asks for joins (``joined=True``), one per column.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

_WHOLE = ("tinyint", "smallint", "int", "bigint")
_FRACTION = ("float", "double")

#: Rows of a code map that may travel as one row.
IN_ONE_ROW = 50_000


def _label_key(value: Column, kind: str) -> Column:
    """The text under which a code or a value of this type is looked up in label mode."""
    if kind in _WHOLE:
        return value.try_cast("double").try_cast("bigint").cast("string")
    if kind in _FRACTION or kind.startswith("decimal"):
        return (value.try_cast("double") + F.lit(0.0)).cast("string")
    return value


def _typed_key(value: Column, kind: str) -> Column:
    """The same in typed mode, where every numeric column compares as a fraction."""
    return value if kind == "string" else (value.try_cast("double") + F.lit(0.0)).cast("string")


def _labels(
    df: DataFrame, code_map: DataFrame, columns: Sequence[str], key: Callable[[Column, str], Column], winner: Callable
) -> dict[str, Column]:
    """Per column its label for the value there, NULL where the code is unknown."""
    kinds = dict(df.dtypes)
    variable = F.col("variable")
    wanted = F.lit(None).cast("string")
    for column in columns:
        wanted = F.when(variable == column, key(F.col("code"), kinds[column])).otherwise(wanted)
    codes = (
        code_map.where(F.col("code").isNotNull() & variable.isin(*columns))
        .select("variable", wanted.alias("key"), "label", "ord").where(F.col("key").isNotNull())
        .groupBy("variable", "key").agg(winner("label", "ord").alias("label"))
    )
    entries = [F.collect_list(F.when(variable == c, F.struct("key", "label"))) for c in columns]
    row = F.struct(*[F.map_from_entries(e).alias(f"m{i}") for i, e in enumerate(entries)])
    too_many = F.count("*") > IN_ONE_ROW
    maps = codes.agg(F.when(too_many, F.raise_error(F.lit(f"more than {IN_ONE_ROW} codes: decode with joined=True"))).otherwise(row).alias("maps")).scalar()
    return {c: F.try_element_at(maps[f"m{i}"], key(F.col(c), kinds[c])) for i, c in enumerate(columns)}


def _joined_labels(
    df: DataFrame, code_map: DataFrame, columns: Sequence[str], key: Callable[[Column, str], Column], winner: Callable
) -> tuple[DataFrame, dict[str, Column]]:
    """The same for a code map of any size, by one join per column."""
    kinds = dict(df.dtypes)
    for i, column in enumerate(columns):
        codes = (
            code_map.where((F.col("variable") == column) & F.col("code").isNotNull())
            .select(key(F.col("code"), kinds[column]).alias(f"__key{i}"), "label", "ord").where(F.col(f"__key{i}").isNotNull())
            .groupBy(f"__key{i}").agg(winner("label", "ord").alias(f"__label{i}"))
        )
        df = df.join(codes, key(F.col(column), kinds[column]) == F.col(f"__key{i}"), "left")
    return df, {c: F.col(f"__label{i}") for i, c in enumerate(columns)}


def _with_labels(df: DataFrame, code_map: DataFrame, columns: Sequence[str], key, winner, shape: Callable, joined: bool) -> DataFrame:
    order, kinds = df.columns, dict(df.dtypes)
    if not columns:
        return df
    if joined:
        df, labels = _joined_labels(df, code_map, columns, key, winner)
    else:
        labels = _labels(df, code_map, columns, key, winner)
    decoded = {c: shape(F.coalesce(labels[c], F.col(c).cast("string")), kinds[c]) for c in columns}
    return df.select(*[decoded[c].alias(c) if c in decoded else F.col(c) for c in order])


def decode_labels(df: DataFrame, code_map: DataFrame, table: str, columns: Sequence[str] | None = None, joined: bool = False) -> DataFrame:
    """Label mode: only the table's own codes count, the last of duplicate codes
    wins, unmatched values stay as text.  Numeric columns compare as numbers."""
    own = code_map.where(F.col("table") == table)
    return _with_labels(df, own, list(df.columns if columns is None else columns), _label_key, F.max_by, lambda text, kind: text, joined)


def decode_typed(df: DataFrame, code_map: DataFrame, columns: Sequence[str], joined: bool = False) -> DataFrame:
    """Typed mode: codes are found by variable name alone, the first of duplicate
    codes wins, and the result returns to the column's own type, so a label in a
    numeric column becomes NULL."""
    shape = lambda text, kind: text if kind == "string" else text.try_cast(kind)
    return _with_labels(df, code_map, list(columns), _typed_key, F.min_by, shape, joined)


def codes_of(code_map: DataFrame, table: str) -> list[str]:
    """Variables of a table that have codes at all (schema metadata, not data)."""
    rows = (
        code_map.where((F.col("table") == table) & F.col("code").isNotNull()).select("variable").distinct().collect()
    )
    return sorted(r.variable for r in rows)
