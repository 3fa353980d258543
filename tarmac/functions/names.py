"""Column-name normalisation, for headers and for name columns alike."""

from __future__ import annotations

import re
from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Rewrites applied in this order after lower-casing.
HEADER_REWRITES = (
    (" ", "_"),
    (r"[()]", ""),
    ("1st", "first"),
    ("2nd", "second"),
    ("-", "_"),
    (r"\?", ""),
)

# Rewrites that turn a normalised header into its variable name,
# applied in this order.
VARIABLE_REWRITES = (
    ("_null_if_not_known", ""),
    ("_dd/mm/yyyy|_hh:mm", ""),
    ("highway_authority___ons_code", "highway"),
    ("lower_super_ouput_area", "lsoa"),
    ("_england_&_wales_only", ""),
    ("_cc", ""),
    ("vehicle_propulsion_code", "propulsion_code"),
    ("pedestrian_road_maintenance_worker_from_2011", "pedestrian_road_maintenance_worker"),
    ("engine_capacity", "engine_capacity_cc"),
    ("age_of_vehicle_manufacture", "age_of_vehicle"),
)


def _rewrite_text(text: str, rules) -> str:
    return reduce(lambda acc, rule: re.sub(rule[0], rule[1], acc), rules, text)


def _rewrite_column(col: Column, rules) -> Column:
    return reduce(lambda acc, rule: F.regexp_replace(acc, rule[0], rule[1]), rules, col)


def header_name(col: Column) -> Column:
    """Normalised form of a column holding header names."""
    return _rewrite_column(F.lower(col), HEADER_REWRITES)


def variable_name(col: Column) -> Column:
    """Canonical variable name of a column holding header names."""
    return _rewrite_column(header_name(col), VARIABLE_REWRITES)


def header_names(names: Sequence[str]) -> list[str]:
    return [_rewrite_text(name.lower(), HEADER_REWRITES) for name in names]


def variable_names(names: Sequence[str]) -> list[str]:
    return [_rewrite_text(name, VARIABLE_REWRITES) for name in header_names(names)]


def normalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*header_names(df.columns))


def canonicalise_headers(df: DataFrame) -> DataFrame:
    return df.toDF(*variable_names(df.columns))
