"""Reading raw record files."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tarmac.functions.names import header_names, normalise_headers
from tarmac.model import RAW_TYPES
from tarmac.operators import clean, decode

# Published file names.
FILE_STEM = "dft-road-casualty-statistics"
KINDS = ("casualty", "collision", "vehicle")
ALL_YEARS, LAST_FIVE = "1979-latest-published-year", "last-5-years"
ADJUSTED_STEMS = ("casualties-adjustment", "collision-adjustment")
ADJUSTMENT_LOOKUP = "adjustment-lookup_2004-latest-published-year"
FIRST_SINGLE_YEAR, LAST_SINGLE_YEAR = 2020, 2050
FIRST_FULL_YEAR = 1979


def file_names(years: Sequence[int]) -> list[str]:
    """Names of the published files when the given single years are out."""
    names = [f"{FILE_STEM}-{kind}-{year}.csv" for year in sorted(years, reverse=True) for kind in KINDS]
    names += [f"{FILE_STEM}-{stem}-{LAST_FIVE}.csv" for stem in ADJUSTED_STEMS]
    names += [f"{FILE_STEM}-{kind}-{ADJUSTMENT_LOOKUP}.csv" for kind in KINDS[:2]]
    names += [f"{FILE_STEM}-{kind}-{span}.csv" for span in (ALL_YEARS, LAST_FIVE) for kind in KINDS]
    return names


def file_filter(name: Column, year: int | str | None = None, kind: str | None = None) -> Column:
    """Predicate choosing the files for a year (or the last five years) and a kind.

    Recent years have files of their own; older ones are only in the full file.
    Adjustment files are never chosen by year.
    """
    wanted = F.lit(True)
    if year in (5, "5", "5 years"):
        wanted = wanted & name.contains(LAST_FIVE) & ~name.contains("adjust")
    elif year is not None and FIRST_SINGLE_YEAR <= int(year) <= LAST_SINGLE_YEAR:
        wanted = wanted & name.contains(str(year)) & ~name.contains("1979") & ~name.contains("adjust")
    elif year is not None and int(year) >= FIRST_FULL_YEAR:
        wanted = wanted & name.contains("1979")
    if kind is not None:
        # "cas" alone would also match the stem of every name
        wanted = wanted & name.rlike("(?i)" + kind.replace("cas", "ics-cas"))
    return wanted


def select_files(spark: SparkSession, names: Sequence[str], year=None, kind: str | None = None) -> list[str]:
    """File names for a year and kind; a kind without files falls back to the year's."""
    listing = spark.createDataFrame([(n,) for n in dict.fromkeys(names)], "name string")
    chosen = [r.name for r in listing.where(file_filter(F.col("name"), year, kind)).collect()]
    if not chosen and kind is not None and year is not None:
        chosen = [r.name for r in listing.where(file_filter(F.col("name"), year)).collect()]
    elif not chosen and kind is not None:
        raise FileNotFoundError(f"no files of kind {kind}")
    return chosen


def declared_schema(header: Sequence[str], types: dict[str, T.DataType] = RAW_TYPES) -> T.StructType:
    """Schema of a header: declared types by normalised name, text for the rest."""
    return T.StructType(
        [T.StructField(raw, types.get(name, T.StringType())) for raw, name in zip(header, header_names(header))]
    )


def read_csv(spark: SparkSession, path: str | list[str], types: dict[str, T.DataType] = RAW_TYPES, guess: bool = False) -> DataFrame:
    """CSV with a header, typed by declaration.  Only the header is looked at before
    the scan; values that do not fit their type become NULL.  Several files must
    share one header: a file that differs is an error, not a shifted table.

    Columns nobody declared are text; with ``guess`` all their values are looked at
    first (one scan) and they get the narrowest type that holds them."""
    header = spark.read.option("header", True).csv(path).columns
    reader = spark.read.option("header", True).option("mode", "PERMISSIVE").option("enforceSchema", False)
    df = reader.schema(declared_schema(header, types)).csv(path)
    if not guess:
        return df
    return guess_types(df, [raw for raw, name in zip(header, header_names(header)) if name not in types])


_NUMBER = r"[+-]?(0|[1-9][0-9]*|(?=\.[0-9]))"
#: From narrow to wide: name, what a value of it looks like, and the column of that type.
#: A number that begins with a needless zero is a code, hence text.  Times of day stay text.
_GUESSES = [
    ("boolean", lambda v: v.isin("T", "F", "TRUE", "FALSE", "true", "false"), lambda v: v.isin("T", "TRUE", "true")),
    ("int", lambda v: v.rlike(f"^{_NUMBER}$") & v.try_cast("int").isNotNull(), lambda v: v.try_cast("int")),
    ("bigint", lambda v: v.rlike(f"^{_NUMBER}$") & v.try_cast("bigint").isNotNull(), lambda v: v.try_cast("bigint")),
    ("double", lambda v: v.rlike(rf"^{_NUMBER}(\.[0-9]*)?([eE][+-]?[0-9]+)?$"), lambda v: v.try_cast("double")),
    ("date", lambda v: v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$") & v.try_cast("date").isNotNull(), lambda v: v.try_cast("date")),
    ("timestamp_ntz", lambda v: v.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}[T ][0-9]{2}:[0-9]{2}:[0-9]{2}(\.[0-9]+)?$") & v.try_cast("timestamp_ntz").isNotNull(), lambda v: v.try_cast("timestamp_ntz")),
    ("string", lambda v: F.lit(True), lambda v: v),
]


def guess_types(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text columns in the narrowest type that all their values fit, else unchanged.

    One aggregate over all rows and columns finds the width of the widest value;
    numbers, dates and truth values have only text in common.  NULL fits
    everything, a column of nothing else is boolean.
    """
    if not columns:
        return df
    held = lambda c: F.col(f"`{c}`")
    fits = [F.bool_and(held(c).isNull() | looks(F.trim(held(c)))).alias(f"{i}_{k}") for i, c in enumerate(columns) for k, (_, looks, _) in enumerate(_GUESSES)]
    row = df.agg(*fits).first()
    chosen = {}
    for i, c in enumerate(columns):
        k = next(k for k in range(len(_GUESSES)) if row[f"{i}_{k}"] is not False)  # no rows at all: None
        if _GUESSES[k][0] != "string":
            chosen[c] = _GUESSES[k][2](F.trim(held(c)))
    return df.select(*[chosen[c].alias(c) if c in chosen else held(c) for c in df.columns])


def kind_of(text: str) -> str:
    """Table kind from a user's word; anything not vehicle or casualty is a collision."""
    if re.search("veh", text, re.IGNORECASE):
        return "vehicle"
    if re.search("cas", text, re.IGNORECASE):
        return "casualty"
    return "collision"


def read_table(
    spark: SparkSession, kind: str, path: str | list[str], code_map: DataFrame | None = None, formatted: bool = True
) -> DataFrame:
    """Raw or formatted records of one kind from CSV files.

    Formatted means normalised names, decoded values in their own types, parsed
    dates and numeric coordinates.
    """
    df = read_csv(spark, path)
    if not formatted:
        return df
    df = normalise_headers(df)
    if code_map is not None:
        coded = [v for v in decode.codes_of(code_map, kind_of(kind)) if v in df.columns]
        df = decode.decode_typed(df, code_map, coded)
    return clean.force_numeric_coordinates(clean.parse_dates(df))


def read_collisions(spark, path, code_map=None, formatted=True) -> DataFrame:
    return read_table(spark, "collision", path, code_map, formatted)


def read_vehicles(spark, path, code_map=None, formatted=True) -> DataFrame:
    return read_table(spark, "vehicle", path, code_map, formatted)


def read_casualties(spark, path, code_map=None, formatted=True) -> DataFrame:
    return read_table(spark, "casualty", path, code_map, formatted)


def get_records(
    spark: SparkSession,
    folder: str,
    year: int | str | None = None,
    kind: str = "collision",
    code_map: DataFrame | None = None,
    formatted: bool = True,
    output: str = "table",
    available: Sequence[str] | None = None,
) -> DataFrame:
    """One call from year and kind to records.

    ``output`` is ``table``, ``points`` (rows with coordinates) or ``window`` (points
    clipped to the UK).  Casualties have no position and always give a table.
    ``available`` lists the file names at hand; by default the folder is listed.
    """
    table_kind = kind_of(kind)
    names = list(available) if available is not None else list_folder(spark, folder)
    chosen = select_files(spark, names, year, table_kind)
    if not chosen:
        raise FileNotFoundError(f"no {table_kind} file for {year} in {folder}")
    df = read_table(spark, table_kind, f"{folder}/{chosen[0]}", code_map, formatted)
    if output == "table" or table_kind == "casualty":
        return df
    x, y = clean.coordinate_columns(df.columns)[:2]
    df = clean.drop_missing_coordinates(df, x, y)
    return clean.clip_to_uk(df, x, y) if output == "window" else df


def list_folder(spark: SparkSession, folder: str) -> list[str]:
    """Names of the CSV files in a folder, through the file listing of Spark's own
    source (works on any file system Spark reads)."""
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.csv").load(folder).select("path")
    return sorted(r.path.rsplit("/", 1)[-1] for r in listing.collect())


def read_code_map(spark: SparkSession, path: str) -> DataFrame:
    """Code list from CSV; ``ord`` numbers the rows in file order (one small file)."""
    raw = spark.read.option("header", True).csv(path)
    return raw.coalesce(1).withColumn("ord", F.monotonically_increasing_id().cast("int"))
