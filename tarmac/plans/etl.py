"""The cleaning run: raw files to consistent tables and aggregates.

Each table is written before the next step reads it, so nothing is computed
twice and a lost executor costs only the stage it was in.  Steps that do not need
each other run side by side.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from tarmac.functions.geo import with_lonlat
from tarmac.functions.names import normalise_headers
from tarmac.operators import clean, decode, hotspots, joins, kpi
from tarmac.session import side_by_side
from tarmac.sources import records, tables


class Tables(dict[str, DataFrame]):
    """Stored tables by name; ``dropped`` has the rows that cleaning left out, by table and reason.

    The counts were taken while the tables were written.  Where executors were lost
    meanwhile, rows read twice count twice.
    """

    def __init__(self) -> None:
        super().__init__()
        self.dropped: dict[str, dict[str, int]] = {}


def locate(df: DataFrame, removed: Observation | None = None) -> DataFrame:
    """Drop rows without a position and add it as text.  Longitude and latitude are
    preferred; national grid coordinates are reprojected when they are all there is."""
    if {"longitude", "latitude"} <= set(df.columns):
        df = clean.drop_missing_coordinates(df, "longitude", "latitude", removed)
    elif {"location_easting_osgr", "location_northing_osgr"} <= set(df.columns):
        df = clean.drop_missing_coordinates(df, "location_easting_osgr", "location_northing_osgr", removed)
        df = with_lonlat(df, "location_easting_osgr", "location_northing_osgr")
    else:
        return df
    return tables.with_wkt(df)


def clean_table(df: DataFrame, kind: str, code_map: DataFrame, dropped: dict[str, Observation] | None = None) -> DataFrame:
    """Names, labels, dates, derived columns and the year range of one raw table.

    ``dropped`` gets an observation for each reason to leave rows out.
    """
    dropped = {} if dropped is None else dropped
    df = normalise_headers(df)
    coded = [v for v in decode.codes_of(code_map, kind) if v in df.columns]
    df = clean.parse_dates(decode.decode_labels(df, code_map, kind, coded))
    if kind == "collision":
        df = clean.add_time_features(df)
    elif kind == "casualty":
        df = clean.add_age_group(df)
    dropped["outside_years"] = Observation()
    df = clean.keep_years(df, removed=dropped["outside_years"])
    if kind != "collision":
        return df
    if {"longitude", "latitude"} <= set(df.columns) or {"location_easting_osgr", "location_northing_osgr"} <= set(df.columns):
        dropped["without_position"] = Observation()
    return locate(df, dropped.get("without_position"))


def enforce_keys(collision: DataFrame, **children: DataFrame) -> dict[str, DataFrame]:
    """Children whose collision was kept."""
    return {name: joins.keep_children(child, collision) for name, child in children.items()}


AGGREGATES = {
    "kpi_monthly": kpi.kpi_monthly,
    "kpi_daily": kpi.kpi_daily,
    "by_hour": lambda collision: kpi.count_by_severity(collision, "hour"),
    "by_dow": lambda collision: kpi.count_by_severity(collision, "day_of_week"),
    "collision_geopoints": hotspots.geopoints,
    "geo_events_raw": hotspots.geo_events,
}


#: Tables that maps and rankings read by year and place: partitioned, and clustered by whole degrees.
_BY_YEAR_AND_PLACE = ("collision_geopoints", "geo_events_raw")
DATABASE = "road_collisions"


def run(
    spark: SparkSession,
    files: dict[str, str | list[str]],
    code_map: DataFrame,
    out: str,
    buckets: int | None = None,
    database: str = DATABASE,
    csv_compression: str = "gzip",
) -> Tables:
    """Clean ``files`` (kind to path) into Parquet tables below ``out``.

    The cleaned CSV copies are written before keys are enforced, so they still hold
    orphans; the tables do not.  They are the largest part of what is written, so
    they are compressed (``csv_compression``; ``none`` for plain text).  Collisions and the map tables are partitioned by
    year.  All results are tables of ``database``, which is made if it is missing;
    their files stay below ``out``.  A further run puts new versions in their place
    one by one (``tables.replace_table``): readers of the old ones are not cut off.
    With ``buckets`` the facts are hashed on the
    collision key: enforcing keys and building the master table then starts without
    shuffling them.
    """
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {database} LOCATION '{out}/database'")

    result = Tables()

    def store(df: DataFrame, name: str, partition_by: Sequence[str] = (), sort_by: Sequence[Column] = (), hashed: bool = False) -> DataFrame:
        by_key = (buckets, joins.COLLISION_KEY) if hashed and buckets is not None else None
        return tables.replace_table(df, database, name, out, partition_by, sort_by, by_key)

    def cleaned_table(kind: str, path: str | list[str]) -> tuple[DataFrame, dict[str, int]]:
        dropped: dict[str, Observation] = {}
        df = clean_table(records.read_csv(spark, path), kind, code_map, dropped)
        if kind == "collision":  # no key to enforce: cleaned and final are the same
            stored = store(df, kind, ["year"], hashed=True)
        else:
            stored = store(df, f"cleaned_{kind}", hashed=True)
        start(tables.write_csv, stored, f"{out}/csv/{kind}", csv_compression)
        return stored, {reason: seen.get["n"] for reason, seen in dropped.items()}

    def kept_table(kind: str) -> tuple[DataFrame, int | None]:
        child, _ = cleaned[kind].result()
        if "collision" not in cleaned:
            return store(child, kind, hashed=True), None
        seen, kept = Observation(), Observation()
        collision, _ = cleaned["collision"].result()
        stored = store(joins.keep_children(child, collision, seen=seen, kept=kept), kind, hashed=True)
        return stored, seen.get["n"] - kept.get["n"]

    def master() -> DataFrame:
        stored = store(joins.master(cleaned["collision"].result()[0], *[final[kind].result()[0] for kind in ("vehicle", "casualty")]), "master")
        start(tables.write_csv, stored, f"{out}/csv/master", csv_compression)
        return stored

    def aggregate(name: str) -> DataFrame:
        by_place = name in _BY_YEAR_AND_PLACE
        df = AGGREGATES[name](cleaned["collision"].result()[0])
        return store(df, name, ["year"] if by_place else (), [F.floor("latitude"), F.floor("longitude")] if by_place else ())

    result["code_map"] = store(code_map, "code_map")
    with side_by_side(spark, len(files) + len(AGGREGATES)) as start:
        cleaned = {kind: start(cleaned_table, kind, path) for kind, path in files.items()}
        final = {kind: start(kept_table, kind) for kind in ("vehicle", "casualty") if kind in cleaned}
        whole = start(master) if {"collision", *final} == {"collision", "vehicle", "casualty"} and "collision" in cleaned else None
        built = {name: start(aggregate, name) for name in AGGREGATES} if "collision" in cleaned else {}
    for kind, future in cleaned.items():
        stored, result.dropped[kind] = future.result()
        if kind == "collision":
            result[kind] = stored
    for kind, future in final.items():
        result[kind], orphans = future.result()
        if orphans is not None:
            result.dropped[kind]["orphans"] = orphans
    if whole is not None:
        result["master"] = whole.result()
    for name, future in built.items():
        result[name] = future.result()
    return result
