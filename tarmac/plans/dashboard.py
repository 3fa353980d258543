"""The dashboard pages as functions from user choices to DataFrames.

Pages read the stored tables of the cleaning run (a dict of name to DataFrame).
Small aggregate tables answer the overview; only the pages that need facts scan
them, with the time and severity choices pushed into the scan.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from tarmac.functions.predicates import TimeFilter, all_of, any_of, equal_unless_all, severity_in
from tarmac.functions.severity import colour
from tarmac.operators import breakdown, hotspots, kpi

Tables = dict[str, DataFrame]


def choices(tables: Tables) -> dict[str, DataFrame]:
    """Years (newest first) and the date range offered in the sidebar."""
    return {
        "years": breakdown.years_on_record(tables["kpi_monthly"]),
        "dates": breakdown.date_range(tables["kpi_daily"]),
    }


def overview(tables: Tables, when: TimeFilter, severities: Sequence[str], adjusted: bool = False) -> dict[str, DataFrame | None]:
    """Totals and trend.  A year shows all its months even when one month is chosen;
    the trend then goes daily."""
    if when.start is not None:
        return {
            "totals": kpi.kpi_range(tables["kpi_daily"], when.start, when.end, severities),
            "trend": kpi.daily_trend_range(tables["kpi_daily"], when.start, when.end, severities),
        }
    yearly = kpi.kpi_year_on_year(tables["kpi_monthly"], severities).where(F.col("year") == when.year)
    if when.month is not None:
        trend = kpi.daily_trend_of_month(tables["kpi_daily"], when.year, when.month, severities)
    else:
        trend = kpi.trend_long(kpi.monthly_trend(tables["kpi_monthly"], when.year, adjusted), severities)
    return {"totals": yearly, "trend": trend}


def heatmap(
    tables: Tables,
    when: TimeFilter,
    severities: Sequence[str],
    road_types: Sequence[str] = (),
    weather: Sequence[str] = (),
    light: Sequence[str] = (),
    *,
    limit: int,
) -> dict[str, DataFrame]:
    """Points to draw, at most ``limit`` of ``matching``; the centre is that of the drawn ones."""
    condition = all_of(
        when.column(),
        severity_in(severities),
        any_of("road_type", road_types),
        any_of("weather_conditions", weather),
        any_of("light_conditions", light),
    )
    points = hotspots.map_points(tables["collision_geopoints"], condition, limit)
    return {
        "points": points.withColumn("color", colour(F.col("collision_severity"))),
        "matching": tables["collision_geopoints"].where(condition).agg(F.count("*").alias("n")),
        "centre": breakdown.centroid(points),
    }


def demographics(
    tables: Tables,
    when: TimeFilter,
    severities: Sequence[str],
    classes: Sequence[str] = (),
    sexes: Sequence[str] = (),
    ages: Sequence[str] = (),
) -> dict[str, DataFrame]:
    condition = all_of(when.column(), severity_in(severities))
    counts = breakdown.demographics(tables["casualty"], tables["collision"], condition, classes, sexes, ages)
    return {
        "counts": counts,
        "by_mode": breakdown.mode_by_severity(counts),
        "mode_order": breakdown.mode_order(counts),
        "by_age_and_sex": breakdown.age_by_sex(counts),
    }


def environment(
    tables: Tables,
    when: TimeFilter,
    severities: Sequence[str],
    first: str,
    second: str | None = None,
    second_values: Sequence = (),
) -> dict[str, DataFrame]:
    condition = all_of(when.column(), severity_in(severities))
    page = {"by_severity": breakdown.factor_by_severity(tables["collision"], first, condition)}
    if second is not None and second != first:
        pair = breakdown.factor_interaction(tables["collision"], first, second, condition)
        page["interaction"] = pair
        if second_values:
            page["grid"] = breakdown.factor_pivot(pair, first, second, second_values)
    return page


def hotspot_options(tables: Tables, n: int) -> dict[str, DataFrame]:
    events = tables["geo_events_raw"]
    return {c: breakdown.top_values(events, c, n) for c in ("weather_conditions", "light_conditions", "road_type")}


def _hotspot_condition(when: TimeFilter, severities, weather, light, road_type):
    return all_of(
        when.column(),
        severity_in(severities),
        equal_unless_all("weather_conditions", weather),
        equal_unless_all("light_conditions", light),
        equal_unless_all("road_type", road_type),
    )


def hotspot_ranking(
    tables: Tables,
    when: TimeFilter,
    severities: Sequence[str],
    scale: int,
    metric: str,
    top: int,
    centre: tuple[float, float] = hotspots.DEFAULT_CENTRE,
    radius_miles: float | None = None,
    weather: str = "All",
    light: str = "All",
    road_type: str = "All",
) -> DataFrame:
    condition = _hotspot_condition(when, severities, weather, light, road_type)
    return hotspots.hotspots(tables["geo_events_raw"], scale, condition, metric, top, centre, radius_miles)


def hotspot_cell(
    tables: Tables,
    when: TimeFilter,
    severities: Sequence[str],
    scale: int,
    cell_id: str,
    order_by: str,
    limit: int,
    drawn: int,
    offset: int = 0,
    weather: str = "All",
    light: str = "All",
    road_type: str = "All",
    after: Row | None = None,
) -> dict[str, DataFrame]:
    """Severity counts of one cell, a page of its rows, and a sample of the page to draw.

    The page is found by ``offset``, or follows the row ``after`` of the page before
    (a row of ``hotspots.cell_page_after``), which costs the same on every page.
    """
    condition = _hotspot_condition(when, severities, weather, light, road_type)
    if after is None:
        page = hotspots.cell_page(tables["geo_events_raw"], scale, condition, cell_id, order_by, limit, offset)
    else:
        page = hotspots.cell_page_after(tables["geo_events_raw"], scale, condition, cell_id, order_by, limit, after)
    chosen = hotspots.stable_sample(page, page.columns, drawn)
    return {
        "severities": hotspots.cell_severities(tables["geo_events_raw"], scale, condition, cell_id),
        "page": page,
        "drawn": chosen.withColumn("color", colour(F.col("collision_severity"))),
        "centre": breakdown.centroid(chosen),
    }
