"""Inspection-history and model queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from tarmac.catalogue.entry import Catalogue
from tarmac.catalogue.roles import collision, table, tests, vehicle, with_roles
from tarmac.operators import clean, inspection, models

catalogue = Catalogue()
add = catalogue.add

_WEEK = 7 * 24 * 3600


def _documents(spark, d):
    """A vehicle document per event: its own reading as the newest test, and two
    older ones at half and a quarter of it, 100 and 200 days back."""
    stamp = lambda days: F.date_format(F.col("ts") - F.make_dt_interval(F.lit(days)), "yyyy.MM.dd HH:mm:ss")

    def test(days, share, result, unit, comment):
        return F.struct(
            stamp(days).alias("completedDate"),
            result.alias("testResult"),
            F.date_format(F.col("ts") + F.make_dt_interval(F.lit(365 - days)), "yyyy.MM.dd").alias("expiryDate"),
            (F.col("value") * share).cast("string").alias("odometerValue"),
            unit.alias("odometerUnit"),
            F.array(F.struct(comment.alias("type"), F.lit("note").alias("text"))).alias("rfrAndComments"),
        )

    kind = F.col("event_type")
    newest = test(
        0,
        1.0,
        F.when(kind == "error", "FAILED").otherwise("PASSED"),
        F.when(kind == "view", "km").when(kind != "signup", "mi"),
        F.when(kind == "purchase", "ADVISORY").otherwise("MINOR"),
    )
    middle = test(100, 0.5, F.lit("PASSED"), F.lit("mi"), F.lit("ADVISORY"))
    oldest = test(200, 0.25, F.lit("PASSED"), F.lit("mi"), F.lit("MINOR"))
    history = F.when(kind == "click", F.array(newest, middle)).otherwise(F.array(newest, middle, oldest))
    doc = F.to_json(
        F.struct(
            F.col("event_id").cast("string").alias("registration"),
            F.lit("2020.01.31").alias("registrationDate"),
            F.lit("2019.11.30").alias("manufactureDate"),
            F.get_json_object("props", "$.k").alias("manufactureYear"),
            history.alias("motTests"),
        )
    )
    return table(spark, d, "events").select(doc.alias("doc"))


_MILES = "value * CASE event_type WHEN 'view' THEN 0.621371 WHEN 'signup' THEN NULL ELSE 1 END"


@add(
    "inspection_parse",
    "SELECT CAST(event_id AS VARCHAR) AS registration, ts, round(value * share, 6) AS odometer, "
    "days FROM events, (VALUES (0, 1.0), (100, 0.5), (200, 0.25)) AS t(days, share) WHERE NOT (event_type = 'click' AND days = 200)",
)
def _(spark, d):
    rows = inspection.explode_tests(inspection.parse_documents(_documents(spark, d)))
    # each test's moment is set back to its event's to compare with the source
    events = table(spark, d, "events").select(F.col("event_id").cast("string").alias("registration"), "ts")
    return (
        rows.join(events, "registration")
        .withColumn("days", F.datediff("ts", "completed"))
        .select("registration", "ts", F.round("odometer", 6).alias("odometer"), "days")
    )


@add(
    "inspection_documents",
    "SELECT CAST(event_id AS VARCHAR) AS registration, CAST(json_extract_string(props, '$.k') AS INT) AS manufacture_year, "
    "DATE '2020-01-31' AS registration_date, CASE event_type WHEN 'click' THEN 2 ELSE 3 END AS n_tests, "
    "CASE event_type WHEN 'click' THEN 2 WHEN 'error' THEN 2 ELSE 3 END AS n_passed, "
    "CASE event_type WHEN 'purchase' THEN 2 ELSE 1 END AS n_passed_with_advisory, "
    "CAST(ts + INTERVAL 365 DAY AS DATE) AS latest_expiry, round(" + _MILES + ", 8) AS latest_odometer, "
    "CASE WHEN event_type <> 'click' THEN round(value * 0.25, 8) END AS prev_odometer, "
    "round(CASE WHEN event_type = 'click' THEN value / datediff('day', DATE '2020-01-31', CAST(ts AS DATE)) * 365.24 "
    "ELSE (" + _MILES + " - value * 0.25) / 200 * 365.24 END, 8) AS annual_mileage FROM events",
)
def _(spark, d):
    summary = inspection.summarise_documents(inspection.parse_documents(_documents(spark, d)))
    return summary.select(
        "registration",
        "manufacture_year",
        "registration_date",
        "n_tests",
        "n_passed",
        "n_passed_with_advisory",
        "latest_expiry",
        *[F.round(c, 8).alias(c) for c in ("latest_odometer", "prev_odometer", "annual_mileage")],
    )


@add(
    "inspection_counts",
    with_roles(
        "SELECT vehicle, count(*) AS n_tests, count(*) FILTER (result = 'PASSED') AS n_passed, "
        "count(*) FILTER (result = 'PASSED' AND advisory) AS n_passed_with_advisory FROM tests GROUP BY 1",
        "tests",
    ),
)
def _(spark, d):
    return inspection.count_tests(tests(spark, d))


_LATEST = (
    "SELECT vehicle, registration_date, expiry AS latest_expiry, completed AS latest_date, "
    "odometer * CASE unit WHEN 'km' THEN 0.621371 WHEN 'mi' THEN 1 END AS latest_odometer FROM tests "
    "QUALIFY row_number() OVER (PARTITION BY vehicle ORDER BY completed DESC, odometer DESC) = 1"
)
_LOOKBACK = (
    "SELECT l.*, p.prev_date, p.prev_odometer FROM latest l LEFT JOIN (SELECT t.vehicle, t.completed AS prev_date, "
    "t.odometer * CASE t.unit WHEN 'km' THEN 0.621371 WHEN 'mi' THEN 1 END AS prev_odometer FROM tests t JOIN latest l USING (vehicle) "
    "WHERE epoch_us(l.latest_date) - epoch_us(t.completed) >= 604800000000 "
    "QUALIFY row_number() OVER (PARTITION BY t.vehicle ORDER BY t.completed DESC, t.odometer DESC) = 1) p USING (vehicle)"
)


@add(
    "inspection_latest",
    with_roles(
        "SELECT vehicle, registration_date, latest_expiry, latest_date, round(latest_odometer, 6) AS latest_odometer FROM latest",
        "tests",
        latest=_LATEST,
    ),
)
def _(spark, d):
    return inspection.latest_tests(tests(spark, d)).withColumn("latest_odometer", F.round("latest_odometer", 6))


@add(
    "asof_lookback",
    with_roles(
        "SELECT vehicle, latest_date, prev_date, round(latest_odometer, 6) AS latest_odometer, round(prev_odometer, 6) AS prev_odometer FROM lookback",
        "tests",
        latest=_LATEST,
        lookback=_LOOKBACK,
    ),
)
def _(spark, d):
    found = inspection.asof_lookback(tests(spark, d), _WEEK)
    return found.select(
        "vehicle",
        "latest_date",
        "prev_date",
        F.round("latest_odometer", 6).alias("latest_odometer"),
        F.round("prev_odometer", 6).alias("prev_odometer"),
    )


@add(
    "annual_mileage",
    with_roles(
        ", g AS (SELECT vehicle, datediff('day', coalesce(CAST(prev_date AS DATE), registration_date), CAST(latest_date AS DATE)) AS days, "
        "CASE WHEN prev_date IS NOT NULL THEN latest_odometer - prev_odometer ELSE latest_odometer END AS driven FROM lookback) "
        "SELECT vehicle, round(driven / days * 365.24, 6) AS annual_mileage, CASE WHEN driven IS NOT NULL THEN round(days / 365.24, 6) END AS period_years FROM g",
        "tests",
        latest=_LATEST,
        lookback=_LOOKBACK,
    ),
)
def _(spark, d):
    found = inspection.annual_mileage(tests(spark, d), _WEEK)
    return found.select(
        "vehicle", F.round("annual_mileage", 6).alias("annual_mileage"), F.round("period_years", 6).alias("period_years")
    )


# --- models -------------------------------------------------------------------


def _model_rows(spark, d):
    cc = clean.null_outliers(F.col("engine_capacity_cc"), 300, 5000)
    return (
        vehicle(spark, d)
        .withColumn("engine_capacity_cc", cc)
        .join(
            collision(spark, d).select("collision_index", "collision_severity", "speed_limit"), "collision_index"
        )
    )


@add(
    "ols_severity",
    with_roles(
        "SELECT round(regr_slope(y, x), 9) AS slope, round(regr_intercept(y, x), 6) AS intercept FROM (SELECT CASE collision_severity WHEN 'Fatal' THEN 3.0 "
        "WHEN 'Serious' THEN 2.0 ELSE 1.0 END AS y, CASE WHEN engine_capacity_cc BETWEEN 300 AND 5000 THEN CAST(engine_capacity_cc AS DOUBLE) END AS x "
        "FROM vehicle JOIN collision USING (collision_index)) WHERE x IS NOT NULL",
        "vehicle",
        "collision",
    ),
)
def _(spark, d):
    fit = models.simple_regression(_model_rows(spark, d), "engine_capacity_cc")
    return fit.select(F.round("slope", 9).alias("slope"), F.round("intercept", 6).alias("intercept"))


def _cramer_sql():
    """Three-regressor least squares from covariances, by Cramer's rule."""
    x = ("engine_capacity_cc", "age_of_driver", "speed_limit")
    cov = {(a, b): f"covar_pop({a}, {b})" for a in x for b in x}
    entries = ", ".join(f"{cov[a, b]} AS c{i}{j}" for i, a in enumerate(x) for j, b in enumerate(x))
    sides = ", ".join(f"covar_pop({a}, y) AS b{i}, avg({a}) AS m{i}" for i, a in enumerate(x))

    def det(m):
        return (
            f"({m[0][0]} * ({m[1][1]} * {m[2][2]} - {m[1][2]} * {m[2][1]}) - {m[0][1]} * ({m[1][0]} * {m[2][2]} - {m[1][2]} * {m[2][0]}) "
            f"+ {m[0][2]} * ({m[1][0]} * {m[2][1]} - {m[1][1]} * {m[2][0]}))"
        )

    base = [[f"c{i}{j}" for j in range(3)] for i in range(3)]
    betas = []
    for k in range(3):
        swapped = [[f"b{i}" if j == k else base[i][j] for j in range(3)] for i in range(3)]
        betas.append(f"{det(swapped)} / {det(base)} AS beta{k}")
    rows = " UNION ALL ".join(f"SELECT '{a}' AS term, round(beta{k}, 8) AS estimate FROM fit" for k, a in enumerate(x))
    body = (
        ", data AS (SELECT CAST(CASE collision_severity WHEN 'Fatal' THEN 3 WHEN 'Serious' THEN 2 ELSE 1 END AS DOUBLE) AS y, "
        "CAST(engine_capacity_cc AS DOUBLE) AS engine_capacity_cc, CAST(age_of_driver AS DOUBLE) AS age_of_driver, "
        "CAST(speed_limit AS DOUBLE) AS speed_limit FROM vehicle JOIN collision USING (collision_index) WHERE engine_capacity_cc BETWEEN 300 AND 5000), "
        f"m AS (SELECT {entries}, {sides}, avg(y) AS my FROM data), fit AS (SELECT *, {', '.join(betas)} FROM m) "
        f"{rows} UNION ALL SELECT '(Intercept)', round(my - beta0 * m0 - beta1 * m1 - beta2 * m2, 6) FROM fit"
    )
    return with_roles(body, "vehicle", "collision")


@add("linear_severity", _cramer_sql())
def _(spark, d):
    fit = models.linear_severity(_model_rows(spark, d), ["engine_capacity_cc", "age_of_driver", "speed_limit"])
    digits = F.when(F.col("term") == "(Intercept)", F.round("estimate", 6)).otherwise(F.round("estimate", 8))
    return fit.withColumn("estimate", digits)


# with an intercept and no penalty, a converged fit's mean probability is the observed share
@add(
    "multinomial_severity",
    with_roles(
        ", data AS (SELECT collision_severity AS severity FROM vehicle JOIN collision USING (collision_index) "
        "WHERE engine_capacity_cc BETWEEN 300 AND 5000 AND age_of_driver IS NOT NULL AND speed_limit IS NOT NULL), "
        "counted AS (SELECT severity, round(count(*) / CAST((SELECT count(*) FROM data) AS DOUBLE), 4) AS share FROM data GROUP BY 1) "
        "SELECT severity, share, share AS mean_fitted FROM counted",
        "vehicle",
        "collision",
    ),
)
def _(spark, d):
    fit = models.severity_probabilities(_model_rows(spark, d), ["engine_capacity_cc", "age_of_driver", "speed_limit"], iterations=500)
    return fit.select("severity", F.round("share", 4).alias("share"), F.round("mean_fitted", 4).alias("mean_fitted"))
