import datetime as dt
import json
import random

from tarmac.operators import inspection

DAY = 24 * 3600


def doc(reg, tests, **more):
    body = {
        "registration": reg,
        "registrationDate": "2015.03.01",
        "manufactureDate": "2014.12.31",
        "motTests": [
            {
                "completedDate": when,
                "testResult": result,
                "expiryDate": "2021.01.01",
                "odometerValue": value,
                **({"odometerUnit": unit} if unit else {}),
                "rfrAndComments": [{"type": c, "text": "t"} for c in comments],
            }
            for when, result, value, unit, comments in tests
        ],
    } | more
    return (json.dumps(body),)


DOCS = [
    doc("ONE", [("2020.01.31 10:00:00", "PASSED", "10000", "mi", [])]),
    doc("BELOW", [("2020.06.29 10:00:00", "PASSED", "20000", "mi", []), ("2020.01.01 10:00:01", "PASSED", "15000", "mi", [])]),
    doc("ABOVE", [("2020.06.29 10:00:00", "PASSED", "20000", "mi", []), ("2020.01.01 10:00:00", "PASSED", "15000", "mi", ["ADVISORY", "MINOR"])]),
    doc("KM", [("2020.06.29 10:00:00", "FAILED", "20000", "km", ["ADVISORY"]), ("2019.06.30 10:00:00", "PASSED", "10000", "mi", [])]),
    doc("NOUNIT", [("2020.06.29 10:00:00", "PASSED", "20000", None, [])], manufactureYear="2013"),
    doc("NONE", []),
    ("not json",),
]


def summary(spark):
    docs = spark.createDataFrame(DOCS, "doc string")
    return {r.registration: r for r in inspection.summarise_documents(inspection.parse_documents(docs)).collect()}


def test_documents(spark):
    got = summary(spark)
    assert (got["ONE"].n_tests, got["ONE"].n_passed, got["ONE"].prev_date) == (1, 1, None)
    # from the registration date and zero
    days = (dt.date(2020, 1, 31) - dt.date(2015, 3, 1)).days
    assert abs(got["ONE"].annual_mileage - 10000 / days * 365.24) < 1e-9
    assert got["BELOW"].prev_date is None  # one second short of 180 days
    assert got["ABOVE"].prev_date == dt.datetime(2020, 1, 1, 10, 0)
    assert abs(got["ABOVE"].annual_mileage - 5000 / 180 * 365.24) < 1e-9
    assert abs(got["ABOVE"].period_years - 180 / 365.24) < 1e-12
    assert got["ABOVE"].n_passed_with_advisory == 1
    assert got["KM"].n_passed == 1 and got["KM"].n_passed_with_advisory == 0
    assert abs(got["KM"].latest_odometer - 20000 * 0.621371) < 1e-9
    assert got["NOUNIT"].latest_odometer is None and got["NOUNIT"].annual_mileage is None and got["NOUNIT"].period_years is None
    assert got["NOUNIT"].manufacture_year == 2013 and got["ONE"].manufacture_year == 2014
    assert got["NONE"].n_tests == 0 and got["NONE"].latest_date is None


def test_long_form_agrees_with_documents(spark):
    docs = spark.createDataFrame(DOCS[:5], "doc string")
    tests = inspection.explode_tests(inspection.parse_documents(docs))
    whole = {r.registration: r for r in inspection.annual_mileage(tests, key="registration").collect()}
    counts = {r.registration: r for r in inspection.count_tests(tests, key="registration").collect()}
    for reg, want in summary(spark).items():
        if reg in whole:
            for name in ("latest_odometer", "latest_date", "prev_odometer", "prev_date", "annual_mileage", "period_years"):
                assert whole[reg][name] == want[name], (reg, name)
            for name in ("n_tests", "n_passed", "n_passed_with_advisory"):
                assert counts[reg][name] == want[name]


def test_vehicle_without_tests_keeps_a_row(spark):
    docs = spark.createDataFrame([DOCS[5]], "doc string")
    tests = inspection.explode_tests(inspection.parse_documents(docs))
    assert tests.count() == 1
    assert inspection.count_tests(tests, key="registration").first().n_tests == 0
    assert inspection.latest_tests(tests, key="registration").first().latest_date is None


def test_asof_matches_brute_force_with_hot_vehicle(spark):
    rng = random.Random(1)
    start = dt.datetime(2020, 1, 1)
    rows = []
    for i in range(3000):
        vehicle = "hot" if i % 3 == 0 else f"v{rng.randint(1, 60)}"
        rows.append((vehicle, start + dt.timedelta(seconds=rng.randint(0, 400 * DAY)), float(i), "mi"))
    df = spark.createDataFrame(
        [(v, None, c, None, o, u) for v, c, o, u in rows],
        "vehicle string, registration_date date, completed timestamp_ntz, expiry date, odometer double, unit string",
    ).selectExpr("*", "'PASSED' AS result")
    got = {r.vehicle: (r.latest_date, r.prev_date, r.prev_odometer) for r in inspection.asof_lookback(df, 30 * DAY).collect()}
    for vehicle in {r[0] for r in rows}:
        mine = sorted((c, o) for v, c, o, _ in rows if v == vehicle)
        old = [m for m in mine if (mine[-1][0] - m[0]).total_seconds() >= 30 * DAY]
        want = (mine[-1][0], *(old[-1] if old else (None, None)))
        assert got[vehicle] == want
