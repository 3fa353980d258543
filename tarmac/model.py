"""Record layouts and the fixed vocabularies of the collision data."""

from __future__ import annotations

from pyspark.sql import types as T

_TEXT, _INT, _DBL = T.StringType(), T.IntegerType(), T.DoubleType()

# Severities in descending order with their hotspot weight and
# map colour (red, green, blue, alpha).
SEVERITIES = ("Fatal", "Serious", "Slight")
RISK_WEIGHT = {"Fatal": 3, "Serious": 2, "Slight": 1}
SEVERITY_COLOUR = {"Fatal": (255, 0, 0, 160), "Serious": (255, 165, 0, 160)}
OTHER_COLOUR = (0, 128, 255, 160)

# Casualty filters offered to the user.
CASUALTY_CLASSES = ("Driver or rider", "Passenger", "Pedestrian")
SEXES = ("Male", "Female")
AGE_GROUPS = ("Child", "Young Adult", "Adult", "Senior", "Unknown")

# The collision columns that may be broken down by severity.
FACTORS = (
    "speed_limit",
    "road_type",
    "weather_conditions",
    "light_conditions",
    "road_surface_conditions",
    "junction_detail",
    "urban_or_rural_area",
)

# Hotspot cell sizes as cells per degree.
GRID_SCALES = {
    "50 m": 2225,
    "100 m": 1113,
    "200 m": 556,
    "~0.5 km": 200,
    "~1.1 km": 100,
    "~2.2 km": 50,
    "~5.5 km": 20,
}

# Years kept by the cleaning run.
FIRST_YEAR, LAST_YEAR = 2000, 2024


def _layout(**columns: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(name, kind, True) for name, kind in columns.items()])


# Declared types of the raw columns; anything else in a file is read as text.
RAW_TYPES: dict[str, T.DataType] = {
    "collision_index": _TEXT,
    "collision_year": _INT,
    "collision_reference": _TEXT,
    "date": _TEXT,
    "time": _TEXT,
    "longitude": _DBL,
    "latitude": _DBL,
    "location_easting_osgr": _DBL,
    "location_northing_osgr": _DBL,
    "collision_severity": _INT,
    "number_of_vehicles": _INT,
    "number_of_casualties": _INT,
    "collision_adjusted_severity_serious": _DBL,
    "collision_adjusted_severity_slight": _DBL,
    "day_of_week": _INT,
    "road_type": _INT,
    "first_road_class": _INT,
    "speed_limit": _INT,
    "junction_detail": _INT,
    "light_conditions": _INT,
    "weather_conditions": _INT,
    "road_surface_conditions": _INT,
    "urban_or_rural_area": _INT,
    "vehicle_reference": _INT,
    "vehicle_type": _INT,
    "engine_capacity_cc": _INT,
    "age_of_driver": _INT,
    "age_of_vehicle": _INT,
    "sex_of_driver": _INT,
    "casualty_reference": _INT,
    "casualty_class": _INT,
    "casualty_type": _INT,
    "casualty_severity": _INT,
    "sex_of_casualty": _INT,
    "age_of_casualty": _INT,
    "casualty_adjusted_severity_serious": _DBL,
    "casualty_adjusted_severity_slight": _DBL,
}

# ``ord`` keeps the row order of the source list: duplicate codes are resolved by it.
CODE_MAP = _layout(ord=_INT, table=_TEXT, variable=_TEXT, code=_TEXT, label=_TEXT, note=_TEXT, type=_TEXT)

INSPECTION_DOC = T.StructType(
    [
        T.StructField("registration", _TEXT),
        T.StructField("registrationDate", _TEXT),
        T.StructField("manufactureDate", _TEXT),
        T.StructField("manufactureYear", _TEXT),
        T.StructField(
            "motTests",
            T.ArrayType(
                T.StructType(
                    [
                        T.StructField("completedDate", _TEXT),
                        T.StructField("testResult", _TEXT),
                        T.StructField("expiryDate", _TEXT),
                        T.StructField("odometerValue", _TEXT),
                        T.StructField("odometerUnit", _TEXT),
                        T.StructField(
                            "rfrAndComments",
                            T.ArrayType(T.StructType([T.StructField("type", _TEXT), T.StructField("text", _TEXT)])),
                        ),
                    ]
                )
            ),
        ),
    ]
)
