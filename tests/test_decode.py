import pytest
from pyspark.sql import functions as F

from tarmac.model import CODE_MAP
from tarmac.operators import decode

ROWS = [
    (1, "collision", "road", "1", "One way", None, None),
    (2, "collision", "road", "2", "Dual (old)", None, None),
    (3, "collision", "road", "2", "Dual", None, None),
    (4, "collision", "road", "-1", "Missing", None, None),
    (5, "vehicle", "road", "3", "From vehicle", None, None),
    (6, "collision", "road", None, "No code", None, None),
    (7, "collision", "age", "99", "Very old", None, None),
    (8, "collision", "age", "98", "77", None, None),
    (9, "collision", "road", "4.9", "Truncated", None, None),
    (10, "collision", "road", "x", "Text code", None, None),
]


def frame(spark):
    return spark.createDataFrame(
        [(1, 99, "1", 1.0), (2, 98, "02", 2.5), (3, 5, "x", None), (-1, None, None, 3.0), (4, 0, "4.9", 4.9)],
        "road int, age int, text string, ratio double",
    )


def test_label_mode(spark):
    codes = spark.createDataFrame(ROWS, CODE_MAP)
    got = decode.decode_labels(frame(spark), codes, "collision", ["road", "age"]).collect()
    # the last duplicate wins, other tables' codes do not count, whole columns truncate codes
    assert [r.road for r in got] == ["One way", "Dual", "3", "Missing", "Truncated"]
    assert [r.age for r in got] == ["Very old", "77", "5", None, "0"]
    # untouched columns keep their type
    assert dict(decode.decode_labels(frame(spark), codes, "collision", ["road"]).dtypes)["age"] == "int"


def test_label_mode_on_text_and_fractions(spark):
    rows = [
        (1, "t", "text", "1", "Code one", None, None),
        (2, "t", "text", "2", "Code two", None, None),
        (3, "t", "ratio", "2.50", "Two and a half", None, None),
    ]
    codes = spark.createDataFrame(rows, CODE_MAP)
    got = decode.decode_labels(frame(spark), codes, "t", ["text", "ratio"]).collect()
    # text compares as text: "02" is not "2"
    assert [r.text for r in got] == ["Code one", "02", "x", None, "4.9"]
    assert [r.ratio for r in got] == ["1.0", "Two and a half", None, "3.0", "4.9"]


def test_typed_mode(spark):
    codes = spark.createDataFrame(ROWS, CODE_MAP)
    out = decode.decode_typed(frame(spark), codes, ["road", "age"])
    assert dict(out.dtypes)["road"] == "int" and dict(out.dtypes)["age"] == "int"
    got = out.collect()
    # labels cannot be integers, so matched codes become missing; 3 matches another table's code
    assert [r.road for r in got] == [None, None, None, None, 4]
    assert [r.age for r in got] == [None, 77, 5, None, 0]


def test_codes_of(spark):
    assert decode.codes_of(spark.createDataFrame(ROWS, CODE_MAP), "collision") == ["age", "road"]


def test_decoding_many_columns_does_not_move_the_facts(spark):
    """An inline code map, broadcasts switched off: no exchange of the facts, and odd codes survive."""
    columns = [f"c{i}" for i in range(30)]
    codes = spark.createDataFrame(
        [(i, "facts", c, str(i % 4), f"label {i}", None, None) for i, c in enumerate(columns)] + [(99, "facts", "c0", "NaN", "none", None, None), (100, "facts", "c1", "1e30", "huge", None, None)],
        CODE_MAP,
    )
    facts = spark.range(50).select("id", *[(F.col("id") % 5).cast("int").alias(c) for c in columns])
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        for decoded in (decode.decode_labels(facts, codes, "facts"), decode.decode_typed(facts, codes, columns)):
            plan = decoded._jdf.queryExecution().executedPlan().toString()
            assert "Join" not in plan.split("Subquery")[0] and "hashpartitioning(id" not in plan
            assert decoded.count() == 50
        labelled = decode.decode_labels(facts, codes, "facts").where("id = 3").first()
        assert labelled.c3 == "label 3" and labelled.c2 == "3" and labelled.c7 == "label 7"
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_a_large_code_map_is_joined(spark, monkeypatch):
    codes = spark.createDataFrame(ROWS, CODE_MAP)
    want = decode.decode_labels(frame(spark), codes, "collision", ["road", "age"]).collect()
    typed = decode.decode_typed(frame(spark), codes, ["road", "age"]).collect()
    assert sorted(map(str, decode.decode_labels(frame(spark), codes, "collision", ["road", "age"], joined=True).collect())) == sorted(map(str, want))
    assert sorted(map(str, decode.decode_typed(frame(spark), codes, ["road", "age"], joined=True).collect())) == sorted(map(str, typed))
    # no count beforehand: the query itself stops
    monkeypatch.setattr(decode, "IN_ONE_ROW", 3)
    with pytest.raises(Exception, match="joined=True"):
        decode.decode_typed(frame(spark), codes, ["road", "age"]).collect()
