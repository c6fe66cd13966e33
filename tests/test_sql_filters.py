"""Filters as SQL text."""

import pytest

from siltstone.functions.predicates import TRUE, col
from siltstone.plans.sql_filters import pushed, register, where
from siltstone.sources.catalog import scratch
from siltstone.sources.metadata import PartitionSpec
from siltstone.sources.schema import Schema

SCHEMA = Schema.of(("ts", "timestamp_ntz"), ("value", "double"), ("user_id", "bigint"), ("event_type", "string"), ("d", "date"))


@pytest.mark.parametrize(
    "text,want",
    [
        ("value > 50.5 AND event_type LIKE 'c%'", col("value") > 50.5),
        ("5 < user_id AND abs(value) > 3", col("user_id") > 5),
        ("user_id IN (1, 2) OR value < -3", (col("user_id") == 1) | (col("user_id") == 2) | (col("value") < -3)),
        ("event_type = 'a' OR upper(event_type) = 'B'", TRUE),
        ("NOT (user_id = 5 OR event_type <> 'x')", ~((col("user_id") == 5) | ~(col("event_type") == "x"))),
        ("user_id BETWEEN 1 AND 3", (col("user_id") >= 1) & (col("user_id") <= 3)),
        ("user_id = 'x'", TRUE),
        ("ts > 'not a time'", TRUE),
        ("value IS NULL", TRUE),
        ("other = 3", TRUE),
        ("user_id = value", TRUE),
        ("user_id = NULL", TRUE),
    ],
)
def test_what_is_pushed(spark, text, want):
    assert pushed(spark, text, SCHEMA) == want


def test_rows_are_those_of_spark(spark):
    df = spark.range(300).selectExpr("timestamp_ntz'2024-01-01' + make_interval(0,0,0,0,cast(id as int)) ts", "if(id % 7 = 0, null, id / 3) value", "id user_id", "concat('k', id % 4) event_type", "date_add(date'2024-01-01', cast(id % 9 as int)) d")
    t = scratch(spark).create("t", SCHEMA, lambda s: PartitionSpec.builder(s).day("ts").build())
    t.append(df)
    for text in ("ts >= '2024-01-05' AND value < 60 AND event_type LIKE '%1'", "NOT (value > 20 AND d > DATE'2024-01-04')", "user_id IN (1, 2, 250) OR value IS NULL", "ts BETWEEN '2024-01-02' AND TIMESTAMP_NTZ'2024-01-03 05:00:00'"):
        assert where(t, text).exceptAll(df.where(text)).count() == 0 and where(t, text).count() == df.where(text).count()
    register(t, "slt_rows", "d = DATE'2024-01-03'")
    assert spark.sql("SELECT count(*) FROM slt_rows").first()[0] == df.where("d = DATE'2024-01-03'").count()
