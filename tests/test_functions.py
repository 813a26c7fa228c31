import datetime as dt

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tideloom.functions import (
    add_date_parts,
    bucket_of,
    conform_to,
    decode_object_key,
    is_later,
    is_on,
    iso_now,
    merge_maps,
    merged_schema,
    option_or,
    prefix_keys,
    present_options,
    sanitize_columns,
)
from tideloom.functions.columns import SchemaConflict

MAP = "map<string,string>"


def only(df):
    return [r[0] for r in df.collect()]


def test_dollar_signs_leave_top_level_names(spark):
    df = spark.createDataFrame([(1, (2,))], "`$a$b` int, s struct<`x$`: int>")
    clean = sanitize_columns(df)
    assert clean.columns == ["ab", "s"]
    assert clean.schema["s"].dataType.names == ["x$"]


@pytest.mark.parametrize("names", [("a$", "a"), ("$", "b"), ("A$", "a")])
def test_colliding_names_are_refused(spark, names):
    df = spark.createDataFrame([(1, 2)], [*names])
    with pytest.raises(SchemaConflict):
        sanitize_columns(df)


def test_flags(spark):
    df = spark.createDataFrame([("True",), ("true",), ("TRUE",), ("False",), ("1",), (None,)], "f string")
    assert only(df.select(is_on("f"))) == [True, True, False, False, False, False]
    assert only(spark.range(1).select(is_on(F.lit(True)))) == [True]


def test_date_parts_of_bad_text_are_null(spark):
    df = spark.createDataFrame([("2024-02-29T01:02:03.5",), ("2024-02-29T01:02:03",), ("junk",), (None,)], "ts string")
    rows = add_date_parts(df, "ts").select("year", "month", "day").collect()
    assert [tuple(r) for r in rows] == [(2024, 2, 29), (2024, 2, 29), (None, None, None), (None, None, None)]


def test_second_map_wins_and_null_counts_as_empty(spark):
    df = spark.createDataFrame(
        [({"a": "1", "b": "1"}, {"b": "2"}), (None, {"c": "3"}), ({"d": "4"}, None), (None, None)], f"x {MAP}, y {MAP}"
    )
    merged = only(df.select(merge_maps(F.col("x"), F.col("y"))))
    assert merged == [{"a": "1", "b": "2"}, {"c": "3"}, {"d": "4"}, {}]


def test_argument_maps(spark):
    df = spark.createDataFrame([({"a": "1", "z": "2"},)], f"m {MAP}")
    m = F.col("m")
    assert only(df.select(prefix_keys(m))) == [{"--a": "1", "--z": "2"}]
    assert only(df.select(present_options(m, ["a", "b"]))) == [{"a": "1"}]
    assert tuple(df.select(option_or(m, "a", "x"), option_or(m, "b", "x"), option_or(m, "b", None)).first()) == (
        "1",
        "x",
        None,
    )


def test_buckets_and_keys(spark):
    df = spark.createDataFrame([("s3://b/k",), ("s3://b",), ("x s3://b/k",), ("s3:///k",), (None,)], "u string")
    assert only(df.select(bucket_of(F.col("u")))) == ["b", None, None, None, None]
    keys = spark.createDataFrame([("a+b%20c",), ("100%",), ("plain",)], "k string")
    assert only(keys.select(decode_object_key(F.col("k")))) == ["a b c", "100%", "plain"]


def test_iso_clock_can_be_given(spark):
    at = dt.datetime(2024, 1, 2, 3, 4, 5)
    assert only(spark.range(1).select(iso_now(at))) == ["2024-01-02T03:04:05"]
    assert dt.datetime.fromisoformat(only(spark.range(1).select(iso_now()))[0])


def test_null_is_the_earliest_ordering_value(spark):
    rows = [(None, 1, None, 1), (1, None, 1, 0), (1, 0, 1, None), (2, 0, 1, 9), (None, 5, 1, 0)]
    df = spark.createDataFrame(rows, "a int, b int, c int, d int")
    later = is_later([F.col("a"), F.col("b")], [F.col("c"), F.col("d")])
    assert only(df.select(later)) == [False, False, True, True, False]


def test_schemas_merge_and_conflicts_are_refused(spark):
    table = T.StructType.fromDDL("a bigint, b string")
    assert merged_schema(table, T.StructType.fromDDL("b string, a int, c date")).names == ["a", "b", "c"]
    with pytest.raises(SchemaConflict):
        merged_schema(table, T.StructType.fromDDL("a string"))
    with pytest.raises(SchemaConflict):
        merged_schema(T.StructType.fromDDL("a int"), T.StructType.fromDDL("a bigint"))
    df = conform_to(spark.createDataFrame([(1,)], "A int"), table)
    assert df.dtypes == [("a", "bigint"), ("b", "string")]
    assert tuple(df.first()) == (1, None)
