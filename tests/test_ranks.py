"""Distributed ranks against Spark's own window and percentile functions."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tillview.functions.ranks import exact_percentiles, with_ntiles


def frame(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "id bigint, v bigint")


def expected(df, buckets=5):
    return {r.id: r.b for r in df.select("id", F.ntile(buckets).over(Window.orderBy("v", "id")).alias("b")).collect()}


@pytest.mark.parametrize("size", [1, 3, 4, 5, 6, 11, 203, 5000])
def test_ntile_with_ties(spark, size):
    rng = random.Random(size)
    df = frame(spark, [rng.choice([1, 1, 1, 2, 3, 50, rng.randint(0, 10**6)]) for _ in range(size)])
    got = {r.id: r.b for r in with_ntiles(df, {"b": F.col("v")}, "id").collect()}
    assert got == expected(df)


@pytest.mark.parametrize("hot_share", [0.0, 0.34, 1.0])
def test_ntile_with_brackets_on_many_rows(spark, hot_share):
    df = spark.range(60_000).select(
        "id", F.when(F.rand(7) < hot_share, F.lit(500)).otherwise(F.pmod(F.hash("id"), F.lit(100_000))).cast("bigint").alias("v")
    )
    got = with_ntiles(df, {"b": F.col("v")}, "id")
    check = got.withColumn("want", F.ntile(5).over(Window.orderBy("v", "id")))
    assert check.filter("b <> want").count() == 0
    assert check.count() == 60_000


def test_descending_and_several_keys(spark):
    df = frame(spark, [5, 5, 1, 9, 9, 9, 2, 0, 3, 3, 7])
    got = with_ntiles(df, {"up": F.col("v"), "down": -F.col("v")}, "id", buckets=3)
    want = got.withColumn("u", F.ntile(3).over(Window.orderBy("v", "id"))).withColumn(
        "d", F.ntile(3).over(Window.orderBy(F.col("v").desc(), "id"))
    )
    assert want.filter("u <> up OR d <> down").count() == 0


def test_percentiles(spark):
    df = spark.range(30_000).select((F.pmod(F.hash("id"), F.lit(999_983)) / 7.0).alias("x"), F.lit(3).alias("same"))
    fractions = [0.0, 0.2, 0.25, 0.5, 0.8, 1.0]
    got = exact_percentiles(df, ["x", "same"], fractions)
    want = df.agg(F.percentile("x", F.array(*[F.lit(f) for f in fractions]))).first()[0]
    assert got["x"] == pytest.approx(want, rel=1e-12)
    assert got["same"] == [3.0] * len(fractions)


def test_percentiles_skip_nulls_and_empty_columns(spark):
    df = spark.createDataFrame([(1, None), (None, None), (3, None)], "a bigint, b bigint")
    assert exact_percentiles(df, ["a", "b"], [0.5]) == {"a": [2.0], "b": [None]}
