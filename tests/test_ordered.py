"""History columns against plain windows, with one hot key and slices of all sizes."""

import random

import pytest
from pyspark.sql import Window, functions as F

from fleetlens.operators.ordered import rolling_lag, with_history


def rows(seed=1, n=600):
    rng = random.Random(seed)
    keys = ["hot"] * 5 + ["a", "b"]
    return [(i, rng.choice(keys), rng.randrange(0, 5000), rng.choice([None, rng.random()])) for i in range(n)]


@pytest.mark.parametrize("width", [1, 70, 10_000])
def test_history(spark, width):
    df = spark.createDataFrame(rows(), "id bigint, key string, at bigint, v double")
    w = Window.partitionBy("key").orderBy("at", "id")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    strictly = w.rowsBetween(Window.unboundedPreceding, -1)
    want = df.select("id", F.lag(F.struct("id", "v")).over(w).alias("p"), F.last("v", True).over(upto).alias("c"),
                     F.last("v", True).over(strictly).alias("b"), F.row_number().over(w).cast("bigint").alias("n"))
    got = with_history(df, ["key"], "at", "id", previous={"p": ["id", "v"]}, carried={"c": "v"}, before={"b": "v"},
                       position="n", width=width).select("id", "p", "c", "b", "n")
    assert sorted(got.collect()) == sorted(want.collect())


@pytest.mark.parametrize("block", [40, 1000])
def test_rolling_lag(spark, block):
    df = spark.createDataFrame(rows(2), "id bigint, key string, at bigint, v double").drop("v")
    w = Window.partitionBy("key").orderBy("at", "id")
    want = df.select("id", F.first("at").over(w.rowsBetween(-30, 0)).alias("since"))
    got = rolling_lag(df, ["key"], "at", "id", "at", 30, "since", "pos", width=100, block=block).select("id", "since")
    assert sorted(got.collect()) == sorted(want.collect())


def exchanges(df):
    plan = df._jdf.queryExecution().executedPlan().toString()
    return [line for line in plan.splitlines() if "Exchange hashpartitioning" in line]


def test_no_row_is_shuffled_by_key_alone(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as for tables beyond the threshold
    try:
        df = spark.createDataFrame(rows(), "id bigint, key string, at bigint, v double")
        out = with_history(df, ["key"], "at", "id", previous={"p": ["v"]}, width=70).select("id", "p")
        found = exchanges(out)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # the rows and what precedes their slice once by (key, slice); the summaries by (key, slice) and by key
    by_key_alone = [line for line in found if "_slice" not in line]
    assert len(by_key_alone) <= 1, found
    assert len(found) == 3, found


def test_rows_without_key_or_time_are_kept(spark):
    data = [(1, None, 5, 1.0), (2, None, 9, 2.0), (3, "a", None, 3.0), (4, "a", 4, None), (5, "a", 400, 5.0), (6, None, None, 6.0)]
    df = spark.createDataFrame(data, "id bigint, key string, at bigint, v double")
    out = with_history(df, ["key"], "at", "id", previous={"p": ["id"]}, carried={"c": "v"}, position="n", width=70)
    got = {r.id: (r.p and r.p.id, r.c, r.n) for r in out.collect()}
    assert got == {1: (None, 1.0, 1), 2: (1, 2.0, 2), 3: (None, None, None), 4: (None, None, 1), 5: (4, 5.0, 2), 6: (None, None, None)}
    lagged = rolling_lag(df, ["key"], "at", "id", "at", 30, "since", "pos", width=100, block=40)
    assert sorted(r.id for r in lagged.collect()) == [1, 2, 3, 4, 5, 6]
