"""Joins on equal keys and comparisons: same rows, however they are run."""

import pytest
from pyspark.sql import functions as F

from quern.operators import sql as Q
from quern.plans import heavy


@pytest.fixture
def eager(monkeypatch):
    """Every such join counts as heavy, and few rows of a key fill a place."""
    monkeypatch.setattr(heavy, "LIGHT_PAIRS", 0)
    monkeypatch.setattr(heavy, "PLACE_ROWS", (3, 2))


def _tasks(df):
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_one_heavy_key_is_shared_by_many_tasks(spark):
    df = spark.range(12_000).selectExpr("id div 100000 as k", "id as x")
    out = Q.query(df, "select a.x as a, b.x as b from df a join df b on a.k = b.k and a.x < b.x - 6000")
    at = out.select("a", "b", F.spark_partition_id().alias("p"))
    assert tuple(at.agg(F.count("*"), F.max("a"), F.min("b"), F.count_distinct("p") > 1).first()) == (5999 * 6000 // 2, 5998, 6001, True)


def test_light_joins_stay_as_planned(spark):
    df = spark.range(50).selectExpr("id % 3 as k", "id as x")
    text = "select a.x as a, b.x as b from df a join df b on a.k = b.k and a.x < b.x"
    assert "__lp_at" not in Q.query(df, text)._jdf.queryExecution().toString()


@pytest.mark.parametrize("on", [
    "a.k = b.k and a.x < b.x - 2", "a.k = b.k and b.x <= a.x", "a.k = b.k and a.x > b.x and a.x <= b.x + 3", "b.k = a.k and a.x >= b.y and a.s <> b.s", "a.k = b.k and a.s = b.s and a.x < b.y",
    "a.k = b.k and a.x < b.x and a.k < 2", "a.k = b.k and a.x + b.x < 9", "a.k + 1 = b.k and a.s < b.s", "a.k = b.k and a.x < b.y and (a.s is null or b.s = 'u')", "a.k <=> b.k and a.x < b.x", "a.k = b.k and a.x < b.x - 1000",
])
def test_heavy_joins_have_the_same_rows(spark, rows, eager, monkeypatch, on):
    nan = float("nan")
    data = [(i % 3 if i % 7 else None, [1.0, -0.0, 0.0, nan, None, 4.5, 7.0][i * 5 % 7], float(i % 6) if i % 5 else None, "uvw"[i % 3] if i % 4 else None) for i in range(40)]
    df = spark.createDataFrame([*data, data[1], data[1]], "k int, x double, y double, s string")
    text = f"select a.*, b.x as bx, b.y as by, b.s as bs from df a join df b on {on}"
    got = rows(Q.query(df, text))
    monkeypatch.setattr(heavy, "LIGHT_PAIRS", float("inf"))
    assert repr(got) == repr(rows(Q.query(df, text)))


def test_heavy_joins_below_other_steps(spark, eager, monkeypatch):
    a = spark.range(60).selectExpr("id % 4 as k", "id as x")
    b = spark.range(30).selectExpr("id % 5 as k", "id * 2 as y", "cast(id as string) as name")
    text = "with j as (select df.k, x, y, name from df, o where df.k = o.k and x < y) select k, count(*) as n, max(name) as m, sum(x) over_x from j where y <> 20 group by k having count(*) > 1 order by k desc limit 3"
    got = Q.query(a, text, {"o": b})
    assert "__lp_at" in got._jdf.queryExecution().toString() and got.columns == ["k", "n", "m", "over_x"]
    rows = got.collect()
    monkeypatch.setattr(heavy, "LIGHT_PAIRS", float("inf"))
    assert rows == Q.query(a, text, {"o": b}).collect() and len(rows) == 3


@pytest.mark.parametrize("text", [
    "select a.x, b.x from df a left join df b on a.k = b.k and a.x < b.x", "select x from df a where exists (select 1 from df b where a.k = b.k and a.x < b.x)",
    "select a.x, b.x from (select * from df limit 7) a join df b on a.k = b.k and a.x < b.x", "select a.x, b.x from (select k, x + rand() as x from df) a join df b on a.k = b.k and a.x < b.x",
])
def test_joins_that_may_not_be_split(spark, eager, text):
    df = spark.range(30).selectExpr("id % 3 as k", "cast(id as double) as x")
    assert "__lp_at" not in Q.query(df, text)._jdf.queryExecution().toString()
