"""Large entities cut by time, and blocks of values by sketched splitters, against plain windows."""

import random

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from cutline.operators import asof, ranks, temporal
from cutline.operators.slices import place, sliced


@pytest.fixture(scope="module")
def history(spark):
    """One entity with nine tenths of the rows, a null entity, short ones, nulls among the values."""
    rng = random.Random(4)
    rows = [(1, 2000 + t // 365, t, rng.choice([None, *range(9)]), rng.randrange(2), rng.choice("xy")) for t in range(1800)]
    rows += [(e, 2000, t, rng.randrange(9), rng.randrange(2), rng.choice("xyz")) for e in (2, 3, None) for t in range(0, 120, 2)]
    return spark.createDataFrame(rows, "e int, season int, t int, v int, played int, c string").repartition(5)


def same(a, b):
    assert a.columns == b.columns
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_a_large_entity_is_cut_evenly(history):
    cut = sliced(history, ["e"], "t", 200, pieces=16)
    counts = {r["__slice"]: r["count"] for r in cut.where("e = 1").groupBy("__slice").count().collect()}
    assert len(counts) == 16 and max(counts.values()) <= 2 * 1800 / 16
    assert {r["__slice"] for r in cut.where("e <> 1 OR e IS NULL").collect()} == {-1}


@pytest.mark.parametrize("most", [30, 200, 10_000])
def test_windows_over_slices_equal_plain_ones(history, most):
    by, order = ["e"], ["t"]
    same(temporal.trailing_mean(history, by, order, ["v"], [3, 8], most=most), temporal.trailing_mean(history, by, order, ["v"], [3, 8]))
    same(temporal.inclusive_mean(history, by, order, ["v"], [1, 5], most=most), temporal.inclusive_mean(history, by, order, ["v"], [1, 5]))
    same(temporal.to_date_mean(history, by, "season", order, ["v"], most=most), temporal.to_date_mean(history, by, "season", order, ["v"]))
    same(temporal.missed_to_date(history, by, order, "played", "missed", most=most), temporal.missed_to_date(history, by, order, "played", "missed"))
    same(temporal.changed(history, by, order, "c", "is_new", most=most), temporal.changed(history, by, order, "c", "is_new"))


@pytest.mark.parametrize("most", [30, 10_000])
def test_asof_over_slices_equals_the_plain_one(history, most):
    spine = history.select("e", F.col("t").alias("at"), "played").where("played = 1")
    some = {"a": (history.where("t % 7 = 0").select("e", F.col("t").alias("at"), "v"), ["v"]), "b": (history.where("t < 400 AND t % 5 = 0").select("e", F.col("t").alias("at"), "c"), ["c"])}
    same(asof.attach_asof(spine, some, ["e"], "at", most=most), asof.attach_asof(spine, some, ["e"], "at"))


def test_newest_snapshots(spark):
    archive = spark.createDataFrame([(1, 3, "a"), (1, 3, "b"), (1, 2, "c"), (1, 9, "d"), (2, 5, "e"), (None, 1, "f"), (None, 2, "g"), (3, None, "h")], "e int, at int, x string")
    assert sorted(r.x for r in asof.latest_before(archive, ["e"], "at", F.lit(6)).collect()) == ["a", "b", "e", "g"]


def test_splitters_follow_the_rows_not_the_range(spark):
    df = spark.range(0, 20_000, 1, 4).select((F.rand(1)).alias("x"), F.lit("g").alias("g")).unionByName(spark.createDataFrame([(1e12, "g")], "x double, g string"))
    blocks = [r["count"] for r in ranks._spread(df, ["g"], "x", 64).groupBy("__block").count().collect()]
    assert len(blocks) >= 60 and max(blocks) <= 2 * 20_001 / 64
    got = ranks.average_ranks(df, ["g"], "x", "r").agg(F.count("*"), F.sum("r")).first()
    assert got[0] == 20_001 and got[1] == 20_001 * 20_002 / 2


def test_place_by_bisection(spark):
    xs = [None, -5, 0, 1, 2, 3, 4, 100]
    df = spark.createDataFrame([(x, [0, 2, 3]) for x in xs] + [(1, []), (1, None)], "x int, ends array<int>")
    want = [0, 0, 0, 1, 1, 2, 3, 3, 0, 0]
    assert [r.p for r in df.select(place(F.col("x"), F.col("ends"), 4).alias("p")).collect()] == want


def test_every_row_has_its_rank(spark):
    df = spark.range(0, 5_000, 1, 7).select((F.col("id") * 7919 % 5_003).alias("x"), "id")
    got = ranks.overall_rank(df, [F.col("x").desc(), "id"], "rank")
    want = df.withColumn("rank", F.row_number().over(Window.orderBy(F.col("x").desc(), "id")).cast("bigint"))
    same(got, want)
    assert ranks.overall_rank(df, ["x", "id"], "rank", most=10).count() == 10
    assert ranks.overall_rank(df.limit(0), ["x"], "rank").count() == 0
