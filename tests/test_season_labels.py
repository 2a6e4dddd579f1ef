"""Season labels where a week was played but its label is unknown."""

from pyspark.sql import functions as F

from cutline.plans import blocks


def test_seasons_without_any_label_have_no_mean(spark):
    spine = spark.createDataFrame([(e, 2020, w, played) for e, played in (("unknown", True), ("half", True), ("absent", False)) for w in (1, 2)], "e string, s int, w int, played boolean")
    stats = spark.createDataFrame([("half", 2020, 1, 6.0)], "e string, s int, w int, y double")
    weekly = blocks.weekly_labels(spine, stats, ["e", "s", "w"], ["y"])
    season = blocks.season_labels(weekly, spine, ["e", "s"], ["e", "s", "w"], ["y"], F.lit(2))
    got = {r.e: (r.games, r.y, r.games_rate, r.y_per_game) for r in season.collect()}
    assert got == {"unknown": (2, 0.0, 1.0, None), "half": (2, 6.0, 1.0, 3.0), "absent": (0, 0.0, 0.0, None)}
