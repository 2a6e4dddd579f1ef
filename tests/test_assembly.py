"""Assembly by buckets, file metadata, the rank line, and the commands."""

import math
import random

import pytest
from pyspark.sql import functions as F

from cutline.__main__ import main
from cutline.operators import priors
from cutline.plans import blocks, learned
from cutline.plans import projectors as P
from cutline.sources import buckets, tables


def test_assembly_shuffles_nothing(spark):
    rng = random.Random(1)
    keys = [(e, s, w) for e in range(40) for s in (2020, 2021) for w in range(1, 6)]
    spine = spark.createDataFrame(keys, "entity int, season int, week int").withColumn("at", F.col("season") * 100 + F.col("week"))
    blocks_, want = [], {k: [] for k in keys}
    for b in range(3):
        found = {k: rng.random() for k in keys if rng.random() < 0.7}
        blocks_.append(buckets.store_bucketed(spark.createDataFrame([(*k, v) for k, v in found.items()], f"entity int, season int, week int, x{b} double"), ["entity", "season"], 4, ["week"]))
        for k in keys:
            want[k].append(found.get(k))
    prior = {(e, s): rng.random() for e, s, _ in keys if e % 3}
    blocks_.append(buckets.store_bucketed(spark.createDataFrame([(*k, v) for k, v in prior.items()], "entity int, season int, p double"), ["entity", "season"], 4))
    out = buckets.assemble(buckets.store_bucketed(spine, ["entity", "season"], 4, ["week"]), ["entity"], "season", "week", blocks_, {"p": -1.0})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Exchange" not in plan
    got = {(r.entity, r.season, r.week): ([r.x0, r.x1, r.x2], r.p) for r in out.collect()}
    assert got == {k: (want[k], prior.get(k[:2], -1.0)) for k in keys}


def test_as_of_blocks_on_the_spines_keys(spark):
    spine = spark.createDataFrame([(1, 2020, 3), (1, 2020, 5), (2, 2020, 3)], "entity int, season int, week int")
    features = spark.createDataFrame([(1, 3, "a"), (1, 4, None), (1, 2, "b")], "entity int, week int, x string")
    got = buckets.on_keys(spine, features, ["entity"], "season", "week", ["x"], 2)
    assert sorted((r.entity, r.week, r.x) for r in got.collect()) == [(1, 3, "b"), (1, 5, None), (2, 3, None)]


def test_coverage_comes_from_footers(spark, tmp_path):
    path = str(tmp_path / "t.parquet")
    spark.createDataFrame([(2019, 1.0), (2024, None), (2021, 2.0)], "season int, x double").write.parquet(path)
    assert tables.coverage(spark, {"t": path}, {"t": ["x"]}) == {"t": {"rows": 3, "newest": 2024, "nulls": {"x": 1}}}
    assert tables.last_seasons(spark, {"t": path}) == {"t": 2024}
    before = spark.conf.get("spark.sql.parquet.aggregatePushdown")
    with tables._from_footers(spark):
        plan = tables.footer_counts(spark, path, ["x"], "season")._jdf.queryExecution().executedPlan().toString()
    assert "PushedAggregation: [COUNT" in plan.replace("PushedAggregation: [MAX", "PushedAggregation: [COUNT") and "ReadSchema: struct<season" not in plan
    assert spark.conf.get("spark.sql.parquet.aggregatePushdown") == before


def test_the_rank_line_by_hand(spark):
    rows = [(e, s, "ab"[e % 2], float(4 + e % 9), float(100 - 3 * e + s - 2018), e if e % 5 else None) for e in range(1, 24) for s in (2018, 2019, 2020)]
    rows += [(90, 2020, "c", 3.0, 10.0, 4), (91, 2020, "a", 3.0, 10.0, 0)]
    panel = spark.createDataFrame(rows, "entity int, season int, grp string, games double, points double, rank int")
    got = {(r.entity, r.season): r for r in P.rank_line(panel, [2019, 2020]).collect()}
    for fold in (2019, 2020):
        train = [r for r in rows if r[1] < fold and r[5]]
        mean = sum(r[4] / r[3] for r in train) / len(train)
        for e, s, g, _, _, rank in rows:
            if s != fold:
                continue
            if not rank:
                assert (e, s) not in got
                continue
            own = [(math.log1p(r[5]), r[4] / r[3]) for r in train if r[2] == g]
            if len(own) < 3:
                want = mean
            else:
                mx, my = sum(x for x, _ in own) / len(own), sum(y for _, y in own) / len(own)
                slope = sum((x - mx) * (y - my) for x, y in own) / sum((x - mx) ** 2 for x, _ in own)
                want = my + slope * (math.log1p(rank) - mx)
            assert got[e, s].pred_ppg == pytest.approx(max(want, 0.0))
    assert P.rank_line(panel.withColumn("rank", F.lit(None).cast("int")), [2020]).count() == 0


def test_spine_with_participation_by_another_id(spark):
    rosters = spark.createDataFrame([(1, 1, "ACT", "OAK"), (1, 1, "RES", "SF"), (2, 1, "ACT", "SF"), (None, 1, "ACT", "SF"), (3, 1, "CUT", "SF")], "e int, wk int, status string, team string")
    snaps = spark.createDataFrame([("p1", 1, 20), ("p1", 1, 31), ("p2", 2, 9), ("q", 1, 4)], "pid string, wk int, n int")
    names = spark.createDataFrame([(1, "p1"), (7, "p1"), (2, "p2"), (None, "q"), (3, None)], "e int, pid string")
    out = blocks.weekly_spine(rosters, snaps, names, "e", "pid", ["wk"], F.col("status") != "CUT", "status", "n", "team", {"OAK": "LV"})
    assert sorted((r.e, r.team, r.n, r.played) for r in out.collect()) == [(1, "LV", 31, True), (2, "SF", 0, False)]


def test_an_upcoming_panel_has_no_outcomes(spark):
    actuals = spark.createDataFrame([(1, 2020, 4.0, 8.0), (1, 2018, 2.0, 2.0)], "entity int, season int, games double, points double")
    target = spark.createDataFrame([(1, 2021), (1, 2021), (2, 2021)], "entity int, season int")
    made = {r.entity: r for r in blocks.upcoming_panel(target, actuals, ["entity"], "season", ["points"]).collect()}
    assert made[1].prev1_ppg == 2.0 and made[1].prev3_games == 2.0 and made[1].n_prior_seasons == 2 and not made[1].is_rookie
    assert made[2].is_rookie and not made[2].has_history and not hasattr(made[2], "points")
    with pytest.raises(ValueError, match="no rows"):
        blocks.upcoming_panel(target.limit(0), actuals, ["entity"], "season", ["points"])


def test_commands_assemble_and_project(spark, tmp_path, capsys):
    rng = random.Random(3)
    rows = [(e, s, "ab"[e % 2], float(rng.randrange(1, 16)), 0.0, 0.0) for e in range(120) for s in range(2017, 2021) if e < 100 or s == 2020]
    rows = [(e, s, g, n, 3.0 * n * (1 + e % 7), 2.0 * n * (1 + e % 7)) for e, s, g, n, _, _ in rows]
    actuals = spark.createDataFrame(rows, "entity int, season int, grp string, games double, points double, opportunities double")
    flags = lambda df: df.withColumns({"has_history": F.col("prev1_games").isNotNull(), "is_rookie": F.col("prev1_games").isNull()})
    panel = flags(priors.lag_join(actuals, ["entity"], "season", ["games", "points", "opportunities"]))
    target = spark.createDataFrame([(e, 2021, "ab"[e % 2]) for e in range(125)], "entity int, season int, grp string")
    target = blocks.upcoming_panel(target, actuals.drop("grp"), ["entity"], "season", ["points", "opportunities"])
    panel.write.parquet(str(tmp_path / "panel"))
    target.withColumn("rank", F.when(F.col("entity") == 123, 2)).write.parquet(str(tmp_path / "target"))
    assert main(["project", "--panel", str(tmp_path / "panel"), "--target", str(tmp_path / "target"), "--season", "2021", "--out", str(tmp_path / "board"), "--rounds", "3"]) == 0
    made = spark.read.parquet(str(tmp_path / "board"))
    assert made.count() == 125 and sorted(r["rank"] for r in made.collect()) == list(range(1, 126))
    assert {(r.projection_source, r.is_rookie) for r in made.collect()} == {("gbm", False), ("rookie_gbm", True)}
    best = made.where("NOT is_rookie").groupBy((F.col("entity") % 7).alias("skill")).agg(F.avg("pred_ppg").alias("p")).orderBy("skill").collect()
    assert best[6].p > 1.3 * best[0].p
    with pytest.raises(ValueError, match="no completed seasons"):
        learned.project_season(panel, target, 2000, learned.Learned([]))
    spine = actuals.select("entity", "season").withColumn("week", F.lit(1))
    spine.write.parquet(str(tmp_path / "spine"))
    actuals.select("entity", F.lit(0).alias("week"), F.col("season").alias("s")).dropDuplicates(["entity"]).select("entity", "week", F.lit(5).alias("seen")).write.parquet(str(tmp_path / "asof"))
    actuals.select("entity", "season", "points").write.parquet(str(tmp_path / "on"))
    assert main(["features", "--spine", str(tmp_path / "spine"), "--asof", str(tmp_path / "asof"), "--on", str(tmp_path / "on"), "--out", str(tmp_path / "table"), "--buckets", "4", "--upcoming-season", "2020"]) == 0
    table = spark.read.parquet(str(tmp_path / "table"))
    assert table.count() == 120 and table.where("seen IS NULL OR points IS NULL").count() == 0
    assert "120 rows, 5 columns" in capsys.readouterr().out
