import math

import pytest
from pyspark.sql import functions as F

from cutline.functions.columns import clip, map_value, piecewise_credit, shrink, weight_mass, weighted_sum
from cutline.operators import asof, dedupe, priors, ranks, temporal
from cutline.plans import moments
from cutline.plans import projectors as P
from cutline.sources import tables


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def values(spark, expressions):
    return tuple(spark.range(1).select(*expressions).first())


def test_asof_is_strict_and_carries_whole_rows(spark):
    spine = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 10), (3, 5)], "e int, k int")
    feats = spark.createDataFrame([(1, 9, 5.0, 9.0), (1, 11, 6.0, None), (2, 10, 7.0, 7.0)], "e int, k int, a double, b double")
    assert rows(asof.attach_asof(spine, feats, ["e"], "k", ["a", "b"])) == [(1, 10, 5.0, 9.0), (1, 11, 5.0, 9.0), (1, 12, 6.0, None), (2, 10, None, None), (3, 5, None, None)]


def test_asof_of_two_blocks_in_one_pass(spark):
    spine = spark.createDataFrame([(1, 3)], "e int, k int")
    a = spark.createDataFrame([(1, 1, 1.0), (1, 2, 2.0)], "e int, k int, a double")
    b = spark.createDataFrame([(1, 1, "x"), (1, 3, "y")], "e int, k int, b string")
    assert rows(asof.attach_asof(spine, {"a": (a, ["a"]), "b": (b, ["b"])}, ["e"], "k")) == [(1, 3, 2.0, "x")]


def test_rolling_and_to_date(spark):
    df = spark.createDataFrame([(1, 1, 1, 2.0), (1, 1, 2, None), (1, 1, 3, 4.0), (1, 2, 1, 6.0)], "e int, s int, w int, x double")
    assert [r.x_last2 for r in temporal.trailing_mean(df, ["e"], ["s", "w"], ["x"], [2]).orderBy("s", "w").collect()] == [None, 2.0, 2.0, 4.0]
    assert [r.x_last2 for r in temporal.inclusive_mean(df, ["e"], ["s", "w"], ["x"], [2]).orderBy("s", "w").collect()] == [2.0, 2.0, 4.0, 5.0]
    assert [r.x_std for r in temporal.to_date_mean(df, ["e"], "s", ["w"], ["x"]).orderBy("s", "w").collect()] == [2.0, None, 2.0, 6.0]


def test_placeholder_and_flags(spark):
    df = spark.createDataFrame([(1, 1, 1, "a"), (1, 2, 0, "a"), (1, 3, 0, "b")], "e int, w int, played int, c string")
    up = temporal.with_upcoming(df, ["e"], {"w": 9})
    assert up.where("w = 9").first().played is None and up.count() == 4
    assert [r.m for r in temporal.missed_to_date(df, ["e"], ["w"], "played", "m").orderBy("w").collect()] == [0, 0, 1]
    assert [r.n for r in temporal.changed(df, ["e"], ["w"], "c", "n").orderBy("w").collect()] == [True, False, True]


def test_dedupe_ties(spark):
    df = spark.createDataFrame([(1, "b", 1), (1, "a", 2), (1, "b", 3), (1, "a", 4), (2, None, 1)], "e int, v string, t int")
    assert rows(dedupe.modal_value(df, ["e"], "v")) == [(1, "a")]
    assert rows(dedupe.last_by(df, ["e"], ["t"], ["v"])) == [(1, "a"), (2, None)]
    assert rows(dedupe.keep_first(df, ["e"], [F.col("t").desc()]).select("e", "t")) == [(1, 4), (2, 1)]
    assert rows(dedupe.crosswalk(df, "v", "t")) == [("a", 2), ("b", 1)]


def test_lags_go_by_key_not_position(spark):
    df = spark.createDataFrame([(1, 2000, 1.0), (1, 2002, 3.0), (1, 2003, 4.0)], "e int, s int, x double")
    assert rows(priors.lag_join(df, ["e"], "s", ["x"], [1, 2]).select("s", "prev1_x", "prev2_x")) == [(2000, None, None), (2002, None, 1.0), (2003, 3.0, None)]
    assert rows(priors.next_season(df, "s", ["x"]).select("s", "prev_season_x"))[0] == (2001, 1.0)


def test_ranks_quantiles_and_correlation(spark):
    df = spark.createDataFrame([("g", float(x), float(y)) for x, y in [(1, 2), (2, 2), (2, 3), (4, 1), (5, 9), (6, 9), (7, 8)]] + [("h", 1.0, 1.0), ("h", 1.0, 2.0), ("h", 1.0, 3.0), ("i", 1.0, 2.0)], "g string, x double, y double")
    assert rows(ranks.average_ranks(df.where("g = 'g'"), ["g"], "x", "r").select("r"))[:3] == [(1.0,), (2.5,), (2.5,)]
    assert ranks.nearest_quantiles(df.where("g = 'g'"), ["g"], "x", [0.1, 0.9]).first()[1:] == (2.0, 6.0)
    found = {r.g: r.spearman for r in ranks.spearman(df, ["g"], "x", "y").collect()}
    assert found["h"] is None and found["i"] is None and math.isclose(found["g"], 17.25 / math.sqrt(27.5 * 27), rel_tol=1e-9)


def test_column_null_rules(spark):
    x = F.lit(None).cast("double")
    assert values(spark, [clip(x, 0.0), clip(F.lit(-1.0), 0.0), clip(F.lit(9.0), None, 5.0)]) == (None, 0.0, 5.0)
    assert values(spark, [shrink(F.lit(0.0), F.lit(0.0), F.lit(2.5), 0), shrink(F.lit(10.0), F.lit(2.0), F.lit(1.0), 2)]) == (2.5, 3.0)
    assert values(spark, [weighted_sum([F.lit(1.0), x], [5, 4]), weight_mass([F.lit(1.0), x], [5, 4])]) == (5.0, 5.0)
    assert values(spark, [piecewise_credit(F.lit(float(y))) for y in (-2, 3, 8, 30)]) == (-2.4, 3.0, 6.0, 7.0)
    assert values(spark, [map_value(F.lit(1), {1: 5}), map_value(F.lit(2), {1: 5})]) == (5, 2)


def test_projection_contract(spark):
    df = spark.createDataFrame([(-1.0, 20.0), (2.0, -3.0), (3.0, 4.0)], "r double, g double")
    assert rows(P.finish(df, F.col("r"), F.col("g"), 17.0).select("pred_ppg", "pred_games", "pred_points")) == [(0.0, 17.0, 0.0), (2.0, 0.0, 0.0), (3.0, 4.0, 12.0)]
    assert P.folds(2019, 2025) == [2022, 2023, 2024, 2025]
    panel = spark.createDataFrame([(1, 2019, True), (2, 2021, False)], "e int, season int, has_history boolean")
    sums = moments.before_each_fold(panel.groupBy("season", "e").agg(F.count(F.lit(1)).alias("n")), [2020, 2021], ["e"])
    assert {(r.e, r.fold) for r in sums.collect()} == {(1, 2020), (1, 2021)}
    assert P.cohort(panel, "rookies").count() == 1
    with pytest.raises(ValueError):
        P.cohort(panel, "none")


def test_sources(spark, tmp_path):
    df = spark.createDataFrame([(1, 2019), (1, 2019), (2, 2030)], "id int, season int")
    status = tables.ingest(spark, {"good": lambda: df, "bad": lambda: 1 / 0}, str(tmp_path))
    assert status["good"] == "ok" and status["bad"].startswith("failed: ZeroDivisionError")
    back = spark.read.parquet(str(tmp_path / "good.parquet"))
    assert tables.in_window(back, 2019, 2025).count() == 2
    assert rows(tables.duplicate_keys(back, ["id"])) == [(1, 2)]
    assert tables.optional_csv(spark, str(tmp_path / "none.csv"), "a int") is None
    (tmp_path / "some.csv").write_text("a\n4\n")
    assert tables.optional_csv(spark, str(tmp_path / "some.csv"), "a int").first().a == 4
    assert tables.conform(df, ["id", "other"]).first().other is None
    assert tables.curate(df, ["other", "season"]).columns == ["season"]
    assert tables.empty(spark, "a int, b string").dtypes == [("a", "int"), ("b", "string")]
    assert rows(tables.lost_rows(df, df.where("id = 1"), ["id"])) == [(2,)]
    with pytest.raises(ValueError):
        tables.require_columns(df, ["nope"])


def test_pulls(spark, tmp_path):
    source = spark.createDataFrame([(1, 2011), (1, 2016), (2, 2017)], "id int, season int")
    read = lambda seasons: source.where(F.col("season").isin(seasons))
    path = tables.pull(read, str(tmp_path / "a.parquet"), [2011, 2016, 2017], floor=2012, columns=["season", "id", "none"], schema="id bigint, season int")
    assert rows(spark.read.parquet(path)) == [(1, 2016), (2, 2017)] and spark.read.parquet(path).dtypes[0] == ("id", "bigint")
    with pytest.raises(ValueError):
        tables.pull(read, str(tmp_path / "b.parquet"), [2010], floor=2012)
    paths = tables.pull_types(lambda kind, s: read(s).withColumn("kind", F.lit(kind)), ["x", "y"], str(tmp_path), "t", [2016], floor=2016)
    assert spark.read.parquet(paths["y"]).first().kind == "y"
    assert tables.last_seasons(spark, paths) == {"x": 2016, "y": 2016}
    status = tables.ingest(spark, {"one": lambda: tables.pull(read, str(tmp_path / "c.parquet"), [2016]), "two": lambda: 1 / 0, "three": lambda: source}, str(tmp_path), skip=["three"])
    assert (status["one"], status["three"], tables.exit_code(status)) == ("ok", "skipped", 1)
    assert tables.exit_code({"one": "ok"}) == 0
    assert rows(tables.market_report(source.withColumn("line", F.lit(None).cast("int")), ["line", "id", "gone"])) == [("gone", False, 3), ("id", True, 0), ("line", True, 3)]
    assert tables.console(source.select(F.lit(1.234).alias("x"), "id").limit(1)) == "   x  id\n1.23   1"


def brute_ranks(values):
    return [sum(v < x for v in values) + (sum(v == x for v in values) + 1) / 2 for x in values]


@pytest.mark.parametrize("blocks", [1, 3, 1024])
def test_blocked_ranks_equal_brute_force(spark, blocks):
    import random

    rng = random.Random(blocks)
    data = [(g, rng.choice([rng.gauss(0, 5), float(rng.randrange(4)), 1e12, -7.0]), i) for g in "ab" for i in range(200)] + [("c", 1.0, 0)]
    df = spark.createDataFrame(data + [("a", None, 999)], "g string, x double, i int").repartition(5)
    for down in (False, True):
        found = {(r.g, r.i): r.r for r in ranks.average_ranks(df, ["g"], "x", "r", descending=down, blocks=blocks).collect()}
        for g in "abc":
            own = [(x, i) for h, x, i in data if h == g]
            want = brute_ranks([-x if down else x for x, _ in own])
            assert [found[g, i] for _, i in own] == want
    quantiles = {r.g: (r.q10, r.q50, r.q90) for r in ranks.nearest_quantiles(df, ["g"], "x", [0.1, 0.5, 0.9], blocks=blocks).collect()}
    for g in "abc":
        own = sorted(x for h, x, _ in data if h == g)
        assert quantiles[g] == tuple(own[math.floor((len(own) - 1) * a + 0.5)] for a in (0.1, 0.5, 0.9))
    whole = df.where("x IS NOT NULL").withColumn("k", F.floor("x"))
    placed = {(r.g, r.i): r.nth for r in ranks.numbered(whole, ["g"], ["k", "i"], [F.col("k").desc(), "i"], "nth", descending=["k"], blocks=blocks).collect()}
    for g in "abc":
        own = sorted(((-math.floor(x), i) for h, x, i in data if h == g))
        assert [placed[g, i] for _, i in own] == list(range(1, len(own) + 1))
    assert ranks.average_ranks(df.limit(0), ["g"], "x", "r").count() == 0


def test_ladder_is_fitted_before_its_fold(spark):
    """Later seasons don't move a fold's predictions, and shuffled outcomes leave no skill over the mean."""
    import random

    rng = random.Random(0)
    skill = {e: rng.uniform(1, 9) for e in range(120)}
    years = {(e, s): (float(rng.randrange(1, 17)), skill[e] + rng.gauss(0, 0.5)) for e in skill for s in range(2000, 2007)}
    base = [(e, s, "ab"[e % 2], g, g * r) for (e, s), (g, r) in years.items()]
    frame = spark.createDataFrame(base, "entity int, season int, grp string, games double, points double")
    panel = priors.lag_join(frame, ["entity"], "season", ["games", "points"]).withColumn("has_history", F.col("prev1_games").isNotNull())
    tests = P.folds(2000, 2006)
    key = lambda df: {(r.entity, r.season): r.pred_ppg for r in df.collect()}
    one = key(P.weighted_prior(panel, tests, (5.0, 4.0, 3.0), bucket=F.col("entity") % 3))
    later = panel.withColumn("points", F.when(F.col("season") >= 2005, F.col("points") * 9).otherwise(F.col("points")))
    two = key(P.weighted_prior(later, tests, (5.0, 4.0, 3.0), bucket=F.col("entity") % 3))
    assert all(math.isclose(one[k], two[k], rel_tol=1e-12) for k in one if k[1] <= 2005)
    scored = {(r.projector, r.target): r.rmse for r in P.summarise(P.score_folds(P.run_walk_forward(panel, tests, common=True))).collect()}
    assert scored["weighted_prior", "ppg"] < 0.5 * scored["segment_mean", "ppg"]
    mixed = P.permuted(frame.where("season = 2003"), "entity", "points", "other").collect()
    assert sorted(r.other for r in mixed) == sorted(r.points for r in mixed) and all(r.other != r.points for r in mixed)


def test_grid_ties_and_nothing_to_fit(spark):
    df = spark.createDataFrame([(1.0, 1.0)], "a double, b double")
    grid = [3.0, 1.0, 2.0]
    assert values(spark, [P.best_of(F.array(F.lit(2.0), F.lit(1.0), F.lit(1.0)), grid), P.best_of(F.array(*[F.lit(None).cast("double")] * 3), grid)]) == (1.0, 3.0)
    assert df.agg(P.grid_errors(F.col("a"), F.col("b"), F.lit(0.0), [0.0, 1.0], F.lit(1.0)).alias("e")).first().e == [0.0, 0.25]


def test_season_from_games_blend_and_board(spark):
    games = spark.createDataFrame([(1, 2.0), (1, 4.0), (2, 1.0)], "entity int, game_points double")
    seasons = spark.createDataFrame([(1, 1.0), (2, -3.0), (3, 5.0)], "entity int, pred_games double")
    out = {r.entity: (r.pred_ppg, r.pred_games, r.pred_points) for r in P.season_from_games(games, seasons, ["entity"]).collect()}
    assert out == {1: (3.0, 1.0, 3.0), 2: (0.0, 0.0, 0.0), 3: (0.0, 5.0, 0.0)}
    first = spark.createDataFrame([(1, 1, 2.0, 10.0), (2, 1, 4.0, 10.0)], "entity int, season int, pred_ppg double, pred_games double")
    second = spark.createDataFrame([(1, 1, 4.0, 6.0)], "entity int, season int, pred_ppg double, pred_games double")
    assert rows(P.blend(first, second, 0.5).select("entity", "pred_ppg", "pred_points")) == [(1, 3.0, 24.0), (2, 4.0, 40.0)]
    a = spark.createDataFrame([(1, "x", 5.0)], "entity int, grp string, pred double")
    b = spark.createDataFrame([(1, "x", 9.0), (2, "x", 7.0), (3, "y", 1.0)], "entity int, grp string, pred double")
    assert rows(P.board([a, b], ["entity"], [F.col("pred").desc()]).select("entity", "pred", "rank", "group_rank")) == [(1, 5.0, 2, 2), (2, 7.0, 1, 1), (3, 1.0, 3, 1)]


def test_trees_find_a_planted_signal(spark):
    df = spark.range(600).select((F.col("id") % 7).cast("double").alias("a"), F.when(F.col("id") % 5 > 0, (F.col("id") % 11).cast("double")).alias("b"), F.lit(1.0).alias("c")).withColumn("y", F.col("a") * 3 + F.coalesce("b", F.lit(20.0)))
    model = P.fit_trees(df, ["a", "b", "c"], "y", rounds=30, tune_on=F.col("a") == 3)
    found = P.predict_trees(model, df, ["a", "b", "c"]).agg(F.sqrt(F.avg(F.pow(F.col("pred") - F.col("y"), F.lit(2)))).alias("e"), F.stddev("y").alias("s")).first()
    assert found.e < 0.5 * found.s
    assert {n for n, _ in P.importances(model, ["a", "b", "c"], 2)} == {"a", "b"}


def test_panel_and_blocks(spark):
    from cutline.plans import blocks

    snap = spark.createDataFrame([(1, 2001, 0), (1, 2002, 1), (2, 2002, None)], "entity int, season int, years int")
    outcomes = spark.createDataFrame([(1, 2001, 4.0, 8.0), (2, 2000, 2.0, 2.0)], "entity int, season int, games double, points double")
    out = {(r.entity, r.season): r for r in blocks.panel(snap, outcomes, ["entity"], "season", ["points"], experience=F.col("years")).collect()}
    assert (out[1, 2001].ppg, out[1, 2001].is_rookie, out[1, 2001].has_history, out[1, 2001].n_prior_seasons) == (2.0, True, False, 0)
    assert (out[1, 2002].games, out[1, 2002].points, out[1, 2002].ppg, out[1, 2002].prev1_points, out[1, 2002].has_history) == (0.0, 0.0, None, 8.0, True)
    assert (out[2, 2002].prev2_games, out[2, 2002].has_history, out[2, 2002].is_rookie) == (2.0, False, False)
    roster = spark.createDataFrame([(1, "OAK", "B"), (1, "OAK", "A"), (2, "X", "B"), (None, "X", "B")], "id int, team string, status string")
    spine = blocks.preseason_spine(roster, "id", 2026, F.col("status").isin("A", "B"), "team", {"OAK": "LV"})
    assert rows(spine.select("id", "team", "status", "season", "week", "played")) == [(1, "LV", "A", 2026, 1, False), (2, "X", "B", 2026, 1, False)]
    kinds = [spark.createDataFrame([(1, 1, 2, 0.5)], f"id int, w int, {k}_n int, {k}_share double") for k in "ab"] + [spark.createDataFrame([(1, 2, 4, 1.0)], "id int, w int, c_n int, c_share double")]
    assert rows(blocks.rolled_shares(kinds, "id", ["w"], [2]).select("w", "a_n_last2", "c_share_last2")) == [(1, 2.0, 0.0), (2, 1.0, 0.5)]


def season_panel(spark, seed=1):
    import random

    rng = random.Random(seed)
    skill = {e: rng.uniform(1, 9) for e in range(80)}
    base = [(e, s, "ab"[e % 2], float(g), g * (skill[e] + rng.gauss(0, 0.3))) for e in skill for s in range(2000, 2006) for g in [rng.randrange(1, 17)]]
    frame = spark.createDataFrame(base, "entity int, season int, grp string, games double, points double")
    return priors.lag_join(frame, ["entity"], "season", ["games", "points"]).withColumn("has_history", F.col("prev1_games").isNotNull())


def test_checks_find_what_is_wrong(spark):
    from cutline.plans import checks

    df = spark.createDataFrame([("a", 0.5, 1.0), ("a", 0.5, None), ("b", 0.9, 2.0), ("c", 0.0, 3.0)], "g string, share double, x double")
    assert rows(checks.shares_sum_to_one(df, ["g"], "share").select("g")) == [("b",)]
    assert rows(checks.null_rate_above(df, ["g"], "x").select("g")) == [("a",)]
    assert rows(checks.means_outside(df, {"share": (0, 1), "x": (5, 9)}).select("column")) == [("x",)]
    assert checks.forbidden_columns(df, ["x"], ["sh"]) == ["share", "x"]
    panel = season_panel(spark)
    bad = panel.withColumn("prev1_points", F.when((F.col("entity") == 3) & (F.col("season") == 2002), 0.0).otherwise(F.col("prev1_points")))
    assert checks.lag_mismatch(panel, ["entity"], "season", "points").count() == 0 and checks.lag_mismatch(bad, ["entity"], "season", "points").count() == 1
    assert checks.differs(panel, bad, ["entity", "season"], "prev1_points").count() == 1
    made = P.weighted_prior(panel, P.folds(2000, 2005), (1.0, 0.0, 0.0))
    assert checks.broken_predictions(made).count() == 0 and checks.broken_predictions(made.withColumn("pred_games", F.lit(18.0))).count() == made.count()
    assert checks.not_narrower(made.withColumn("raw", F.col("pred_ppg") * 2), "raw", "pred_ppg").count() == 0 and checks.not_narrower(made.withColumn("raw", F.col("pred_ppg") / 2), "raw", "pred_ppg").count() == 1
    flags = spark.createDataFrame([(True, True, 0), (True, False, 1), (False, True, 2)], "is_rookie boolean, has_history boolean, years int")
    assert checks.wrong_flags(flags, F.col("years") == 0).count() == 2
    assert checks.coverage_gap(df, df.where("x IS NOT NULL"), "x").count() == 1 and checks.changed_row_count(df, df.limit(2)).count() == 1
    spine = spark.createDataFrame([(1, 3), (1, 4)], "e int, k int")
    feats = spark.createDataFrame([(1, 3, 3), (1, 2, 2)], "e int, k int, src int")
    assert checks.asof_not_strict(asof.attach_asof(spine, feats, ["e"], "k", ["src"]), "k", "src").count() == 0


def test_command_line(spark, tmp_path, capsys):
    from cutline.__main__ import main

    season_panel(spark).write.parquet(str(tmp_path / "panel.parquet"))
    assert main(["score", "--panel", str(tmp_path / "panel.parquet"), "--out", str(tmp_path / "p.parquet"), "--common", "--check"]) == 0
    assert "weighted_prior" in capsys.readouterr().out
    assert main(["board", str(tmp_path / "p.parquet"), "--out", str(tmp_path / "b.parquet"), "--rows", "3"]) == 0
    assert main(["ingest", "--raw", str(tmp_path), "--out", str(tmp_path / "o"), "--tables", "panel", "none", "--seasons", "2003"]) == 1
    assert {r.season for r in spark.read.parquet(str(tmp_path / "o/panel.parquet")).collect()} == {2003}


def test_labels_table_and_priors(spark):
    from cutline.plans import blocks

    spine = spark.createDataFrame([(1, 2020, 1, True), (1, 2020, 2, True), (1, 2020, 3, False)], "e int, s int, w int, played boolean")
    stats = spark.createDataFrame([(1, 2020, 1, 5.0)], "e int, s int, w int, y double")
    weekly = blocks.weekly_labels(spine, stats, ["e", "s", "w"], ["y"])
    assert rows(weekly.select("w", "y")) == [(1, 5.0), (2, None), (3, 0.0)]
    season = blocks.season_labels(weekly, spine, ["e", "s"], ["e", "s", "w"], ["y"], F.lit(16)).first()
    assert (season.games, season.y, season.games_rate, season.y_per_game) == (2, 5.0, 2 / 16, 2.5)
    nobody = blocks.season_labels(weekly, spine.withColumn("played", F.lit(False)), ["e", "s"], ["e", "s", "w"], ["y"], F.lit(16)).first()
    assert (nobody.games, nobody.y_per_game) == (0, None)
    people = spark.createDataFrame([(1, "2000-09-01", 2), (2, "no", 0)], "e int, born string, exp int")
    people = people.withColumn("born", F.try_to_date("born"))
    picks = spark.createDataFrame([(1, 9, 1), (1, 7, 2)], "e int, pick int, round int")
    found = {r.e: r for r in blocks.prior_features(people, picks, "e", "born", F.lit("2020-09-01").cast("date"), "exp", "pick", "round").collect()}
    assert (found[1].pick, found[1].is_undrafted, round(found[1].age_years)) == (7, False, 20) and (found[2].pick, found[2].round, found[2].is_undrafted, found[2].age_years) == (300, 8, True, None)
    assert rows(blocks.availability(spine, ["e"], "s", F.lit(16)).select("s", "prev_season_games", "prev_season_roster_weeks")) == [(2021, 2, 3)]
    feats = spark.createDataFrame([(1, 1, 3.0), (1, 2, 4.0)], "e int, w int, f double")
    table = blocks.feature_table(spine, ["e"], "w", "s", {"f": (feats, ["f"])}, [feats.withColumnRenamed("f", "now")], [spark.createDataFrame([(1, 2020, "x")], "e int, s int, prior string")], {"now": -1.0})
    assert rows(table.select("w", "f", "now", "prior")) == [(1, None, 3.0, "x"), (2, 3.0, 4.0, "x"), (3, 4.0, -1.0, "x")]
    archive = spark.createDataFrame([(1, 1, 5.0), (1, 3, 6.0), (1, 9, 7.0)], "e int, t int, ecr double")
    assert blocks.attach_snapshot(spine.limit(1), archive, ["e"], "t", F.lit(5), ["ecr"]).first().ecr == 6.0


def test_design_and_stages(spark):
    df = spark.createDataFrame([(1, "b", 2.0, True, 9.0), (2, "a", 3.0, False, 8.0), (3, None, None, None, 7.0)], "id int, team string, x double, flag boolean, actual_points double")
    assert P.design(df, ["id"], ["actual_"]) == (["x", "flag"], ["team"])
    new = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "team string")
    assert [r.team_code for r in P.with_codes(new, df, ["team"]).orderBy(F.col("team").asc_nulls_last()).collect()] == [0.0, 1.0, None, None]
    with pytest.raises(ValueError):
        P.with_codes(new, df, ["team"], most=1)
    panel = spark.createDataFrame([(1, 2.0, 8.0, None, None, None, None), (2, None, None, None, None, None, None)], "e int, prev1_games double, prev1_points double, prev2_games double, prev2_points double, prev3_games double, prev3_points double")
    assert rows(P.engineered_priors(panel).select("e", "prior_games_weighted", "prior_ppg", "prior_games_total")) == [(1, 10.0, 4.0, 2.0), (2, 0.0, None, 0.0)]
    teams = spark.createDataFrame([(1, "A", 2020), (2, "B", 2020)], "e int, team string, season int")
    games = spark.createDataFrame([("A", 2020, 1, "B"), ("A", 2020, 2, "C")], "team string, season int, week int, opponent string")
    assert rows(P.expand_to_games(teams, games).select("e", "week", "opponent")) == [(1, 1, "B"), (1, 2, "C")]
    crossing = spark.createDataFrame([(3.0, 1.0, -2.0)], "q10 double, q50 double, q90 double")
    assert rows(P.ordered_quantiles(crossing, ["q10", "q50", "q90"])) == [(0.0, 1.0, 3.0)]
    data = spark.range(400).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 3).cast("double").alias("b")).withColumns({"games": F.col("a"), "carries": F.col("b") * 2})
    out = P.predict_stages(P.fit_stages(data, {"games": ["a"], "carries": ["b"]}, 10), data)
    assert out.where("abs(pred_games - games) > 1 OR abs(pred_carries - carries) > 1").count() < 40
    rookies = season_panel(spark).withColumn("is_rookie", F.col("prev1_games").isNull())
    assert P.rookies_only(P.segment_means)(rookies, [2003]).where("NOT is_rookie").count() == 0


def test_participation_stream_equals_batch(spark, tmp_path):
    from cutline.streaming.participation import participation

    events = spark.sql("SELECT timestamp '2024-01-01 10:00:00' + make_interval(0,0,0,0,id) AS ts, id % 3 AS user_id, double(id) AS value FROM range(60)")
    events.write.parquet(str(tmp_path / "in"))
    stream = participation(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("p").outputMode("update").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start().awaitTermination()
    assert rows(spark.table("p")) == rows(participation(events))
