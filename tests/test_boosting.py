"""Boosted trees: planted signals, limits, quantiles, missing values and categories."""

import random

import pytest
from pyspark.sql import functions as F

from cutline.plans import boosting as B
from cutline.plans import learned
from cutline.plans import projectors as P

FAST = {"rounds": 6, "depth": 2, "rate": 0.4, "least": 20}


@pytest.fixture(scope="module")
def table(spark):
    rng = random.Random(1)
    rows = []
    for i in range(2400):
        x, c, z = rng.uniform(0, 10), rng.choice("abcde"), None if rng.random() < 0.3 else rng.random()
        noise = rng.gauss(0, 1)
        rows.append((i % 5, x, c, z, 2 * (x > 5) - (x > 8) + noise, {"a": 5, "b": 0, "c": 5, "d": 0, "e": 1}[c] + noise / 4, 4.0 * (z is None) + noise / 4, noise * (1 + x)))
    return spark.createDataFrame(rows, "season int, x double, c string, z double, bent double, by_set double, by_absence double, wide double").repartition(3).cache()


def test_a_rising_feature_never_lowers_a_prediction(spark, table):
    train = F.col("season") < 4
    problems = [B.Problem("free", "bent", train), B.Problem("risen", "bent", train, rising=("x",))]
    model = B.boosted(table, B.fit_design(table, ["x", "z"], ["c"]), problems, rounds=8, depth=3, rate=0.4, least=20)
    sweep = spark.range(0, 400).select((F.col("id") / 40).alias("x")).crossJoin(table.where("season = 4").select("c", "z").limit(8)).withColumn("row", F.concat_ws("/", "c", "z"))
    out = model.predict(sweep, {"free": "free", "risen": "risen"}).orderBy("row", "x").collect()
    falls = lambda name: sum(a[name] > b[name] + 1e-12 for a, b in zip(out, out[1:]) if a.row == b.row)
    assert falls("risen") == 0 and falls("free") > 0


def test_quantiles_cover_and_adapt(table):
    problems = [B.Problem(f"q{q}", "wide", F.col("season") < 4, quantile=q) for q in (0.1, 0.5, 0.9)]
    model = B.boosted(table, B.fit_design(table, ["x"]), problems, **FAST)
    out = P.ordered_quantiles(model.predict(table.where("season = 4"), {f"p{i}": p.name for i, p in enumerate(problems)}).withColumns({f"p{i}": F.col(f"p{i}") + 100 for i in range(3)}), ["p0", "p1", "p2"])
    cover = out.agg(*[F.avg((F.col("wide") + 100 <= F.col(f"p{i}")).cast("double")) for i in range(3)]).first()
    assert all(abs(a - b) < 0.05 for a, b in zip(cover, (0.1, 0.5, 0.9)))
    width = {r.high: r.w for r in out.groupBy((F.col("x") > 5).alias("high")).agg(F.avg(F.col("p2") - F.col("p0")).alias("w")).collect()}
    assert width[True] > 1.3 * width[False]


def test_names_of_categories_do_not_matter_and_any_set_may_split(table):
    other = table.withColumn("c", F.translate("c", "abcde", "zmaqb"))
    predict = lambda df: B.boosted(df, B.fit_design(df, [], ["c"]), [B.Problem("m", "by_set", F.col("season") < 4)], **FAST)
    first, second = predict(table), predict(other)
    assert len(first.rounds[0][0][0]["left"]) in (2, 3)
    by = lambda m, df: sorted(round(r.p, 9) for r in m.predict(df.where("season = 4"), {"p": "m"}).select("p").collect())
    assert by(first, table) == by(second, other)


def test_absence_and_unseen_categories_go_to_a_side_of_their_own(spark, table):
    model = B.boosted(table, B.fit_design(table, ["z"]), [B.Problem("m", "by_absence", F.lit(True))], rounds=1, depth=1, rate=1.0)
    out = model.predict(spark.createDataFrame([(None,), (0.1,), (0.9,), (float("nan"),)], "z double"), {"p": "m"}).collect()
    assert out[0].p == out[3].p > 3.8 and out[1].p < 0.3 and out[2].p < 0.3
    seen = B.boosted(table, B.fit_design(table, [], ["c"]), [B.Problem("m", "by_set", F.lit(True))], **FAST)
    assert seen.predict(spark.createDataFrame([("new",), (None,)], "c string"), {"p": "m"}).select("p").distinct().count() == 1


def test_trees_do_not_depend_on_partitions(table):
    fit = lambda df: B.boosted(df, B.Design({"x": [1.0, 2.5, 5.0, 8.0]}, {"c": list("abcde")}), [B.Problem("m", "bent", F.lit(True)), B.Problem("q", "wide", F.lit(True), quantile=0.9)], rounds=2, depth=2, settle=1)
    splits = lambda m: [[[(n["j"], n["left"]) for n in t] for t in trees] for trees in m.rounds]
    a, b = fit(table), fit(table.repartition(7).orderBy(F.rand(3)))
    assert splits(a) == splits(b)


def test_rounds_are_chosen_on_held_rows(table):
    rows, held = F.col("season") < 4, F.col("season") == 4
    design = B.fit_design(table, ["x", "z"], ["c"])
    model = B.boosted(table, design, [B.Problem("m", "bent", rows, held=held), B.Problem("few", "bent", rows, held=F.lit(False)), B.Problem("none", "bent", rows)], rounds=5, depth=2, rate=0.9, least=5)
    chosen = B.tuned_rounds(model, table, default=77)
    assert chosen["few"] == chosen["none"] == 77 and 1 <= chosen["m"] <= 5
    error = lambda n: model.used({"m": n}).predict(table.where(held), {"p": "m"}).agg(F.avg((F.col("p") - F.col("bent")) ** 2)).first()[0]
    assert error(chosen["m"]) <= min(map(error, range(1, 6))) + 1e-9


def test_no_rows_and_null_labels(spark, table):
    none = B.boosted(table, B.fit_design(table, ["x"]), [B.Problem("m", "bent", F.lit(False))], rounds=2, depth=1)
    assert none.predict(table.limit(3), {"p": "m"}).select("p").distinct().collect() == [(0.0,)]
    nulls = table.withColumn("bent", F.when(F.col("x") < 5, F.col("bent")))
    model = B.boosted(nulls, B.fit_design(nulls, ["x"]), [B.Problem("m", "bent", F.lit(True))], rounds=1, depth=1)
    assert abs(model.start[0]) < 0.2


def panel(spark):
    rng = random.Random(2)
    rows, skill = [], {e: rng.uniform(1, 9) for e in range(260)}
    for season in range(2015, 2021):
        for e, s in skill.items():
            games = float(rng.randrange(4, 17)) if rng.random() < 0.9 else 0.0
            rows.append((e, season, "ab"[e % 2], games, round(games * s * 1.5 + rng.gauss(0, 3), 3) if games else 0.0, games * s))
    df = spark.createDataFrame(rows, "entity int, season int, grp string, games double, points double, opportunities double")
    from cutline.operators import priors

    out = priors.lag_join(df, ["entity"], "season", ["games", "points", "opportunities"])
    return out.withColumns({"has_history": F.col("prev1_games").isNotNull(), "is_rookie": F.col("prev1_games").isNull()})


def test_the_projector_in_the_ladder(spark):
    base = panel(spark)
    settings = learned.Learned(["prev1_games", "prev1_points"], rounds=10, options={"depth": 2, "rate": 0.3, "least": 15})
    ladder = {"segment_mean": P.segment_means, "gbm": settings, "blend": learned.blended(settings)}
    made = P.run_walk_forward(base, [2019, 2020], ladder, extra=["pred_q10", "pred_q90"]).cache()
    scored = P.with_coverage(P.score_folds(made), made, ["pred_q10", "pred_q90"]).collect()
    rmse = {(r.projector, r.season): r.rmse for r in scored if r.target == "ppg"}
    for season in (2019, 2020):
        assert rmse["gbm", season] < 0.6 * rmse["segment_mean", season]
        assert rmse["blend", season] < 0.6 * rmse["segment_mean", season]
    for r in scored:
        known = r.target == "points" and r.projector != "segment_mean"
        assert (r.cover_pred_q10 is not None) == known
        if known:
            assert r.cover_pred_q10 < 0.3 and r.cover_pred_q90 > 0.75
    assert made.where("projector = 'gbm' AND (pred_q10 > pred_q90 OR pred_q10 < 0)").count() == 0
    assert settings.models["season"].importances("opportunities@2020")[0][0] in ("prior_opportunities", "prior_points", "prev1_points")


def test_opportunities_by_game_follow_the_opponent(spark):
    base = panel(spark).withColumn("team", F.col("entity") % 4)
    plan = spark.createDataFrame([(t, s, w, float((t + w) % 3)) for t in range(4) for s in range(2015, 2021) for w in range(6)], "team int, season int, week int, ease double")

    def expand(rows):
        games = P.expand_to_games(rows, plan, columns=("week", "ease"))
        each = F.try_divide("opportunities", F.nullif("games", F.lit(0.0)))
        return games.withColumn("label", F.when(F.col("games") > 0, each * (0.5 + 0.5 * F.col("ease"))))

    games = learned.Games(expand, "label", ["ease"], rising=["ease"])
    settings = learned.Learned([], games=games, rounds=8, options={"depth": 2, "rate": 0.3, "least": 15})
    out = settings(base, [2020])
    assert out.count() == 260 and out.where("pred_opportunities IS NULL OR pred_points < 0").count() == 0
    model = settings.models["game"]
    one = expand(learned.with_priors(base)).where("season = 2020 AND entity = 1 AND week = 0").limit(1)
    eased = [model.predict(one.withColumn("ease", F.lit(x)), {"p": "opportunities@2020"}).first().p for x in (0.0, 1.0, 2.0)]
    assert eased == sorted(eased) and eased[2] > 1.3 * eased[0]
