"""Predictions go through the trees in batches: no tree is an expression that every row interprets, and they equal a plain walk."""

import random

from pyspark.sql import functions as F

from cutline.plans import boosting as B


def walk(model, k, bins):
    total = [model.start[k]]
    for trees in model.rounds:
        n = 1
        for _ in range(model.depth):
            node = trees[k][n - 1]
            n = n if node["j"] < 0 else 2 * n + (bins[node["j"]] not in node["left"])
        total.append(total[-1] + trees[k][n - 1]["v"])
    return total


def test_predictions_are_plain_walks_made_in_batches(spark):
    rng = random.Random(3)
    number = lambda: rng.choice([None, float("nan"), -0.0, 1.0, 2.5, 8.0, float("inf"), rng.uniform(-1, 11)])
    rows = [(i, number(), rng.choice(["a", "b", "new", None]), rng.choice(["m", "q", "unknown", None])) for i in range(300)]
    df = spark.createDataFrame(rows, "i int, x double, c string, which string").repartition(3)
    node = lambda j, left, v: {"j": j, "left": left, "v": v}
    tree = lambda v: [node(0, [0, 1, 2], 0.0), node(1, [1], 0.0), node(-1, [], v), node(-1, [], -v), node(-1, [], 2 * v), *[node(-1, [], 9.0)] * 2]
    design = B.Design({"x": [1.0, 2.5, 8.0]}, {"c": ["a", "b"]})
    rounds = [[tree(0.1 * r + 0.3), tree(-0.7 / (r + 1))] for r in range(4)]
    problems = [B.Problem("m", "y", F.lit(True)), B.Problem("q", "y", F.lit(True), quantile=0.9)]
    model = B.Model(design, problems, [5.0, -2.0], 2, rounds)
    out = model.predict(df, {"m": "m", "own": F.col("which")})
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "lambdafunction" not in plan and "from_json" not in plan and "from_json" not in out._jdf.queryExecution().analyzed().toString()
    assert out.columns == [*df.columns, "m", "own"]
    bins = lambda x, c: [0 if x is None or x != x else 1 + sum(e < x for e in (1.0, 2.5, 8.0)), {"a": 1, "b": 2}.get(c, 0)]
    found = {r.i: r for r in out.collect()}
    assert len(found) == len(rows)
    for i, x, c, which in rows:
        assert abs(found[i].m - walk(model, 0, bins(x, c))[-1]) < 1e-12
        assert found[i].own is None if which not in ("m", "q") else abs(found[i].own - walk(model, "mq".index(which), bins(x, c))[-1]) < 1e-12
    every = df.select("i", "x", "c", B._predicted(model, every=True)(design.bins(), F.array(F.lit(1))).alias("p")).collect()
    assert all(max(abs(a - b) for a, b in zip(r.p, walk(model, 1, bins(r.x, r.c)), strict=True)) < 1e-12 for r in every)
    assert model.predict(df.where("i < 0"), {"m": "m"}).collect() == []


def test_a_model_without_features_or_rounds_predicts_its_start(spark):
    model = B.Model(B.Design(), [B.Problem("m", "y", F.lit(True))], [3.0], 1)
    assert [r.p for r in model.predict(spark.range(2), {"p": "m"}).collect()] == [3.0, 3.0]


def test_passes_leave_out_scores_while_they_are_the_start(spark):
    df = spark.createDataFrame([(i % 3, float(i % 11), float(i)) for i in range(200)], "season int, x double, y double").repartition(3)
    run = B._begin(df, B.Design({"x": [2.0, 5.0, 8.0]}), [B.Problem("a", "y", F.col("season") < 2), B.Problem("b", "y", F.col("season") < 2), B.Problem("q", "y", F.col("season") < 1, quantile=0.5)], 3)
    split = lambda left: {"j": 0, "left": left, "v": 0.0}
    leaf = lambda v: {"j": -1, "left": [], "v": v}
    tree = [split([0, 1, 2]), split([1]), split([3]), leaf(0.0), split([2]), leaf(0.0), leaf(0.0), *[leaf(0.25 * n) for n in range(8)]]
    run.model.rounds.append([tree] * 3)
    assert "scores" not in run.rows(0).columns and "scores" in run.rows(1).columns
    fresh = {tuple(r) for r in run.sums(0, [tree] * 3, 2).collect()}
    run.state = run.scored(0)
    assert fresh and fresh == {tuple(r) for r in run.sums(1, [tree] * 3, 2).collect()}
