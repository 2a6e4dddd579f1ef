"""Sums of a tree level: equal to plain ones, and no row of the table is multiplied for them."""

import random
from collections import defaultdict

from pyspark.sql import functions as F

from cutline.plans import boosting as B


def test_level_sums_are_plain_sums_and_no_row_is_exploded(spark):
    rng = random.Random(2)
    rows = [(i % 4, None if rng.random() < 0.2 else rng.uniform(0, 10), rng.choice(["a", "b", None]), None if rng.random() < 0.1 else rng.gauss(0, 3)) for i in range(600)]
    df = spark.createDataFrame(rows, "season int, x double, c string, y double").repartition(3)
    design = B.Design({"x": [2.0, 5.0, 8.0]}, {"c": ["a", "b"]})
    run = B._begin(df, design, [B.Problem("mean", "y", F.col("season") < 2), B.Problem("q", "y", F.col("season") < 3, quantile=0.9)], 2)
    split = {"j": 0, "left": [0, 1], "v": 0.0}
    still = {"j": -1, "left": [], "v": 0.5}
    run.model.rounds.append([[split, still, {**still, "v": -0.5}, *[still] * 4]] * 2)
    sums = run.sums(0, [[split, *[still] * 6]] * 2, 1)
    plan = sums._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "Explode" not in plan
    want = defaultdict(lambda: [0, 0])
    for season, x, c, y in rows:
        bins = [0 if x is None else 1 + sum(e < x for e in (2.0, 5.0, 8.0)), {"a": 1, "b": 2, None: 0}[c]]
        left = bins[0] in (0, 1)
        for k in range(2):
            if y is not None and season < 2 + k:
                gap = run.model.start[k] + (0.5 if left else -0.5) - y
                gradient = gap if k == 0 else (-0.9 if gap < 0 else 1 - 0.9)
                for j, b in enumerate(bins):
                    cell = want[k, 2 if left else 3, j, b]
                    cell[0] += int(abs(gradient / run.units[k]) + 0.5) * (1 if gradient > 0 else -1)
                    cell[1] += 1
    assert {(r.k, r.node, r.j, r.bin): [r.g, r.n] for r in sums.collect()} == dict(want)
    before = {r.k: r.s for r in run.state.select(F.explode("uses").alias("k"), "scores").groupBy("k").agg(F.sum(F.get("scores", F.col("k"))).alias("s")).collect()}
    after = {r.k: r.s for r in run.scored(0).select(F.explode("uses").alias("k"), "scores").groupBy("k").agg(F.sum(F.get("scores", F.col("k"))).alias("s")).collect()}
    moved = {k: sum((1 if n == 2 else -1) * 0.5 * v[1] for (p, n, j, _), v in want.items() if p == k and j == 0) for k in range(2)}
    assert all(abs(after[k] - before[k] - moved[k]) < 1e-6 for k in range(2))
