"""Queries of the boosted projector: a level of its trees with SQL, and its rows in the ladder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import steady
from ..operators import priors
from ..operators.lineage import settled
from ..sources.tables import table
from . import boosting, learned
from . import projectors as P
from .bases import PANEL, customer_lines
from .catalogue import _TESTS, S, _panel, query

_EDGES = {"prev1_points": [100.0, 150.0, 200.0, 250.0, 300.0, 400.0, 500.0], "prev1_games": [1.0, 2.0, 3.0]}
_LEAST, _RIDGE = 30, 5.0


def _bin(column: str) -> str:
    return f"CASE WHEN {column} IS NULL THEN 0 ELSE 1 + " + " + ".join(f"({column} > {e})::INT" for e in _EDGES[column]) + " END"


_LONG = " UNION ALL ".join(f"SELECT fold, {j} AS j, {b} AS bin, g FROM r" for j, b in enumerate([*map(_bin, _EDGES), "coalesce(code, 0)"]))
_VALUE = "-{g} / ({n} + 5.0)".format
_LOSS = "(2 * {g} * {w} + ({n} + 5.0) * {w} * {w})".format


@query(f"""WITH {PANEL}, codes AS (SELECT grp, row_number() OVER (ORDER BY grp) AS code FROM (SELECT DISTINCT grp FROM panel WHERE season < {_TESTS[0]})),
tr AS (SELECT fold, panel.*, code FROM panel LEFT JOIN codes USING (grp), range({_TESTS[0]}, {_TESTS[-1] + 1}) f(fold) WHERE season < fold), r AS (SELECT *, avg(points) OVER (PARTITION BY fold) - points AS g FROM tr),
h AS (SELECT fold, j, bin, sum(g) AS g, count(*) AS n FROM ({_LONG}) GROUP BY ALL), p AS (SELECT *, CASE WHEN bin = 0 THEN '-inf'::DOUBLE WHEN j = 2 THEN g / n ELSE bin END AS place FROM h),
c AS (SELECT *, sum(CASE WHEN bin > 0 THEN g ELSE 0 END) OVER u AS gc, sum(CASE WHEN bin > 0 THEN n ELSE 0 END) OVER u AS nc, sum(CASE WHEN bin = 0 THEN g ELSE 0 END) OVER f AS g0, sum(CASE WHEN bin = 0 THEN n ELSE 0 END) OVER f AS n0, sum(g) OVER f AS gt, sum(n) OVER f AS nt
FROM p WINDOW f AS (PARTITION BY fold, j), u AS (PARTITION BY fold, j ORDER BY place, n, bin ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, gc + CASE WHEN side THEN g0 ELSE 0 END AS gl, nc + CASE WHEN side THEN n0 ELSE 0 END AS nl FROM c, (VALUES (TRUE), (FALSE)) v(side) WHERE bin > 0 AND (n0 > 0 OR side = (2 * nc >= nt))),
w AS (SELECT *, gt - gl AS gr, nt - nl AS nr, {_VALUE(g="gl", n="nl")} AS wl, {_VALUE(g="(gt - gl)", n="(nt - nl)")} AS wr, {_VALUE(g="gt", n="nt")} AS wt FROM s WHERE nl >= {_LEAST} AND nt - nl >= {_LEAST}),
e AS (SELECT *, {_LOSS(g="gt", n="nt", w="wt")} - {_LOSS(g="gl", n="nl", w="wl")} - {_LOSS(g="gr", n="nr", w="wr")} AS gain FROM w),
b AS (SELECT *, row_number() OVER (PARTITION BY fold, j ORDER BY gain DESC, nl DESC, side DESC, bin) AS nth FROM e WHERE gain > 0 AND (j <> 0 OR wl <= wr))
SELECT fold, j AS feature, bin::BIGINT AS last_bin, side AS absent_left, nl::BIGINT AS nl, nr::BIGINT AS nr, {S("wl")} AS wl, {S("wr")} AS wr FROM b WHERE nth = 1""")
def boosted_level(spark, sf):
    """The best split of two numbers and a category at the root of every fold's first tree; more points before never lower a prediction."""
    panel = _panel(spark, sf)
    known = boosting.fit_design(panel.where(F.col("season") < _TESTS[0]), [], ["grp"]).known
    problems = [boosting.Problem(str(t), "points", F.col("season") < t, rising=("prev1_points",)) for t in _TESTS]
    found = boosting.root_splits(panel, boosting.Design(_EDGES, known), problems, _LEAST, _RIDGE)
    whole = lambda c: F.col(c).cast("bigint").alias(c)
    fold = (F.col("k") + _TESTS[0]).cast("bigint").alias("fold")
    return found.select(fold, F.col("j").alias("feature"), F.col("at").cast("bigint").alias("last_bin"), "absent_left", whole("nl"), whole("nr"), steady(F.col("wl")).alias("wl"), steady(F.col("wr")).alias("wr"))


def _learned_panel(spark, sf):
    panel = priors.lag_join(customer_lines(spark, sf), ["entity"], "season", ["games", "points", "opportunities"])
    history = F.col("prev1_games").isNotNull()
    rookie = F.coalesce(*[F.col(f"prev{n}_games") for n in (1, 2, 3)]).isNull()
    return panel.withColumns({"has_history": history, "is_rookie": rookie})


def _settings(rounds: int = 12) -> learned.Learned:
    return learned.Learned([f"prev{n}_{c}" for n in (1, 2) for c in ("games", "points", "opportunities")], rounds=rounds, options={"depth": 2, "rate": 0.3})


@query()
def boosted_ladder(spark, sf):
    """The boosted projector and its blend beside the weighted prior on every fold, with the share of points under each quantile (no SQL form)."""
    panel = settled(_learned_panel(spark, sf))
    gbm = settled(_settings()(panel, _TESTS))  # read by the blend too
    prior = lambda panel, tests: P.weighted_prior(panel, tests, (5.0, 4.0, 3.0))
    ladder = {"weighted_prior": prior, "gbm": lambda *_: gbm, "gbm_blend": lambda panel, tests: P.blend(gbm, prior(panel, tests), 0.35)}
    predicted = P.run_walk_forward(panel, _TESTS, ladder, extra=["pred_q10", "pred_q50", "pred_q90"])
    scored = P.with_coverage(P.score_folds(predicted), predicted)
    rounded = {c: steady(F.col(c)) for c in ("rmse", "mae", "cover_pred_q10", "cover_pred_q50", "cover_pred_q90")}
    return scored.withColumns(rounded)


@query()
def boosted_rookies(spark, sf):
    """First seasons projected by a boosted model of earlier first seasons (no SQL form)."""
    settings = learned.Learned(["acctbal"], rounds=8, options={"depth": 2, "rate": 0.3})
    balance = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.col("c_acctbal").alias("acctbal"))
    out = learned.rookies(settings)(_learned_panel(spark, sf).join(balance, "entity"), _TESTS)
    return out.select("entity", "season", *[steady(F.col(c)).alias(c) for c in ("pred_games", "pred_ppg", "pred_points", "pred_q10", "pred_q50", "pred_q90")])
