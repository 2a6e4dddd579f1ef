"""Queries of the assembly by buckets, the game script, the rank line and boards' checks, with their SQL."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from ..functions.columns import steady
from ..operators import temporal
from ..sources import buckets
from ..sources.tables import table
from . import blocks
from . import projectors as P
from .bases import CM, PANEL, customer_month, period
from .catalogue import _SPINE, _TESTS, S, _panel, query

_BUCKETS = 8


@query(f"""WITH {CM}, {_SPINE}, f AS (SELECT cust, wk, avg(spend) OVER w AS a, avg(n) OVER w AS b FROM cm WINDOW w AS (PARTITION BY cust ORDER BY wk ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)),
y AS (SELECT cust, yr + 1 AS yr, avg(n) AS n FROM cm GROUP BY ALL), e AS (SELECT cust, wk, n FROM cm)
SELECT s.cust, s.wk // 100 AS yr, s.wk, {S("a")} AS spend_last3, {S("b")} AS n_last3, {S("y.n")} AS prev_season_n, coalesce(e.n, 0) AS n_now
FROM spine s ASOF LEFT JOIN f ON s.cust = f.cust AND s.wk > f.wk LEFT JOIN y ON y.cust = s.cust AND y.yr = s.wk // 100 LEFT JOIN e ON e.cust = s.cust AND e.wk = s.wk""")
def bucketed_assembly(spark, sf):
    """Blocks and spine stored by (entity, season) and joined bucket by bucket: an as-of block on the spine's keys, a block of the season before, one of the very period."""
    months = customer_month(spark, sf)
    weeks = F.explode(F.sequence(F.lit(199801).cast("bigint"), F.lit(199812).cast("bigint"))).alias("wk")
    spine = table(spark, sf, "customer").select(F.col("c_custkey").alias("cust"), F.lit(1998).cast("bigint").alias("yr"), weeks)
    rolled = temporal.inclusive_mean(months, ["cust"], ["wk"], ["spend", "n"], [3]).drop("yr")
    prior = months.groupBy("cust", (F.col("yr") + 1).alias("yr")).agg(F.avg("n").alias("prev_season_n"))
    now = months.select("cust", "yr", "wk", F.col("n").alias("n_now"))
    stored = [
        buckets.on_keys(spine, rolled, ["cust"], "yr", "wk", ["spend_last3", "n_last3"], _BUCKETS),
        buckets.store_bucketed(prior, ["cust", "yr"], _BUCKETS),
        buckets.store_bucketed(now, ["cust", "yr"], _BUCKETS, ["wk"]),
    ]
    out = buckets.assemble(buckets.store_bucketed(spine, ["cust", "yr"], _BUCKETS, ["wk"]), ["cust"], "yr", "wk", stored, {"n_now": 0})
    return out.withColumns({c: steady(F.col(c)) for c in ("spend_last3", "n_last3", "prev_season_n")})


_KINDS = {"new": "l_returnflag = 'N'", "back": "l_returnflag IN ('A', 'R')"}
_SCRIPT = {"mean_difference": "avg(d)", "share_behind": "avg((d <= -15)::INT)", "share_ahead": "avg((d >= 15)::INT)", "share_close": "avg((d > -15 AND d < 15)::INT)"}


def _kind_sql(name: str) -> str:
    return f"{name} AS (SELECT l_suppkey AS supp, wk, " + ", ".join(f"{x} AS {name}_{c}" for c, x in _SCRIPT.items()) + f" FROM l WHERE {_KINDS[name]} GROUP BY ALL)"


@query(
    f"WITH l AS (SELECT *, (year(l_shipdate) * 100 + month(l_shipdate))::BIGINT AS wk, l_quantity - 25 AS d FROM lineitem), {_kind_sql('new')}, {_kind_sql('back')}, u AS (SELECT * FROM new FULL JOIN back USING (supp, wk)) SELECT supp, wk, "
    + ", ".join(f"{S(f'avg({k}_{c}) OVER (PARTITION BY supp ORDER BY wk ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)')} AS {k}_{c}_last{n}" for k in _KINDS for c in _SCRIPT for n in (3, 5))
    + " FROM u"
)
def game_script_rolled(spark, sf):
    """Shares of lines far below, far above and near the usual quantity, of lines sold and returned, rolled over a supplier's months."""
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_returnflag", "l_quantity", *period("l_shipdate"))
    kinds = {k: (F.expr(x), "l_suppkey") for k, x in _KINDS.items()}
    out = blocks.game_script(lines, ["wk"], kinds, F.col("l_quantity") - 25, 15, "supp", (3, 5))
    return out.select("supp", "wk", *[steady(F.col(c)).alias(c) for c in out.columns if c not in ("supp", "wk")])


_RANKED = f"{PANEL}, m AS (SELECT *, CASE WHEN prev1_points IS NOT NULL THEN row_number() OVER (PARTITION BY grp, season ORDER BY prev1_points DESC NULLS LAST, entity) END AS rank FROM panel)"


@query(f"""WITH {_RANKED}, tr AS (SELECT fold, m.*, ln(1 + rank) AS x FROM m, range({_TESTS[0]}, {_TESTS[-1] + 1}) f(fold) WHERE season < fold AND rank IS NOT NULL),
c AS (SELECT fold, grp, regr_slope(points / games, x) AS rs, regr_intercept(points / games, x) AS ri, regr_slope(games, x) AS gs, regr_intercept(games, x) AS gi FROM tr GROUP BY ALL),
p AS (SELECT m.entity, m.season, greatest(ri + rs * ln(1 + rank), 0) AS ppg, least(greatest(gi + gs * ln(1 + rank), 0), 17) AS g FROM m JOIN c ON c.fold = m.season AND c.grp = m.grp WHERE rank IS NOT NULL)
SELECT entity, season, {S("ppg")} AS pred_ppg, {S("g")} AS pred_games, {S("ppg * g")} AS pred_points FROM p""")
def rank_line_rung3(spark, sf):
    """The projector of a market's rank: a line for each group in every fold, from last season's points as the market."""
    place = F.row_number().over(Window.partitionBy("grp", "season").orderBy(F.col("prev1_points").desc_nulls_last(), "entity"))
    ranked = _panel(spark, sf).withColumn("rank", F.when(F.col("prev1_points").isNotNull(), place))
    out = P.rank_line(ranked, _TESTS)
    return out.select("entity", "season", *[steady(F.col(c)).alias(c) for c in ("pred_ppg", "pred_games", "pred_points")])


_PRIORITIES = ("1-URGENT", "2-HIGH", "3-MEDIUM")


@query(f"""WITH o AS (SELECT o_custkey AS cust, year(o_orderdate)::BIGINT AS yr, month(o_orderdate)::BIGINT AS mo, o_orderpriority AS status, o_orderkey FROM orders),
r AS (SELECT cust, yr, mo, min(status) AS status FROM o WHERE status IN {_PRIORITIES} GROUP BY ALL), x AS (SELECT l_orderkey, max(l_quantity) AS quantity FROM lineitem WHERE l_linenumber > 2 GROUP BY 1),
n AS (SELECT cust, yr, mo, max(quantity) AS quantity FROM x JOIN o ON o_orderkey = l_orderkey GROUP BY ALL) SELECT r.*, coalesce(quantity, 0) AS quantity, coalesce(quantity, 0) > 0 AS played FROM r LEFT JOIN n USING (cust, yr, mo)""")
def weekly_spine_crosswalk(spark, sf):
    """A customer's months with an order of some urgency, and the largest third line of them, which comes by the order's key."""
    orders = table(spark, sf, "orders").select("o_orderkey", F.col("o_custkey").alias("cust"), *period("o_orderdate"), F.col("o_orderpriority").alias("status"))
    lines = table(spark, sf, "lineitem").where("l_linenumber > 2").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_quantity").alias("quantity"))
    snaps = lines.join(orders.select("o_orderkey", "yr", "mo"), "o_orderkey")
    out = blocks.weekly_spine(orders.select("cust", "yr", "mo", "status"), snaps, orders, "cust", "o_orderkey", ["yr", "mo"], F.col("status").isin(*_PRIORITIES), "status", "quantity")
    return out.select("cust", "yr", "mo", "status", "quantity", "played")
