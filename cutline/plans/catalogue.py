"""Every registered query with its SQL twin, over the driver's star schema."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.columns import avg_if, clip, implied_totals, map_value, piecewise_credit, rate, schedule_length, shrink, steady, sum0, sum_if, weight_mass, weighted_sum
from ..operators import asof, dedupe, priors, ranks, temporal
from ..sources.tables import null_rates, table
from . import blocks
from . import projectors as P
from .bases import CM, CY, PANEL, SM, cents, customer_month, customer_year, supplier_month

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}
S = "round({} + 1e-7, 4)".format


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def _panel(spark: SparkSession, sf: str) -> DataFrame:
    return priors.lag_join(customer_year(spark, sf), ["entity"], "season", ["games", "points"])


_SPINE = "spine AS (SELECT c_custkey AS cust, 199800 + m AS wk FROM customer, range(1, 13) r(m))"


@query(f"""WITH {CM}, f AS (SELECT cust, wk, avg(spend) OVER (PARTITION BY cust ORDER BY wk ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a FROM cm), {_SPINE}
SELECT s.cust, s.wk, {S("a")} AS spend_last3 FROM spine s ASOF LEFT JOIN f ON s.cust = f.cust AND s.wk > f.wk""")
def asof_last3_spend(spark, sf):
    """Mean spend over the last three active months strictly before each month of 1998."""
    spine = table(spark, sf, "customer").select(F.col("c_custkey").alias("cust"), F.explode(F.sequence(F.lit(199801).cast("bigint"), F.lit(199812).cast("bigint"))).alias("wk"))
    feats = temporal.inclusive_mean(customer_month(spark, sf), ["cust"], ["wk"], ["spend"], [3])
    return asof.attach_asof(spine, feats, ["cust"], "wk", ["spend_last3"]).withColumn("spend_last3", steady(F.col("spend_last3")))


def _trail(col: str, part: str, order: str, n: int) -> str:
    return f"avg({col}) OVER (PARTITION BY {part} ORDER BY {order} ROWS BETWEEN {n} PRECEDING AND 1 PRECEDING)"


@query(f"WITH {SM} SELECT supp, wk, " + ", ".join(f"{S(_trail('qty', 'supp', 'wk', n))} AS qty_last{n}" for n in (3, 5, 8)) + " FROM sm")
def trailing_mean_supplier_month(spark, sf):
    out = temporal.trailing_mean(supplier_month(spark, sf), ["supp"], ["wk"], ["qty"])
    return out.select("supp", "wk", *[steady(F.col(f"qty_last{n}")).alias(f"qty_last{n}") for n in (3, 5, 8)])


@query(f"WITH {CM} SELECT cust, wk, " + ", ".join(f"{S(f'avg(n) OVER (PARTITION BY cust ORDER BY wk ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW)')} AS n_last{n}" for n in (3, 5)) + " FROM cm")
def inclusive_mean_customer_month(spark, sf):
    out = temporal.inclusive_mean(customer_month(spark, sf), ["cust"], ["wk"], ["n"], [3, 5])
    return out.select("cust", "wk", *[steady(F.col(f"n_last{n}")).alias(f"n_last{n}") for n in (3, 5)])


@query(f"""WITH {CM}, x AS (SELECT cust, yr, mo, nullif(n, 2) AS n FROM cm)
SELECT cust, yr, mo, CASE WHEN n IS NOT NULL THEN {S("sum(n) OVER w / row_number() OVER w")} END AS n_std, row_number() OVER w AS nth FROM x WINDOW w AS (PARTITION BY cust, yr ORDER BY mo)""")
def season_to_date_customer(spark, sf):
    """To-date means with null measures (months of two orders) and the row's number in its year."""
    base = customer_month(spark, sf).withColumn("n", F.nullif(F.col("n"), F.lit(2)))
    out = temporal.to_date_mean(base, ["cust"], "yr", ["mo"], ["n"])
    nth = F.row_number().over(Window.partitionBy("cust", "yr").orderBy("mo")).cast("bigint")
    return out.select("cust", "yr", "mo", steady(F.col("n_std")).alias("n_std"), nth.alias("nth"))


@query(f"""WITH {SM}, u AS (SELECT supp, wk, qty FROM sm UNION ALL SELECT DISTINCT supp, 200201, NULL FROM sm)
SELECT supp, wk, {S(_trail("qty", "supp", "wk", 3))} AS qty_last3 FROM u""")
def upcoming_month_placeholder(spark, sf):
    base = temporal.with_upcoming(supplier_month(spark, sf).select("supp", "wk", "qty"), ["supp"], {"wk": 200201})
    return temporal.trailing_mean(base, ["supp"], ["wk"], ["qty"], [3]).select("supp", "wk", steady(F.col("qty_last3")).alias("qty_last3"))


_QUARTERS = "q AS (SELECT DISTINCT o_custkey AS cust, year(o_orderdate)::BIGINT AS yr, quarter(o_orderdate)::BIGINT AS qt FROM orders), years AS (SELECT DISTINCT cust, yr FROM q), sp AS (SELECT cust, yr, r.qt, (q.cust IS NOT NULL)::BIGINT AS played FROM (SELECT cust, yr, t.qt FROM years, range(1, 5) t(qt)) r LEFT JOIN q USING (cust, yr, qt))"


def _quarter_spine(spark, sf):
    active = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.year("o_orderdate").cast("bigint").alias("yr"), F.quarter("o_orderdate").cast("bigint").alias("qt")).distinct()
    years = active.select("cust", "yr").distinct()
    spine = years.select("cust", "yr", F.explode(F.array(*[F.lit(n).cast("bigint") for n in range(1, 5)])).alias("qt"))
    played = active.withColumn("played", F.lit(1).cast("bigint"))
    return spine.join(played, ["cust", "yr", "qt"], "left").withColumn("played", F.coalesce("played", F.lit(0)).cast("bigint"))


@query(f"WITH {_QUARTERS} SELECT cust, yr, qt, played FROM sp")
def spine_with_played_flag(spark, sf):
    return _quarter_spine(spark, sf).select("cust", "yr", "qt", "played")


@query(f"WITH {_QUARTERS} SELECT cust, yr, qt, coalesce(sum(1 - played) OVER (PARTITION BY cust, yr ORDER BY qt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS missed FROM sp")
def lagged_absence_count(spark, sf):
    return temporal.missed_to_date(_quarter_spine(spark, sf), ["cust", "yr"], ["qt"], "played", "missed").select("cust", "yr", "qt", F.col("missed").cast("bigint").alias("missed"))


@query(f"WITH {_QUARTERS} SELECT cust, yr, qt, " + ", ".join(f"{S(_trail('played', 'cust', 'yr, qt', n))} AS played_rate_last{n}" for n in (3, 5, 8)) + " FROM sp")
def participation_rate(spark, sf):
    out = temporal.trailing_mean(_quarter_spine(spark, sf), ["cust"], ["yr", "qt"], ["played"])
    return out.select("cust", "yr", "qt", *[steady(F.col(f"played_last{n}")).alias(f"played_rate_last{n}") for n in (3, 5, 8)])


@query("""SELECT cust, yr, qt, o_orderkey, o_orderpriority FROM (SELECT o_custkey AS cust, year(o_orderdate)::BIGINT AS yr, quarter(o_orderdate)::BIGINT AS qt, o_orderkey, o_orderpriority,
row_number() OVER (PARTITION BY o_custkey, year(o_orderdate), quarter(o_orderdate) ORDER BY o_orderpriority, o_orderkey) AS nth FROM orders) WHERE nth = 1""")
def keep_first_status(spark, sf):
    orders = table(spark, sf, "orders").select(F.col("o_custkey").alias("cust"), F.year("o_orderdate").cast("bigint").alias("yr"), F.quarter("o_orderdate").cast("bigint").alias("qt"), "o_orderkey", "o_orderpriority")
    return dedupe.keep_first(orders, ["cust", "yr", "qt"], ["o_orderpriority", "o_orderkey"])


@query("SELECT user_id, day, event_type, value FROM (SELECT user_id, ts::DATE AS day, event_type, value, row_number() OVER (PARTITION BY user_id, ts::DATE ORDER BY ts DESC, event_id DESC) AS nth FROM events) WHERE nth = 1")
def last_report_per_user_day(spark, sf):
    events = table(spark, sf, "events").withColumn("day", F.to_date("ts"))
    return dedupe.last_by(events, ["user_id", "day"], ["ts", "event_id"], ["event_type", "value"])


_MODAL = """c AS (SELECT c_nationkey AS nation, year(o_orderdate)::BIGINT AS yr, o_orderpriority AS p, count(*) AS n FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY ALL),
m AS (SELECT nation, yr, p AS priority FROM (SELECT *, row_number() OVER (PARTITION BY nation, yr ORDER BY n DESC, p) AS nth FROM c) WHERE nth = 1)"""


def _modal(spark, sf):
    orders = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return dedupe.modal_value(orders.select(F.col("c_nationkey").alias("nation"), F.year("o_orderdate").cast("bigint").alias("yr"), F.col("o_orderpriority").alias("priority")), ["nation", "yr"], "priority")


@query(f"WITH {_MODAL} SELECT nation, yr, priority, coalesce(priority <> lag(priority) OVER (PARTITION BY nation ORDER BY yr), TRUE) AS is_new FROM m")
def modal_priority_changed(spark, sf):
    return temporal.changed(_modal(spark, sf), ["nation"], ["yr"], "priority", "is_new")


@query(f"""WITH {_MODAL}, o AS (SELECT nation, yr, CASE WHEN nation IN (1, 3) AND yr = 1997 THEN 'MANUAL' ELSE priority END AS priority FROM m)
SELECT nation, yr, priority, coalesce(priority <> lag(priority) OVER (PARTITION BY nation ORDER BY yr), TRUE) AS is_new FROM o""")
def caller_with_override(spark, sf):
    """Modal values under a literal override table."""
    override = spark.createDataFrame([(1, 1997, "MANUAL"), (3, 1997, "MANUAL")], "nation int, yr bigint, own string")
    joined = _modal(spark, sf).join(F.broadcast(override), ["nation", "yr"], "left").select("nation", "yr", F.coalesce("own", "priority").alias("priority"))
    return temporal.changed(joined, ["nation"], ["yr"], "priority", "is_new")


_SHARE = "sh AS (SELECT l_suppkey AS supp, (year(l_shipdate) * 100 + month(l_shipdate))::BIGINT AS wk, l_partkey AS part, sum(CASE WHEN l_quantity <= 20 THEN 1 ELSE 0 END)::BIGINT AS n FROM lineitem GROUP BY ALL)"


@query(f"WITH {_SHARE} SELECT supp, wk, part, n, {S('coalesce(CASE WHEN sum(n) OVER w > 0 THEN n / sum(n) OVER w END, 0)')} AS share FROM sh WINDOW w AS (PARTITION BY supp, wk)")
def share_of_supplier_small_lots(spark, sf):
    """A part's share of its supplier's small lots in the month; 0 where there are none."""
    lines = table(spark, sf, "lineitem")
    wk = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("bigint")
    base = lines.groupBy(F.col("l_suppkey").alias("supp"), wk.alias("wk"), F.col("l_partkey").alias("part")).agg(F.sum((F.col("l_quantity") <= 20).cast("bigint")).alias("n"))
    total = F.sum("n").over(Window.partitionBy("supp", "wk"))
    return base.withColumn("share", steady(F.coalesce(F.when(total > 0, F.col("n") / total), F.lit(0.0))))


_DIFF = "round(l_discount * 200) - 10"


@query(f"""SELECT l_suppkey AS supp, count(*)::BIGINT AS n, {S("avg(CASE WHEN d <= -8 THEN 1.0 ELSE 0.0 END)")} AS trailing_share, {S("avg(CASE WHEN d > -8 AND d < 8 THEN 1.0 ELSE 0.0 END)")} AS close_share,
{S("avg(CASE WHEN d >= 8 THEN 1.0 ELSE 0.0 END)")} AS leading_share, {S("avg(d)")} AS mean_diff FROM (SELECT l_suppkey, {_DIFF} AS d FROM lineitem) GROUP BY 1""")
def bucket_shares(spark, sf):
    d = F.round(F.col("l_discount") * 200) - 10
    rows = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supp"), d.alias("d"))
    shares = {"trailing": F.col("d") <= -8, "close": (F.col("d") > -8) & (F.col("d") < 8), "leading": F.col("d") >= 8}
    return rows.groupBy("supp").agg(F.count(F.lit(1)).alias("n"), *[steady(rate(c)).alias(f"{n}_share") for n, c in shares.items()], steady(F.avg("d")).alias("mean_diff"))


@query(f"SELECT l_suppkey AS supp, {S('sum(CASE WHEN y < 0 THEN 1.2 * y ELSE least(y, 4.0) + 0.5 * (CASE WHEN y - 4 < 0 THEN 0 WHEN y - 4 > 6 THEN 6 ELSE y - 4 END) END)')} AS credit FROM (SELECT l_suppkey, l_quantity - 10 AS y FROM lineitem) GROUP BY 1")
def piecewise_credit_by_supplier(spark, sf):
    return table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("supp")).agg(steady(F.sum(piecewise_credit(F.col("l_quantity") - 10))).alias("credit"))


@query(f"""SELECT l_returnflag AS flag, {S("avg(l_quantity) FILTER (WHERE l_linestatus = 'O')")} AS open_qty, coalesce(sum(l_quantity) FILTER (WHERE l_quantity <= 10), 0) AS tiny_qty,
count(DISTINCT l_suppkey) FILTER (WHERE l_quantity <= 20 AND l_linenumber IN (1, 2) AND abs({_DIFF}) <= 7)::BIGINT AS neutral_suppliers FROM lineitem GROUP BY 1""")
def filtered_aggregates(spark, sf):
    d = F.round(F.col("l_discount") * 200) - 10
    neutral = (F.col("l_quantity") <= 20) & F.col("l_linenumber").isin(1, 2) & (F.abs(d) <= 7)
    return table(spark, sf, "lineitem").groupBy(F.col("l_returnflag").alias("flag")).agg(
        steady(avg_if(F.col("l_quantity"), F.col("l_linestatus") == "O")).alias("open_qty"),
        sum_if(F.col("l_quantity"), F.col("l_quantity") <= 10).alias("tiny_qty"),
        F.count_distinct(F.when(neutral, F.col("l_suppkey"))).alias("neutral_suppliers"),
    )


@query(f"""WITH e AS (SELECT user_id, ts::DATE AS day, epoch_us(ts) // 1000000 AS t, event_id FROM events), g AS (SELECT user_id, day, t - lag(t) OVER (PARTITION BY user_id, day ORDER BY t, event_id) AS gap FROM e)
SELECT user_id, count(*)::BIGINT AS n, {S("avg(gap) FILTER (WHERE gap BETWEEN 1 AND 7200)")} AS mean_gap FROM g GROUP BY 1""")
def elapsed_within_session(spark, sf):
    events = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), F.unix_seconds(F.col("ts").cast("timestamp")).alias("t"), "event_id")
    gap = F.col("t") - F.lag("t").over(Window.partitionBy("user_id", "day").orderBy("t", "event_id"))
    return events.select("user_id", gap.alias("gap")).groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), steady(avg_if(F.col("gap"), F.col("gap").between(1, 7200))).alias("mean_gap"))


_SIDES = "l AS (SELECT o_orderkey AS k, c.c_nationkey AS cn, s.s_nationkey AS sn, l_quantity AS q FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer c ON o_custkey = c_custkey JOIN supplier s ON l_suppkey = s_suppkey)"


def _lines(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_suppkey", "l_quantity", "l_discount", "l_returnflag", "l_linestatus", "l_shipdate")
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("l_orderkey"), "o_custkey", "o_orderdate")
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_nationkey", "c_mktsegment")
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), "s_nationkey")
    return lines.join(orders, "l_orderkey").join(customers, "o_custkey").join(suppliers, "l_suppkey")


@query(f"""WITH {_SIDES}, t AS (SELECT cn AS nation, 'home' AS side, q, q / 2 + 1 AS implied FROM l UNION ALL SELECT sn, 'away', q, q / 2 - 1 FROM l)
SELECT nation, side, count(*)::BIGINT AS n, sum(q) AS qty, {S("avg(implied)")} AS implied FROM t GROUP BY ALL""")
def unpivot_two_sides(spark, sf):
    """Both sides of a line as rows of their own, from one scan."""
    home, away = implied_totals(F.col("l_quantity"), F.lit(2.0))
    sides = F.array(F.struct(F.col("c_nationkey").alias("nation"), F.lit("home").alias("side"), home.alias("implied")), F.struct(F.col("s_nationkey").alias("nation"), F.lit("away").alias("side"), away.alias("implied")))
    rows = _lines(spark, sf).select("l_quantity", F.explode(sides).alias("s")).select("l_quantity", "s.*")
    return rows.groupBy("nation", "side").agg(F.count(F.lit(1)).alias("n"), F.sum("l_quantity").alias("qty"), steady(F.avg("implied")).alias("implied"))


_SEGMENTS = ("AUTOMOBILE", "BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")


@query("SELECT year(o_orderdate)::BIGINT AS yr, " + ", ".join(f"coalesce(sum(round(o_totalprice * 100)::BIGINT) FILTER (WHERE c_mktsegment = '{s}'), 0)::BIGINT AS {s.lower()}" for s in _SEGMENTS) + " FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1")
def position_pivot_sums(spark, sf):
    joined = table(spark, sf, "orders").join(table(spark, sf, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    return joined.groupBy(F.year("o_orderdate").cast("bigint").alias("yr")).agg(*[sum_if(cents("o_totalprice"), F.col("c_mktsegment") == s).alias(s.lower()) for s in _SEGMENTS])


@query(f"WITH {CY} SELECT a.entity, a.season, a.games, b.games AS prev_season_games, {S('b.points')} AS prev_season_points FROM cy a LEFT JOIN cy b ON a.entity = b.entity AND a.season = b.season + 1")
def prior_year_profile(spark, sf):
    base = customer_year(spark, sf).select("entity", "season", "games", "points")
    out = base.select("entity", "season", "games").join(priors.next_season(base, "season", ["games", "points"]), ["entity", "season"], "left")
    return out.withColumn("prev_season_points", steady(F.col("prev_season_points")))


@query(f"WITH {PANEL} SELECT entity, season, " + ", ".join(f"{S(f'prev{n}_points')} AS prev{n}_points" for n in (1, 2, 3)) + ", prev1_games IS NOT NULL OR prev2_games IS NOT NULL OR prev3_games IS NOT NULL AS has_history FROM panel")
def lag_join_1_2_3(spark, sf):
    history = F.coalesce("prev1_games", "prev2_games", "prev3_games").isNotNull()
    return _panel(spark, sf).select("entity", "season", *[steady(F.col(f"prev{n}_points")).alias(f"prev{n}_points") for n in (1, 2, 3)], history.alias("has_history"))


_W = (5, 4, 3)
_WP = " + ".join(f"{w}.0 * coalesce(prev{n}_points, 0)" for n, w in enumerate(_W, 1))
_WG = " + ".join(f"{w}.0 * coalesce(prev{n}_games, 0)" for n, w in enumerate(_W, 1))
_WM = " + ".join(f"CASE WHEN prev{n}_games IS NOT NULL THEN {w}.0 ELSE 0 END" for n, w in enumerate(_W, 1))


@query(f"WITH {PANEL} SELECT entity, season, {S(_WP)} AS weighted_points, ({_WM})::DOUBLE AS mass, {S(f'CASE WHEN {_WG} + 20 > 0 THEN ({_WP} + 20 * 2.5) / ({_WG} + 20) ELSE 2.5 END')} AS rate FROM panel")
def weighted_prior_543(spark, sf):
    points = weighted_sum([F.col(f"prev{n}_points") for n in (1, 2, 3)], list(_W))
    games = [F.col(f"prev{n}_games") for n in (1, 2, 3)]
    return _panel(spark, sf).select("entity", "season", steady(points).alias("weighted_points"), weight_mass(games, list(_W)).alias("mass"), steady(shrink(points, weighted_sum(games, list(_W)), F.lit(2.5), 20)).alias("rate"))


@query(f"WITH {PANEL} SELECT k::DOUBLE AS k, {S(f'avg(((({_WP}) + k * 2.5) / (({_WG}) + k) - points / games) ** 2)')} AS mse FROM panel, range(1, 82) r(k) WHERE prev1_games IS NOT NULL GROUP BY 1")
def shrink_grid_argmin(spark, sf):
    """Errors of 81 constants from one scan; the argmin is the caller's."""
    train = _panel(spark, sf).where("prev1_games IS NOT NULL")
    out = P.shrink_errors(train, [], _W, F.lit(2.5), [float(k) for k in range(1, 82)], F.col("points") / F.col("games"))
    return out.withColumn("mse", steady(F.col("mse")))


@query(f"WITH {CY}, g AS (SELECT grp, sum(points) / sum(games) AS m FROM cy WHERE grp <> 'MACHINERY' GROUP BY 1), a AS (SELECT sum(points) / sum(games) AS m FROM cy) SELECT grp, {S('coalesce(g.m, a.m)')} AS mu FROM (SELECT DISTINCT grp FROM cy) LEFT JOIN g USING (grp), a")
def segment_means_fallback(spark, sf):
    """Ratio of sums by group, the overall one for a group without training rows."""
    base = customer_year(spark, sf)
    sums = base.groupBy("grp").agg(F.sum("points").alias("p"), F.sum("games").alias("g"))
    every = Window.partitionBy()  # five rows
    mu = F.coalesce(F.when(F.col("grp") != "MACHINERY", F.try_divide("p", "g")), F.try_divide(F.sum("p").over(every), F.sum("g").over(every)))
    return sums.select("grp", steady(mu).alias("mu"))


_TENURE = "t AS (SELECT *, CASE WHEN a < 1 THEN 1 WHEN a > 4 THEN 4 ELSE a END AS bucket FROM (SELECT *, season - min(season) OVER (PARTITION BY entity) AS a FROM panel))"


@query(f"WITH {PANEL}, {_TENURE} SELECT grp, bucket::BIGINT AS bucket, count(*)::BIGINT AS n, {S('sum(points / games - prev1_points / prev1_games) / (count(*) + 20)')} AS adjust FROM t WHERE prev1_games IS NOT NULL GROUP BY ALL")
def age_bucket_residuals(spark, sf):
    tenure = F.col("season") - F.min("season").over(Window.partitionBy("entity"))
    base = _panel(spark, sf).withColumn("bucket", clip(tenure, 1, 4).cast("bigint")).where("prev1_games IS NOT NULL")
    residual = F.col("points") / F.col("games") - F.col("prev1_points") / F.col("prev1_games")
    return base.groupBy("grp", "bucket").agg(F.count(F.lit(1)).alias("n"), steady(F.sum(residual) / (F.count(F.lit(1)) + 20)).alias("adjust"))


@query(f"""WITH {CY}, r AS (SELECT grp, season, points, row_number() OVER (PARTITION BY grp, season ORDER BY games DESC, entity) AS k FROM cy)
SELECT grp, {S("CASE WHEN count(*) >= 3 THEN regr_slope(points, ln(1 + k)) ELSE 0 END")} AS slope, {S("CASE WHEN count(*) >= 3 THEN regr_intercept(points, ln(1 + k)) ELSE avg(points) END")} AS intercept FROM r GROUP BY 1""")
def rank_calibration_line(spark, sf):
    placed = ranks.numbered(customer_year(spark, sf), ["grp", "season"], ["games", "entity"], [F.col("games").desc(), "entity"], "k", descending=["games"])
    ranked = placed.select("grp", "points", F.log1p("k").alias("x"))
    enough = F.count(F.lit(1)) >= 3
    return ranked.groupBy("grp").agg(steady(F.when(enough, F.regr_slope("points", "x")).otherwise(0.0)).alias("slope"), steady(F.when(enough, F.regr_intercept("points", "x")).otherwise(F.avg("points"))).alias("intercept"))


@query(f"""WITH {PANEL}, r AS (SELECT grp, points - prev1_points AS x, row_number() OVER (PARTITION BY grp ORDER BY points - prev1_points) - 1 AS i, count(*) OVER (PARTITION BY grp) AS n FROM panel WHERE prev1_points IS NOT NULL)
SELECT grp, {", ".join(f"{S(f'max(x) FILTER (WHERE i = floor((n - 1) * {a} + 0.5))')} AS q{round(a * 100)}" for a in (0.1, 0.5, 0.9))} FROM r GROUP BY 1""")
def residual_quantiles_nearest(spark, sf):
    out = P.residual_quantiles(_panel(spark, sf), ["grp"], "prev1_points", "points")
    return out.select("grp", *[steady(F.col(q)).alias(q) for q in ("q10", "q50", "q90")])


_RANKED = "SELECT grp, {p} AS p, {a} AS a, rank() OVER (PARTITION BY grp ORDER BY {p}) + (count(*) OVER (PARTITION BY grp, {p}) - 1) / 2 AS rp, rank() OVER (PARTITION BY grp ORDER BY {a}) + (count(*) OVER (PARTITION BY grp, {a}) - 1) / 2 AS ra FROM panel WHERE {p} IS NOT NULL"


@query(f"WITH {PANEL}, r AS ({_RANKED.format(p='prev1_games', a='games')}) SELECT grp, count(*)::BIGINT AS n, {S('sqrt(avg((p - a) ** 2))')} AS rmse, {S('avg(abs(p - a))')} AS mae, {S('corr(rp, ra)')} AS spearman FROM r GROUP BY 1")
def rmse_mae_spearman(spark, sf):
    out = P.scores(_panel(spark, sf), ["grp"], "prev1_games", "games")
    return out.select("grp", "n", *[steady(F.col(c)).alias(c) for c in ("rmse", "mae", "spearman")])


@query(f"WITH {PANEL} SELECT grp, " + ", ".join(f"{S(f'avg((games <= prev1_games * {f})::INT)')} AS cover_{n}" for n, f in (("low", 0.5), ("mid", 1.0), ("high", 2.0))) + " FROM panel WHERE prev1_games IS NOT NULL GROUP BY 1")
def quantile_coverage(spark, sf):
    base = _panel(spark, sf).where("prev1_games IS NOT NULL").select("grp", "games", *[(F.col("prev1_games") * f).alias(n) for n, f in (("low", 0.5), ("mid", 1.0), ("high", 2.0))])
    out = P.coverage(base, ["grp"], "games", ["low", "mid", "high"])
    return out.select("grp", *[steady(F.col(f"cover_{n}")).alias(f"cover_{n}") for n in ("low", "mid", "high")])


_TESTS = P.folds(1995, 2001)
#: Training rows of every fold with the mean rate and games of their group there.
_FOLDS = f"""{PANEL}, tr AS (SELECT fold, panel.* FROM panel, range({_TESTS[0]}, {_TESTS[-1] + 1}) f(fold) WHERE season < fold),
mu AS (SELECT fold, grp, sum(points) / sum(games) AS mu, avg(games) AS gmu FROM tr GROUP BY ALL)"""


def _prior_sql(name: str, weights: tuple) -> str:
    """SQL of one weighted prior in every fold: ``name`` has the panel's columns, ``ppg``, ``g`` and ``pred``."""
    scale = float(sum(weights))
    total = lambda c: "(" + " + ".join(f"{w} * coalesce(prev{n}_{c}, 0)" for n, w in enumerate(weights, 1)) + ")"
    mass = "(" + " + ".join(f"CASE WHEN prev{n}_games IS NOT NULL THEN {w} ELSE 0 END" for n, w in enumerate(weights, 1)) + ")"
    shrunk = lambda x, n, m, k: f"CASE WHEN {n} + {k} > 0 THEN ({x} + {k} * {m}) / ({n} + {k}) ELSE {m} END"
    grid = lambda g: ", ".join(f"({k * scale})" for k in g)
    rate = lambda k: shrunk(total("points"), total("games"), "mu", k)
    games = lambda k: shrunk(total("games"), mass, "gmu", k)
    best = lambda c, g, e, a: f"SELECT fold, arg_min(k, (e, k)) AS {c} FROM (SELECT fold, k, avg(({e} - {a}) ** 2) AS e FROM tr JOIN mu USING (fold, grp), (VALUES {grid(g)}) v(k) GROUP BY ALL) GROUP BY 1"
    return f"""{name}_kr AS ({best("kr", P.RATE_GRID, rate("k"), "points / games")}), {name}_kg AS ({best("kg", P.GAMES_GRID, games("k"), "games")}),
{name}_raw AS (SELECT panel.*, mu, gmu, {rate("kr")} AS r, {games("kg")} AS h FROM panel JOIN mu ON mu.fold = season AND mu.grp = panel.grp JOIN {name}_kr k1 ON k1.fold = season JOIN {name}_kg k2 ON k2.fold = season),
{name} AS (SELECT *, CASE WHEN r < 0 THEN 0 ELSE r END AS ppg, CASE WHEN h < 0 THEN 0 WHEN h > 17 THEN 17 ELSE h END AS g, (CASE WHEN r < 0 THEN 0 ELSE r END) * (CASE WHEN h < 0 THEN 0 WHEN h > 17 THEN 17 ELSE h END) AS pred FROM {name}_raw)"""


_R1 = f"{_FOLDS}, {_prior_sql('r1', (1.0, 0.0, 0.0))}"


def _rung1(spark, sf):
    return P.weighted_prior(_panel(spark, sf), _TESTS, (1.0, 0.0, 0.0))


@query(f"WITH {_R1} SELECT season, count(*)::BIGINT AS n, {S('sqrt(avg((pred - points) ** 2))')} AS rmse, {S('avg(abs(pred - points))')} AS mae FROM r1 GROUP BY 1")
def walk_forward_rung1(spark, sf):
    """Rung 1 in every fold: means and both shrinkage constants are fitted on the seasons before the fold's."""
    out = P.errors(_rung1(spark, sf), ["season"], "pred_points", "points")
    return out.select("season", "n", steady(F.col("rmse")).alias("rmse"), steady(F.col("mae")).alias("mae"))


@query(f"WITH {_R1}, e AS (SELECT season, (pred - points) ** 2 AS r1, (mu * gmu - points) ** 2 AS r0 FROM r1) SELECT projector, " + ", ".join(f"{S(f'sqrt(avg(e) FILTER (WHERE season = {y}))')} AS y{y}" for y in range(1998, 2002)) + ", count(*)::BIGINT AS n FROM (SELECT season, 'rung1' AS projector, r1 AS e FROM e UNION ALL SELECT season, 'rung0', r0 FROM e) GROUP BY 1")
def leaderboard_pivot(spark, sf):
    """Error by projector and season, wide, with the number of scored rows."""
    base = _rung1(spark, sf)
    long = base.select("season", "points", F.explode(F.create_map(F.lit("rung1"), F.col("pred_points"), F.lit("rung0"), F.col("mu") * F.col("games_mu"))).alias("projector", "pred"))
    found = P.errors(long, ["projector", "season"], "pred", "points")
    wide = found.groupBy("projector").pivot("season", [1998, 1999, 2000, 2001]).agg(F.first("rmse"))
    return wide.select("projector", *[steady(F.col(str(y))).alias(f"y{y}") for y in range(1998, 2002)]).join(found.groupBy("projector").agg(F.sum("n").alias("n")), "projector")


@query("WITH n AS (SELECT c_nationkey AS nation, c_custkey AS cust, floor(c_acctbal / 1000) AS b FROM customer) SELECT nation, cust, floor(rank() OVER (PARTITION BY nation ORDER BY b DESC) + (count(*) OVER (PARTITION BY nation, b) - 1) / 2)::BIGINT AS pos_rank FROM n")
def average_rank_desc(spark, sf):
    base = table(spark, sf, "customer").select(F.col("c_nationkey").alias("nation"), F.col("c_custkey").alias("cust"), F.floor(F.col("c_acctbal") / 1000).alias("b"))
    return ranks.average_ranks(base, ["nation"], "b", "r", descending=True).select("nation", "cust", F.floor("r").cast("bigint").alias("pos_rank"))


@query(f"""WITH {CY}, a AS (SELECT entity, 'first' AS source, games FROM cy WHERE season = 1997 AND games >= 3), b AS (SELECT entity, 'second' AS source, games FROM cy WHERE season = 1998)
SELECT * FROM a UNION ALL SELECT * FROM b WHERE entity NOT IN (SELECT entity FROM a)""")
def anti_join_override(spark, sf):
    """Rows of the first source, then those of the second whose key the first lacks."""
    base = customer_year(spark, sf)
    first = base.where("season = 1997 AND games >= 3").select("entity", F.lit("first").alias("source"), "games")
    second = base.where("season = 1998").select("entity", F.lit("second").alias("source"), "games")
    return first.unionByName(second.join(first, "entity", "left_anti"))


@query(f"WITH {CY}, k AS (SELECT entity FROM cy WHERE season = 1996 INTERSECT SELECT entity FROM cy WHERE season = 1997 INTERSECT SELECT entity FROM cy WHERE season = 1998) SELECT entity, season, games FROM cy WHERE entity IN (SELECT entity FROM k)")
def common_coverage_keys(spark, sf):
    base = customer_year(spark, sf)
    keys = base.where("season = 1996").select("entity")
    for year in (1997, 1998):
        keys = keys.intersect(base.where(F.col("season") == year).select("entity"))
    return base.select("entity", "season", "games").join(keys, "entity", "left_semi")


@query("SELECT user_id, day, round(sum(value) + 1e-7, 4) AS total FROM (SELECT user_id, ts::DATE AS day, value, max(ts::DATE) OVER (PARTITION BY user_id) AS newest FROM events WHERE ts::DATE <= (SELECT min(ts::DATE) + 14 FROM events)) WHERE day = newest GROUP BY ALL")
def latest_snapshot_before_cutoff(spark, sf):
    """Each user's newest day that is not after the cutoff, a fortnight into the table."""
    events = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "value")
    cutoff = F.broadcast(events.agg(F.date_add(F.min("day"), 14).alias("cutoff")))  # a row
    dated = events.join(cutoff, F.col("day") <= F.col("cutoff"))
    return asof.latest_before(dated, ["user_id"], "day", F.col("cutoff")).groupBy("user_id", "day").agg(steady(F.sum("value")).alias("total"))


@query(f"""WITH {SM}, a AS (SELECT l_suppkey AS supp, year(l_shipdate)::BIGINT AS yr, sum(l_quantity) AS n_qty FROM lineitem WHERE l_returnflag = 'N' AND l_quantity > 48 GROUP BY ALL), b AS (SELECT l_suppkey AS supp, year(l_shipdate)::BIGINT AS yr, sum(l_quantity) AS a_qty FROM lineitem WHERE l_returnflag = 'A' AND l_quantity < 3 GROUP BY ALL)
SELECT supp, yr, coalesce(n_qty, 0) AS n_qty, coalesce(a_qty, 0) AS a_qty FROM a FULL JOIN b USING (supp, yr)""")
def full_outer_two_kinds(spark, sf):
    lines = table(spark, sf, "lineitem").select(F.col("l_suppkey").alias("supp"), F.year("l_shipdate").cast("bigint").alias("yr"), "l_returnflag", "l_quantity")
    kinds = [lines.where((F.col("l_returnflag") == f) & c).groupBy("supp", "yr").agg(F.sum("l_quantity").alias(n)) for f, c, n in (("N", F.col("l_quantity") > 48, "n_qty"), ("A", F.col("l_quantity") < 3, "a_qty"))]
    return kinds[0].join(kinds[1], ["supp", "yr"], "full").select("supp", "yr", *[F.coalesce(c, F.lit(0.0)).alias(c) for c in ("n_qty", "a_qty")])


@query(f"WITH {CY} SELECT entity, season, m::BIGINT AS mo, {S('points / games * (games / 12)')} AS expected FROM cy, range(1, 13) r(m) WHERE season = 1999")
def expand_to_calendar(spark, sf):
    base = customer_year(spark, sf).where("season = 1999")
    rows = base.select("entity", "season", "points", "games", F.explode(F.sequence(F.lit(1).cast("bigint"), F.lit(12).cast("bigint"))).alias("mo"))
    return rows.select("entity", "season", "mo", steady(F.col("points") / F.col("games") * (F.col("games") / 12)).alias("expected"))


@query(f"WITH x AS (SELECT year(o_orderdate)::BIGINT AS yr, try_cast(substr(o_orderpriority, 1, 1) AS INT) AS level, CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS price FROM orders) SELECT yr, {S('avg((level IS NULL)::INT)')} AS level_null_rate, {S('avg((price IS NULL)::INT)')} AS price_null_rate FROM x GROUP BY 1")
def null_rate_by_year(spark, sf):
    base = table(spark, sf, "orders").select(F.year("o_orderdate").cast("bigint").alias("yr"), F.substring("o_orderpriority", 1, 1).try_cast("int").alias("level"), F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("price"))
    out = null_rates(base, ["yr"], ["level", "price"])
    return out.select("yr", *[steady(F.col(c)).alias(c) for c in ("level_null_rate", "price_null_rate")])


@query(f"""WITH d AS (SELECT o_orderkey AS k, try_cast(year(o_orderdate) || '-' || lpad(((o_orderkey % 14) + 0)::VARCHAR, 2, '0') || '-15' AS DATE) AS born FROM orders)
SELECT k, born, {S("date_diff('day', born, DATE '2002-09-01') / 365.25")} AS age FROM d""")
def lenient_date_age(spark, sf):
    """Ages at a date from text that is not always a date."""
    text = F.concat(F.year("o_orderdate").cast("string"), F.lit("-"), F.lpad((F.col("o_orderkey") % 14).cast("string"), 2, "0"), F.lit("-15"))
    base = table(spark, sf, "orders").select(F.col("o_orderkey").alias("k"), F.try_to_date(text, "yyyy-MM-dd").alias("born"))
    return base.select("k", "born", steady(F.datediff(F.lit("2002-09-01").cast("date"), F.col("born")) / 365.25).alias("age"))


@query(f"WITH {CY} SELECT entity, season, games FROM cy ORDER BY games DESC, entity, season LIMIT 25")
def topk_gain(spark, sf):
    return customer_year(spark, sf).select("entity", "season", "games").orderBy(F.col("games").desc(), "entity", "season").limit(25)


@query(f"WITH {CY} SELECT entity, season + 1 AS season, {S('games / CASE WHEN season >= 1999 THEN 17 ELSE 16 END')} AS prev_season_rate FROM cy")
def era_schedule_rate(spark, sf):
    base = customer_year(spark, sf).withColumn("rate", steady(F.col("games") / schedule_length(F.col("season"), 1999)))
    return priors.next_season(base.select("entity", "season", "rate"), "season", ["rate"])


@query(f"""WITH {_QUARTERS}, v AS (SELECT o_custkey AS cust, year(o_orderdate)::BIGINT AS yr, quarter(o_orderdate)::BIGINT AS qt, sum(round(o_totalprice * 100)::BIGINT)::BIGINT AS c FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL)
SELECT cust, yr, qt, CASE WHEN played = 0 THEN 0 ELSE c END AS label FROM sp LEFT JOIN v USING (cust, yr, qt)""")
def season_labels_analogue(spark, sf):
    """Absent entities have a true zero; present ones without a value stay null."""
    values = table(spark, sf, "orders").where("o_orderstatus <> 'P'").groupBy(F.col("o_custkey").alias("cust"), F.year("o_orderdate").cast("bigint").alias("yr"), F.quarter("o_orderdate").cast("bigint").alias("qt")).agg(F.sum(cents("o_totalprice")).alias("c"))
    return _quarter_spine(spark, sf).join(values, ["cust", "yr", "qt"], "left").select("cust", "yr", "qt", F.when(F.col("played") == 0, 0).otherwise(F.col("c")).cast("bigint").alias("label"))


@query(f"""WITH {_SIDES}, d AS (SELECT l_shipdate, s_nationkey AS nation, l_quantity AS q, l_returnflag AS f FROM lineitem JOIN supplier ON l_suppkey = s_suppkey),
p AS (SELECT nation, (year(l_shipdate) * 100 + month(l_shipdate))::BIGINT AS wk, count(*)::BIGINT AS n, avg(q) AS mean_q, avg(q) FILTER (WHERE f = 'N') - avg(q) FILTER (WHERE f = 'A') AS delta FROM d GROUP BY ALL)
SELECT nation, wk, n, {S("mean_q")} AS mean_q, {S("delta")} AS delta, {S(_trail("mean_q", "nation", "wk", 3))} AS mean_q_last3 FROM p""")
def profile_with_deltas(spark, sf):
    lines = table(spark, sf, "lineitem").select("l_suppkey", "l_shipdate", "l_quantity", "l_returnflag").join(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation")), "l_suppkey")
    q, flag = F.col("l_quantity"), F.col("l_returnflag")
    wk = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("bigint")
    profile = lines.groupBy("nation", wk.alias("wk")).agg(F.count(F.lit(1)).alias("n"), F.avg(q).alias("mean_q"), (avg_if(q, flag == "N") - avg_if(q, flag == "A")).alias("delta"))
    out = temporal.trailing_mean(profile, ["nation"], ["wk"], ["mean_q"], [3])
    return out.select("nation", "wk", "n", *[steady(F.col(c)).alias(c) for c in ("mean_q", "delta", "mean_q_last3")])


@query(f"""WITH {SM}, f AS (SELECT supp, wk, {_trail("small", "supp", "wk", 3)} AS small3, {_trail("qty", "supp", "wk", 5)} AS qty5 FROM sm), y AS (SELECT supp, yr, avg(qty) AS m FROM sm GROUP BY ALL)
SELECT sm.supp, sm.wk, {S("small3")} AS small_last3, {S("qty5")} AS qty_last5, {S("m")} AS prev_season_mean FROM sm JOIN f USING (supp, wk) LEFT JOIN y ON y.supp = sm.supp AND y.yr + 1 = sm.yr""")
def team_tendencies_analogue(spark, sf):
    base = supplier_month(spark, sf)
    rolled = temporal.trailing_mean(temporal.trailing_mean(base, ["supp"], ["wk"], ["small"], [3]), ["supp"], ["wk"], ["qty"], [5])
    yearly = priors.next_season(base.groupBy("supp", "yr").agg(F.avg("qty").alias("mean")), "yr", ["mean"])
    out = rolled.join(yearly, ["supp", "yr"], "left")
    return out.select("supp", "wk", *[steady(F.col(c)).alias(c) for c in ("small_last3", "qty_last5", "prev_season_mean")])


@query(f"""WITH {CM}, {_SPINE}, f AS (SELECT cust, wk, avg(spend) OVER (PARTITION BY cust ORDER BY wk ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS a FROM cm), g AS (SELECT o_custkey AS cust, (year(o_orderdate) * 100 + month(o_orderdate))::BIGINT AS wk, max(o_orderkey) AS top FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY ALL),
y AS (SELECT o_custkey AS cust, count(*)::BIGINT AS n FROM orders WHERE year(o_orderdate) = 1997 GROUP BY 1),
x AS (SELECT s.cust, s.wk, a FROM spine s ASOF LEFT JOIN f ON s.cust = f.cust AND s.wk > f.wk), z AS (SELECT x.cust, x.wk, a, top FROM x ASOF LEFT JOIN g ON x.cust = g.cust AND x.wk > g.wk)
SELECT z.cust, z.wk, c_mktsegment AS segment, {S("a")} AS spend_last3, top AS last_urgent, y.n AS prev_season_n FROM z JOIN customer ON c_custkey = z.cust LEFT JOIN y ON y.cust = z.cust""")
def feature_table_analogue(spark, sf):
    """Two as-of blocks in one pass and a prior-season block, on a spine whose rows stay."""
    spine = table(spark, sf, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("segment"), F.explode(F.sequence(F.lit(199801).cast("bigint"), F.lit(199812).cast("bigint"))).alias("wk"))
    spend = temporal.inclusive_mean(customer_month(spark, sf), ["cust"], ["wk"], ["spend"], [3])
    orders = table(spark, sf, "orders")
    wk = (F.year("o_orderdate") * 100 + F.month("o_orderdate")).cast("bigint")
    urgent = orders.where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("cust"), wk.alias("wk")).agg(F.max("o_orderkey").alias("last_urgent"))
    attached = asof.attach_asof(spine, {"spend": (spend, ["spend_last3"]), "urgent": (urgent, ["last_urgent"])}, ["cust"], "wk")
    prior = orders.where(F.year("o_orderdate") == 1997).groupBy(F.col("o_custkey").alias("cust")).agg(F.count(F.lit(1)).alias("prev_season_n"))
    return attached.join(prior, "cust", "left").withColumn("spend_last3", steady(F.col("spend_last3")))


@query("""WITH x AS (SELECT p_brand AS brand, min(p_partkey) AS part FROM part GROUP BY 1) SELECT brand, (year(l_shipdate))::BIGINT AS yr, max(l_quantity) AS most FROM lineitem JOIN x ON l_partkey = x.part GROUP BY ALL""")
def crosswalk_inner_max(spark, sf):
    names = dedupe.crosswalk(table(spark, sf, "part"), "p_brand", "p_partkey").select(F.col("p_brand").alias("brand"), F.col("p_partkey").alias("l_partkey"))
    return table(spark, sf, "lineitem").join(names, "l_partkey").groupBy("brand", F.year("l_shipdate").cast("bigint").alias("yr")).agg(F.max("l_quantity").alias("most"))


@query(f"WITH {SM} SELECT supp, wk, qty - lag(qty) OVER w AS diff, {S('CASE WHEN small > 0 THEN qty / small END')} AS ratio, least(qty, small, n) AS lowest FROM sm WINDOW w AS (PARTITION BY supp ORDER BY wk)")
def lag_diff_scalar(spark, sf):
    before = F.lag("qty").over(Window.partitionBy("supp").orderBy("wk"))
    return supplier_month(spark, sf).select("supp", "wk", (F.col("qty") - before).alias("diff"), steady(F.try_divide("qty", "small")).alias("ratio"), F.least("qty", "small", F.col("n").cast("double")).alias("lowest"))


@query("WITH u AS (SELECT DISTINCT k, nation, seg FROM (SELECT s_suppkey AS k, s_nationkey::BIGINT AS nation, NULL::VARCHAR AS seg FROM supplier UNION ALL SELECT c_custkey, c_nationkey::BIGINT, c_mktsegment FROM customer)) SELECT k, nation, seg, row_number() OVER (PARTITION BY nation ORDER BY k, seg NULLS FIRST)::BIGINT AS nth FROM u")
def union_widened_distinct(spark, sf):
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_nationkey").cast("bigint").alias("nation"))
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("k"), F.col("c_nationkey").cast("bigint").alias("nation"), F.col("c_mktsegment").alias("seg"))
    both = suppliers.unionByName(customers, allowMissingColumns=True).distinct()
    return ranks.numbered(both, ["nation"], ["k"], ["k", F.col("seg").asc_nulls_first()], "nth").withColumn("nth", F.col("nth").cast("bigint"))


_CODES = {0: 100, 5: 105, 9: 109}


@query(f"WITH {_SIDES} SELECT CASE cn {' '.join(f'WHEN {a} THEN {b}' for a, b in _CODES.items())} ELSE cn END::INT AS code, count(*)::BIGINT AS n, coalesce(sum(q) FILTER (WHERE sn = cn), 0) AS own_qty FROM l GROUP BY 1")
def two_sides_context(spark, sf):
    """Code fixes by a literal map, and sums over lines with one nation on both sides."""
    code = map_value(F.col("c_nationkey"), _CODES)
    return _lines(spark, sf).groupBy(code.alias("code")).agg(F.count(F.lit(1)).alias("n"), sum0(F.when(F.col("s_nationkey") == F.col("c_nationkey"), F.col("l_quantity"))).alias("own_qty"))


@query(f"WITH {CY}, lags AS (SELECT entity, season + n AS season, n, games FROM cy, range(1, 4) r(n)), u AS (SELECT entity, max(games) FILTER (WHERE n = 1) AS prev1_games, max(games) FILTER (WHERE n = 2) AS prev2_games FROM lags WHERE season = 2002 GROUP BY 1) SELECT c_custkey AS entity, 2002::BIGINT AS season, prev1_games, prev2_games, prev1_games IS NULL AND prev2_games IS NULL AS rookie FROM customer LEFT JOIN u ON c_custkey = entity")
def panel_unplayed_year(spark, sf):
    """The panel of a season without outcomes."""
    spine = table(spark, sf, "customer").select(F.col("c_custkey").alias("entity"), F.lit(2002).cast("bigint").alias("season"))
    made = blocks.upcoming_panel(spine, customer_year(spark, sf).select("entity", "season", "games", "points"), ["entity"], "season", ["points"], lags=[1, 2])
    return made.select("entity", "season", "prev1_games", "prev2_games", F.col("is_rookie").alias("rookie"))


@query(f"WITH {_R1}, m AS (SELECT season, sqrt(avg((pred - points) ** 2)) AS r1, sqrt(avg((mu * gmu - points) ** 2)) AS r0, stddev_samp(points) AS sd, max(points) AS most FROM r1 GROUP BY 1) SELECT season, {S('r1 - r0')} AS gap, {S('sd')} AS sd, {S('most')} AS most FROM m")
def metrics_vs_floor(spark, sf):
    """A projector's error beside the floor's, all scalars of a season in one aggregate."""
    square = lambda p: F.sqrt(F.avg(F.pow(p - F.col("points"), F.lit(2))))
    gap = square(F.col("pred_points")) - square(F.col("mu") * F.col("games_mu"))
    return _rung1(spark, sf).groupBy("season").agg(steady(gap).alias("gap"), steady(F.stddev_samp("points")).alias("sd"), steady(F.max("points")).alias("most"))


@query()
def games_from_trees(spark, sf):
    """Games of the last season from boosted trees on the lags (no SQL form)."""
    panel = _panel(spark, sf)
    features = [f"prev{n}_{c}" for n in (1, 2, 3) for c in ("games", "points")]
    out = P.tree_games(panel.where("season < 2001"), panel.where("season = 2001"), features)
    return out.select("entity", "season", "games", clip(F.col("pred"), 0.0, 17.0).alias("pred_games"))


from . import catalogue_assembly, catalogue_blocks, catalogue_boosting  # noqa: E402, F401  registers further queries
