"""More queries with their SQL: feature blocks, panels and the projection ladder."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.columns import map_value, piecewise_credit, steady
from ..operators import temporal
from ..operators.ranks import overall_rank
from ..sources.tables import empty, table
from . import blocks
from . import projectors as P
from .bases import CM, CY, PANEL, customer_month, customer_year
from .catalogue import _FOLDS, _QUARTERS, _TESTS, S, _panel, _prior_sql, _quarter_spine, query

_ROLLED = (3, 5, 8)


@query("""SELECT cust, segment, season, week, snaps, played FROM (SELECT c_custkey AS cust, CASE c_mktsegment WHEN 'AUTOMOBILE' THEN 'AUTO' ELSE c_mktsegment END AS segment, 2002 AS season, 1 AS week, 0::BIGINT AS snaps, FALSE AS played,
row_number() OVER (PARTITION BY c_custkey ORDER BY c_nationkey) AS nth FROM customer WHERE c_acctbal > 0 AND c_mktsegment IN ('AUTOMOBILE', 'BUILDING', 'MACHINERY')) WHERE nth = 1""")
def preseason_rows(spark, sf):
    """First period of a season that has no games: one unplayed row for each entity on a roster."""
    roster = table(spark, sf, "customer").select(F.col("c_custkey").alias("cust"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("status"), "c_acctbal")
    keep = (F.col("c_acctbal") > 0) & F.col("segment").isin("AUTOMOBILE", "BUILDING", "MACHINERY")
    return blocks.preseason_spine(roster, "cust", 2002, keep, "segment", {"AUTOMOBILE": "AUTO"}).select("cust", "segment", "season", "week", "snaps", "played")


_LOTS = """l AS (SELECT l_suppkey AS supp, s_nationkey AS nation, (year(l_shipdate) * 100 + month(l_shipdate))::BIGINT AS wk, l_quantity AS q, l_returnflag AS f FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""
_ZONES = {"small": "q <= 20", "tiny": "q <= 5"}


def _zone_sql(flag: str, prefix: str) -> str:
    counts = ", ".join(f"count(*) FILTER (WHERE {c}) AS {prefix}_{n}_n" for n, c in _ZONES.items())
    share = ", ".join(f"coalesce({prefix}_{n}_n / nullif(sum({prefix}_{n}_n) OVER (PARTITION BY nation, wk), 0), 0) AS {prefix}_{n}_share" for n in _ZONES)
    return f"{prefix} AS (SELECT supp, wk, {', '.join(f'{prefix}_{n}_n' for n in _ZONES)}, {share} FROM (SELECT supp, nation, wk, {counts} FROM l WHERE f = '{flag}' GROUP BY ALL))"


_ZONE_COLUMNS = [f"{p}_{n}_{k}" for p in ("ret", "acc") for k in ("n", "share") for n in _ZONES]


@query(
    f"WITH {_LOTS}, {_zone_sql('R', 'ret')}, {_zone_sql('A', 'acc')}, z AS (SELECT supp, wk, {', '.join(f'coalesce({c}, 0) AS {c}' for c in _ZONE_COLUMNS)} FROM ret FULL JOIN acc USING (supp, wk))\nSELECT supp, wk, "
    + ", ".join(f"{S(f'avg({c}) OVER (PARTITION BY supp ORDER BY wk ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)')} AS {c}_last{w}" for c in _ZONE_COLUMNS for w in _ROLLED)
    + " FROM z"
)
def small_lot_rolling(spark, sf):
    """Counts and shares of the nation's small lots, two kinds side by side, rolled."""
    suppliers = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("l_suppkey"), F.col("s_nationkey").alias("nation"))
    wk = (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("bigint")
    lots = table(spark, sf, "lineitem").join(suppliers, "l_suppkey").select(F.col("l_suppkey").alias("supp"), "nation", wk.alias("wk"), F.col("l_quantity").alias("q"), "l_returnflag")
    zones = {"small": F.col("q") <= 20, "tiny": F.col("q") <= 5}
    kinds = [blocks.shares(lots.where(F.col("l_returnflag") == flag), "supp", "nation", ["wk"], zones, prefix) for flag, prefix in (("R", "ret"), ("A", "acc"))]
    rolled = blocks.rolled_shares(kinds, "supp", ["wk"], _ROLLED)
    return rolled.select("supp", "wk", *[steady(F.col(f"{c}_last{w}")).alias(f"{c}_last{w}") for c in _ZONE_COLUMNS for w in _ROLLED])


_LINE = ("line_yards", "stuff_rate", "power_success", "sack_rate", "hit_rate")


@query(
    """WITH p AS (SELECT l_suppkey AS supp, (year(l_shipdate) * 100 + month(l_shipdate))::BIGINT AS wk, l_quantity - 10 AS y, l_returnflag <> 'R' AS run, l_returnflag = 'R' AS pass, l_tax <= 0.02 AS power, l_linestatus = 'F' AS won, l_discount > 0.08 AS sack, l_discount > 0.05 AS hit FROM lineitem),
m AS (SELECT supp, wk, avg(CASE WHEN y < 0 THEN 1.2 * y ELSE least(y, 4.0) + 0.5 * (CASE WHEN y - 4 < 0 THEN 0 WHEN y - 4 > 6 THEN 6 ELSE y - 4 END) END) FILTER (WHERE run) AS line_yards, avg((y <= 0)::INT) FILTER (WHERE run) AS stuff_rate, avg(won::INT) FILTER (WHERE run AND power) AS power_success,
avg(sack::INT) FILTER (WHERE pass) AS sack_rate, avg(hit::INT) FILTER (WHERE pass) AS hit_rate FROM p GROUP BY ALL), u AS (SELECT * FROM m UNION ALL SELECT DISTINCT supp, 200201, NULL, NULL, NULL, NULL, NULL FROM m)
SELECT supp, wk, """
    + ", ".join(f"{S(f'avg({c}) OVER (PARTITION BY supp ORDER BY wk ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)')} AS {c}_last{w}" for c in _LINE for w in _ROLLED)
    + " FROM u"
)
def line_measures_rolled(spark, sf):
    """Five filtered means a supplier-month from one aggregate, with the upcoming month, rolled."""
    y, wk = F.col("l_quantity") - 10, (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("bigint")
    lines = table(spark, sf, "lineitem").withColumns({"supp": F.col("l_suppkey"), "wk": wk})
    run, dropback = F.col("l_returnflag") != "R", F.col("l_returnflag") == "R"
    found = blocks.line_measures(lines, "supp", ["wk"], run, piecewise_credit(y), y <= 0, F.col("l_tax") <= 0.02, F.col("l_linestatus") == "F", dropback, F.col("l_discount") > 0.08, F.col("l_discount") > 0.05)
    rolled = blocks.rolled_team(found, "supp", ["wk"], _ROLLED, {"wk": 200201})
    return rolled.select("supp", "wk", *[steady(F.col(f"{c}_last{w}")).alias(f"{c}_last{w}") for c in _LINE for w in _ROLLED])


@query("""WITH e AS (SELECT user_id, ts::DATE AS day, ts, event_id, event_type, value FROM events), a AS (SELECT user_id, day, event_type AS report FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY ts DESC, event_id DESC) AS nth FROM e WHERE event_type <> 'purchase') WHERE nth = 1),
b AS (SELECT user_id, day, floor(value)::BIGINT AS level FROM (SELECT *, row_number() OVER (PARTITION BY user_id, day ORDER BY event_id) AS nth FROM e WHERE event_type = 'purchase') WHERE nth = 1),
r AS (SELECT * FROM a FULL JOIN b USING (user_id, day)), s AS (SELECT u AS user_id, d AS day FROM (SELECT DISTINCT user_id AS u FROM e), (SELECT DISTINCT day AS d FROM e WHERE day <= (SELECT min(day) + 2 FROM e)))
SELECT s.user_id, s.day, coalesce(report, 'Healthy') AS report, level FROM s LEFT JOIN r ON r.user_id = s.user_id AND r.day = s.day""")
def report_full_outer_defaults(spark, sf):
    """Last report and first level side by side; the default comes after the join to the spine."""
    events = table(spark, sf, "events").select("user_id", F.to_date("ts").alias("day"), "ts", "event_id", F.col("event_type").alias("report"), F.floor("value").cast("bigint").alias("level"))
    both = blocks.reports(events.where("report <> 'purchase'"), events.where("report = 'purchase'"), ["user_id", "day"], ["ts", "event_id"], ["report"], ["level"], ["event_id"])
    first = F.broadcast(events.agg(F.min("day").alias("first")))  # a row
    days = F.explode(F.sequence(F.col("first"), F.date_add("first", 2))).alias("day")
    present = events.select("day").distinct()
    spine = events.select("user_id").distinct().withColumn("one", F.lit(1)).join(first.withColumn("one", F.lit(1)), "one").select("user_id", days).join(present, "day", "left_semi")
    return blocks.on_spine(spine, both, ["user_id", "day"], {"report": "Healthy"}).select("user_id", "day", "report", "level")


_SEASONAL = f"""{CY}, snap AS (SELECT c_custkey AS entity, c_mktsegment AS grp, s AS season FROM customer, range(1995, 2002) r(s) WHERE c_acctbal > 0), y AS (SELECT entity, season, games, points, points / games AS ppg FROM cy),
pan AS (SELECT n.*, coalesce(a.games, 0) AS games, coalesce(a.points, 0) AS points, a.ppg, """ + ", ".join(f"p{k}.games AS prev{k}_games, p{k}.points AS prev{k}_points, p{k}.ppg AS prev{k}_ppg" for k in (1, 2, 3)) + " FROM snap n LEFT JOIN y a USING (entity, season) " + " ".join(f"LEFT JOIN y p{k} ON p{k}.entity = n.entity AND p{k}.season = n.season - {k}" for k in (1, 2, 3)) + ")"


@query(
    f"WITH {_SEASONAL} SELECT entity, season, grp, games, {S('points')} AS points, {S('ppg')} AS ppg, {S('prev1_points')} AS prev1_points, {S('prev3_ppg')} AS prev3_ppg, "
    "((prev1_games IS NOT NULL)::INT + (prev2_games IS NOT NULL)::INT + (prev3_games IS NOT NULL)::INT) AS n_prior_seasons, prev1_games IS NULL AND prev2_games IS NULL AND prev3_games IS NULL AS is_rookie FROM pan WHERE prev1_games IS NOT NULL"
)
def panel_lagged(spark, sf):
    """Snapshots with outcomes, three lags and flags, of the cohort that played the season before."""
    seasons = F.explode(F.sequence(F.lit(1995).cast("bigint"), F.lit(2001).cast("bigint"))).alias("season")
    snapshot = table(spark, sf, "customer").where("c_acctbal > 0").select(F.col("c_custkey").alias("entity"), F.col("c_mktsegment").alias("grp"), seasons)
    built = blocks.panel(snapshot, customer_year(spark, sf).drop("grp"), ["entity"], "season", ["points"])
    shown = {c: steady(F.col(c)) for c in ("points", "ppg", "prev1_points", "prev3_ppg")}
    return P.cohort(built, "history").withColumns(shown).select("entity", "season", "grp", "games", "points", "ppg", "prev1_points", "prev3_ppg", "n_prior_seasons", "is_rookie")


@query(f"WITH {_FOLDS} SELECT p.entity, p.season, {S('mu')} AS pred_ppg, {S('CASE WHEN gmu > 17 THEN 17 ELSE gmu END')} AS pred_games, {S('mu * CASE WHEN gmu > 17 THEN 17 ELSE gmu END - points')} AS miss FROM panel p JOIN mu ON fold = season AND mu.grp = p.grp")
def segment_mean_rung0(spark, sf):
    """Every group's mean, from seasons before the fold's, beside what came."""
    out = P.segment_means(_panel(spark, sf), _TESTS)
    return out.select("entity", "season", steady(F.col("pred_ppg")).alias("pred_ppg"), steady(F.col("pred_games")).alias("pred_games"), steady(F.col("pred_points") - F.col("points")).alias("miss"))


_E543 = {c: " + ".join(f"{w}.0 * coalesce(prev{n}_{c}, 0)" for n, w in enumerate((5, 4, 3), 1)) for c in ("games", "points")}


@query(f"""WITH {PANEL}, tr AS (SELECT * FROM panel WHERE season < 2001), mu AS (SELECT grp, sum(points) / sum(games) AS mu FROM tr GROUP BY 1),
e AS (SELECT k, avg((CASE WHEN {_E543["games"]} + k > 0 THEN ({_E543["points"]} + k * mu) / ({_E543["games"]} + k) ELSE mu END - points / games) ** 2 * games) AS e FROM tr JOIN mu USING (grp), (VALUES {", ".join(f"({k})" for k in P.EFFICIENCY_GRID)}) v(k) WHERE games > 0 GROUP BY 1),
b AS (SELECT arg_min(k, (e, k)) AS k FROM e) SELECT entity, season, {S(f"CASE WHEN {_E543['games']} + k > 0 THEN ({_E543['points']} + k * mu) / ({_E543['games']} + k) ELSE mu END")} AS efficiency FROM panel JOIN mu USING (grp), b WHERE season = 2001""")
def efficiency_shrunk(spark, sf):
    """Points an opportunity, shrunk by the constant whose errors, counted by opportunities, are least."""
    panel = _panel(spark, sf)
    out = P.efficiency(panel.where("season = 2001"), panel.where("season < 2001"), "points", "games")
    return out.select("entity", "season", steady(F.col("efficiency")).alias("efficiency"))


@query(f"""WITH {CY}, share AS (SELECT month(o_orderdate)::BIGINT AS mo, count(*) * 12.0 / sum(count(*)) OVER () AS factor FROM orders WHERE year(o_orderdate) = 1999 GROUP BY 1), last AS (SELECT * FROM cy WHERE season = 1999),
g AS (SELECT entity, sum(points / games * factor) AS total, count(*) AS n FROM last, share GROUP BY 1), s AS (SELECT entity, CASE WHEN games > 17 THEN 17 ELSE games END AS games FROM last)
SELECT entity, games AS pred_games, {S("CASE WHEN games > 0 THEN total * games / n / games ELSE 0 END")} AS pred_ppg, {S("CASE WHEN games > 0 THEN total * games / n ELSE 0 END")} AS pred_points FROM s JOIN g USING (entity)""")
def season_from_calendar(spark, sf):
    """A prediction for each month of the calendar, summed, scaled to the expected games, and back to a rate."""
    orders = table(spark, sf, "orders").where(F.year("o_orderdate") == 1999)
    months = orders.groupBy(F.month("o_orderdate").cast("bigint").alias("mo")).agg(F.count(F.lit(1)).alias("n"))
    every = F.broadcast(months.agg(F.collect_list(F.col("n") * 12.0).alias("__m"), F.sum("n").alias("__all")).withColumn("one", F.lit(1)))  # a row
    last = customer_year(spark, sf).where("season = 1999").withColumn("one", F.lit(1))
    games = last.join(every, "one").select("entity", "points", "games", "__all", F.explode("__m").alias("m")).select("entity", (F.col("points") / F.col("games") * F.col("m") / F.col("__all")).alias("game_points"))
    out = P.season_from_games(games, last.select("entity", F.col("games").alias("pred_games")), ["entity"])
    return out.select("entity", "pred_games", steady(F.col("pred_ppg")).alias("pred_ppg"), steady(F.col("pred_points")).alias("pred_points"))


_LADDER = f"{_FOLDS}, {_prior_sql('r1', (1.0, 0.0, 0.0))}, {_prior_sql('r2', (5.0, 4.0, 3.0))}, r0 AS (SELECT *, mu AS ppg, CASE WHEN gmu > 17 THEN 17 ELSE gmu END AS g, mu * CASE WHEN gmu > 17 THEN 17 ELSE gmu END AS pred FROM r1_raw)"
_SCORED = " UNION ALL ".join(f"SELECT '{n}' AS projector, season, ppg, g, pred, points, games FROM {t} WHERE prev1_games IS NOT NULL" for n, t in (("segment_mean", "r0"), ("last_season_regressed", "r1"), ("weighted_prior", "r2")))


@query(
    f"WITH {_LADDER}, s AS ({_SCORED}), t AS ("
    + " UNION ALL ".join(f"SELECT projector, season, '{n}' AS target, {p} AS p, {a} AS a FROM s" for n, p, a in (("points", "pred", "points"), ("ppg", "ppg", "points / games"), ("games", "g", "games")))
    + f") SELECT projector, season, target, count(*)::BIGINT AS n, {S('sqrt(avg((p - a) ** 2))')} AS rmse, {S('avg(abs(p - a))')} AS mae FROM t GROUP BY ALL"
)
def walk_forward_ladder(spark, sf):
    """Every projector of the default ladder on every fold, scored on points, rate and games, on rows with history."""
    history = _panel(spark, sf).withColumn("has_history", F.col("prev1_games").isNotNull())
    scored = P.score_folds(P.run_walk_forward(history, _TESTS))
    return scored.select("projector", "season", "target", "n", steady(F.col("rmse")).alias("rmse"), steady(F.col("mae")).alias("mae"))


@query(f"""WITH {CY}, a AS (SELECT entity, grp, points AS pred, 'expert' AS source FROM cy WHERE season = 2000 AND games >= 4), b AS (SELECT entity, grp, points, 'model' FROM cy WHERE season = 1999 AND entity NOT IN (SELECT entity FROM a)),
u AS (SELECT * FROM a UNION ALL SELECT * FROM b), r AS (SELECT *, row_number() OVER (ORDER BY pred DESC, entity) AS rank FROM u)
SELECT entity, source, {S("pred")} AS pred, rank::BIGINT AS rank, row_number() OVER (PARTITION BY grp ORDER BY rank)::BIGINT AS group_rank FROM r WHERE rank <= 200""")
def draft_board(spark, sf):
    """The board: the first source's rows, then the second's that it lacks, with overall and group ranks."""
    base = customer_year(spark, sf)
    expert = base.where("season = 2000 AND games >= 4").select("entity", "grp", F.col("points").alias("pred"), F.lit("expert").alias("source"))
    model = base.where("season = 1999").select("entity", "grp", F.col("points").alias("pred"), F.lit("model").alias("source"))
    out = P.board([expert, model], ["entity"], [F.col("pred").desc(), "entity"], most=200)
    return out.select("entity", "source", steady(F.col("pred")).alias("pred"), F.col("rank").cast("bigint").alias("rank"), F.col("group_rank").cast("bigint").alias("group_rank"))


@query(f"WITH {CY}, f AS (SELECT o_custkey AS cust, year(o_orderdate)::BIGINT AS yr, month(o_orderdate)::BIGINT AS week, count(*)::BIGINT AS n FROM orders WHERE month(o_orderdate) = 1 GROUP BY ALL) SELECT cust, yr, n FROM f")
def first_period_snapshot(spark, sf):
    """The whole first-month row of each entity-season."""
    months = customer_month(spark, sf).withColumn("week", F.col("mo"))
    return blocks.first_period(months, ["cust"], "yr", "week", ["wk"]).select("cust", "yr", "n")


@query("SELECT r.r_name AS region, n.n_name AS nation, NULL::DOUBLE AS rank_ecr, NULL::BIGINT AS n_rankers FROM nation n JOIN region r ON n_regionkey = r_regionkey")
def missing_source_typed_empty(spark, sf):
    """A source without files is an empty table with its whole schema, so the join still gives its columns."""
    ranks = empty(spark, "nation string, rank_ecr double, n_rankers bigint")
    nations = table(spark, sf, "nation").join(table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("r_name").alias("region"), F.col("n_name").alias("nation"))
    return nations.join(ranks, "nation", "left").select("region", "nation", "rank_ecr", "n_rankers")


@query("SELECT c_custkey, c_acctbal, c_nationkey FROM customer WHERE c_acctbal > 9000")
def columns_by_name(spark, sf):
    """Key, balance and nation columns chosen by how their names start and end."""
    customers = table(spark, sf, "customer")
    return customers.where("c_acctbal > 9000").select(*P.columns_like(customers, first=["c_acct"], last=["key"]))


@query(f"WITH {PANEL}, x AS (SELECT * FROM panel WHERE season = 2000), o AS (SELECT entity, points, row_number() OVER (ORDER BY hash_order) AS nth, count(*) OVER () AS n FROM (SELECT entity, points, md5(entity::VARCHAR) AS hash_order FROM x)) SELECT a.entity, {S('b.points')} AS shuffled FROM o a JOIN o b ON b.nth = a.nth % a.n + 1")
def permuted_column(spark, sf):
    """Each entity gets another's points: neighbours in the order of a hash, so runs agree and nothing is drawn."""
    base = customer_year(spark, sf).where("season = 2000").select("entity", "points")
    return P.permuted(base, "entity", "points", "shuffled").select("entity", steady(F.col("shuffled")).alias("shuffled"))


@query()
def tree_gains(spark, sf):
    """The features of the games model by gain, the greatest first (no SQL form)."""
    features = [f"prev{n}_{c}" for n in (1, 2, 3) for c in ("games", "points")]
    model = P.fit_trees(_panel(spark, sf).where("season < 2001"), features, rounds=10)
    return spark.createDataFrame(P.importances(model, features), "feature string, gain double")


@query("SELECT s_suppkey AS supp, CASE WHEN s_nationkey = 3 THEN 103 ELSE s_nationkey END::INT AS code, count(*)::BIGINT AS n FROM supplier JOIN lineitem ON l_suppkey = s_suppkey WHERE l_linenumber IN (1, 2) AND l_quantity <= 30 AND abs(round(l_discount * 200) - 10) <= 7 GROUP BY ALL")
def neutral_rows(spark, sf):
    """The shared neutral predicate over lines."""
    d = F.round(F.col("l_discount") * 200) - 10
    lines = table(spark, sf, "lineitem").where(blocks.neutral(F.col("l_linenumber"), F.col("l_quantity") / 10, d))
    joined = lines.join(table(spark, sf, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return joined.groupBy(F.col("s_suppkey").alias("supp"), map_value(F.col("s_nationkey"), {3: 103}).cast("int").alias("code")).agg(F.count(F.lit(1)).alias("n"))


#: Aggregates of a supplier's month, in words that both engines read.
_OPPORTUNITY = {
    "qty": "sum(l_quantity)",
    "lots": "count(*)",
    "small_lots": "count(*) FILTER (WHERE l_quantity <= 20)",
    "small_share": "avg(CAST(CASE WHEN l_quantity <= 20 THEN 1 ELSE 0 END AS DOUBLE))",
    "returned": "coalesce(sum(l_quantity) FILTER (WHERE l_returnflag = 'R'), 0)",
    "parts": "count(DISTINCT l_partkey)",
    "largest": "max(l_quantity)",
}
_TENDENCIES = {
    "pace": "count(*)",
    "pass_rate": "avg(CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE))",
    "neutral_pass_rate": "avg(CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE)) FILTER (WHERE l_linenumber IN (1, 2) AND l_quantity <= 30)",
    "early_pass_rate": "avg(CAST(CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS DOUBLE)) FILTER (WHERE l_linenumber = 1)",
    "small_rate": "avg(CAST(CASE WHEN l_quantity <= 20 THEN 1 ELSE 0 END AS DOUBLE))",
    "no_discount_rate": "avg(CAST(CASE WHEN l_discount = 0 THEN 1 ELSE 0 END AS DOUBLE))",
    "taxed": "avg(l_tax) FILTER (WHERE l_tax > 0)",
    "parts": "count(DISTINCT l_partkey)",
    "depth": "avg(l_quantity) FILTER (WHERE l_returnflag = 'R')",
}
_KINDS = {"rush": "l_returnflag = 'N'", "pass": "l_returnflag = 'A'"}
_CONCEDED = {
    **{f"{k}_{n}": f"{a} FILTER (WHERE {c})" for k, c in _KINDS.items() for n, a in (("n", "count(*)"), ("qty", "sum(l_quantity)"), ("mean", "avg(l_quantity)"), ("cents", "sum(round(l_extendedprice * 100))"), ("won", "avg(CAST(CASE WHEN l_linestatus = 'F' THEN 1 ELSE 0 END AS DOUBLE))"))},
    **{f"seg{d}_qty": f"coalesce(sum(l_quantity) FILTER (WHERE l_linenumber = {d}), 0)" for d in (1, 2, 3, 4)},
    "n": "count(*)",
    "qty": "sum(l_quantity)",
    "funnel": "avg(l_discount) FILTER (WHERE l_returnflag = 'A') - avg(l_discount) FILTER (WHERE l_returnflag = 'N')",
}


def _month_sql(measures: dict[str, str]) -> str:
    own = ", ".join(f"({a})::DOUBLE AS {n}" for n, a in measures.items())
    return f"m AS (SELECT l_suppkey AS supp, year(l_shipdate)::BIGINT AS yr, (year(l_shipdate) * 100 + month(l_shipdate))::BIGINT AS wk, {own} FROM lineitem GROUP BY ALL)"


def _months(spark, sf, measures: dict[str, str]):
    keys = [F.col("l_suppkey").alias("supp"), F.year("l_shipdate").cast("bigint").alias("yr"), (F.year("l_shipdate") * 100 + F.month("l_shipdate")).cast("bigint").alias("wk")]
    return table(spark, sf, "lineitem").groupBy(*keys).agg(*[F.expr(a).cast("double").alias(n) for n, a in measures.items()])


def _shown(df, columns):
    return [(steady(F.col(f"{c}_last{w}")) + 0.0).alias(f"{c}_last{w}") for c in columns for w in _ROLLED]  # no negative zero


@query(
    f"WITH {_month_sql(_OPPORTUNITY)} SELECT supp, wk, "
    + ", ".join(f"{S(f'avg({c}) OVER (PARTITION BY supp ORDER BY wk ROWS BETWEEN {w - 1} PRECEDING AND CURRENT ROW)')} AS {c}_last{w}" for c in _OPPORTUNITY for w in _ROLLED)
    + ", "
    + ", ".join(f"CASE WHEN {c} IS NOT NULL THEN {S(f'sum({c}) OVER s / row_number() OVER s')} END AS {c}_std" for c in _OPPORTUNITY)
    + " FROM m WINDOW s AS (PARTITION BY supp, yr ORDER BY wk)"
)
def opportunity_rolled(spark, sf):
    """Seven measures, rolled over three windows and to date."""
    base = temporal.inclusive_mean(_months(spark, sf, _OPPORTUNITY), ["supp"], ["wk"], list(_OPPORTUNITY), _ROLLED)
    out = temporal.to_date_mean(base, ["supp"], "yr", ["wk"], list(_OPPORTUNITY))
    return out.select("supp", "wk", *_shown(out, _OPPORTUNITY), *[steady(F.col(f"{c}_std")).alias(f"{c}_std") for c in _OPPORTUNITY])


def _profile_sql(measures: dict[str, str], prefix: str) -> str:
    trailing = ", ".join(f"{S(f'avg({c}) OVER (PARTITION BY supp ORDER BY wk ROWS BETWEEN {w} PRECEDING AND 1 PRECEDING)')} + 0.0 AS {c}_last{w}" for c in measures for w in _ROLLED)
    means = ", ".join(f"avg({c}) AS {c}" for c in measures)
    return f"""WITH {_month_sql(measures)}, u AS (SELECT * FROM m UNION ALL SELECT DISTINCT supp, 2002, 200201, {", ".join(["NULL"] * len(measures))} FROM m), r AS (SELECT supp, yr, wk, {trailing} FROM u),
y AS (SELECT supp, yr + 1 AS yr, {means} FROM m GROUP BY ALL) SELECT r.*, {", ".join(f"{S(f'y.{c}')} + 0.0 AS {prefix}{c}" for c in measures)} FROM r LEFT JOIN y USING (supp, yr)"""


def _profile(spark, sf, measures: dict[str, str], prefix: str):
    months = _months(spark, sf, measures)
    rolled = blocks.rolled_team(months, "supp", ["yr", "wk"], _ROLLED, {"yr": 2002, "wk": 200201})
    out = rolled.join(blocks.next_season_profile(months, ["supp"], "yr", list(measures), prefix), ["supp", "yr"], "left")
    return out.select("supp", "yr", "wk", *_shown(out, measures), *[(steady(F.col(prefix + c)) + 0.0).alias(prefix + c) for c in measures])


@query(_profile_sql(_TENDENCIES, "prev_season_"))
def tendencies_rolled(spark, sf):
    """Nine tendencies of a supplier's month, with the upcoming one, rolled, and last year's means."""
    return _profile(spark, sf, _TENDENCIES, "prev_season_")


@query(_profile_sql(_CONCEDED, "prev_season_opp_"))
def conceded_profile(spark, sf):
    """Seventeen measures of what a side gives up, rolled over three windows, and last year's profile."""
    return _profile(spark, sf, _CONCEDED, "prev_season_opp_")


@query(f"WITH {_LADDER}, s AS ({_SCORED}), f AS (SELECT projector, season, sqrt(avg((pred - points) ** 2)) AS rmse, avg(abs(pred - points)) AS mae, count(*) AS n FROM s GROUP BY ALL) SELECT projector, sum(n)::BIGINT AS n, {S('avg(rmse)')} AS rmse, {S('avg(mae)')} AS mae, row_number() OVER (ORDER BY avg(rmse))::BIGINT AS place FROM f GROUP BY 1")
def ladder_summary(spark, sf):
    """The leaderboard: mean errors over folds, best first."""
    history = _panel(spark, sf).withColumn("has_history", F.col("prev1_games").isNotNull())
    means = P.summarise(P.score_folds(P.run_walk_forward(history, _TESTS)).where("target = 'points'"))
    placed = overall_rank(means, ["rmse"], "place")
    return placed.select("projector", "n", steady(F.col("rmse")).alias("rmse"), steady(F.col("mae")).alias("mae"), F.col("place").cast("bigint").alias("place"))


@query(f"WITH {CM}, {_QUARTERS}, lab AS (SELECT o_custkey AS cust, year(o_orderdate)::BIGINT AS yr, quarter(o_orderdate)::BIGINT AS qt, sum(o_totalprice) AS total FROM orders WHERE o_orderstatus <> 'P' GROUP BY ALL), w AS (SELECT cust, yr, qt, played, CASE WHEN played = 0 THEN 0 ELSE total END AS y FROM sp LEFT JOIN lab USING (cust, yr, qt)) SELECT cust, yr, sum(played)::BIGINT AS games, {S('sum(played) / 4')} AS games_rate, round(coalesce(sum(y), 0) + 1e-7, 2) AS y, round(sum(y) / nullif(sum(played), 0) + 1e-7, 2) AS y_per_game FROM w GROUP BY ALL")
def season_labels_of_weeks(spark, sf):
    """Games, share of the schedule, totals and means a game played, from labels of quarters."""
    spine = _quarter_spine(spark, sf).withColumn("played", F.col("played") == 1)
    orders = table(spark, sf, "orders").where("o_orderstatus <> 'P'")
    stats = orders.groupBy(F.col("o_custkey").alias("cust"), F.year("o_orderdate").cast("bigint").alias("yr"), F.quarter("o_orderdate").cast("bigint").alias("qt")).agg(F.sum("o_totalprice").alias("y"))
    weekly = blocks.weekly_labels(spine, stats, ["cust", "yr", "qt"], ["y"])
    out = blocks.season_labels(weekly, spine, ["cust", "yr"], ["cust", "yr", "qt"], ["y"], F.lit(4))
    return out.select("cust", "yr", "games", steady(F.col("games_rate")).alias("games_rate"), F.round(F.col("y") + 1e-7, 2).alias("y"), F.round(F.col("y_per_game") + 1e-7, 2).alias("y_per_game"))
