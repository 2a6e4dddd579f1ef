"""Feature blocks and panels over caller's tables: each takes frames and column names, and gives one keyed frame."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.columns import avg_if, map_value, rate
from ..operators import asof, dedupe, priors, temporal


def neutral(down: Column, quarter: Column, difference: Column, most: float = 7) -> Column:
    """Early downs of the first three quarters with both sides within ``most`` points."""
    return down.isin(1, 2) & (quarter <= 3) & (F.abs(difference) <= most)


def preseason_spine(rosters: DataFrame, entity: str, season: int, keep: Column, team: str | None = None, teams: Mapping | None = None, status: str = "status") -> DataFrame:
    """A synthetic first period of a season without games: one row an entity that ``keep`` lets in, none played.

    Of an entity's several rows the one with the least ``status`` stays.
    """
    rows = rosters.where(keep & F.col(entity).isNotNull())
    if team and teams:
        rows = rows.withColumn(team, map_value(F.col(team), teams))
    one = dedupe.keep_first(rows, [entity], [status, *[c for c in rows.columns if c not in (entity, status)]])
    return one.withColumns({"season": F.lit(season), "week": F.lit(1), "snaps": F.lit(0).cast("bigint"), "played": F.lit(False)})


def weekly_spine(rosters: DataFrame, snaps: DataFrame, names: DataFrame, entity: str, source: str, period: Sequence[str], keep: Column, status: str, count: str, team: str | None = None, teams: Mapping | None = None) -> DataFrame:
    """One row an entity and period that ``keep`` lets in, with ``count`` and whether it ``played``.

    Of several rows the one with the least ``status`` stays. Participation comes by
    another id: ``names`` (``entity, source``) translates it, one entity for each
    source; of several counts the greatest is taken, and none is 0.
    """
    rows = rosters.where(keep & F.col(entity).isNotNull())
    if team and teams:
        rows = rows.withColumn(team, map_value(F.col(team), teams))
    key = [entity, *period]
    one = dedupe.keep_first(rows, key, [status, *[c for c in rows.columns if c not in (*key, status)]])
    counts = snaps.join(dedupe.crosswalk(names, source, entity), source).groupBy(*key).agg(F.max(count).alias(count))
    joined = one.join(counts, key, "left").withColumn(count, F.coalesce(count, F.lit(0)))
    return joined.withColumn("played", F.col(count) > 0)


def shares(rows: DataFrame, entity: str, team: str, period: Sequence[str], flags: Mapping[str, Column], prefix: str) -> DataFrame:
    """``{prefix}_{flag}_n`` and ``{prefix}_{flag}_share``: an entity's flagged rows in each period and their share of its team's; 0 where the team has none."""
    counts = rows.groupBy(entity, team, *period).agg(*[F.sum(c.cast("bigint")).alias(f"{prefix}_{n}_n") for n, c in flags.items()])
    totals = counts.groupBy(team, *period).agg(*[F.sum(f"{prefix}_{n}_n").alias(f"__{n}") for n in flags])
    joined = counts.join(totals, [team, *period])
    return joined.select(entity, *period, *[F.col(f"{prefix}_{n}_n") for n in flags], *[F.coalesce(F.try_divide(f"{prefix}_{n}_n", f"__{n}"), F.lit(0.0)).alias(f"{prefix}_{n}_share") for n in flags])


def rolled_shares(kinds: Sequence[DataFrame], entity: str, period: Sequence[str], windows: Sequence[int] = (3, 5, 8)) -> DataFrame:
    """Several kinds of shares side by side: an absent kind is a real 0, then inclusive means over the entity's periods; raw columns go."""
    out = kinds[0]
    for more in kinds[1:]:
        out = out.join(more, [entity, *period], "full")
    values = [c for c in out.columns if c not in (entity, *period)]
    rolled = temporal.inclusive_mean(out.fillna(0, values), [entity], period, values, windows)
    return rolled.drop(*values)


def line_measures(plays: DataFrame, team: str, period: Sequence[str], runs: Column, credit: Column, stuffed: Column, power: Column, converted: Column, dropbacks: Column, sack: Column, hit: Column) -> DataFrame:
    """Five measures a team-period: mean credit, stuff rate and power success of runs, sack and hit rate of dropbacks; null where nothing was tried."""
    return plays.groupBy(team, *period).agg(
        avg_if(credit, runs).alias("line_yards"),
        rate(F.when(runs, stuffed)).alias("stuff_rate"),
        rate(F.when(runs & power, converted)).alias("power_success"),
        rate(F.when(dropbacks, sack)).alias("sack_rate"),
        rate(F.when(dropbacks, hit)).alias("hit_rate"),
    )


def rolled_team(measures: DataFrame, team: str, period: Sequence[str], windows: Sequence[int] = (3, 5, 8), upcoming: Mapping[str, int] | None = None) -> DataFrame:
    """Means of the periods before, with a placeholder row for an upcoming one; raw columns go, as they tell of the period itself."""
    values = [c for c in measures.columns if c not in (team, *period)]
    if upcoming:
        measures = temporal.with_upcoming(measures, [team], dict(upcoming))
    return temporal.trailing_mean(measures, [team], period, values, windows).drop(*values)


def reports(first: DataFrame, second: DataFrame, key: Sequence[str], stamp: Sequence[str], first_columns: Sequence[str], second_columns: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The last-dated row of one source and the first by ``order`` of another, side by side for every key that either has."""
    last = dedupe.last_by(first, key, stamp, first_columns)
    one = dedupe.keep_first(second, key, order).select(*key, *second_columns)
    return last.join(one, list(key), "full")


def on_spine(spine: DataFrame, block: DataFrame, key: Sequence[str], defaults: Mapping[str, object]) -> DataFrame:
    """``block`` joined to the spine; ``defaults`` fill what is absent only once it stands on a known row."""
    joined = spine.join(block, list(key), "left")
    return joined.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in defaults.items()})


def panel(snapshot: DataFrame, actuals: DataFrame, by: Sequence[str], season: str, totals: Sequence[str], games: str = "games", points: str = "points", experience: Column | None = None, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """One row a snapshot row, with its season's outcome, the outcomes of seasons before, and flags.

    Who never appeared has 0 in every total and no rate. ``experience`` 0 marks a
    rookie; without it, no earlier outcome does. Lags come from outcomes, whether
    or not the entity had a snapshot then.
    """
    rated = actuals.withColumn("ppg", F.try_divide(points, F.nullif(F.col(games).cast("double"), F.lit(0.0))))
    joined = snapshot.join(rated, [*by, season], "left")
    joined = joined.withColumns({c: F.coalesce(c, F.lit(0).cast(dict(actuals.dtypes)[c])) for c in (games, *totals)})
    return _lagged(joined, rated, by, season, [games, *totals, "ppg"], experience, lags)


def upcoming_panel(snapshot: DataFrame, actuals: DataFrame, by: Sequence[str], season: str, totals: Sequence[str], games: str = "games", points: str = "points", experience: Column | None = None, lags: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """The panel of a season that hasn't been played: lags and flags, and no outcome, not even 0. An empty snapshot raises."""
    if snapshot.isEmpty():
        raise ValueError("the snapshot of the upcoming season has no rows")
    rated = actuals.withColumn("ppg", F.try_divide(points, F.nullif(F.col(games).cast("double"), F.lit(0.0))))
    return _lagged(snapshot.dropDuplicates([*by, season]), rated, by, season, [games, *totals, "ppg"], experience, lags)


def _lagged(joined: DataFrame, rated: DataFrame, by: Sequence[str], season: str, columns: Sequence[str], experience: Column | None, lags: Sequence[int]) -> DataFrame:
    """``prev{n}_{column}`` of the seasons before, ``n_prior_seasons, has_history, is_rookie``."""
    games = columns[0]
    for n in lags:
        earlier = rated.select(*by, (F.col(season) + n).alias(season), *[F.col(c).alias(f"prev{n}_{c}") for c in columns])
        joined = joined.join(earlier, [*by, season], "left")
    known = sum((F.col(f"prev{n}_{games}").isNotNull().cast("int") for n in lags), F.lit(0))
    rookie = known == 0 if experience is None else F.coalesce(experience == 0, F.lit(False))
    return joined.withColumns({"n_prior_seasons": known, "has_history": F.col(f"prev{lags[0]}_{games}").isNotNull(), "is_rookie": rookie})


def game_script(rows: DataFrame, period: Sequence[str], kinds: Mapping[str, tuple[Column, str]], difference: Column, margin: float, entity: str = "entity", windows: Sequence[int] = (3, 5, 8)) -> DataFrame:
    """Shares of each kind's rows while far behind, far ahead and close, and the mean difference, as inclusive means over the entity's periods.

    ``kinds`` names a condition and the column of who took part. Rows without
    either or without a difference don't count; a kind that a period lacks is null.
    """
    out = None
    for name, (which, who) in kinds.items():
        some = rows.where(which & F.col(who).isNotNull() & difference.isNotNull())
        share = lambda c: F.avg(c.cast("double"))
        own = some.groupBy(F.col(who).alias(entity), *period).agg(
            F.avg(difference).alias(f"{name}_mean_difference"),
            share(difference <= -margin).alias(f"{name}_share_behind"),
            share(difference >= margin).alias(f"{name}_share_ahead"),
            share((difference > -margin) & (difference < margin)).alias(f"{name}_share_close"),
        )
        out = own if out is None else out.join(own, [entity, *period], "full")
    values = [c for c in out.columns if c not in (entity, *period)]
    return temporal.inclusive_mean(out, [entity], period, values, windows).drop(*values)


def first_period(features: DataFrame, by: Sequence[str], season: str, week: str, order: Sequence[str]) -> DataFrame:
    """The whole row of the first week of each entity-season: what is known before the season."""
    return dedupe.keep_first(features.where(F.col(week) == 1), [*by, season], order)


def next_season_profile(rows: DataFrame, by: Sequence[str], season: str, columns: Sequence[str], prefix: str) -> DataFrame:
    """Means over a season, keyed by the season after."""
    return priors.next_season(rows.groupBy(*by, season).agg(*[F.avg(c).alias(c) for c in columns]), season, columns, prefix)


def feature_table(spine: DataFrame, entity: Sequence[str], period: str, season: str, asof_blocks: Mapping[str, tuple[DataFrame, Sequence[str]]], equal_blocks: Sequence[DataFrame] = (), prior_blocks: Sequence[DataFrame] = (), defaults: Mapping[str, object] | None = None) -> DataFrame:
    """One row a spine row: the newest of each ``asof_blocks`` strictly before its period (all in one pass), ``equal_blocks`` of the very period (known before it), ``prior_blocks`` of its season (means of the one before), and defaults where these left nothing."""
    out = asof.attach_asof(spine, dict(asof_blocks), entity, period) if asof_blocks else spine
    for block in equal_blocks:
        out = out.join(block, [*(c for c in (*entity, period) if c in block.columns)], "left")
    for block in prior_blocks:
        out = out.join(block, [*(c for c in (*entity, season) if c in block.columns)], "left")
    return out.withColumns({c: F.coalesce(c, F.lit(v)) for c, v in (defaults or {}).items()})


def weekly_labels(spine: DataFrame, stats: DataFrame, key: Sequence[str], targets: Sequence[str], played: str = "played") -> DataFrame:
    """Targets of each spine row: 0 for who didn't play, null for who did but has no row of stats."""
    joined = spine.join(stats.select(*key, *targets), list(key), "left")
    return joined.select(*key, *[F.when(~F.col(played), F.lit(0.0)).otherwise(F.col(c)).alias(c) for c in targets])


def season_labels(weekly: DataFrame, spine: DataFrame, by: Sequence[str], key: Sequence[str], targets: Sequence[str], scheduled: Column, played: str = "played") -> DataFrame:
    """Games, their share of the schedule, totals (0 where all labels are null), and means a game played (null for no games, or where all labels are null)."""
    joined = weekly.join(spine.select(*key, played), list(key))
    sums = joined.groupBy(*by).agg(F.sum(F.col(played).cast("bigint")).alias("games"), *[F.sum(c).alias(c) for c in targets])
    totals = [F.coalesce(c, F.lit(0.0)).alias(c) for c in targets]
    means = [F.try_divide(c, F.nullif(F.col("games"), F.lit(0))).alias(f"{c}_per_game") for c in targets]
    return sums.select(*by, "games", *totals, (F.col("games") / scheduled).alias("games_rate"), *means)


def prior_features(entities: DataFrame, picks: DataFrame, entity: str, born: str, start: Column, experience: str, pick: str, round_: str, last_pick: int = 300, last_round: int = 8) -> DataFrame:
    """Age in years at ``start``, experience, and where the entity was picked; who never was stands after the last pick, with a flag."""
    best = picks.groupBy(entity).agg(F.min(pick).alias(pick), F.min(round_).alias(round_))
    joined = entities.join(best, entity, "left")
    age = (F.datediff(start, F.to_date(F.col(born))) / 365.25).alias("age_years")
    return joined.select(entity, age, F.col(experience).alias("years_exp"), F.coalesce(pick, F.lit(last_pick)).alias(pick), F.coalesce(round_, F.lit(last_round)).alias(round_), F.col(pick).isNull().alias("is_undrafted"))


def availability(spine: DataFrame, by: Sequence[str], season: str, scheduled: Column, played: str = "played") -> DataFrame:
    """Last season's games, weeks on a roster and share of the schedule, keyed by the season after."""
    sums = spine.groupBy(*by, season).agg(F.sum(F.col(played).cast("bigint")).alias("games"), F.count(F.lit(1)).alias("roster_weeks"))
    rated = sums.withColumn("availability_rate", F.col("games") / scheduled)
    return priors.next_season(rated, season, ["games", "roster_weeks", "availability_rate"])


def attach_snapshot(base: DataFrame, archive: DataFrame, key: Sequence[str], stamp: str, cutoff: Column, columns: Sequence[str]) -> DataFrame:
    """``base`` with ``columns`` of the newest row of ``archive`` that is not after ``cutoff``; every row of ``base`` stays."""
    newest = dedupe.last_by(archive.where(F.col(stamp) <= cutoff), key, [stamp], columns)
    return base.join(newest, list(key), "left")
