"""``python -m cutline``: pull sources, assemble features, score the ladder, check a run, project a season, make a board."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .plans import checks, learned
from .plans import projectors as P
from .sources import buckets, tables


def seasons_of(args: argparse.Namespace) -> list[int]:
    return args.seasons or list(range(args.start, args.end + 1))


def ingest(spark: SparkSession, args: argparse.Namespace) -> int:
    """Curate raw parquet tables of ``--raw``, each to a file of its own; those with a season column by season."""

    def step(name: str):
        def read(seasons: list[int]):
            df = tables.table(spark, args.raw, name)
            return df.where(F.col("season").isin(seasons)) if "season" in df.columns else df

        return lambda: tables.pull(read, f"{args.out}/{name}.parquet", seasons_of(args))

    status = tables.ingest(spark, {n: step(n) for n in args.tables}, args.out, skip=args.skip)
    for name, what in status.items():
        print(f"{name}: {what}")
    return tables.exit_code(status)


def score(spark: SparkSession, args: argparse.Namespace) -> int:
    """Walk forward over a panel file; predictions go to ``--out``, the summary to the console, and the checks decide the exit code."""
    panel = spark.read.parquet(args.panel)
    known = sorted(r[0] for r in panel.select("season").distinct().collect())
    tests = known[args.least :]
    ladder = P.default_ladder()
    chosen = {n: ladder[n] for n in args.projectors or ladder}
    P.run_walk_forward(panel, tests, chosen, args.cohort, args.common).write.mode("overwrite").parquet(args.out)
    predictions = spark.read.parquet(args.out)
    scored = P.score_folds(predictions)
    print(tables.console(P.summarise(scored).orderBy("target", "rmse"), 100, 3))
    failed = checks.gate(checks.standard(panel, predictions, scored, next(iter(chosen))))
    for name, n in failed.items():
        print(f"{name}: {n or 'fine'}")
    return int(any(failed.values())) if args.check else 0


def board(spark: SparkSession, args: argparse.Namespace) -> int:
    """One board from several prediction files, the first file that has an entity deciding."""
    sources = [spark.read.parquet(p) for p in args.predictions]
    out = P.board(sources, ["entity"], [F.col("pred_points").desc(), "entity"], most=args.most)
    out.write.mode("overwrite").parquet(args.out)
    print(tables.console(spark.read.parquet(args.out).orderBy("rank"), args.rows))
    return 0


def features(spark: SparkSession, args: argparse.Namespace) -> int:
    """Assemble a feature table of a spine file and block files: ``--asof`` blocks are bound strictly before each period, ``--on`` blocks on equal keys (with the period or without)."""
    spine = spark.read.parquet(args.spine)
    if args.upcoming_season is not None:
        spine = spine.where(F.col(args.season) == args.upcoming_season)
    by = [args.entity, args.season]
    stored = []
    for path in args.asof:
        block = spark.read.parquet(path)
        columns = [c for c in block.columns if c not in (args.entity, args.season, args.period)]
        stored.append(buckets.on_keys(spine, block, [args.entity], args.season, args.period, columns, args.buckets))
    stored += [buckets.store_bucketed(spark.read.parquet(path), by, args.buckets) for path in args.on]
    out = buckets.assemble(buckets.store_bucketed(spine, by, args.buckets, [args.period]), [args.entity], args.season, args.period, stored)
    tables.write(out, args.out)
    print(f"{args.out}: {spark.read.parquet(args.out).count()} rows, {len(out.columns)} columns")
    return 0


def project(spark: SparkSession, args: argparse.Namespace) -> int:
    """Project a season that hasn't been played from a panel file and the season's own panel file, and print the head of the board."""
    history, target = spark.read.parquet(args.panel), spark.read.parquet(args.target)
    outcomes = ("games", "points", args.opportunities)
    numeric = [c for c, k in history.dtypes if c in target.columns and c not in ("entity", "season", *outcomes) and k in ("int", "bigint", "float", "double")]
    settings = lambda: learned.Learned(numeric, opportunities=args.opportunities, rounds=args.rounds, tune=args.tune)
    ranked = (lambda panel, tests: P.rank_line(panel, tests, args.rank)) if args.rank else None
    out = learned.project_season(history, target, args.season, settings(), settings(), ranked)
    tables.write(out, args.out)
    shown = spark.read.parquet(args.out).orderBy("rank").select("rank", "group_rank", "entity", "grp", "projection_source", "pred_games", "pred_ppg", "pred_points")
    print(tables.console(shown, args.rows))
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="cutline", description=__doc__)
    commands = parser.add_subparsers(dest="command", required=True)
    one = commands.add_parser("ingest", help=ingest.__doc__)
    one.add_argument("--raw", required=True)
    one.add_argument("--out", required=True)
    one.add_argument("--tables", nargs="+", required=True)
    one.add_argument("--seasons", nargs="*", type=int)
    one.add_argument("--start", type=int, default=2012)
    one.add_argument("--end", type=int, default=2025)
    one.add_argument("--skip", nargs="*", default=[])
    two = commands.add_parser("score", help=score.__doc__)
    two.add_argument("--panel", required=True)
    two.add_argument("--out", required=True)
    two.add_argument("--projectors", nargs="*")
    two.add_argument("--cohort", choices=["history", "rookies", "all"], default="history")
    two.add_argument("--common", action="store_true")
    two.add_argument("--least", type=int, default=3, help="seasons before the first test season")
    two.add_argument("--check", action="store_true", help="exit with 1 where a check fails")
    three = commands.add_parser("board", help=board.__doc__)
    three.add_argument("predictions", nargs="+")
    three.add_argument("--out", required=True)
    three.add_argument("--most", type=int)
    three.add_argument("--rows", type=int, default=30)
    four = commands.add_parser("features", help=features.__doc__)
    four.add_argument("--spine", required=True)
    four.add_argument("--asof", nargs="*", default=[])
    four.add_argument("--on", nargs="*", default=[])
    four.add_argument("--out", required=True)
    four.add_argument("--entity", default="entity")
    four.add_argument("--season", default="season")
    four.add_argument("--period", default="week")
    four.add_argument("--buckets", type=int, default=200)
    four.add_argument("--upcoming-season", type=int)
    five = commands.add_parser("project", help=project.__doc__)
    five.add_argument("--panel", required=True)
    five.add_argument("--target", required=True)
    five.add_argument("--season", type=int, required=True)
    five.add_argument("--out", required=True)
    five.add_argument("--opportunities", default="opportunities")
    five.add_argument("--rank", help="column of a market's rank, which then decides for rookies that have one")
    five.add_argument("--rounds", type=int, default=50)
    five.add_argument("--tune", action="store_true", help="let the last season choose the rounds")
    five.add_argument("--rows", type=int, default=40)
    args = parser.parse_args(argv)
    return {"ingest": ingest, "score": score, "board": board, "features": features, "project": project}[args.command](SparkSession.builder.getOrCreate(), args)


if __name__ == "__main__":
    sys.exit(main())
