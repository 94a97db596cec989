"""The protocols as commands: ``python -m clickloom COMMAND``, each reading and writing tables.

``features`` builds the matrix from a click log and a table of visitors; the others read its result with ``target`` and
``day_index`` beside it. Results go to a folder of JSON lines that ``report`` ranks.
"""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession

from .config import Settings
from .functions.kernels import KEY
from .functions.storage import scratch
from .operators import analysis, models, tuning
from .operators.metrics import METRICS
from .plans.features import build_features, strict_report
from .sources import readers

_BESIDE = (KEY, "target", "day_index", "is_fit", "dominant_platform")


def _columns(df: DataFrame, args: argparse.Namespace) -> list[str]:
    numbers = [f.name for f in df.schema.fields if f.name not in _BESIDE and f.dataType.typeName() not in ("string", "timestamp", "timestamp_ntz")]
    return models.columns_like(numbers, args.keep, args.drop)


def _told(spark: SparkSession, args: argparse.Namespace, values: dict) -> None:
    row = {"name": args.name, "ts": int(time.time() * 1000)} | {k: v for k, v in values.items() if v is not None}
    print(json.dumps(row))
    if args.results:
        kinds = {str: "string", int: "long", float: "double"}
        schema = ", ".join(f"`{k}` {kinds[type(v)]}" for k, v in row.items())
        readers.append_results(spark.createDataFrame([tuple(row.values())], schema).coalesce(1), args.results)


def features(spark: SparkSession, args: argparse.Namespace) -> None:
    cookies = spark.read.parquet(args.cookies)
    matrix = build_features(spark.read.parquet(args.clicks), cookies, Settings())
    matrix.join(cookies.select(KEY, "target", "day_index"), KEY).write.mode("overwrite").parquet(args.out)


def experiment(spark: SparkSession, args: argparse.Namespace) -> None:
    """Metrics of models on folds drawn anew for each seed, of columns chosen by pattern."""
    df = spark.read.parquet(args.matrix).where("target IS NOT NULL")
    report, _ = models.repeated_cv(df, _columns(df, args), args.learner, args.folds, tuple(args.seeds), args.select)
    rows = report.collect()  # a row a metric
    _told(spark, args, {r["metric"]: r["blend"] for r in rows} | {f"{r['metric']}_deviation": r["deviation"] for r in rows})


def strict(spark: SparkSession, args: argparse.Namespace) -> None:
    """The matrix built anew for each cut in time, and the metrics on the days from it on."""
    clicks, cookies = spark.read.parquet(args.clicks), spark.read.parquet(args.cookies)
    for cut in args.cuts:
        told = strict_report(clicks, cookies, Settings(), cut, learner=args.learner, seeds=tuple(args.seeds), keep=args.keep, drop=args.drop).first()
        _told(spark, args, {"cut": cut} | told.asDict())


def ablation(spark: SparkSession, args: argparse.Namespace) -> None:
    """Metrics without each block of columns; ``--blocks`` is a JSON object of names and patterns."""
    df, name = spark.read.parquet(args.matrix).where("target IS NOT NULL"), args.name
    for told in analysis.ablation(df, _columns(df, args), json.loads(args.blocks), args.learner, args.folds):
        args.name = f"{name}-without-{told['without']}" if told["without"] else name
        _told(spark, args, {m: told[m] for m in METRICS})


def tune(spark: SparkSession, args: argparse.Namespace) -> None:
    df = spark.read.parquet(args.matrix).where("target IS NOT NULL")
    found = tuning.tune(df, _columns(df, args), args.learner, args.trials, args.folds, args.temporal, tuple(args.cuts), folder=args.trials_folder, out=args.out)
    _told(spark, args, {"value": found["value"], "settings": json.dumps(found["settings"])})


def submit(spark: SparkSession, args: argparse.Namespace) -> None:
    """Scores of the visitors without a target, from a bag of seeds over those with one, checked and written as CSV."""
    df = spark.read.parquet(args.matrix)
    known, wanted = df.where("target IS NOT NULL"), df.where("target IS NULL")
    readers.write_scores(models.bagged(known, wanted, _columns(df, args), args.learner, tuple(args.seeds)), wanted.select(KEY), args.out)


def report(spark: SparkSession, args: argparse.Namespace) -> None:
    readers.report_table(readers.read_results(spark, args.results, (args.by,)), args.by).show(args.rows, truncate=False)


COMMANDS = {f.__name__: f for f in (features, experiment, strict, ablation, tune, submit, report)}


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="clickloom", description=__doc__)
    commands = out.add_subparsers(dest="command", required=True)
    own = {
        "features": ("clicks", "cookies", "out"),
        "experiment": ("matrix", "learner", "seeds", "folds", "columns", "select", "results"),
        "strict": ("clicks", "cookies", "learner", "seeds", "columns", "cuts", "results"),
        "ablation": ("matrix", "learner", "folds", "columns", "blocks", "results"),
        "tune": ("matrix", "learner", "folds", "columns", "cuts", "trials", "out", "results"),
        "submit": ("matrix", "learner", "seeds", "columns", "out"),
        "report": ("results", "by"),
    }
    flags = {
        "clicks": {"--clicks": {"required": True}}, "cookies": {"--cookies": {"required": True}}, "matrix": {"--matrix": {"required": True}}, "out": {"--out": {"required": True}},
        "learner": {"--learner": {"default": "gbt", "choices": sorted(models.LEARNERS)}}, "seeds": {"--seeds": {"type": int, "nargs": "+", "default": [42, 43, 44]}}, "folds": {"--folds": {"type": int, "default": 5}},
        "columns": {"--keep": {"default": "", "help": "pattern of columns to use"}, "--drop": {"default": "", "help": "pattern of columns to leave out"}}, "select": {"--select": {"type": int, "default": 0, "help": "columns to choose in each fold"}},
        "cuts": {"--cuts": {"type": int, "nargs": "+", "default": [7, 10]}}, "blocks": {"--blocks": {"required": True}},
        "trials": {"--trials": {"type": int, "default": 25}, "--trials-folder": {"default": ""}, "--temporal": {"type": float, "default": 0.5}},
        "results": {"--results": {"default": ""}, "--name": {"default": "run"}}, "by": {"--by": {"default": "average_precision"}, "--rows": {"type": int, "default": 50}},
    }
    for name, groups in own.items():
        command = commands.add_parser(name, help=COMMANDS[name].__doc__)
        for group in groups:
            for flag, more in flags[group].items():
                command.add_argument(flag, **more)
    return out


def main(argv: list[str] | None = None) -> None:
    args = parser().parse_args(argv)
    with scratch():  # nothing is read after the command
        COMMANDS[args.command](SparkSession.builder.appName("clickloom").getOrCreate(), args)


if __name__ == "__main__":
    main()
