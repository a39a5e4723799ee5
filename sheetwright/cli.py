"""Command line: evaluate rows, show the funnel, compare runs, verify a sheet.

    python -m sheetwright.cli evaluate ROWS --label v2 --output OUT [--limit N]
    python -m sheetwright.cli funnel ROWS --output OUT
    python -m sheetwright.cli compare SUMMARY... --output OUT
    python -m sheetwright.cli verify --fields F --groups G --signatures S --records SHEET --select 1,3,5-8 --output OUT

Rows and tables are Parquet; summaries are JSON, one object a file; OUT is a
folder.  Files that do not exist are named and passed over; if none is left the
exit code is 1.
"""

from __future__ import annotations

import argparse
import os
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sheetwright.operators import metrics, records
from sheetwright.session import session
from sheetwright.sources import files, xlsx
from sheetwright.verify import verify


def evaluate(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = spark.read.parquet(args.rows)
    if args.limit:
        rows = rows.orderBy("doc").limit(args.limit)
    summary = metrics.evaluation_summary(rows).withColumns({"run_label": F.lit(args.label), "pipeline_module": F.lit(args.pipeline)})
    files.write_json(summary.coalesce(1), f"{args.output}/summary")
    files.write_csv(rows, f"{args.output}/results")
    return 0


def funnel(spark: SparkSession, args: argparse.Namespace) -> int:
    rows = spark.read.parquet(args.rows)
    nested = metrics.funnel(rows).select(F.struct("*").alias("funnel"), F.lit(args.label).alias("run_label"))
    files.write_json(nested.coalesce(1), f"{args.output}/summary")
    return 0


def summaries(spark: SparkSession, paths: list[str]) -> dict[str, DataFrame]:
    """By kind, the metrics (run, metric, ord, value) of the runs in ``paths``, in order."""
    found: dict[str, DataFrame] = {}
    for path in paths:
        one = files.read_summaries(spark, path)
        kind = metrics.summary_kind(one.columns)
        label, module = (F.col(c) if c in one.columns else F.lit(None).cast("string") for c in ("run_label", "pipeline_module"))
        named = one.select(metrics.run_label(label, module, F.lit(path.rstrip("/"))).alias("run"), *[c for c in one.columns if c != "source_path"])
        long = metrics.metrics_of(named, "run")
        found[kind] = found[kind].unionByName(long) if kind in found else long
    return found


def compare(spark: SparkSession, args: argparse.Namespace) -> int:
    there = [p for p in args.summaries if os.path.exists(p)]
    for p in args.summaries:
        if p not in there:
            print(f"not found, passed over: {p}", file=sys.stderr)
    if not there:
        return 1
    for kind, long in summaries(spark, there).items():
        baseline = long.first()["run"]
        table = metrics.compare_runs(long, baseline).orderBy("position", "metric", "run")
        table.show(1000, truncate=False)
        files.write_csv(table, f"{args.output}/kind={kind}")
    return 0


def read_sheet(spark: SparkSession, path: str) -> DataFrame:
    if path.lower().endswith(".xlsx"):
        spark.dataSource.register(xlsx.XlsxSource)
        return spark.read.format("xlsx").load(path)
    return files.read_csv(spark, path)


def run_verify(spark: SparkSession, args: argparse.Namespace) -> int:
    sheet = records.clean_records(read_sheet(spark, args.records))
    chosen = records.selected_ids(spark, args.select, sheet)
    out = verify(spark, *[spark.read.parquet(p) for p in (args.fields, args.groups, args.signatures)], chosen, collapse_evidence=not args.two_evidence)
    out.write.mode("overwrite").parquet(f"{args.output}/decisions")
    return 0


def main(argv: list[str] | None = None) -> int:
    parser = argparse.ArgumentParser(prog="sheetwright", description=__doc__.splitlines()[0])
    commands = parser.add_subparsers(required=True)
    for name, function in (("evaluate", evaluate), ("funnel", funnel)):
        p = commands.add_parser(name)
        p.add_argument("rows")
        p.add_argument("--label")
        p.add_argument("--pipeline", default="pipeline")
        p.add_argument("--limit", type=int)
        p.set_defaults(run=function)
    p = commands.add_parser("compare")
    p.add_argument("summaries", nargs="+")
    p.set_defaults(run=compare)
    p = commands.add_parser("verify")
    for name in ("fields", "groups", "signatures", "records"):
        p.add_argument(f"--{name}", required=True)
    p.add_argument("--select", default="")
    p.add_argument("--two-evidence", action="store_true")
    p.set_defaults(run=run_verify)
    for p in commands.choices.values():
        p.add_argument("--output", required=True)
    args = parser.parse_args(argv)
    return args.run(session(), args)


if __name__ == "__main__":
    sys.exit(main())
