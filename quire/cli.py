"""Parse, extract, demo and show-metrics from the command line.

    python -m quire parse files/ --decoder package.module:make_decoder --output blocks/
"""

from __future__ import annotations

import argparse
import json
from importlib import import_module

from pyspark.sql import DataFrame, SparkSession

from quire.operators import extraction
from quire.sources import files, fixtures, pages


def session() -> SparkSession:
    return SparkSession.builder.appName("quire").config("spark.sql.session.timeZone", "UTC").getOrCreate()


def named(where: str | None):
    """The function at "module:name"."""
    if where is None:
        return None
    module, _, name = where.partition(":")
    return getattr(import_module(module), name)


def _out(df: DataFrame, path: str | None) -> None:
    """JSON lines to a folder, or the rows to the console."""
    if path:
        df.write.mode("overwrite").json(path)
    else:
        df.show(truncate=80)


def _blocks(spark: SparkSession, args: argparse.Namespace) -> DataFrame:
    return pages.parse(spark, args.path, named(args.decoder), named(args.engine))


def parse(args: argparse.Namespace) -> None:
    _out(_blocks(session(), args), args.output)


def extract(args: argparse.Namespace) -> None:
    blocks = _blocks(session(), args).select("document_id", "page", "block_id", "kind", "text", "bbox", "reading_order").persist()
    _out(extraction.validate(extraction.extract(blocks), blocks), args.output)
    blocks.unpersist()


def demo(args: argparse.Namespace) -> None:
    report = fixtures.demo(session())
    files.write_json_report(report, f"{args.output_dir}/metrics.json")
    files.write_html_report(report, f"{args.output_dir}/report.html")
    print(files.console_summary(report))


def show_metrics(args: argparse.Namespace) -> None:
    with open(args.report, encoding="utf-8") as f:
        print(json.dumps(json.load(f)["summary"], indent=2))


def main(argv: list[str] | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quire")
    commands = parser.add_subparsers(required=True)
    for run in (parse, extract):
        command = commands.add_parser(run.__name__)
        command.add_argument("path")
        command.add_argument("--decoder", required=True, help="module:function that makes a decoder")
        command.add_argument("--engine", help="module:function that makes an OCR engine")
        command.add_argument("--output", "-o")
        command.set_defaults(run=run)
    command = commands.add_parser("demo")
    command.add_argument("--output-dir", default="quire-demo")
    command.set_defaults(run=demo)
    command = commands.add_parser("show-metrics")
    command.add_argument("report", nargs="?", default="quire-demo/metrics.json")
    command.set_defaults(run=show_metrics)
    args = parser.parse_args(argv)
    args.run(args)
