"""Command line: ``python -m fileloom.cli convert|list-formats``."""

from __future__ import annotations

import argparse
import json
import logging
import os
import sys

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from fileloom import api
from fileloom.functions import formats, text
from fileloom.operators import raster
from fileloom.sources import manifest
from fileloom.sources.manifest import InputError


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="fileloom")
    out.add_argument("-v", "--verbose", action="store_true")
    out.add_argument("-q", "--quiet", action="store_true")
    out.add_argument("--json", action="store_true")
    commands = out.add_subparsers(dest="command", required=True)
    commands.add_parser("list-formats")
    c = commands.add_parser("convert")
    c.add_argument("--from", dest="source", default="auto")
    c.add_argument("--to")
    c.add_argument("-i", "--input", required=True)
    c.add_argument("-o", "--output")
    c.add_argument("--package", action="store_true")
    c.add_argument("--quality", type=int, default=80)
    c.add_argument("--lossless", action="store_true")
    c.add_argument("-r", "--recursive", action="store_true")
    c.add_argument("-d", "--delete-original", action="store_true")
    c.add_argument("--overwrite", action="store_true")
    c.add_argument("-w", "--workers", type=int)
    c.add_argument("--pages")
    c.add_argument("--dpi", type=int, default=150)
    c.add_argument("--width", type=int)
    c.add_argument("--height", type=int)
    c.add_argument("--no-upscale", action="store_true")
    return out


def _configured_master() -> bool:
    """Whether spark-submit, the environment or a running session names a master."""
    from pyspark import SparkContext

    env = os.environ
    return SparkContext._active_spark_context is not None or bool(env.get("MASTER") or env.get("SPARK_REMOTE") or env.get("PYSPARK_GATEWAY_PORT")) or "--master" in env.get("PYSPARK_SUBMIT_ARGS", "")


def session(workers: int | None) -> SparkSession:
    """The session; its master is the one that is configured, or as many threads as there are workers here."""
    master = {} if _configured_master() else {"spark.master": f"local[{workers or '*'}]"}
    return SparkSession.builder.config(map=master).appName("fileloom").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()


def list_formats(spark: SparkSession, as_json: bool) -> None:
    rows = formats.capabilities(spark).orderBy("ord")
    if as_json:
        print(json.dumps([{"from": r["from"], "to": r["to"], "description": r.description, "parameters": r.parameters} for r in rows.collect()], indent=2))
        return
    print("Supported Conversions:")
    for r in rows.select(formats.capability_label(F.col("from"), F.col("to"), F.col("description")).alias("line")).collect():
        print(r.line)


def report(result: api.BatchResult) -> str:
    """The summary as text."""
    s = result.summary()
    spark = result.tasks.sparkSession
    shown = spark.range(1).select(*(text.human_size(F.lit(s[k]).cast("long")).alias(k) for k in ("orig_size", "new_size"))).first()
    lines = [("Total Tasks", s["total_tasks"]), ("Successful", s["successful"]), ("Skipped", s["skipped"]), ("Failed", s["failed"]), ("Originals Deleted", s["deleted"]), ("Deletion Failures", len(s["deletion_errors"])), ("Original Size", shown.orig_size), ("New Size", shown.new_size), ("Space Savings", s["savings"])]
    out = [f"{name + ':':<20}{value}" for name, value in lines]
    failed = result.tasks.filter("status = 'failed'").select("input_path", "error_message").toLocalIterator()
    return "\n".join([*out, *(f"{r.input_path}: {r.error_message}" for r in failed), *(f"{p}: {e}" for p, e in s["deletion_errors"])])


def panel(args: argparse.Namespace, target: str) -> str:
    """The options of a batch, in a box."""
    shown = args.input if len(args.input) <= 35 else "..." + args.input[-32:]
    rows = [("Target:", shown), ("Formats:", target), ("Quality:", f"{args.quality} (lossless={str(args.lossless).lower()})"), ("Recursive:", str(args.recursive).lower()), ("Delete Original:", str(args.delete_original).lower()), ("Overwrite Existing:", str(args.overwrite).lower())]
    body = [f"| {name:<19}{value:<35} |" for name, value in rows]
    return "\n".join(["+" + "-" * 56 + "+", *body, "+" + "-" * 56 + "+"])


def run(args: argparse.Namespace, spark: SparkSession) -> int:
    if args.command == "list-formats":
        list_formats(spark, args.json)
        return 0
    options = api.Options(args.quality, args.lossless, args.overwrite, args.delete_original, args.package, args.pages, args.dpi, args.width, args.height, args.no_upscale)
    files, single = None, args.input
    if manifest.is_pattern(args.input):
        files = manifest.glob_files(args.input)
        if len(files) == 1:
            single, files = files[0], None
        elif args.output and (os.path.isfile(args.output) or not os.path.exists(args.output) and os.path.splitext(args.output)[1]):
            raise InputError("invalid_input", "Invalid input data: Output path must be a directory when converting multiple files")
    elif not os.path.exists(args.input):
        raise InputError("input_not_found", f"Input file not found: {args.input}")
    if files is None and not os.path.isdir(single):
        made = api.convert(spark, single, args.to, args.output, args.source, options)
        print(json.dumps({"output_files": made}, indent=2) if args.json else "\n".join(f"{f['path']} ({f['size_bytes']} bytes): {f['description']}" for f in made))
        if not args.json and any(f["path"].endswith("favicon-tags.html") for f in made):
            print(raster.HTML_TAGS, end="")
        return 0
    root = manifest.glob_root(args.input) if files else single
    if not (args.json or args.quiet):
        print(panel(args, args.to or "auto"))
    shown = None if args.json or args.quiet else lambda done, total: print(f"\r{done}/{total} tasks", end="" if done < total else "\n", file=sys.stderr)
    result = api.batch_convert(spark, root, args.to, args.output, args.source, args.recursive, files, options, progress=shown)
    if args.json:
        print(json.dumps({"tasks": [r.asDict() for r in result.tasks.toLocalIterator()], "deleted": result.deleted, "deletion_errors": result.deletion_errors}, indent=2))
    else:
        print(report(result))
    return result.exit_code


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    logging.basicConfig(stream=sys.stderr, level=logging.CRITICAL if args.quiet else logging.DEBUG if args.verbose else logging.INFO, force=True)
    logging.getLogger("py4j").setLevel(logging.WARNING)
    try:
        return run(args, session(getattr(args, "workers", None)))
    except InputError as error:
        code = text.EXIT_CODES.get(error.kind, 4)
        print(json.dumps({"error": str(error), "exit_code": code}, indent=2) if args.json else f"Error: {error}", file=sys.stderr)
        return code


if __name__ == "__main__":
    sys.exit(main())
