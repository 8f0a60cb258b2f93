"""Library entry points: ``convert``, ``batch_convert`` and ``supported_formats``."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fileloom.codecs import CodecError, pdf
from fileloom.functions import formats, pages, paths, text
from fileloom.operators import content, planning, progress as watching, sinks, tasks
from fileloom.operators.staging import new_path
from fileloom.sources import manifest, store
from fileloom.sources.manifest import InputError


#: Told how many tasks are done, and of how many.
Progress = Callable[[int, int], None]


@dataclass
class Options:
    """How to convert; checked when made."""

    quality: int = 80
    lossless: bool = False
    overwrite: bool = False
    delete_original: bool = False
    package: bool = False
    pages: str | None = None
    dpi: int = 150
    width: int | None = None
    height: int | None = None
    no_upscale: bool = False

    def __post_init__(self) -> None:
        for name, value, lo, hi in (("quality", self.quality, 1, 100), ("dpi", self.dpi, 0, 65535), ("width", self.width, 0, (1 << 32) - 1), ("height", self.height, 0, (1 << 32) - 1)):
            if value is not None and not lo <= value <= hi:
                raise InputError("invalid_input", f"Invalid input data: {name} must be from {lo} to {hi}")

    def settings(self) -> content.Settings:
        return content.Settings(self.width, self.height, self.no_upscale, self.quality, self.lossless, self.package, self.dpi)


@dataclass
class BatchResult:
    """One row per file and target, their report, and what was deleted."""

    tasks: DataFrame
    deleted: int = 0
    deletion_errors: list[tuple[str, str]] = field(default_factory=list)

    def summary(self) -> dict:
        return tasks.summary(self.tasks).first().asDict() | {"deleted": self.deleted, "deletion_errors": self.deletion_errors}

    @property
    def exit_code(self) -> int:
        return text.BATCH_FAILED if self.deletion_errors or self.summary()["any_failed"] else 0


def supported_formats(spark: SparkSession) -> DataFrame:
    return formats.capabilities(spark)


def _evaluate(spark: SparkSession, **columns: Column) -> dict:
    """Values of expressions over literals: the rules that batches use, for one file."""
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first().asDict()


def targets_of(spark: SparkSession, name: str) -> list[str]:
    """Formats that a target name means."""
    found = _evaluate(spark, targets=planning.target_list(F.lit(name)))["targets"]
    if found is None:
        raise InputError("unsupported", f"Unsupported conversion from 'any' to '{name}'")
    return found


def _goals(spark: SparkSession, path: str, targets: list[str], output: str | None, package: bool) -> list[str]:
    """Output of each target of one file."""
    is_dir = F.lit(output is not None and store.kind(output) == "dir")
    where, given = F.lit(output).cast("string"), F.lit(output if output is not None else os.path.dirname(path) or ".")
    packed = paths.package_paths(given, is_dir | F.lit(output is None))
    goals = []
    for target in targets:
        if target == "favicon" and package:
            goals.append(paths.join(packed["directory"], packed["ico"]))
        else:
            goals.append(paths.single_output(F.lit(path), F.lit(target), where, is_dir, F.lit(len(targets))))
    return _evaluate(spark, goals=F.array(*goals))["goals"]


def _page_indexes(spark: SparkSession, data: bytes, spec: str | None) -> list[int]:
    """Pages of a PDF that a selection means; raises if there are none."""
    n = F.lit(pdf.page_count(data))
    found = _evaluate(spark, pages=pages.select_pages(F.lit(spec).cast("string"), n), error=pages.page_error(F.lit(spec).cast("string"), n))
    if found["error"]:
        raise InputError("invalid_input", f"Invalid input data: {found['error']}")
    return found["pages"]


def convert(spark: SparkSession, path: str, to: str | None = None, output: str | None = None, source: str = "auto", options: Options | None = None, progress: Progress = lambda done, total: None) -> list[dict]:
    """Convert one file; its output files as dictionaries (path, size_bytes, description). Stops at the first error.

    A file's pages and targets are planned in the driver, as there are few; bytes are handled here too.
    """
    options = options or Options()
    ext = paths.extension(F.lit(path))
    is_dir = F.lit(output is not None and store.kind(output) == "dir")
    named = planning.target_from_output(ext, F.lit(output).cast("string"), is_dir, F.lit(options.package)) if to is None else F.lit(to)
    plan = _evaluate(spark, name=named, ext=ext, kind=formats.parse_format(F.lit(source) if source != "auto" else ext))
    names, kind = targets_of(spark, plan["name"]), plan["kind"]
    if store.kind(path) is None:
        raise InputError("input_not_found", f"Input file not found: {path}")
    if store.size(path) == 0:
        raise InputError("invalid_input", "Invalid input data: Input file is empty")
    goals = _goals(spark, path, names, output, options.package)
    how = _evaluate(spark, how=F.array(*(formats.converter(F.lit(kind).cast("string"), F.lit(t)) for t in names)))["how"]
    made: list[dict] = []
    data = store.read(path)
    for k, (target, goal, converter) in enumerate(zip(names, goals, how, strict=True)):
        progress(k, len(names))
        if converter is None:
            raise InputError("unsupported", f"Unsupported conversion from '{kind or plan['ext']}' to '{target}'")
        if store.kind(goal) and not options.overwrite:
            made.append({"path": goal, "size_bytes": store.size(goal), "description": "Skipped (already exists)"})
            continue
        try:
            wanted = _page_indexes(spark, data, options.pages) if converter == "pdf" else None
            files = content.convert_bytes(data, converter, kind, target, goal, options.settings(), wanted)
        except CodecError as error:
            raise InputError("image", f"Image processing error: {error}") from error
        except InputError:
            raise
        except ValueError as error:
            raise InputError("invalid_input", str(error)) from error
        for name, body, description in files:
            if converter == "pdf" and store.kind(name) and not options.overwrite:  # pages are checked under their own names
                made.append({"path": name, "size_bytes": store.size(name), "description": "Skipped (already exists)"})
                continue
            try:
                store.write(name, body)
            except OSError as error:
                raise InputError("output_write", f"Output writing error: {error.strerror}") from error
            made.append({"path": name, "size_bytes": len(body), "description": description})
    progress(len(names), len(names))
    if options.delete_original and not any(store.same(f["path"], path) for f in made):  # an output that is the input is never deleted
        store.delete(path)
    return made


def batch_convert(spark: SparkSession, root: str | None = None, to: str | None = None, output_dir: str | None = None, from_filter: str = "auto", recursive: bool = False, files: list[str] | None = None, options: Options | None = None, folder: str | None = None, progress: Progress | None = None) -> BatchResult:
    """Convert the files of a directory, or those listed. Errors are rows, never exceptions.

    Outputs that exist are found by metadata alone, so the bytes of skipped files are never read. The table of tasks is written
    in ``folder`` (one that executors share) before anything is counted or deleted, so that outputs are written once.
    ``progress`` is told of Spark's tasks while contents are converted.
    """
    options = options or Options()
    if files is None:
        found = manifest.batch_files(spark, root, recursive, from_filter).select("path", "length", "extension")
        found = planning.number_files(found)
    else:
        found = manifest.listed_files(spark, files).select("path", "length", "extension", "file_idx")
        root = root or os.path.commonpath([os.path.dirname(os.path.abspath(p)) for p in files]) if files else "."
    wanted = targets_of(spark, to) if to else None
    goal = F.array(*map(F.lit, wanted)) if wanted else F.array(planning.default_target(F.col("extension")))
    n_targets = len(wanted) if wanted else 1
    planned = planning.plan_batch(found, goal, root.rstrip("/"), output_dir)
    folder = folder or new_path(spark, "batch")
    planned.write.mode("overwrite").parquet(f"{folder}/plan")
    planned = planning.mark_collisions(spark.read.parquet(f"{folder}/plan"))
    existing = _existing(planned)
    planning.skip_existing(planned, existing, options.overwrite).write.mode("overwrite").parquet(f"{folder}/checked")
    planned = spark.read.parquet(f"{folder}/checked")  # what existed before anything was written
    base = ("file_idx", "target_idx", "input_path", "output_path", "original_size")
    why = F.when(F.col("collides"), "Output is that of an earlier file").when(~F.col("supported"), F.format_string("Unsupported conversion from '%s' to '%s'", "from_format", "to_format"))
    refused = planned.filter("collides or not supported").select(*base, F.lit("failed").alias("status"), F.lit(0).cast("long").alias("converted_size"), why.alias("error_message"))
    skipped = planned.filter("supported and not collides and skipped").select(*base, F.lit("skipped").alias("status"), F.col("existing_size").alias("converted_size"), F.lit(None).cast("string").alias("error_message"))
    todo = planned.filter("supported and not collides and not skipped")
    refused_pages = None
    if not todo.filter("converter = 'pdf'").isEmpty():
        counted = content.page_counts(todo.filter("converter = 'pdf'").select("input_path").distinct())
        counted.write.mode("overwrite").parquet(f"{folder}/pages")
        spec, n = F.lit(options.pages).cast("string"), F.col("n_pages")
        chosen = spark.read.parquet(f"{folder}/pages").select("input_path", pages.select_pages(spec, n).alias("pages"), pages.page_error(spec, n).alias("page_error"))
        todo = todo.join(chosen, "input_path", "left")
        refused_pages = todo.filter("page_error is not null").select(*base, F.lit("failed").alias("status"), F.lit(0).cast("long").alias("converted_size"), F.concat(F.lit("Invalid input data: "), "page_error").alias("error_message"))
        todo = todo.filter("page_error is null")
    made = content.convert_files(todo, options.settings())
    with watching.watched(spark, progress):
        made.drop("output_files").write.mode("overwrite").parquet(f"{folder}/made")
    made = spark.read.parquet(f"{folder}/made")
    done = todo.select(*base).join(made, ["input_path", "output_path"]).select(*base, "status", "converted_size", "error_message")
    if refused_pages is not None:
        refused = refused.unionByName(refused_pages)
    rows = done.unionByName(skipped).unionByName(refused).orderBy("file_idx", "target_idx").drop("file_idx", "target_idx")
    result = BatchResult(rows)
    if options.delete_original:
        result.deleted, result.deletion_errors = sinks.delete_originals(tasks.delete_eligible(rows, n_targets))
    return result


def _existing(planned: DataFrame) -> DataFrame:
    """(path, length) of the planned outputs that exist."""
    from collections.abc import Iterator

    import pyarrow as pa

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(p, store.size(p)) for p in batch.column(0).to_pylist() if p is not None and store.kind(p) == "file"]
            yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["path", "length"])

    return planned.select("output_path").mapInArrow(run, "path string, length long")
