"""From files and targets to planned outputs, before any content is read."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fileloom.functions import formats, paths
from fileloom.operators.staging import staged, unused


def default_target(extension: Column) -> Column:
    return F.when(extension == "svg", "favicon").when(extension == "pdf", "png").when(extension.isin("md", "markdown"), "docx").otherwise("webp")


def target_from_output(extension: Column, output: Column, output_is_dir: Column, package: Column) -> Column:
    """Target name when none is given: a package means favicon; then by the output's extension; else the default."""
    wanted = paths.extension(output)
    by_output = F.when(wanted.isin("ico", "html"), "favicon").otherwise(wanted)
    return F.when(package, "favicon").when(output.isNull() | output_is_dir | (wanted == ""), default_target(extension)).otherwise(by_output)


def target_list(name: Column) -> Column:
    """Targets that a name means: ``both`` in any case, or one format; null if it is none."""
    parsed = formats.parse_format(name)
    return F.when(F.lower(name) == "both", F.array(F.lit("webp"), F.lit("avif"))).otherwise(F.when(parsed.isNotNull(), F.array(parsed)))


def expand_targets(files: DataFrame, targets: Column) -> DataFrame:
    """One row per file and target, with target_idx; a projection, so nothing is shuffled."""
    return files.select("*", F.posexplode(targets).alias("target_idx", "target"))


def skip_existing(plan: DataFrame, existing: DataFrame, overwrite: bool) -> DataFrame:
    """``plan`` (output_path, ...) with existing_size and skipped, joined to a listing (path, length) of outputs."""
    (name,) = unused(plan, "listed_path")
    listed = existing.select(F.col("path").alias(name), F.col("length").alias("existing_size")).dropDuplicates([name])
    joined = plan.join(listed, plan.output_path == F.col(name), "left").drop(name)
    return joined.withColumn("skipped", F.col("existing_size").isNotNull() & F.lit(not overwrite))


def mark_collisions(plan: DataFrame) -> DataFrame:
    """``plan`` with collides: true for all but the first row (by file_idx, target_idx) that leads to an output path."""
    (name,) = unused(plan, "first_task")
    first = plan.groupBy("output_path").agg(F.min(F.struct("file_idx", "target_idx")).alias(name))
    return plan.join(first, "output_path").withColumn("collides", F.struct("file_idx", "target_idx") != F.col(name)).drop(name)


def number_files(files: DataFrame) -> DataFrame:
    """``files`` with file_idx, from 0 in component order of ``path``.

    Rows are sorted in range partitions and written once, with their partition and place in it: evaluated twice, a range shuffle
    would sample other bounds. Places are then offset by the partitions' counts, so no task sorts all files. Extra columns stay.
    """
    part, row, before = unused(files, "part", "row", "before")
    key = paths.component_key(F.col("path"))
    ranged = files.repartitionByRange(key, F.col("path")).sortWithinPartitions(key, F.col("path"))
    placed = ranged.withColumns({part: F.spark_partition_id(), row: F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    placed = staged(placed, "numbered")
    earlier = Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)  # one row per partition
    counts = placed.groupBy(part).agg(F.count("*").alias("n"))
    offsets = counts.select(part, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias(before))
    return placed.join(F.broadcast(offsets), part).withColumn("file_idx", F.col(before) + F.col(row)).drop(part, row, before)


def plan_batch(files: DataFrame, targets: Column, root: str, output_dir: str | None = None) -> DataFrame:
    """file_idx, target_idx, input_path, from_format, target, output_path, converter, supported of each task."""
    path = F.col("path")
    rows = expand_targets(files, targets)
    source = formats.parse_format(paths.extension(path))
    return rows.select(
        "file_idx", "target_idx", path.alias("input_path"), F.col("length").alias("original_size"), source.alias("from_format"), F.col("target").alias("to_format"),
        paths.batch_output(path, F.lit(root), F.lit(output_dir).cast("string"), F.col("target")).alias("output_path"),
        formats.converter(source, F.col("target")).alias("converter"),
    ).withColumn("supported", F.col("converter").isNotNull())
