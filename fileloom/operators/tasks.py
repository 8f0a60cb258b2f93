"""Reports over the table of tasks: input_path, output_path, status, original_size, converted_size, error_message."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fileloom.functions import text

TASK = "input_path string, output_path string, status string, original_size bigint, converted_size bigint, error_message string"


def counts(tasks: DataFrame) -> DataFrame:
    """total_tasks, successful, skipped, failed, any_failed."""
    return tasks.agg(
        F.count("*").alias("total_tasks"),
        *(F.count(F.when(F.col("status") == s, 1)).alias(name) for s, name in (("success", "successful"), ("skipped", "skipped"), ("failed", "failed"))),
        F.coalesce(F.bool_or(F.col("status") == "failed"), F.lit(False)).alias("any_failed"),
    )


def sizes(tasks: DataFrame, *by: str) -> DataFrame:
    """orig_size, new_size, saved_bytes, saved_percent over tasks that didn't fail; a file counts once per target."""
    done = F.col("status").isin("success", "skipped")
    summed = tasks.groupBy(*by).agg(
        F.coalesce(F.sum(F.when(done, F.col("original_size"))), F.lit(0)).alias("orig_size"),
        F.coalesce(F.sum(F.when(done, F.col("converted_size"))), F.lit(0)).alias("new_size"),
    )
    return summed.withColumn("saved_bytes", F.col("orig_size") - F.col("new_size")).withColumn("saved_percent", text.saved_percent(F.col("orig_size"), F.col("new_size")))


def summary(tasks: DataFrame) -> DataFrame:
    """The one row of the report."""
    total = counts(tasks).crossJoin(sizes(tasks))  # one row each
    return total.withColumn("savings", text.savings(F.col("orig_size"), F.col("new_size"))).withColumn("exit_code", F.when(F.col("any_failed"), text.BATCH_FAILED).otherwise(0))


def delete_eligible(tasks: DataFrame, n_targets: int) -> DataFrame:
    """input_path of files whose every target has an output and no task failed; skipped counts as done.

    ``safe`` is false where an output is the input itself: such a file is never deleted.
    """
    ok = F.col("status").isin("success", "skipped")
    grouped = tasks.groupBy("input_path").agg(
        F.count_distinct(F.when(ok, F.col("output_path"))).alias("ok_outputs"),
        F.count(F.when(F.col("status") == "failed", 1)).alias("failures"),
        F.coalesce(F.bool_or(F.col("output_path") == F.col("input_path")), F.lit(False)).alias("_self"),
    )
    return grouped.filter((F.col("ok_outputs") == n_targets) & (F.col("failures") == 0)).select("input_path", "ok_outputs", (~F.col("_self")).alias("safe"))


def converted_size(output_files: Column) -> Column:
    """Sum of the sizes of a task's files."""
    return F.aggregate(output_files, F.lit(0).cast("bigint"), lambda total, f: total + f["size_bytes"])


def none_failed(output_files: Column) -> Column:
    return F.forall(output_files, lambda f: ~f["description"].contains("failed"))
