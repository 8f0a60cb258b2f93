"""Deleting originals, and results as JSON."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.sources import store


def delete_originals(eligible: DataFrame) -> tuple[int, list[tuple[str, str]]]:
    """Delete the files that are safe to; number deleted, and (path, error) of those that couldn't be.

    Runs in the driver, after all outputs are written; paths come a partition at a time.
    """
    deleted, errors = 0, []
    for row in eligible.filter("safe").select("input_path").toLocalIterator():
        try:
            store.delete(row.input_path)
            deleted += 1
        except FileNotFoundError:
            continue
        except OSError as e:
            errors.append((row.input_path, e.strerror or str(e)))
    return deleted, errors


def results_json(tasks: DataFrame) -> DataFrame:
    """Each row as a JSON text."""
    return tasks.select(F.to_json(F.struct(*tasks.columns), {"ignoreNullFields": "false"}).alias("json"))
