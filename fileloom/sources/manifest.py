"""Listing files.

``file_manifest`` is a Python data source: it keeps empty files and names that begin with ``_``, which Spark's own
file sources drop, and skips hidden files and folders. Each folder below the root is listed by tasks of its own. Roots may be URIs.
"""

from __future__ import annotations

import glob as globs
import os
from collections.abc import Iterator
from zlib import crc32

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from fileloom.functions import formats, paths
from fileloom.sources import store

SCHEMA = "path string, name string, extension string, kind string, length bigint, modified_ms bigint"


class InputError(ValueError):
    """An input that can't be taken; ``kind`` leads to its exit code."""

    def __init__(self, kind: str, message: str):
        super().__init__(message)
        self.kind = kind


#: Entries of a folder that a task looks at, at about.
ENTRIES = 50_000


class Folder(InputPartition):
    """A share of a folder's entries: those whose name's checksum leaves ``part`` by ``parts``."""

    def __init__(self, path: str, part: int = 0, parts: int = 1):
        self.path, self.part, self.parts = path, part, parts


class ManifestReader(DataSourceReader):
    def __init__(self, root: str, recursive: bool):
        self.root, self.recursive = root, recursive

    def partitions(self) -> list[Folder]:
        """Folders, in shares where they are large. The driver sees names only; sizes and times are looked up by the tasks."""
        found, left = [], [self.root]
        while left:
            folder, n = left.pop(), 0
            try:
                for path, _, kind in store.entries(folder):
                    n += 1
                    if self.recursive and kind == "dir":
                        left.append(path)
            except OSError:  # a folder that can't be read has no files to offer
                continue
            parts = max(1, -(-n // ENTRIES))
            found += [Folder(folder, k, parts) for k in range(parts)]
        return found

    def read(self, partition: Folder) -> Iterator[tuple]:
        try:
            for path, name, kind in store.entries(partition.path):
                if partition.parts > 1 and crc32(name.encode("utf-8", "surrogateescape")) % partition.parts != partition.part:
                    continue
                try:
                    size, changed = store.stat(path)
                except OSError:
                    continue
                stem, dot, ext = name.rpartition(".")
                yield path, name, ext.lower() if stem and dot else "", kind, size, changed
        except OSError:
            return


class FileManifest(DataSource):
    @classmethod
    def name(cls) -> str:
        return "file_manifest"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> ManifestReader:
        return ManifestReader(self.options["path"], self.options.get("recursive", "false").lower() == "true")


def manifest(spark: SparkSession, root: str, recursive: bool = False) -> DataFrame:
    """One row per entry below ``root`` that isn't hidden."""
    spark.dataSource.register(FileManifest)
    return spark.read.format("file_manifest").option("recursive", str(recursive).lower()).load(root)


def batch_files(spark: SparkSession, root: str, recursive: bool = False, from_filter: str = "auto") -> DataFrame:
    """The files of a batch: regular, with an extension that the filter allows."""
    found = store.kind(root)
    if found is None:
        raise InputError("input_not_found", f"Input file not found: {root}")
    if found != "dir":
        raise InputError("invalid_input", "Invalid input data: a batch needs a directory")
    if from_filter != "auto" and from_filter.lower() not in formats.FILTER_EXTENSIONS:
        raise InputError("invalid_input", f"Invalid input data: unknown filter '{from_filter}'")
    rows = manifest(spark, root, recursive).filter(F.col("kind") == "file")
    return rows.filter(formats.extension_allowed(F.col("extension"), F.lit(from_filter)))


def is_pattern(path: str) -> bool:
    """Whether an input is a pattern; a file of that very name comes first."""
    return store.kind(path) is None and ("*" in path or "?" in path or ("[" in path and "]" in path))


def glob_files(pattern: str) -> list[str]:
    """Regular files that a pattern names, in component order."""
    found = [p for p in globs.glob(pattern.replace("\\", "/"), recursive=True) if os.path.isfile(p)]
    if not found:
        raise InputError("input_not_found", f"Input file not found: {pattern}")
    return sorted(found, key=lambda p: p.split("/"))


def glob_root(pattern: str) -> str:
    """The directory that a pattern starts from."""
    prefix = pattern.replace("\\", "/")
    cut = min((prefix.find(c) for c in "*?[" if c in prefix), default=len(prefix))
    prefix = prefix[:cut]
    return prefix.rstrip("/") or "/" if prefix.endswith("/") else os.path.dirname(prefix) or "."


def listed_files(spark: SparkSession, names: list[str]) -> DataFrame:
    """Rows like the manifest's for an explicit list, in its order and whatever the extensions."""
    rows = [(p, os.path.basename(p), store.size(p), k) for k, p in enumerate(names)]
    df = spark.createDataFrame(rows, "path string, name string, length bigint, file_idx bigint")
    return df.withColumn("extension", paths.extension(F.col("path")))


def images(spark: SparkSession, path: str) -> DataFrame:
    """Rasters by Spark's image source: origin, height, width, nChannels, mode, data. What can't be decoded is dropped."""
    return spark.read.format("image").option("dropInvalid", True).load(path).select("image.*")


def markdown_blocks(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, seq, kind, level, depth, quote, text of each block of Markdown texts."""
    import pandas as pd

    from fileloom.operators import markdown

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = [(k, n, b.kind, b.level, b.depth, b.quote, markdown.plain_text(b)) for k, t in zip(frame[key], frame[text], strict=True) for n, b in enumerate(markdown.parse(t or ""))]
            yield pd.DataFrame(rows, columns=[key, "seq", "kind", "level", "depth", "quote", "text"])

    kind = docs.schema[key].dataType.simpleString()
    return docs.select(key, text).mapInPandas(run, f"`{key}` {kind}, seq int, kind string, level int, depth int, quote boolean, text string")
