"""The content plane: one Arrow pass that reads files, converts them and writes their outputs.

Errors are data: a file that can't be converted gives an error, never a failed job.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.codecs import CodecError, pdf, svg
from fileloom.operators import markdown, raster
from fileloom.sources import store

FILES = "array<struct<path:string,size_bytes:bigint,description:string,bytes:binary>>"
ARROW_FILES = pa.list_(pa.struct([("path", pa.string()), ("size_bytes", pa.int64()), ("description", pa.string()), ("bytes", pa.binary())]))
LISTED = "array<struct<path:string,size_bytes:bigint,description:string>>"
ARROW_LISTED = pa.list_(pa.struct([("path", pa.string()), ("size_bytes", pa.int64()), ("description", pa.string())]))
TASK = ["input_path", "from_format", "to_format", "converter", "output_path"]

Made = list[tuple[str, bytes, str]]


@dataclass(frozen=True)
class Settings:
    """How content is converted."""

    width: int | None = None
    height: int | None = None
    no_upscale: bool = False
    quality: int = 80
    lossless: bool = False
    package: bool = False
    dpi: int = 150

    def size(self, width: int, height: int) -> tuple[int, int]:
        """The size that an image of this size is fitted to."""
        return raster.fit(width, height, self.width, self.height, self.no_upscale)

    def encoded(self, pixels: np.ndarray, target: str) -> bytes:
        return raster.encode(raster.normalise(pixels), target, self.quality, self.lossless)


def page_path(output: str, page: int) -> str:
    """The output of a page, counted from 1, as :func:`fileloom.functions.paths.page_output` names it."""
    stem, ext = os.path.splitext(output)
    return f"{stem}_page_{page}{ext or '.png'}"


def _pages(data: bytes, target: str, output: str, settings: Settings, pages: list[int] | None) -> Made:
    document = pdf.Document(data)
    found, made = document.pages(), []
    if not found:
        raise ValueError("Invalid input data: PDF document has no pages")
    for k in range(len(found)) if pages is None else pages:
        pixels = pdf.render_page(document, found[k], max(1, settings.dpi) / 72)
        size = settings.size(pixels.shape[1], pixels.shape[0])
        made.append((page_path(output, k + 1), settings.encoded(raster.resize(pixels, *size), target), f"Page {k + 1} of PDF"))
    return made


def _decoded(data: bytes, source: str | None) -> svg.Drawing | np.ndarray:
    return svg.parse_svg(data) if source == "svg" else raster.decode(data)


def convert_bytes(data: bytes, converter: str | None, source: str | None, target: str, output: str, settings: Settings = Settings(), pages: list[int] | None = None, decoded: svg.Drawing | np.ndarray | None = None) -> Made:
    """(path, bytes, description) of the files of one conversion; raises ValueError with the reason.

    ``pages``: indexes of a PDF's pages, all if none are given. ``decoded``: the image, if it is known already.
    """
    if converter is None:
        raise ValueError(f"Unsupported conversion from '{source}' to '{target}'")
    if converter == "markdown":
        return [(output, markdown.to_docx(data), "Converted Markdown to DOCX")]
    if converter == "pdf":
        return _pages(data, target, output, settings, pages)
    image = _decoded(data, source) if decoded is None else decoded
    drawing = isinstance(image, svg.Drawing)
    if target == "favicon":
        folder, _, name = output.rpartition("/")
        made = raster.favicon_files((lambda n: image.render(n, n)) if drawing else raster.squares(image), settings.package, name)
        return [(f"{folder}/{n}" if folder else n, b, d) for n, b, d in made]
    if drawing:
        pixels = image.render(*settings.size(*svg.svg_size(image)))
    else:
        pixels = raster.resize(image, *settings.size(image.shape[1], image.shape[0]))
    text = f"Converted image from {source} to {target} (quality: {settings.quality}, lossless: {str(settings.lossless).lower()})"
    return [(output, settings.encoded(pixels, target), text)]


Row = tuple[str, str, str, str, str]


def _each(batches: Iterator[pa.RecordBatch], settings: Settings, read: Callable[[str, bytes | None], bytes]) -> Iterator[tuple[Row, Made | None, str | None]]:
    """Each task with its files or an error. Tasks of one file that stand together read and decode it once."""
    last, data, decoded = None, b"", None
    for batch in batches:
        rows = zip(*(batch.column(c).to_pylist() for c in range(6)), strict=True)
        for k, (*task, pages) in enumerate(rows):
            path, source, target, converter, output = task
            try:
                if path is None or path != last:
                    last, data, decoded = None, read(path, batch.column(6)[k].as_py()), None  # contents may be large: one at a time
                    last = path
                if converter == "image" and decoded is None:
                    decoded = _decoded(data, source)
                yield tuple(task), convert_bytes(data, converter, source, target, output, settings, pages, decoded if converter == "image" else None), None
            except OSError as error:
                yield tuple(task), None, f"Failed to read source file: {error.strerror or error}"
            except Exception as error:
                yield tuple(task), None, str(error) or type(error).__name__


#: Rows, and bytes of their files, that are returned together.
ROWS, BYTES = 500, 4 << 20


def _gathered(rows: Iterator[tuple[int, tuple]], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches of (size, row)."""
    held, size = [], 0
    for n, row in rows:
        held.append(row)
        size += n
        if len(held) >= ROWS or size >= BYTES:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), schema, strict=True)], schema=schema)


def _selected(tasks: DataFrame) -> DataFrame:
    """Columns that the pass reads; pages and content are null where ``tasks`` lacks them."""
    extra = {"pages": "array<bigint>", "content": "binary"}
    return tasks.select(*TASK, *(F.col(x).cast(t) if x in tasks.columns else F.lit(None).cast(t).alias(x) for x, t in extra.items()))


def _given(path: str, content: bytes | None) -> bytes:
    return content or b""


def convert_tasks(tasks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``tasks`` (input_path, from_format, to_format, converter, output_path, content, and pages) with files and error."""
    schema = pa.schema([*((x, pa.string()) for x in TASK), ("files", ARROW_FILES), ("error", pa.string())])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for task, made, error in _each(batches, settings, _given):
            files = None if made is None else [{"path": p, "size_bytes": len(b), "description": d, "bytes": b} for p, b, d in made]
            yield sum(len(b) for _, b, _ in made or ()), (*task, files, error)

    spark_schema = ", ".join(f"{x} string" for x in TASK) + f", files {FILES}, error string"
    return _selected(tasks).mapInArrow(lambda batches: _gathered(rows(batches), schema), spark_schema)


def _file_bytes(path: str, content: bytes | None) -> bytes:
    return store.read(path) if content is None else content


def convert_files(tasks: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """Convert ``tasks`` and write their outputs: input_path, output_path, status, converted_size, error_message, output_files.

    A task's file is read, converted and written in one pass; bytes never leave the worker. Files are read where ``tasks`` has no
    content. Collect or store the result once: each evaluation writes again.
    """

    kinds = (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), ARROW_LISTED)
    schema = pa.schema(list(zip(("input_path", "output_path", "status", "converted_size", "error_message", "output_files"), kinds, strict=True)))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, tuple]]:
        for task, made, error in _each(batches, settings, _file_bytes):
            if made is not None:
                try:
                    for path, data, _ in made:
                        store.write(path, data)
                except OSError as e:
                    made, error = None, f"Output writing error: {e.strerror or e}"
            listed = [{"path": p, "size_bytes": len(b), "description": d} for p, b, d in made or []]
            yield 0, (task[0], task[4], "failed" if made is None else "success", sum(f["size_bytes"] for f in listed), error, listed)

    spark_schema = f"input_path string, output_path string, status string, converted_size bigint, error_message string, output_files {LISTED}"
    return _selected(tasks).mapInArrow(lambda batches: _gathered(rows(batches), schema), spark_schema)


def page_counts(files: DataFrame) -> DataFrame:
    """``files`` (input_path) with n_pages; null where the file can't be read as PDF, which its task will say."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for path in batch.column(0).to_pylist():
                try:
                    found.append(pdf.page_count(_file_bytes(path, None)))
                except (OSError, CodecError):
                    found.append(None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], ["input_path", "n_pages"])

    return files.select("input_path").mapInArrow(run, "input_path string, n_pages bigint")
