"""Lempel-Ziv phrase fingerprints.

A text is parsed from left to right into dictionary phrases: each phrase is the shortest run of characters that no
earlier phrase equals (LZ78). Similar texts share most phrases, as they would share a compressor's dictionary. The
set of phrase hashes is summarised by one-permutation min-hashing: ``BINS`` bins by hash, in each the least hash,
of which eight bits are kept; empty bins borrow from the next filled bin to the right. The likeness of two
fingerprints is the share of bins that agree.

A phrase's hash is built character by character, so the parse keeps only the set of hashes seen. The edited text of a
document shares its first three quarters with the document, so the parse of those is shared as well.

The next document, in ascending doc_id, is found without ordering all rows in one task: rows are range-partitioned
and sorted by id, which is the one time that texts move, and a partition's last document is finished in a second pass
over the partitions' first and last documents.

Defined results: a null text is empty; the empty text has the fingerprint of no phrases, which is like only itself;
null ids come first, equal ids are ordered by a hash of their text; every row gives a row; a table of one document is
its own next; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.llm.common import among_equals, batch_slices, materialize, partitions, text_column
from fileloom.llm.wordblocks import mix

BINS = 128
MASK = (1 << 58) - 1
FACTOR = 0x2545F4914F6CDD
U = np.uint64


def parse(codes: list[int] | bytes, seen: set[int], phrase: int = 1) -> int:
    """Adds the phrases of ``codes`` to ``seen``; ``phrase`` is the hash of a phrase begun before. Returns the open one."""
    add = seen.add
    for c in codes:
        phrase = (phrase * FACTOR + c) & MASK
        if phrase not in seen:
            add(phrase)
            phrase = 1
    return phrase


def codes_of(text: str) -> list[int] | bytes:
    """Code points, from 1."""
    try:
        return text.encode("latin-1")
    except UnicodeEncodeError:
        return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4").tolist()


def signature(seen: set[int], last: int) -> np.ndarray:
    """The signature of the phrases and of the unfinished one at the end."""
    n = len(seen) + (last != 1)
    if not n:
        return np.zeros(BINS, dtype=np.uint8)
    values = np.fromiter(seen, dtype=np.uint64, count=len(seen))
    values = mix(np.append(values, U(last)) if last != 1 else values)
    order = (values & U(BINS - 1)).astype(np.int64)
    least = np.full(BINS, np.iinfo(np.uint64).max, dtype=np.uint64)
    np.minimum.at(least, order, values >> U(7))
    filled = np.flatnonzero(least != np.iinfo(np.uint64).max)
    source = filled[np.searchsorted(filled, np.arange(BINS)) % len(filled)]
    distance = (source - np.arange(BINS)) % BINS
    return (mix(least[source] + distance.astype(np.uint64) * U(0x9E3779B97F4A7C15)) & U(0xFF)).astype(np.uint8)


def fingerprint(text: str) -> np.ndarray:
    seen: set[int] = set()
    return signature(seen, parse(codes_of(text), seen))


def both_fingerprints(text: str, following: str) -> tuple[np.ndarray, np.ndarray, str]:
    """Signatures of the text and of the text with its last quarter replaced, and the edited text."""
    n = len(text)
    quarter = n // 4
    kept, tail, fresh = text[: n - quarter], text[n - quarter :], following[:quarter]
    seen: set[int] = set()
    open_ = parse(codes_of(kept), seen)
    edited = set(seen)
    return signature(seen, parse(codes_of(tail), seen, open_)), signature(edited, parse(codes_of(fresh), edited, open_)), kept + fresh


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


ROW = "doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, part long, first_text string, last_text string"
NAMES = [x.split()[0] for x in ROW.split(", ")]


def finished(doc_id: int | None, text: str, following: str, next_signature: np.ndarray | None = None) -> tuple:
    """The result row of a document, but for near_next, and its signature at the place of that."""
    own, edited, edited_text = both_fingerprints(text, following)
    digest = sha256(edited_text.encode("utf-8", "surrogatepass")).hexdigest()
    near = likeness(own, next_signature) if next_signature is not None else None
    return (doc_id, len(text), digest, own.tobytes(), edited.tobytes(), likeness(own, edited), near)


def batch_of(rows: list[tuple], names: list[str], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows), strict=True)), schema)


def arrow_schema() -> pa.Schema:
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64()}
    return pa.schema([(x.split()[0], kinds[x.split()[1]]) for x in ROW.split(", ")])


def _ordered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """All rows of a partition but the last, then one row with the partition's first and last text."""
    part, schema, rows = TaskContext.get().partitionId(), arrow_schema(), []
    first = before = waiting = None  # waiting: the row that lacks its likeness to ``before``
    for batch in batch_slices(batches):
        for doc_id, text in zip(batch.column(0).to_pylist(), text_column(batch).to_pylist(), strict=True):
            text = text or ""
            if before is None:
                first = text
            else:
                row = finished(*before, text)
                if waiting is not None:
                    rows.append((*waiting[:6], likeness(signature_of(waiting[3]), signature_of(row[3])), part, None, None))
                waiting = row
            before = (doc_id, text)
        if len(rows) > 2_000:
            yield batch_of(rows, NAMES, schema)
            rows = []
    if before is not None:
        if waiting is not None:
            rows.append((*waiting[:6], likeness(signature_of(waiting[3]), fingerprint(before[1])), part, None, None))
        rows.append((before[0], None, None, None, None, None, None, part, first, before[1]))
        yield batch_of(rows, NAMES, schema)


def signature_of(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, dtype=np.uint8)


def _closing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The last row of each partition, given the first text of the next."""
    schema = arrow_schema()
    for batch in batches:
        rows = []
        for doc_id, text, following, part in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
            rows.append((*finished(doc_id, text, following, fingerprint(following)), part, None, None))
        if rows:
            yield batch_of(rows, NAMES, schema)


def fingerprints(docs: DataFrame, n: int | None = None) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of each document."""
    spark = docs.sparkSession
    n = n or partitions(spark)
    by = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("tie"))
    rows = docs.select(F.col("doc_id").cast("long"), "text", among_equals()).repartitionByRange(n, *by).sortWithinPartitions(*by).select("doc_id", "text")
    found = materialize(rows.mapInArrow(_ordered, ROW), "fingerprints")
    edges = found.filter(F.col("last_text").isNotNull())
    filled = [r.part for r in edges.select("part").orderBy("part").collect()]  # as many as partitions
    following = spark.createDataFrame([(x, filled[(k + 1) % len(filled)]) for k, x in enumerate(filled)], "part long, next_part long")
    firsts = edges.select(F.col("part").alias("next_part"), F.col("first_text").alias("following"))
    pairs = edges.select("part", "doc_id", "last_text").join(following, "part").join(firsts, "next_part")
    closed = pairs.select("doc_id", "last_text", "following", "part").mapInArrow(_closing, ROW)
    out = found.filter(F.col("last_text").isNull()).unionByName(closed)
    return out.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"), F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
