"""Packing along a space-filling curve.

Each document's bag of tokens is projected to ``DIMS`` dimensions (the mean of a hashed value per token and
dimension); the point's place on a Hilbert curve is the sort key. Documents are range-partitioned and sorted by that
key, so that neighbours on the curve share sequences, and are packed one after the other: a document is cut where a
sequence is full. Only a partition's last sequence can be short; it is cut into lengths that are powers of two, which
need no padding.

Tokens are encoded once, into a table in the shared folder; the range shuffle then moves ids. Pieces are numbered
within their partition, and a partition's first sequence number comes from the partitions' counts.

Defined results: null text is empty and gives the end id alone; ties on the curve (copies) are ordered by doc_id,
null ids first, then in any order, so that copies are dealt to several tasks; each row is packed, repeated rows too; a text of any
length is packed whole; an empty table gives no piece; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.llm.common import among_equals, batch_slices, drop, materialize, partitions, text_column
from fileloom.llm.encoding import encoder
from fileloom.llm.wordblocks import mix

SEQUENCE = 2048
DIMS, BITS = 3, 10
#: Means of projected tokens lie within about this distance of 0; what lies beyond is clipped.
REACH = 0.5


@lru_cache(maxsize=2)
def directions(size: int) -> np.ndarray:
    """Pseudo-random value of each token id in each dimension, from -1 to 1."""
    hashes = mix(np.arange(size, dtype=np.uint64) + np.uint64(0x9E3779B97F4A7C15))
    return np.stack([((hashes >> np.uint64(20 * d)) & np.uint64(0xFFFFF)).astype(np.float64) / (1 << 19) - 1 for d in range(DIMS)]).astype(np.float32)


def project(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Grid coordinates (document, dimension) of documents given by their ids, one after the other; none is empty."""
    begin = np.cumsum(lengths) - lengths
    table = directions(1 << (8 * ids.dtype.itemsize) if ids.dtype.itemsize == 2 else int(ids.max()) + 1)
    mean = np.stack([np.add.reduceat(np.take(own, ids), begin) / lengths for own in table], axis=1)
    return np.clip((mean / REACH + 1) / 2 * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)


def hilbert_key(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Place of each grid point on the Hilbert curve (Skilling's transposition, for all points at once)."""
    x = [points[:, d].copy() for d in range(points.shape[1])]
    step = 1 << (bits - 1)
    while step > 1:
        low = step - 1
        for axis in x:
            flip = (axis & step) != 0
            swap = np.where(flip, 0, (x[0] ^ axis) & low)
            x[0] ^= np.where(flip, low, swap)
            if axis is not x[0]:
                axis ^= swap
        step >>= 1
    for d in range(1, len(x)):
        x[d] ^= x[d - 1]
    turn = np.zeros_like(x[0])
    step = 1 << (bits - 1)
    while step > 1:
        turn ^= np.where((x[-1] & step) != 0, step - 1, 0)
        step >>= 1
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for axis in x:
            key = (key << 1) | (((axis ^ turn) >> bit) & 1)
    return key


def encoded(docs: DataFrame, tokenizer_path: str, end_id: int) -> DataFrame:
    """doc_id, curve key, ids (little-endian, with the end id) of each document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        for batch in batch_slices(batches):
            ids = [x + end for x in encode.encode([x or "" for x in text_column(batch).to_pylist()])]
            lengths = np.array([len(x) for x in ids]) // encode.dtype.itemsize
            curve = hilbert_key(project(np.frombuffer(b"".join(ids), dtype=encode.dtype), lengths))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(curve), pa.array(ids, pa.binary()), pa.array([encode.dtype.itemsize] * len(ids), pa.int32())], ["doc_id", "curve", "ids", "width"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, curve long, ids binary, width int")


PIECE = "part long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long, local long, offset long, sequence_length long"
NAMES = [x.split()[0] for x in PIECE.split(", ")]


def powers(n: int) -> list[int]:
    """``n`` as a sum of falling powers of two."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


class Packer:
    """Fills sequences with documents in the order given; rows of ``closed`` are ready to be returned."""

    def __init__(self, part: int, size: int = SEQUENCE):
        self.part, self.size, self.number, self.fill = part, size, 0, 0
        self.open: list[tuple] = []
        self.closed: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        at = 0
        while at < len(ids):
            take = min(self.size - self.fill, len(ids) - at)
            self.open.append((doc_id, at, ids[at : at + take], len(ids)))
            self.fill, at = self.fill + take, at + take
            if self.fill == self.size:
                self._close(self.open, self.size)
                self.open, self.fill = [], 0

    def _close(self, pieces: list[tuple], length: int) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            self.closed.append((self.part, doc_id, start, len(ids), zlib.crc32(ids.astype("<u4").tobytes()), total, self.number, offset, length))
            offset += len(ids)
        self.number += 1

    def finish(self) -> None:
        """Cut what is left into sequences whose lengths are powers of two."""
        left = self.open[::-1]
        for length in powers(self.fill):
            own, room = [], length
            while room:
                doc_id, start, ids, total = left.pop()
                if len(ids) > room:
                    left.append((doc_id, start + room, ids[room:], total))
                    ids = ids[:room]
                own.append((doc_id, start, ids, total))
                room -= len(ids)
            self._close(own, length)
        self.open, self.fill = [], 0


def pack(docs: DataFrame, tokenizer_path: str, end_id: int = 1, n: int | None = None, size: int = SEQUENCE) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_length."""
    spark = docs.sparkSession
    n = n or partitions(spark)
    tokens = materialize(encoded(docs, tokenizer_path, end_id), "tokens")  # ids hardly shrink under a stronger codec
    by = (F.col("curve"), F.col("doc_id").asc_nulls_first(), F.col("tie"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = Packer(TaskContext.get().partitionId(), size)

        def ready() -> pa.RecordBatch:
            rows, packer.closed = packer.closed, []
            return pa.RecordBatch.from_pydict(dict(zip(NAMES, zip(*rows), strict=True)), pa.schema([(x, pa.int64()) for x in NAMES]))

        for batch in batches:
            ids = batch.column(1)
            for k, (doc_id, width) in enumerate(zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)):
                packer.add(doc_id, np.frombuffer(ids[k].as_buffer(), dtype=f"<u{width}"))
                if len(packer.closed) > 10_000:
                    yield ready()
            packer.open = [(d, s, x.copy(), t) for d, s, x, t in packer.open]  # lets the batch go
        packer.finish()
        if packer.closed:
            yield ready()

    sorted_rows = tokens.withColumn("tie", among_equals()).repartitionByRange(n, *by).sortWithinPartitions(*by)
    pieces = materialize(sorted_rows.select("doc_id", "ids", "width").mapInArrow(run, PIECE), "pieces")
    drop(tokens)
    counts = pieces.groupBy("part").agg(F.max("local").alias("last")).orderBy("part").collect()  # one row per partition
    bases, total = [], 0
    for row in counts:
        bases.append((row.part, total))
        total += row.last + 1
    base = spark.createDataFrame(bases, "part long, base long")
    out = pieces.join(F.broadcast(base), "part")  # as many rows as partitions
    return out.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", (F.col("base") + F.col("local")).alias("sequence_id"), "offset", "sequence_length")
