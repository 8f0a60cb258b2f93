"""Token-id output as length-delimited binary records with a separate offset index.

A shard file is a sequence of frames: length (unsigned 64-bit), masked checksum of those eight bytes (unsigned
32-bit), payload, masked checksum of the payload; all little-endian. The checksum is CRC-32; masking rotates it right
by 15 bits and adds a constant, so that checksums of data that hold checksums stay useful. A payload is one document:
flags (1: the document id is null), bytes per id, two zero bytes, document id (signed 64-bit), ids. Beside each shard
lies ``.idx``: one unsigned 64-bit offset per frame, so that any frame can be read alone (shuffled reads).

Writing: documents are range-partitioned by id and sorted, each task streams one shard; a document's ids are all
that is held at once besides the Arrow batch. A file's name is new for each attempt, and only the manifest, which
Spark commits task by task, says which files count: lost executors and repeated or speculative tasks leave
unreferenced files, never wrong ones.

Defined results: null text is empty and gives the end id alone; null ids come first, equal ids are ordered by a hash
of their text, and equal rows stand in any order, dealt to several shards; every row gives one record; a text of any length is one
record; an empty table gives no shard; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fileloom.llm.common import among_equals, batch_slices, materialize, new_path, partitions, text_column
from fileloom.llm.encoding import encoder

MASK_DELTA = 0xA282EAD8
HEAD = struct.Struct("<QI")
META = struct.Struct("<BBHq")


def masked_crc(data: bytes) -> int:
    crc = zlib.crc32(data)
    return (((crc >> 15) | (crc << 17)) + MASK_DELTA) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    length = struct.pack("<Q", len(payload))
    return length + struct.pack("<I", masked_crc(length)) + payload + struct.pack("<I", masked_crc(payload))


def payload_of(doc_id: int | None, ids: bytes, width: int) -> bytes:
    return META.pack(doc_id is None, width, 0, doc_id or 0) + ids


def unframe(data: memoryview, at: int) -> tuple[memoryview, int]:
    """The payload of the frame at ``at`` and the end of the frame; a wrong checksum raises."""
    length, check = HEAD.unpack_from(data, at)
    if masked_crc(data[at : at + 8]) != check:
        raise ValueError(f"damaged frame length at {at}")
    payload = data[at + 12 : at + 12 + length]
    if masked_crc(payload) != struct.unpack_from("<I", data, at + 12 + length)[0]:
        raise ValueError(f"damaged frame at {at}")
    return payload, at + length + 16


def filesystem(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


MANIFEST = "shard long, file string, n_records long, n_tokens long, n_bytes long"


def write_records(docs: DataFrame, tokenizer_path: str, path: str, end_id: int, n: int | None = None) -> DataFrame:
    """Encode, write below ``path`` in ascending ``doc_id`` order, return the manifest (one row per shard file)."""
    n = n or partitions(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long"), "text", among_equals())
    by = (F.col("doc_id").asc_nulls_first(), F.xxhash64("text"), F.col("tie"))
    rows = rows.repartitionByRange(n, *by).sortWithinPartitions(*by).select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer_path)
        end = np.array([end_id], dtype=encode.dtype).tobytes()
        store, root = filesystem(path)
        shard = TaskContext.get().partitionId()
        name = f"{shard:06d}-{uuid.uuid4().hex}.rec"
        out, offsets, at, tokens = None, [], 0, 0
        for batch in batch_slices(batches):
            if out is None:
                store.create_dir(root, recursive=True)
                out = store.open_output_stream(f"{root}/{name}")
            texts = [x or "" for x in text_column(batch).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), encode.encode(texts), strict=True):
                ids += end
                record = frame(payload_of(doc_id, ids, encode.dtype.itemsize))
                out.write(record)
                offsets.append(at)
                at += len(record)
                tokens += len(ids) // encode.dtype.itemsize
        if out is not None:
            out.close()
            with store.open_output_stream(f"{root}/{name}.idx") as index:
                index.write(np.array(offsets, dtype="<u8").tobytes())
            yield pa.RecordBatch.from_pydict({"shard": [shard], "file": [name], "n_records": [len(offsets)], "n_tokens": [tokens], "n_bytes": [at]})

    return materialize(rows.mapInArrow(run, MANIFEST), "manifest")


def read_frames(path: str, name: str, order: np.ndarray | None = None, span: int = 1 << 22) -> Iterator[tuple[int, int | None, np.ndarray]]:
    """(record number, doc_id, ids) of a shard: in file order by spans of bytes, or single frames in ``order``."""
    store, root = filesystem(path)
    with store.open_input_stream(f"{root}/{name}.idx") as f:
        offsets = np.frombuffer(f.read(), dtype="<u8").astype(np.int64)
    with store.open_input_file(f"{root}/{name}") as f:
        bounds = np.append(offsets, f.size())
        k = 0
        while k < (len(offsets) if order is None else len(order)):
            lo = k if order is None else int(order[k])
            hi = max(lo + 1, int(np.searchsorted(bounds, bounds[lo] + span, "right")) - 1) if order is None else lo + 1
            data = memoryview(f.read_at(int(bounds[hi] - bounds[lo]), int(bounds[lo])))
            at = 0
            for number in range(lo, hi):
                payload, at = unframe(data, at)
                null, width, _, doc_id = META.unpack_from(payload)
                yield number, None if null else doc_id, np.frombuffer(payload[META.size :], dtype=f"<u{width}")
            k += hi - lo


def shard_starts(manifest: DataFrame) -> dict[int, int]:
    """Ids in all shards before each; the manifest has one row per shard, so its size is the number of partitions."""
    starts, total = {}, 0
    for row in manifest.select("shard", "n_tokens").orderBy("shard").collect():
        starts[row.shard], total = total, total + row.n_tokens
    return starts


def read_records(spark: SparkSession, manifest: DataFrame, path: str, shuffle_seed: int | None = None, ids: bool = True) -> DataFrame:
    """One row per record: shard, record, doc_id, start, n_tokens, ids_crc32 and, if wanted, the ids.

    With ``shuffle_seed`` each shard's records are read one by one in a random order, by the offset index.
    """
    starts = shard_starts(manifest)
    schema = "shard long, record long, doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * ids
    names = [x.split()[0] for x in schema.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for shard, name, n in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                order = None if shuffle_seed is None else np.random.default_rng([shuffle_seed, shard]).permutation(n)
                rows, held, total, before = [], 0, starts[shard], {}
                if order is not None:  # starts need the lengths in file order
                    for number, _, own in read_frames(path, name):
                        before[number], total = total, total + len(own)
                for number, doc_id, own in read_frames(path, name, order):
                    start = before.get(number, total)
                    rows.append((shard, number, doc_id, start, len(own), zlib.crc32(own.astype("<u4").tobytes()), *([own.astype(np.int64)] if ids else [])))
                    total, held = total + len(own), held + len(own) * ids
                    if len(rows) >= 10_000 or held > 1 << 21:
                        yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows), strict=True)), pa.schema(arrow))
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pydict(dict(zip(names, zip(*rows), strict=True)), pa.schema(arrow))

    arrow = [(x, pa.list_(pa.int64()) if x == "ids" else pa.int64()) for x in names]
    files = manifest.select("shard", "file", "n_records")
    return files.repartitionByRange(max(1, len(starts)), "shard").mapInArrow(run, schema)


def encode_and_read(docs: DataFrame, tokenizer_path: str, end_id: int = 2) -> DataFrame:
    """Write the record files in the shared folder and read them back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    path = new_path(spark, "records")
    manifest = write_records(docs, tokenizer_path, path, end_id)
    return read_records(spark, manifest, path, ids=False).select("doc_id", "start", "n_tokens", "ids_crc32", "shard", "record")
