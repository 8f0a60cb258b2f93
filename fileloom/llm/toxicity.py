"""Toxicity by compression distance.

Two zstandard dictionaries of equal size are trained, one on toxic and one on ordinary text. A trainer in the manner of zstandard's
own (cover: take the segments whose byte sequences of length ``DMER`` are worth most, then count those sequences no more) is run
on each class apart; a sequence is worth the share of the class's documents that have it, times the logarithm of how much rarer it is
in the other class, so that what both classes share isn't learned twice. Behind its own segments each dictionary has
the same common words of ordinary text: windows then compress alike but for what marks a class. (zstandard's trainer, which
sees one class at a time, spends both dictionaries on text that both classes share; the README has figures.)

A text is cut into windows of ``WINDOW`` words; a window that the toxic dictionary compresses to fewer bytes than the ordinary
one has something of the toxic material in it. The mean gain per window, the shares of windows beyond two thresholds, and the largest
gains go through a logistic curve, whose weights, like the size of the trained segments, are calibrated on labelled documents
kept out of the dictionaries.

Fitting reads at most about ``sample`` labelled documents of each class (twice as many ordinary ones), those with the least hash
of their id, never from the held-out fold; of a sampled document at most ``SAMPLE_WORDS`` words are used. Scoring reads whole texts
of any length in one pass, with no shuffle.

Defined results: a text without words (null or empty) gets the score of a text without gains; a document with several labels is
toxic if any of them says so; rows that share a labelled id are all learned from; with no labelled
documents of both classes every score is 0; every row gives a row, repeated rows the same score; an empty table gives an empty
result; columns other than doc_id and text are not read.
"""

from __future__ import annotations

import heapq
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.llm.common import batch_slices, held_out, text_column
from fileloom.llm.wordblocks import mix

WINDOW = 8
SAMPLE, SAMPLE_WORDS = 2500, 4000
ORDINARY_WORDS = 2000
#: Bytes of a class's own segments that calibration chooses from.
SEGMENT_BYTES = (128, 256, 512, 1024)
#: Bytes of the sequences that training counts; least logarithm of how much rarer one is in the other class; least share of documents.
DMER, RARER, LEAST_SHARE = 6, 1.0, 0.005
SPLIT = re.compile("[^\x20\x09-\x0d]+")
FEATURES = 6


def windows(text: str) -> list[bytes]:
    words = SPLIT.findall(text.lower())
    return [f" {' '.join(words[i : i + WINDOW])} ".encode("utf-8", "replace") for i in range(0, len(words), WINDOW)]


def _parameters() -> zstandard.ZstdCompressionParameters:
    return zstandard.ZstdCompressionParameters(
        min_match=4, strategy=zstandard.STRATEGY_GREEDY, window_log=17, chain_log=16, hash_log=16, search_log=4,
        write_content_size=False, write_checksum=False, write_dict_id=False,
    )


class Compressor:
    """Compressed lengths of windows under one dictionary."""

    def __init__(self, dictionary: bytes):
        parameters = _parameters()
        data = zstandard.ZstdCompressionDict(dictionary, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        data.precompute_compress(compression_params=parameters)
        self.compressor = zstandard.ZstdCompressor(dict_data=data, compression_params=parameters)

    def lengths(self, pieces: list[bytes]) -> np.ndarray:
        if not pieces:
            return np.zeros(0, dtype=np.int64)
        done = self.compressor.multi_compress_to_buffer(pieces)
        return np.fromiter((len(done[i]) for i in range(len(done))), dtype=np.int64, count=len(done))


_compressors: dict[bytes, Compressor] = {}


def compressor(dictionary: bytes) -> Compressor:
    if dictionary not in _compressors:
        if len(_compressors) > 16:
            _compressors.clear()
        _compressors[dictionary] = Compressor(dictionary)
    return _compressors[dictionary]


def gains(cut: list[list[bytes]], ordinary: bytes, toxic: bytes) -> list[np.ndarray]:
    """Bytes that the toxic dictionary saves over the ordinary one, for each window of each text."""
    flat = [w for x in cut for w in x]
    gain = compressor(ordinary).lengths(flat) - compressor(toxic).lengths(flat)
    return np.split(gain, np.cumsum([len(x) for x in cut])[:-1]) if cut else []


def features(gain: np.ndarray) -> list[float]:
    if not len(gain):
        return [0.0] * FEATURES
    top = np.sort(gain)[::-1][:3]
    n = len(gain)
    return [float(np.clip(gain.mean(), -2, 4)), float((gain >= 2).mean()), float((gain >= 4).mean()), float(np.clip(top[0], 0, 12)) / 4, float(np.clip(top.mean(), 0, 12)) / 4, float(gain.clip(-2, 8).sum() / np.sqrt(n)) / 4]


class Model:
    """Dictionaries and weights; a few hundred kilobytes at most."""

    def __init__(self, ordinary: bytes, toxic: bytes, weights: np.ndarray):
        self.ordinary, self.toxic, self.weights = ordinary, toxic, weights

    def scores(self, texts: list[str]) -> np.ndarray:
        if not texts:
            return np.zeros(0)
        x = np.array([features(g) for g in gains([windows(x) for x in texts], self.ordinary, self.toxic)])
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[1:] + self.weights[0], -40, 40)))


def auc(score: np.ndarray, label: np.ndarray) -> float:
    values, at, counts = np.unique(score, return_inverse=True, return_counts=True)
    rank = (np.cumsum(counts) - counts / 2 + 0.5)[at]
    n = int(label.sum())
    return float((rank[label == 1].sum() - n * (n + 1) / 2) / (n * (len(label) - n))) if 0 < n < len(label) else 0.5


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 0.05) -> np.ndarray:
    """Weights by Newton's method, intercept first."""
    x = np.concatenate([np.ones((len(x), 1)), x], axis=1)
    w, ridge = np.zeros(x.shape[1]), penalty * np.eye(x.shape[1])
    ridge[0, 0] = 1e-6
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p) + 1e-9)[:, None]) + ridge, x.T @ (y - p) - ridge @ w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def dmers(data: bytes) -> np.ndarray:
    """All byte sequences of length ``DMER``, as numbers."""
    codes = np.frombuffer(data, dtype=np.uint8).astype(np.uint64)
    n = max(0, len(codes) - DMER + 1)
    out = np.zeros(n, dtype=np.uint64)
    for k in range(DMER):
        out = out << np.uint64(8) | codes[k : k + n]
    return out


def _distinct(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values; one sort is faster here than numpy's hashing."""
    values = np.sort(values)
    fresh = np.ones(len(values), dtype=bool)
    fresh[1:] = values[1:] != values[:-1]
    return values[fresh]


def _plain(text: str) -> bytes:
    return f" {' '.join(SPLIT.findall(text.lower()))} ".encode("utf-8", "replace")


def spread_of(texts: list[str], least: float) -> tuple[np.ndarray, np.ndarray]:
    """Sequences that at least so many of the texts have, and how many have each.

    Counts by hash bucket come first, so that the many rare sequences are never held together.
    """
    buckets = np.zeros(1 << 22, dtype=np.int32)
    place = lambda x: (mix(x) & np.uint64(len(buckets) - 1)).astype(np.int64)
    for x in texts:
        buckets[_distinct(place(dmers(_plain(x))))] += 1
    held = [np.zeros(0, dtype=np.uint64)]
    for x in texts:
        own = _distinct(dmers(_plain(x)))
        held.append(own[buckets[place(own)] >= least])
    keys, counts = np.unique(np.concatenate(held), return_counts=True)
    return keys[counts >= least], counts[counts >= least]


def counted(keys: np.ndarray, texts: list[str]) -> np.ndarray:
    """How many of the texts have each of the sequences."""
    out = np.zeros(len(keys), dtype=np.int64)
    for x in texts if len(keys) else ():
        own = _distinct(dmers(_plain(x)))
        at = np.minimum(np.searchsorted(keys, own), len(keys) - 1)
        out[at[keys[at] == own]] += 1
    return out


def segments(texts: list[str], others: list[str], size: int) -> list[bytes]:
    """Words of a class's texts that cover what marks the class against the other's, the most valuable first, about ``size`` bytes."""
    n = len(texts)
    keys, counts = spread_of(texts, max(3, LEAST_SHARE * n))
    rarer = np.log((counts + 0.5) / (n + 1)) - np.log((counted(keys, others) + 0.5) / (len(others) + 1))
    worth = counts / n * np.maximum(0, rarer - RARER)
    value = dict(zip(keys[worth > 0].tolist(), worth[worth > 0].tolist(), strict=True))
    listed = sorted({f" {w} ".encode("utf-8", "replace") for x in texts for w in SPLIT.findall(x.lower())})
    codes, start = dmers(b"".join(listed)), np.concatenate([[0], np.cumsum([len(x) for x in listed])])
    place = np.flatnonzero(np.isin(codes, keys[worth > 0]))
    word = np.searchsorted(start, place, "right") - 1
    whole = place + DMER <= start[word + 1]  # not across two words
    held: dict[bytes, list[int]] = {}
    for k, code in zip(word[whole].tolist(), codes[place[whole]].tolist(), strict=True):
        inside = held.setdefault(listed[k], [])
        if code not in inside:
            inside.append(code)
    heap = [(-sum(sorted(value[d] for d in inside)) / len(data), data) for data, inside in held.items()]
    heapq.heapify(heap)
    out, total = [], 0
    while heap and total < size:
        _, data = heapq.heappop(heap)
        now = -sum(sorted(value[d] for d in held[data])) / len(data)
        if now < 0 and heap and now > heap[0][0]:  # others have covered some of it
            heapq.heappush(heap, (now, data))
        elif now < 0:
            out.append(data)
            total += len(data)
            value.update(dict.fromkeys(held[data], 0.0))
    return out


def dictionary(found: list[bytes], size: int, common: bytes) -> bytes:
    """The segments that fit in ``size`` bytes, the best one nearest to the common words."""
    out, left = [], size
    for data in found:
        if len(data) > left:
            break
        out.append(data)
        left -= len(data)
    return b"".join(out[::-1]).rjust(size, b"\n") + common


def fit(toxic: list[str], ordinary: list[str]) -> Model | None:
    """Dictionaries from two of every three documents, calibration on the others; none without both classes."""
    if len(toxic) < 4 or len(ordinary) < 4:
        return None
    parts = [([x for k, x in enumerate(t) if k % 3], t[::3]) for t in (toxic, ordinary)]
    (toxic_fit, toxic_cal), (ordinary_fit, ordinary_cal) = parts
    words = Counter(w for x in ordinary_fit for w in SPLIT.findall(x.lower()))
    common = "".join(f" {w} " for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:ORDINARY_WORDS][::-1]).encode("utf-8", "replace")[-49_152:]
    bad_segments = segments(toxic_fit, ordinary_fit, max(SEGMENT_BYTES))
    good_segments = segments(ordinary_fit, toxic_fit, max(SEGMENT_BYTES))
    cut, label = [windows(x) for x in toxic_cal + ordinary_cal], np.array([1] * len(toxic_cal) + [0] * len(ordinary_cal))
    best = None
    for size in SEGMENT_BYTES:
        own = dictionary(good_segments, size, common), dictionary(bad_segments, size, common)
        x = np.array([features(g) for g in gains(cut, *own)])
        found = logistic(x, label)
        quality = auc(x @ found[1:], label) - np.mean((x @ found[1:] + found[0] >= 0) != label)
        if best is None or quality > best[0] + 1e-6:
            best = (quality, Model(*own, found))
    return best[1]


def _sample(docs: DataFrame, labels: DataFrame, sample: int) -> tuple[list[str], list[str]]:
    """Texts of at most about ``sample`` toxic and ``2 * sample`` other labelled documents outside the held-out fold."""
    known = labels.filter(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    known = known.groupBy(F.col("doc_id").cast("long").alias("labelled")).agg(F.max(F.col("toxic").cast("int")).alias("toxic"))
    counts = {r.toxic: r["count"] for r in known.groupBy("toxic").count().collect()}
    place = F.pmod(F.xxhash64(F.col("labelled"), F.lit(17)), F.lit(1 << 30)) / float(1 << 30)
    rate = F.when(F.col("toxic") == 1, min(1.0, sample / max(1, counts.get(1, 0)))).otherwise(min(1.0, 2 * sample / max(1, counts.get(0, 0))))
    ids = known.withColumn("place", place).filter(F.col("place") <= rate).orderBy("place", "labelled").limit(4 * sample)
    rows = docs.filter(~held_out()).select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(F.broadcast(ids), F.col("doc_id") == F.col("labelled"))  # bounded by the sample
    cut = F.array_join(F.slice(F.split("text", " "), 1, SAMPLE_WORDS), " ").alias("text")
    order = ("place", "doc_id", F.xxhash64("text"))  # rows that tie are equal
    found = rows.filter(F.col("text").isNotNull()).orderBy(*order).limit(8 * sample).select("doc_id", "toxic", cut).collect()
    found.sort(key=lambda r: (r.doc_id, r.text))
    return [r.text for r in found if r.toxic == 1], [r.text for r in found if r.toxic == 0]


def score_toxicity(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted of each document."""
    model = fit(*_sample(docs, labels, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches):
            texts = [x or "" for x in text_column(batch).to_pylist()]
            score = model.scores(texts) if model is not None else np.zeros(len(texts))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["doc_id", "held_out", "score", "predicted"])

    return docs.select(F.col("doc_id").cast("long"), held_out().alias("held_out"), "text").mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
