"""Mixing sources to target weights by the cube method.

Each source's target gives a rate: words wanted per word there are, from 0 to 2. A document is taken floor(rate)
times for certain, and once more with the fractional rest as its inclusion probability. The cube method makes
that choice: the vector of probabilities moves through the null space of the balancing constraints (documents and
words of the source), each move fixing at least one document at 0 or 1, so both totals stay what they were.

Documents are dealt to blocks within their source, and each block's flight runs in one task; the at most ten
documents it leaves undecided go, with their probabilities as they then are, to the next level, where a block
gathers what many blocks left, until a source has one block. A source with a third of all rows is so many blocks. Only
at the end are a dozen documents of each source landed, by whichever outcome leaves its words closest to the target.

Random moves come from a generator seeded with the source and the block, and rows are ordered by size, doc_id and
a hash of the text: reruns agree.

Defined results: a null text has size 0 and is taken 0 words; null sources are one source, ordered last; repeated
rows are documents of their own; a text of any length is one document, counted whole; documents of equal size are ties
that the order by doc_id and text hash settles; an empty table gives an empty result; columns other than doc_id, text and source
are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.llm.common import BROADCAST_ROWS, batch_slices, materialize, small_side, text_column, unused
from fileloom.llm.wordblocks import Block

#: Documents of a flight, at about.
BLOCK = 4096
#: Documents set aside for the landing, which tries all their outcomes; and those that other flights leave to the next level.
LANDING, KEPT_OPEN = 12, 8
WEIGHTS, SHARE, MOST = (3, 1, 2), 1.5, 2.0


def sized(docs: DataFrame) -> DataFrame:
    """doc_id, source, hash of the text, words of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batch_slices(batches):
            _, _, first = Block.of(text_column(batch)).words()
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(np.diff(first))], ["doc_id", "source", "digest", "size"])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("source").cast("string"), F.xxhash64("text").alias("digest"), "text")
    return rows.mapInArrow(run, "doc_id long, source string, digest long, size long")


def targets(sizes: list[tuple[str | None, int]], weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> dict[str | None, float]:
    """Words wanted of each source: shares by weight, none above ``most`` times its size.

    ``sizes`` has one row per source; weights go round the sources in code point order, null last.
    """
    order = sorted((s for s, _ in sizes if s is not None)) + [None] * any(s is None for s, _ in sizes)
    size, left = dict(sizes), dict(zip(order, (weights[i % len(weights)] for i in range(len(order))), strict=True))
    wanted, out = share * sum(size.values()), {}
    while left:
        unit = wanted / sum(left.values())
        full = [s for s, w in left.items() if w * unit > most * size[s]]
        if not full:
            return out | {s: w * unit for s, w in left.items()}
        for s in full:
            out[s] = most * size[s]
            wanted -= out[s]
            del left[s]
    return out


def flight(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """Moves the probabilities, keeping their sum and that of prob * size, until at most two lie strictly between 0 and 1."""
    p, x = prob.tolist(), size.tolist()
    draws = iter(rng.random(3 * len(p) + 3).tolist())
    active: list[int] = []
    for i in range(len(p)):
        if 0 < p[i] < 1:
            active.append(i)
        while len(active) == 3:
            a, b, c = active
            move = [x[b] - x[c], x[c] - x[a], x[a] - x[b]]  # sums to 0, and so does its product with the sizes
            if move == [0, 0, 0]:
                move = [1, -1, 0]
            up = down = float("inf")
            for k, m in zip(active, move, strict=True):
                if m:
                    up = min(up, (1 - p[k]) / m if m > 0 else p[k] / -m)
                    down = min(down, p[k] / m if m > 0 else (1 - p[k]) / -m)
            step = up if next(draws) * (up + down) < down else -down
            for k, m in zip(active, move, strict=True):
                p[k] += step * m
                p[k] = 0.0 if p[k] < 1e-9 else 1.0 if p[k] > 1 - 1e-9 else p[k]
            active = [k for k in active if 0 < p[k] < 1]
    return np.array(p)


def land(prob: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Decides the last documents: the outcome whose words, then number, are closest to those expected."""
    left = np.flatnonzero((prob > 0) & (prob < 1))
    picks = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
    words, number = np.abs((picks - prob[left]) @ size[left]), np.abs((picks - prob[left]).sum(1))
    out = prob.copy()
    out[left] = picks[np.lexsort((number, words.round(6)))[0]]
    return out


def set_aside(prob: np.ndarray, size: np.ndarray, rng: np.random.Generator, n: int) -> np.ndarray:
    """A flight of all but ``n`` documents, whose sizes halve from one to the next: their outcomes can make up many sums.

    Rows are sorted by size, longest first.
    """
    undecided = np.flatnonzero((prob > 0) & (prob < 1))
    wanted = size[undecided[:1]].sum() / 2.0 ** np.arange(n)
    aside = np.unique(undecided[np.minimum(np.searchsorted(-size[undecided], -wanted), max(0, len(undecided) - 1))]) if len(undecided) else undecided
    rest = np.setdiff1d(np.arange(len(prob)), aside)
    out = prob.copy()
    out[rest] = flight(prob[rest], size[rest], rng)
    return out


def _seed(source: str | None, level: int, block: int) -> list[int]:
    return [crc32((source or "").encode()), source is None, level, block]


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, block: int = BLOCK) -> DataFrame:
    """doc_id, size, digest, source, source_size, target, copies, taken of each document."""
    spark = docs.sparkSession
    rows = materialize(sized(docs), "sizes")
    # One row per source: a corpus has far fewer sources than documents, and only names and sums come here.
    sums = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n")).collect()
    wanted = targets([(r.source, r.source_size) for r in sums], weights, share, most)
    plan = [(r.source, r.source_size, r.n, float(wanted[r.source]), wanted[r.source] / r.source_size if r.source_size else 0.0, max(1, -(-r.n // block))) for r in sums]
    rates = spark.createDataFrame(plan, "source string, source_size long, n long, target double, rate double, blocks long")
    # Rates have a row per source, as the sums above; a corpus of very many sources is joined by a shuffle.
    rates = F.broadcast(rates) if len(plan) <= BROADCAST_ROWS else rates
    joined = rows.join(rates, rows.source.eqNullSafe(rates.source)).drop(rates.source)
    joined = joined.withColumn("block", F.pmod(F.xxhash64("doc_id", "digest", "size"), F.col("blocks")))
    whole = F.floor("rate").cast("long")
    state = joined.select("doc_id", "digest", "source", "size", "source_size", "target", "blocks", "block", whole.alias("whole"), (F.col("rate") - whole).alias("prob"))
    schema = state.schema
    fan, level, decided = max(2, block // 8), 0, []
    most_blocks = max([p[5] for p in plan], default=1)
    while True:
        last = most_blocks == 1

        def run(pdf: pd.DataFrame) -> pd.DataFrame:  # pickled in this turn, so it sees this level
            pdf = pdf.sort_values(["size", "doc_id", "digest"], ascending=[False, True, True], na_position="first", kind="stable")
            source, prob, size = pdf["source"].iloc[0], pdf["prob"].to_numpy(), pdf["size"].to_numpy()
            source = None if pd.isna(source) else source
            rng, final = np.random.default_rng(_seed(source, level, int(pdf["block"].iloc[0]))), pdf["blocks"].iloc[0] == 1
            prob = set_aside(prob, size, rng, LANDING if final else KEPT_OPEN)
            pdf["prob"] = land(prob, size) if final else prob
            return pdf

        moved = materialize(state.groupBy("source", "block").applyInPandas(run, schema), f"flight{level}")
        decided.append(moved.filter((F.col("prob") <= 0) | (F.col("prob") >= 1)))
        if last:
            break
        left = moved.filter((F.col("prob") > 0) & (F.col("prob") < 1))
        state = left.withColumns({"block": F.floor(F.col("block") / fan).cast("long"), "blocks": F.ceil(F.col("blocks") / fan).cast("long")}).select(schema.names)
        most_blocks, level = -(-most_blocks // fan), level + 1
    out = decided[0]
    for more in decided[1:]:
        out = out.unionByName(more)
    copies = F.col("whole") + F.col("prob").cast("long")
    return out.select("doc_id", "size", "source_size", "target", (copies * F.col("size")).alias("taken"), "source", copies.alias("copies"), "digest")


def take_mix(docs: DataFrame) -> DataFrame:
    """``docs`` as mixed: each row as often as it is taken, with all its columns, whatever their names.

    Rows that share id, text and source are taken as often as their mean, rounded.
    """
    doc_id, digest, source, copies, turn = unused(docs, "mix_id", "mix_digest", "mix_source", "copies", "turn")
    decided = mix(docs).groupBy("doc_id", "digest", "source").agg(F.round(F.avg("copies")).cast("int").alias(copies)).filter(F.col(copies) > 0)
    decided = small_side(decided.withColumnsRenamed({"doc_id": doc_id, "digest": digest, "source": source}), "decided")
    same = docs["doc_id"].cast("long").eqNullSafe(decided[doc_id]) & (F.xxhash64(docs["text"]) == decided[digest]) & docs["source"].cast("string").eqNullSafe(decided[source])
    taken = docs.join(decided, same).withColumn(turn, F.explode(F.sequence(F.lit(1), F.col(copies))))
    return taken.select(*[docs[x] for x in docs.columns])
