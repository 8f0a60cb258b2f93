"""Minimax contiguous partition into shards, with DataFrame functions only.

Documents of equal text are one atomic group, ordered by the MD5 digest of the text; sizes are UTF-8 bytes plus one. The
smallest shard capacity for which the ordered groups fit in ``shards`` contiguous runs is found by search: a
capacity is feasible if greedy filling reaches the end. Greedy filling only asks "the last group that ends within
x bytes", and only near the even cuts. Where those stretches hold at most ``NEAR_ROWS`` groups, which is counted, their ends come
to the driver at once; beyond that (a group as large as a shard, very many tiny groups) each question is a job over the table of
running totals, which is written sorted, so it reads a few row groups and answers for ``WAYS`` capacities at once. Both ways
give the same cuts. Cuts are then put as close to even as that capacity allows.

Running totals take two levels (blocks by the digest's first digits, then within each block), so no task orders the
whole table. Rows in a group are numbered by salted parts of it, so a group that holds a third of all rows is spread over
``SALTS`` tasks, and its rows without id, which no salt can tell apart, by the files that they come from.

Defined results: a null text has size 1 and all null texts are one group; ties within a salted part go by doc_id, equal rows in any
order; each row is placed; a text of any length is one document and lies in one shard; an empty table gives an empty result;
columns other than doc_id and text are not read.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right
from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fileloom.llm.common import materialize

SALTS = 64
#: Capacities tried at once.
WAYS = 48
BLOCK_DIGITS = 3
#: Groups whose ends may come to the driver.
NEAR_ROWS = 100_000


def sized(docs: DataFrame) -> DataFrame:
    """Small columns of each document: its text never moves."""
    text = F.col("text")
    return docs.select(
        "doc_id",
        (F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + 1).alias("size"),
        F.crc32(F.coalesce(text, F.lit("")).cast("binary")).alias("text_crc32"),
        F.coalesce(F.md5(text.cast("binary")), F.lit("null")).alias("grp"),
    ).withColumns({"salt": F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)), "piece": F.when(F.col("doc_id").isNull(), F.spark_partition_id()).otherwise(0)})


def running_totals(parts: DataFrame) -> DataFrame:
    """grp, n, bytes, rows_before, bytes_before of each group, in order of ``grp``."""
    groups = parts.groupBy("grp").agg(F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    groups = groups.withColumn("block", F.substring("grp", 1, BLOCK_DIGITS))
    blocks = groups.groupBy("block").agg(F.sum("n").alias("bn"), F.sum("bytes").alias("bb"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)  # over 16^BLOCK_DIGITS + 1 rows at most
    blocks = blocks.select("block", F.coalesce(F.sum("bn").over(before), F.lit(0)).alias("bn0"), F.coalesce(F.sum("bb").over(before), F.lit(0)).alias("bb0"))
    own = Window.partitionBy("block").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    return groups.join(F.broadcast(blocks), "block").select(
        "grp", "n", "bytes",
        (F.col("bn0") + F.coalesce(F.sum("n").over(own), F.lit(0))).alias("rows_before"),
        (F.col("bb0") + F.coalesce(F.sum("bytes").over(own), F.lit(0))).alias("bytes_before"),
    )


class Totals:
    """Looks up where groups end and start."""

    def __init__(self, totals: DataFrame):
        self.ends = totals.select((F.col("bytes_before") + F.col("bytes")).alias("end"), F.col("bytes_before").alias("begin"))
        row = totals.agg(F.max(F.col("bytes_before") + F.col("bytes")), F.max("bytes")).first()
        self.total, self.largest = row[0] or 0, row[1] or 0

    def ask(self, lasts: list[int], firsts: list[int] = ()) -> tuple[list[int], list[int]]:
        """In one job: for each of ``lasts`` the greatest group end that is no greater (0 if none is), for each of
        ``firsts`` the least group start that is no less (the total if none is). Only rows near those places are read."""
        near = [(F.col("end") <= x) & (F.col("end") > x - self.largest - 1) for x in sorted(set(lasts))]
        near += [(F.col("begin") >= x) & (F.col("begin") < x + self.largest + 1) for x in sorted(set(firsts))]
        wanted = [F.max(F.when(F.col("end") <= x, F.col("end"))) for x in lasts] + [F.min(F.when(F.col("begin") >= x, F.col("begin"))) for x in firsts]
        got = list(self.ends.filter(reduce(or_, near)).agg(*[x.alias(f"a{k}") for k, x in enumerate(wanted)]).first())
        return [x or 0 for x in got[: len(lasts)]], [self.total if x is None else x for x in got[len(lasts) :]]


class NearTotals(Totals):
    """Answers from the group ends and starts near the even cuts, as far as they came to the driver."""

    def __init__(self, totals: DataFrame, shards: int):
        super().__init__(totals)
        # No place that is asked for lies farther from an even cut: each step of a filling is off by a group at most.
        reach = 4 * (shards + 1) * (self.largest + 1)
        self.stretches: list[tuple[int, int]] = []
        for k in range(shards + 1):
            middle = self.total * k // shards
            lo, hi = max(0, middle - reach), min(self.total, middle + reach)
            if self.stretches and lo <= self.stretches[-1][1]:
                self.stretches[-1] = (self.stretches[-1][0], hi)
            else:
                self.stretches.append((lo, hi))
        near = reduce(or_, [(F.col("end") >= lo) & (F.col("begin") <= hi) for lo, hi in self.stretches])
        found = self.ends.filter(near).limit(NEAR_ROWS + 1).collect()
        self.known = len(found) <= NEAR_ROWS
        self.near_ends, self.near_begins = sorted(r.end for r in found), sorted(r.begin for r in found)

    def inside(self, x: int) -> bool:
        """Whether the ends and starts next to a place are known."""
        return any((lo == 0 or x - self.largest > lo) and (hi == self.total or x + self.largest < hi) for lo, hi in self.stretches if lo <= x <= hi)

    def ask(self, lasts: list[int], firsts: list[int] = ()) -> tuple[list[int], list[int]]:
        places = [min(self.total, max(0, x)) for x in [*lasts, *firsts]]
        if not self.known or not all(map(self.inside, places)):
            return super().ask(lasts, firsts)
        ends, begins = self.near_ends, self.near_begins
        last = [ends[k - 1] if (k := bisect_right(ends, x)) else 0 for x in lasts]
        return last, [begins[k] if (k := bisect_left(begins, x)) < len(begins) else self.total for x in firsts]


def fits(totals: Totals, capacities: list[int], shards: int) -> list[bool]:
    """Greedy filling, for all capacities at once."""
    at = [0] * len(capacities)
    for _ in range(shards):
        at, _ = totals.ask([a + c for a, c in zip(at, capacities, strict=True)])
        if min(at) >= totals.total:
            break
    return [a >= totals.total for a in at]


def capacity(totals: Totals, shards: int) -> int:
    """The smallest feasible capacity."""
    lo = max(totals.largest, -(-totals.total // shards)) - 1  # not known to be feasible
    hi = max(totals.largest, -(-totals.total // shards) + totals.largest)  # feasible
    tried = sorted({min(hi, lo + (1 << k)) for k in range((hi - lo).bit_length() + 1)})  # it is often close to the least
    while hi - lo > 1:
        good = [c for c, ok in zip(tried, fits(totals, tried, shards), strict=True) if ok]
        bad = [c for c in tried if not good or c < min(good)]
        lo, hi = max([lo, *bad]), min([hi, *good])
        tried = sorted({lo + max(1, (hi - lo) * k // (WAYS + 1)) for k in range(1, WAYS + 1)})
    return hi


def cuts(totals: Totals, shards: int) -> list[int]:
    """Bytes before shards 1, 2, ...: as even as the smallest capacity allows."""
    if not totals.total:
        return [0] * (shards - 1)
    most = capacity(totals, shards)
    latest, earliest = [0], [totals.total]
    for _ in range(shards - 1):
        last, first = totals.ask([latest[-1] + most], [max(0, earliest[-1] - most)])
        latest.append(last[0])
        earliest.append(first[0])
    found = [0]
    for k in range(1, shards):
        ideal = found[-1] + (totals.total - found[-1]) // (shards - k + 1)
        low, high = earliest[shards - k], min(latest[k], found[-1] + most)
        (below, within), (above,) = totals.ask([ideal, min(max(ideal, low), high)], [ideal])
        near = below if ideal - below <= above - ideal else above
        found.append(max(near if low <= near <= high else within, low, found[-1]))
    return found[1:]


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of each document."""
    rows = materialize(sized(docs), "sized")
    parts = materialize(rows.groupBy("grp", "salt", "piece").agg(F.count("*").alias("n"), F.sum("size").alias("bytes")), "parts")
    groups = running_totals(parts)
    totals = materialize(groups.repartitionByRange("bytes_before").sortWithinPartitions("bytes_before"), "totals")
    at = cuts(NearTotals(totals, shards), shards)
    number = sum((F.when(F.col("bytes_before") >= x, 1).otherwise(0) for x in at), F.lit(0)).cast("int")
    placed = totals.withColumn("shard", number)
    first = placed.groupBy("shard").agg(F.min("rows_before").alias("shard_rows"))  # one row per shard
    placed = placed.join(F.broadcast(first), "shard").select("grp", "shard", (F.col("rows_before") - F.col("shard_rows")).alias("base"))
    salted = Window.partitionBy("grp").orderBy("salt", "piece").rowsBetween(Window.unboundedPreceding, -1)  # over SALTS rows, and one per file
    bases = parts.select("grp", "salt", "piece", F.coalesce(F.sum("n").over(salted), F.lit(0)).alias("salt_rows")).join(placed, "grp")
    own = Window.partitionBy("grp", "salt", "piece").orderBy(F.col("doc_id").asc_nulls_first())
    ranked = rows.withColumn("rank", F.row_number().over(own) - 1)
    return ranked.join(bases, ["grp", "salt", "piece"]).select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("base") + F.col("salt_rows") + F.col("rank")).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
