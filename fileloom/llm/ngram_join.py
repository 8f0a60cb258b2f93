"""N-gram Jaccard join with several global token orders.

A document's set is its distinct ``K``-word shingles, as 64-bit hashes. Two sets with Jaccard similarity t or more share
a token among the first n - ceil(t n) + 1 tokens of each, under every global order of the tokens. Candidates must share a
prefix token under each of ``ORDERS`` orders:

1. Documents of equal sets become one class; copies are never compared. Classes carry a vector of token counts by hash
   bucket: the distance of two vectors is no more than the number of tokens in which the sets differ.
2. Groups of near copies are joined first, so that they needn't be compared pair by pair: classes that share a min-hash are
   compared to the most typical of them. Links found are verified, and make first components.
3. Prefix tokens under the first order are shuffled, and those that occur once are dropped. A token's classes are
   paired if they are of like size and not in one first component; a pair stays if its count vectors are near enough.
4. The filters are intersected before any set is fetched: a pair's ids are joined to small columns that hold the prefix
   tokens under every order as 32-bit numbers (which can only let more pairs pass), and pairs that share none under some order go.
5. What is left is verified on the full sets, and components of all links give the result.

Hot groups are split. A min-hash that more than ``HOT_STAR`` classes share is salted: each part has a most typical member, and
these are compared in a second round. A prefix token that more than ``HOT_TOKEN`` classes share is cut into blocks, and each pair
of blocks is a task's group of its own, so the comparison of an unlike group is spread over tasks.

All orders put frequent tokens last, so passages that many documents share are rarely in a prefix. Frequencies come from
one pass over all documents, in which each task reports tokens that repeat among its own; the most frequent ``HEAVY``
are broadcast (a fixed bound). Any order gives right results; frequencies only make prefixes rare.

Defined results: words are lower-cased (A-Z) runs of non-space; with fewer than K words the whole sequence is
the one shingle; null and wordless texts have no shingles and are linked with nothing (component_id is their own
doc_id); every row gives a row, repeated rows too; null ids take part in linking, and a component's id is the least id that
isn't null; texts of any length are taken whole, one longer than a batch alone; an empty table gives an empty result;
columns other than doc_id and text are not read, so their names don't matter.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fileloom.llm.common import arrow_batches, batch_slices, cells, drop, materialize, partitions, release_memory, small_side, text_column, unused
from fileloom.llm.components import components
from fileloom.llm.wordblocks import Block, mix, order_by, spread, windows

U = np.uint64
K, PERCENT, ORDERS = 5, 80, 3
HEAVY, HEAVY_FOLD, HEAVY_LEAST = 1 << 18, 1 << 21, 2
SALTS = [U(0x8C3D1F5A7B9E2461), U(0x1D8E4E27C47D124F), U(0xEB44ACCAB455D165), U(0x6A09E667F3BCC909)]


def shingle_sets(column: pa.Array, k: int = K) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes, text after text, and the bounds of each text's."""
    block = Block.of(column)
    starts, ends, first = block.words()
    counts = np.diff(first)
    hashes = block.hashes(starts, ends, lower=True)
    value, _, begin = windows(hashes, first, k)
    owner = spread(np.diff(begin))
    values, owners = [value], [owner]
    for n in range(1, k):
        texts = np.flatnonzero(counts == n)
        whole = np.zeros(len(texts), dtype=np.uint64)
        for j in range(n):
            whole = whole * U(0x9E3779B97F4A7C15) + hashes[first[texts] + j]
        values.append(mix(whole + U(n)))
        owners.append(texts)
    value, owner = np.concatenate(values), np.concatenate(owners)
    order = order_by(owner, value)
    value, owner = value[order], owner[order]
    fresh = np.ones(len(value), dtype=bool)
    fresh[1:] = (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])
    return value[fresh], np.concatenate([[0], np.cumsum(np.bincount(owner[fresh], minlength=len(block)))])


def set_names(values: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128-bit name of each set, as two signed numbers; equal sets have equal names."""
    out = []
    for salt in SALTS[:2]:
        total = np.zeros(len(values) + 1, dtype=np.uint64)
        np.cumsum(mix(values ^ salt), out=total[1:])
        out.append((mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64))).view(np.int64))
    return out[0], out[1]


def prefix_length(n: np.ndarray, percent: int = PERCENT) -> np.ndarray:
    return n - -(-n * percent // 100) + (n > 0)


class Frequent:
    """Tokens that every order puts last, the most frequent at the very end."""

    def __init__(self, tokens: np.ndarray):
        """``tokens``: from rare to frequent."""
        order = np.argsort(tokens)
        self.tokens, self.rank = tokens[order], order.astype(np.uint64) << U(62 - len(tokens).bit_length())  # in the first bits

    def keys(self, values: np.ndarray, order: int) -> np.ndarray:
        """Place of each token in the numbered order."""
        key = mix(values ^ SALTS[order]) >> U(1)
        if len(self.tokens):
            at = np.minimum(np.searchsorted(self.tokens, values), len(self.tokens) - 1)
            key = np.where(self.tokens[at] == values, self.rank[at] | U(1 << 63), key)
        return key


def prefixes(values: np.ndarray, bounds: np.ndarray, frequent: Frequent, order: int, percent: int = PERCENT) -> tuple[np.ndarray, np.ndarray]:
    """Prefix tokens of each set under an order, and whose they are."""
    n = np.diff(bounds)
    owner = spread(n)
    by = order_by(owner, frequent.keys(values, order))
    place = np.arange(len(values)) - bounds[owner]
    keep = place < prefix_length(n, percent)[owner]
    return values[by][keep], owner[keep]


BINS, STAR_KEYS, SHORT, LOW = 32, 6, 256, 8


def min_hashes(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Least hash of each set in each of ``BINS`` ranges of hashes (an empty range has the next one's), by set and range."""
    n = len(bounds) - 1
    out = np.zeros((n, BINS), dtype=np.uint64)
    owner = spread(np.diff(bounds))
    place = owner * BINS + (values >> U(59)).astype(np.int64)
    head = np.ones(len(place), dtype=bool)
    head[1:] = place[1:] != place[:-1]  # values are sorted within a set
    out.reshape(-1)[place[head]] = values[head]
    for k in [*range(BINS - 2, -1, -1), *range(BINS - 1, -1, -1)]:
        out[:, k] = np.where(out[:, k] == 0, out[:, (k + 1) % BINS], out[:, k])
    return out


def count_vectors(values: np.ndarray, bounds: np.ndarray) -> pa.Array:
    """Tokens per hash bucket of each set, a byte each; about half as many buckets as tokens, always a power of two.

    Counts stop at 255, which can only bring vectors nearer.
    """
    n = np.diff(bounds)
    width = (1 << np.clip(np.ceil(np.log2(np.maximum(n, 1) / 2)), 4, 15).astype(np.int64)) * (n > 0)
    offset = np.concatenate([[0], np.cumsum(width)])
    owner = spread(n)
    counts = np.bincount(offset[owner] + (values & (width[owner] - 1).astype(np.uint64)).astype(np.int64), minlength=offset[-1])
    return pa.Array.from_buffers(pa.binary(), len(n), [None, pa.py_buffer(offset.astype(np.int32).tobytes()), pa.py_buffer(np.minimum(counts, 255).astype(np.uint8).tobytes())])


def short_vectors(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Tokens in each of ``SHORT`` buckets of each set, two to a byte; counts stop at 15."""
    n = len(bounds) - 1
    place = spread(np.diff(bounds)) * SHORT + (values & U(SHORT - 1)).astype(np.int64)
    counts = np.minimum(np.bincount(place, minlength=n * SHORT), 15).astype(np.uint8).reshape(n, SHORT // 2, 2)
    return counts[:, :, 0] << 4 | counts[:, :, 1]


def unpacked(short: np.ndarray) -> np.ndarray:
    return np.stack([short >> 4, short & 15], axis=2).reshape(len(short), SHORT).astype(np.int8)


def vector_distance(a: memoryview, b: memoryview) -> int:
    """No more than the number of tokens in one set and not in the other."""
    x, y = (np.frombuffer(v, dtype=np.uint8).astype(np.int64) for v in (a, b))
    width = min(len(x), len(y))
    return int(np.abs(x.reshape(-1, width).sum(0) - y.reshape(-1, width).sum(0)).sum()) if width else 0


def near_enough(n: int, m: int, distance: int, percent: int = PERCENT) -> bool:
    """Whether sets of these sizes that differ in that many tokens can reach the similarity."""
    return distance * (100 + percent) <= (100 - percent) * (n + m)


FIRST = "doc_id long, n_shingles long, hi long, lo long, vector binary, keys array<long>, sketch binary, short binary, token long, count long, digest long"
NAMES = [x.split()[0] for x in FIRST.split(", ")]


def _first_pass(docs: DataFrame, k: int) -> DataFrame:
    """Rows of documents (doc_id, n_shingles, name, vector, min-hashes) and rows of tokens that repeat within a task (token, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        held, size, seen = [], 0, set()

        def repeated() -> pa.RecordBatch:
            token, count = np.unique(np.concatenate(held), return_counts=True)
            token, count = token[count >= HEAVY_LEAST].view(np.int64), count[count >= HEAVY_LEAST]
            none = [pa.nulls(len(token), x) for x in kinds]
            return pa.RecordBatch.from_arrays([*none, pa.array(token), pa.array(count), pa.nulls(len(token), pa.int64())], NAMES)

        kinds = [pa.int64()] * 4 + [pa.binary(), pa.list_(pa.int64()), pa.binary(), pa.binary()]
        for batch in batch_slices(batches):
            values, bounds = shingle_sets(text_column(batch), k)
            hi, lo = set_names(values, bounds)
            least = min_hashes(values, bounds)
            keys = pa.array(list((mix(least[:, :: BINS // STAR_KEYS][:, :STAR_KEYS]) + np.arange(STAR_KEYS, dtype=np.uint64)).view(np.int64)), kinds[5])
            sketch = (mix(least) & U(255)).astype(np.uint8)
            none = pa.nulls(len(hi), pa.int64())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(bounds)), pa.array(hi), pa.array(lo), count_vectors(values, bounds), keys, pa.array([x.tobytes() for x in sketch], pa.binary()), pa.array([x.tobytes() for x in short_vectors(values, bounds)], pa.binary()), none, none, batch.column(2)], NAMES)
            fresh = np.array([x not in seen for x in hi.tolist()], dtype=bool)  # copies don't make a token frequent
            seen.update(hi.tolist())
            held.append(values[np.repeat(fresh, np.diff(bounds))])
            size += len(held[-1])
            if size >= HEAVY_FOLD:
                yield repeated()
                held, size, seen = [], 0, set()
        if held:
            yield repeated()

    return docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("digest")).mapInArrow(run, FIRST)


def _runs(key: np.ndarray, more: np.ndarray) -> list[tuple[int, int]]:
    """Bounds of the runs of rows in which both columns stay the same."""
    cuts = np.concatenate([[0], np.flatnonzero((key[1:] != key[:-1]) | (more[1:] != more[:-1])) + 1, [len(key)]]).tolist() if len(key) else []
    return list(zip(cuts, cuts[1:]))


#: Members from which a group's most typical one is chosen; all members are compared to it.
TYPICAL_OF = 4096
#: Least share of equal min-hashes for which the comparison is made before the exact join.
ALIKE = 0.4
#: Classes of one min-hash, and of one prefix token, beyond which the group is split.
HOT_STAR, HOT_TOKEN = 20_000, 4096


def _stars(rows: DataFrame, n: int) -> DataFrame:
    """(a, b): the most typical member of each group with every other that seems alike; and (key, a, sketch) of the typical
    members of salted groups.

    ``rows``: key, salt (null where the group is whole), node, sketch.
    """

    def typical(sketches: np.ndarray) -> int:
        score = np.zeros(len(sketches), dtype=np.int64)
        for k in range(BINS):
            score += sketches[:, k] == np.bincount(sketches[:, k], minlength=256).argmax()
        return int(score.argmax())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hub = hub_sketch = None
        held: list[tuple[np.ndarray, np.ndarray]] = []
        out: list[np.ndarray] = []
        hubs: list[tuple[int, int, bytes]] = []

        def star(nodes: np.ndarray, sketches: np.ndarray) -> None:
            near = ((sketches == hub_sketch).mean(1) >= ALIKE) & (nodes != hub)
            out.append(np.stack([np.full(near.sum(), hub), nodes[near]], axis=1))

        def settle() -> None:
            nonlocal hub, hub_sketch, held
            if hub is None and held:
                nodes, sketches = (np.concatenate(x) for x in zip(*held, strict=True))
                salted = key[1] >= 0
                if len(nodes) > 1 or salted:
                    at = typical(sketches)
                    hub, hub_sketch = nodes[at], sketches[at]
                    star(nodes, sketches)
                    if salted:
                        hubs.append((int(key[0]), int(hub), hub_sketch.tobytes()))
            held = []

        def ready() -> pa.RecordBatch:
            pairs = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
            m = len(hubs)
            a = np.concatenate([pairs[:, 0], np.array([h[1] for h in hubs], dtype=np.int64)])
            b = pa.concat_arrays([pa.array(pairs[:, 1]), pa.nulls(m, pa.int64())])
            keys = pa.concat_arrays([pa.nulls(len(pairs), pa.int64()), pa.array([h[0] for h in hubs], pa.int64())])
            own = pa.concat_arrays([pa.nulls(len(pairs), pa.binary()), pa.array([h[2] for h in hubs], pa.binary())])
            out[:], hubs[:] = [], []
            return pa.RecordBatch.from_arrays([pa.array(a), b, keys, own], ["a", "b", "key", "sketch"])

        for batch in batches:
            keys, salts, nodes = (batch.column(k).to_numpy() for k in range(3))
            raw = batch.column(3)
            sketches = np.frombuffer(raw.buffers()[2], dtype=np.uint8)[raw.offset * BINS : (raw.offset + len(raw)) * BINS].reshape(-1, BINS)
            for lo, hi in _runs(keys, salts):
                if (keys[lo], salts[lo]) != key:
                    settle()
                    key, hub, held = (keys[lo], salts[lo]), None, []
                if hub is not None:
                    star(nodes[lo:hi], sketches[lo:hi])
                else:
                    held.append((nodes[lo:hi].copy(), sketches[lo:hi].copy()))
                    if sum(len(x) for x, _ in held) >= TYPICAL_OF:
                        settle()
            if sum(map(len, out)) > 20_000:
                yield ready()
        settle()
        if out or hubs:
            yield ready()

    dealt = rows.select("key", F.coalesce("salt", F.lit(-1)).alias("salt"), "node", "sketch").repartition(n, "key", "salt").sortWithinPartitions("key", "salt", "node")
    return dealt.mapInArrow(run, "a long, b long, key long, sketch binary")


def _star_pairs(classes: DataFrame, n: int) -> DataFrame:
    """(a, b): pairs of nodes that share a min-hash and seem alike, one of them the most typical of its group."""
    keys = classes.select(F.explode("keys").alias("key"), "node", "sketch")
    counts = keys.groupBy("key").count().filter(F.col("count") > HOT_STAR)
    hot = small_side(counts.select("key", F.ceil(F.col("count") / HOT_STAR).cast("int").alias("parts")), "hotkeys")
    salted = keys.join(hot, "key", "left").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    found = materialize(_stars(salted, n), "stars")
    hubs = found.filter(F.col("key").isNotNull()).select("key", F.lit(None).cast("int").alias("salt"), F.col("a").alias("node"), "sketch")
    return found.filter(F.col("b").isNotNull()).select("a", "b").union(_stars(hubs, n).filter(F.col("b").isNotNull()).select("a", "b")).distinct()


def _shared_tokens(docs: DataFrame, classes: DataFrame, frequent, n: int, k: int, percent: int) -> DataFrame:
    """(token, node) for prefix tokens under the first order that several classes have."""

    def local(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        seen: set[tuple[int, int]] = set()
        for batch in batch_slices(batches):
            values, bounds = shingle_sets(text_column(batch), k)
            hi, lo = set_names(values, bounds)
            fresh = np.zeros(len(hi), dtype=bool)
            for i, name in enumerate(zip(hi.tolist(), lo.tolist(), strict=True)):  # a class once per task
                if name not in seen:
                    seen.add(name)
                    fresh[i] = True
            if len(seen) > 200_000:
                seen.clear()
            token, owner = prefixes(values, bounds, frequent.value, 0, percent)
            keep = fresh[owner]
            yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in (token.view(np.int64), hi[owner], lo[owner])], ["token", "hi", "lo"])

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, told = None, False  # the last row, and whether it was returned
        for batch in batches:
            rows = np.stack([batch.column(k).to_numpy() for k in range(3)])
            if before is not None:
                rows = np.concatenate([before, rows], axis=1)
            fresh = np.ones(rows.shape[1], dtype=bool)
            fresh[1:] = (rows[:, 1:] != rows[:, :-1]).any(0)
            rows = rows[:, fresh]
            twin = np.zeros(rows.shape[1] + 1, dtype=bool)
            twin[1:-1] = rows[0, 1:] == rows[0, :-1]
            keep = twin[:-1] | twin[1:]
            last = keep[-1]
            if before is not None and told:
                last = last if rows.shape[1] > 1 else True
                keep[0] = False
            before, told = rows[:, -1:].copy(), bool(last)
            if keep.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[keep]) for x in rows], ["token", "hi", "lo"])

    names = "token long, hi long, lo long"
    rows = docs.select("text").mapInArrow(local, names)
    found = rows.repartition(n, "token").sortWithinPartitions("token", "hi", "lo").mapInArrow(several, names)
    return found.join(classes.select("hi", "lo", "node"), ["hi", "lo"]).select("token", "node")


def _cross_pairs(shared: DataFrame, n: int, percent: int) -> DataFrame:
    """(a, b) of classes that share a token, are of like size and lie in different first components.

    ``shared``: token, node, n, label, short, low (the node's least shared tokens), cell, block, both (the cell pairs two
    blocks). Within a cell those of its largest component are compared to the others
    only, never among themselves; only pairs whose short count vectors are near enough leave the task. A pair is
    passed over where both have a lesser token among their ``low``: that token's group has the pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[np.ndarray] = []

        def group(token: int, node: np.ndarray, size: np.ndarray, label: np.ndarray, block: np.ndarray, both: np.ndarray, short: np.ndarray, low: np.ndarray) -> None:
            found, at, counts = np.unique(label, return_inverse=True, return_counts=True)
            if len(found) < 2:
                return
            short = unpacked(short)
            rank = np.where(at == counts.argmax(), len(node), np.arange(len(node)))  # pairs start at the others
            for i in np.flatnonzero(at != counts.argmax()).tolist():
                good = (label != label[i]) & (rank > rank[i]) & (100 * np.minimum(size, size[i]) >= percent * np.maximum(size, size[i]))
                if both[0]:
                    good &= block != block[i]
                near = np.flatnonzero(good)
                lesser = low[i][low[i] < token]
                if len(lesser) and len(near):
                    near = near[~np.isin(low[near], lesser).any(1)]
                distance = np.abs(short[near] - short[i]).sum(1, dtype=np.int64)
                other = node[near[distance * (100 + percent) <= (100 - percent) * (size[near] + size[i])]]
                if len(other):
                    out.append(np.stack([np.minimum(other, node[i]), np.maximum(other, node[i])], axis=1))

        def ready() -> pa.RecordBatch:
            pairs, out[:] = np.unique(np.concatenate(out), axis=0), []
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        held: list[tuple[np.ndarray, ...]] = []
        key = None
        for batch in batches:
            token, cell = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 7)]
            raw = batch.column(7)
            columns.append(np.frombuffer(raw.buffers()[2], dtype=np.uint8)[raw.offset * SHORT // 2 : (raw.offset + len(raw)) * SHORT // 2].reshape(-1, SHORT // 2))
            columns.append(batch.column(8).flatten().to_numpy().reshape(-1, LOW))
            for lo, hi in _runs(token, cell):
                if (token[lo], cell[lo]) != key:
                    if held:
                        group(key[0], *(np.concatenate(x) for x in zip(*held, strict=True)))
                    key, held = (token[lo], cell[lo]), []
                held.append(tuple(x[lo:hi].copy() for x in columns))
            if sum(map(len, out)) > 50_000:
                yield ready()
        if held:
            group(key[0], *(np.concatenate(x) for x in zip(*held, strict=True)))
        if out:
            yield ready()

    rows = shared.select("token", "cell", "node", "n", "label", "block", "both", "short", "low").repartition(n, "token", "cell").sortWithinPartitions("token", "cell")
    return rows.mapInArrow(run, "a long, b long").distinct()


def in_blocks(shared: DataFrame) -> DataFrame:
    """``shared`` (token, node, ...) with cell, block and both: a hot token's group is cut into blocks, and a row goes to each cell
    (pair of blocks) of its own block; any two rows of a token meet in one cell."""
    hot = shared.groupBy("token").count().filter(F.col("count") > HOT_TOKEN)
    hot = small_side(hot.select("token", F.ceil(F.col("count") / HOT_TOKEN).cast("int").alias("parts")), "hottokens")
    parts = F.coalesce("parts", F.lit(1))
    dealt = shared.join(hot, "token", "left").withColumn("parts", parts).withColumn("block", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    cell = F.least("block", "other").cast("long") * F.col("parts") + F.greatest("block", "other")
    return dealt.withColumns({"cell": cell, "both": F.col("block") != F.col("other")}).drop("parts", "other")


def _vector_filter(pairs: DataFrame, classes: DataFrame, percent: int) -> DataFrame:
    """The pairs whose count vectors don't rule a link out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, m = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            x, y = cells(batch.column(4)), cells(batch.column(5))
            keep = pa.array([near_enough(n[i], m[i], vector_distance(x(i), y(i)), percent) for i in range(len(n))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    own = classes.select("node", "n", "vector")
    joined = pairs.join(own.toDF("a", "n", "x"), "a").join(own.toDF("b", "m", "y"), "b")
    return joined.select("a", "b", "n", "m", "x", "y").mapInArrow(run, "a long, b long").distinct()


def prefix_marks(values: np.ndarray, bounds: np.ndarray, frequent: Frequent, orders: int, percent: int = PERCENT) -> list[bytes]:
    """Of each set its prefix tokens under every order, one order after the other, each sorted, as 32-bit numbers."""
    n = prefix_length(np.diff(bounds), percent)
    owners, tokens = [], []
    for order in range(orders):
        token, owner = prefixes(values, bounds, frequent, order, percent)
        owners.append(owner * orders + order)
        tokens.append((mix(token) >> U(32)).astype(np.uint32))
    owner, token = np.concatenate(owners), np.concatenate(tokens)
    raw = token[order_by(owner, token.astype(np.uint64) << U(32))].tobytes()
    end = np.concatenate([[0], np.cumsum(n) * orders * 4]).tolist()
    return [raw[a:b] for a, b in zip(end, end[1:])]


def shares_all(x: memoryview, y: memoryview, orders: int) -> bool:
    """Whether two sets' marks have a number in common under every order."""
    a, b = (np.frombuffer(v, dtype=np.uint32).reshape(orders, -1) for v in (x, y))
    return all(shares(a[k], b[k]) for k in range(orders))


def _linked(pairs: DataFrame, classes: DataFrame, docs: DataFrame, frequent, name: str, k: int, percent: int, orders: int) -> DataFrame:
    """(a, b): the pairs of nodes that share prefix tokens under all orders and reach the similarity."""
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    wanted = classes.join(nodes, "node").select("node", "hi", "lo", F.col("rep.doc_id").alias("rep"), F.col("rep.digest").alias("same"))
    wanted = small_side(wanted, "wanted")

    def sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release_memory()
        seen: set[int] = set()
        for batch in batch_slices(batches):
            values, bounds = shingle_sets(text_column(batch), k)
            hi, lo = set_names(values, bounds)
            node = batch.column(1).to_numpy()
            keep = (hi == batch.column(2).to_numpy()) & (lo == batch.column(3).to_numpy())
            for i in np.flatnonzero(keep).tolist():  # repeated rows once per task
                keep[i] = node[i] not in seen
                seen.add(node[i])
            marks = prefix_marks(values, bounds, frequent.value, orders, percent)
            at = np.flatnonzero(keep).tolist()
            tokens = [values[bounds[i] : bounds[i + 1]].tobytes() for i in at]
            yield pa.RecordBatch.from_arrays([pa.array(node[at]), pa.array([marks[i] for i in at], pa.binary()), pa.array(tokens, pa.binary())], ["node", "marks", "tokens"])

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = cells(batch.column(2)), cells(batch.column(3))
            keep = pa.array([shares_all(x(i), y(i), orders) for i in range(len(batch))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(2)], ["a", "b"])

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = cells(batch.column(2)), cells(batch.column(3))
            keep = pa.array([reaches(np.frombuffer(x(i), dtype=np.uint64), np.frombuffer(y(i), dtype=np.uint64), percent) for i in range(len(batch))], pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(i).filter(keep) for i in range(2)], ["a", "b"])

    def joined(left: DataFrame, column: str, check) -> DataFrame:
        own = sets.select("node", column)
        both = left.join(own.toDF("a", "x"), "a").join(own.toDF("b", "y"), "b")
        return both.select("a", "b", "x", "y").mapInArrow(check, "a long, b long").distinct()

    spark = docs.sparkSession
    with arrow_batches(spark):
        texts = docs.select(F.col("doc_id").cast("long").alias("id"), "text", F.xxhash64("text").alias("digest"))
        found = texts.join(wanted, texts["id"].eqNullSafe(wanted["rep"]) & (texts["digest"] == wanted["same"])).select("text", "node", "hi", "lo")
        sets = materialize(found.mapInArrow(sets_of, "node long, marks binary, tokens binary"), "sets")
        survivors = materialize(joined(pairs, "marks", filtered), "survivors")
        links = materialize(joined(survivors, "tokens", compared), name)
    drop(wanted, sets, survivors)
    return links


def shares(a: np.ndarray, b: np.ndarray) -> bool:
    return bool((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).any())


def reaches(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    both = int((a[np.minimum(np.searchsorted(a, b), len(a) - 1)] == b).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def link(docs: DataFrame, k: int = K, percent: int = PERCENT, orders: int = ORDERS, heavy: int = HEAVY) -> DataFrame:
    """doc_id, n_shingles, component_id of each document (and hi, lo: the name of its set; label: of its component; digest: of its text)."""
    spark = docs.sparkSession
    n = partitions(spark)
    first = materialize(_first_pass(docs, k), "shingles")
    rows = first.filter(F.col("hi").isNotNull())
    counted = first.filter(F.col("token").isNotNull()).groupBy("token").agg(F.sum("count").alias("c"))
    top = counted.orderBy(F.desc("c"), "token").limit(heavy).select("token").toPandas()["token"]  # bounded by ``heavy``
    frequent = spark.sparkContext.broadcast(Frequent(top.to_numpy(dtype=np.int64)[::-1].copy().view(np.uint64)))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("rep")  # ids before null ids
    alike = [F.first(x).alias(y) for x, y in (("n_shingles", "n"), ("vector", "vector"), ("keys", "keys"), ("sketch", "sketch"), ("short", "short"))]
    classes = rows.filter("n_shingles > 0").groupBy("hi", "lo").agg(least, *alike)
    classes = materialize(classes.withColumn("node", F.monotonically_increasing_id()), "classes")  # numbers hold once they are written

    stars = materialize(_star_pairs(classes, n), "near")
    early = _linked(stars, classes, docs, frequent, "early", k, percent, orders)
    joined = components(early)

    shared = materialize(_shared_tokens(docs, classes, frequent, n, k, percent), "shared")
    low = shared.groupBy("node").agg(F.slice(F.array_sort(F.collect_list("token")), 1, LOW).alias("low"))
    low = low.withColumn("low", F.concat("low", F.array_repeat(F.lit((1 << 63) - 1), F.lit(LOW) - F.size("low"))))
    own = low.join(classes.select("node", "n", "short"), "node").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    pairs = _cross_pairs(in_blocks(shared).join(own, "node"), n, percent)
    with arrow_batches(spark):
        pairs = materialize(_vector_filter(pairs, classes, percent), "pairs")
    late = _linked(pairs, classes, docs, frequent, "late", k, percent, orders)
    drop(stars, shared, pairs)

    # Later links join first components, so only these are looked at again.
    ends = late.join(joined.toDF("a", "la"), "a", "left").join(joined.toDF("b", "lb"), "b", "left")
    second = components(ends.select(F.coalesce("la", "a").alias("a"), F.coalesce("lb", "b").alias("b"))).toDF("label", "whole")
    labelled = classes.select("hi", "lo", "rep.doc_id", "node").join(joined, "node", "left").withColumn("label", F.coalesce("label", "node"))
    labelled = labelled.join(second, "label", "left").withColumn("label", F.coalesce("whole", "label")).drop("whole")
    ids = labelled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    named = labelled.join(ids, "label").select("hi", "lo", "component_id", "label")
    out = rows.select("doc_id", "n_shingles", "hi", "lo", "digest").join(named, ["hi", "lo"], "left")
    return out.select("doc_id", "n_shingles", F.when(F.col("n_shingles") == 0, F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"), "hi", "lo", "label", "digest")


def keep_one(docs: DataFrame, k: int = K, percent: int = PERCENT) -> DataFrame:
    """The rows of ``docs`` that stay when of each component only one does: the one with the least id (null ids last), then the
    least hash of its text; of rows that share both any one.

    Documents without shingles are linked with nothing and stay. Extra columns stay, whatever their names.
    """
    linked = link(docs, k, percent).select("doc_id", "digest", "n_shingles", "label")
    alone = linked.filter("n_shingles = 0").select("doc_id", "digest", F.lit(False).alias("many")).distinct()
    counted = linked.filter("n_shingles > 0").groupBy("label", "doc_id", "digest").agg(F.count("*").alias("n"))
    least = counted.groupBy("label").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest", "n")).alias("r"))
    kept = alone.unionByName(least.select("r.doc_id", "r.digest", (F.col("r.n") > 1).alias("many")))
    own = unused(docs, "kept_id", "kept_digest", "many")
    kept = materialize(kept.toDF(*own), "kept")
    same = lambda keys: (F.xxhash64(docs.text) == keys[own[1]]) & docs.doc_id.eqNullSafe(keys[own[0]])
    once = small_side(kept.filter(~F.col(own[2])), "once")
    out = docs.join(once, same(once), "left_semi")
    many = small_side(kept.filter(own[2]), "many")
    if many.isEmpty():
        return out
    repeated = docs.join(many, same(many)).dropDuplicates(own[:2])  # each task leaves one row of a key first
    return out.unionByName(repeated.select(*docs.columns))
