"""Length-limited Huffman codes."""

from __future__ import annotations

import numpy as np


def _depths(weights: list[int]) -> list[int]:
    """Depths of a Huffman tree's leaves, given by weights in rising order; the first is among the deepest."""
    n = len(weights)
    total, parent = weights + [0] * max(0, n - 1), [0] * (2 * n)
    leaf, node = 0, n
    for made in range(n, 2 * n - 1):
        for _ in range(2):  # the lesser of the next leaf and the next inner node; both stand in rising order
            if node >= made or (leaf < n and weights[leaf] <= total[node]):
                least, leaf = leaf, leaf + 1
            else:
                least, node = node, node + 1
            parent[least] = made
            total[made] += total[least]
    depth = [0] * (2 * n)
    for k in range(2 * n - 3, -1, -1):
        depth[k] = depth[parent[k]] + 1
    return depth[:n]


def _used(values: np.ndarray) -> list[tuple[int, int]]:
    """Values other than 0 and their places, in rising order."""
    at = values.nonzero()[0]
    return sorted(zip(values[at].tolist(), at.tolist(), strict=True))


def code_lengths(counts: np.ndarray, limit: int, extra: bool = False) -> np.ndarray:
    """Optimal code lengths of at most ``limit`` bits; 0 for symbols that don't occur.

    A plain Huffman tree, and package-merge where that is too deep.

    With ``extra`` room is left for one more code of the greatest length, so none of the codes is all ones.
    """
    items = _used(counts)
    if extra:
        items = [(0, -1), *items]
    out = np.zeros(len(counts) + 1, dtype=np.int64)
    if len(items) == 1:
        out[items[0][1]] = 1
    depths = _depths([n for n, _ in items]) if len(items) > 1 else [0]
    if max(depths) <= limit:
        if len(items) > 1:
            out[[s for _, s in items]] = depths
        return out[:-1]
    items = [(n, (s,)) for n, s in items]
    packages: list[tuple[int, tuple[int, ...]]] = []
    for _ in range(limit):
        level = sorted(items + packages, key=lambda x: x[0])
        packages = [(level[k][0] + level[k + 1][0], level[k][1] + level[k + 1][1]) for k in range(0, len(level) - 1, 2)]
    for _, symbols in packages[: len(items) - 1]:
        np.add.at(out, list(symbols), 1)
    return out[:-1]


def canonical(lengths: np.ndarray) -> np.ndarray:
    """Codes of canonical order: by length, then by symbol."""
    out, used, found, code, before = np.zeros(len(lengths), dtype=np.int64), _used(lengths), [], 0, 0
    for n, _ in used:
        code <<= n - before
        before = n
        found.append(code)
        code += 1
    out[[s for _, s in used]] = found
    return out


def pack(values: np.ndarray, lengths: np.ndarray, first_bit_high: bool) -> np.ndarray:
    """The values' bits, one after the other, as an array of 0 and 1; each value's highest or lowest bit first."""
    out = []
    for lo in range(0, len(values), 1 << 18):
        v, n = values[lo : lo + (1 << 18)].astype(np.uint64), lengths[lo : lo + (1 << 18)]
        end = np.cumsum(n)
        place = np.arange(end[-1] if len(end) else 0) - np.repeat(end - n, n)
        shift = np.repeat(n, n) - 1 - place if first_bit_high else place
        out.append(((np.repeat(v, n) >> shift.astype(np.uint64)) & np.uint64(1)).astype(np.uint8))
    return np.concatenate(out) if out else np.zeros(0, np.uint8)
