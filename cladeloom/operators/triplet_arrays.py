"""Triplets of many trees at once as arrays, inside tasks: Spark parses the trees and brings those of a simulation together.

A tree comes as the depths and root distances of its joins and the text positions of its sorted taxa. ``joins_of_pairs`` finds
the join in which any two taxa meet; a triplet is resolved by the joins of its three pairs. Triplets are taken in blocks, so
no list of all of them is held.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache
from math import comb

import numpy as np
import pyarrow as pa

#: Observations (triplets times trees) that are worked on together: a few arrays of eight bytes each.
BLOCK = 1 << 19


def rectangle(lists: pa.ListArray) -> np.ndarray:
    """Lists as rows of one array; shorter ones are filled up with the largest number of their type."""
    flat, sizes = lists.flatten().to_numpy(), lists.value_lengths().to_numpy()
    if (sizes == sizes[0]).all():
        return flat.reshape(len(sizes), sizes[0])
    out = np.full((len(sizes), sizes.max()), np.iinfo(flat.dtype).max if flat.dtype.kind == "i" else np.inf, dtype=flat.dtype)
    out[np.arange(sizes.max()) < sizes[:, None]] = flat
    return out


def joins_of_pairs(depths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For every pair of sorted taxa (rows, in the order of ``pair_numbers``) and tree: place in ``depths.ravel()`` of their join.

    ``depths`` is trees x joins, ``at`` trees x taxa with 0-based positions; trees may have more leaves than there are taxa.
    The join of two leaves is the shallowest between them.
    """
    trees, joins = depths.shape
    places = np.arange(joins)
    # by positions first: the last place at which the running minimum was met
    by_position = np.zeros((joins + 1, joins + 1, trees), dtype=np.int16 if joins < 1 << 15 else np.int32)
    for p in range(joins):
        run = depths[:, p:]
        met = np.maximum.accumulate(np.where(run == np.minimum.accumulate(run, axis=1), places[p:], 0), axis=1)
        by_position[p, p + 1:] = by_position[p + 1:, p] = met.T
    x, y = _pairs(at.shape[1])
    tree = np.arange(trees)
    return by_position[at.T[x], at.T[y], tree] + tree * joins


@lru_cache(maxsize=64)
def _pairs(n: int) -> tuple[np.ndarray, np.ndarray]:
    return np.triu_indices(n, 1)


def pair_numbers(n: int, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return x * n - x * (x + 1) // 2 + y - x - 1


def resolve(depths: np.ndarray, dists: np.ndarray, ab: np.ndarray, ac: np.ndarray, bc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Topology (-1 if open) and internal length of triplets whose pairs meet in the joins ``ab``, ``ac`` and ``bc``."""
    d_ab, d_ac, d_bc = depths[ab], depths[ac], depths[bc]
    # of the three depths two are always equal and the third is at least as deep
    topo = np.where(d_ab > d_ac, 0, np.where(d_ac > d_ab, 1, np.where(d_bc > d_ab, 2, -1))).astype(np.int8)
    pair = np.where(topo == 0, ab, np.where(topo == 1, ac, bc))
    return topo, dists[pair] - dists[np.where(topo == 0, ac, ab)]


@lru_cache(maxsize=16)
def _all_triplets(n: int) -> np.ndarray:
    x, y, z = (part.ravel() for part in np.indices((n, n, n)))
    keep = (x < y) & (y < z)
    return np.stack([x[keep], y[keep], z[keep]])


def triplet_blocks(n: int, size: int, plan: np.ndarray | None = None) -> Iterator[np.ndarray]:
    """Triplets of 0-based sorted taxa as arrays of three rows, ``size`` at a time: those of ``plan``, or all."""
    size = max(1, size)
    if plan is None and comb(n, 3) > min(size, 1 << 13):
        groups = (np.stack([np.full(comb(n - x - 1, 2), x), *(rest + x + 1 for rest in _pairs(n - x - 1))]) for x in range(n - 2))
    else:
        groups = iter([_all_triplets(n) if plan is None else plan])
    for group in groups:
        for start in range(0, group.shape[1], size):
            yield group[:, start:start + size]


def resolved_blocks(depths: np.ndarray, dists: np.ndarray, at: np.ndarray, plan: np.ndarray | None = None) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Blocks of (triplets, topologies, lengths) of trees over the same taxa; the last two are triplets x trees."""
    trees, n = at.shape
    pairs = joins_of_pairs(depths, at)
    flat_depths, flat_dists = depths.ravel(), dists.ravel()
    for block in triplet_blocks(n, BLOCK // trees, plan):
        x, y, z = block
        yield block, *resolve(flat_depths, flat_dists, pairs[pair_numbers(n, x, y)], pairs[pair_numbers(n, x, z)], pairs[pair_numbers(n, y, z)])


def length_statistics(topo: np.ndarray, lengths: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Per triplet (rows): number of trees with topology ``k``, and mean, median and population deviation of their lengths.

    Where there is no such tree the statistics mean nothing.
    """
    own = topo == k
    count = own.sum(axis=1)
    some = np.maximum(count, 1)
    mean = np.where(own, lengths, 0.0).sum(axis=1) / some
    off = np.where(own, lengths - mean[:, None], 0.0)
    ordered = np.sort(np.where(own, lengths, np.inf), axis=1)
    row = np.arange(len(count))
    median = (ordered[row, (some - 1) // 2] + ordered[row, some // 2]) / 2
    return count, mean, median, np.sqrt((off * off).sum(axis=1) / some)


def trees_together(n: int) -> int:
    """Trees of ``n`` taxa whose triplets with one first taxon make arrays that stay in a processor's cache."""
    return max(1, (1 << 16) // comb(n, 2))


def sums_by_first(depths: np.ndarray, dists: np.ndarray, at: np.ndarray, numbers: np.ndarray) -> list[np.ndarray]:
    """Trees x first taxa: numbers of triplets of each topology, total internal length, and the topology times the taxa's ``numbers``."""
    trees, n = at.shape
    out = [np.zeros((trees, n - 2), dtype=np.int64) for _ in range(3)] + [np.zeros((trees, n - 2)), np.zeros((trees, n - 2), dtype=np.int64)]
    second, third = 997 * numbers.T, 31 * numbers.T
    for (x, y, z), topo, lengths in resolved_blocks(depths, dists, at):
        cuts = np.flatnonzero(np.diff(x, prepend=-1))
        firsts = x[cuts]
        add = lambda into, values: into.__setitem__((slice(None), firsts), into[:, firsts] + np.add.reduceat(values, cuts, axis=0).T)
        for k in range(3):
            add(out[k], (topo == k).astype(np.int64))
        known = topo >= 0
        add(out[3], np.where(known, lengths, 0.0))
        add(out[4], np.where(known, topo, 0) * (second[y] + third[z]))
    return out
