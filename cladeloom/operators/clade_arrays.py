"""Clades of many trees at once as arrays, inside tasks: what two parsed trees over the same taxa have in common."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .triplet_arrays import rectangle

#: Taxa whose bits share a number, and comparisons of clades that are worked on together.
WORD = 62
BLOCK = 1 << 21


def clade_bits(depths: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Trees x joins x words: bits of the sorted taxa below the node of each join.

    ``depths`` is trees x (n - 1), ``at`` trees x n with 0-based positions. A node reaches to the next shallower join on each side.
    """
    trees, joins = depths.shape
    first, last = np.empty_like(depths), np.empty_like(depths)
    places = np.arange(joins)
    for j in range(joins):
        shallower = depths < depths[:, j:j + 1]
        first[:, j] = np.where(shallower[:, :j], places[:j], -1).max(axis=1, initial=-1) + 1
        last[:, j] = np.where(shallower[:, j:], places[j:], joins).min(axis=1, initial=joins)
    taxon = np.argsort(at, axis=1)
    words = []
    for word in range(-(-at.shape[1] // WORD)):
        bit = np.where(taxon // WORD == word, np.int64(1) << (taxon % WORD).astype(np.int64), 0)
        upto = np.concatenate([np.zeros((trees, 1), dtype=np.int64), np.cumsum(bit, axis=1)], axis=1)
        words.append(np.take_along_axis(upto, last.astype(np.int64) + 1, 1) - np.take_along_axis(upto, first.astype(np.int64), 1))
    return np.stack(words, axis=2)


def compare(true: np.ndarray, inferred: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per tree: nontrivial clades in only one of both, nontrivial clades of each added up, all clades of the second."""
    joins = true.shape[1]
    if joins == 0:
        return (np.zeros(len(true), dtype=np.int32),) * 3
    meets = lambda a, b: (a[:, :, None] == b[:, None]).all(axis=3)
    whole = true.max(axis=1, keepdims=True)  # the root's clade holds every bit
    fresh = lambda a: ~np.tril(meets(a, a), -1).any(axis=2)  # noqa: E731  several joins of one node
    new = fresh(inferred)
    own, other = fresh(true) & ~(true == whole).all(axis=2), new & ~(inferred == whole).all(axis=2)
    same = meets(true, inferred)
    distance = (own & ~same.any(axis=2)).sum(axis=1) + (other & ~same.any(axis=1)).sum(axis=1)
    return distance, own.sum(axis=1) + other.sum(axis=1), new.sum(axis=1)


_FOUND = T.StructType([T.StructField(name, T.IntegerType()) for name in ("distance", "total", "nodes")])


@F.arrow_udf(_FOUND)
def robinson_foulds(true_depths: pa.Array, true_at: pa.Array, depths: pa.Array, at: pa.Array) -> pa.Array:
    """Distance of two trees over the same taxa, number of their nontrivial clades, and of the second's nodes; NULL for NULL."""
    columns = [true_depths, true_at, depths, at]
    sizes = at.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out = np.zeros((3, len(sizes)), dtype=np.int32)
    for n in np.unique(sizes[sizes > 0]):
        rows = np.flatnonzero(sizes == n)
        step = max(1, BLOCK // int(n) ** 2)
        for start in range(0, len(rows), step):
            some = rows[start:start + step]
            a, p, b, q = (rectangle(c.take(pa.array(some))) for c in columns)
            out[:, some] = compare(clade_bits(a, p - 1), clade_bits(b, q - 1))
    missing = sizes == 0
    return pa.StructArray.from_arrays([pa.array(v, mask=missing) for v in out], _FOUND.names, mask=pa.array(missing))
