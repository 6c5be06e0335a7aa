"""Vector codes by parts: each part of a vector is replaced by its nearest codebook entry, found with LAESA pivots.

Components become integers ``floor(scale * x)`` and a vector is cut into equal consecutive parts; each part position has
a codebook of its own. Distances of every part to a few fixed pivots of its position are computed once and stored beside
the parts. A round only computes the distances of pivots to entries: ``|d(part, pivot) - d(pivot, entry)|`` bounds the
distance of part and entry from below, entries are tried in the order of that bound, and a part is done as soon as the
bound of its next entry exceeds the best distance found. Distances that are evaluated are exact integers.

Every round is one pass over the stored parts: tasks add up the components and the number of the parts of each entry,
the sums are combined by a shuffle of at most (parts x entries) rows a task, and only those (parts x entries) sums
come to the driver. Codebooks travel with the next round's tasks; their size is a parameter, not the table's.

Rules for unusual rows: vectors that are NULL or hold NULL or non-finite components are dropped. The dimension of the
table is that of the kept vector with the smallest id, empty ones aside; vectors of another dimension, empty ones among
them, are dropped too, and a dimension that the number of parts doesn't divide stops the job. Rows without an id come last in the choice of the first entries; rows that share an id follow the order of their vectors.
Repeated rows are coded each. With fewer rows than entries a codebook starts with as many entries as there are rows.
Entries without a part stay as they are. An empty table gives an empty result. Components whose squared distances would
leave 64 bits (above about 2**27 after scaling in 64 dimensions) stop the job with a message. Columns beside id, vector
and label are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import stored


@dataclass(frozen=True)
class Settings:
    parts: int = 8
    entries: int = 16
    rounds: int = 6
    pivots: int = 4
    scale: int = 4096


#: Share by which float bounds are lowered, far above the rounding of 32-bit roots.
SLACK = 1e-6
#: Rows handled at once in a task.
BLOCK = 4096


def squared(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact squared distance of equally long rows of integers."""
    gap = a - b
    return np.einsum("ij,ij->i", gap, gap)


def pivots_of(entries: np.ndarray, count: int) -> np.ndarray:
    """Rows of ``entries`` that lie far from each other: each next one is the farthest from those chosen."""
    chosen = [0]
    far = squared(entries, np.broadcast_to(entries[0], entries.shape))
    while len(chosen) < min(count, len(entries)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, squared(entries, np.broadcast_to(entries[chosen[-1]], entries.shape)))
    return entries[chosen]


def to_pivots(block: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distance of every row to every pivot, as 32-bit floats."""
    return np.stack([np.sqrt(squared(block, np.broadcast_to(p, block.shape)).astype(np.float64)) for p in pivots], axis=1).astype(np.float32)


def nearest(block: np.ndarray, distances: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Index of the nearest entry of every row (ties to the lower index), its squared distance, evaluations made."""
    reach = to_pivots(entries, pivots).astype(np.float64)
    seen = distances.astype(np.float64)
    bound = np.zeros((len(block), len(entries)))
    for p in range(len(pivots)):
        a, b = seen[:, p, None], reach[None, :, p]
        np.maximum(bound, np.abs(a - b) - SLACK * (a + b), out=bound)
    bound = np.square(bound) * (1 - SLACK)
    order = np.argsort(bound, axis=1, kind="stable")
    bound = np.take_along_axis(bound, order, axis=1)
    best = np.full(len(block), np.iinfo(np.int64).max)
    index = np.zeros(len(block), dtype=np.int64)
    open_rows, evaluated = np.arange(len(block)), 0
    for turn in range(len(entries)):
        # bounds grow from turn to turn, so a row that stops once has nothing left to find; ties are still looked at
        open_rows = open_rows[bound[open_rows, turn] <= best[open_rows]]
        if not len(open_rows):
            break
        entry = order[open_rows, turn]
        exact = squared(block[open_rows], entries[entry])
        evaluated += len(open_rows)
        better = (exact < best[open_rows]) | ((exact == best[open_rows]) & (entry < index[open_rows]))
        rows = open_rows[better]
        best[rows], index[rows] = exact[better], entry[better]
    return index, best, evaluated


def integers(vectors: pa.ListArray, dimension: int, scale: int) -> np.ndarray:
    """One row of scaled integers per vector."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    scaled = np.floor(flat * scale)
    if len(scaled) and np.abs(scaled).max() >= np.sqrt((2.0**63 - 1) / (4 * max(dimension, 1))):
        raise ValueError("components are too large for exact 64-bit distances")
    return scaled.astype(np.int64).reshape(len(vectors), dimension)


def kept_vectors(df: DataFrame, vec: str = "embedding") -> DataFrame:
    """Rows whose vector is present and finite throughout."""
    finite = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col(vec).isNotNull() & F.coalesce(finite, F.lit(False)))


class Codebooks:
    """Entries and pivots of every part position."""

    def __init__(self, first: np.ndarray, settings: Settings):
        width = first.shape[1] // settings.parts
        self.settings, self.width = settings, width
        self.entries = [first[:, p * width : (p + 1) * width].copy() for p in range(settings.parts)]
        self.pivots = [pivots_of(e, settings.pivots) for e in self.entries]

    def updated(self, sums: list) -> Codebooks:
        new = object.__new__(Codebooks)
        new.settings, new.width, new.pivots = self.settings, self.width, self.pivots
        new.entries = [e.copy() for e in self.entries]
        for row in sums:
            new.entries[row.part][row.entry] = [int(s) // row.n for s in row.sums]
        return new

    def digest(self) -> str:
        numbers = (str(x) for book in self.entries for entry in book for x in entry.tolist())
        return hashlib.sha256(",".join(numbers).encode()).hexdigest()

    def assigned(self, batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """Part position, parts, entry and squared distance of each, for a batch of stored parts."""
        rows = batch.num_rows
        ints = np.frombuffer(b"".join(batch.column("parts").to_pylist()), np.int64).reshape(rows, self.settings.parts, self.width)
        far = np.frombuffer(b"".join(batch.column("far").to_pylist()), np.float32).reshape(rows, self.settings.parts, -1)
        for p in range(self.settings.parts):
            block = np.ascontiguousarray(ints[:, p])
            index, error, _ = nearest(block, far[:, p], self.entries[p], self.pivots[p])
            yield p, block, index, error


def _parted(kept: DataFrame, books: Codebooks, id_col: str, vec: str, label: str) -> DataFrame:
    """Integers of every vector and their distances to the pivots, computed once."""
    settings, dimension = books.settings, books.width * books.settings.parts
    names = ("id", "label")

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                piece = batch.slice(at, BLOCK)
                ints = integers(piece.column("vec"), dimension, settings.scale)
                far = np.empty((len(ints), settings.parts, len(books.pivots[0])), np.float32)
                for p in range(settings.parts):
                    far[:, p] = to_pivots(ints[:, p * books.width : (p + 1) * books.width], books.pivots[p])
                yield pa.RecordBatch.from_arrays(
                    [*(piece.column(n) for n in names), pa.array([r.tobytes() for r in ints], pa.binary()), pa.array([f.tobytes() for f in far], pa.binary())],
                    [*names, "parts", "far"],
                )

    source = kept.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.col(vec).alias("vec"))
    schema = T.StructType([T.StructField("id", kept.schema[id_col].dataType), T.StructField("label", kept.schema[label].dataType),
                           T.StructField("parts", T.BinaryType()), T.StructField("far", T.BinaryType())])
    return source.mapInArrow(split, schema)


def _sums(parts: DataFrame, books: Codebooks) -> list:
    """Number and component sums of the parts of every used entry."""
    settings, width = books.settings, books.width

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros((settings.parts, len(books.entries[0])), np.int64)
        sums = np.zeros((*counts.shape, width), np.int64)
        for batch in batches:
            for p, block, index, _ in books.assigned(batch):
                counts[p] += np.bincount(index, minlength=counts.shape[1])
                np.add.at(sums[p], index, block)
        part, entry = np.nonzero(counts)
        yield pa.RecordBatch.from_pydict({"part": pa.array(part, pa.int32()), "entry": pa.array(entry, pa.int32()), "n": counts[part, entry],
                                          "sums": pa.array(sums[part, entry].tolist(), pa.list_(pa.int64()))})

    partial = parts.select("parts", "far").mapInArrow(add, "part int, entry int, n bigint, sums array<bigint>")
    # exact beyond 64 bits: the sum over a whole table may leave them though a mean never does
    total = [F.sum(F.get("sums", F.lit(i)).cast("decimal(38,0)")).alias(f"s{i}") for i in range(width)]
    rows = partial.groupBy("part", "entry").agg(F.sum("n").alias("n"), *total)
    return rows.select("part", "entry", "n", F.array(*[f"s{i}" for i in range(width)]).alias("sums")).collect()


def vector_codes(df: DataFrame, id_col: str = "vec_id", vec: str = "embedding", label: str = "label", settings: Settings | None = None) -> DataFrame:
    """``id``, ``label``, ``code``, ``error``, ``label_error`` and ``codebooks_sha256`` of every kept vector."""
    settings = settings or Settings()
    kept = kept_vectors(df.select(id_col, vec, label), vec)
    first = kept.where(F.size(vec) > 0).orderBy(F.col(id_col).asc_nulls_last(), vec).limit(1).select(F.size(vec).alias("n")).first()
    dimension = first.n if first else 0
    if dimension % settings.parts:
        raise ValueError(f"{settings.parts} parts don't divide {dimension} dimensions")
    same = kept.where((F.size(vec) == dimension) & (F.size(vec) > 0))
    start = same.orderBy(F.col(id_col).asc_nulls_last(), vec).limit(settings.entries).select(vec).toArrow().column(0).combine_chunks()
    if not len(start):
        # nothing to code: the plan has no row
        return _coded(same.select(F.col(id_col).alias("id"), F.col(label).alias("label"), F.lit("").alias("code"), F.lit(0).cast("bigint").alias("error")), "")
    books = Codebooks(integers(start, dimension, settings.scale), settings)
    parts = stored(_parted(same, books, id_col, vec, label), "parts")
    for _ in range(settings.rounds):
        books = books.updated(_sums(parts, books))

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, errors = np.empty((batch.num_rows, settings.parts), np.uint8), np.zeros(batch.num_rows, np.int64)
            for p, _, index, error in books.assigned(batch):
                codes[:, p] = index
                errors += error
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("label"), pa.array([c.tobytes().hex() for c in codes]), pa.array(errors)],
                                             ["id", "label", "code", "error"])

    schema = T.StructType([*parts.select("id", "label").schema, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())])
    return _coded(stored(parts.mapInArrow(code, schema), "codes"), books.digest())


def _coded(rows: DataFrame, digest: str) -> DataFrame:
    """Adds the sum of errors over equal labels. Sums are combined before the shuffle; Spark sees their size when it joins them back."""
    sums = rows.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "__label")
    return rows.join(sums, F.col("label").eqNullSafe(F.col("__label"))).drop("__label").withColumn("codebooks_sha256", F.lit(digest))
