"""Importance resampling towards a target distribution: hashed word n-grams, a gain per bucket, Gumbel top-k.

Every run of one to three consecutive words is a feature and falls into one of a fixed number of buckets by its CRC-32.
A bucket's gain is the logarithm of its smoothed share in the target over its smoothed share in the source. A document
weighs the sum of the gains of its features; weights with Gumbel noise (drawn from a hash of the id) are ranked, and the
highest ones are a sample without replacement in proportion to exp(weight).

The scan: separators collapse to single spaces, one space is set in front, and one pattern with ``overlapped=True`` matches
at every word; the word and, by lookahead at its right boundary, the next two give the spans of all features that start
there. The CRC of a longer feature goes on from that of the shorter one. A document's bucket numbers are stored, so texts are
read once; counts are added up by each task and then over buckets, and only one sum per bucket comes to the driver.

Ranks: bins of the score come from its percentiles, offsets of bins from their counts, and only bins that reach into the drawn
part are sorted, each for itself. Nothing is sorted as a whole and no cut-off is estimated.

Rules for unusual rows: a NULL text has no words, so no features, weight 0 and no draw; so has a text without words. A row
without an id gets the noise of the empty id and comes after equal scores with one. Rows that share an id are separate
documents with equal noise; fully equal rows are ranked in any order. An empty source gives an empty result, an empty
target leaves its counts at 0. Very long texts are scanned as a whole. Columns beside id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .bins import ordered_bins
from .common import partitions, stored


@dataclass(frozen=True)
class Settings:
    buckets: int = 10_000
    least_words: int = 20  # documents with fewer are never drawn
    percent: int = 5
    seed: int = 42


LOWER = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")
#: Separators are all ASCII characters but digits and lower-case letters; texts are lower-cased before.
SEPARATORS = re.compile(rb"[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
#: At every word: the word, and behind its right boundary the next word and the one after that, each with its space.
FEATURES = regex.compile(rb" ([^ ]+)(?=( [^ ]+)?( [^ ]+)?)")


def collapsed(text: str) -> bytes:
    """Lower-cased words, a single space in front of each."""
    return (b" " + SEPARATORS.sub(b" ", text.encode("utf-8", "replace").translate(LOWER)).strip(b" ")).rstrip(b" ")


def feature_codes(text: str) -> tuple[int, list[int]]:
    """Number of words, and the CRC-32 of every feature of the text."""
    codes: list[int] = []
    add, crc, words = codes.append, zlib.crc32, 0
    for match in FEATURES.finditer(collapsed(text), overlapped=True):
        word, second, third = match.groups()
        words += 1
        code = crc(word)
        add(code)
        if second is not None:
            code = crc(second, code)
            add(code)
            if third is not None:
                add(crc(third, code))
    return words, codes


def _features(docs: DataFrame, id_col: str, text_col: str, buckets: int) -> DataFrame:
    """``id``, ``n_words``, ``n_features`` and the bucket numbers of every text."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            words, sizes, found = [], [], []
            for text in batch.column("text"):
                count, codes = feature_codes(text.as_py() or "")
                words.append(count)
                sizes.append(len(codes))
                found.append((np.array(codes, np.uint32) % np.uint32(buckets)).astype(kind).tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), pa.array(words, pa.int64()), pa.array(sizes, pa.int64()), pa.array(found, pa.binary())], ["id", "n_words", "n_features", "found"]
            )

    schema = T.StructType([T.StructField("id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()),
                           T.StructField("n_features", T.LongType()), T.StructField("found", T.BinaryType())])
    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(scan, schema)


def _counts(features: DataFrame, buckets: int) -> np.ndarray:
    """How often each bucket occurs; tasks add up before the shuffle, one sum per bucket reaches the driver."""
    kind = np.uint16 if buckets <= 1 << 16 else np.uint32

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(buckets, np.int64)
        for batch in batches:
            for found in batch.column("found"):
                counts += np.bincount(np.frombuffer(found.as_py(), kind), minlength=buckets)
        used = np.nonzero(counts)[0]
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(used, pa.int32()), "n": pa.array(counts[used], pa.int64())})

    sums = features.select("found").mapInArrow(add, "bucket int, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    counts = np.zeros(buckets, np.int64)
    for row in sums.collect():
        counts[row.bucket] = row.n
    return counts


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Gain of every bucket in thousandths, rounded down."""
    buckets, all_source, all_target = len(source), float(source.sum() + len(source)), float(target.sum() + len(target))
    ratio = ((float(t + 1) * all_source) / (float(s + 1) * all_target) for s, t in zip(source.tolist(), target.tolist(), strict=True))
    return np.fromiter((math.floor(1000 * math.log(r)) for r in ratio), np.int64, buckets)


def noise(seed: int, doc_id: int | None) -> int:
    """Gumbel noise of an id in thousandths, rounded down."""
    head = int(hashlib.sha256(f"{seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((head + 0.5) / 4294967296)))


def _scored(features: DataFrame, gain: np.ndarray, seed: int) -> DataFrame:
    kind = np.uint16 if len(gain) <= 1 << 16 else np.uint32

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [int(gain[np.frombuffer(found.as_py(), kind)].sum()) for found in batch.column("found")]
            scores = [w + noise(seed, i) for w, i in zip(weights, batch.column("id").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("id"), batch.column("n_words"), batch.column("n_features"), pa.array(weights, pa.int64()), pa.array(scores, pa.int64())],
                ["id", "n_words", "n_features", "weight", "score"],
            )

    schema = T.StructType([*features.select("id", "n_words", "n_features").schema, T.StructField("weight", T.LongType()), T.StructField("score", T.LongType())])
    return features.mapInArrow(score, schema)


def resampled(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """``id``, ``n_words``, ``n_features``, ``weight``, ``score`` and ``rank`` (NULL unless drawn) of every document."""
    settings = settings or Settings()
    features = stored(_features(docs, id_col, text_col, settings.buckets), "features")
    source = _counts(features, settings.buckets)
    wanted = _counts(_features(target, target_col, target_col, settings.buckets), settings.buckets)
    scored = stored(_scored(features, gains(source, wanted), settings.seed), "scores")
    return ranked(scored, settings)


def ranked(scored: DataFrame, settings: Settings) -> DataFrame:
    """Adds ``rank``, from 1 for the highest score, to the drawn part of the documents that may be drawn."""
    may = F.col("n_words") >= settings.least_words
    # a bin's number grows as scores fall
    bins = ordered_bins(scored.where(may), "score", 4 * partitions(scored.sparkSession))
    marked = scored.withColumn("__bin", F.when(may, bins(F.col("score"))))
    sizes = {r["__bin"]: r["n"] for r in marked.where(may).groupBy("__bin").agg(F.count("*").alias("n")).collect()}
    drawn, before, offsets = settings.percent * sum(sizes.values()) // 100, 0, {}
    for number in sorted(sizes):
        if before >= drawn:
            break
        offsets[number] = before
        before += sizes[number]
    rest = marked.where(F.col("__bin").isNull() | ~F.col("__bin").isin(list(offsets)) if offsets else F.lit(True)).withColumn("rank", F.lit(None).cast("bigint"))
    if not offsets:
        return rest.drop("__bin")
    start = F.element_at(F.create_map(*[F.lit(x) for pair in offsets.items() for x in pair]), F.col("__bin"))
    order = Window.partitionBy("__bin").orderBy(F.desc("score"), F.col("id").asc_nulls_last())
    high = marked.where(F.col("__bin").isin(list(offsets))).withColumn("__place", F.row_number().over(order) + start)
    high = high.withColumn("rank", F.when(F.col("__place") <= drawn, F.col("__place")).cast("bigint")).drop("__place")
    return high.unionByName(rest).drop("__bin")
