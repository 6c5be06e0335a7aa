"""What the operators for training data share: tables, intermediate tables, word hashes, components."""

from __future__ import annotations

import uuid
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cladeloom.session import checkpoint_folder

#: Distinct words whose hashes one Python worker keeps at most.
WORDS_KEPT = 400_000

#: Spark drops the shuffle files of a statement at its end; a stored table never needs them again.
SHUFFLE_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared checkpoint folder and read back: later steps neither repeat its work
    nor depend on an executor that may be lost, and read only the columns they need."""
    spark = df.sparkSession
    path = f"{checkpoint_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(SHUFFLE_CLEANUP, "false")
    spark.conf.set(SHUFFLE_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.set(SHUFFLE_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def mix(values: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every input bit over 64 bits (uint64, wraps around)."""
    x = values ^ (values >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hash of each word, computed once a word; bounded by :data:`WORDS_KEPT`."""

    def __missing__(self, word: bytes) -> int:
        value = self[word] = xxhash.xxh3_64_intdigest(word)
        return value

    def of(self, words: list[bytes]) -> np.ndarray:
        if len(self) > WORDS_KEPT:
            self.clear()
        return np.fromiter(map(self.__getitem__, words), dtype=np.uint64, count=len(words))


class Remembered(dict):
    """A cache in two generations: when the young one is full it becomes the old one; what is asked for again stays."""

    def __init__(self, most: int, compute):
        super().__init__()
        self.most, self.compute, self.old = most, compute, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.compute(key)
        if len(key) <= 100:
            if len(self) >= self.most:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


def gram_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of ``width`` consecutive words."""
    count = len(hashes) - width + 1
    rolled = hashes[:count].copy()
    for shift in range(1, width):
        rolled = mix(rolled) + hashes[shift : shift + count]
    return mix(rolled)


def binary_lists(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    """Arrow list column from one array per row."""
    ends = np.cumsum([0, *map(len, values)], dtype=np.int32)
    flat = np.concatenate(values) if values else np.empty(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat, kind))


def _both_ways(edges: DataFrame) -> DataFrame:
    return edges.select("u", "v").unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))


def components(links: DataFrame) -> DataFrame:
    """``(node, component)`` of the undirected ``links(u, v)``: the smallest node each one can reach.

    Alternates two rounds until nothing changes: every node hands its smallest neighbour to its larger
    neighbours, then to its smaller ones. The number of rounds grows with the logarithm of the longest chain.
    The minimum per node is combined before the shuffle, and the join back is an ordinary one that Spark splits
    when a node has very many links. Only a row count and one checksum of each round come to the driver.
    """
    edges = links.select("u", "v").where("u <> v").select(
        F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")
    ).distinct()
    before = None
    while True:
        for larger in (True, False):
            around = _both_ways(edges) if larger else edges
            smallest = around.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("low"))
            joined = around.join(smallest, "u")
            if larger:
                passed = joined.where("v > u").select(F.col("v").alias("u"), F.col("low").alias("v"))
            else:
                passed = joined.where("v < u").select(
                    F.when(F.col("v") == F.col("low"), F.col("u")).otherwise(F.col("v")).alias("u"), F.col("low").alias("v")
                )
            edges = passed.where("u <> v").distinct()
        edges = stored(edges, "links")
        state = edges.agg(F.count("*").alias("n"), F.sum(F.hash("u", "v").cast("bigint")).alias("h")).first()
        if (state.n, state.h) == before:
            break
        before = (state.n, state.h)
    members = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return members.unionAll(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())


def union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)
