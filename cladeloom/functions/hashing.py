"""Deterministic draws: md5 ranks inside the JVM, and the blake2b seed that Spark has no function for."""

from __future__ import annotations

import hashlib

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Fixed value: seeds are reduced modulo the largest signed 32-bit prime.
SEED_MODULUS = 2_147_483_647


def md5_int(*parts: Column | str) -> Column:
    """32-bit integer from the md5 of the parts joined by ``|``."""
    joined = F.concat_ws("|", *[p if isinstance(p, Column) else F.lit(p) for p in parts])
    return F.conv(F.substring(F.md5(joined), 1, 8), 16, 10).cast("bigint")


@F.pandas_udf(T.LongType())
def _blake2b_seed(keys: pd.Series, base: pd.Series) -> pd.Series:
    def one(key: str, offset: int) -> int:
        digest = hashlib.blake2b(key.encode(), digest_size=8).digest()
        return (int.from_bytes(digest, "big") + int(offset)) % SEED_MODULUS

    return pd.Series([one(k, b) for k, b in zip(keys, base)], dtype="int64")


def deterministic_seed(base_seed: int | Column, key: Column) -> Column:
    """(first 8 bytes of blake2b(key) + base) mod 2147483647."""
    base = base_seed if isinstance(base_seed, Column) else F.lit(int(base_seed)).cast("bigint")
    return _blake2b_seed(key, base)


def start_seed(simulation_id: Column, start_index: Column) -> Column:
    """1 + (first 8 bytes of sha256("id|start")) mod 2e9, in exact decimal arithmetic."""
    hexed = F.substring(F.sha2(F.concat_ws("|", simulation_id, start_index.cast("string")), 256), 1, 16)
    value = F.conv(hexed, 16, 10).cast("decimal(20,0)")
    return (value % F.lit(2_000_000_000).cast("decimal(20,0)") + 1).cast("bigint")
