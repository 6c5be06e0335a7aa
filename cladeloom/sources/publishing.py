"""Verified output: a batch is staged, read back and compared, and only then becomes part of its table.

A table is a folder of batches, one subfolder each. Staged files lie in a folder whose name readers pass over. While they
are written, rows and an order-free sum of row hashes are counted in the same job; what is read back from the files has to
give the same numbers and exactly the expected keys. The step that makes a batch visible is one rename of a folder, which takes
the place of an earlier attempt of the same batch: a retry replaces, it never adds rows twice, and a job that dies before
leaves the table as it was.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

BATCH = "published_batch"


class VerificationError(RuntimeError):
    """Files that don't hold what was written."""


@dataclass(frozen=True)
class Staged:
    table: str
    batch: str
    folder: str
    rows: int
    checksum: int

    @property
    def target(self) -> str:
        return f"{self.table}/{BATCH}={self.batch}"


def checksum(columns: list[str]) -> Column:
    """Sum of row hashes: independent of the order of rows, sensitive to lost, changed and repeated ones."""
    return F.coalesce(F.sum(F.xxhash64(*columns).cast("decimal(38,0)")), F.lit(0).cast("decimal(38,0)"))


def batch_of(keys: DataFrame) -> str:
    """Name of the batch that holds these keys: the same keys in any order have the same name."""
    row = keys.agg(F.count(F.lit(1)).alias("n"), checksum(keys.columns).alias("h")).first()
    return f"{row.n}-{int(row.h) % (1 << 64):016x}"


def _files(spark: SparkSession, path: str):
    target = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), target


def stage(df: DataFrame, table: str, batch: str) -> Staged:
    """Write ``df`` where no reader of ``table`` looks, and count what goes in."""
    folder = f"{table}/_staged-{batch}-{uuid.uuid4().hex}"
    seen = Observation(f"staged-{uuid.uuid4().hex}")
    df.observe(seen, F.count(F.lit(1)).alias("rows"), checksum(df.columns).alias("checksum")).write.parquet(folder)
    return Staged(table, batch, folder, int(seen.get["rows"]), int(seen.get["checksum"]))


def verify(staged: Staged, spark: SparkSession, keys: DataFrame | None = None, key: str = "simulation_id") -> None:
    """Read the staged files back; anything but the same rows, with exactly ``keys``, stops the job."""
    try:
        back = spark.read.parquet(staged.folder)
        found = back.agg(F.count(F.lit(1)).alias("rows"), checksum(back.columns).alias("checksum")).first()
    except Exception as error:
        raise VerificationError(f"batch {staged.batch} can't be read back: {str(error)[:300]}") from error
    if (found.rows, int(found.checksum)) != (staged.rows, staged.checksum):
        raise VerificationError(f"batch {staged.batch}: {staged.rows} rows were written, {found.rows} read back, checksums {staged.checksum} and {found.checksum}")
    if keys is not None:
        want, have = keys.select(key).distinct().withColumn("__w", F.lit(1)), back.select(key).distinct().withColumn("__h", F.lit(1))
        wrong = want.join(have, key, "full_outer").where("__w IS NULL OR __h IS NULL").select(key, F.col("__w").isNull().alias("foreign")).limit(5).collect()
        if wrong:
            raise VerificationError(f"batch {staged.batch} and its plan differ: " + ", ".join(f"{r[0]} {'is foreign' if r[1] else 'is missing'}" for r in wrong))


def commit(staged: Staged, spark: SparkSession) -> None:
    """Make the batch part of its table. An earlier attempt of the same batch is set aside first and removed last."""
    fs, target = _files(spark, staged.target)
    _, source = _files(spark, staged.folder)
    aside = None
    if fs.exists(target):
        _, aside = _files(spark, f"{staged.table}/_replaced-{uuid.uuid4().hex}")
        if not fs.rename(target, aside):
            raise VerificationError(f"the earlier attempt at {staged.target} can't be set aside")
    if not fs.rename(source, target):
        if aside is not None:
            fs.rename(aside, target)
        raise VerificationError(f"{staged.folder} can't be published as {staged.target}")
    if aside is not None:
        fs.delete(aside, True)


def discard(staged: Staged, spark: SparkSession) -> None:
    fs, folder = _files(spark, staged.folder)
    fs.delete(folder, True)


def publish(df: DataFrame, table: str, batch: str, keys: DataFrame | None = None, key: str = "simulation_id", replace_all: bool = False) -> Staged:
    """Stage, verify and commit one batch. ``replace_all`` removes all other batches once this one has been verified."""
    spark = df.sparkSession
    staged = stage(df, table, batch)
    try:
        verify(staged, spark, keys, key)
    except VerificationError:
        discard(staged, spark)
        raise
    if replace_all:
        fs, root = _files(spark, table)
        for status in fs.listStatus(root):
            name = status.getPath().getName()
            if not name.startswith("_") and name != f"{BATCH}={batch}":
                fs.delete(status.getPath(), True)
    commit(staged, spark)
    return staged


def read_published(spark: SparkSession, table: str) -> DataFrame:
    """Rows of all committed batches."""
    rows = spark.read.parquet(table)
    return rows.drop(BATCH)
