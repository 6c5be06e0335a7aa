"""Leakage-free folds and bounded samples."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.hashing import md5_int
from .plan_tools import attach
from .ranking import row_numbers


def group_folds(df: DataFrame, group: str, folds: int, seed: int, strata: str | None = None) -> DataFrame:
    """One row per group: group, stratum, rows, fold (1..folds). Whole groups, balanced within each stratum.

    Groups of a stratum are ordered by rows (largest first, ties by hash) and dealt to the folds back and forth: every
    second full round, counted over all strata, runs backwards, so rows stay level too. The next stratum goes on at the
    fold where the one before stopped, so the groups per fold differ by at most one, within every stratum and over all
    of them. A group in two strata or a stratum with fewer groups than folds stops the job.
    """
    if folds < 2:
        raise ValueError(f"{folds} fold leaves nothing to hold out")
    stratum = F.col(strata) if strata else F.lit("all")
    sizes = df.groupBy(F.col(group)).agg(
        F.count(F.lit(1)).alias("rows"), F.min(stratum).alias("stratum"),
        (~F.min(stratum).eqNullSafe(F.max(stratum)) | (F.count(stratum) % F.greatest(F.count(F.lit(1)), F.lit(1)) != 0)).alias("__mixed"),
    )
    stop = F.raise_error(F.concat(F.lit(f"Each {group} must have one {strata}: "), F.col(group).cast("string")))
    sizes = sizes.withColumn("rows", F.when(F.col("__mixed"), stop.cast("bigint")).otherwise(F.col("rows"))).drop("__mixed")
    tie = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(group).cast("string")))
    ranked = row_numbers(
        sizes, ["stratum"], [-F.col("rows"), F.substring(tie, 1, 3)], [tie, F.col(group)], "rank", total="groups"
    )
    few = F.raise_error(F.format_string(f"Every stratum needs at least {folds} groups; %s has %d", F.col("stratum").cast("string"), F.col("groups")))
    # one row per stratum
    totals = sizes.groupBy("stratum").agg(F.count(F.lit(1)).alias("__groups"))
    before = lambda value: F.coalesce(F.sum(value).over(Window.partitionBy(F.lit(1)).orderBy("stratum").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rounds = lambda groups: F.floor(F.col(groups) / folds)
    starts = totals.select("stratum", before(F.col("__groups")).alias("__start"), before(rounds("__groups")).alias("__rounds"))
    ranked = attach(ranked, starts, ["stratum"])
    turn, place = F.floor((F.col("rank") - 1) / folds), (F.col("rank") - 1) % folds
    place = F.when((turn < rounds("groups")) & ((F.col("__rounds") + turn) % 2 == 1), folds - 1 - place).otherwise(place)
    fold = (F.col("__start") + place) % folds + 1
    return ranked.select(
        group, "stratum", "rows", F.when(F.col("groups") < folds, few.cast("int")).otherwise(fold.cast("int")).alias("fold")
    )


def default_strata(df: DataFrame, cv_mode: str, folds: int) -> str | None:
    """Column to balance folds by: shape for six-taxon data, else balance bin, else shape, if large enough."""
    if cv_mode != "backbone":
        return None
    shape, balance = "backbone_shape_class", "backbone_balance_bin"
    kinds = [c for c in (shape, balance) if c in df.columns]
    sized = "tree_size" in df.columns
    if not kinds:
        return None
    # one row per group, then one per stratum, then one per column: the same two small jobs whatever is chosen
    groups = df.groupBy("backbone_id", *kinds).agg(*[f("tree_size" if sized else F.lit(0)).alias(n) for f, n in ((F.min, "low"), (F.max, "high"))])
    strata = groups.select("backbone_id", "low", "high", F.explode(F.array(*[F.struct(F.lit(c).alias("kind"), F.col(c).cast("string").alias("value")) for c in kinds])).alias("s"))
    each = strata.select("*", "s.*").groupBy("kind", "value").agg(F.count_distinct("backbone_id").alias("n"), F.min("low").alias("low"), F.max("high").alias("high"))
    found = {
        r.kind: r for r in each.groupBy("kind").agg(
            F.min(F.when(F.col("value").isNotNull(), F.col("n"))).alias("smallest"), F.count("value").alias("values"), F.min("low").alias("low"), F.max("high").alias("high")
        ).collect()
    }
    enough = lambda c: c in found and found[c].smallest is not None and found[c].smallest >= folds
    if sized and shape in found and found[shape].low == found[shape].high == 6 and enough(shape):
        return shape
    if balance in found and found[balance]["values"] > 1 and enough(balance):
        return balance
    return shape if enough(shape) else None


def with_folds(df: DataFrame, assignment: DataFrame, group: str, name: str = "fold") -> DataFrame:
    """Rows with their group's fold; how the small side travels is left to its size at run time."""
    return df.join(assignment.select(group, F.col("fold").alias(name)), group)


def bounded_sample(df: DataFrame, key: str, order: list[str], limit: int, seed: int, tag: str) -> DataFrame:
    """At most ``limit`` rows per key, the ones with the smallest seeded hash of ``order``.

    A task keeps the ``limit`` smallest rows of each key it meets (Spark derives a group limit from the filter on the
    rank), so the one shuffle carries at most ``limit`` rows per key and task, however many rows a key has. The session's
    ``spark.sql.optimizer.windowGroupLimitThreshold`` (1,000) is the largest limit Spark does this for.
    """
    hashed = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(tag), F.col(key).cast("string"), *[F.col(c).cast("string") for c in order]))
    smallest = Window.partitionBy(key).orderBy("__h", *order)
    return df.withColumn("__h", hashed).withColumn("__rank", F.row_number().over(smallest)).where(F.col("__rank") <= limit).drop("__rank", "__h")


def missing_keys(wanted: DataFrame, rows: DataFrame, key: str = "simulation_id", shown: int = 5) -> tuple[int, list]:
    """How many of the wanted keys have no row, and the first ``shown`` of them: what a sample would silently lack."""
    absent = wanted.select(key).distinct().join(rows.select(key).distinct(), key, "left_anti")
    found = absent.agg(F.count(F.lit(1)).alias("n")).first().n
    return found, [r[0] for r in absent.orderBy(key).limit(shown).collect()] if found else []


def resample_seed(seed: int, name: Column) -> Column:
    return md5_int(F.lit(str(seed)), name)
