"""One rooted tree per simulation from weighted triplets.

A split of a taxon set is scored by the mean signed support of the triplets it separates: a triplet whose
lone taxon is x adds (weight of "x is the outgroup") minus the two other weights, and the sum is divided by
the number of distinct separated triplets. The tree is grown by splitting every set of three or more taxa.

``exact`` tries all splits of up to 12 taxa and is one JVM projection over bit masks. ``fm`` improves one
split by single-taxon moves; each move depends on the last, so a simulation is solved inside one Arrow
batch row. Weights of equal triplets are summed before they are gathered, so a simulation never carries
more than C(n, 3) triplets into a task.
"""

from __future__ import annotations

import time

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .features import TAXA

# Exact search limit, and the decimals to which scores count as tied.
EXACT_TAXA = 12
SCORE_DECIMALS = 12
TOO_MANY = (
    "the exact search goes up to 12 taxa; larger trees take method fm"
)
WEIGHTS = ["weight0", "weight1", "weight2"]


def gather(weighted: DataFrame, key: str = "simulation_id") -> DataFrame:
    """key, taxa (sorted), tri (three 0-based taxon positions and the three weights, sorted)."""
    triplets = weighted.groupBy(key, *TAXA).agg(*[F.sum(w).alias(w) for w in WEIGHTS])
    listed = triplets.groupBy(key).agg(
        F.array_sort(F.collect_list(F.struct(*TAXA, *WEIGHTS))).alias("__rows")
    )
    taxa = F.array_sort(F.array_distinct(F.flatten(F.transform("__rows", lambda r: F.array(*[r[t] for t in TAXA])))))
    at = lambda t: F.array_position("taxa", t).cast("int") - 1
    tri = F.transform(
        "__rows",
        lambda r: F.struct(*[at(r[t]).alias(t[-1]) for t in TAXA], *[r[w].alias(f"w{w[-1]}") for w in WEIGHTS]),
    )
    return listed.withColumn("taxa", taxa).withColumn("tri", tri).drop("__rows")


# exact search ---------------------------------------------------------------------------------------


def _bit(position: Column) -> Column:
    return F.call_function("shiftleft", F.lit(1).cast("bigint"), position)


def _members(mask: Column, n: Column) -> Column:
    """Positions of the set bits, ascending."""
    return F.filter(F.sequence(F.lit(0), n - 1), lambda i: F.getbit(mask, i) == 1)


def score_split(masked: Column, left: Column) -> Column:
    """Mean signed support of the split whose one side is the mask ``left``; -infinity if nothing crosses.

    ``masked`` holds structs (all, a, b, c, w0, w1, w2) with the bits of a triplet and its weights.
    """
    start = F.struct(F.lit(0.0).alias("sum"), F.lit(0).alias("crossing"))

    def add(acc: Column, t: Column) -> Column:
        inside = t["all"].bitwiseAND(left)
        lone = F.when(F.bit_count(inside) == 1, inside).otherwise(t["all"].bitwiseXOR(inside))
        own = F.when(lone == t["c"], t["w0"]).when(lone == t["b"], t["w1"]).otherwise(t["w2"])
        signed = 2 * own - (t["w0"] + t["w1"] + t["w2"])
        return F.when((inside == 0) | (inside == t["all"]), acc).otherwise(
            F.struct((acc["sum"] + signed).alias("sum"), (acc["crossing"] + 1).alias("crossing"))
        )

    return F.aggregate(
        masked, start, add,
        lambda acc: F.when(acc["crossing"] > 0, F.round(acc["sum"] / acc["crossing"], SCORE_DECIMALS)).otherwise(
            F.lit(float("-inf"))
        ),
    )


def bipartitions(mask: Column, n: Column) -> Column:
    """Masks of every side that holds the first taxon of ``mask`` and is not all of it."""
    others = F.slice(_members(mask, n), F.lit(2), F.greatest(F.bit_count(mask) - 1, F.lit(0)))
    anchor = _bit(F.get(_members(mask, n), F.lit(0)))
    count = F.call_function("shiftleft", F.lit(1), F.bit_count(mask) - 1) - 1
    return F.transform(
        F.sequence(F.lit(0), count - 1),
        lambda s: F.aggregate(
            F.filter(others, lambda _, i: F.getbit(s, i) == 1), anchor, lambda m, p: m.bitwiseOR(_bit(p))
        ),
    )


def masked_triplets() -> Column:
    return F.transform(
        "tri",
        lambda t: F.struct(
            _bit(t["a"]).bitwiseOR(_bit(t["b"])).bitwiseOR(_bit(t["c"])).alias("all"),
            _bit(t["a"]).alias("a"), _bit(t["b"]).alias("b"), _bit(t["c"]).alias("c"), t["w0"], t["w1"], t["w2"],
        ),
    )


def best_split(mask: Column, masked: Column, n: Column) -> Column:
    """Best left side: highest score, then most balanced, then the last list of members."""
    inside = F.filter(masked, lambda t: t["all"].bitwiseAND(mask) == t["all"])
    ranked = F.transform(
        bipartitions(mask, n),
        lambda left: F.struct(
            score_split(inside, left).alias("score"),
            (-F.abs(2 * F.bit_count(left) - F.bit_count(mask))).alias("balance"),
            _members(left, n).alias("members"), left.alias("left"),
        ),
    )
    return F.array_max(ranked)


def exact_clades(n: Column, masked: Column) -> Column:
    """Masks of all sets of two or more taxa, the whole set included."""
    whole = _bit(n) - 1
    start = F.struct(F.array(whole).alias("todo"), F.array(whole).alias("clades"))

    def step(state: Column, _: Column) -> Column:
        mask = F.get(state["todo"], F.lit(0))
        rest = F.slice(state["todo"], F.lit(2), F.greatest(F.size(state["todo"]) - 1, F.lit(0)))
        left = best_split(mask, masked, n)["left"]
        sides = F.array(left, mask.bitwiseXOR(left))
        split = F.transform(F.array(sides), lambda both: F.struct(
            F.concat(rest, F.filter(both, lambda m: F.bit_count(m) > 2)).alias("todo"),
            F.concat(state["clades"], F.filter(both, lambda m: F.bit_count(m) > 1)).alias("clades"),
        ))
        return F.when((F.size(state["todo"]) == 0) | (F.bit_count(mask) < 3), state).otherwise(F.get(split, F.lit(0)))

    return F.aggregate(F.sequence(F.lit(1), n - 1), start, step, lambda s: s["clades"])


def clades_to_newick(clades: Column, taxa: Column) -> Column:
    """Newick text of a binary tree given as clade masks; children in order of their smallest taxon."""
    n = F.size(taxa)
    has = lambda mask, i: F.getbit(mask, i) == 1
    by_size = F.reverse(F.array_sort(F.transform(clades, lambda m: F.struct(F.bit_count(m).alias("k"), m.alias("m")))))
    path = lambda i: F.concat(
        F.transform(F.filter(by_size, lambda s: has(s["m"], i)), lambda s: F.get(_members(s["m"], n), F.lit(0))), F.array(i)
    )
    ordered = F.transform(
        F.array_sort(F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(path(i).alias("p"), i.alias("i")))),
        lambda s: s["i"],
    )

    def text(order: Column) -> Column:
        def leaf(i: Column, q: Column) -> Column:
            before, after = F.get(order, q - 1), F.get(order, q + 1)
            opens = F.size(F.filter(clades, lambda m: has(m, i) & ((q == 0) | ~has(m, F.coalesce(before, i)))))
            closes = F.size(F.filter(clades, lambda m: has(m, i) & (after.isNull() | ~has(m, F.coalesce(after, i)))))
            return F.concat(F.repeat(F.lit("("), opens), F.get(taxa, i), F.repeat(F.lit(")"), closes))

        return F.concat(F.array_join(F.transform(order, leaf), ","), F.lit(";"))

    return F.get(F.transform(F.array(ordered), text), F.lit(0))


def assemble_exact(gathered: DataFrame) -> DataFrame:
    """Add inferred_newick, assembly_error and a NULL assembly_seconds (the work is not timed per row)."""
    fits = F.size("taxa") <= EXACT_TAXA
    return (
        gathered.withColumn("__n", F.size("taxa"))
        .withColumn("__masked", F.when(fits, masked_triplets()))
        .withColumn("__clades", F.when(fits, exact_clades(F.col("__n"), F.col("__masked"))))
        .withColumn("inferred_newick", F.coalesce(clades_to_newick(F.col("__clades"), F.col("taxa")), F.lit("")))
        .withColumn("assembly_error", F.when(fits, F.lit("")).otherwise(F.lit(TOO_MANY)))
        .withColumn("assembly_seconds", F.lit(None).cast("double"))
        .drop("__n", "__masked", "__clades", "tri")
    )


# move-based search ----------------------------------------------------------------------------------


def _signed(sides: np.ndarray, outgroup: np.ndarray, total: np.ndarray):
    """Signed support and crossing flag of each triplet for an array of three sides per triplet."""
    s0, s1, s2 = sides[..., 0], sides[..., 1], sides[..., 2]
    crossing = ~((s0 == s1) & (s1 == s2))
    lone = np.where(s0 == s1, outgroup[:, 2], np.where(s0 == s2, outgroup[:, 1], outgroup[:, 0]))
    return np.where(crossing, 2.0 * lone - total, 0.0), crossing.astype(np.int64)


def _start(n: int, tri: np.ndarray, outgroup: np.ndarray) -> np.ndarray:
    """First sides: two seeds that should part, then each taxon to the side it is closer to."""
    support, seen = np.zeros((n, n)), np.zeros((n, n), dtype=bool)
    for x, y, z in ((0, 1, 2), (0, 2, 1), (1, 2, 0)):
        np.add.at(support, (tri[:, x], tri[:, y]), outgroup[:, z])
        seen[tri[:, x], tri[:, y]] = True
    support, seen = support + support.T, seen | seen.T
    first, second = np.triu_indices(n, 1)
    unseen = np.flatnonzero(~seen[first, second])
    if len(unseen) and (outgroup.sum() >= 0) and not (support[seen] < 0).any():
        pick = unseen[0]
    else:
        pick = int(np.argmin(support[first, second]))
    a, b = int(first[pick]), int(second[pick])
    left = np.zeros(n, dtype=bool)
    left[a] = True
    near_left, near_right, size_left, size_right = support[a].copy(), support[b].copy(), 1, 1
    for taxon in range(n):
        if taxon in (a, b):
            continue
        gap = round(near_left[taxon] / size_left - near_right[taxon] / size_right, SCORE_DECIMALS)
        if gap > 0 or (gap == 0 and size_left <= size_right):
            left[taxon] = True
            near_left += support[taxon]
            size_left += 1
        else:
            near_right += support[taxon]
            size_right += 1
    return left


def _moves(left: np.ndarray, tri: np.ndarray, outgroup: np.ndarray, total: np.ndarray, touching: list[np.ndarray]):
    """Move every taxon once, best first; return the best sides met and their gain over the start."""
    n, side = len(left), left.copy()
    flips = np.eye(3, dtype=bool)

    def state(rows):
        sides = side[tri[rows]]
        value, cross = _signed(sides, outgroup[rows], total[rows])
        flipped = [_signed(sides ^ flips[j], outgroup[rows], total[rows]) for j in range(3)]
        gain = np.stack([f[0] - value for f in flipped], axis=1)
        more = np.stack([f[1] - cross for f in flipped], axis=1)
        return value, cross, gain, more

    every = np.arange(len(tri))
    value, cross, gain, more = state(every)
    flat = tri.ravel()
    gains = np.bincount(flat, gain.ravel(), n)
    growth = np.bincount(flat, more.ravel(), n)
    numerator, denominator = value.sum(), cross.sum()
    started = numerator / denominator if denominator else -np.inf
    free, names = np.ones(n, dtype=bool), np.arange(n)
    best_score, best = -np.inf, None
    while True:
        count = int(side.sum())
        crossing = denominator + growth
        usable = free & np.where(side, count > 1, n - count > 1) & (crossing > 0.5)
        if not usable.any():
            break
        options = names[usable]
        scores = np.round((numerator + gains[options]) / crossing[options], SCORE_DECIMALS)
        chosen = int(options[np.lexsort((options, np.round(gains[options], SCORE_DECIMALS), scores))[-1]])
        numerator, denominator = numerator + gains[chosen], crossing[chosen]
        free[chosen] = False
        rows = touching[chosen]
        members = tri[rows].ravel()
        side[chosen] = not side[chosen]
        _, _, new_gain, new_more = state(rows)
        gains += np.bincount(members, (new_gain - gain[rows]).ravel(), n)
        growth += np.bincount(members, (new_more - more[rows]).ravel(), n)
        gain[rows], more[rows] = new_gain, new_more
        reached = numerator / denominator
        if reached > best_score + 1e-12 or best is None:
            best_score, best = reached, side.copy()
    if best is None or not best_score - started > 1e-12:
        return left, 0.0
    return best, best_score - started


def move_split(n: int, tri: np.ndarray, outgroup: np.ndarray) -> np.ndarray:
    """Sides of one split found by repeated rounds of moves; the sorted halves if there are no triplets."""
    if not len(tri):
        left = np.zeros(n, dtype=bool)
        left[: max(1, n // 2)] = True
        return left
    total = outgroup.sum(axis=1)
    left = _start(n, tri, outgroup)
    order = np.argsort(tri.ravel(), kind="stable")
    touching = np.split(order // 3, np.cumsum(np.bincount(tri.ravel(), minlength=n))[:-1])
    gain = 1.0
    while gain > 1e-12:
        left, gain = _moves(left, tri, outgroup, total, touching)
    return left


def grow_tree(taxa: list[str], tri: np.ndarray, outgroup: np.ndarray) -> str:
    """Newick text of the tree grown by ``move_split``."""

    def grow(members: np.ndarray, tri: np.ndarray, outgroup: np.ndarray) -> str:
        if len(members) == 1:
            return taxa[members[0]]
        if len(members) == 2:
            return f"({taxa[members[0]]},{taxa[members[1]]})"
        left = move_split(len(members), tri, outgroup)
        if not left[0]:
            left = ~left
        sides = left[tri]
        parts = []
        for inside in (left, ~left):
            keep = sides.all(axis=1) if inside is left else ~sides.any(axis=1)
            renumber = np.cumsum(inside) - 1
            parts.append(grow(members[inside], renumber[tri[keep]], outgroup[keep]))
        return f"({parts[0]},{parts[1]})"

    return grow(np.arange(len(taxa)), tri, outgroup) + ";"


_RESULT = T.StructType([
    T.StructField("newick", T.StringType()), T.StructField("error", T.StringType()), T.StructField("seconds", T.DoubleType()),
])


@F.pandas_udf(_RESULT)
def _grow(taxa: pd.Series, positions: pd.Series, weights: pd.Series) -> pd.DataFrame:
    rows = []
    for names, where, value in zip(taxa, positions, weights):
        started = time.perf_counter()
        try:
            tri = np.asarray(where, dtype=np.int64).reshape(-1, 3)
            outgroup = np.asarray(value, dtype=float).reshape(-1, 3)
            rows.append((grow_tree(list(names), tri, outgroup), "", time.perf_counter() - started))
        except Exception as error:  # noqa: BLE001 - one bad simulation must not stop the others
            rows.append(("", f"{type(error).__name__}: {error}", time.perf_counter() - started))
    return pd.DataFrame(rows, columns=["newick", "error", "seconds"])


def assemble_moves(gathered: DataFrame) -> DataFrame:
    positions = F.flatten(F.transform("tri", lambda t: F.array(t["a"], t["b"], t["c"])))
    # the weight of the resolution in which a, b or c is the outgroup
    outgroup = F.flatten(F.transform("tri", lambda t: F.array(t["w2"], t["w1"], t["w0"])))
    return (
        gathered.withColumn("__g", _grow("taxa", positions, outgroup))
        .withColumn("inferred_newick", F.col("__g")["newick"])
        .withColumn("assembly_error", F.col("__g")["error"])
        .withColumn("assembly_seconds", F.col("__g")["seconds"])
        .drop("__g", "tri")
    )


def assemble(weighted: DataFrame, method: str = "fm", key: str = "simulation_id") -> DataFrame:
    """key, inferred_newick, assembly_status, assembly_error, assembly_seconds; one row per simulation."""
    if method not in ("fm", "exact"):
        raise ValueError("method must be 'fm' or 'exact'")
    gathered = gather(weighted, key)
    solved = assemble_exact(gathered) if method == "exact" else assemble_moves(gathered)
    status = F.when(F.col("assembly_error") == "", "completed").otherwise("failed")
    return solved.withColumn("assembly_status", status).drop("taxa")
