"""Near-duplicate documents: MinHash signatures, a multi-index Hamming join, confirmation on full shingle sets.

1. Each text becomes its set of distinct word shingles (64-bit hashes) and a signature of ``chunks * width`` symbols
   of 16 bits, one per MinHash function. Texts with equal sets form a class at once; only its smallest id goes on.
2. Two signatures that differ in at most ``distance`` symbols agree, by the pigeonhole principle, in one chunk up to
   ``distance // chunks`` symbols. Every chunk therefore emits one key for each choice of the symbols that may
   differ (left out). All pairs within ``distance`` share a key. A pair of similarity s differs in a binomial number
   of symbols with probability 1 - s each; at the defaults and 0.8, 2 in 100,000 such pairs exceed the distance.
3. Keys held by several classes are kept. Within a key, the classes are compared with one hub at a time (the classes
   with the most company over all their keys come first), so a key never lists its pairs. Confirmed links give
   components, and the next hub meets only the classes of other components.
4. What these rounds leave apart is compared without listing the pairs of a key: every class of an open key is
   written as its difference from the key's first hub, and two classes can only be linked if they share enough of
   their differences. They are joined on shared differences, rare ones first, at positions that still allow enough of
   them (a prefix filter); then confirmed. Where an element has very many holders, they meet one of them at a time
   before, and only pairs of different components are listed. So no pair within the distance goes unchecked.
5. Components of all links, carried back to every row of the input.

Rules for unusual rows: a NULL text or one without words has an empty set and is linked with nothing. A row with a
NULL id can't be named in a result and is left out. Repeated rows are answered each; they share a class. Of rows
that share an id but not the text, the set with the smallest digest stands for the id, and all of them get its component.
Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import WordHashes, binary_lists, components, gram_hashes, mix, stored

SYMBOL_BITS = 16
#: Symbols in a chunk.
WIDTH = 4


@dataclass(frozen=True)
class Settings:
    words: int = 5  # words in a shingle
    percent: int = 80  # link if 100 * intersection >= percent * union
    chunks: int = 10
    distance: int = 19  # symbols that may differ; less than two a chunk
    rounds: int = 1  # hubs that every key tries before its open pairs are looked for by their differences
    pairs_a_row: int = 8  # pairs for a row of differences up to which they are listed without more links first

    @property
    def symbols(self) -> int:
        return self.chunks * WIDTH

    @property
    def errors(self) -> int:
        errors = self.distance // self.chunks
        if errors > 1:
            raise ValueError("chunks with more than one differing symbol aren't enumerated: take more chunks")
        return errors


def shingle_set(text: bytes | None, width: int, hashes: WordHashes) -> np.ndarray:
    """Sorted distinct shingle hashes; bytes lower-case A-Z only and split at 0x20 and 0x09-0x0D only."""
    words = text.lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    found = hashes.of(words)
    return np.unique(gram_hashes(found, min(width, len(words))))


class Signer:
    def __init__(self, settings: Settings):
        self.settings = settings
        draw = np.random.default_rng(20_11)
        self.factor = draw.integers(1, 2**63, settings.symbols, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
        self.shift = draw.integers(0, 2**63, settings.symbols, dtype=np.uint64)
        keep = WIDTH - settings.errors
        self.subsets = [list(c) for c in combinations(range(WIDTH), keep)]

    def sign(self, shingles: np.ndarray) -> np.ndarray:
        """16-bit symbols of the signature; one pass over the set per function, so memory stays that of the set."""
        if len(shingles) < 2_000:
            low = (shingles[None, :] * self.factor[:, None] + self.shift[:, None]).min(axis=1)
        else:
            low = np.array([(shingles * f + s).min() for f, s in zip(self.factor, self.shift, strict=True)], np.uint64)
        return (mix(low) & np.uint64(2**SYMBOL_BITS - 1)).astype(np.uint16)

    def keys(self, symbols: np.ndarray) -> np.ndarray:
        chunks = symbols.reshape(self.settings.chunks, WIDTH).astype(np.uint64)
        found = np.empty((self.settings.chunks, len(self.subsets)), np.uint64)
        for at, subset in enumerate(self.subsets):
            value = np.arange(self.settings.chunks, dtype=np.uint64) * np.uint64(len(self.subsets)) + np.uint64(at)
            for symbol in subset:
                value = mix(value * np.uint64(2**SYMBOL_BITS) + chunks[:, symbol])
            found[:, at] = value
        return found.ravel()


def _sign_rows(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        signer, hashes = Signer(settings), WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 1000):
                part = batch.slice(start, 1000)
                sizes, digests, signs, keys = [], [], [], []
                for text in part.column(1):
                    shingles = shingle_set(text.as_py(), settings.words, hashes)
                    sizes.append(len(shingles))
                    digests.append(xxhash.xxh3_128_digest(shingles.tobytes()))
                    if len(shingles):
                        symbols = signer.sign(shingles)
                        signs.append(symbols.view(np.int16))
                        keys.append(signer.keys(symbols).view(np.int64))
                    else:
                        signs.append(np.empty(0, np.int16))
                        keys.append(np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), binary_lists(signs, pa.int16()), binary_lists(keys, pa.int64())],
                    names=["id", "n_shingles", "digest", "sign", "keys"],
                )

    return run


def _shingle_rows(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes = WordHashes()
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                sets = [shingle_set(text.as_py(), words, hashes) for text in part.column(1)]
                digests = pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary())
                lists = binary_lists([s.view(np.int64) for s in sets], pa.int64())
                yield pa.RecordBatch.from_arrays([part.column(0), digests, lists], names=["id", "digest", "shingles"])

    return run


def _differ_in(chunk: int) -> Column:
    """Number of symbols of a chunk in which the signatures ``a`` and ``b`` differ."""
    total = F.lit(0)
    for i in range(chunk * WIDTH, (chunk + 1) * WIDTH):
        total = total + (F.get(F.col("a"), F.lit(i)) != F.get(F.col("b"), F.lit(i))).cast("int")
    return total


def differing(settings: Settings) -> Column:
    """Number of symbols in which the signatures ``a`` and ``b`` differ."""
    total = F.lit(0)
    for chunk in range(settings.chunks):
        total = total + _differ_in(chunk)
    return total


def _confirmed(pairs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Links ``(u, v)`` among distinct ``pairs`` whose full sets are similar enough."""
    both = pairs.join(sets.select(F.col("id").alias("u"), F.col("shingles").alias("a")), "u").join(
        sets.select(F.col("id").alias("v"), F.col("shingles").alias("b")), "v"
    )
    common = F.size(F.array_intersect("a", "b")).cast("bigint")
    return stored(both.where(100 * common >= settings.percent * (F.size("a") + F.size("b") - common)).select("u", "v"), "links")


def _left_apart(placed: DataFrame, hubs: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """Classes under one first hub h, by the elements of their difference from it that two linked ones have to share first:
    ``(hub, id, left, fewest, element, component, out, d, excess)``, ``left`` being how many shared elements stand from there
    on and ``excess`` d less c times the size of the class.

    With D the symmetric difference from h and A the sum of both set sizes, u and v are linked only if their own
    difference, of size ``d_u + d_v - 2 * shared``, is at most ``c * A``, c = (100 - percent) / (100 + percent). One of the two
    isn't linked with h, so ``d > c * (size + size of h)`` holds for it, and ``shared`` has to be positive. In any common
    order of the elements, the first one shared has at least ``shared - 1`` elements of either difference behind it.
    Elements that few classes of the hub hold come first: what many of them lost alike is only joined on by classes with too
    few elements of their own. Elements of a single component link nothing and stand before all others.
    """
    c = (100 - settings.percent) / (100 + settings.percent)
    own = placed.select("key", F.col("id").alias("hub"), F.col("component").alias("hub_component"))
    told = hubs.where("turn = 1").select("key", "hub").join(own, ["key", "hub"])
    groups = placed.join(told, "key").where("id <> hub").select("hub", "id", "component", "hub_component").distinct()
    met = groups.join(sets, "id").join(sets.select(F.col("id").alias("hub"), F.col("shingles").alias("of_hub")), "hub")
    gained, lost = F.array_except("shingles", "of_hub"), F.array_except("of_hub", "shingles")
    rows = met.select(
        "hub", "id", "component", (F.col("component") != F.col("hub_component")).alias("out"), F.size("shingles").alias("n"),
        F.concat(gained, lost).alias("difference"),
    ).withColumn("d", F.size("difference"))
    # the fewest elements, this one included, that have to follow the first shared one
    fewest = F.when(F.col("out"), F.col("d") - F.floor(F.col("n") * (c * (1 + 100 / settings.percent)) + 1e-6)).otherwise(
        F.col("d") - F.floor(F.col("d") * (1 + c) / 2 + 1e-6)
    )
    rows = stored(rows.withColumn("fewest", fewest), "differences")
    each = rows.select("hub", "id", "component", "fewest", F.explode("difference").alias("element"))
    common = each.groupBy("hub", "element").agg(F.count("*").alias("holders"), F.min("component").alias("low"), F.max("component").alias("high"))
    common = common.where("low <> high").select("hub", "element", "holders")
    behind = each.join(common, ["hub", "element"]).groupBy("hub", "id", "fewest").agg(F.sort_array(F.collect_list(F.struct("holders", "element")), asc=False).alias("common"))
    behind = behind.select("hub", "id", "fewest", F.posexplode("common").alias("at", "e")).select("hub", "id", (F.col("at") + 1).alias("left"), "fewest", "e.element")
    return stored(behind.where("left >= fewest").join(rows.select("hub", "id", "component", "out", "d", (F.col("d") - F.col("n") * c).alias("excess")), ["hub", "id"]), "listed")


def _share_enough(settings: Settings) -> Column:
    """Rows ``a`` and ``b`` of one hub and element may be linked, and have not both been linked with the hub."""
    shared = F.ceil((F.col("a.excess") + F.col("b.excess")) / 2 - 1e-6)
    return (F.col("a.out") | F.col("b.out")) & (F.least("a.left", "b.left") >= shared)


def _crossing(listed: DataFrame) -> tuple[int, int]:
    """How many rows are listed, and how many pairs of them share an element but no component."""
    blocks = listed.groupBy("hub", "element", "component").agg(F.count("*").alias("n"))
    groups = blocks.groupBy("hub", "element").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n").cast("double")).alias("alike"))
    rows, pairs = groups.agg(F.sum("n"), F.sum((F.col("n").cast("double") * F.col("n") - F.col("alike")) / 2)).first()
    return rows or 0, int(pairs or 0)


def _to_one(listed: DataFrame, turn: int, settings: Settings) -> DataFrame:
    """Distinct pairs ``(u, v)``: in every group of an element one class, the nearest to the hub and later any, with all others."""
    chosen = (F.col("d"), F.col("id")) if turn == 0 else (F.xxhash64("id", "element", F.lit(turn)), F.col("id"))
    whole = F.struct(*[c.alias(f"by_{i}") for i, c in enumerate(chosen)], "id", "component", "out", "excess", "left")
    ones = listed.groupBy("hub", "element").agg(F.min(whole).alias("one")).select("hub", "element", "one.id", "one.component", "one.out", "one.excess", "one.left")
    same = (F.col("a.hub") == F.col("b.hub")) & (F.col("a.element") == F.col("b.element")) & (F.col("a.component") != F.col("b.component"))
    found = ones.alias("a").join(listed.alias("b"), same & _share_enough(settings))
    return found.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()


def _across(listed: DataFrame, settings: Settings) -> DataFrame:
    """Distinct pairs ``(u, v)`` of different components that share a listed element; pairs within one are never made."""
    # a component's rows of an element meet those of another one only if the best of both would do
    blocks = listed.groupBy("hub", "element", "component").agg(F.max("out").alias("out"), F.max("left").alias("left"), F.min("excess").alias("excess"))
    same = (F.col("a.hub") == F.col("b.hub")) & (F.col("a.element") == F.col("b.element")) & (F.col("a.component") < F.col("b.component"))
    meet = blocks.alias("a").join(blocks.alias("b"), same & _share_enough(settings)).select("a.hub", "a.element", "a.component", F.col("b.component").alias("other"))
    one = meet.join(listed, ["hub", "element", "component"]).alias("a")
    same = (F.col("a.hub") == F.col("b.hub")) & (F.col("a.element") == F.col("b.element")) & (F.col("a.other") == F.col("b.component"))
    found = one.join(listed.alias("b"), same & _share_enough(settings))
    return found.select(F.least("a.id", "b.id").alias("u"), F.greatest("a.id", "b.id").alias("v")).distinct()


def _joined_apart(labels: DataFrame, listed: DataFrame, sets: DataFrame, settings: Settings) -> DataFrame:
    """``labels`` after all links between ``listed`` rows. Where they would make many pairs, classes meet one class of an
    element at a time, as long as that links some: a group of near copies is one component then, and lists no pair."""
    turn = 0
    while True:
        rows, pairs = _crossing(listed)
        if pairs <= settings.pairs_a_row * rows:
            break
        links = _confirmed(_to_one(listed, turn, settings), sets, settings)
        if links.isEmpty():
            break
        labels = _contract(labels, links)
        now = listed.drop("component").join(listed.select("id", "component").distinct().join(labels.select(F.col("node").alias("id"), F.col("component").alias("low")), "id", "left").select("id", F.coalesce("low", "component").alias("component")), "id")
        several = now.groupBy("hub", "element").agg(F.min("component").alias("low"), F.max("component").alias("high")).where("low <> high").select("hub", "element")
        listed = stored(now.join(several, ["hub", "element"], "left_semi").select(listed.columns), "listed")
        turn += 1
    return _contract(labels, _confirmed(_across(listed, settings), sets, settings)) if pairs else labels


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """``(id, n_shingles, component_id, kept)``, one row per row of ``docs`` with an id."""
    settings = settings or Settings()
    texts = docs.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).cast("binary").alias("text")).where("id IS NOT NULL")
    signed = stored(
        texts.mapInArrow(_sign_rows(settings), "id bigint, n_shingles bigint, digest binary, sign array<smallint>, keys array<bigint>"), "signed"
    )
    filled = signed.where("n_shingles > 0")
    chosen = filled.groupBy("id").agg(F.min(F.struct("digest", "n_shingles")).alias("set"), F.count("*").alias("rows")).select("id", "set.digest", "set.n_shingles", "rows")
    chosen = stored(chosen, "chosen")
    classes = chosen.groupBy("digest", "n_shingles").agg(F.min("id").alias("class_id"), F.count("*").alias("copies"))
    # only classes of several ids are looked up again
    several = classes.where("copies > 1").select("digest", "n_shingles", "class_id")
    membership = stored(
        chosen.join(several, ["digest", "n_shingles"], "left").select("id", "digest", "rows", F.coalesce("class_id", "id").alias("class_id")), "classes"
    )
    # all rows but the few that don't stand for a class as they are stay where they were read
    special = stored(membership.where("id <> class_id OR rows > 1").select("id"), "special")
    repeated = stored(membership.where("id = class_id AND rows > 1").select("id", "digest"), "repeated")
    firsts = filled.join(special, "id", "left_anti").unionByName(filled.join(repeated, ["id", "digest"], "left_semi").dropDuplicates(["id"]))
    keyed = firsts.select("id", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("held")).where("held > 1")
    held = stored(keyed.join(shared, "key"), "keys")
    company = held.groupBy("id").agg(F.sum("held").alias("company"))
    held = stored(held.join(company, "id").select("key", "id", "held", "company"), "company")
    turn = F.row_number().over(Window.partitionBy("key").orderBy(F.desc("company"), "id"))
    hubs = stored(held.select("key", F.col("id").alias("hub"), turn.alias("turn")).where(F.col("turn") <= settings.rounds), "hubs")
    met = held.select("id").distinct()
    signs = stored(firsts.join(met, "id", "left_semi").select("id", "digest", "sign", "n_shingles"), "signs")
    placed = held.select("key", "id", F.col("id").alias("component"))
    # full sets are needed of classes close to a hub, and of those that meet other classes than the hubs under a key
    wanted = held.where(F.col("held") > settings.rounds + 1).select("id")
    close = []
    for turn in range(1, settings.rounds + 1):
        apart = held.select("key", "id").join(hubs.where(F.col("turn") == turn).select("key", "hub"), "key").where("id <> hub")
        pairs = apart.select(F.least("id", "hub").alias("u"), F.greatest("id", "hub").alias("v")).distinct()
        close.append(stored(_close(pairs, signs, settings), "close"))
        wanted = wanted.unionAll(close[-1].select("u")).unionAll(close[-1].select("v"))
    wanted = stored(signs.select("id", "digest").join(wanted.distinct(), "id", "left_semi"), "wanted")
    sets = texts.join(wanted.select("id"), "id", "left_semi").mapInArrow(_shingle_rows(settings.words), "id bigint, digest binary, shingles array<bigint>")
    sets = stored(sets.join(wanted, ["id", "digest"], "left_semi").dropDuplicates(["id"]).select("id", "shingles"), "sets")
    labels = None
    for turn, pairs in enumerate(close, 1):
        if labels is not None:
            pairs = _between(pairs, labels)
        labels = _contract(labels, _confirmed(pairs, sets, settings))
    placed = _open(placed, labels, settings.rounds + 1)
    labels = _joined_apart(labels, _left_apart(placed, hubs, sets, settings), sets, settings)
    final = membership.join(labels.select(F.col("node").alias("class_id"), "component"), "class_id", "left").select(
        "id", F.coalesce("component", "class_id").alias("component_id")
    )
    # signed holds a row per input row; ids without words belong to themselves
    result = signed.select("id", "n_shingles").join(final, "id", "left").select("id", "n_shingles", F.coalesce("component_id", "id").alias("component_id"))
    return result.withColumn("kept", F.col("id") == F.col("component_id"))


def _may_link(settings: Settings) -> Column:
    """Neither the sizes ``m, n`` nor the signatures ``a, b`` rule the pair out."""
    smaller, larger = F.least("m", "n"), F.greatest("m", "n")
    return (100 * smaller >= settings.percent * larger) & (differing(settings) <= settings.distance)


def _close(pairs: DataFrame, signs: DataFrame, settings: Settings) -> DataFrame:
    one = signs.select(F.col("id").alias("u"), F.col("sign").alias("a"), F.col("n_shingles").alias("m"))
    other = signs.select(F.col("id").alias("v"), F.col("sign").alias("b"), F.col("n_shingles").alias("n"))
    return pairs.join(one, "u").join(other, "v").where(_may_link(settings)).select("u", "v")


def _contract(labels: DataFrame | None, links: DataFrame) -> DataFrame:
    """``(node, component)`` after more links; a component found before is one node of the new graph."""
    if labels is None:
        return stored(components(links), "labels")
    raised = (
        links.join(labels.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left")
        .join(labels.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left")
        .select(F.coalesce("cu", "u").alias("u"), F.coalesce("cv", "v").alias("v"))
    )
    merged = components(raised)
    moved = labels.join(merged.select(F.col("node").alias("component"), F.col("component").alias("low")), "component", "left").select(
        "node", F.coalesce("low", "component").alias("component")
    )
    return stored(moved.unionAll(merged.join(labels.select("node"), "node", "left_anti").select("node", "component")), "labels")


def _between(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Pairs whose two classes aren't in one component yet."""
    told = pairs.join(labels.select(F.col("node").alias("u"), F.col("component").alias("cu")), "u", "left").join(
        labels.select(F.col("node").alias("v"), F.col("component").alias("cv")), "v", "left"
    )
    return told.where(F.coalesce("cu", "u") != F.coalesce("cv", "v")).select("u", "v")


def _open(placed: DataFrame, labels: DataFrame, compared: int) -> DataFrame:
    """Rows, with their components as they are now, of the keys that still hold several components. In a key of no more
    than ``compared`` classes the hubs have met everyone."""
    now = placed.select("key", "id").join(labels.select(F.col("node").alias("id"), "component"), "id", "left")
    now = now.select("key", "id", F.coalesce("component", "id").alias("component"))
    several = now.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high"), F.count("*").alias("n"))
    return stored(now.join(several.where((F.col("low") != F.col("high")) & (F.col("n") > compared)).select("key"), "key", "left_semi"), "open")
