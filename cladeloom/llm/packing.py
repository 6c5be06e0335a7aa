"""Packing token pieces into as few fixed-length sequences as possible with a grouping genetic algorithm.

A solution is a set of bins. Crossover copies well-filled bins of one parent into the other, empties the bins that
hold the same pieces, and puts the displaced pieces back by best fit, largest first. Mutation empties some of the
least filled bins. Solutions are ranked by the number of bins, then by the sum of squared fills.

Pieces are dealt by a hash into blocks of about ``block_pieces``, or of more if they are so short that a block would fill
fewer than ``block_bins`` sequences (at most ``1.5 * block_bins * capacity`` pieces then). Every block is evolved on several islands, a row per
(block, island); after each epoch an island gets the elite of the next island of its block by a join. The
emptiest bins of all blocks are then dissolved, their pieces dealt into at most half as many blocks and evolved again,
until one block is left, so a block's own remainder isn't lost. Pieces that fill a sequence alone take no part in this.

Rules for unusual rows: a NULL text is an empty document, one end token. Repeated rows, and rows with a NULL id, are
documents of their own. Only documents longer than a sequence are cut. An empty table packs into nothing.
Other columns are never read.
"""

from __future__ import annotations

import random
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered, stored, union

#: White-space-separated chunks, and words in them, whose ids one Python worker keeps in each generation.
CHUNKS_KEPT = 400_000
WORDS_KEPT = 400_000
PIECE = "uid bigint, doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@dataclass(frozen=True)
class Settings:
    capacity: int = 4096
    block_pieces: int = 2048
    block_bins: int = 32  # a block fills at least so many sequences, if there are several blocks
    islands: int = 2
    epochs: int = 2
    generations: int = 12  # in each epoch
    population: int = 6
    elites: int = 3  # solutions an island hands on
    dissolved: float = 0.04  # share of a block's bins, the emptiest, that meet those of other blocks
    seed: int = 17


#: A chunk that is one run of Latin letters and perhaps one of other signs: two words of the vocabulary's split pattern.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([!\"#$%&()*+,\-./:;<=>?@\[\\\]^_`{|}~]*)")


def byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies show for each byte: itself if it is printable, else one from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class ChunkIds:
    """Little-endian 32-bit ids of a text. Neither the normaliser nor a pattern or an added token of the vocabulary
    reaches across ASCII white space, so the ids of a text are those of its chunks in a row."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = byte_letters()
        self.words = Remembered(WORDS_KEPT, self._word)
        self.chunks = Remembered(CHUNKS_KEPT, self._chunk)

    def _word(self, word: str) -> bytes:
        """A lower-case run of Latin letters, or of signs: the model's own step, after the byte-level spelling."""
        spelled = word if word.isascii() else word.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(spelled)])

    def _chunk(self, chunk: bytes) -> bytes:
        text = chunk.decode()
        plain = PLAIN.fullmatch(text)
        if plain and "<|" not in text:
            word, signs = plain.groups()
            return self.words[word.lower()] + (self.words[signs] if signs else b"")
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def of(self, text: bytes | None) -> bytes:
        return b"".join(map(self.chunks.__getitem__, text.split())) if text else b""


def _cut(path: str, end_id: int, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = ChunkIds(path), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                tokens = ids.of(text.as_py()) + end
                for at in range(0, len(tokens), 4 * capacity):
                    part = tokens[at : at + 4 * capacity]
                    out.append((doc_id, at // (4 * capacity), at // 4, len(part) // 4, zlib.crc32(part)))
            columns = list(zip(*out, strict=True)) or [[]] * 5
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces_of(docs: DataFrame, tokenizer_path: str, end_id: int = 1, capacity: int = 4096, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Token pieces of every document, with a number ``uid`` of their own, stored once."""
    rows = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("binary").alias("text"))
    cut = rows.mapInArrow(_cut(tokenizer_path, end_id, capacity), PIECE.removeprefix("uid bigint, "))
    return stored(cut.select(F.monotonically_increasing_id().alias("uid"), "*"), "pieces")


class Bins(list):
    """Lists of piece numbers, and the fill of each. Lists are shared by the solutions that hold them and are never changed."""

    def __init__(self, bins: list[list[int]], fills: list[int]):
        super().__init__(bins)
        self.fills = fills


class Block:
    """The pieces of one block, longest first, and solutions over them."""

    def __init__(self, lengths: list[int], settings: Settings, seed: int):
        self.lengths, self.settings, self.draw = lengths, settings, random.Random(seed)
        self.least = -(-sum(lengths) // settings.capacity)

    def fill(self, bins: list[list[int]]) -> list[int]:
        lengths = self.lengths
        return bins.fills if isinstance(bins, Bins) else [sum([lengths[i] for i in b]) for b in bins]

    def cost(self, bins: list[list[int]]) -> tuple[int, float]:
        return len(bins), -sum([x * x for x in self.fill(bins)]) / self.settings.capacity**2

    def place(self, bins: Bins, pieces: list[int]) -> Bins:
        """Best fit, longest first: each piece goes to the fullest bin that still takes it."""
        capacity, lengths, fills = self.settings.capacity, self.lengths, bins.fills
        room = sorted([(capacity - used, at) for at, used in enumerate(fills)])
        for i in sorted(pieces):  # piece numbers are in order of length
            at = bisect_left(room, (lengths[i], -1))
            if at == len(room):
                bins.append([i])
                fills.append(lengths[i])
                insort(room, (capacity - lengths[i], len(bins) - 1))
            else:
                free, where = room.pop(at)
                bins[where] = [*bins[where], i]
                fills[where] += lengths[i]
                insort(room, (free - lengths[i], where))
        return bins

    def first(self, noise: float) -> Bins:
        """Best fit decreasing; with noise, some pieces come out of turn."""
        late = [i for i in range(len(self.lengths)) if noise and self.draw.random() < noise]
        chosen = set(late)
        return self.place(self.place(Bins([], []), [i for i in range(len(self.lengths)) if i not in chosen]), late)

    def cross(self, base: list[list[int]], giver: list[list[int]]) -> Bins:
        fills = self.fill(giver)
        order = sorted(range(len(giver)), key=fills.__getitem__, reverse=True)
        order = order[: max(1, len(order) // 2)]
        taken = self.draw.sample(order, max(1, len(order) // 2))
        injected = {i for at in taken for i in giver[at]}
        stay = [at for at, b in enumerate(base) if injected.isdisjoint(b)]
        kept = set(stay)
        displaced = [i for at, b in enumerate(base) if at not in kept for i in b if i not in injected]
        own = self.fill(base)
        return self.place(Bins([giver[at] for at in taken] + [base[at] for at in stay], [fills[at] for at in taken] + [own[at] for at in stay]), displaced)

    def mutate(self, bins: list[list[int]]) -> Bins:
        fills = self.fill(bins)
        order = sorted(range(len(bins)), key=lambda i: fills[i] * self.draw.uniform(0.9, 1.0))
        gone = set(order[: max(2, len(bins) // 20)])
        stay = [i for i in range(len(bins)) if i not in gone]
        return self.place(Bins([bins[i] for i in stay], [fills[i] for i in stay]), [i for g in gone for i in bins[g]])

    def evolve(self, start: list[list[list[int]]]) -> list[Bins]:
        size = self.settings.population
        solutions = [Bins(s, self.fill(s)) for s in start] + [self.first(0.0 if not start and n == 0 else 0.1) for n in range(size - len(start))]
        ranked = sorted(((self.cost(s), n, s) for n, s in enumerate(solutions)), key=lambda x: x[:2])
        count = len(ranked)
        for _ in range(self.settings.generations):
            if ranked[0][0][0] <= self.least:
                break
            children = []
            for _ in range(size // 2):
                base, giver = self.draw.sample(ranked, 2) if len(ranked) > 1 else (ranked[0], ranked[0])
                child = self.cross(base[2], giver[2])
                children += [child, self.mutate(min(base, giver)[2])]
            for child in children:
                ranked.append((self.cost(child), count, child))
                count += 1
            ranked = sorted(ranked, key=lambda x: x[:2])[:size]
        return [s for _, _, s in ranked[: self.settings.elites]]


def _as_bins(where: list[int]) -> list[list[int]]:
    bins: list[list[int]] = [[] for _ in range(max(where, default=-1) + 1)]
    for i, b in enumerate(where):
        bins[b].append(i)
    return [b for b in bins if b]


def _evolve_rows(settings: Settings, epoch: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, island, lengths, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                block = Block(lengths, settings, hash((settings.seed, epoch, number, island)))
                found = block.evolve([_as_bins(x) for x in start or []])
                arrays = []
                for bins in found:
                    where = [0] * len(lengths)
                    for b, held in enumerate(bins):
                        for i in held:
                            where[i] = b
                    arrays.append(where)
                bins, squares = block.cost(found[0])
                yield pa.RecordBatch.from_arrays(
                    [pa.array([number], pa.int64()), pa.array([island], pa.int32()), pa.array([arrays], pa.list_(pa.list_(pa.int32()))), pa.array([bins], pa.int64()), pa.array([squares], pa.float64())],
                    names=["block", "island", "found", "bins", "squares"],
                )

    return run


def _lay_out(settings: Settings, level: int, last: bool):
    """Rows of pieces with their sequence and offset; ``loose`` marks those of the emptiest bins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, uids, lengths, where in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bins = _as_bins(where)
                fill = [sum(lengths[i] for i in b) for b in bins]
                loose = set() if last else set(sorted(range(len(bins)), key=fill.__getitem__)[: max(1, int(len(bins) * settings.dissolved))])
                out = []
                for b, held in enumerate(bins):
                    offset = 0
                    for i in held:
                        out.append((uids[i], (level << 56) | (number << 24) | b, offset, b in loose))
                        offset += lengths[i]
                columns = zip(*out, strict=True)
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.bool_()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["uid", "sequence_id", "offset", "loose"])

    return run


def block_count(count: int, tokens: int, settings: Settings, before: int | None = None) -> int:
    """Blocks for ``count`` pieces of ``tokens`` in all: each many pieces and many sequences, so that the share of a
    block's sequences that is dissolved stays small; at most half as many as ``before``, so that rounds end."""
    blocks = min(round(count / settings.block_pieces), round(tokens / (settings.block_bins * settings.capacity)))
    return max(1, blocks if before is None else min(blocks, before // 2))


def _level(pieces: DataFrame, blocks: int, level: int, settings: Settings) -> DataFrame:
    """Places of ``pieces(uid, length)`` after one round over all blocks; nothing is loose after a round over one."""
    # sort_array orders by length, then number: both are reversed for longest first
    dealt = pieces.groupBy(F.pmod(F.xxhash64("uid", F.lit(level)), F.lit(blocks)).alias("block")).agg(F.sort_array(F.collect_list(F.struct("length", "uid")), asc=False).alias("held"))
    dealt = stored(dealt.select("block", F.col("held.uid").alias("uids"), F.col("held.length").alias("lengths")), "blocks")
    islands = dealt.select("block", F.explode(F.sequence(F.lit(0), F.lit(settings.islands - 1))).alias("island"), "lengths")
    state = None
    for epoch in range(settings.epochs):
        if state is None:
            rows = islands.select("block", "island", "lengths", F.lit(None).cast("array<array<int>>").alias("start"))
        else:
            came = state.select("block", F.pmod(F.col("island") - 1, F.lit(settings.islands)).alias("island"), F.slice("found", 1, 1).alias("elite"))
            own = state.select("block", "island", "found")
            rows = islands.join(own, ["block", "island"]).join(came, ["block", "island"]).select("block", "island", "lengths", F.concat("elite", "found").alias("start"))
        rows = rows.repartition(blocks * settings.islands, "block", "island")
        state = stored(rows.mapInArrow(_evolve_rows(settings, epoch), "block bigint, island int, found array<array<int>>, bins bigint, squares double"), "islands")
    best = state.groupBy("block").agg(F.min_by("found", F.struct("bins", "squares", "island"))[0].alias("places"))
    chosen = dealt.join(best, "block").select("block", "uids", "lengths", "places")
    return stored(chosen.mapInArrow(_lay_out(settings, level, blocks == 1), "uid bigint, sequence_id bigint, offset bigint, loose boolean"), "places")


def pack(pieces: DataFrame, settings: Settings | None = None) -> DataFrame:
    """``pieces`` (columns of :data:`PIECE`) with ``sequence_id`` and ``offset``."""
    settings = settings or Settings()
    if max(settings.block_pieces, settings.block_bins * settings.capacity) * 2 > 1 << 24:
        raise ValueError("a block may hold 8 million pieces at most")
    full = pieces.where(F.col("length") == settings.capacity)
    placed = [full.select("uid", (-F.col("uid") - 1).alias("sequence_id"), F.lit(0).cast("bigint").alias("offset"))]
    rest = pieces.where(F.col("length") < settings.capacity).select("uid", "length")
    level, blocks = 0, None
    while blocks != 1:
        left = rest.agg(F.count(F.lit(1)).alias("count"), F.sum("length").alias("tokens")).first()
        if left["count"] == 0:
            break
        blocks = block_count(left["count"], left["tokens"], settings, blocks)
        places = _level(rest, blocks, level, settings)
        placed.append(places.where(~F.col("loose")).select("uid", "sequence_id", "offset"))
        rest = pieces.select("uid", "length").join(places.where("loose").select("uid"), "uid", "left_semi")
        level += 1
    return pieces.join(union(placed), "uid")
