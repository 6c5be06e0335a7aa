"""Repeated word windows, found with one FM-index per shard.

A window is ``window`` consecutive words of one document. A window whose words also start earlier (in a smaller id, or
earlier in the same document) is a repeat; every word a repeat covers is removed. Windows are judged on the input.

1. Anchors: every window is named by the smallest hash of its ``gram``-word runs, so equal windows have equal anchors.
   A document becomes runs of windows with one anchor, about one run per eight words. Only runs whose anchor
   occurs more than once go on; all others cannot hold a repeat.
2. Runs with equal words are collapsed: the first occurrence stands for them, all others consist of repeats. The
   count and the minimum are combined before the shuffle, so a passage that very many documents share is one row.
3. Shards: runs that differ but share an anchor are brought together. In a sorted partition, consecutive
   anchors fill a shard of about ``shard_words`` words, which gets an FM-index: a wavelet matrix over the
   transform of its words. All runs of the shard stream through it by backward search; windows whose match reaches the
   full length get the rows of the match, and of the windows with the same rows all but the first are repeats.
   An anchor with more than ``spread_runs`` different runs is dealt window by window, by the hash of the window.
4. The reported intervals are carried back to the documents.

Rules for unusual rows: a NULL text has no words; a document shorter than a window loses nothing. Rows with a NULL id
are left out, as no order is defined for them. Repeated rows (same id and text) are one document and answered alike;
rows that share only the id are ordered by a hash of their text. Other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordHashes, gram_hashes, mix, partitions, stored
from .fm_index import FMIndex


@dataclass(frozen=True)
class Settings:
    window: int = 20
    gram: int = 6
    shard_words: int = 300_000
    spread_runs: int = 2_000

    @property
    def grams(self) -> int:
        return self.window - self.gram + 1


def sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """Minimum of every ``width`` consecutive values, by doubling."""
    low, covered = values, 1
    while covered * 2 <= width:
        low = np.minimum(low[:-covered], low[covered:])
        covered *= 2
    rest = width - covered
    return np.minimum(low[: len(low) - rest], low[rest:]) if rest else low


def runs_of(hashes: np.ndarray, settings: Settings) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Anchor, first window, number of windows of each run, and whether its anchor occurs in it more than once."""
    if len(hashes) < settings.window:
        none = np.empty(0, np.int64)
        return none.astype(np.uint64), none, none, none.astype(bool)
    grams = gram_hashes(hashes, settings.gram)
    least = sliding_least(grams, settings.grams)
    starts = np.concatenate([[0], np.flatnonzero(least[1:] != least[:-1]) + 1])
    counts = np.diff(np.append(starts, len(least)))
    anchors = least[starts]
    again = np.zeros(len(starts), bool)
    ordered = np.sort(grams)
    twice = ordered[1:][ordered[1:] == ordered[:-1]]
    if len(twice):
        for i in np.flatnonzero(np.isin(anchors, twice)):
            held = grams[starts[i] : starts[i] + counts[i] + settings.grams - 1]
            again[i] = np.count_nonzero(held == anchors[i]) > 1
    return anchors, starts, counts, again


def _batch(columns: list, names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=names)


ANCHOR = "id bigint, version bigint, anchor bigint, start int, windows int, again boolean"


def _anchor_rows(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        kinds = [pa.int64()] * 3 + [pa.int32(), pa.int32(), pa.bool_()]
        for batch in batches:
            for offset in range(0, batch.num_rows, 1000):
                part = batch.slice(offset, 1000)
                out: list[list[np.ndarray]] = [[] for _ in kinds]
                for doc_id, version, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), strict=True):
                    words = (text.as_py() or b"").split()
                    if len(words) < settings.window:
                        continue
                    a, s, n, again = runs_of(known.of(words), settings)
                    row = [np.full(len(a), doc_id, np.int64), np.full(len(a), version, np.int64), a.view(np.int64), s.astype(np.int32), n.astype(np.int32), again]
                    for held, values in zip(out, row, strict=True):
                        held.append(values)
                if out[0]:
                    yield _batch([np.concatenate(x) for x in out], [c.split()[0] for c in ANCHOR.split(", ")], kinds)

    return run


RUN = "id bigint, version bigint, anchor bigint, h1 bigint, h2 bigint, start int, windows int, again boolean"


def _run_rows(settings: Settings):
    """Digests of the words of the wanted runs; their places are known from the first reading of the text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for offset in range(0, batch.num_rows, 500):
                part = batch.slice(offset, 500)
                digests, sizes = [], []
                for text, wanted in zip(part.column(2), part.column(3), strict=True):
                    hashes = known.of((text.as_py() or b"").split())
                    starts = wanted.values.field("start").to_numpy()
                    ends = starts + wanted.values.field("windows").to_numpy() + settings.window - 1
                    sizes.append(len(starts))
                    digests += [xxhash.xxh3_128_digest(hashes[s:e].data) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)]
                halves = np.frombuffer(b"".join(digests), ">i8").astype(np.int64).reshape(-1, 2)
                owner = np.repeat(np.arange(part.num_rows), sizes)
                flat = [part.column(c).to_numpy()[owner] for c in (0, 1)]
                runs = pa.concat_arrays([w.values for w in part.column(3)]) if len(owner) else None
                held = {c: runs.field(c) if runs is not None else [] for c in ("anchor", "start", "windows", "again")}
                columns = [*flat, held["anchor"], halves[:, 0], halves[:, 1], held["start"], held["windows"], held["again"]]
                yield _batch(columns, [c.split()[0] for c in RUN.split(", ")], [pa.int64()] * 5 + [pa.int32(), pa.int32(), pa.bool_()])

    return run


PAYLOAD = "key bigint, id bigint, version bigint, start int, words binary"


def _payload_rows(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = WordHashes()
        for batch in batches:
            for offset in range(0, batch.num_rows, 200):
                part = batch.slice(offset, 200)
                out = []
                for doc_id, version, text, runs in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), part.column(2), part.column(3).to_pylist(), strict=True):
                    hashes = known.of((text.as_py() or b"").split())
                    for r in runs:
                        s, n = r["start"], r["windows"]
                        if r["different"] <= settings.spread_runs:
                            out.append((r["anchor"], doc_id, version, s, hashes[s : s + n + settings.window - 1].tobytes()))
                        else:
                            for at in range(s, s + n):
                                held = hashes[at : at + settings.window].tobytes()
                                out.append((xxhash.xxh3_64_intdigest(held) - 2**63, doc_id, version, at, held))
                columns = list(zip(*out, strict=True)) or [[]] * 5
                yield _batch(columns, ["key", "id", "version", "start", "words"], [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.binary()])

    return run


def repeats_in_shard(ids: np.ndarray, versions: np.ndarray, starts: np.ndarray, runs: list[np.ndarray], window: int) -> tuple[np.ndarray, ...]:
    """``(id, version, start)`` of the windows in ``runs`` that also start earlier in the shard."""
    flat = np.concatenate([np.append(r, np.uint64(0)) for r in runs])
    inside = np.ones(len(flat), bool)
    lengths = np.array([len(r) + 1 for r in runs])
    inside[np.cumsum(lengths) - 1] = False
    text = np.empty(len(flat), np.int64)
    _, numbers = np.unique(flat[inside], return_inverse=True)
    text[inside] = numbers + 2
    text[~inside] = 1  # between runs; no window holds it
    index = FMIndex(text, window)
    owner = np.repeat(np.arange(len(runs)), lengths)
    at = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ends = np.flatnonzero((at >= window) & (at <= np.repeat(lengths - 1, lengths)))
    matched, low, _ = index.matches(text, ends, window, least=2)
    full = matched >= window
    ends, low = ends[full], low[full]
    who = owner[ends]
    begin = starts[who] + at[ends] - window
    order = np.lexsort((begin, versions[who], ids[who], low))
    low, who, begin = low[order], who[order], begin[order]
    leads = np.concatenate([[True], low[1:] != low[:-1]]) if len(low) else np.empty(0, bool)
    lead = np.maximum.accumulate(np.where(leads, np.arange(len(low)), 0))
    later = (ids[who] != ids[who[lead]]) | (versions[who] != versions[who[lead]]) | (begin != begin[lead])
    return ids[who][later], versions[who][later], begin[later]


def _shards(settings: Settings):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        words = 0

        def flush() -> pa.RecordBatch:
            ids, versions, starts, runs = zip(*rows, strict=True)
            found = repeats_in_shard(np.array(ids), np.array(versions), np.array(starts), list(runs), settings.window)
            return _batch([*found, np.full(len(found[0]), settings.window)], ["id", "version", "start", "words"], [pa.int64(), pa.int64(), pa.int32(), pa.int32()])

        last = None
        for batch in batches:
            for key, doc_id, version, start, held in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if words >= settings.shard_words and key != last:
                    yield flush()
                    rows, words = [], 0
                values = np.frombuffer(held, np.uint64)
                rows.append((doc_id, version, start, values))
                words += len(values) + 1
                last = key
        if rows:
            yield flush()

    return run


def version_of(text_col: str = "text"):
    return F.xxhash64(F.col(text_col).cast("binary"))


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.col(text_col).cast("binary")
    return docs.select(F.col(id_col).cast("bigint").alias("id"), version_of(text_col).alias("version"), text.alias("text")).where("id IS NOT NULL")


def repeated_intervals(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """``(id, version, start, words)``: stretches of words covered by repeats; stretches may overlap."""
    settings = settings or Settings()
    texts = _texts(docs, id_col, text_col)
    anchors = stored(texts.mapInArrow(_anchor_rows(settings), ANCHOR), "anchors")
    # a run that holds its anchor twice meets itself
    again = anchors.groupBy("anchor").agg(F.count("*").alias("n"), F.max("again").alias("inner")).where("n > 1 OR inner").select("anchor")
    place = F.struct("anchor", "start", "windows", "again")
    wanted = stored(anchors.join(again, "anchor", "left_semi").groupBy("id", "version").agg(F.collect_set(place).alias("runs")), "wanted")
    runs = stored(texts.join(wanted, ["id", "version"]).select("id", "version", "text", "runs").mapInArrow(_run_rows(settings), RUN), "runs")
    content = ["anchor", "h1", "h2"]
    firsts = stored(
        runs.groupBy(*content).agg(
            F.min(F.struct("id", "version", "start")).alias("first"), F.count("*").alias("times"), F.max("windows").alias("windows"), F.max("again").alias("again")
        ),
        "firsts",
    )
    copies = firsts.where("times > 1").select(*content, "first")
    whole = runs.join(copies, content).where(F.struct("id", "version", "start") != F.col("first")).select("id", "version", "start", (F.col("windows") + settings.window - 1).alias("words"))
    met = firsts.groupBy("anchor").agg(F.count("*").alias("different"), F.max("again").alias("inner")).where("different > 1 OR inner").select("anchor", "different")
    needed = firsts.join(met, "anchor").groupBy("first.id", "first.version").agg(F.collect_list(F.struct("anchor", F.col("first.start").alias("start"), "windows", "different")).alias("runs"))
    payload = texts.join(needed, ["id", "version"]).select("id", "version", "text", "runs").mapInArrow(_payload_rows(settings), PAYLOAD)
    payload = payload.repartition(partitions(docs.sparkSession), "key").sortWithinPartitions("key")
    searched = payload.select("key", "id", "version", "start", "words").mapInArrow(_shards(settings), "id bigint, version bigint, start int, words int")
    return stored(whole.unionAll(searched), "intervals")


def _keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for offset in range(0, batch.num_rows, 500):
            part = batch.slice(offset, 500)
            totals, removed, kept = [], [], []
            for text, spans in zip(part.column(2), part.column(3), strict=True):
                words = (text.as_py() or b"").split()
                gone = np.zeros(len(words) + 1, np.int32)
                if spans.is_valid:
                    flat = spans.values
                    starts = flat.field("start").to_numpy()
                    np.add.at(gone, starts, 1)
                    np.add.at(gone, starts + flat.field("words").to_numpy(), -1)
                covered = np.cumsum(gone[:-1]) > 0
                totals.append(len(words))
                removed.append(int(covered.sum()))
                kept.append(b" ".join([w for w, c in zip(words, covered.tolist(), strict=True) if not c]) if removed[-1] else b" ".join(words))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(1), pa.array(totals, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string())],
                names=["id", "version", "n_words", "n_removed", "kept"],
            )


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", settings: Settings | None = None) -> DataFrame:
    """``(id, version, n_words, n_removed, kept)``, one row per row with an id: ``kept`` joins the words left by one
    space, ``version`` is the hash of the text that tells apart rows with one id."""
    intervals = repeated_intervals(docs, id_col, text_col, settings)
    spans = intervals.groupBy("id", "version").agg(F.collect_list(F.struct("start", "words")).alias("spans"))
    joined = _texts(docs, id_col, text_col).join(spans, ["id", "version"], "left").select("id", "version", "text", "spans")
    return joined.mapInArrow(_keep, "id bigint, version bigint, n_words bigint, n_removed bigint, kept string")
