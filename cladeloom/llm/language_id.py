"""Language identification by words first, then by progressively shorter character n-grams.

A known word adds the logarithm of its smoothed frequency in each language. A word that training never kept is
scored by the longest of its n-grams (ends of the word are marked) that are known in any language, and by shorter
ones only if no longer one is. The language with the largest sum wins; the score is its share of the posterior
under equal priors.

Rules for unusual rows: a NULL text, or one without a letter, gets ``und`` and score 0. Equal sums go to the language
that sorts first. Repeated rows get equal answers. With no labelled row nothing is learned, and every row gets
``und``. Other columns pass through; they are never read.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Remembered, stored

UNDETERMINED = "und"
WORD = re.compile(r"[^\W\d_]+")
#: Additive smoothing of word and n-gram counts.
SMOOTHING = 0.5
#: Words that one Python worker remembers in each generation; logarithms of backed-off ones are divided by the languages.
REMEMBERED = 200_000
#: Seed with which Spark's ``xxhash64`` starts.
HASH_SEED = 42


@dataclass(frozen=True)
class Bounds:
    """What limits training; prediction always covers every row, and all words and n-grams of the sample are kept."""

    documents_per_language: int = 8_000  # about so many labelled rows of each language, chosen by a hash of the id
    longest_ngram: int = 5


class Table:
    """Counts of keys by language as sorted 64-bit hashes and three flat arrays; no key is held as text.

    A key adds its logarithm in each language: that of a key the language lacks, plus a difference for languages that have it.
    """

    def __init__(self, hashes: np.ndarray, lang: np.ndarray, counts: np.ndarray, languages: int):
        order = np.lexsort((lang, hashes))
        hashes, self.lang, counts = hashes[order], lang[order].astype(np.int32), counts[order]
        self.keys, starts = np.unique(hashes, return_index=True)
        self.starts = np.append(starts, len(hashes)).astype(np.int64)
        total = np.bincount(self.lang, weights=counts, minlength=languages) + SMOOTHING * max(1, len(self.keys))
        self.least = np.log(SMOOTHING / total)
        self.more = np.log((counts + SMOOTHING) / SMOOTHING).astype(np.float32)

    def find(self, key: str) -> int:
        """Row of a key, or -1."""
        value = np.uint64(xxhash.xxh64_intdigest(key.encode(), HASH_SEED)).view(np.int64)
        at = int(np.searchsorted(self.keys, value))
        return at if at < len(self.keys) and self.keys[at] == value else -1

    def sums(self, rows: np.ndarray, times: np.ndarray) -> np.ndarray:
        """Sum over the rows of ``times`` their logarithms, one number per language."""
        sizes = self.starts[rows + 1] - self.starts[rows]
        ends = np.cumsum(sizes)
        at = np.arange(ends[-1]) - np.repeat(ends - sizes, sizes) + np.repeat(self.starts[rows], sizes)
        return self.least * times.sum() + np.bincount(self.lang[at], weights=self.more[at] * np.repeat(times, sizes), minlength=len(self.least))


@dataclass
class Model:
    languages: list[str]
    words: Table | None
    ngrams: Table | None
    longest: int


def split_words(text: str) -> Iterator[str]:
    """Maximal runs of letters, in lower case."""
    for word in WORD.findall(text.lower()):
        if word.isalpha():
            yield word
        else:  # a numeral such as a fraction counts as a word character, but is no letter
            yield from "".join(c if c.isalpha() else " " for c in word).split()


def ngrams_of(word: str, length: int) -> list[str]:
    marked = f"^{word}$"
    return [marked[i : i + length] for i in range(len(marked) - length + 1)]


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        seen: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            seen.setdefault(lang, Counter()).update(split_words(text))
        rows = [(lang, word, n) for lang, counts in seen.items() for word, n in counts.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.string()), pa.array([r[2] for r in rows], pa.int64())],
            names=["lang", "word", "n"],
        )


def _table(counts: DataFrame, key: str, languages: list[str]) -> Table:
    """Hashes and counts come to the driver as numbers, 20 bytes for each word or n-gram of the sample and language."""
    index = F.array_position(F.array(*[F.lit(x) for x in languages]), F.col("lang")).cast("int") - 1
    found = counts.select(F.xxhash64(key).alias("h"), index.alias("lang"), "n").toArrow()
    numbers = [found.column(c).to_numpy() for c in ("h", "lang", "n")]
    return Table(numbers[0], numbers[1], numbers[2].astype(np.float64), len(languages))


def train(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", bounds: Bounds | None = None) -> Model:
    """Fit on a bounded sample of the labelled ``rows`` (:class:`Bounds`), spread over the languages."""
    bounds = bounds or Bounds()
    labelled = rows.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang")).where("lang IS NOT NULL AND text IS NOT NULL")
    sizes = labelled.groupBy("lang").count().collect()
    if not sizes:
        return Model([], None, None, bounds.longest_ngram)
    scale = 1 << 30
    kept = F.create_map(*[F.lit(x) for r in sizes for x in (r["lang"], min(scale, bounds.documents_per_language * scale // r["count"]))])
    chosen = labelled.where(F.pmod(F.xxhash64("id", F.lit("fit")), F.lit(scale)) < F.element_at(kept, F.col("lang")))
    counts = chosen.select("lang", "text").mapInArrow(_count_words, "lang string, word string, n bigint").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = stored(counts, "words")
    languages = sorted(r["lang"] for r in counts.select("lang").distinct().collect())
    if not languages:
        return Model([], None, None, bounds.longest_ngram)
    marked = F.concat(F.lit("^"), "word", F.lit("$"))
    parts = [_parts(marked, n) for n in range(1, bounds.longest_ngram + 1)]
    grams = counts.select("lang", "n", F.explode(F.concat(*parts)).alias("gram")).groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    return Model(languages, _table(counts, "word", languages), _table(grams, "gram", languages), bounds.longest_ngram)


def _parts(marked: Column, length: int) -> Column:
    """All n-grams of one length of a marked word."""
    places = F.sequence(F.lit(1), F.length(marked) - length + 1)
    return F.when(F.length(marked) >= length, F.transform(places, lambda i: marked.substr(i, F.lit(length)))).otherwise(F.array().cast("array<string>"))


class Scorer:
    """Scores texts; remembers the row of each word, or the logarithms of a word it backed off for."""

    def __init__(self, model: Model):
        self.model = model
        self.rows = Remembered(REMEMBERED, self._row)
        self.backed_off = Remembered(max(1, REMEMBERED // max(1, len(model.languages))), self.unseen)

    def _row(self, word: str) -> int:
        return self.model.words.find(word)

    def unseen(self, word: str) -> np.ndarray:
        """Mean logarithms of the longest n-grams of a word that are known."""
        table = self.model.ngrams
        for length in range(min(self.model.longest, len(word) + 2), 0, -1):
            rows = np.array([r for r in map(table.find, ngrams_of(word, length)) if r >= 0], np.int64)
            if len(rows):
                return table.sums(rows, np.full(len(rows), 1 / len(rows)))
        return np.zeros(len(self.model.languages))

    def score(self, text: str | None) -> tuple[str, float]:
        model = self.model
        counts = Counter(split_words(text)) if text else None
        if not counts or not model.languages:
            return UNDETERMINED, 0.0
        rows = np.fromiter(map(self.rows.__getitem__, counts), np.int64, len(counts))
        times = np.fromiter(counts.values(), np.float64, len(counts))
        known = rows >= 0
        sums = model.words.sums(rows[known], times[known]) if known.any() else np.zeros(len(model.languages))
        if not known.all():
            for word, row, n in zip(counts, rows.tolist(), counts.values(), strict=True):
                if row < 0:
                    sums += n * self.backed_off[word]
        best = int(np.argmax(sums))
        return model.languages[best], float(1.0 / np.exp(sums - sums[best]).sum())


def language_of(docs: DataFrame, model: Model, text_col: str = "text") -> Column:
    """Column ``struct<lang_pred string, score double>`` for the whole text of each row.

    The model goes to the executors once, as a few arrays; :class:`Bounds` limits the sample that they count.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kept: list[Scorer] = []

    def predict(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        if not kept:
            kept.append(Scorer(shared.value))
        for batch in texts:
            found = [kept[0].score(text) for text in batch]
            yield pd.DataFrame({"lang_pred": [x[0] for x in found], "score": [x[1] for x in found]})

    return F.pandas_udf(predict, "lang_pred string, score double")(F.col(text_col))
