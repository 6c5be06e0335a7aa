"""Encoding with a SentencePiece BPE model that keeps, for every piece, the bytes of the original text it stands for.

Normalisation reads the text from left to right: at each place the longest key of the compiled character map (a
double-array trie) is replaced by its value; without a match one character is copied. Every normalised character
records where its source begins and ends. A white-space mark is put in front, spaces become marks. Pairs are
then merged by score, leftmost first; characters without a piece become byte pieces. Piece boundaries are projected
through the recorded alignment to byte spans of the original text; of the byte pieces of one character, the last one
spans it and the others are empty, as the library reports them.

Merges never cross a place that no piece spans (before a run of marks, around a line feed, between two characters
that no piece holds in a row), so the text between such places is encoded once and remembered.

Rules for unusual rows: a NULL or empty text has no pieces, only the end id. A text may be as long as a row may be.
Repeated rows are encoded alike. Other columns pass through, but for one that has the name of the result, which is replaced.
Decoding goes from ids to text alone: pieces, byte pieces and control ids, whatever their order.
"""

from __future__ import annotations

import heapq
import re
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from itertools import repeat
from operator import add

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Remembered

MARK = "▁"
#: Chunks whose pieces one Python worker keeps in each generation of its cache.
CHUNKS_KEPT = 400_000
#: Characters up to which rescanning all offers is quicker than a queue.
SHORT = 48
#: Letters and the stops behind them: a word and its stop are remembered apart, if no piece holds both in a row.
LETTERS, STOPS = "a-zA-Z\u00c0-\u024f", ".,;:!?"
#: Texts whose pieces are held at once.
TEXTS_HELD = 200
# kinds of a piece in the public model format
UNKNOWN, CONTROL, USER_DEFINED, BYTE = 2, 3, 4, 6
BPE = 2


class CharacterMap:
    """The compiled map: 4 bytes with the size of the trie, the trie's 32-bit units, then zero-ended values."""

    def __init__(self, blob: bytes):
        size = int.from_bytes(blob[:4], "little")
        self.units = np.frombuffer(blob[4 : 4 + size], "<u4").tolist()
        self.values = blob[4 + size :]

    def longest(self, text: bytes, start: int) -> tuple[int, str] | None:
        """Length of the longest key at ``start`` and its value."""
        units, found = self.units, None
        at = _offset(units[0])
        for i in range(start, len(text)):
            at ^= text[i]
            unit = units[at]
            if unit & 0x800000FF != text[i]:
                break
            at ^= _offset(unit)
            if unit >> 8 & 1:
                found = i + 1 - start, units[at] & 0x7FFFFFFF
        if found is None:
            return None
        end = self.values.index(b"\0", found[1])
        return found[0], self.values[found[1] : end].decode()


def _offset(unit: int) -> int:
    return unit >> 10 << ((unit & 1 << 9) >> 6)


@dataclass(frozen=True)
class Rules:
    dummy_prefix: bool
    squeeze: bool  # leading, trailing and repeated spaces go
    escape: bool
    map: CharacterMap | None


def normalise(text: str, rules: Rules) -> tuple[str, np.ndarray]:
    """Normalised text and ``len + 1`` byte offsets: the source of character i begins at offset i; the source of
    a stretch ends where that of the next character begins."""
    if not text:
        return "", np.zeros(1, np.int64)
    if rules.map is None and not rules.squeeze:
        mark = MARK if rules.escape else " "
        body = text.replace(" ", mark) if rules.escape else text
        raw = np.frombuffer(text.encode(), np.uint8)
        begins = np.append(np.flatnonzero((raw & 0xC0) != 0x80), len(raw))
        return (mark + body, np.concatenate([[0], begins])) if rules.dummy_prefix else (body, begins)
    raw, at = text.encode(), 0
    parts: list[tuple[str, int, int]] = []
    while at < len(raw):
        found = rules.map.longest(raw, at) if rules.map else None
        if found is None:
            width = 1 if raw[at] < 0x80 else 2 if raw[at] < 0xE0 else 3 if raw[at] < 0xF0 else 4
            found = width, raw[at : at + width].decode()
        parts.append((found[1], at, at + found[0]))
        at += found[0]
    mark = MARK if rules.escape else " "
    if rules.squeeze:
        first = next((i for i, p in enumerate(parts) if p[0] != " "), len(parts))
        parts = parts[first:]
        if not parts:
            return "", np.zeros(1, np.int64)
    out, begins = [], []
    if rules.dummy_prefix:
        out.append(mark)
        begins.append(parts[0][1])
    end, spaced = parts[0][1], rules.squeeze
    for value, begin, stop in parts:
        if rules.squeeze and spaced:
            value = value.lstrip(" ")
        for c in value:
            out.append(mark if c == " " else c)
            begins.append(begin)
        if value:
            spaced = value.endswith(" ")
            end = stop
        if not rules.squeeze:
            spaced = False
    if rules.squeeze:
        while out and out[-1] == mark:
            out.pop()
            end = begins.pop()
    return "".join(out), np.array([*begins, end], np.int64)


class Encoder:
    """Chunk to pieces, remembered: ids and the characters that each piece spans."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as schema

        model = schema.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        if model.trainer_spec.model_type != BPE or model.trainer_spec.treat_whitespace_as_suffix:
            raise ValueError("only BPE models with the mark in front of a word are supported")
        if any(p.type == USER_DEFINED for p in model.pieces):
            raise ValueError("models with user-defined pieces are not supported")
        spec = model.normalizer_spec
        charsmap = CharacterMap(spec.precompiled_charsmap) if spec.precompiled_charsmap else None
        self.rules = Rules(spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces, charsmap)
        self.end_id = model.trainer_spec.eos_id
        special = (UNKNOWN, CONTROL, BYTE)
        self.ids = {p.piece: i for i, p in enumerate(model.pieces) if p.type not in special}
        self.scores = {p.piece: p.score for p in model.pieces if p.type not in special}
        self.bytes = {int(p.piece[3:5], 16): i for i, p in enumerate(model.pieces) if p.type == BYTE}
        self.unknown = next(i for i, p in enumerate(model.pieces) if p.type == UNKNOWN)
        if len(self.bytes) < 256:
            raise ValueError("only models with a piece for every byte are supported")
        joined = [p for p in self.ids if len(p) > 1]
        whole = any(MARK in p.lstrip(MARK) for p in joined) or any("\n" in p for p in joined)
        if max(map(len, self.ids)) > 255:
            raise ValueError("only models with pieces of at most 255 characters are supported")
        self.pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        bound = {p[1] for p in self.pairs if re.match(f"[{LETTERS}]", p)}
        stops = "".join(c for c in STOPS if c not in bound)
        word = f"{MARK}*+[{LETTERS}]++(?=[{stops}])|" if stops else ""
        self.chunks = re.compile(r"(?s).+") if whole else re.compile(f"{word}{MARK}*[^{MARK}\n]+|{MARK}+|\n")
        self.known, self.parts = Remembered(CHUNKS_KEPT, self.chunk), Remembered(CHUNKS_KEPT, self.part)
        # what each id stands for: nothing, a text, or one byte of a character
        self.byte_of = np.full(len(model.pieces), -1, np.int16)
        self.byte_of[list(self.bytes.values())] = list(self.bytes)
        shown = {UNKNOWN: lambda p: model.trainer_spec.unk_surface, CONTROL: lambda p: "", BYTE: lambda p: ""}
        self.texts = [shown.get(p.type, lambda p: p.piece.replace(MARK, " "))(p) for p in model.pieces]

    def merge(self, chunk: str) -> list[str]:
        """Symbols after all merges, best score first, the leftmost of equal ones."""
        if len(chunk) > SHORT:
            return self.merge_long(chunk)
        score, none = self.scores.get, float("-inf")
        symbols = list(chunk)
        offers = list(map(score, map(add, chunk, chunk[1:]), repeat(none)))
        while offers:
            best = max(offers)
            if best == none:
                break
            at = offers.index(best)
            symbols[at] = pair = symbols[at] + symbols.pop(at + 1)
            del offers[at]
            if at:
                offers[at - 1] = score(symbols[at - 1] + pair, none)
            if at < len(offers):
                offers[at] = score(pair + symbols[at + 1], none)
        return symbols

    def merge_long(self, chunk: str) -> list[str]:
        """The same with a queue, so that the time hardly grows faster than the chunk."""
        scores = self.scores
        symbols: list[str | None] = list(chunk)
        left, right = list(range(-1, len(symbols) - 1)), list(range(1, len(symbols) + 1))
        queue: list[tuple[float, int, int, str]] = []

        def offer(a: int, b: int) -> None:
            pair = symbols[a] + symbols[b]
            score = scores.get(pair)
            if score is not None:
                heapq.heappush(queue, (-score, a, b, pair))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while queue:
            _, a, b, pair = heapq.heappop(queue)
            if symbols[a] is None or symbols[b] is None or symbols[a] + symbols[b] != pair or right[a] != b:
                continue
            symbols[a], symbols[b] = pair, None
            right[a] = right[b]
            if right[a] < len(symbols):
                left[right[a]] = a
                offer(a, right[a])
            if left[a] >= 0:
                offer(left[a], a)
        return [s for s in symbols if s is not None]

    def chunk(self, chunk: str) -> tuple[bytes, bytes, str]:
        """Ids of a chunk, how many characters each piece spans, and what the ids are decoded to behind other ids: a chunk
        holds whole characters, so texts of chunks follow one another."""
        if len(chunk) <= SHORT:
            pieces = self.merge(chunk)
            try:
                ids = list(map(self.ids.__getitem__, pieces))
                return array("i", ids).tobytes(), bytes(map(len, pieces)), "".join(map(self.texts.__getitem__, ids))
            except KeyError:  # a character without a piece
                ids, spans = self.part(chunk)
        else:
            ids, spans = self.split(chunk)
        return ids, spans, self.decode(np.frombuffer(ids, "<i4"), first=False)

    def split(self, chunk: str) -> tuple[bytes, bytes]:
        """Ids and spans part by part, where no piece holds two neighbouring characters in a row and merges therefore end."""
        start, found = 0, []
        for at in range(1, len(chunk)):
            if chunk[at - 1 : at + 1] not in self.pairs:
                found.append(self.parts[chunk[start:at]])
                start = at
        found.append(self.parts[chunk[start:]])
        return found[0] if len(found) == 1 else (b"".join(f[0] for f in found), b"".join(f[1] for f in found))

    def part(self, chunk: str) -> tuple[bytes, bytes]:
        ids, spans = [], []
        for piece in self.merge(chunk):
            number = self.ids.get(piece)
            if number is not None:
                ids.append(number)
                spans.append(len(piece))
            else:  # one character without a piece
                raw = piece.encode()
                ids += [self.bytes[b] for b in raw]
                spans += [0] * (len(raw) - 1) + [1]
        return np.array(ids, "<i4").tobytes(), bytes(spans)

    def decode(self, ids: np.ndarray, first: bool = True) -> str:
        """Text of any ids: bytes in a row are read as UTF-8, each that belongs to no character as U+FFFD; control ids show
        nothing; the space that normalisation puts in front goes again, if the ids are the ``first`` ones of a text."""
        bytes_of = self.byte_of[ids]
        strips = first and (self.rules.dummy_prefix or self.rules.squeeze)
        if not (bytes_of >= 0).any() and not self.rules.squeeze and (not len(ids) or self.texts[ids[0]]):
            text = "".join(map(self.texts.__getitem__, ids.tolist()))
            return text[1:] if strips and text.startswith(" ") and ids[0] != self.unknown else text
        out: list[str] = []
        held, empty, stripping = bytearray(), True, strips
        for number, byte in zip([*ids.tolist(), None], [*bytes_of.tolist(), -1], strict=True):
            if byte >= 0:
                held.append(byte)
                continue
            if held:
                out.append(_characters(bytes(held)))
                held, empty = bytearray(), False
            if number is None:
                break
            text = self.texts[number]
            if empty and stripping and number != self.unknown and text.startswith(" "):
                text, stripping = text[1:], self.rules.squeeze
            out.append(text)
            empty = empty and not text
        return "".join(out)

    def encode(self, text: str | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, str]:
        """Ids without the end id, begin and end byte of each piece, and the decoded text."""
        normal, begins = normalise(text or "", self.rules)
        found = list(map(self.known.__getitem__, self.chunks.findall(normal)))
        if not found:
            none = np.empty(0, np.int32)
            return none, none, none, ""
        ids, spans, shown = zip(*found, strict=True)
        ends = np.cumsum(np.frombuffer(b"".join(spans), np.uint8), dtype=np.int64)
        bounds = begins[np.concatenate([[0], ends])].astype(np.int32)
        numbers = np.frombuffer(b"".join(ids), "<i4")
        if self.rules.squeeze:
            return numbers, bounds[:-1], bounds[1:], self.decode(numbers)
        start = self.decode(np.frombuffer(ids[0], "<i4"))
        return numbers, bounds[:-1], bounds[1:], start + "".join(shown[1:])


def _characters(raw: bytes) -> str:
    """UTF-8 read leniently: a byte that starts no whole character becomes U+FFFD, and reading goes on at the next one."""
    out, at = [], 0
    while at < len(raw):
        for width in range(1, 5):
            try:
                out.append(raw[at : at + width].decode())
            except UnicodeDecodeError:
                continue
            at += width
            break
        else:
            out.append("\ufffd")
            at += 1
    return "".join(out)


@lru_cache(maxsize=1)
def encoder_of(path: str) -> Encoder:
    """The encoder of a Python worker, with all it remembers: later tasks of the worker go on with it."""
    return Encoder(path)


ENCODED = "ids array<int>, begins array<int>, ends array<int>, decoded string"


def encode(docs: DataFrame, model_path: str, text_col: str = "text", into: str = "encoded") -> DataFrame:
    """``docs`` with a struct column ``into``: ids (the end id last), begin and end byte of each piece in the UTF-8 text
    (the end id spans nothing at the end), and the text that decoding the ids gives."""

    def run(texts: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        encoder = encoder_of(model_path)
        for part in (batch.iloc[at : at + TEXTS_HELD] for batch in texts for at in range(0, max(1, len(batch)), TEXTS_HELD)):
            ids, begins, ends, decoded = [], [], [], []
            for text in part:
                i, b, e, d = encoder.encode(text)
                last = len(text.encode()) if text else 0
                ids.append(np.append(i, np.int32(encoder.end_id)))
                begins.append(np.append(b, np.int32(last)))
                ends.append(np.append(e, np.int32(last)))
                decoded.append(d)
            columns = {"ids": _lists(ids), "begins": _lists(begins), "ends": _lists(ends), "decoded": decoded}
            yield pd.DataFrame(columns)

    return docs.withColumn(into, F.pandas_udf(run, ENCODED)(F.col(text_col)))


def _lists(values: list[np.ndarray]) -> pd.Series:
    offsets = np.cumsum([0, *map(len, values)], dtype=np.int32)
    return pd.Series(pd.arrays.ArrowExtensionArray(pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(values) if values else np.empty(0, np.int32), pa.int32()))))
