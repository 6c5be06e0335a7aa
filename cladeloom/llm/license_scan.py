"""Coverage of licence templates in texts by patience alignment.

Text and template are sequences of words (letters and digits, lower case). Words that occur once in both are
anchors; the longest increasing subsequence of their places, found by patience sorting, is kept; the stretches
before, between and after anchors are aligned in the same way. A stretch without an anchor is aligned by its equal
first and last words only. The aligned words divided by the template's words are its coverage.

Templates are short notices, standard headers and full texts of public licences; several forms of one licence give one
row, the best. Coverage alone doesn't tell near relatives apart, so a form names words that must be among the aligned
ones (name, version, clause) and words that must not lie within the stretch or just after it (``Lesser``, ``NC``).

A template that a text covers must share that many of its words, counted with repeats, so texts are first held against a
word index of the templates; this drops nothing that could reach ``least``. Texts are aligned whole. The templates
are a small fixed collection whose size is checked.

Rules for unusual rows: a NULL or empty text covers nothing and gives no row, as does a text below ``least`` for every
template. Equal coverages give a row each. Repeated rows are answered each; a NULL id stays NULL. Other columns
are never read.
"""

from __future__ import annotations

import pkgutil
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

#: Words of all templates together, at most: they travel with every task.
TEMPLATE_WORDS = 200_000
WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

# --- fixed values: short forms of public licences, by SPDX name, then headers and the names of full texts ---
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0-only": "This work is licensed under the GNU General Public License, version 3.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, "
        "provided that the above copyright notice and this permission notice appear in all copies."
    ),
}
HEADER = (
    "This {what} is free software: you can redistribute it and/or modify it under the terms of the GNU {name} as published by the "
    "Free Software Foundation, either version {version} of the License, or (at your option) any later version."
)
HEADERS = {
    "GPL-2.0-or-later": HEADER.format(what="program", name="General Public License", version="2"),
    "GPL-3.0-or-later": HEADER.format(what="program", name="General Public License", version="3"),
    "LGPL-2.1-or-later": HEADER.format(what="library", name="Lesser General Public License", version="2.1"),
    "LGPL-3.0-or-later": HEADER.format(what="library", name="Lesser General Public License", version="3"),
    "AGPL-3.0-or-later": HEADER.format(what="program", name="Affero General Public License", version="3"),
    "Apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
    "MPL-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "GPL-2.0-only": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-3-Clause": "Released under the BSD 3-Clause License.",
    "BSD-2-Clause": "Released under the BSD 2-Clause License.",
    "CC-BY-SA-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
}
FULL_TEXTS = (
    "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "CC0-1.0", "GPL-2.0-only", "GPL-3.0-only", "LGPL-2.0-only", "LGPL-2.1-only", "LGPL-3.0-only",
    "MIT", "MPL-1.1", "MPL-2.0", "Unlicense",
)
# words that a form of the licence must have aligned, and words that may not lie within the stretch or up to AFTER words behind it
CREATIVE = "nc sa nd noncommercial sharealike noderivatives noderivs commercial share"
GNU = "lesser library affero"
MARKS = {
    "notice": {
        "MIT": ("mit", ""), "Apache-2.0": ("apache 2 0", ""), "GPL-3.0-only": ("gnu general 3", GNU + " later"), "ISC": ("appear", ""),
        "CC-BY-NC-4.0": ("cc by nc 4 0", "sa nd sharealike noderivatives"), "CC-BY-4.0": ("creative attribution 4 0", CREATIVE),
    },
    "header": {
        "GPL-2.0-or-later": ("gnu general 2 later", GNU), "GPL-3.0-or-later": ("gnu general 3 later", GNU), "LGPL-2.1-or-later": ("gnu lesser 2 1 later", "affero"),
        "LGPL-3.0-or-later": ("gnu lesser 3 later", "affero"), "AGPL-3.0-or-later": ("gnu affero 3 later", "lesser"), "Apache-2.0": ("apache 2 0", ""),
        "MPL-2.0": ("mozilla 2 0", ""), "GPL-2.0-only": ("gnu general 2", GNU + " later"), "BSD-3-Clause": ("bsd 3", ""), "BSD-2-Clause": ("bsd 2", ""),
        "CC-BY-SA-4.0": ("creative sharealike 4 0", "nc noncommercial"),
    },
    "text": {
        "MIT": ("conditions included portions", ""), "BSD-3-Clause": ("endorse promote", ""), "BSD-2-Clause": ("redistributions", "endorse promote advertising"),
        "GPL-2.0-only": ("gnu", ""), "GPL-3.0-only": ("gnu", "remotely"), "LGPL-2.0-only": ("gnu library", "lesser"), "LGPL-2.1-only": ("gnu lesser", ""),
        "LGPL-3.0-only": ("gnu lesser", ""), "Apache-2.0": ("apache", ""), "MPL-1.1": ("mpl", ""), "MPL-2.0": ("mozilla", ""), "CC0-1.0": ("cc0", ""),
        "Unlicense": ("unencumbered", ""),
    },
}
AFTER = 8
# --- end of fixed values ---


@dataclass(frozen=True)
class Form:
    """One template of a licence, with the words it must and must not have."""

    licence: str
    text: str
    needs: frozenset[bytes] = frozenset()
    bars: frozenset[bytes] = frozenset()


def _form(licence: str, text: str, kind: str) -> Form:
    needs, bars = MARKS[kind].get(licence, ("", ""))
    return Form(licence, text, frozenset(needs.encode().split()), frozenset(bars.encode().split()))


def notices() -> list[Form]:
    return [_form(name, text, "notice") for name, text in TEMPLATES.items()]


def all_forms() -> list[Form]:
    """Notices, headers and the full texts that lie beside this module."""
    bodies = [(name, (pkgutil.get_data(__package__, f"licences/{name}.txt") or b"").decode()) for name in FULL_TEXTS]
    return notices() + [_form(*item, "header") for item in HEADERS.items()] + [_form(*item, "text") for item in bodies]


def words_of(text: bytes) -> tuple[list[bytes], list[tuple[int, int]]]:
    """Words, and the byte span of each in the text; only A-Z are lowered, so spans stay true."""
    found = list(WORD.finditer(text.lower()))
    return [m.group() for m in found], [m.span() for m in found]


def increasing(values: list[int]) -> list[int]:
    """Positions of one longest strictly increasing subsequence: each card goes on the leftmost pile whose top isn't
    smaller, and remembers the top of the pile before."""
    tops: list[int] = []
    held: list[int] = []
    back = [-1] * len(values)
    for i, value in enumerate(values):
        pile = bisect_left(tops, value)
        if pile:
            back[i] = held[pile - 1]
        if pile == len(tops):
            tops.append(value)
            held.append(i)
        else:
            tops[pile], held[pile] = value, i
    out, at = [], held[-1] if held else -1
    while at >= 0:
        out.append(at)
        at = back[at]
    return out[::-1]


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched places ``(in text, in template)``, increasing in both."""
    matched: list[tuple[int, int]] = []
    open_gaps = [(0, len(text), 0, len(template))]
    while open_gaps:
        a, b, c, d = open_gaps.pop()
        while a < b and c < d and text[a] == template[c]:
            matched.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            matched.append((b, d))
        if a == b or c == d:
            continue
        wanted = Counter(template[c:d])
        held = Counter(w for w in text[a:b] if w in wanted)
        place = {template[j]: j for j in range(c, d) if wanted[template[j]] == 1}
        anchors = [(i, place[text[i]]) for i in range(a, b) if held.get(text[i]) == 1 and text[i] in place]
        chain = [anchors[k] for k in increasing([j for _, j in anchors])]
        if not chain:
            continue
        matched += chain
        before = (a - 1, c - 1)
        for at in [*chain, (b, d)]:
            open_gaps.append((before[0] + 1, at[0], before[1] + 1, at[1]))
            before = at
    return sorted(matched)


class Templates:
    def __init__(self, templates: dict[str, str] | list[Form]):
        if isinstance(templates, dict):
            templates = notices() if templates is TEMPLATES else [Form(*item) for item in templates.items()]
        forms = [(form, words_of(form.text.encode())[0]) for form in sorted(templates, key=lambda f: (f.licence, f.text))]
        if sum(len(words) for _, words in forms) > TEMPLATE_WORDS:
            raise ValueError(f"templates hold more than {TEMPLATE_WORDS} words")
        self.forms = [(form, words, Counter(words)) for form, words in forms if words]
        self.known = {w for _, words, _ in self.forms for w in words}

    def scan(self, text: bytes, least: float) -> Iterator[tuple[str, float, int, int, int]]:
        """``(licence, coverage, matched words, first byte, end byte)`` of every licence covered well enough."""
        return (row[:5] for row in self.best_forms(text, least))

    def best_forms(self, text: bytes, least: float) -> Iterator[tuple[str, float, int, int, int, int]]:
        """``(licence, coverage, matched words, first byte, end byte, template words)`` of every licence covered well
        enough, by its best form."""
        held = Counter(filter(self.known.__contains__, WORD.findall(text.lower())))
        total, wanted = held.total(), []
        for form, template, counts in self.forms:
            short = len(template) * least
            if total >= short and form.needs <= held.keys() and sum(min(n, held[w]) for w, n in counts.items()) >= short:
                wanted.append((form, template))
        words, spans = words_of(text) if wanted else ([], [])
        found: dict[str, tuple] = {}
        for form, template in wanted:
            matched = self.best_stretch(words, template, least, form)
            if matched and len(matched) >= least * len(template):
                row = (form.licence, len(matched) / len(template), len(matched), spans[matched[0][0]][0], spans[matched[-1][0]][1], len(template))
                if form.licence not in found or row[1:3] > found[form.licence][1:3]:
                    found[form.licence] = row
        yield from (found[name] for name in sorted(found))

    @staticmethod
    def fits(words: list[bytes], template: list[bytes], matched: list[tuple[int, int]], form: Form) -> bool:
        if not matched or not form.needs <= {template[j] for _, j in matched}:
            return False
        return not form.bars or form.bars.isdisjoint(words[matched[0][0] : matched[-1][0] + 1 + AFTER])

    def best_stretch(self, words: list[bytes], template: list[bytes], least: float, form: Form) -> list[tuple[int, int]]:
        """The whole text is aligned first. Words of the template that the text repeats elsewhere are no anchors there, so
        the stretch around every place of its rarest words is aligned too: of one word more than a good match may
        miss, it holds at least one, and lies where that word's place in the template says."""
        best = align(words, template)
        best = best if self.fits(words, template, best, form) else []
        spare = int((1 - least) * len(template)) + 1
        places: dict[bytes, list[int]] = {w: [] for w in template}
        for i, w in enumerate(words):
            if w in places:
                places[w].append(i)
        rare = sorted(range(len(template)), key=lambda j: (len(places[template[j]]), j))[:spare]
        starts = sorted({i - j for j in rare for i in places[template[j]]})
        for start in starts:
            if len(best) == len(template):
                break
            low, high = max(0, start - spare), min(len(words), start + len(template) + spare)
            found = [(a + low, b) for a, b in align(words[low:high], template)]
            if len(found) > len(best) and self.fits(words, template, found, form):
                best = found
        return best


FOUND = "id bigint, license string, coverage double, matched int, template_words int, first_byte bigint, end_byte bigint"


def scan(docs: DataFrame, templates: dict[str, str] | None = None, least: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row (:data:`FOUND`) for every text and template with coverage of at least ``least``."""
    known = Templates(templates or all_forms())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                for name, coverage, matched, first, end, size in known.best_forms(text.as_py() or b"", least):
                    out.append((doc_id, name, coverage, matched, size, first, end))
            columns = list(zip(*out, strict=True)) or [[]] * 7
            kinds = [pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=[x.split()[0] for x in FOUND.split(", ")])

    return docs.selectExpr(f"CAST(`{id_col}` AS bigint) AS id", f"CAST(`{text_col}` AS binary) AS text").mapInArrow(run, FOUND)
