import random
from itertools import combinations

from cladeloom.llm.license_scan import FULL_TEXTS, TEMPLATES, Templates, align, all_forms, increasing, scan, words_of


def test_longest_increasing_subsequence():
    draw = random.Random(1)
    for _ in range(200):
        values = draw.sample(range(30), draw.randrange(9))
        found = [values[i] for i in increasing(values)]
        assert found == sorted(set(found))
        longest = max((n for n in range(len(values) + 1) for c in combinations(values, n) if list(c) == sorted(c)), default=0)
        assert len(found) == longest


def test_alignment_is_a_common_subsequence_and_finds_anchors():
    draw = random.Random(2)
    for _ in range(300):
        a = [draw.randrange(12) for _ in range(draw.randrange(20))]
        b = [draw.randrange(12) for _ in range(draw.randrange(20))]
        pairs = align(a, b)
        assert all(a[i] == b[j] for i, j in pairs)
        assert all(p[0] < q[0] and p[1] < q[1] for p, q in zip(pairs, pairs[1:], strict=False))
    unique = [draw.random() for _ in range(200)]
    cut = unique[:50] + unique[60:]
    assert len(align(cut, unique)) == 190


def test_planted_licences(spark, documents):
    marks = {"MIT": "under the MIT", "Apache-2.0": "under the Apache", "GPL-3.0-only": "GNU General Public", "CC-BY-NC-4.0": "CC BY-NC"}
    found = {(r.id, r.license) for r in scan(documents).collect()}
    assert found == {(r.doc_id, name) for r in documents.collect() for name, mark in marks.items() if mark in r.text}


def test_damaged_and_hidden_templates():
    known = Templates(TEMPLATES)
    words = TEMPLATES["ISC"].split()
    draw = random.Random(3)
    noise = [draw.choice(words) for _ in range(4000)]  # the template's own words, so few are unique in the text
    damaged = words[:6] + ["CHANGED"] + words[7:20] + words[22:]
    text = " ".join(["é", *noise[:2000], *damaged, *noise[2000:]])
    found = {x[0]: x for x in known.scan(text.encode(), 0.8)}
    assert found["ISC"][1] >= (len(words_of(TEMPLATES["ISC"].encode())[0]) - 3) / len(words_of(TEMPLATES["ISC"].encode())[0])
    plain = "Some words. " + TEMPLATES["MIT"] + " More."
    name, coverage, matched, first, end = next(x for x in known.scan(plain.encode(), 0.8))
    assert (name, coverage) == ("MIT", 1.0) and plain.encode()[first:end] == TEMPLATES["MIT"].rstrip(".").encode()


def test_unusual_rows(spark, frame, odd):
    mit = TEMPLATES["MIT"]
    rows = scan(frame([*odd, (1, mit), (1, mit), (None, mit)])).collect()
    assert sorted(str(r.id) for r in rows) == ["1", "1", "None"] and {r.license for r in rows} == {"MIT"}
    assert scan(frame([])).count() == 0


def test_full_texts_and_headers_by_name():
    known = Templates(all_forms())
    for form in all_forms():
        text = "Some file.\n" + form.text + "\nCopyright somebody."
        assert {x[0]: x[1] for x in known.scan(text.encode(), 0.8)}.get(form.licence) == 1.0, form.licence
    for name in FULL_TEXTS:
        text = max((f.text for f in all_forms() if f.licence == name), key=len)
        words = text.split()
        for body in (text, " ".join(words[:20] + ["changed"] + words[21:])):
            found = {x[0] for x in known.scan(body.encode(), 0.8)}
            # a text may quote the header of its own family
            assert name in found and all(f.split("-")[0] == name.split("-")[0] and "later" in f or f == name for f in found), (name, found)


def test_near_misses_keep_their_own_name():
    known = Templates(all_forms())
    wanted = {
        "Released under the BSD License.": set(),
        "This work is licensed under the GNU General Public License, version 2.": {"GPL-2.0-only"},
        "This work is licensed under the GNU Lesser General Public License, version 3.": set(),
        "This work is licensed under the GNU Affero General Public License, version 3.": set(),
        "Licensed under CC BY-SA 4.0.": set(),
        "Licensed under CC BY-NC-SA 4.0.": set(),
        "Licensed under CC BY-NC 3.0.": set(),
        "Licensed under the Apache License, Version 1.1.": set(),
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.": set(),
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.": {"CC-BY-SA-4.0"},
        "Released under the BSD License. Other parts are: Released under the MIT License.": {"MIT"},
    }
    for text, names in wanted.items():
        assert {x[0] for x in known.scan(text.encode(), 0.8)} == names, text
