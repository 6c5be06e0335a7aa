import hashlib
import random

import numpy as np
import pytest

from cladeloom.llm.laesa_codes import Settings, nearest, pivots_of, to_pivots, vector_codes

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, code string, error string, part string, far int, parts int"
EXTRA = ("x", "x", "x", "x", 1, 2)


def brute(rows, settings):
    """Plain integers in plain loops; rows are (vec_id, vector, label) that are to be kept."""
    ordered = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, list(r[1])))
    cut = []
    for _, vector, _ in ordered:
        ints = [int(np.floor(settings.scale * np.float64(np.float32(x)))) for x in vector]
        width = len(ints) // settings.parts
        cut.append([ints[p * width : (p + 1) * width] for p in range(settings.parts)])
    books = [[list(v[p]) for v in cut[: settings.entries]] for p in range(settings.parts)]
    gap = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    assign = lambda: [[min((gap(v[p], e), i) for i, e in enumerate(books[p])) for p in range(settings.parts)] for v in cut]
    for _ in range(settings.rounds):
        found = assign()
        for p in range(settings.parts):
            for i in range(len(books[p])):
                mine = [v[p] for v, f in zip(cut, found, strict=True) if f[p][1] == i]
                if mine:
                    books[p][i] = [sum(column) // len(mine) for column in zip(*mine, strict=True)]
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    out = []
    totals = {}
    for (_, _, label), found in zip(ordered, assign(), strict=True):
        totals[label] = totals.get(label, 0) + sum(d for d, _ in found)
    for (vec_id, _, label), found in zip(ordered, assign(), strict=True):
        out.append((vec_id, "".join(f"{i:02x}" for _, i in found), sum(d for d, _ in found), totals[label], digest))
    return sorted(out, key=str)


def answers(spark, rows, settings):
    frame = spark.createDataFrame([(*r, *EXTRA) for r in rows], SCHEMA).repartition(3)
    found = vector_codes(frame, settings=settings).collect()
    return sorted(((r.id, r.code, r.error, r.label_error, r.codebooks_sha256) for r in found), key=str)


@pytest.mark.parametrize("settings", [Settings(parts=2, entries=4, rounds=3, pivots=2), Settings(parts=4, entries=16, rounds=6)])
def test_against_plain_loops(spark, settings):
    draw = random.Random(3)
    centers = [[draw.uniform(-1, 1) for _ in range(8)] for _ in range(5)]
    rows = [(i, [x + draw.gauss(0, 0.1) for x in draw.choice(centers)], draw.choice([0, 1, None])) for i in range(150)]
    rows += [(200 + i, [0.5] * 8, 2) for i in range(40)]  # ties: many equal vectors
    assert answers(spark, rows, settings) == brute(rows, settings)


def test_unusual_rows(spark):
    settings = Settings(parts=2, entries=4, rounds=2)
    kept = [(5, [0.25, -0.25, 1.0, 0.0], 1), (5, [0.25, -0.25, 1.0, 0.0], 1), (5, [0.0, 0.0, 0.5, 0.0], None), (None, [9.0, 1.0, -3.0, 2.0], None), (7, [-0.0001, 0.0, 0.0, 0.0], 3)]
    dropped = [(1, None, 1), (2, [], 1), (3, [1.0, None, 0.0, 0.0], 1), (4, [float("nan"), 0.0, 0.0, 0.0], 1), (6, [float("inf")] * 4, 1), (8, [1.0, 2.0], 1)]
    assert answers(spark, kept + dropped, settings) == brute(kept, settings)
    for none in ([], dropped[:1], dropped[1:2]):
        assert answers(spark, none, settings) == []
    with pytest.raises(ValueError, match="don't divide"):
        answers(spark, [(1, [1.0, 2.0, 3.0], 0)], settings)
    with pytest.raises(Exception, match="too large"):
        answers(spark, [(1, [1e30, 2.0], 0)], settings)


def test_bounds_prune_without_changing_the_answer():
    draw = np.random.default_rng(2)
    centers = draw.integers(-4000, 4000, (16, 8))
    block = centers[draw.integers(0, 16, 3000)] + draw.integers(-200, 200, (3000, 8))
    pivots = pivots_of(centers, 4)
    index, best, evaluated = nearest(block, to_pivots(block, pivots), centers, pivots)
    full = ((block[:, None] - centers[None]) ** 2).sum(axis=2)
    assert (index == full.argmin(axis=1)).all() and (best == full.min(axis=1)).all()
    assert evaluated < 0.25 * full.size
