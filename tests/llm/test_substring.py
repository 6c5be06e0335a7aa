import random

import numpy as np

from cladeloom.llm.fm_index import FMIndex, WaveletMatrix
from cladeloom.llm.substring_dedup import Settings, remove_repeats, repeats_in_shard, runs_of, sliding_least


def brute(pairs, window):
    """Kept words of each distinct (id, text) row; rows of one id are told apart by position in the sorted order."""
    seen, out = set(), {}
    for doc_id, text in pairs:
        words = (text or "").encode().split()
        gone = [False] * len(words)
        mine = []
        for at in range(len(words) - window + 1):
            held = tuple(words[at : at + window])
            if held in seen:
                gone[at : at + window] = [True] * window
            seen.add(held)
        out[doc_id, text] = (len(words), sum(gone), b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode())
        del mine
    return out


def answers(docs, settings):
    return sorted((r.id, r.n_words, r.n_removed, r.kept) for r in remove_repeats(docs, settings=settings).collect())


def test_shared_passages_against_brute_force(spark, frame):
    draw = random.Random(6)
    passages = [[f"p{n}_{i}" for i in range(draw.randrange(15, 70))] for n in range(6)]
    pairs = []
    for doc_id in range(120):
        words = [f"w{draw.randrange(10**6)}" for _ in range(draw.randrange(0, 60))]
        for _ in range(draw.randrange(3)):
            p = draw.choice(passages)
            a = draw.randrange(0, 10)
            at = draw.randrange(len(words) + 1)
            words[at:at] = p[a:]
        pairs.append((doc_id, " ".join(words)))
    for settings in (Settings(), Settings(spread_runs=1, shard_words=50)):
        assert answers(frame(pairs), settings) == sorted((i, *v) for (i, _), v in brute(pairs, 20).items())


def test_unusual_rows(spark, frame, odd):
    rows = answers(frame(odd), Settings())
    plain = sorted({p for p in odd if p[0] is not None and p[0] != 12}, key=lambda p: p[0])
    twelve = [p for p in odd if p[0] == 12]
    expected = brute(sorted([*plain, twelve[0]], key=lambda p: p[0]), 20)
    for doc_id, text in plain:
        assert (doc_id, *expected[doc_id, text]) in rows
    assert rows.count((12, *expected[12, twelve[0][1]])) == 2  # a repeated row is the same document
    assert len(rows) == sum(p[0] is not None for p in odd)
    assert remove_repeats(frame([])).count() == 0


def test_wavelet_ranks():
    draw = np.random.default_rng(1)
    values = draw.integers(0, 37, 700)
    matrix = WaveletMatrix(values, 37)
    symbol, low, high = draw.integers(0, 37, 400), draw.integers(0, 701, 400), draw.integers(0, 701, 400)
    a, b = matrix.ranks(symbol, low, high)
    assert a.tolist() == [int((values[:x] == s).sum()) for s, x in zip(symbol, low, strict=True)]
    assert b.tolist() == [int((values[:x] == s).sum()) for s, x in zip(symbol, high, strict=True)]


def test_matching_lengths():
    draw = np.random.default_rng(2)
    text = draw.integers(1, 4, 300)
    index = FMIndex(text, 16)
    other = draw.integers(1, 6, 120)
    ends = np.arange(1, 121)
    length, low, high = index.matches(other, ends, 16)
    held = text.tolist()
    for end, n, a, b in zip(ends, length, low, high, strict=True):
        for size in range(1, min(16, end) + 1):
            part = other[end - size : end].tolist()
            times = sum(held[i : i + size] == part for i in range(len(held) - size + 1))
            if size <= n:
                assert times > 0
                if size == n:
                    assert b - a == times
            else:
                assert times == 0
                break


def test_equal_windows_have_equal_anchors():
    draw = np.random.default_rng(3)
    values = draw.integers(0, 2**62, 200).astype(np.uint64)
    settings = Settings()
    both = np.concatenate([values[:90], values[30:90], values[100:]])
    anchors, starts, counts, _ = runs_of(both, settings)
    each = np.repeat(anchors, counts)
    assert len(each) == len(both) - 19 and np.array_equal(each[30:71], each[90:131])
    assert sliding_least(np.arange(10)[::-1], 4).tolist() == [6, 5, 4, 3, 2, 1, 0]


def test_one_shard_by_hand():
    run = np.arange(1, 25, dtype=np.uint64)
    ids, versions, starts = np.array([9, 4, 4]), np.zeros(3, int), np.array([0, 5, 50])
    found = repeats_in_shard(ids, versions, starts, [run, run[2:], run[:21]], 20)
    assert sorted(zip(*(x.tolist() for x in found), strict=True)) == [(9, 0, i) for i in range(5)]
