import random

from cladeloom.llm.common import components
from cladeloom.llm.near_dedup import Settings, Signer, near_duplicates


def brute(pairs, words, percent=80):
    sets = {}
    for i, text in pairs:
        w = (text or "").encode().lower().split()
        n = min(words, len(w))
        sets[i] = {tuple(w[j : j + n]) for j in range(len(w) - n + 1)} if w else set()
    low = {i: i for i in sets}

    def root(a):
        while low[a] != a:
            a = low[a]
        return a

    for a in sets:
        for b in sets:
            common = len(sets[a] & sets[b])
            if a < b and common and 100 * common >= percent * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                low[max(x, y)] = min(x, y)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def mutated(draw, base, edits):
    words = list(base)
    for _ in range(edits):
        words[draw.randrange(len(words))] = f"new{draw.randrange(10**9)}"
    return " ".join(words)


def test_large_group_of_near_copies(spark, frame):
    """Copies of very different distance from their origin: hubs reach some, shared differences the rest."""
    draw = random.Random(4)
    base = [f"b{draw.randrange(500)}" for _ in range(120)]
    variant = mutated(draw, base, 14).split()  # too far from the origin, but with copies of its own
    texts = [mutated(draw, base, draw.randrange(14)) for _ in range(110)] + [mutated(draw, variant, draw.randrange(8)) for _ in range(40)]
    texts += [" ".join(f"u{draw.randrange(10**6)}" for _ in range(60)) for _ in range(40)] + [" ".join(base)] * 5
    draw.shuffle(texts)
    pairs = list(enumerate(texts))
    found = {r.id: (r.n_shingles, r.component_id) for r in near_duplicates(frame(pairs), settings=Settings(words=2)).collect()}
    assert found == brute(pairs, 2)


def test_keys_find_every_pair_within_the_distance():
    settings = Settings()
    signer, draw = Signer(settings), random.Random(1)
    import numpy as np

    for _ in range(300):
        a = np.array([draw.randrange(2**16) for _ in range(settings.symbols)], np.uint16)
        b = a.copy()
        for at in draw.sample(range(settings.symbols), settings.distance):
            b[at] ^= draw.randrange(1, 2**16)
        assert set(signer.keys(a).tolist()) & set(signer.keys(b).tolist())


def test_unusual_rows(spark, frame, odd):
    rows = near_duplicates(frame(odd), settings=Settings(words=5)).collect()
    ids = [i for i, _ in odd if i is not None]
    assert sorted(r.id for r in rows) == sorted(ids)
    by = {}
    for r in rows:
        by.setdefault(r.id, set()).add(r.component_id)
    assert by[3] == by[2] == {2} and by[5] == {5} and by[7] == {7} and by[8] == {8} and by[12] == {12}
    assert all(r.kept == (r.id == r.component_id) for r in rows)
    assert near_duplicates(frame([])).count() == 0


def test_components_of_a_path_and_a_star(spark):
    path = [(i, i + 1) for i in range(40)]
    star = [(1000, 100 + i) for i in range(50)]
    loops = [(7, 7)]
    found = {r.node: r.component for r in components(spark.createDataFrame(path + star + loops, "u bigint, v bigint")).collect()}
    assert {found[i] for i in range(41)} == {0} and {found[i] for i in [1000, *range(100, 150)]} == {100}
    assert components(spark.createDataFrame([], "u bigint, v bigint")).count() == 0


def left_apart(spark, texts, hub, labels=()):
    """Listed differences and full sets of one key that holds all texts, each a component of its own but for ``labels``."""
    from cladeloom.llm.common import WordHashes
    from cladeloom.llm.near_dedup import _left_apart, shingle_set

    hashes, component = WordHashes(), dict(labels)
    placed = spark.createDataFrame([(1, i, component.get(i, i)) for i in range(len(texts))], "key bigint, id bigint, component bigint")
    hubs = spark.createDataFrame([(1, hub, 1)], "key bigint, hub bigint, turn int")
    sets = [(i, shingle_set(t.encode(), 2, hashes).view("int64").tolist()) for i, t in enumerate(texts)]
    sets = spark.createDataFrame(sets, "id bigint, shingles array<bigint>").cache()
    return _left_apart(placed, hubs, sets, Settings(words=2)), sets


def test_rare_differences_come_first(spark):
    """Classes with a passage of the hub and a line that it lacks, all else their own: few pairs, all linked ones among them."""
    from cladeloom.llm.near_dedup import _across

    draw = random.Random(8)
    base = [f"b{i}" for i in range(120)]
    line = " ".join(f"l{i}" for i in range(15))
    texts = [" ".join(base)] + [" ".join([line, *base, *(f"u{draw.randrange(10**9)}" for _ in range(80))]) for _ in range(150)]
    texts += [mutated(draw, texts[i].split(), 4) for i in (3, 4, 5)]
    listed, _ = left_apart(spark, texts, 0)
    pairs = {(r.u, r.v) for r in _across(listed, Settings(words=2)).collect()}
    truth = brute(list(enumerate(texts)), 2)
    assert {(3, 151), (4, 152), (5, 153)} <= pairs and [truth[i][1] for i in (151, 152, 153)] == [3, 4, 5]
    assert len(pairs) < 100  # 11,628 with new shingles before lost ones


def test_a_second_group_of_near_copies_lists_no_pairs(spark):
    """Copies of a text far from the hub are linked one by one before pairs are listed, so few pairs are."""
    from cladeloom.llm import near_dedup
    from cladeloom.llm.near_dedup import _crossing, _joined_apart

    draw = random.Random(6)
    base = [f"b{i}" for i in range(120)]
    variant = mutated(draw, base, 16).split()
    texts = [" ".join(base), " ".join(variant)] + [mutated(draw, variant, draw.randrange(1, 9)) for _ in range(200)]
    settings, seen, whole = Settings(words=2), [], near_dedup._crossing
    listed, sets = left_apart(spark, texts, 0)
    assert whole(listed)[1] > 20 * len(texts)
    near_dedup._crossing = lambda rows: seen.append(whole(rows)) or seen[-1]
    try:
        labels = _joined_apart(spark.createDataFrame([], "node bigint, component bigint"), listed, sets, settings)
    finally:
        near_dedup._crossing = whole
    found = {r.node: r.component for r in labels.collect()}
    assert {i: found.get(i, i) for i in range(len(texts))} == {i: c for i, (_, c) in brute(list(enumerate(texts)), 2).items()}
    # 19,986 pairs when all were listed at once
    assert seen[-1][1] <= settings.pairs_a_row * seen[-1][0] < seen[0][1]
