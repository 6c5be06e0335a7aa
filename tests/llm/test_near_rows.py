import random

from pyspark.sql import functions as F

from cladeloom.llm.near_dedup import Settings
from cladeloom.llm.near_rows import one_of_each, renamed_rows, with_identity
from test_near import brute, mutated


def wanted(rows, words=5):
    """One (id, text) pair of each group, by comparing all pairs of different rows."""
    distinct = sorted(set(rows), key=lambda r: (r[0] is None, r[0] or 0, r[1] or ""))
    groups = {}
    for at, (_, low) in brute([(i, t) for i, (_, t) in enumerate(distinct)], words).items():
        groups.setdefault(low, []).append(distinct[at])
    return groups.values()


def test_ids_that_are_missing_or_shared(spark, frame):
    """No clean text is lost: texts without an id, and several texts of one id, each stand for themselves."""
    draw = random.Random(8)
    texts = [" ".join(f"w{draw.randrange(10**6)}" for _ in range(90)) for _ in range(30)]
    rows = [(draw.choice([None, 1, 2, 3, 4, 5, draw.randrange(1000)]), draw.choice([t, t, mutated(draw, t.split(), 1)])) for t in texts * 4]
    rows += [(1, texts[0]), (1, texts[0]), (None, texts[1]), (None, texts[1]), (None, None), (6, None), (2**40, "one")]
    found = [(r.doc_id, r.text) for r in one_of_each(frame(rows), Settings(words=5)).collect()]
    groups = list(wanted(rows))
    assert len(found) == len(set(found)) == len(groups)
    key = lambda r: (r[0] is None, r[0] or 0)
    for group in groups:
        kept = [r for r in group if r in set(found)]
        assert len(kept) == 1 and key(kept[0]) == min(map(key, group))


def test_clean_ids_stay_as_they_are(spark, frame):
    docs = frame([(3, "a b"), (3, "a b"), (-2, "c d"), (9, None)])
    assert renamed_rows(docs).count() == 0
    assert [r["__identity"] for r in with_identity(docs, renamed_rows(docs)).orderBy("doc_id").collect()] == [-2, 3, 3, 9]
    odd = frame([(3, "a b"), (3, "x"), (None, "c"), (None, "c"), (None, None)])
    numbers = renamed_rows(odd)
    assert sorted(r["__number"] for r in numbers.collect()) == [4, 5, 6]
    assert renamed_rows(odd, texts_apart=False).where(F.col("__id").isNotNull()).count() == 0
    named = with_identity(odd, numbers)
    assert named.count() == 5 and named.select("__identity").distinct().count() == 4
    assert one_of_each(frame([])).count() == 0
