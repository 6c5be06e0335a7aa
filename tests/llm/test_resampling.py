import hashlib
import math
import random
import re
import zlib
from collections import Counter

from cladeloom.llm.importance_resampling import Settings, feature_codes, ranked, resampled

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def features(text):
    words = WORD.findall((text or "").translate(LOWER))
    return words, [" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)]


def plain(pairs, target, settings):
    bucket = lambda f: zlib.crc32(f.encode()) % settings.buckets
    source, wanted = Counter(), Counter()
    for _, text in pairs:
        source.update(map(bucket, features(text)[1]))
    for text in target:
        wanted.update(map(bucket, features(text)[1]))
    s_all, t_all = sum(source.values()) + settings.buckets, sum(wanted.values()) + settings.buckets
    gain = {b: math.floor(1000 * math.log((wanted[b] + 1) * s_all / ((source[b] + 1) * t_all))) for b in source}
    rows = []
    for doc_id, text in pairs:
        words, found = features(text)
        weight = sum(gain[bucket(f)] for f in found)
        h = int(hashlib.sha256(f"{settings.seed}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32)))))
    may = sorted((r for r in rows if r[1] >= settings.least_words), key=lambda r: (-r[4], r[0] is None, r[0] or 0))
    drawn = may[: settings.percent * len(may) // 100]
    return sorted([(*r, n) for n, r in enumerate(drawn, 1)] + [(*r, None) for r in may[len(drawn) :]] + [(*r, None) for r in rows if r[1] < settings.least_words], key=str)


def answers(docs, target, settings):
    return sorted((tuple(r[:6]) for r in resampled(docs, target, settings=settings).select("id", "n_words", "n_features", "weight", "score", "rank").collect()), key=str)


def test_against_plain_python(spark, frame, odd, documents):
    draw = random.Random(8)
    made = [(i, " ".join(draw.choice(["alpha", "Beta", "GAMMA", "δέλτα", "e1", "--", "f_g"]) for _ in range(draw.randrange(0, 60)))) for i in range(400)]
    target = ["alpha beta alpha gamma", None, "", "e1 e1 e1", "beta δέλτα"]
    wanted = spark.createDataFrame([(t, 1) for t in target], "text string, id int")
    for pairs, settings in ((made, Settings()), (odd, Settings(percent=50)), (odd, Settings(percent=100, least_words=1, buckets=70_000)),
                            ([(r.doc_id, r.text) for r in documents.collect()], Settings(percent=20))):
        assert answers(frame(pairs).repartition(4), wanted, settings) == plain(pairs, target, settings)


def test_empty_tables(spark, frame, odd):
    nothing = spark.createDataFrame([], "text string")
    assert answers(frame([]), nothing, Settings()) == []
    assert answers(frame(odd), nothing, Settings()) == plain(odd, [], Settings())
    assert answers(frame([(1, None), (2, "")]), nothing, Settings()) == plain([(1, None), (2, "")], [], Settings())


def test_scan_finds_every_run():
    draw = random.Random(9)
    for _ in range(300):
        text = "".join(draw.choice("ab Zé1-\t\n_\U0001F600") for _ in range(draw.randrange(0, 40)))
        words, found = features(text)
        count, codes = feature_codes(text)
        assert count == len(words) and Counter(codes) == Counter(zlib.crc32(f.encode()) for f in found)


def test_ranks_with_many_ties(spark):
    rows = [(i, 25, 0, 0, [5, 5, -3][i % 3]) for i in range(3000)]
    scored = spark.createDataFrame(rows, "id long, n_words long, n_features long, weight long, score long").repartition(6)
    found = {r.id: r["rank"] for r in ranked(scored, Settings(percent=60)).collect()}
    order = sorted(rows, key=lambda r: (-r[4], r[0]))[:1800]
    assert len(found) == 3000 and {i: r for i, r in found.items() if r} == {r[0]: n for n, r in enumerate(order, 1)}
