import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from cladeloom.llm.bins import bins_below
from cladeloom.llm.spot_signatures import COMMON, Settings, edited_pairs, fingerprint, likeness, with_signatures

SPLIT = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_set(text, settings):
    words = SPLIT.findall((text or "").translate(LOWER))
    content = [(i, w) for i, w in enumerate(words) if w not in COMMON]
    found = set()
    for j, (i, _) in enumerate(content):
        if j + settings.chain > len(content) or i == 0:
            continue
        before = words[max(0, i - settings.gap) : i]
        if words[i - 1] in COMMON or (len(before) == settings.gap and not set(before) & set(COMMON)):
            found.add(" ".join([words[i - 1], *(w for _, w in content[j : j + settings.chain])]))
    found = found or set(words) or ({text} - {None, ""})
    return sorted({hashlib.md5(s.encode()).hexdigest()[:8] for s in found})


def plain_likeness(a, b, least):
    if a == b:
        return 1.0
    share = len(set(a) & set(b)) / len(set(a) | set(b))
    return share if share >= least else 0.0


def plain(pairs, settings):
    """Answers of every (id, text) row, by sorting all rows at once."""
    rows = sorted(((i, t or "") for i, t in pairs if i is not None), key=lambda r: (-r[0], r[1]))
    after = {n: rows[(n + 1) % len(rows)][1] for n in range(len(rows))}
    out = [(i, t, after[n]) for n, (i, t) in enumerate(rows)] + [(None, t or "", None) for i, t in pairs if i is None]
    answers = []
    for i, text, following in out:
        cut = len(text) // 3
        edited = text[: len(text) - cut] + (following or "")[:cut]
        a, b = plain_set(text, settings), plain_set(edited, settings)
        c = plain_set(following, settings) if following is not None else []
        answers.append((i, len(text), edited, "".join(a), "".join(b), plain_likeness(a, b, settings.least), plain_likeness(a, c, settings.least)))
    return sorted(answers, key=str)


def answers(docs, settings):
    found = edited_pairs(docs, settings=settings)
    columns = ["id", "n_chars", "edited_text", fingerprint("signatures").alias("a"), fingerprint("edited_signatures").alias("b"), "near_edited", "near_next"]
    return sorted((tuple(r) for r in found.select(*columns).collect()), key=str)


@pytest.mark.parametrize("settings", [Settings(), Settings(chain=2, gap=3, least=0.5)])
def test_against_plain_python(spark, frame, odd, documents, settings):
    draw = random.Random(4)
    pool = [*COMMON[:6], *(f"w{i}" for i in range(30)), "ÉCOLE", "𝒳y"]
    made = [(draw.randrange(-50, 400), " ".join(draw.choice(pool) for _ in range(draw.randrange(0, 60)))) for _ in range(300)]
    for pairs in (odd, made, [(r.doc_id, r.text) for r in documents.limit(80).collect()]):
        assert answers(frame(pairs).repartition(5), settings) == plain(pairs, settings)


def test_few_rows(frame):
    for pairs in ([(3, "the only text here is its own next one")], [(1, None), (2, None)], [(4, "a"), (None, "the text of none")]):
        assert answers(frame(pairs), Settings()) == plain(pairs, Settings())
    assert answers(frame([]), Settings()) == []


def test_bins_agree_with_counting(spark):
    for bounds in ([], [5], [9, 7, 3], list(range(97, 0, -7))):
        found = spark.range(-2, 101).select("id", bins_below(bounds)(F.col("id")).alias("bin")).collect()
        assert all(r.bin == sum(b >= r.id for b in bounds) for r in found)


def test_passing_over_changes_nothing(spark):
    """Lengths and ranges only rule out pairs that stay below the threshold anyway."""
    draw = random.Random(5)
    texts = [" ".join(draw.choice(["the", "of", "x", "y", "z", "u", "v"]) for _ in range(draw.randrange(0, 80))) for _ in range(60)]
    rows = with_signatures(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", "s")
    pairs = rows.select(F.col("id").alias("i"), F.col("s").alias("a")).join(rows.select(F.col("id").alias("j"), F.col("s").alias("b")), F.col("i") < F.col("j"))
    for least in (0.05, 0.3, 0.8):
        for r in pairs.select("a", "b", likeness("a", "b", Settings(least=least)).alias("x")).collect():
            assert abs(r.x - (plain_likeness(r.a, r.b, least))) < 1e-12


def test_only_dataframe_functions_and_one_shuffle_of_texts(spark, documents):
    plan = edited_pairs(documents)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert len(re.findall(r"Exchange hashpartitioning", plan)) == 1
