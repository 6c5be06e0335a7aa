from collections import Counter

import numpy as np

from cladeloom.llm.language_id import Bounds, Scorer, language_of, ngrams_of, split_words, train
from cladeloom.llm.q_language import held_out, op1_language_id, trained


def test_held_out_accuracy_and_inputs(spark, documents):
    found = op1_language_id(spark, "/root/testdata/sf0.001")
    assert found.columns[:4] == ["doc_id", "held_out", "lang_pred", "score"]
    both = found.join(documents.select("doc_id", "lang"), "doc_id").where("held_out").toPandas()
    assert len(both) > 30 and (both.lang == both.lang_pred).mean() > 0.97
    assert both.score.between(0, 1).all()


def test_held_out_is_the_crc_remainder(spark):
    import zlib

    rows = spark.range(200).select("id", held_out("id").alias("out")).collect()
    assert all(r.out == (zlib.crc32(str(r.id).encode()) % 4 == 2) for r in rows)


def test_backoff_by_hand(spark):
    rows = spark.createDataFrame([(1, "sun sun moon", "aa"), (2, "sol luna", "bb")], "doc_id bigint, text string, lang string")
    model = train(rows, bounds=Bounds(longest_ngram=3))
    assert model.languages == ["aa", "bb"]
    logs = np.log([(2 + 0.5) / (3 + 0.5 * 4), 0.5 / (2 + 0.5 * 4)])
    assert np.allclose(model.words.sums(np.array([model.words.find("sun")]), np.ones(1)), logs)
    scorer = Scorer(model)
    # no three-letter piece of "^so$" but "^so" is known: the shorter ones aren't asked
    assert np.allclose(scorer.unseen("so"), model.ngrams.sums(np.array([model.ngrams.find("^so")]), np.ones(1)))
    assert ngrams_of("so", 3) == ["^so", "so$"]
    assert model.ngrams.find("q") == -1 and model.words.find("su") == -1
    assert scorer.score("luna nova")[0] == "bb"
    assert list(split_words("Ab1c ½ É")) == ["ab", "c", "é"]


def plain_scores(labelled, texts, longest):
    """Log frequencies and back-off by dictionaries of words and n-grams."""
    languages = sorted({lang for _, lang in labelled if lang})
    words, grams = {lang: Counter() for lang in languages}, {lang: Counter() for lang in languages}
    for text, lang in labelled:
        if lang and text:
            words[lang].update(split_words(text))
    for lang in languages:
        for word, n in words[lang].items():
            for length in range(1, longest + 1):
                for gram in ngrams_of(word, length):
                    grams[lang][gram] += n

    def log(table, key, lang):
        known = len(set().union(*table.values()))
        return np.log((table[lang][key] + 0.5) / (sum(table[lang].values()) + 0.5 * known))

    out = []
    for text in texts:
        found = list(split_words(text or ""))
        if not found:
            out.append(("und", 0.0))
            continue
        sums = np.zeros(len(languages))
        for word in found:
            if any(word in words[lang] for lang in languages):
                sums += [log(words, word, lang) for lang in languages]
                continue
            for length in range(min(longest, len(word) + 2), 0, -1):
                known = [g for g in ngrams_of(word, length) if any(g in grams[lang] for lang in languages)]
                if known:
                    sums += [np.mean([log(grams, g, lang) for g in known]) for lang in languages]
                    break
        best = int(np.argmax(sums))
        out.append((languages[best], float(1 / np.exp(sums - sums[best]).sum())))
    return out


def test_against_dictionaries(spark, frame, documents):
    rows = documents.limit(60).collect()
    labelled = [(r.text, r.lang if r.doc_id % 3 else None) for r in rows]
    docs = spark.createDataFrame([(i, t, lang) for i, (t, lang) in enumerate(labelled)], "doc_id bigint, text string, lang string")
    model = train(docs, bounds=Bounds(longest_ngram=4))
    texts = [(r.text or "")[:300] for r in rows] + ["", "12", "zzzz qqq", "the la de und"]
    scorer = Scorer(model)
    for text, (lang, score) in zip(texts, plain_scores(labelled, texts, 4), strict=True):
        found = scorer.score(text)
        assert found[0] == lang and abs(found[1] - score) < 1e-4


def test_every_language_can_be_predicted(spark):
    rows = spark.createDataFrame([(i, f"w{chr(97 + i // 26)}{chr(97 + i % 26)} common", f"l{i:03d}") for i in range(300)], "doc_id bigint, text string, lang string")
    scorer = Scorer(train(rows))
    assert len(scorer.model.languages) == 300
    assert all(scorer.score(f"w{chr(97 + i // 26)}{chr(97 + i % 26)}")[0] == f"l{i:03d}" for i in range(300))


def test_unusual_rows(spark, frame, odd):
    docs = frame(odd)
    found = docs.select("doc_id", "text", language_of(docs, trained(docs)).alias("f")).collect()
    assert len(found) == len(odd)
    for r in found:
        letters = any(c.isalpha() for c in r.text or "")
        assert r.f.lang_pred == ("en" if letters else "und") and (r.f.score > 0) == letters


def test_nothing_to_learn(spark, frame):
    docs = frame([(1, "some text")], lang=None)
    assert docs.select(language_of(docs, train(docs)).alias("f")).first().f.lang_pred == "und"
    empty = frame([])
    assert empty.select(language_of(empty, train(empty)).alias("f")).count() == 0
