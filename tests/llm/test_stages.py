import zlib

import corpus_pipeline
from cladeloom.llm.queries import ORACLES, QUERIES


def test_every_operator_has_its_query():
    import __spark_entry__ as entry

    names = entry.queries()
    assert [sum(q.startswith(f"op{n}_") for q in names) for n in range(1, 11)] == [1] * 10 and "pipeline" in names
    assert set(ORACLES) <= set(QUERIES) and ORACLES.items() <= entry.oracle_sql().items()


def test_stages_in_order_and_what_each_keeps(spark, frame, odd):
    assert [name for name, _ in corpus_pipeline.STAGES] == ["language", "near_duplicates", "substrings", "packing"]
    docs = frame(odd)
    by = dict(corpus_pipeline.STAGES)
    told = by["language"](spark, docs, "")
    assert told.columns == docs.columns
    assert sorted(str(r.text) for r in told.collect()) == sorted(str(t) for _, t in odd if any(c.isalpha() for c in t or ""))
    near = by["near_duplicates"](spark, told, "")
    assert near.columns == docs.columns
    # equal and repeated texts leave one row, the smallest id; a text without an id, or with the id of another text, stays
    rows = [(r.doc_id, r.text) for r in near.collect()]
    ids = [i for i, _ in rows]
    assert sorted(i for i in ids if i is not None) == [-4, 2, 11, 12, 12, 14]  # 13 is a near copy of 12
    assert [t for i, t in rows if i is None] == ["no id"] and (12, "another text under a used id") in rows
    left = by["substrings"](spark, near, "").collect()
    assert {r.doc_id for r in left} == set(ids) and len(left) == len(rows)
    texts = {r.doc_id: r.text for r in left}
    assert all(r.n_chars == len(r.text) or r.text in {t for _, t in odd} for r in left)
    before = dict(rows)
    assert texts[-4] == before[-4] and texts[11] == before[11]
    # repeated windows of rows without an id are judged too, behind those with one
    passage = " ".join(f"word{i}" for i in range(40))
    cut = by["substrings"](spark, frame([(None, passage + " tail"), (None, "other"), (None, None), (4, passage)]), "").collect()
    assert sorted((str(r.doc_id), r.text) for r in cut if r.text) == [("4", passage), ("None", "other"), ("None", "tail")] and len(cut) == 4
    empty = frame([])
    for _, stage in corpus_pipeline.STAGES:
        empty = stage(spark, empty, "")
    assert empty.count() == 0


def test_run_against_brute_force(spark, documents):
    """The rows of run() by the plain form of every stage, with the language decisions of the trained model."""
    from tokenizers import Tokenizer

    import numpy as np
    import public_tokenizers
    from cladeloom.llm.language_id import Scorer
    from cladeloom.llm.q_language import trained

    scorer = Scorer(trained(documents))
    docs = []
    for r in documents.orderBy("doc_id").collect():
        lang, score = scorer.score(r.text)
        if lang != "und" and score >= corpus_pipeline.LEAST_SCORE:
            docs.append((r.doc_id, r.text))
    from test_near import brute as groups
    from test_substring import brute as windows

    found = groups(docs, 5)
    docs = [(i, t) for i, t in docs if found[i][1] == i]
    kept = windows(docs, 20)
    docs = [(i, kept[i, t][2] if kept[i, t][1] else t) for i, t in docs if kept[i, t][2] or not kept[i, t][1]]
    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    wanted = []
    for i, t in docs:
        ids = np.array([*tokenizer.encode(t, add_special_tokens=False).ids, 1], "<u4")
        wanted += [(i, n, 4096 * n, len(ids[4096 * n :][:4096]), zlib.crc32(ids[4096 * n :][:4096].tobytes())) for n in range(-(-len(ids) // 4096))]
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").collect()
    assert sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == sorted(wanted)
    used = {}
    for r in sorted(rows, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == used.get(r.sequence_id, 0)
        used[r.sequence_id] = r.offset + r.length
    assert max(used.values()) <= 4096 and len(used) <= -(-sum(w[3] for w in wanted) // 4096) + 1
