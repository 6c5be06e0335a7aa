import numpy as np

from cladeloom.llm.nn_descent import Settings, nearest

SCHEMA = "vec_id bigint, embedding array<float>, label int, id string, node string, code string"


def exact(ids, vectors, query, count):
    scores = vectors @ vectors[query]
    scores[query] = -np.inf
    order = np.lexsort((ids, -scores))[: min(count, len(ids) - 1)]
    return ids[order].tolist()


def test_recall_on_the_drivers_vectors(spark):
    table = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    rows = table.toPandas()
    ids, vectors = rows.vec_id.to_numpy(), np.stack(rows.embedding).astype(float)
    found = {}
    for r in nearest(table, "id % 20 = 0", 20, settings=Settings(beam=64)).collect():
        found.setdefault(r.query_id, []).append((r["rank"], r.id, r.score))
    assert sorted(found) == sorted(ids[ids % 20 == 0].tolist())
    hits = 0
    for at in np.flatnonzero(ids % 20 == 0):
        mine = sorted(found[ids[at]])
        assert [m[0] for m in mine] == list(range(1, 21))
        assert mine == sorted(mine, key=lambda m: (-m[2], m[1]))
        place = {i: n for n, i in enumerate(ids)}
        assert all(abs(s - vectors[place[i]] @ vectors[at]) < 1e-12 for _, i, s in mine)
        hits += len({m[1] for m in mine} & set(exact(ids, vectors, at, 20)))
    assert hits >= 0.9 * 20 * len(found)


def test_unequal_norms_copies_and_unusual_rows(spark):
    draw = np.random.default_rng(3)
    vectors = draw.normal(size=(300, 8)) * draw.uniform(0.1, 5, size=(300, 1))
    rows = [(i, v.tolist()) for i, v in enumerate(vectors)]
    rows += [(1000 + i, vectors[0].tolist()) for i in range(40)]  # copies: ties go to the smaller id
    rows += [(1, vectors[1].tolist()), (500, None), (501, [0.0] * 8), (502, [float("nan")] * 8), (503, [None] * 8), (504, [1.0]), (505, []), (506, [float("inf")] * 8), (None, [1.0] * 8)]
    table = spark.createDataFrame([(*r, 1, "x", "y", "z") for r in rows], SCHEMA)
    valid = {i: np.array(v, np.float32).astype(float) for i, v in rows if i is not None and not 500 <= i < 507}
    ids = np.array(sorted(valid))
    matrix = np.stack([valid[i] for i in ids])
    found = {}
    for r in nearest(table, "id % 20 = 0", 20).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    assert sorted(found) == [i for i in ids.tolist() if i % 20 == 0]
    truth = {i: exact(ids, matrix, int(np.flatnonzero(ids == i)[0]), 20) for i in found}
    assert sum(len(set(found[i]) & set(truth[i])) for i in found) >= 0.95 * 20 * len(found)
    assert found[0][:3] == truth[0][:3]


def test_few_or_no_rows(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1, "", "", ""), (20, [0.0, 1.0], 1, "", "", ""), (3, [1.0, 1.0], 1, "", "", "")], SCHEMA)
    rows = nearest(few, "id % 20 = 0", 20).orderBy("query_id", "rank").collect()
    assert [(r.query_id, r["rank"], r.id, r.score) for r in rows] == [(0, 1, 3, 1.0), (0, 2, 20, 0.0), (20, 1, 3, 1.0), (20, 2, 0, 0.0)]
    assert nearest(few.limit(0), "id % 20 = 0", 20).count() == 0
    assert nearest(few.limit(1), "id % 20 = 0", 20).count() == 0


def test_one_very_long_vector_does_not_flatten_the_others(spark):
    draw = np.random.default_rng(8)
    vectors = draw.normal(size=(3000, 32)) * draw.uniform(0.7, 1.4, size=(3000, 1))
    vectors[7] *= 1000
    table = spark.createDataFrame([(i, v.tolist(), 1, "x", "y", "z") for i, v in enumerate(vectors)], SCHEMA)
    matrix, ids = vectors.astype(np.float32).astype(float), np.arange(3000)
    found = {}
    for r in nearest(table, "id % 20 = 0", 20, settings=Settings(beam=64)).orderBy("query_id", "rank").collect():
        found.setdefault(r.query_id, []).append(r.id)
    hits = sum(len(set(found[i]) & set(exact(ids, matrix, i, 20))) for i in range(0, 3000, 20))
    assert hits >= 0.9 * 20 * 150, hits / 3000
