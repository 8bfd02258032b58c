import numpy as np

from framerank.llm import ann


def brute(rows, k=10):
    ids = np.array([r.vec_id for r in rows])
    x = np.array([r.embedding for r in rows], np.float32).astype(np.float64)
    out = {}
    for i in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[i]) ** 2).sum(axis=1))
        order = np.lexsort((ids, d))
        out[int(ids[i])] = [(int(ids[j]), float(d[j])) for j in order if ids[j] != ids[i]][:k]
    return out


def test_recall_and_scores(spark):
    vectors = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    want = brute(vectors.collect())
    got = {}
    for r in ann.digest(vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    assert set(got) == set(want)
    hit = 0
    for q, own in got.items():
        assert [r for r, _, _ in own] == list(range(1, 11))
        assert own == sorted(own, key=lambda r: (r[2], r[1]))
        exact = dict(want[q])
        for _, v, s in own:
            hit += v in exact
            if v in exact:
                assert abs(s - exact[v]) < 1e-12
    assert hit / (10 * len(want)) >= 0.9


def test_edges_and_hot_cells(spark, monkeypatch):
    monkeypatch.setattr(ann, "CELL_ROWS", 20)
    e = [0.5, 0.5, 0.5]
    rows = [(i, e) for i in range(1, 90)] + [(200, e), (300, [1.0, 0.0, 0.0]), (300, [1.0, 0.0, 0.0]), (400, None), (500, [0.0, 0.0, 0.0]), (600, [1.0, None, 0.0]), (700, [1.0, float("nan"), 0.0]), (None, e), (5, e), (800, [1.0])]
    vectors = spark.createDataFrame([(i, v, 1.0) for i, v in rows], "vec_id long, embedding array<float>, score double")
    got = {}
    for r in ann.digest(vectors).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.vec_id, round(r.score, 6)))
    assert got[200] == [(i, 0.0) for i in range(1, 11)]
    assert len(got[300]) == 10 and got[300][0] == (1, round(0.75**0.5, 6))
    assert set(got) == {200, 300}
    two = spark.createDataFrame([(100, e), (7, e)], "vec_id long, embedding array<float>")
    assert [tuple(r) for r in ann.digest(two).collect()] == [(100, 1, 7, 0.0)]
    assert ann.digest(two.where("vec_id = 100")).count() == 0
    assert ann.digest(two.limit(0)).count() == 0


def test_cells_are_nearest_axes():
    h = ann.Hash(5, 3)
    x = np.random.default_rng(0).normal(size=(50, 5)).astype(np.float32)
    cells = h.cells(x, 2).reshape(50, 3, 2)
    for t in range(3):
        y = h.rotated(x, t)
        assert np.allclose(np.linalg.norm(y, axis=1), 1, atol=1e-5)
        signed = np.stack((y, -y), axis=2).reshape(50, -1)
        assert (cells[:, t, 0] - t * 16 == signed.argmax(axis=1)).all()


def test_an_id_repeated_sixty_times_takes_one_place(spark):
    """Nine other ids lie right behind the copies of one."""
    rng = np.random.default_rng(2)
    q = rng.normal(size=16)
    rows = [(100, q)] + [(1, q + 1e-4 * k) for k in range(1, 61)] + [(10 + k, q + 0.02 + 1e-3 * k) for k in range(9)] + [(200 + k, rng.normal(size=16)) for k in range(1, 50)]
    vectors = spark.createDataFrame([(i, [float(c) for c in v]) for i, v in rows], "vec_id long, embedding array<double>")
    for options in ({}, {"hashes": 2, "probes": 10}, {"hashes": 3, "probes": 12}):
        got = [r.vec_id for r in ann.nearest(vectors, vectors.where("vec_id = 100"), **options).orderBy("rank").collect()]
        assert got == [1, *range(10, 19)]


def test_recall_with_more_hashes(spark, monkeypatch):
    vectors = spark.read.parquet("/root/testdata/check_s/embeddings.parquet")
    want = brute(vectors.where("embedding is not null").collect())
    monkeypatch.setattr(ann, "HASHES", ((None, 3, 24),))
    hit = sum(r.vec_id in dict(want[r.query_id]) for r in ann.digest(vectors).collect())
    assert hit / sum(map(len, want.values())) >= 0.9


def test_far_rows_change_nothing(spark):
    """Among 1,510 rows a query finds what it finds among the 1,490 that are near."""
    rng = np.random.default_rng(3)
    near = [(i, [float(c) for c in v]) for i, v in enumerate(rng.normal(size=(1490, 64)))]
    schema = "vec_id long, embedding array<float>"
    found = []
    for extra in (0, 20):
        far = [(10_000 + i, [float(c) for c in v]) for i, v in enumerate(1000 * rng.normal(size=(extra, 64)))]
        vectors = spark.createDataFrame(near + far, schema)
        found.append(sorted(map(tuple, ann.nearest(vectors, vectors.where("vec_id < 1490 and vec_id % 100 = 0")).collect())))
    assert len(found[0]) == 150
    assert found[1] == found[0]
