import math

import numpy as np
import pytest

from foliospark.llm import queries, whitening

NAN, INF = float("nan"), float("inf")
SCHEMA = "vec_id long, embedding array<float>, label int, whitened string, _x int, i int"


def table(spark, rows):
    return spark.createDataFrame([(i, v, 0, "w", 1, 2) for i, v in rows], SCHEMA)


def plain(vectors):
    """x, n x - s in whole numbers, variances and unit components, by exact sums and an eigendecomposition."""
    x = [[math.floor(1024 * float(np.float32(c))) + 100_000 for c in v] for v in vectors]
    n, s = len(x), [sum(c) for c in zip(*x)]
    moved = [[n * c - t for c, t in zip(row, s)] for row in x]
    centred = np.array(moved, float) / n
    values, axes = np.linalg.eigh(centred.T @ centred / n)
    return moved, centred, values[::-1], axes[:, ::-1]


def check(rows, model, vectors, kept):
    moved, centred, values, axes = plain(vectors)
    whole = [sum(c * c for c in m) for m in moved]
    assert [r.deviation for r in rows] == [v if v < 2**63 else None for v in whole]
    assert len(model.sizes) == kept
    assert np.allclose(model.sizes, values[:kept], rtol=1e-9) and np.isclose(model.trace, values.sum(), rtol=1e-12)
    found = np.array([r.whitened for r in rows])
    for k in range(kept):
        gap = min(abs(values[k] - values[j]) for j in range(len(values)) if j != k)
        wanted = centred @ axes[:, k] / np.sqrt(values[k])
        sign = np.sign(found[:, k] @ wanted)
        assert np.abs(found[:, k] * sign - wanted).max() < 1e-11 * values[0] / gap + 1e-9
    assert np.abs(found.T @ found / len(rows) - np.eye(kept)).max() < 1e-9 and model.identity_error < 1e-9


def test_given_vectors(spark):
    given = spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")
    rows, model = whitening.whiten(given, ["vec_id"])
    vectors = [r.embedding for r in given.orderBy("vec_id").collect()]
    check(sorted(rows.collect(), key=lambda r: r.vec_id), model, vectors, 8)


@pytest.mark.parametrize("kind", ["few rows", "scales", "dependent", "short", "copies"])
def test_hard_matrices(spark, kind):
    made = np.random.default_rng(7)
    a, kept = made.normal(size=(300, 12)) * np.linspace(1, 5, 12), 8
    if kind == "few rows":
        a, kept = made.normal(size=(6, 20)), 5
    elif kind == "scales":  # variances over 12 powers of ten; the small ones vanish in whole numbers
        a = a * 10.0 ** np.linspace(4, -2, 12)
    elif kind == "dependent":
        a = np.round(a[:, :4] * 64) / 1024
        a, kept = np.hstack([a, a, np.zeros((300, 3))]), 4
    elif kind == "short":
        a, kept = a[:, :3], 3
    elif kind == "copies":
        a = np.vstack([a, np.repeat(a[:1], 600, axis=0)])
    vectors = a.astype(np.float32).tolist()
    rows, model = whitening.whiten(table(spark, list(enumerate(vectors))).repartition(7), ["vec_id"])
    check(sorted(rows.collect(), key=lambda r: r.vec_id), model, vectors, kept)


def test_odd_rows(spark):
    good = np.random.default_rng(2).normal(size=(20, 3)).astype(np.float32).tolist()
    bad = [None, [], [1.0, None, 2.0], [1.0, NAN, 2.0], [INF, 0.0, 0.0], [-INF, 0.0, 0.0], [1.0, 2.0], [3e38, 0.0, 0.0], [1e30, 1.0, 1.0]]
    rows = [(i, v) for i, v in enumerate(good)] + [(None, good[0]), (3, good[3])] + [(100 + i, v) for i, v in enumerate(bad)]
    found, model = whitening.whiten(table(spark, rows), ["vec_id", "label", "_x", "i"])
    assert model.n == 22
    ids = [r.vec_id for r in found.collect()]
    assert sorted(ids, key=str) == sorted([*range(20), None, 3], key=str)


def test_one_repeated_row_and_no_rows(spark):
    found, model = whitening.whiten(table(spark, [(i, [1.0, 2.0]) for i in range(5)]), ["vec_id"])
    assert len(model.sizes) == 0 and [(r.deviation, r.whitened) for r in found.collect()] == [(0, [])] * 5
    for rows in ([], [(1, None)]):
        found, model = whitening.whiten(table(spark, rows), ["vec_id"])
        assert model is None and found.columns == ["vec_id", "deviation", "whitened"] and found.count() == 0


def test_query_of_an_empty_table(spark, tmp_path):
    table(spark, []).write.parquet(str(tmp_path / "embeddings.parquet"))
    found = queries.op12_embedding_whitening(spark, str(tmp_path))
    assert found.columns == ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"] and found.count() == 0


def test_large_deviations_stay_exact_or_null():
    x = np.array([[10**9, 5], [-(10**9), 7]], np.int64)
    n, s = 2, [0, 12]
    assert whitening.deviations(x, n, s) == [(2 * 10**9) ** 2 + 4, (2 * 10**9) ** 2 + 4]
    assert whitening.deviations(x * 4, n, [0, 48]) == [None, None]


def test_triangular_solves_and_shift():
    made = np.random.default_rng(3)
    q, r = made.normal(size=(50, 6)), np.triu(made.normal(size=(6, 6))) + 5 * np.eye(6)
    assert np.allclose(whitening.solved(q, [r, r]) @ r @ r, q)
    flat = np.ones((4, 4))  # singular: only a shift gives a factor
    got = whitening.factor(flat, 10, False)
    assert np.allclose(got.T @ got, flat, atol=1e-6)
