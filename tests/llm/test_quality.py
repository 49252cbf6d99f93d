import zlib

import numpy as np
from conftest_llm import prose

from foliospark.llm import quality
from foliospark.llm.queries import op3_quality_classifier


def test_held_out_accuracy(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in op3_quality_classifier(spark, folder).collect()}
    marks = {r.doc_id: r.quality for r in spark.read.parquet(f"{folder}/labels.parquet").collect()}
    assert all(r.held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i, r in found.items())
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in found.values())
    held = [(r.predicted, marks[i]) for i, r in found.items() if r.held_out and i in marks]
    assert sum(p == y for p, y in held) / len(held) > 0.95


def test_dual_descent_reaches_the_minimum():
    """The dual solution's primal objective is not above that of subgradient steps on the same problem."""
    r = np.random.default_rng(0)
    rows = [np.flatnonzero(r.random(12) < 0.4) for _ in range(80)]
    labels = np.array([int(len(x) and x[0] < 3) for x in rows])
    scale = r.normal(size=12)
    weight, bias = quality.hinge_fit(rows, labels, scale, 1.0, 400)
    share = np.where(labels == 1, (labels == 0).sum(), (labels == 1).sum()) * 2.0 / len(labels)
    x = np.zeros((80, 12))
    for i, row in enumerate(rows):
        x[i, row] = scale[row] / max(len(row), 1) ** 0.5
    sign = np.where(labels == 1, 1, -1)

    def cost(w, b):
        return 0.5 * (w @ w + b * b) + (share * np.maximum(0, 1 - sign * (x @ w + b))).sum()

    w, b = np.zeros(12), 0.0
    for t in range(1, 30_000):
        on = (sign * (x @ w + b) < 1) * share * sign
        w, b = w - (w - on @ x) / (t + 100), b - (b - on.sum()) / (t + 100)
    assert cost(weight / scale, bias) <= cost(w, b) + 1e-2


def test_ratios():
    ratios = quality.log_count_ratios([np.array([0, 1]), np.array([1]), np.array([2])], np.array([1, 1, 0]), 3)
    expected = np.log(np.array([2, 3, 1]) / 6) - np.log(np.array([1, 1, 2]) / 4)
    assert np.allclose(ratios, expected)


def test_odd_rows(spark, odd, empty):
    good, bad = [prose(s, 60) for s in range(30)], [prose(s, 60).replace(" ", "### ") for s in range(30)]
    model = quality.train([t.encode() for t in good + bad], [1] * 30 + [0] * 30)
    assert model.score(prose(99, 80).encode()) > 0.5 > model.score(prose(98, 80).replace(" ", "### ").encode())
    found = quality.scored(odd, ["doc_id", "mark"], "text", model)
    assert found.count() == odd.count() and all(0 <= r.score <= 1 for r in found.collect())
    kept = quality.accepted(odd, model)
    assert kept.columns == odd.columns and kept.count() == sum(r.score >= 0.3 for r in found.collect())
    assert quality.accepted(empty, model).count() == quality.scored(empty, ["doc_id"], "text", model).count() == 0
    labels = spark.createDataFrame([(1, 1), (None, 0), (4, None), (2, 0), (2, 1)], "doc_id long, quality int")
    one = quality.train_on(odd, labels)
    assert one.score(b"") == one.score(b"anything") > 0.9
    none = quality.train_on(empty, labels)
    assert none.score(b"x") == 0.5
