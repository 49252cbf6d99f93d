"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams: single words, and runs of up to three word
shapes (letters, capitals, digits and signs in order, repeats folded, with a mark on a word equal to the
one before). Each is scaled by the log ratio of its smoothed
document frequency in the two classes; a linear hinge-loss model on the scaled
indicators is fitted by dual coordinate descent. A logistic curve on the
margins of rows left out of the fit turns a margin into a probability.

The fit sees at most ``MAX_ROWS`` labelled rows, chosen by hash; scoring is one pass over all texts.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from operator import add, eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import raw

MAX_ROWS = 3_000
MIN_DOCUMENTS = 3  # rows that must hold an n-gram
COST = 0.1
EPOCHS = 15
CUT = 0.3

_CLASSES = bytearray(range(256))
for _b in range(256):
    if 97 <= _b <= 122 or _b >= 128:
        _CLASSES[_b] = ord("a")
    elif 65 <= _b <= 90:
        _CLASSES[_b] = ord("A")
    elif 48 <= _b <= 57:
        _CLASSES[_b] = ord("0")
_CLASSES = bytes(_CLASSES)
_FOLD = re.compile(rb"([^\x20\x09-\x0D])\1+")
CACHE = 300_000
Feature = bytes | int | tuple


class Shapes(dict):
    """word -> twice a checksum of its shape; repeats of a sign class are folded."""

    def __missing__(self, word: bytes) -> int:
        self[word] = found = 2 * zlib.crc32(_FOLD.sub(rb"\1", word.translate(_CLASSES)))
        return found


_SHAPES = Shapes()


def features(text: bytes) -> set[Feature]:
    """N-grams present in a text: lower-case words, and runs of one to three shapes, where an odd number says
    that the word equals the one before it. A text without words has one feature of its own."""
    if len(_SHAPES) > CACHE:
        _SHAPES.clear()
    found = text.split()
    shapes = list(map(_SHAPES.__getitem__, found))
    marked = shapes[:1] + list(map(add, shapes[1:], map(eq, found[1:], found)))
    out: set[Feature] = set(text.lower().split())
    out.update(marked)
    out.update(zip(marked, marked[1:]))
    out.update(zip(marked, marked[1:], marked[2:]))
    return out or {-1}


@dataclass(frozen=True)
class Model:
    weights: dict[Feature, float]
    bias: float
    slope: float
    shift: float

    def margin(self, text: bytes) -> float:
        known = [w for w in map(self.weights.get, features(text)) if w is not None]
        return self.bias + sum(known) / max(len(known), 1) ** 0.5

    def score(self, text: bytes) -> float:
        z = self.slope * self.margin(text) + self.shift
        return float(1 / (1 + np.exp(-np.clip(z, -500, 500))))


def log_count_ratios(rows: list[np.ndarray], labels: np.ndarray, size: int) -> np.ndarray:
    """log of each n-gram's share in class 1 over its share in class 0, one added to every count."""
    held = {}
    for c in (0, 1):
        chosen = [r for r, y in zip(rows, labels) if y == c]
        held[c] = 1.0 + np.bincount(np.concatenate(chosen) if chosen else np.empty(0, int), minlength=size)
    return np.log(held[1] / held[1].sum()) - np.log(held[0] / held[0].sum())


def hinge_fit(rows: list[np.ndarray], labels: np.ndarray, scale: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """Dual coordinate descent for the hinge loss; each class has the same total weight."""
    sign = np.where(labels == 1, 1.0, -1.0)
    share = np.where(labels == 1, (labels == 0).sum(), (labels == 1).sum()) * 2.0 / max(len(labels), 1)
    top = cost * np.maximum(share, 1e-9)
    values = [scale[r] / max(len(r), 1) ** 0.5 for r in rows]
    square = [v @ v + 1 for v in values]  # and 1 for the bias
    weight, bias, alpha = np.zeros(len(scale)), 0.0, np.zeros(len(rows))
    order = np.random.default_rng(0)
    for _ in range(epochs):
        for i in order.permutation(len(rows)):
            r, v = rows[i], values[i]
            slack = sign[i] * (weight[r] @ v + bias) - 1
            new = min(max(alpha[i] - slack / square[i], 0.0), top[i])
            step, alpha[i] = (new - alpha[i]) * sign[i], new
            if step:
                weight[r] += step * v
                bias += step
    return weight * scale, bias


def logistic(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of P(1) over the margin, by Newton steps with smoothed targets."""
    up, down = (labels == 1).sum(), (labels == 0).sum()
    target = np.where(labels == 1, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.stack([margins, np.ones_like(margins)], 1)
    at = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ at, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2), x.T @ (target - p) - 1e-6 * at)
        at += np.clip(step, -5, 5)
    return float(max(at[0], 1e-3)), float(at[1])


def train(texts: list[bytes], labels: list[int], *, cost: float = COST, epochs: int = EPOCHS) -> Model:
    """Fit on texts with labels 0 and 1. With one class only, or no rows, every text gets that class's (or an even) score."""
    y = np.array(labels, int)
    if len(set(labels)) < 2:
        return Model({}, 0.0, 1.0, 0.0 if not labels else (4.0 if labels[0] else -4.0))
    times: Counter = Counter()
    for t in texts:  # the n-grams of all rows are never held at once
        times.update(features(t))
    index = {f: i for i, f in enumerate(sorted((f for f, n in times.items() if n >= MIN_DOCUMENTS), key=repr))}
    del times
    rows = [np.array(sorted(index[f] for f in features(t) if f in index), np.int64) for t in texts]

    def fitted(chosen: list[int]) -> tuple[np.ndarray, float]:
        part, own = [rows[i] for i in chosen], y[chosen]
        return hinge_fit(part, own, log_count_ratios(part, own, len(index)), cost, epochs)

    def margin(row: np.ndarray, weight: np.ndarray, bias: float) -> float:
        return float(weight[row].sum() / max(len(row), 1) ** 0.5 + bias)

    left = [i for i in range(len(rows)) if i % 3 == 0]
    most = [i for i in range(len(rows)) if i % 3]
    if len(set(y[most])) < 2 or len(set(y[left])) < 2:
        left = most = list(range(len(rows)))
    half = fitted(most)
    slope, shift = logistic(np.array([margin(rows[i], *half) for i in left]), y[left])
    weight, bias = fitted(list(range(len(rows))))
    return Model({f: float(weight[i]) for f, i in index.items()}, float(bias), slope, shift)


def fold_of(doc_id: Column, folds: int) -> Column:
    return F.pmod(F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), F.lit(folds))


def scored(docs: DataFrame, keep: list[str], text: str, model: Model) -> DataFrame:
    """The kept columns and ``score``, row for row. Null text scores as empty text."""
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = shared.value.score
        for batch in batches:
            found = pa.array([score(t) for t in raw(batch.column("_text"))], pa.float64())
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], found], [*keep, "score"])

    return source.mapInArrow(run, docs.select(*keep).schema.add("score", "double"))


def train_on(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", *,
    max_rows: int = MAX_ROWS, **settings,
) -> Model:
    """Fit on the texts of at most ``max_rows`` labelled ids, the first by a hash of the id.

    The ids are chosen from the labels alone, so that only their texts leave the scan. Ids that are null, labelled
    both ways or with anything but 0 and 1 are left out. Of rows that repeat an id, at most ``max_rows`` in all count.
    """
    marks = labels.select(F.col(doc_id).alias("_id"), F.col(label).cast("int").alias("_mark")).where("_id is not null and _mark is not null")
    marks = marks.groupBy("_id").agg(F.min("_mark").alias("_mark"), F.max("_mark").alias("_other"))
    marks = marks.where("_mark = _other and _mark in (0, 1)").select("_id", "_mark", F.xxhash64("_id").alias("_place"))
    marks = F.broadcast(marks.orderBy("_place", "_id").limit(max_rows))  # max_rows narrow rows
    rows = docs.select(F.col(doc_id).alias("_id"), F.col(text).cast("string").alias("_text")).join(marks, "_id")
    rows = rows.orderBy("_place", "_text").limit(max_rows).select("_text", "_mark").toArrow()
    return train(raw(rows.column("_text").combine_chunks()), rows.column("_mark").to_pylist(), **settings)


def accepted(docs: DataFrame, model: Model, text: str = "text", *, cut: float = CUT) -> DataFrame:
    """The documents, with all columns, whose score is ``cut`` or more."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def score(values):
        return values.fillna("").map(lambda t: shared.value.score(t.encode("utf-8", "replace"))).astype("float64")

    return docs.where(score(F.col(text).cast("string")) >= cut)
