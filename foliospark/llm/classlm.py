"""Class-based n-gram scores (Brown): P(word | history) = P(class | history class) * P(word | class).

Words are assigned to classes by exchange in batches: a word moves to the class
under which its neighbours are likeliest, the class distributions are summed anew,
and so on for ``ROUNDS`` rounds. This is done twice. At first only neighbours that are
context words are told apart and counted; then every neighbour is counted, context words one by one
and all others by the class they have got, so no neighbour is left out.

The vocabulary is all of the training documents'. Two thresholds are relative to
the corpus, so that what they select has a proven bound: *core* words make up at
least 2 ** -CORE of all tokens (so there are at most 2 ** CORE), *context* words
at least 2 ** -CONTEXT. Core words and their classes are broadcast, and most
tokens are core. All other words get their class by the same likelihood
from the classes they follow, and meet their counts in a join by word. The history
of a token is the class of the nearest core word before it.

Every known word's class probability is mixed with its smoothed frequency; the
weight of the latter is the share of tokens seen once. A word never seen keeps the
probability of the plain model.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Stage, raw, words

CORE, CONTEXT = 21, 8
CLASSES = 32
ROUNDS = 6
END = b"\n"  # no word holds white space
SLICE = 256  # documents handled at once in a task
FLUSH = 400_000  # table entries a task holds before it passes them on


@dataclass(frozen=True)
class Corpus:
    """Counts of the training tokens and the core words by falling count."""

    tokens: int
    distinct: int
    once: int
    core: list[bytes]
    counts: np.ndarray
    contexts: int

    @property
    def unknown(self) -> float:
        return 1 / (self.tokens + self.distinct + 1)


def count_words(docs: DataFrame, text: str) -> DataFrame:
    """word (bytes) and n over all documents, one end token each."""
    source = docs.select(F.col(text).cast("string").alias("_text"))

    def rows(held: Counter) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array(held.values(), pa.int64())], ["word", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                for data in raw(batch.column("_text").slice(at, SLICE)):
                    held.update(words(data))
                    held[END] += 1
                if len(held) > FLUSH:
                    yield rows(held)
                    held = Counter()
        yield rows(held)

    return source.mapInArrow(run, "word binary, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


def gather(docs: DataFrame, text: str) -> Corpus:
    stage = Stage(docs.sparkSession)
    counts = stage.keep(count_words(docs, text), "words")
    known = counts.agg(F.sum("n"), F.count("*"), F.sum((F.col("n") == 1).cast("long"))).first()
    total = known[0] or 0
    core = counts.where(F.col("n") * (1 << CORE) >= total).orderBy(F.desc("n"), "word").toArrow()
    n = np.array(core.column("n").to_pylist(), np.int64)
    contexts = int((n * (1 << CONTEXT) >= total).sum()) if total else 0
    stage.drop(counts)
    return Corpus(total, known[1], known[2] or 0, core.column("word").to_pylist(), n, contexts)


class Reader:
    """Turns slices of documents into arrays of core numbers (-1: not core)."""

    def __init__(self, core: list[bytes]):
        self.number = {w: i for i, w in enumerate(core)}

    def read(self, texts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        """All tokens with their ends, their core numbers, and the first token of each document."""
        tokens: list[bytes] = []
        starts = []
        for data in texts:
            starts.append(len(tokens))
            tokens += words(data)
            tokens.append(END)
        numbers = np.fromiter(map(self.number.get, tokens, repeat(-1)), np.int64, len(tokens))
        return tokens, numbers, np.array(starts, np.int64)


def before(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each token, the place of the nearest core token before it in its document, or -1."""
    place = np.arange(len(numbers))
    upto = np.maximum.accumulate(np.where(numbers >= 0, place, -1)) if len(numbers) else place
    out = np.full(len(numbers), -1, np.int64)
    out[1:] = upto[:-1]
    first = np.repeat(starts, np.diff(np.append(starts, len(numbers))))
    return np.where(out >= first, out, -1)


def neighbours(docs: DataFrame, text: str, core, cells: np.ndarray, side: int) -> DataFrame:
    """w, cells, n: for each core word how often core words stand before it (cell ``cells[v]``) or after it (``side + cells[v]``).

    Core words v with a negative cell are not counted.
    """
    source = docs.select(F.col(text).cast("string").alias("_text"))
    width = 2 * side
    dealt = docs.sparkSession.sparkContext.broadcast(cells)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, cell = Reader(core.value), dealt.value
        held, size = [], 0

        def rows() -> pa.RecordBatch:
            keys, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays(
                [pa.array((keys // width).astype(np.int32)), pa.array((keys % width).astype(np.int32)), pa.array(n)], ["w", "cell", "n"]
            )

        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                _, numbers, starts = reader.read(raw(batch.column("_text").slice(at, SLICE)))
                back = before(numbers, starts)
                here = np.flatnonzero((numbers >= 0) & (back >= 0))
                left, right = numbers[back[here]], numbers[here]
                before_it, after_it = cell[left], cell[right]
                held.append((right * width + before_it)[before_it >= 0])
                held.append((left * width + side + after_it)[after_it >= 0])
                size += len(held[-1]) + len(held[-2])
                if size > 10 * FLUSH:
                    yield rows()
                    held, size = [], 0
        if held:
            yield rows()

    found = source.mapInArrow(run, "w int, cell int, n bigint").groupBy("w", "cell").agg(F.sum("n").alias("n"))
    return found.groupBy("w").agg(F.collect_list("cell").alias("cells"), F.collect_list("n").alias("n"))


def _dense(batch: pa.RecordBatch, cells: str, counts: str, width: int) -> np.ndarray:
    lists = batch.column(cells)
    row = np.repeat(np.arange(batch.num_rows), np.diff(lists.offsets.to_numpy()))
    out = np.zeros((batch.num_rows, width))
    out[row, lists.flatten().to_numpy()] = batch.column(counts).flatten().to_numpy()
    return out


def _log_shares(sums: np.ndarray) -> np.ndarray:
    """Log of each class's distribution, smoothed by a little of the distribution of all."""
    whole = sums.sum(0) + 1e-9
    mixed = sums + 0.5 * whole / whole.sum()
    return np.log(mixed / mixed.sum(1, keepdims=True))


def exchange(vectors: DataFrame, width: int, seeds: np.ndarray, rounds: int) -> np.ndarray:
    """Final log distributions of the classes. Only class by cell sums are gathered in a round."""
    spark = vectors.sparkSession
    shares = _log_shares(seeds)
    for _ in range(rounds):
        shared = spark.sparkContext.broadcast(shares)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            logs = shared.value
            sums = np.zeros_like(logs)
            for batch in batches:
                for at in range(0, batch.num_rows, 1000):
                    x = _dense(batch.slice(at, 1000), "cells", "n", width)
                    np.add.at(sums, (x @ logs.T).argmax(1), x)
            k, cell = np.nonzero(sums)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k.astype(np.int32)), pa.array(cell.astype(np.int32)), pa.array(sums[k, cell])], ["k", "cell", "n"]
            )

        rows = vectors.mapInArrow(run, "k int, cell int, n double").groupBy("k", "cell").agg(F.sum("n").alias("n")).toArrow()
        sums = np.zeros_like(shares)
        sums[rows.column("k").to_numpy(), rows.column("cell").to_numpy()] = rows.column("n").to_numpy()
        shares = _log_shares(sums)
    return shares


def choose_seeds(x: np.ndarray, classes: int) -> np.ndarray:
    """Context words that differ most from each other, the most frequent first."""
    logs = _log_shares(x)
    p = np.exp(logs)
    chosen = [0]
    far = (p * (logs - logs[0])).sum(1)
    while len(chosen) < min(classes, len(x)):
        chosen.append(int(far.argmax()))
        far = np.minimum(far, (p * (logs - logs[chosen[-1]])).sum(1))
    return x[chosen]


def core_classes(docs: DataFrame, text: str, corpus: Corpus, core, classes: int, rounds: int) -> np.ndarray:
    """Class of each core word, by all its core neighbours."""
    number = np.arange(len(corpus.core), dtype=np.int64)
    if not corpus.contexts:
        return np.zeros(len(number), np.int32)
    context = number < corpus.contexts
    first = clustered(docs, text, corpus, core, np.where(context, number, -1), corpus.contexts, classes, rounds)
    if context.all():
        return first
    cells = np.where(context, number, corpus.contexts + first)
    return clustered(docs, text, corpus, core, cells, corpus.contexts + classes, classes, rounds)


def clustered(
    docs: DataFrame, text: str, corpus: Corpus, core, cells: np.ndarray, side: int, classes: int, rounds: int
) -> np.ndarray:
    """Class of each core word, by the cells of its neighbours; 0 where none is counted."""
    out = np.zeros(len(corpus.core), np.int32)
    stage, width = Stage(docs.sparkSession), 2 * side
    vectors = stage.keep(neighbours(docs, text, core, cells, side), "vectors")
    top = vectors.where(F.col("w") < corpus.contexts).orderBy("w").toArrow().combine_chunks()
    if not top.num_rows:
        return out
    seeds = choose_seeds(_dense(top.to_batches()[0], "cells", "n", width), classes)
    shares = exchange(vectors, width, seeds, rounds)
    shared = docs.sparkSession.sparkContext.broadcast(shares)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 1000):
                part = batch.slice(at, 1000)
                k = (_dense(part, "cells", "n", width) @ shared.value.T).argmax(1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column("w"), pa.array(k)], ["w", "k"])

    rows = vectors.mapInArrow(run, "w int, k int").toArrow()
    out[rows.column("w").to_numpy()] = rows.column("k").to_numpy()
    stage.drop(vectors)
    return out


def _histories(numbers: np.ndarray, starts: np.ndarray, classes: np.ndarray, none: int) -> np.ndarray:
    if not len(classes):
        return np.full(len(numbers), none)
    back = before(numbers, starts)
    return np.where(back >= 0, classes[numbers[np.maximum(back, 0)]], none)


def rare_tokens(docs: DataFrame, text: str, key: str, train: str, core, classes, count: int) -> DataFrame:
    """One row for each token that is not core: word (hash), h, key, train; and, with key null, sums of core tokens
    of training documents: n of class k after history h."""
    source = docs.select(F.col(key).alias("key"), F.col(train).alias("train"), F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, kinds = Reader(core.value), classes.value
        sums = np.zeros((count + 1, count), np.int64)
        digest = xxhash.xxh3_64_intdigest
        names = ["word", "h", "key", "train", "k", "n"]
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                tokens, numbers, starts = reader.read(raw(part.column("_text")))
                h = _histories(numbers, starts, kinds, count)
                sizes = np.diff(np.append(starts, len(numbers)))
                learn = np.repeat(np.array(part.column("train").to_pylist(), bool), sizes)
                seen = np.flatnonzero(learn & (numbers >= 0))
                np.add.at(sums, (h[seen], kinds[numbers[seen]]), 1)
                rare = np.flatnonzero(numbers < 0)
                hashes = np.array([digest(tokens[i]) for i in rare.tolist()], np.uint64).astype(np.int64)
                doc = np.repeat(np.arange(part.num_rows), sizes)[rare]
                blank = pa.nulls(len(rare), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [pa.array(hashes), pa.array(h[rare].astype(np.int32)), part.column("key").take(pa.array(doc)), pa.array(learn[rare]), blank, blank.cast(pa.int64())],
                    names,
                )
        h, k = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(len(h), pa.int64()), pa.array(h.astype(np.int32)), pa.nulls(len(h), pa.int64()), pa.nulls(len(h), pa.bool_()), pa.array(k.astype(np.int32)), pa.array(sums[h, k])],
            names,
        )

    return source.mapInArrow(run, "word bigint, h int, key bigint, train boolean, k int, n bigint")


def rare_classes(rare: DataFrame, moves: np.ndarray, count: int) -> DataFrame:
    """word, n, k, hs, ns: each other word's class, by the likelihood of the histories it was seen after."""
    spark = rare.sparkSession
    per = rare.where("train and word is not null").groupBy("word", "h").agg(F.count("*").alias("n"))
    per = per.groupBy("word").agg(F.sum("n").alias("n"), F.collect_list("h").alias("hs"), F.collect_list("n").alias("ns"))
    smooth = moves + 0.5
    gain = spark.sparkContext.broadcast(np.log(smooth / smooth.sum(1, keepdims=True)) - np.log(smooth.sum(0) / smooth.sum()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _dense(batch, "hs", "ns", count + 1)
            k = (x @ gain.value).argmax(1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("word", "n", "hs", "ns")], pa.array(k)], ["word", "n", "hs", "ns", "k"])

    return per.mapInArrow(run, "word bigint, n bigint, hs array<int>, ns array<bigint>, k int")


def score(
    docs: DataFrame, train: Column, doc_id: str = "doc_id", text: str = "text", *, classes: int = CLASSES, rounds: int = ROUNDS
) -> DataFrame:
    """doc_id, train, n_tokens, n_known, train_tokens, base_score, score: one row per row of ``docs``, log10.

    Null text is empty: its end token alone. Without training documents every token is unknown. Rows equal in id and
    text get the same scores.
    """
    spark, stage = docs.sparkSession, Stage(docs.sparkSession)
    source = docs.select(
        F.col(doc_id).alias("doc_id"), F.coalesce(train, F.lit(False)).alias("train"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text")
    )
    source = source.withColumn("key", F.xxhash64("doc_id", "text"))
    learned = source.where("train")
    corpus = gather(learned, "text")
    core = spark.sparkContext.broadcast(corpus.core)
    kinds = core_classes(learned, "text", corpus, core, classes, rounds)
    shared = spark.sparkContext.broadcast(kinds)

    rare = stage.keep(rare_tokens(source, "text", "key", "train", core, shared, classes), "rare")
    moves = np.zeros((classes + 1, 2 * classes))
    for r in rare.where("word is null").groupBy("h", "k").agg(F.sum("n").alias("n")).collect():
        moves[r["h"], r["k"]] = r["n"]
    other = stage.keep(rare_classes(rare, moves[:, :classes], classes), "other")
    cells = other.select("k", F.inline(F.arrays_zip("hs", "ns"))).groupBy("hs", "k").agg(F.sum("ns").alias("n"))
    for r in cells.collect():
        moves[r["hs"], classes + r["k"]] = r["n"]

    share = moves.sum(0) / max(moves.sum(), 1)
    follow = (moves + share) / (moves.sum(1, keepdims=True) + 1)
    emit = np.zeros(2 * classes)
    np.divide(1.0, moves.sum(0), out=emit, where=moves.sum(0) > 0)
    cell = follow * emit  # times a word's count: its class probability
    flat = corpus.once / corpus.tokens if corpus.tokens else 1.0
    table = spark.sparkContext.broadcast(cell)

    known = 1 - corpus.unknown

    def core_part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader, ks, cells = Reader(core.value), shared.value, table.value
        n = np.append(corpus.counts, 0).astype(float)
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                tokens, numbers, starts = reader.read(raw(part.column("text")))
                h = _histories(numbers, starts, ks, classes)
                own = numbers >= 0
                c, k = n[numbers], (ks[numbers] if len(ks) else np.zeros(len(numbers), int))
                plain = np.where(own, np.log10((c + 1) * corpus.unknown), 0.0)
                mixed = (1 - flat) * cells[h, k] * c + flat * (c + 1) / max(corpus.tokens + corpus.distinct, 1)
                full = np.where(own, np.log10(np.maximum(mixed * known, 1e-300)), 0.0)
                sums = [np.add.reduceat(v, starts) for v in (plain, full, own.astype(np.int64))]
                sizes = np.diff(np.append(starts, len(numbers)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("train"), part.column("key"), *[pa.array(v) for v in (sizes, *sums)]],
                    ["doc_id", "train", "key", "n_tokens", "base", "full", "known"],
                )

    schema = source.select("doc_id", "train", "key").schema
    for name, kind in (("n_tokens", "long"), ("base", "double"), ("full", "double"), ("known", "long")):
        schema = schema.add(name, kind)
    rows = stage.keep(source.mapInArrow(core_part, schema), "scores")

    slots = [(h, k, float(cell[h, classes + k])) for h in range(classes + 1) for k in range(classes)]
    slots = F.broadcast(spark.createDataFrame(slots, "h int, k int, p double"))  # classes squared rows
    met = rare.where("word is not null").select("word", "h", "key").join(other.select("word", "n", "k"), "word", "left")
    met = met.join(slots, ["h", "k"], "left")
    n = F.coalesce("n", F.lit(0))
    mixed = F.lit(1 - flat) * F.coalesce("p", F.lit(0.0)) * n + F.lit(flat) * (n + 1) / F.lit(float(max(corpus.tokens + corpus.distinct, 1)))
    rest = met.groupBy("key").agg(
        F.sum(F.log10((n + 1) * F.lit(corpus.unknown))).alias("base2"),
        F.sum(F.when(F.col("n").isNull(), math.log10(corpus.unknown)).otherwise(F.log10(mixed * F.lit(known)))).alias("full2"),
        F.count("n").alias("known2"),
    )
    copies = rows.groupBy("key").agg(F.count("*").alias("copies"))
    rest = stage.keep(rest.join(copies, "key").select(
        "key", (F.col("base2") / F.col("copies")).alias("base2"), (F.col("full2") / F.col("copies")).alias("full2"),
        (F.col("known2") / F.col("copies")).cast("bigint").alias("known2"),
    ), "rest")
    none = F.lit(0.0)
    return rows.join(rest, "key", "left").select(
        "doc_id", "train", "n_tokens", (F.col("known") + F.coalesce("known2", F.lit(0))).alias("n_known"),
        F.lit(corpus.tokens).cast("bigint").alias("train_tokens"),
        (F.col("base") + F.coalesce("base2", none)).alias("base_score"), (F.col("full") + F.coalesce("full2", none)).alias("score"),
    )
