import math
import zlib
from collections import Counter

from conftest_llm import prose
from pyspark.sql import functions as F

from foliospark.llm import classlm
from foliospark.llm.queries import op5_class_ngrams


def tokens(text):
    return [*(text or "").encode().lower().split(), b"\n"]


def plain_base(rows):
    counts = Counter(w for _, t, train in rows if train for w in tokens(t))
    n, v = sum(counts.values()), len(counts)
    return n, [(sum(math.log10((counts[w] + 1) / (n + v + 1)) for w in tokens(t)), sum(counts[w] > 0 for w in tokens(t)), len(tokens(t))) for _, t, _ in rows]


def close(a, b):
    return abs(a - b) <= 1e-8 * max(1, abs(a))


def test_base_counts_and_gain_on_held_out(spark):
    folder = "/root/testdata/sf0.01"
    found = {r.doc_id: r for r in op5_class_ngrams(spark, folder).collect()}
    rows = [(r.doc_id, r.text, zlib.crc32(str(r.doc_id).encode()) % 7 != 2) for r in spark.read.parquet(f"{folder}/documents.parquet").collect()]
    n, base = plain_base(rows)
    for (i, _, train), (score, known, size) in zip(rows, base):
        r = found[i]
        assert close(r.base_score, score) and (r.n_known, r.n_tokens, r.train_tokens, r.held_out) == (known, size, n, not train)
    held = [r for r in found.values() if r.held_out]
    assert sum(r.score for r in held) > sum(r.base_score for r in held) + 0.1 * sum(r.n_tokens for r in held)


def test_words_outside_the_core_are_joined(spark, monkeypatch):
    """With few core words, most counts come through the join; counts and base scores stay exact."""
    monkeypatch.setattr(classlm, "CORE", 6)
    monkeypatch.setattr(classlm, "CONTEXT", 4)
    rows = [(i, ("The of and " * 3 + prose(i % 25, 40)).replace("a", "A"), i % 4 != 0) for i in range(60)]
    rows += [(60, "never seen words", False), (61, None, True), (62, "", False), (5, rows[5][1], True), (None, "of the", False), (None, "of the", False)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, train boolean")
    found = classlm.score(docs, F.col("train"), classes=4, rounds=3).collect()
    n, base = plain_base(rows)
    mine = sorted(((r.doc_id or -1, r.n_tokens), r.n_known, r.train_tokens, round(r.base_score, 6)) for r in found)
    assert mine == sorted(((i or -1, size), known, n, round(score, 6)) for (i, *_), (score, known, size) in zip(rows, base))
    assert all(r.score <= 0 for r in found)


def test_probabilities_of_a_history_sum_to_one(spark, monkeypatch):
    """Over the whole vocabulary and the unknown word, after any history that training has seen."""
    for bits in (21, 5):
        monkeypatch.setattr(classlm, "CORE", bits)
        train = [(i, "the cat of a dog the " + prose(i, 6), True) for i in range(30)]
        vocabulary = sorted({w for _, t, _ in train for w in tokens(t)} - {b"\n"})
        asked = [(100 + i, f"the {w.decode()}", False) for i, w in enumerate(vocabulary)] + [(98, "the", False), (99, "the neverseen", False)]
        docs = spark.createDataFrame(train + asked, "doc_id long, text string, train boolean")
        found = {r.doc_id: r.score for r in classlm.score(docs, F.col("train"), classes=3, rounds=2).collect() if r.doc_id >= 98}
        # P(the, w, end) differs from P(the) P(w | the) by the end's probability after w, so sum over what follows is at most one
        assert sum(10 ** found[100 + i] for i in range(len(vocabulary))) + 10 ** found[98] + 10 ** found[99] <= 1


def test_odd_rows(odd, empty):
    found = classlm.score(odd, F.col("doc_id") != 3).collect()
    assert len(found) == odd.count()
    assert sum(r.n_tokens == 1 for r in found) == 4
    assert classlm.score(empty, F.lit(True)).count() == 0
    none = classlm.score(odd, F.lit(False)).collect()
    assert all(r.n_known == r.train_tokens == 0 and r.base_score == r.score == 0 for r in none)


def test_neighbours_that_are_not_frequent_count(spark, monkeypatch):
    """x and y words have the same frequent neighbours; only the rare words around tell them apart."""
    monkeypatch.setattr(classlm, "CONTEXT", 4)
    rows = []
    for i in range(300):
        kind = "xy"[i % 2]
        rows.append((f"the {kind}a{i % 7} {kind}b{i % 5} the the {kind}b{i % 5} {kind}a{i % 7} the",))
    docs = spark.createDataFrame(rows, "text string")
    corpus = classlm.gather(docs, "text")
    core = spark.sparkContext.broadcast(corpus.core)
    words = {w: i for i, w in enumerate(corpus.core)}
    assert corpus.contexts == 2 and corpus.core[:2] == [b"the", b"\n"]
    cells = [0, 1, *[2 + (w[:1] == b"y") for w in corpus.core[2:]]]
    found = {r.w: dict(zip(r.cells, r.n)) for r in classlm.neighbours(docs, "text", core, classlm.np.array(cells), 4).collect()}
    pairs = Counter()
    for (t,) in rows:
        seen = tokens(t)
        for a, b in zip(seen, seen[1:]):
            pairs[words[b], cells[words[a]]] += 1
            pairs[words[a], 4 + cells[words[b]]] += 1
    assert {(w, c): n for w, held in found.items() for c, n in held.items()} == pairs
    counted = []
    plain = classlm.neighbours
    monkeypatch.setattr(classlm, "neighbours", lambda *a: counted.append(a[3]) or plain(*a))
    classlm.core_classes(docs, "text", corpus, core, 4, 3)
    assert (counted[-1] >= 0).all() and len(counted[-1]) == len(corpus.core)
