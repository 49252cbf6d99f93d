import random

import numpy as np
from conftest_llm import prose

from foliospark.llm import chunks


def test_hash_is_that_of_the_rolling_loop():
    data = prose(1, 200).encode()
    slow, h = [], 0
    for i in range(len(data)):
        window = data[max(0, i - chunks.GEAR_WINDOW + 1) : i + 1]
        h = 0
        for b in window:
            h = ((h << 1) + int(chunks.GEAR[b])) % (1 << 32)
        slow.append(h)
    assert chunks.gear_hashes(np.frombuffer(data, np.uint8)).tolist() == slow


def test_chunks_tile_the_text_and_survive_an_insertion():
    r = random.Random(2)
    for text in ("", "a", "é" * 3000, prose(3, 500), "".join(chr(r.randrange(32, 1000)) for _ in range(3000))):
        starts, lengths, words, digests = chunks.text_chunks(text.encode())
        assert sum(lengths) == len(text) and sum(words) == len(text.encode().split())
        assert all(a + n == b for a, n, b in zip(starts, lengths, starts[1:]))
    text = prose(4, 400)
    moved = text[:700] + " put in between " + text[700:]
    before, after = (set(chunks.text_chunks(t.encode())[3]) for t in (text, moved))
    assert len(before - after) <= 3


def plain_repeat(text, others, size=50):
    """Words of text that lie in a passage of ``size`` words or more that another text holds too."""
    own = text.split()
    grams = {tuple(w[i : i + size]) for t in others for w in [t.split()] for i in range(len(w) - size + 1)}
    return any(tuple(own[i : i + size]) in grams for i in range(len(own) - size + 1))


def test_passages_are_caught_and_other_texts_left_alone(spark):
    passages = [prose(100 + s, 55) for s in range(8)]
    texts = [prose(s, 150 + s) for s in range(60)]
    for i in range(40):
        at = texts[i].split()
        texts[i] = " ".join([*at[: 10 + i], passages[i % 8], *at[10 + i :]])
    rows = list(enumerate(texts))
    found = chunks.repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    expected = {i for i, t in rows if plain_repeat(t, [u for j, u in rows if j != i])}
    assert expected == set(range(40)) == {r.doc_id for r in found}
    assert {r.doc_id for r in found if r.stays} == set(range(8))
    for r in found:
        run = texts[r.doc_id][r.start : r.end]
        middle = " ".join(passages[r.doc_id % 8].split()[15:40])
        assert middle in run and middle in texts[r.first_doc_id] and abs(len(run.split()) - r.n_words) <= 1
    left = {r.doc_id: r.text for r in chunks.repeats_removed(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert all(left[i] == texts[i] for i in (*range(8), *range(40, 60)))
    assert all(len(left[i].split()) <= len(texts[i].split()) - 25 for i in range(8, 40))


def test_odd_rows(odd, empty):
    found = chunks.repeats(odd).collect()
    assert {(r.doc_id, r.stays) for r in found if r.first_doc_id == 1 and r.n_words > 40} >= {(1, True), (2, False)}
    left = chunks.repeats_removed(odd)
    assert left.columns == odd.columns and left.count() == odd.count()
    kept = {r.doc_id: r.text for r in left.collect()}
    assert kept[2] == "" and kept[3] is None and kept[4] == "" and kept[8] == "x"
    assert chunks.repeats(empty).count() == chunks.repeats_removed(empty).count() == 0
