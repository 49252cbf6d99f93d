import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from foliospark.llm import packing

PATH = public_tokenizers.path("word_bpe_49k.json")


def check(rows, texts):
    """Every id of every document lies in one piece, sequences have no gaps; returns their lengths."""
    known = Tokenizer.from_file(PATH)
    ids = defaultdict(list)
    for i, t in texts:
        ids[i].append(np.array(known.encode(t or "", add_special_tokens=False).ids + [1], "<u4"))
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        sequences[r.sequence_id].append(r)
    assert pieces.keys() == ids.keys()
    for i, found in pieces.items():
        assert sum(r.length for r in found) == sum(map(len, ids[i]))
        if len(ids[i]) == 1:
            own, at = ids[i][0], 0
            for r in sorted(found, key=lambda r: r.start):
                assert (r.start, r.doc_tokens) == (at, len(own))
                assert r.ids_crc32 == zlib.crc32(own[at : at + r.length].tobytes())
                at += r.length
    lengths = []
    for found in sequences.values():
        at = 0
        for r in sorted(found, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        lengths.append(at)
    return lengths


def test_odd_rows_round_trip(odd, empty):
    lengths = check(packing.pack(odd, PATH).collect(), [(r.doc_id, r.text) for r in odd.collect()])
    assert all(n == 2048 or n & (n - 1) == 0 for n in lengths)
    assert packing.pack(empty, PATH).count() == 0


def test_whole_table_round_trip(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    lengths = check(packing.pack(docs.repartition(5), PATH).collect(), [(r.doc_id, r.text) for r in docs.collect()])
    assert max(lengths) == 2048 and all(n & (n - 1) == 0 for n in lengths)


def test_words_alone_give_the_tokenizers_ids():
    known, mine = Tokenizer.from_file(PATH), packing.Encoder(PATH)
    for t in ["Don't 'S 12,3 über--Ñandú", "á ́b x\x1cy \x85z", "ΣΑΣ ﬁ <|endoftext|> a<|endoftext|>b", "ẹ́ 漢字 😀!?", "", "a\u00a0b ªµº ÷×"]:
        split = t.encode().split()
        mine.learn([split])
        assert np.frombuffer(mine.encode(split), "<u4").tolist() == known.encode(t, add_special_tokens=False).ids


def test_best_fit_with_few_open_windows():
    done = []
    packer = packing.Packer(lambda pieces, size: done.append((size, [(p[0], p[1], len(p[2]) // 4) for p in pieces])), 10, 2)
    for i, n in enumerate([6, 7, 3, 25, 9]):
        packer.add(i, 0, bytes(4 * n), n)
    assert done == [
        (10, [(1, 0, 7), (2, 0, 3)]), (10, [(3, 0, 10)]), (10, [(3, 10, 10)]),
        *done[3:],
    ]
    assert all(sum(n for *_, n in pieces) == size for size, pieces in done)
    packer.merge()
    packer.powers()
    assert sum(n for _, pieces in done for *_, n in pieces) == 50
    assert all(sum(n for *_, n in pieces) == size for size, pieces in done)


def test_the_table_of_words_stays_bounded(monkeypatch):
    monkeypatch.setattr(packing, "CACHE", 10)
    mine = packing.Encoder(PATH)
    for at in range(30):
        mine.learn([[f"w{at * 5 + j}".encode() for j in range(5)] + [b"the"]])
        assert len(mine.words.young) + len(mine.words.old) <= 40
    assert b"the" in mine.words.young
