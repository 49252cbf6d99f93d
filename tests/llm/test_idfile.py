import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from foliospark.llm import idfile

PATH = public_tokenizers.path("byte_bpe_50k.json")


def plain(rows):
    """(doc_id, start, n_tokens, crc) by the tokenizer on whole texts; rows in the order of the files."""
    known, out, start = Tokenizer.from_file(PATH), [], 0
    for number, text in rows:
        ids = np.array([*known.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((number, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


TEXTS = [
    "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n\nb  \n", "\n a", "Don't we'll 'S I'M", "x y  z", "  two  spaces  ", "tab\tand \t mixed",
    "Größe über—die Straße, naïve ½ ²³ Ⅷ", "漢字 と かな 😀!? a😀b", "line.\nNext line.\r\nThird", "a\x1cb \x1f c", "<|endoftext|>", "a <|endoftext|> b<|endoftext|>",
    "1234 56,78 v1.2.3", "__init__ x=y;#$%", "µ ª º × ÷ ǅ ɏ ɐ", "é ́x ​zero", "’s ’t 'st", "\x85\x0b\x0c ok", "   sep",
]


def test_words_alone_give_the_tokenizers_ids():
    known, mine = Tokenizer.from_file(PATH), idfile.Encoder(PATH)
    dealer = random.Random(3)
    made = ["".join(dealer.choice(["a", "B", " ", " ", "  ", "\n", "\t", "é", "9", "'s", ",", " ", "字", "word"]) for _ in range(30)) for _ in range(3000)]
    texts = TEXTS + made
    found = [np.frombuffer(mine.encode(t.encode()), "<u2").tolist() for t in texts]
    assert found == [e.ids for e in known.encode_batch(texts, add_special_tokens=False)]


def test_pieces_of_long_texts_tokenise_alone(monkeypatch):
    monkeypatch.setattr(idfile, "PIECE", 40)
    known, mine = Tokenizer.from_file(PATH), idfile.Encoder(PATH)
    text = "One line of  words,\n\n and über another; " * 30
    cut = list(idfile.pieces(text.encode()))
    assert len(cut) > 10 and b"".join(cut).decode() == text
    found = np.frombuffer(b"".join(map(mine.encode, cut)), "<u2").tolist()
    assert found == known.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("values", [
    [], [0], [0, 0, 0], [5], list(range(1000)), [0] * 700 + [10**6] * 300, [2**63, 2**64 - 1], [7, 7, 2**40, 2**40 + 1],
    sorted(random.Random(1).randrange(10**9) for _ in range(3001)), [i // 3 for i in range(2000)],
])
def test_elias_fano_gives_back_every_number(values):
    made = idfile.EliasFano.loaded(idfile.EliasFano.of(np.array(values, np.uint64)).dumped())
    assert [made.select(i) for i in range(len(values))] == values
    assert [int(v) for b in made.blocks() for v in b] == values


def test_elias_fano_is_near_minimal():
    n, top = 100_000, 50_000_000
    made = idfile.EliasFano.of(np.sort(np.random.default_rng(1).integers(0, top, n)))
    bits = 8 * len(made.dumped()) / n
    assert bits < np.log2(top / n) + 2.3  # 64-bit offsets take 64


def test_odd_rows(spark, odd, empty):
    rows = odd.collect()
    found = sorted(idfile.read(spark, idfile.write(odd, PATH)).collect(), key=lambda r: r.start)
    assert [r.doc_id for r in found] == sorted((r.doc_id for r in rows), key=lambda i: (i is not None, i))
    assert [r.start for r in found] == [sum(x.n_tokens for x in found[:i]) for i in range(len(found))]
    of = sorted((i, n, c) for i, _, n, c in plain([(r.doc_id or 0, r.text) for r in rows]))
    assert sorted((r.doc_id or 0, r.n_tokens, r.ids_crc32) for r in found) == of
    assert idfile.read(spark, idfile.write(empty, PATH)).count() == 0


def test_whole_table_round_trip_over_many_files(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    manifest = idfile.write(docs.repartition(5, "n_chars"), PATH, file_ids=9000)
    assert manifest.count() > 5
    found = sorted(map(tuple, idfile.read(spark, manifest).collect()), key=lambda r: r[1])
    assert found == plain(docs.orderBy("doc_id").select("doc_id", "text").collect())


def test_any_document_at_once(spark, tmp_path):
    path = str(tmp_path / "a.ids")
    writer = idfile.Writer(path, False)
    dealer, docs = random.Random(5), []
    for i in range(2000):
        ids = [dealer.randrange(50_000) for _ in range(dealer.choice([0, 1, 7, 300]))]
        docs.append((None if i < 3 else i * 5 - 4000, ids))
        writer.add(np.array(ids, "<u2").tobytes())
        writer.end(docs[-1][0])
    writer.close()
    file = idfile.IdFile(f"file:{path}")
    for i in (0, 2, 3, 255, 256, 1024, 1999):
        number, ids = docs[i]
        assert file.document(i).tolist() == ids and file.number(i) == number
        if number is not None:
            assert file.find(number) == i
    assert file.find(1) is None and file.find(10**12) is None
    starts = [(n, a, e) for ns, ss, es in file.documents() for n, a, e in zip(ns.tolist(), ss.tolist(), es.tolist())]
    assert [n for n, *_ in starts] == [n for n, _ in docs] and [e - a for _, a, e in starts] == [len(i) for _, i in docs]


def test_wide_ids_and_other_files(tmp_path):
    path = str(tmp_path / "b.ids")
    writer = idfile.Writer(path, True)
    writer.add(np.array([70_000, 1], "<u4").tobytes())
    writer.end(-(2**62))
    writer.close()
    assert idfile.IdFile(path).document(0).tolist() == [70_000, 1] and idfile.IdFile(path).number(0) == -(2**62)
    (tmp_path / "c").write_bytes(bytes(200))
    with pytest.raises(ValueError):
        idfile.IdFile(str(tmp_path / "c"))


def test_tables_stay_bounded(monkeypatch):
    monkeypatch.setattr(idfile, "CACHE", 10)
    found = idfile.Table(lambda k: k * 2)
    assert [found[i % 35] for i in range(200)] == [i % 35 * 2 for i in range(200)]
    assert len(found) <= 10 and len(found.old) <= 10
