"""Bounded-space online packing of tokenised documents into fixed windows.

Each partition of the documents keeps ``open_windows`` unfinished windows. A document
first fills whole windows of its own; its tail goes into the open window it
fits best. If it fits none, the fullest is topped up with the head of the tail
and emitted, and the rest of the tail is placed again. At the end of a partition the
unfinished windows go, as pieces with their ids, to a second round that packs
the leftovers of many partitions the same way and joins what is still open, so
that less than one window for each task remains; that is written as
windows of powers of two, which need no padding.

Memory in a task is the open windows and one Arrow batch. The tokenizer splits text
at white space, so the ids of a word are looked up once and kept in a table of
the ``CACHE`` to twice ``CACHE`` words used last.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Stage, raw

WINDOW = 2048
OPEN_WINDOWS = 32
END_ID = 1
CACHE = 500_000  # words
MERGE_PIECES = 4096  # leftover pieces, under a window each, that meet in one task
PIECE = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint, ids binary"

# Fixed values of the tokenizer: its pattern, here for Latin letters only, and the signs that stand for bytes.
PLAIN = re.compile(r"[\x21-\x7eÀ-ÖØ-öø-ÿ]+")
PART = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
_SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTE_SIGNS = {b: 256 + i for i, b in enumerate(b for b in range(256) if b not in _SHOWN)}

_ENCODERS: dict[str, "Encoder"] = {}


class Recent:
    """A table of what was used lately: when ``CACHE`` new entries came, the older half is dropped."""

    def __init__(self):
        self.young: dict = {}
        self.old: dict = {}

    def settle(self, wanted: set) -> list:
        """Make room, keep what is wanted and known; return what is wanted and unknown."""
        if len(self.young) > CACHE:
            self.young, self.old = {}, self.young
        missing = wanted.difference(self.young)
        kept = missing & self.old.keys()
        self.young.update((w, self.old[w]) for w in kept)
        return list(missing - kept)


class Encoder:
    """Ids of texts as little-endian 32-bit bytes, word by word through a bounded table.

    The tokenizer cuts text at white space first, so words can be looked up alone. Words of plain or
    Latin letters, digits and signs are cut by the tokenizer's own pattern here and each part is put to
    its merge model; any other word goes to the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.words, self.parts = Recent(), Recent()

    def learn(self, texts: Iterable[list[bytes]]) -> None:
        """Look up every word of the texts that is not known yet."""
        new = self.words.settle(set().union(*texts))
        plain, other = {}, []
        for word in new:
            text = word.decode("utf-8", "replace")
            if PLAIN.fullmatch(text) and "<|" not in text:
                plain[word] = PART.findall(text.lower())
            else:
                other.append(word)
        model = self.tokenizer.model
        for part in self.parts.settle(set().union(*plain.values())):
            mapped = part.encode().decode("latin-1").translate(BYTE_SIGNS)
            self.parts.young[part] = np.array([t.id for t in model.tokenize(mapped)], "<u4").tobytes()
        ids = self.parts.young.__getitem__
        self.words.young.update((w, b"".join(map(ids, found))) for w, found in plain.items())
        whole = self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in other], add_special_tokens=False)
        self.words.young.update(zip(other, [np.array(e.ids, "<u4").tobytes() for e in whole]))

    def encode(self, words: list[bytes]) -> bytes:
        return b"".join(map(self.words.young.__getitem__, words))


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


class Packer:
    """Places pieces (doc_id, start, ids as bytes, doc_tokens) and calls ``emit`` for each finished window."""

    def __init__(self, emit: Callable[[list, int], None], window: int = WINDOW, open_windows: int = OPEN_WINDOWS):
        self.emit, self.window, self.most = emit, window, open_windows
        self.open: list[tuple[int, list]] = []  # (tokens, pieces)

    def add(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        size = self.window * 4
        whole = len(ids) // size * size
        for at in range(0, whole, size):
            self.emit([(doc_id, start + at // 4, ids[at : at + size], doc_tokens)], self.window)
        if whole < len(ids):
            self._place(doc_id, start + whole // 4, ids[whole:], doc_tokens)

    def _place(self, doc_id, start: int, ids: bytes, doc_tokens: int) -> None:
        need = len(ids) // 4
        room = [i for i, (used, _) in enumerate(self.open) if used + need <= self.window]
        if room:
            best = max(room, key=lambda i: self.open[i][0])
            used, pieces = self.open[best]
            pieces.append((doc_id, start, ids, doc_tokens))
            if used + need == self.window:
                self.open.pop(best)
                self.emit(pieces, self.window)
            else:
                self.open[best] = (used + need, pieces)
        elif len(self.open) < self.most:
            self.open.append((need, [(doc_id, start, ids, doc_tokens)]))
        else:
            fullest = max(range(len(self.open)), key=lambda i: self.open[i][0])
            used, pieces = self.open.pop(fullest)
            cut = self.window - used
            self.emit([*pieces, (doc_id, start, ids[: cut * 4], doc_tokens)], self.window)
            self._place(doc_id, start + cut, ids[cut * 4 :], doc_tokens)

    def merge(self) -> None:
        """Join the open windows: all but the last are filled up and emitted."""
        rest, self.open = sorted(self.open, key=lambda w: -w[0]), []
        self.most = 1
        for _, pieces in rest:
            for piece in pieces:
                self._place(*piece)

    def powers(self) -> None:
        """Emit what is left in windows of powers of two."""
        for used, pieces in self.open:
            pieces = list(pieces)
            while used:
                size = 1 << (used.bit_length() - 1)
                used, want, taken = used - size, size, []
                while want:
                    doc_id, start, ids, total = pieces.pop(0)
                    n = min(want, len(ids) // 4)
                    taken.append((doc_id, start, ids[: n * 4], total))
                    if n * 4 < len(ids):
                        pieces.insert(0, (doc_id, start + n, ids[n * 4 :], total))
                    want -= n
                self.emit(taken, size)
        self.open = []


class _Rows:
    """Collects emitted windows as rows; sequence ids are unique over tasks and rounds."""

    def __init__(self, keep_ids: bool, round_number: int):
        self.rows: list[tuple] = []
        self.next = (TaskContext.get().partitionId() * 2 + round_number) << 32
        self.keep_ids = keep_ids

    def emit(self, pieces: list, size: int) -> None:
        at = 0
        for doc_id, start, ids, total in pieces:
            length = len(ids) // 4
            self.rows.append((doc_id, start, length, zlib.crc32(ids), total, self.next, at, None))
            at += length
        self.next += 1

    def leave(self, pieces: list) -> None:
        for doc_id, start, ids, total in pieces:
            self.rows.append((doc_id, start, len(ids) // 4, None, total, None, None, ids))

    def take(self) -> pa.RecordBatch:
        types = [pa.int64()] * 7 + [pa.binary()]
        columns = list(zip(*self.rows)) or [()] * 8
        self.rows = []
        names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "ids"]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)


def pack(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", *, window: int = WINDOW,
    open_windows: int = OPEN_WINDOWS, end_id: int = END_ID,
) -> DataFrame:
    """One row for each piece of a document: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end id alone. Rows with the same or a null doc_id are packed each, as documents
    of their own. Every id lies in exactly one piece; sequences hold ``window`` ids, or a smaller power of two.
    ``tokenizer`` is the path of a tokenizer file that every executor can read.
    """
    stage = Stage(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))

    def first(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, rows = encoder(tokenizer), _Rows(False, 0)
        packer = Packer(rows.emit, window, open_windows)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                texts = [t.split() for t in raw(part.column("text"))]
                known.learn(texts)
                for number, split in zip(part.column("doc_id").to_pylist(), texts):
                    ids = known.encode(split) + end
                    packer.add(number, 0, ids, len(ids) // 4)
            yield rows.take()
        for _, pieces in packer.open:
            rows.leave(pieces)
        yield rows.take()

    def second(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(False, 1)
        packer = Packer(rows.emit, window, open_windows)
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("doc_id", "start", "ids", "doc_tokens")]
            for piece in zip(*columns):
                packer.add(*piece)
            yield rows.take()
        packer.merge()
        packer.powers()
        yield rows.take()

    packed = stage.keep(source.mapInArrow(first, PIECE), "packed")
    left = packed.where("ids is not null").select("doc_id", "start", "ids", "doc_tokens")
    tasks = -(-left.count() // MERGE_PIECES) or 1
    merged = stage.keep(left.repartition(tasks, "doc_id", "start").mapInArrow(second, PIECE), "merged")
    return packed.where("ids is null").unionByName(merged).drop("ids")
