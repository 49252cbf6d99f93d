"""Token ids of documents in binary files with Elias-Fano encoded boundaries.

``write`` sorts documents by id over all tasks (nulls first), tokenises them and lets each task stream its
stretch into files of at most about ``FILE_IDS`` ids. ``read`` goes over the files, one file to a task.
``IdFile`` gives any document of a file at once, by place or by id.

A file, little-endian throughout:

    ids        unsigned 16-bit integers, or 32-bit ones where the vocabulary needs them
    ends       end of every document in ids, Elias-Fano
    numbers    document ids above the smallest, Elias-Fano; documents without an id come first and have none
    trailer    ``TRAILER``: the sizes that place the parts, then a magic number

An Elias-Fano list of n numbers below u keeps the lowest log2(u / n) bits of each as they are and the rest in
unary: one bit set for number i at (high part + i). That is two bits and the low ones for a document. Every
``SAMPLE``-th set bit has its place stored in 32 bits; select starts there, so there is no table of 64-bit offsets.

Files have names of their own for every attempt of a task, and only those of finished attempts are in the
manifest, so lost executors and repeated tasks leave nothing wrong behind.
"""

from __future__ import annotations

import re
import struct
import sys
import uuid
import zlib
from array import array
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.llm.common import Stage, raw
from foliospark.llm.packing import BYTE_SIGNS, CACHE

END_ID = 2
FILE_IDS = 1 << 28  # ids after which a file is closed; the document at hand is finished first
SAMPLE = 256  # set bits between two stored places
PIECE = 1 << 20  # bytes of a long text that are tokenised at once
TRAILER = struct.Struct("<QQQqBQQQQ8s")
MAGIC = b"EFTOKEN1"
MANIFEST = "slice int, file int, path string, n_docs bigint, n_ids bigint"

# Fixed values of the tokenizer: its white space, its pattern (here for Latin letters only), its special text.
SPACES = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
LATIN = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f"
PART = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LATIN}]+| ?[0-9]+| ?[^{SPACES}{LATIN}0-9]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+"
)
UNIT = re.compile(rf" ?[^{SPACES}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
PLAIN = re.compile(rf"[\t-\r\x20-\x7e{LATIN}]*")
BLANK = re.compile(rf"[{SPACES}]")
SPECIAL = b"<|endoftext|>"
SPACE_SIGN = chr(BYTE_SIGNS[32])
CUT = re.compile(rb"[!-~] [!-~]")

_ENCODERS: dict[str, "Encoder"] = {}


class Table(dict):
    """What ``make`` gives for a key, kept for the ``CACHE`` to twice ``CACHE`` keys used last."""

    def __init__(self, make: Callable[[Any], Any]):
        self.make, self.old = make, {}

    def __missing__(self, key):
        value = self.old[key] if key in self.old else self.make(key)
        if len(self) >= CACHE:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


class Encoder:
    """Ids of texts by a byte-level tokenizer, looked up word by word in a bounded table.

    A single space before a word belongs to it, so a text cut at its spaces falls into words whose ids do not depend
    on their neighbours. Where a word is empty or begins with other white space (several spaces in a row), the
    text goes through the pattern instead; a text with the special token goes to the tokenizer whole. Words of Latin
    letters, digits and signs are cut by the tokenizer's pattern here and each part is put to its merge model; any
    other word goes to the tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.wide = self.tokenizer.get_vocab_size() > 1 << 16
        self.words, self.parts, self.units = Table(self._word), Table(self._part), Table(self._whole)

    def packed(self, ids: list[int]) -> bytes:
        out = array("I" if self.wide else "H", ids)
        if sys.byteorder == "big":
            out.byteswap()
        return out.tobytes()

    def _whole(self, text: str) -> bytes:
        return self.packed(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _part(self, part: str) -> bytes:
        if part.isascii() and part.isprintable():
            mapped = part.replace(" ", SPACE_SIGN)
        else:
            mapped = part.encode().decode("latin-1").translate(BYTE_SIGNS)
        return self.packed([t.id for t in self.tokenizer.model.tokenize(mapped)])

    def _word(self, key: bytes) -> bytes | None:
        """A key with a space in front is the first word of a text, any other follows a space; None: no word of its own."""
        text = key.decode("utf-8", "replace")
        if text.startswith(" "):
            text = text[1:]
        elif not text or BLANK.match(text):
            return None
        else:
            text = " " + text
        if not PLAIN.fullmatch(text):
            return self._whole(text)
        return b"".join(map(self.parts.__getitem__, PART.findall(text)))

    def encode(self, text: bytes) -> bytes:
        if SPECIAL in text:
            return self._whole(text.decode("utf-8", "replace"))
        found = text.split(b" ")
        found[0] = b" " + found[0]
        try:
            return b"".join(map(self.words.__getitem__, found))
        except TypeError:  # a None among the words
            return b"".join(map(self.units.__getitem__, UNIT.findall(text.decode("utf-8", "replace"))))


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces that tokenise alone, cut at single spaces between visible ASCII signs."""
    at = 0
    while len(text) - at > PIECE and SPECIAL not in text and (cut := CUT.search(text, at + PIECE)):
        yield text[at : cut.start() + 1]
        at = cut.start() + 1
    yield text[at:]


class EliasFano:
    """Non-decreasing numbers from 0, each read by ``select`` without reading those before it."""

    def __init__(self, n: int, low_bits: int, low: np.ndarray, high: np.ndarray, places: np.ndarray):
        self.n, self.low_bits, self.low, self.high, self.places = n, low_bits, low, high, places

    @classmethod
    def of(cls, values: np.ndarray) -> "EliasFano":
        values = values.astype(np.uint64)
        n, top = len(values), int(values[-1]) if len(values) else 0
        bits = max((top // n).bit_length() - 1, 0) if n else 0
        kept = (values[:, None] >> np.arange(bits, dtype=np.uint64)) & np.uint64(1)
        low = np.packbits(kept.astype(np.uint8).ravel(), bitorder="little")
        ones = (values >> np.uint64(bits)).astype(np.int64) + np.arange(n)
        high = np.zeros(((int(ones[-1]) + 8) // 8 if n else 0) * 8, np.uint8)
        high[ones] = 1
        return cls(n, bits, low, np.packbits(high, bitorder="little"), ones[::SAMPLE].astype("<u4"))

    def dumped(self) -> bytes:
        head = struct.pack("<QBQQ", self.n, self.low_bits, len(self.low), len(self.high))
        return head + self.places.tobytes() + self.low.tobytes() + self.high.tobytes()

    @classmethod
    def loaded(cls, data: bytes) -> "EliasFano":
        n, bits, low, high = struct.unpack_from("<QBQQ", data)
        at = struct.calcsize("<QBQQ")
        places = np.frombuffer(data, "<u4", -(-n // SAMPLE), at)
        at += places.nbytes
        return cls(n, bits, np.frombuffer(data, np.uint8, low, at), np.frombuffer(data, np.uint8, high, at + low), places)

    def _ones(self, block: int) -> np.ndarray:
        """Places of the set bits of one block of ``SAMPLE`` numbers."""
        first = int(self.places[block])
        end = int(self.places[block + 1]) if block + 1 < len(self.places) else len(self.high) * 8
        bits = np.unpackbits(self.high[first // 8 : -(-end // 8)], bitorder="little")
        return np.flatnonzero(bits[first % 8 : end - first // 8 * 8]) + first

    def _lows(self, first: int, end: int) -> np.ndarray:
        start, stop = first * self.low_bits, end * self.low_bits
        bits = np.unpackbits(self.low[start // 8 : -(-stop // 8)], bitorder="little")[start % 8 :][: stop - start]
        weights = np.uint64(1) << np.arange(self.low_bits, dtype=np.uint64)
        return (bits.reshape(end - first, self.low_bits).astype(np.uint64) * weights).sum(axis=1, dtype=np.uint64)

    def block(self, block: int) -> np.ndarray:
        """All numbers of a block."""
        first, end = block * SAMPLE, min((block + 1) * SAMPLE, self.n)
        high = (self._ones(block) - np.arange(first, end)).astype(np.uint64)
        return (high << np.uint64(self.low_bits)) | self._lows(first, end)

    def select(self, i: int) -> int:
        high = int(self._ones(i // SAMPLE)[i % SAMPLE]) - i
        return high << self.low_bits | int(self._lows(i, i + 1)[0])

    def blocks(self) -> Iterator[np.ndarray]:
        return map(self.block, range(len(self.places)))

    def __len__(self) -> int:
        return self.n


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a Spark path: local, HDFS or an object store that pyarrow knows."""
    if path.startswith(("file:", "/")):
        return fs.LocalFileSystem(), re.sub("^file:/*", "/", path)
    return fs.FileSystem.from_uri(path)


class Writer:
    """Streams documents, in ascending order of id with nulls first, into one file."""

    def __init__(self, path: str, wide: bool):
        where, name = opened(path)
        self.out, self.width = where.open_output_stream(name, buffer_size=1 << 20), 4 if wide else 2
        self.ends, self.numbers, self.no_id, self.n_ids = array("q"), array("q"), 0, 0

    def add(self, ids: bytes) -> None:
        self.out.write(ids)
        self.n_ids += len(ids) // self.width

    def end(self, number: int | None) -> None:
        """The ids added since the last call were the document of this id."""
        self.ends.append(self.n_ids)
        if number is None:
            self.no_id += 1
        else:
            self.numbers.append(number)

    def close(self) -> None:
        numbers = np.array(self.numbers, np.int64)
        least = int(numbers[0]) if len(numbers) else 0
        ends = EliasFano.of(np.array(self.ends, np.int64)).dumped()
        above = EliasFano.of(numbers.view(np.uint64) - np.uint64(least % (1 << 64))).dumped()
        self.out.write(ends + above)
        size = self.n_ids * self.width
        self.out.write(TRAILER.pack(len(self.ends), self.n_ids, self.no_id, least, self.width, size, len(ends), size + len(ends), len(above), MAGIC))
        self.out.close()


class IdFile:
    """A written file: its documents by place or by id."""

    def __init__(self, path: str):
        where, name = opened(path)
        self.file = where.open_input_file(name)
        size = self.file.size()
        tail = self.file.read_at(TRAILER.size, size - TRAILER.size)
        self.n_docs, self.n_ids, self.no_id, self.least, self.width, at, ends, at_2, numbers, magic = TRAILER.unpack(tail)
        if magic != MAGIC:
            raise ValueError(f"{path} is no file of token ids")
        self.ends = EliasFano.loaded(self.file.read_at(ends, at))
        self.numbers = EliasFano.loaded(self.file.read_at(numbers, at_2))

    def bounds(self, i: int) -> tuple[int, int]:
        """First id and end of the document at place ``i``."""
        return (self.ends.select(i - 1) if i else 0), self.ends.select(i)

    def ids(self, first: int, end: int) -> np.ndarray:
        data = self.file.read_at((end - first) * self.width, first * self.width)
        return np.frombuffer(data, f"<u{self.width}")

    def document(self, i: int) -> np.ndarray:
        return self.ids(*self.bounds(i))

    def number(self, i: int) -> int | None:
        """Id of the document at place ``i``."""
        return None if i < self.no_id else self.numbers.select(i - self.no_id) + self.least

    def find(self, number: int) -> int | None:
        """Place of the first document with this id, by binary search."""
        low, high = 0, len(self.numbers)
        while low < high:
            middle = (low + high) // 2
            if self.numbers.select(middle) + self.least < number:
                low = middle + 1
            else:
                high = middle
        found = low < len(self.numbers) and self.numbers.select(low) + self.least == number
        return self.no_id + low if found else None

    def documents(self) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """Ids of documents (masked where null), first ids and ends, a block of documents at a time."""
        numbers, rest, done, last = self.numbers.blocks(), np.zeros(0, np.int64), 0, 0
        for ends in self.ends.blocks():
            ends = ends.astype(np.int64)
            without = min(max(self.no_id - done, 0), len(ends))
            while len(rest) < len(ends) - without:
                rest = np.concatenate([rest, (next(numbers) + np.uint64(self.least % (1 << 64))).view(np.int64)])
            mine, rest = rest[: len(ends) - without], rest[len(ends) - without :]
            starts = np.concatenate([[last], ends[:-1]])
            known = np.concatenate([np.zeros(without, np.int64), mine])
            yield np.ma.array(known, mask=np.arange(len(ends)) < without), starts, ends
            done, last = done + len(ends), int(ends[-1])

    def close(self) -> None:
        self.file.close()


def write(
    docs: DataFrame, tokenizer: str, doc_id: str = "doc_id", text: str = "text", *, end_id: int = END_ID,
    folder: str | None = None, file_ids: int = FILE_IDS,
) -> DataFrame:
    """Write the ids of all texts, each followed by ``end_id``, and return the manifest.

    The manifest has a row per file in order: path, n_docs, n_ids, and ``start``, the ids in all files before it. It is
    held on the driver (a row for every task and ``file_ids`` ids). A null text is empty: the end id alone. Null ids
    come first; rows with one id stand side by side, each a document of its own, equal texts too. An empty table
    gives no files. Other columns are not read. ``folder`` is one that driver and executors share; by default
    a new one among the staged tables. ``end_id`` must fit the width of the tokenizer's ids.
    """
    spark = docs.sparkSession
    folder = folder or scale.fresh_path(spark, "ids")
    where, name = opened(folder)
    where.create_dir(name, recursive=True)
    source = docs.select(F.col(doc_id).cast("bigint").alias("doc_id"), F.col(text).cast("string").alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    ranged = source.repartitionByRange(*order).sortWithinPartitions("doc_id")

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, task = encoder(tokenizer), TaskContext.get()
        end, rows, writer = known.packed([end_id]), [], None

        def close() -> None:
            writer.close()
            rows.append((task.partitionId(), len(rows), path, len(writer.ends), writer.n_ids))

        for batch in batches:
            for number, text in zip(batch.column("doc_id").to_pylist(), raw(batch.column("text"))):
                if writer is None:
                    path = f"{folder}/{task.partitionId():06d}-{len(rows):04d}-{uuid.uuid4().hex}.ids"
                    writer = Writer(path, known.wide)
                for piece in pieces(text):
                    writer.add(known.encode(piece))
                writer.add(end)
                writer.end(number)
                if writer.n_ids >= file_ids:
                    close()
                    writer = None
        if writer is not None:
            close()
        columns = list(zip(*rows)) or [()] * 5
        types = [pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.int64()]
        names = ["slice", "file", "path", "n_docs", "n_ids"]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names)

    found = Stage(spark).keep(ranged.mapInArrow(stream, MANIFEST), "manifest").orderBy("slice", "file").collect()
    start, rows = 0, []
    for r in found:
        rows.append((r.path, r.n_docs, r.n_ids, start))
        start += r.n_ids
    return spark.createDataFrame(rows, "path string, n_docs bigint, n_ids bigint, start bigint")


def read(spark: SparkSession, manifest: DataFrame) -> DataFrame:
    """Every document of the files: doc_id, start (ids before it in all files), n_tokens, ids_crc32.

    The crc is that of the ids as little-endian unsigned 32-bit integers. A task holds one block of documents.
    """
    files = manifest.select("path", "start")
    dealt = files.repartitionByRange(max(manifest.count(), 1), "start")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column("path").to_pylist(), batch.column("start").to_pylist()):
                file = IdFile(path)
                for numbers, starts, ends in file.documents():
                    sums = [_crc(file, a, b) for a, b in zip(starts.tolist(), ends.tolist())]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(numbers.data, mask=np.ma.getmaskarray(numbers)), pa.array(starts + before), pa.array(ends - starts), pa.array(sums, pa.int64())],
                        ["doc_id", "start", "n_tokens", "ids_crc32"],
                    )
                file.close()

    return dealt.mapInArrow(scan, "doc_id bigint, start bigint, n_tokens bigint, ids_crc32 bigint")


def _crc(file: IdFile, first: int, end: int) -> int:
    value = 0
    for at in range(first, end, PIECE):
        value = zlib.crc32(file.ids(at, min(at + PIECE, end)).astype("<u4").tobytes(), value)
    return value
