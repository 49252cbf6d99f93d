"""Substring dedup by content-defined chunks.

A gear hash rolls over the UTF-8 bytes: h = (h << 1) + gear[byte], cut off after
``GEAR_WINDOW`` bytes, so it is computed for all positions at once by doubling.
A chunk ends where the hash's top bits are zero, which moves with the
content: an insertion changes the chunks it touches and no others. Chunks are
compared by digest over the whole table. The first occurrence of a chunk
(smallest document, then position) stays; elsewhere, unbroken runs of repeated
chunks with at least ``min_words`` words are repeats. A chance agreement of two
digests does no harm, as a run needs several in a row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import Stage, raw

GEAR_WINDOW = 16  # bytes, a power of two
MASK_BITS = 4  # a chunk may end at one byte in 16
MIN_BYTES = 16
MAX_BYTES = 256
MIN_WORDS = 20  # in whole chunks; the first and last chunk of a passage are seldom whole, so about 50 in the text
GEAR_SEED = 42


def gear_table() -> np.ndarray:
    return np.array([xxhash.xxh32_intdigest(bytes([b]), GEAR_SEED) for b in range(256)], np.uint32)


GEAR = gear_table()


def gear_hashes(data: np.ndarray) -> np.ndarray:
    """The rolling hash after each byte of the last ``GEAR_WINDOW`` bytes."""
    h = GEAR[data]
    step = 1
    while step < GEAR_WINDOW:
        longer = h.copy()
        longer[step:] += h[:-step] << np.uint32(step)
        h, step = longer, step * 2
    return h


def chunk_ends(text: bytes, mask_bits: int = MASK_BITS, least: int = MIN_BYTES, most: int = MAX_BYTES) -> list[int]:
    """End of each chunk in bytes; the last is the length of the text. No chunk is longer than ``most``."""
    if not text:
        return []
    marks = np.flatnonzero(gear_hashes(np.frombuffer(text, np.uint8)) >> np.uint32(32 - mask_bits) == 0) + 1
    ends, start = [], 0
    for mark in marks.tolist():
        while mark - start > most:
            start += most
            ends.append(start)
        if mark - start >= least:
            start = mark
            ends.append(start)
    while len(text) - start > most:
        start += most
        ends.append(start)
    if start < len(text):
        ends.append(len(text))
    return ends


def text_chunks(text: bytes) -> tuple[list[int], list[int], list[int], list[int]]:
    """Start and length in code points, words that begin in it, and digest of each chunk."""
    ends = chunk_ends(text)
    if not ends:
        return [], [], [], []
    pieces = [text[a:b] for a, b in zip([0, *ends], ends)]
    words = [len(p.split()) for p in pieces]
    for i in range(1, len(pieces)):
        if not pieces[i - 1][-1:].isspace() and not pieces[i][:1].isspace():
            words[i] -= 1
    if text.isascii():
        stops = ends
    else:
        stops = np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)[np.array(ends) - 1].tolist()
    starts = [0, *stops[:-1]]
    return starts, [b - a for a, b in zip(starts, stops)], words, [xxhash.xxh3_64_intdigest(p) for p in pieces]


def chunked(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """One row for each chunk: the kept columns, digest, and place = start << 32 | length << 16 | words."""
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                row, starts, lengths, words, digests = [], [], [], [], []
                for i, data in enumerate(raw(part.column("_text"))):
                    found = text_chunks(data)
                    row += [i] * len(found[0])
                    starts += found[0]
                    lengths += found[1]
                    words += found[2]
                    digests += found[3]
                place = (np.array(starts, np.int64) << 32) | (np.array(lengths, np.int64) << 16) | np.array(words, np.int64)
                kept = [part.column(k).take(pa.array(row, pa.int32())) for k in keep]
                digest = pa.array(np.array(digests, np.uint64).astype(np.int64))
                yield pa.RecordBatch.from_arrays([*kept, digest, pa.array(place)], [*keep, "digest", "place"])

    return source.mapInArrow(run, docs.select(*keep).schema.add("digest", "long").add("place", "long"))


def repeats(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, min_words: int = MIN_WORDS) -> DataFrame:
    """Runs of repeated chunks: doc_id, mark (hash of the text), start, end (code points, end exclusive), n_words,
    stays (the run is the first occurrence), first_doc_id (smallest document that holds part of it).

    Documents without repeats have no rows; null or empty texts have none. Rows equal in id and text are one
    document. Rows without an id come last in the order, and count as one document when the first is chosen.
    """
    stage = Stage(docs.sparkSession)
    number, body = F.col(doc_id).cast("bigint"), F.col(text).cast("string")
    plain = docs.select(F.coalesce(number, F.lit(2**63 - 1)).alias("doc"), body.alias("text"))
    marked = docs.select(number.alias("doc_id"), F.xxhash64(body).alias("mark"), body.alias("text"))
    known = chunked(plain, ["doc"], "text").groupBy("digest").agg(F.count("*").alias("times"), F.min("doc").alias("least"))
    known = stage.keep(known.where("times > 1").drop("times"), "known")
    again = chunked(marked, ["doc_id", "mark"], "text").join(known, "digest").distinct()

    doc = Window.partitionBy("doc_id", "mark")
    start = F.shiftright("place", 32)
    length = F.shiftright("place", 16).bitwiseAND(F.lit(0xFFFF).cast("bigint"))
    chunk = again.select(
        "doc_id", "mark", "digest", "least", start.alias("start"), (start + length).alias("end"),
        F.col("place").bitwiseAND(F.lit(0xFFFF).cast("bigint")).alias("words"),
    )
    mine = F.coalesce("doc_id", F.lit(2**63 - 1)) == F.col("least")
    chunk = chunk.withColumn("stays", mine & (F.min("start").over(Window.partitionBy("doc_id", "mark", "digest")) == F.col("start")))
    order = doc.orderBy("start")
    breaks = (F.lag("end").over(order) != F.col("start")) | (F.lag("stays").over(order) != F.col("stays"))
    chunk = chunk.withColumn("_new", F.when(F.coalesce(breaks, F.lit(True)), 1).otherwise(0))
    chunk = chunk.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    runs = chunk.groupBy("doc_id", "mark", "_run").agg(
        F.min("start").alias("start"), F.max("end").alias("end"), F.sum("words").alias("n_words"),
        F.first("stays").alias("stays"), F.nullif(F.min("least"), F.lit(2**63 - 1)).alias("first_doc_id"),
    )
    return runs.where(F.col("n_words") >= min_words).drop("_run")


def repeats_removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", **settings) -> DataFrame:
    """The documents with every repeat cut out of ``text``, except where it occurs first. Other columns pass through."""
    cuts = repeats(docs, doc_id, text, **settings).where("not stays").groupBy(
        F.col("doc_id").alias("__llm_id"), F.col("mark").alias("__llm_mark")
    )
    cuts = cuts.agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("__llm_cuts"))
    cuts = Stage(docs.sparkSession).keep(cuts, "cuts")
    same = F.col(doc_id).cast("bigint").eqNullSafe(F.col("__llm_id")) & (F.xxhash64(F.col(text).cast("string")) == F.col("__llm_mark"))
    joined = docs.join(cuts, same, "left")
    body = F.col(text).cast("string")
    begin = F.concat(F.array(F.lit(0).cast("bigint")), F.col("__llm_cuts.end"))
    end = F.concat(F.col("__llm_cuts.start"), F.array(F.length(body).cast("bigint")))
    left = F.zip_with(begin, end, lambda a, b: body.substr((a + 1).cast("int"), (b - a).cast("int")))
    return joined.withColumn(text, F.when(F.col("__llm_cuts").isNull(), body).otherwise(F.concat_ws("", left))).drop(
        "__llm_id", "__llm_mark", "__llm_cuts"
    )
