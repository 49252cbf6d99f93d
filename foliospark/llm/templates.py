"""Benchmark decontamination by templates.

Numbers, units and names become typed placeholders, so a question with other
values has the same template. Windows of ``WINDOW`` template tokens of documents
and benchmark items are joined by hash; an item of fewer tokens is one window, and
documents have windows of its length too. A sentence may open with a name or a plain
word, so windows with a capitalised opener have two templates. Windows with few tokens that are no
placeholders are joined by their exact words. Where windows of a document and an item
line up, their slots must agree: one value of the item stands for one value
of the document throughout. That tells a re-parameterised question from chance.

Document windows pass a bit map of the benchmark's window hashes first; it has a
fixed size, whatever the benchmark's. The join itself is exact.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliospark.llm.common import Stage, raw

WINDOW = 8
MIN_LITERAL = 4  # tokens of a window that are no placeholders
MIN_WINDOWS = 6  # windows of one place that convict, 13 tokens in a row
MIN_SHARE = 0.5  # or this share of a short item's windows
MIN_CONSISTENT = 0.75
MAP_BITS = 23
CACHE = 300_000
BASE = np.uint64(0x9E3779B97F4A7C15)

# What counts as a number word or a unit.
NUMBER_WORDS = frozenset(
    "zero one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
)
UNITS = frozenset(
    "mm cm m km in ft yd mi mg g kg t oz lb ml l s sec min h hr hours minutes seconds days weeks months years meters metres "
    "kilometers kilometres miles feet inches grams kilograms pounds liters litres dollars euros cents percent degrees".split()
)
NUMBER = re.compile(r"[$€£]?[-+]?\d[\d.,:/]*(?:e[-+]?\d+)?(?:st|nd|rd|th)?(%|[a-z°]{1,3})?")
EDGES = re.compile(r"^[^\w$€£%+-]+|[^\w%°]+$")
SLOTS = (None, "number", "unit", "name")
LINE = b"\x00"
SIGNS, STOPS = frozenset(b".,;:!?"[i : i + 1] for i in range(6)), frozenset((b".", b"!", b"?", b":"))


class Vocabulary(dict):
    """word -> row of the property arrays, filled on demand; what ``older`` knows is taken over from it."""

    def __init__(self, older: Vocabulary | None = None):
        self.older = older
        self.literal, self.kind, self.ends = np.empty(1024, np.uint64), np.empty(1024, np.int8), np.empty(1024, bool)

    def __missing__(self, word: bytes) -> int:
        self[word] = row = len(self)
        if row == len(self.kind):
            self.literal, self.kind, self.ends = (np.resize(a, 2 * row) for a in (self.literal, self.kind, self.ends))
        old = None if self.older is None else self.older.get(word)
        if old is not None:
            self.literal[row], self.kind[row], self.ends[row] = self.older.literal[old], self.older.kind[old], self.older.ends[old]
        else:
            self.literal[row], self.kind[row], self.ends[row] = properties(word)
        return row


def properties(word: bytes) -> tuple[int, int, bool]:
    """Hash of the word without edge signs in lower case, slot kind (4: a line's end), and whether it ends a sentence."""
    if word == LINE:
        return 0, 4, True
    core = word[:-1] if word[-1:] in SIGNS and len(word) > 1 else word
    if core.isalpha():  # ASCII letters, and at most one sign behind them
        ends, low = word[-1:] in STOPS, core.lower()
        text = low.decode()
        name = len(core) > 1 and core[:1].isupper() and core[1:].islower()
        return xxhash.xxh64_intdigest(low), 1 if text in NUMBER_WORDS else 2 if text in UNITS else 3 if name else 0, ends
    text = word.decode("utf-8", "replace")
    core = EDGES.sub("", text)
    low = core.lower()
    if NUMBER.fullmatch(low) or low in NUMBER_WORDS:
        kind = 1
    elif low in UNITS:
        kind = 2
    elif len(core) > 1 and core[0].isupper() and core[1:].islower():
        kind = 3
    else:
        kind = 0
    return xxhash.xxh64_intdigest(low.encode()), kind, text[-1] in ".!?:" or text[-2:-1] in (".", "!", "?")


class Canonical:
    """Template tokens of texts."""

    def __init__(self):
        self.known = Vocabulary()

    def tokens(self, text: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[bytes], np.ndarray]:
        """Word hashes, slot kinds (0 where literal), the kinds where sentence openers may be names, and the words with
        each token's place among them. A unit is one only after a number."""
        if len(self.known) > CACHE:
            self.known.older = None
            self.known = Vocabulary(self.known)
        found = text.replace(LINE, b" ").replace(b"\n", b" \x00 ").split()
        rows = np.fromiter(map(self.known.__getitem__, found), np.int32, len(found))
        kind = self.known.kind[rows]
        before = np.ones(len(rows), bool)
        before[1:] = self.known.ends[rows][:-1]
        counted = np.zeros(len(rows), bool)
        counted[1:] = kind[:-1] == 1
        opened = np.where((kind == 1) | ((kind == 2) & counted) | (kind == 3), kind, 0)
        slot = np.where((kind == 3) & before, 0, opened)
        real = np.flatnonzero(kind != 4)
        return self.known.literal[rows[real]], slot[real], opened[real], found, real


def _sums(flags: np.ndarray, size: int) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags)])
    return total[size:] - total[:-size]


def _hashed(hashes: np.ndarray, at: np.ndarray, size: int, seed: int) -> np.ndarray:
    keys = np.full(len(at), seed, np.uint64)
    for j in range(size):
        keys = keys * BASE + hashes[at + j]
    keys = (keys ^ (keys >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
    return keys ^ (keys >> np.uint64(32))


def window_keys(words: np.ndarray, slot: np.ndarray, opened: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray, np.ndarray | None]]:
    """(positions, keys, slot kinds) of the windows by template, by template with openers as names where that
    differs, and by exact words (no kinds) where the second template has too few literals."""
    need = min(MIN_LITERAL, size)
    plain, other, literal = _sums(slot == 0, size), _sums(slot != opened, size), _sums(opened == 0, size)
    out = []
    for kinds, good in ((slot, plain >= need), (opened, (other > 0) & (literal >= need))):
        at = np.flatnonzero(good)
        out.append((at, _hashed(np.where(kinds > 0, kinds.astype(np.uint64), words), at, size, size), kinds))
    at = np.flatnonzero(literal < need)
    out.append((at, _hashed(words, at, size, size + 64), None))
    return out


def windows(
    docs: DataFrame, keep: list[str], text: str, seen: np.ndarray | None = None, sizes: list[int] | None = None
) -> DataFrame:
    """One row for each key of a window: kept columns, position, size, windows of the text, and how many of them have a
    template, key, exact (by words), slots (at, kind, value; none if exact).

    ``seen`` is a bit map by the key's low bits; windows outside it are left out. ``sizes`` are the windows' lengths;
    without it ``WINDOW``, and a shorter text is one window.
    """
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))
    shared = None if seen is None else docs.sparkSession.sparkContext.broadcast(seen.tobytes())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = Canonical()
        bits = None if shared is None else np.frombuffer(shared.value, np.uint64)
        slot_type = pa.list_(pa.struct([("at", pa.int32()), ("kind", pa.string()), ("value", pa.string())]))
        for batch in batches:
            row, position, length, total, usable, found, exact, slots = [], [], [], [], [], [], [], []
            for i, data in enumerate(raw(batch.column("_text"))):
                hashes, slot, opened, read, places = reader.tokens(data)
                n = len(hashes)
                for size in sizes or [min(WINDOW, n)]:
                    if not 0 < size <= n:
                        continue
                    every = window_keys(hashes, slot, opened, size)
                    with_template = len(np.union1d(every[0][0], every[1][0])) if bits is None else 0
                    for at, keys, kinds in every:
                        if bits is not None:
                            low = keys & np.uint64((1 << MAP_BITS) - 1)
                            good = (bits[(low >> np.uint64(6)).astype(np.int64)] >> (low & np.uint64(63)) & np.uint64(1)) > 0
                            at, keys = at[good], keys[good]
                        row += [i] * len(at)
                        position += at.tolist()
                        length += [size] * len(at)
                        total += [n - size + 1] * len(at)
                        usable += [with_template] * len(at)
                        found += keys.astype(np.int64).tolist()
                        exact += [kinds is None] * len(at)
                        for p in at.tolist():
                            values = [] if kinds is None else [(p + j, k) for j, k in enumerate(kinds[p : p + size].tolist()) if k]
                            slots.append([{"at": q, "kind": SLOTS[k], "value": _value(read[places[q]])} for q, k in values])
            columns = [batch.column(k).take(pa.array(row, pa.int32())) for k in keep]
            columns += [pa.array(x, pa.int32()) for x in (position, length, total, usable)]
            columns += [pa.array(found, pa.int64()), pa.array(exact, pa.bool_()), pa.array(slots, slot_type)]
            yield pa.RecordBatch.from_arrays(columns, [*keep, "position", "size", "windows", "usable", "key", "exact", "slots"])

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return source.mapInArrow(
        run, f"{kept}, position int, size int, windows int, usable int, key bigint, exact boolean, slots array<struct<at:int,kind:string,value:string>>"
    )


def _value(word: bytes) -> str:
    return EDGES.sub("", word.decode("utf-8", "replace"))


def key_map(keys: DataFrame) -> np.ndarray:
    """Bit map of 2 ** MAP_BITS bits with the low bits of every key; one row for each 64 bits is gathered."""
    low = F.col("key").bitwiseAND(F.lit((1 << MAP_BITS) - 1).cast("bigint"))
    bit = F.expr("shiftleft(1L, CAST(key & 63 AS INT))")
    rows = keys.select(F.shiftright(low, 6).alias("word"), bit.alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    found, out = rows.toArrow(), np.zeros(1 << (MAP_BITS - 6), np.int64)
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view(np.uint64)


def contaminated(
    docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id",
    item_text: str = "text",
) -> DataFrame:
    """Pairs of document and benchmark item: doc_id, mark (hash of the text), item_id, n_windows (of the item, found
    in the document), item_windows, n_slots, consistent_slots, changed_slots (value differs from the item's).

    Only pairs that convict are returned: at one place of the document, ``MIN_WINDOWS`` different windows of the item, or
    ``MIN_SHARE`` of them, whose slots are consistent; or as many by template, of those of the item that have one. A
    place is a set of alignments that lie at most ``WINDOW`` words apart; the figures are of the best place. Null and empty texts, and an empty benchmark, give no pairs. Rows equal in id and text are one document.
    """
    stage = Stage(docs.sparkSession)
    bench = items.select(F.col(item_id).alias("item_id"), F.col(item_text).alias("text")).distinct()
    bench = stage.keep(windows(bench, ["item_id"], "text"), "bench")
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text"))
    ids = ids.withColumn("mark", F.xxhash64("text"))
    sizes = sorted(r["size"] for r in bench.select("size").distinct().collect())
    mine = windows(ids, ["doc_id", "mark"], "text", key_map(bench), sizes or [WINDOW]).select("doc_id", "mark", "position", "key", "slots")
    known = bench.select(
        "item_id", "key", F.col("position").alias("item_at"), F.col("windows").alias("item_windows"),
        F.col("usable").alias("item_usable"), "exact", F.col("slots").alias("item_slots"),
    )
    hits = stage.keep(mine.join(known, "key").withColumn("shift", F.col("position") - F.col("item_at")), "hits")

    pair = ["doc_id", "mark", "item_id"]
    slot = F.explode(F.arrays_zip("item_slots", "slots")).alias("s")
    values = hits.select(*pair, "shift", slot).select(
        *pair, "shift", F.col("s.item_slots.at").alias("at"), F.col("s.slots.at").alias("doc_at"),
        F.col("s.item_slots.kind").alias("kind"), F.col("s.item_slots.value").alias("old"), F.col("s.slots.value").alias("new"),
    ).distinct()
    counted = values.groupBy(*pair, "shift", "kind", "old", "new").agg(F.count("*").alias("n"))
    usual = counted.groupBy(*pair, "shift", "kind", "old").agg(
        F.sum("n").alias("n"), F.max("n").alias("most"), F.sum(F.when(F.col("old") != F.col("new"), F.col("n")).otherwise(0)).alias("changed")
    )
    slots = usual.groupBy(*pair, "shift").agg(
        F.sum("n").alias("n_slots"), F.sum("most").alias("consistent_slots"), F.sum("changed").alias("changed_slots")
    )
    lined = hits.groupBy(*pair, "item_windows", "item_usable", "shift").agg(
        F.count_distinct("item_at").alias("n_windows"), F.count_distinct(F.when(~F.col("exact"), F.col("item_at"))).alias("n_templates")
    )
    same = [lined[k].eqNullSafe(slots[k]) for k in [*pair, "shift"]]
    joined = lined.join(slots, same[0] & same[1] & same[2] & same[3], "left").select(
        *[lined[k] for k in [*pair, "shift"]], "item_windows", "item_usable", "n_windows", "n_templates", *[F.coalesce(slots[k], F.lit(0)).alias(k) for k in ("n_slots", "consistent_slots", "changed_slots")]
    )
    # Alignments of one place, shifted by a few words put in or left out, count together, each window of the item once.
    good = joined.where(F.col("consistent_slots") >= MIN_CONSISTENT * F.col("n_slots"))
    along = Window.partitionBy(*pair).orderBy("shift")
    step = F.when(F.col("shift") - F.lag("shift").over(along) <= WINDOW, 0).otherwise(1)
    good = good.withColumn("_step", step).withColumn("place", F.sum("_step").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    good = stage.keep(good, "places")
    there = hits.join(good.select(*[F.col(k).alias(f"_{k}") for k in [*pair, "shift"]], "place"), [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in [*pair, "shift"]])
    placed = there.groupBy(*pair, "item_windows", "item_usable", "place").agg(
        F.count_distinct("item_at").alias("n_windows"), F.count_distinct(F.when(~F.col("exact"), F.col("item_at"))).alias("n_templates")
    )
    figures = good.groupBy(*pair, "place").agg(*[F.sum(k).alias(k) for k in ("n_slots", "consistent_slots", "changed_slots")])
    same = [placed[k].eqNullSafe(figures[k]) for k in [*pair, "place"]]
    found = placed.join(figures, same[0] & same[1] & same[2] & same[3]).select(
        *[placed[k] for k in pair], "item_windows", "item_usable", "n_windows", "n_templates", "n_slots", "consistent_slots", "changed_slots"
    )
    need, least = (F.least(F.lit(MIN_WINDOWS), F.ceil(F.col(k) * MIN_SHARE)) for k in ("item_windows", "item_usable"))
    convicted = (F.col("n_windows") >= need) | ((F.col("item_usable") > 0) & (F.col("n_templates") >= least))
    best = found.where(convicted).groupBy(*pair, "item_windows").agg(
        F.max(F.struct("n_windows", "n_slots", "consistent_slots", "changed_slots")).alias("best")
    )
    return best.select(*pair, F.col("best.n_windows"), "item_windows", "best.n_slots", "best.consistent_slots", "best.changed_slots")


def clean(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents, with all columns, that hold no benchmark item."""
    bad = contaminated(docs, items, doc_id, text).select(F.col("doc_id").alias("__llm_bad_id"), F.col("mark").alias("__llm_bad_mark")).distinct()
    bad = Stage(docs.sparkSession).keep(bad, "leaks")
    same = F.col(doc_id).eqNullSafe(F.col("__llm_bad_id")) & F.xxhash64(F.col(text).cast("string")).eqNullSafe(F.col("__llm_bad_mark"))
    return docs.join(bad, same, "left_anti")
