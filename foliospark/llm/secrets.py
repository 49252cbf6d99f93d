"""Secrets by pattern, and by a battery of randomness tests on long strings.

Patterns give the base spans. Beyond them, every long run of encoding characters
is read in the narrowest encoding that holds it, and tested: chi-squared
uniformity over the alphabet's parts and its symbols, runs above and below its middle, and serial
correlation of neighbours, combined by Fisher's method. How often a structured string of length n
passes by luck is measured on the corpus: strings that fail as a whole by far are structured, and the share of their beginnings
that pass gives the chance by length. What passes is accepted from the
length at which the false-discovery rate over all strings tested stays below ``FDR`` (Benjamini-Hochberg
over one count per length; nothing else is gathered).
"""

from __future__ import annotations

import bisect
import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Stage, strings

ASSIGN = re.compile(
    r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE
)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
LONG_HEX = re.compile(r"[0-9a-f]{24,}")  # the same spans as HEX runs of 24 or more
RUN = re.compile(r"[A-Za-z0-9+/_-]{20,}")
KINDS = ("assign", "access", "hex", "random")
LEVEL = 0.01  # of the battery: share of truly random strings it rejects
STRUCTURED = 1e-5  # a string below it is taken as structured; a random one seldom is
FDR = 0.01
BITS = 0.5  # by which each further character lowers a structured string's chance to look random, before any is measured
PRIOR = 1000  # beginnings that weigh as much as that assumption
STARTS = (20, 28, 36, 48)  # lengths of the beginnings that are tested, of strings at least half as long again
TOP = 512  # lengths from here on count as one
SCHEMA = "base array<struct<kind:string,start:int,end:int>>, tested int, runs array<struct<start:int,end:int>>, tried array<int>, leaked array<int>"
FIELDS = ["base", "tested", "runs", "tried", "leaked"]
FOUND = "__llm_found"

SMALL, LARGE, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
ENCODINGS = [  # narrowest first: parts that should each get their share, in value order
    [DIGITS[:5], DIGITS[5:], "abc", "def"],
    [DIGITS[:5], DIGITS[5:], "ABC", "DEF"],
    [LARGE[:13], LARGE[13:], "234567"],
    [LARGE[:13], LARGE[13:], SMALL[:13], SMALL[13:], DIGITS],
    [LARGE[:13], LARGE[13:], SMALL[:13], SMALL[13:], DIGITS, "+/"],
    [LARGE[:13], LARGE[13:], SMALL[:13], SMALL[13:], DIGITS, "-_"],
]
VALUES = [{c: i for i, c in enumerate("".join(parts))} for parts in ENCODINGS]


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the three patterns as (kind, start, end), by start and then kind."""
    found = [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        found += [("access", *m.span()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
    found += [("hex", *m.span()) for m in LONG_HEX.finditer(text)]
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0])))


def _upper_tail(x: float, freedom: int) -> float:
    """Chi-squared tail by the Wilson-Hilferty approximation."""
    spread = 2 / (9 * freedom)
    return 0.5 * math.erfc(((x / freedom) ** (1 / 3) - 1 + spread) / math.sqrt(2 * spread))


def randomness(token: str) -> float:
    """Combined p-value of the battery; 0 for strings of one class of characters."""
    classes = sum((any(c in part for c in token) for part in (DIGITS, SMALL, LARGE)), 0)
    if classes < 2:
        return 0.0
    number = next((i for i, known in enumerate(VALUES) if all(c in known for c in token)), None)
    if number is None:
        return 0.0
    parts, values = ENCODINGS[number], VALUES[number]
    n, size = len(token), len(values)
    chi = sum((sum(token.count(c) for c in p) - n * len(p) / size) ** 2 / (n * len(p) / size) for p in parts)
    uniform = _upper_tail(chi, len(parts) - 1)
    single = sum(k * k for k in Counter(token).values()) * size / n - n  # chi-squared over single symbols, too few each
    spread = 2 * (size - 1) * (n - 1) / n  # for the usual tail, so by its exact mean and variance
    symbols = 0.5 * math.erfc((single - (size - 1)) / math.sqrt(2 * spread))
    at = [values[c] for c in token]
    high = [v * 2 >= size for v in at]
    up = sum(high)
    if up in (0, n):
        return 0.0
    runs = 1 + sum(a != b for a, b in zip(high, high[1:]))
    mean = 1 + 2 * up * (n - up) / n
    variance = (mean - 1) * (mean - 2) / (n - 1)
    alternate = math.erfc(abs(runs - mean) / math.sqrt(2 * variance)) if variance > 0 else 0.0
    middle = sum(at) / n
    square = sum((v - middle) ** 2 for v in at)
    lag = sum((a - middle) * (b - middle) for a, b in zip(at, at[1:])) / square if square else 1.0
    serial = math.erfc(abs(lag * n + 1) / math.sqrt(2 * n))
    half = -sum(math.log(max(p, 1e-300)) for p in (uniform, symbols, alternate, serial))
    return math.exp(-half) * (1 + half + half**2 / 2 + half**3 / 6)


class Scan(NamedTuple):
    """Base spans, the number of strings tested, those that pass outside base spans, and for each of
    ``STARTS`` how many beginnings of failing strings were tried and how many passed."""

    base: list[tuple[str, int, int]]
    tested: int
    passed: list[tuple[int, int]]
    tried: list[int]
    leaked: list[int]


def scan(text: str) -> Scan:
    """What the text holds, in time linear in its length."""
    base = base_spans(text)
    found = Scan(base, 0, [], [0] * len(STARTS), [0] * len(STARTS))
    tested, at, last = 0, 0, 0  # spans before ``at`` start before the run's end; ``last`` is the furthest end among them
    for m in RUN.finditer(text):
        start, end = m.span()
        while at < len(base) and base[at][1] < end:
            last = max(last, base[at][2])
            at += 1
        if start < last:
            continue
        tested += 1
        token = m.group()
        score = randomness(token)
        if score >= LEVEL:
            found.passed.append((start, end))
        if score >= STRUCTURED:
            continue
        for i, n in enumerate(STARTS):
            if 2 * len(token) >= 3 * n:
                found.tried[i] += 1
                found.leaked[i] += randomness(token[:n]) >= LEVEL
    return found._replace(tested=tested)


def _arrays(texts: list[str]) -> list[pa.Array]:
    """What ``scan`` finds in each text, as the columns of ``SCHEMA``."""
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
    plain = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    counts = pa.list_(pa.int32())
    found = [scan(t) for t in texts]
    base = [[dict(zip(("kind", "start", "end"), x)) for x in f.base] for f in found]
    runs = [[dict(zip(("start", "end"), x)) for x in f.passed] for f in found]
    return [
        pa.array(base, spans), pa.array([f.tested for f in found], pa.int32()), pa.array(runs, plain),
        pa.array([f.tried for f in found], counts), pa.array([f.leaked for f in found], counts),
    ]


def scanned(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The kept columns and what ``scan`` finds. Null text counts as empty."""
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = _arrays(strings(batch.column("_text")))
            yield pa.RecordBatch.from_arrays([*[batch.column(k) for k in keep], *columns], [*keep, *FIELDS])

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return source.mapInArrow(run, f"{kinds}, {SCHEMA}" if keep else SCHEMA)


def measured_chances(tried: list[int], leaked: list[int]) -> list[float]:
    """The chance of a structured string to pass at each of ``STARTS``: what was counted, with ``PRIOR`` beginnings that
    fall by ``BITS`` a character from the length before."""
    chances, last, at = [], 1.0, 0
    for n, t, k in zip(STARTS, tried, leaked):
        last, at = (k + PRIOR * last * 2.0 ** (-BITS * (n - at))) / (t + PRIOR), n
        chances.append(last)
    return chances


def chance(n: int, chances: list[float]) -> float:
    """The chance at length n, from the nearest measured length at or below it."""
    i = max(bisect.bisect_right(STARTS, n) - 1, 0)
    return chances[i] * 2.0 ** (-BITS * max(n - STARTS[i], 0))


def least_length(found: DataFrame, fdr: float = FDR) -> int:
    """The length from which strings that pass are accepted; above ``TOP`` if none are."""
    sums = [F.sum(F.get(c, F.lit(i))) for c in ("tried", "leaked") for i in range(len(STARTS))]
    tested, *counts = (n or 0 for n in found.agg(F.sum("tested"), *sums).first())
    chances = measured_chances(counts[: len(STARTS)], counts[len(STARTS) :])
    length = F.explode(F.transform("runs", lambda r: F.least(r["end"] - r["start"], F.lit(TOP))))
    passed = sorted(((r["n"], r["count"]) for r in found.select(length.alias("n")).groupBy("n").count().collect()), reverse=True)
    best, above = TOP + 1, 0
    for n, count in passed:
        above += count
        if tested * chance(n, chances) <= fdr * above:
            best = n
    return best


def secrets(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", *, fdr: float = FDR) -> DataFrame:
    """doc_id, base and spans: arrays of (kind, start, end) in code points, by start and then kind.

    ``spans`` holds the base spans and, as kind "random", the strings accepted by the tests. A null or
    empty text has none; repeated rows are scanned each.
    """
    stage = Stage(docs.sparkSession)
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    found = stage.keep(scanned(ids, ["doc_id"], "text"), "secrets")
    least = least_length(found, fdr)
    added = F.transform(
        F.filter("runs", lambda r: r["end"] - r["start"] >= least),
        lambda r: F.struct(F.lit("random").alias("kind"), r["start"].alias("start"), r["end"].alias("end")),
    )
    return found.select("doc_id", "base", in_order(F.concat("base", added)).alias("spans"))


def in_order(spans: Column) -> Column:
    """By start, then kind as listed."""
    rank = {k: i for i, k in enumerate(KINDS)}
    place = lambda s: F.coalesce(*[F.when(s["kind"] == k, F.lit(i)) for k, i in rank.items()])
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("at"), place(s).alias("rank"), s.alias("span"))))
    return F.transform(ordered, lambda s: s["span"])


def listed(spans: Column) -> Column:
    """kind:start:end, comma-joined."""
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def redact(text: str, least: int, mask: str) -> str:
    """The text with each span, or overlap of spans, replaced by the mask."""
    found = scan(text)
    return replaced(text, sorted([(s, e) for _, s, e in found.base] + [(s, e) for s, e in found.passed if e - s >= least]), mask)


def replaced(text: str, spans: list[tuple[int, int]], mask: str) -> str:
    """The text with each of the sorted spans, or overlap of them, replaced by the mask."""
    out, last = [], 0
    for start, end in spans:
        if start >= last:
            out += [text[last:start], mask]
        last = max(last, end)
    return "".join([*out, text[last:]])


def redacted(docs: DataFrame, text: str = "text", *, mask: str = "[SECRET]", fdr: float = FDR) -> DataFrame:
    """The documents, row for row, with every secret in ``text`` masked. Null stays null, an
    empty text empty; repeated rows stay, an empty table stays empty.

    A text is scanned once; what is found is written beside its row, and only texts that hold a secret are masked.
    """

    @F.arrow_udf(f"struct<{SCHEMA}>")
    def found(values: pa.Array) -> pa.Array:
        return pa.StructArray.from_arrays(_arrays(strings(values)), FIELDS)

    @F.arrow_udf("string")
    def masked(values: pa.Array, spans: pa.Array) -> pa.Array:
        pairs = zip(values.to_pylist(), spans.to_pylist())
        return pa.array([t if t is None else replaced(t, [(x["start"], x["end"]) for x in s], mask) for t, s in pairs], pa.string())

    source = docs.withColumn(text, F.col(text).cast("string"))
    held = Stage(docs.sparkSession).keep(source.withColumn(FOUND, found(F.col(text))), "scanned")
    least = least_length(held.select(f"{FOUND}.*"), fdr)
    base = F.transform(F.col(FOUND)["base"], lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))
    spans = F.array_sort(F.concat(base, F.filter(F.col(FOUND)["runs"], lambda r: r["end"] - r["start"] >= least)))
    some = F.size(spans) > 0
    clean = F.when(some, masked(F.when(some, F.col(text)), F.when(some, spans))).otherwise(F.col(text))
    return held.withColumn(text, clean).drop(FOUND)


def digest(spans: str) -> str:
    return hashlib.sha256(spans.encode()).hexdigest()
