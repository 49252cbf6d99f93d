"""Quality rules of a document, and verdicts on whole hosts.

Rule counts come from one pass over the texts. Failures are then summed per host;
a host's failure rate is shrunk towards the rate of all hosts by a beta prior
fitted to the hosts themselves (method of moments), so a host with few documents
needs more than a few failures. Hosts whose shrunk rate reaches ``reject`` are
rejected and that verdict is joined back to their documents.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Stage, raw

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
REPEAT_PERCENT = 50
REJECT = 0.5  # shrunk failure rate from which a host is rejected
MOST_PRIOR = 1e6  # documents the prior may weigh, where hosts do not differ at all


def repeated_words(found: list[bytes]) -> int:
    """Words inside three-word windows that occur twice or more in the text, the first occurrence too."""
    windows = list(zip(found, found[1:], found[2:]))
    if len(set(windows)) == len(windows):
        return 0
    times, covered, last = Counter(windows), 0, -1
    for at, window in enumerate(windows):
        if times[window] > 1:
            covered += at + 3 - max(at, last)
            last = at + 3
    return covered


def rule_counts(text: bytes) -> tuple[int, int, int, int, int]:
    """The five counts of ``COUNTS`` for one text."""
    found = text.split()
    points = len(text.decode("utf-8", "replace")) if not text.isascii() else len(text)
    space = sum(text.count(c) for c in (b" ", b"\t", b"\n", b"\v", b"\f", b"\r"))
    lines = [line for line in text.split(b"\n") if line and not line.isspace()]
    return (
        len(found), points - space, sum(text.count(bytes([c])) for c in SYMBOLS),
        len(lines) - len(set(lines)), repeated_words(found),
    )


def count_rules(docs: DataFrame, keep: list[str], text: str) -> DataFrame:
    """The kept columns, the counts, and ``base_failed``. Null text has no words and fails."""
    source = docs.select(*keep, F.col(text).cast("string").alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            counted = list(zip(*map(rule_counts, raw(batch.column("_text"))))) or [()] * len(COUNTS)
            columns = [batch.column(k) for k in keep] + [pa.array(c, pa.int64()) for c in counted]
            yield pa.RecordBatch.from_arrays(columns, [*keep, *COUNTS])

    schema = docs.select(*keep).schema
    for name in COUNTS:
        schema = schema.add(name, "long")
    short = F.col("n_words") < MIN_WORDS
    return source.mapInArrow(run, schema).withColumn(
        "base_failed", short | (100 * F.col("n_repeat_words") > REPEAT_PERCENT * F.col("n_words"))
    )


def host_rates(counted: DataFrame, host: str = "host") -> DataFrame:
    """host, documents, failures and the shrunk ``rate`` of each host that is not null."""
    stage = Stage(counted.sparkSession)
    hosts = counted.where(F.col(host).isNotNull()).groupBy(F.col(host).alias("host"))
    hosts = hosts.agg(F.count("*").alias("documents"), F.sum(F.col("base_failed").cast("long")).alias("failures"))
    hosts = stage.keep(hosts, "hosts")
    rate = F.col("failures") / F.col("documents")
    known = hosts.agg(
        F.count("*").alias("hosts"), F.sum("documents").alias("n"), F.sum("failures").alias("f"),
        F.sum(rate * F.col("failures")).alias("squares"),
    ).first()
    if not known["n"]:
        return hosts.withColumn("rate", F.lit(0.0))
    mean = known["f"] / known["n"]
    spread = known["squares"] / known["n"] - mean * mean
    within = mean * (1 - mean) * known["hosts"] / known["n"]
    between = max(spread - within, 0.0)
    weight = min(mean * (1 - mean) / between - 1, MOST_PRIOR) if between > 0 else MOST_PRIOR
    weight = max(weight, 1.0)
    return hosts.withColumn("rate", (F.col("failures") + weight * mean) / (F.col("documents") + weight))


def host_verdicts(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", host: str = "source", *, reject: float = REJECT
) -> DataFrame:
    """doc_id, host, the rule counts, base_failed, host_rejected and kept, one row per row of ``docs``.

    kept: passes its own rules and its host is not rejected. A null host gets no verdict. An empty
    table gives no rows; repeated rows are judged, and counted for their host, each.
    """
    stage = Stage(docs.sparkSession)
    ids = docs.select(F.col(doc_id).alias("doc_id"), F.col(host).cast("string").alias("host"), F.col(text).alias("text"))
    counted = stage.keep(count_rules(ids, ["doc_id", "host"], "text"), "rules")
    bad = stage.keep(host_rates(counted).where(F.col("rate") >= reject).select(F.col("host").alias("bad")), "bad")
    judged = counted.join(bad, counted.host == bad.bad, "left").withColumn("host_rejected", F.col("bad").isNotNull())
    return judged.drop("bad").withColumn("kept", ~F.col("base_failed") & ~F.col("host_rejected"))
