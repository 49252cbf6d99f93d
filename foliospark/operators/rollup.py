"""Recognised lines to block text and confidence."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as tx


def rollup_lines(lines: DataFrame, keys: list[str]) -> DataFrame:
    """Text and line confidence of each block, one row per block.

    Lines are joined by LF in order, null ones left out. The text of a block is
    one value, so the lines it is made of meet in one row.
    """
    conf = F.col("confidence")
    line = F.when(F.col("text").isNotNull(), F.struct("line_no", "text"))
    folded = lines.groupBy(*keys).agg(
        F.transform(F.sort_array(F.collect_list(line)), lambda e: e["text"]).alias("_lines"),
        F.count(conf).alias("line_confidence_count"), F.avg(conf).alias("line_confidence_mean"),
        F.min(conf).alias("line_confidence_min"), F.max(conf).alias("line_confidence_max"),
    )
    made = folded.withColumn("text", F.array_join("_lines", "\n")).withColumn("line_count", F.size("_lines"))
    body = tx.strip(F.col("text"))
    return made.withColumns(
        {"text_length": F.length(body), "empty_text": body == "", "confidence": F.col("line_confidence_mean")}
    ).drop("_lines")
