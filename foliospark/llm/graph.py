"""Connected components by alternating large-star and small-star rounds.

Each round rewires links towards smaller nodes, so a chain of n nodes needs
about log n rounds. A node's smallest neighbour is a plain minimum with partial
aggregation; it is written and joined back as one row per node, so a node with
a large share of all links is split by the adaptive skew join. Rounds are
written to the shared folder, which cuts lineage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark.llm.common import Stage


def _smallest(links: DataFrame) -> DataFrame:
    return links.groupBy("u").agg(F.min("v").alias("m"))


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64("u", "v"))).first())


def components(edges: DataFrame, a: str, b: str) -> DataFrame:
    """(node, root) for every node of ``edges``; the root is the smallest node it can reach.

    Self-links, repeated links and links with a null end are ignored; no links give no rows.
    """
    stage = Stage(edges.sparkSession)
    ends = edges.select(F.col(a).alias("x"), F.col(b).alias("y")).where("x <> y")
    links = stage.keep(ends.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct(), "links")
    state = _state(links)
    while state[0]:
        both = links.unionByName(links.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = stage.keep(_smallest(both), "low")
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.least("m", "u").alias("v"))
        large = stage.keep(large.distinct(), "links")
        lower = stage.keep(_smallest(large), "low")
        moved = large.join(lower, "u")
        small = moved.where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        small = stage.keep(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct(), "links")
        now = _state(small)
        stage.drop(links, low, large, lower)
        links, done, state = small, now == state, now
        if done:
            break
    roots = links.select(F.col("v").alias("node")).distinct().withColumn("root", F.col("node"))
    return links.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(roots)
