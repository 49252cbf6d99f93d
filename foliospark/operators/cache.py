"""Content-addressed cache tables: look-up, fill, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.functions.text import slug
from foliospark.settings import FIGURE_TYPES

KEYS = ["cache_key", "backend"]
BUCKETS = 256  # of a clustered cache
CLUSTER = "_cluster_key"


def with_cache_key(df: DataFrame, content: Column, backend: Column) -> DataFrame:
    """Add the content hash and the backend's partition name."""
    return df.withColumns({"cache_key": F.sha1(content.cast("binary")), "backend": slug(backend)})


def cache_lookup(df: DataFrame, cache: DataFrame, *, spread_by: Column, rows: int | None = None) -> DataFrame:
    """Rows with their cached payload and hit and miss flags.

    ``cache`` has one row per (cache_key, backend). Copies of one content may be
    a large share of the rows, so they are dealt over several tasks.
    """
    found = cache.withColumn("_found", F.lit(True))
    joined = scale.keyed_join(df, found, KEYS, "left", spread_by=spread_by, rows=rows)
    hit = F.coalesce("_found", F.lit(False))
    return joined.withColumns({"cache_hit": hit, "cache_miss": ~hit}).drop("_found")


def _clustered() -> Column:
    """Both keys in one: a clustering by two is lost where a caller's backend is a constant."""
    return F.concat("backend", F.lit(":"), "cache_key")


def save_cache(cache: DataFrame, table: str, *, buckets: int = BUCKETS, path: str | None = None) -> DataFrame:
    """Write a cache as a table clustered by its key, one file a bucket, and read it back.

    ``path`` puts its files outside the warehouse. Choose ``buckets`` for the size the cache will have: a bucket is one
    task's in every look-up. Rows with a null key are never found and not written.
    """
    keyed = cache.withColumn(CLUSTER, _clustered()).where(F.col(CLUSTER).isNotNull()).repartition(buckets, CLUSTER)
    writer = keyed.write.format("parquet").mode("overwrite").bucketBy(buckets, CLUSTER).sortBy(CLUSTER)
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)
    return cache.sparkSession.table(table)


def wanted_rows(df: DataFrame, cache: DataFrame, *, buckets: int = BUCKETS) -> DataFrame:
    """The rows of a clustered cache that ``df`` asks for. Only the distinct keys of ``df`` are moved, to where
    the cache's buckets are; the cache itself is read in place."""
    asked = df.select(_clustered().alias(CLUSTER)).distinct().repartition(buckets, CLUSTER)
    return asked.join(cache, CLUSTER).drop(CLUSTER)


def clustered_lookup(
    df: DataFrame, cache: DataFrame, *, spread_by: Column, buckets: int = BUCKETS, rows: int | None = None
) -> DataFrame:
    """``cache_lookup`` in a cache written by ``save_cache`` that is much larger than ``df``.

    What is joined to the rows afterwards is no larger than their distinct keys. ``df`` is read three times.
    """
    return cache_lookup(df, wanted_rows(df, cache, buckets=buckets), spread_by=spread_by, rows=rows)


def cache_fill(results: DataFrame, cache: DataFrame) -> DataFrame:
    """New cache rows: misses only, one per key.

    Copies collapse before the shuffle; the first of them in order of ``pick``
    (a column of ``results``) is kept, so a rerun gives the same row.
    """
    keys = KEYS
    rest = [c for c in results.columns if c not in [*keys, "pick"]]
    single = results.groupBy(*keys).agg(F.min(F.struct("pick", *rest)).alias("_row"))
    single = single.select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
    return single.join(cache.select(*keys), keys, "left_anti")


def cache_summary(blocks: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Eligible blocks, and hits and misses over all blocks."""
    eligible = ~F.col("block_type").isin(*FIGURE_TYPES)
    return blocks.groupBy(*(by or [])).agg(
        F.count(F.when(eligible, 1)).alias("eligible_block_count"),
        F.count(F.when(F.col("cache_hit"), 1)).alias("ocr_cache_hit_count"),
        F.count(F.when(F.col("cache_miss"), 1)).alias("ocr_cache_miss_count"),
    )
