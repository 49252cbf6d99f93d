from pyspark.sql import functions as F

from foliospark.operators import cache


def test_clustered_cache_is_not_moved(spark, tmp_path):
    held = spark.range(500).select(F.sha1(F.col("id").cast("string")).alias("cache_key"), F.lit("b").alias("backend"), F.col("id").alias("payload"))
    table = cache.save_cache(held, "clustered_cache_test", buckets=4, path=str(tmp_path / "cache"))
    asked = spark.range(3000).select(
        "id", F.when(F.col("id") % 10 > 0, F.sha1(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).cast("string"))).alias("cache_key"), F.lit("b").alias("backend")
    )
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        lines = cache.wanted_rows(asked, table, buckets=4)._jdf.queryExecution().executedPlan().toString().splitlines()
        join = next(i for i, line in enumerate(lines) if "Join" in line)
        scan = next(i for i, line in enumerate(lines) if "FileScan" in line)
        assert "Bucketed: true" in lines[scan]
        side = [i for i in range(join + 1, scan) if lines[i].index("+-" if "+-" in lines[i] else ":-") == lines[join].index("+-") + 3]
        assert not any("Exchange" in line for line in lines[side[-1] : scan])  # the cache's side of the join
        assert sum("Exchange" in line for line in lines) <= 2  # the asked keys, distinct and to their buckets
        found = cache.clustered_lookup(asked, table, spread_by=F.col("id"), buckets=4, rows=100)
        plain = cache.cache_lookup(asked, held, spread_by=F.col("id"))
        assert sorted(map(repr, found.select(plain.columns).collect())) == sorted(map(repr, plain.collect()))
        assert found.where("cache_hit").count() > 1000 and found.count() == 3000
        assert cache.clustered_lookup(asked.limit(0), table, spread_by=F.col("id"), buckets=4).count() == 0
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
        spark.sql("DROP TABLE clustered_cache_test")
