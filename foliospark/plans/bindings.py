"""The given tables seen as layout tables.

Each view is a plain projection, explode or aggregate of one given table, so
its size follows the table's. The same definitions stand in SQL in
``plans.oracle``.
"""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import scale

SUBJECT_OF_LANGUAGE = {"en": "english", "fr": "social", "de": "science", "es": "math"}


class Tables:
    """Lazy access to the given parquet tables and the views on them."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark = spark
        self.folder = folder
        self._made: dict = {}

    def once(self, name: str, make):
        """Something that several parts of a query use, made once."""
        if name not in self._made:
            self._made[name] = make()
        return self._made[name]

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.folder}/{name}.parquet")

    def spread(self, name: str) -> DataFrame:
        """A table read by at least as many tasks as there are cores.

        A small file has fewer splits than cores and is dealt out; a large one
        has plenty and is left as it is.
        """
        df = self.table(name)
        cores = self.spark.sparkContext.defaultParallelism
        return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df

    # ------------------------------------------------------------ documents
    @cached_property
    def pages(self) -> DataFrame:
        """One page per document."""
        subject = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in SUBJECT_OF_LANGUAGE.items()], F.lit("unknown"))
        d = self.spread("documents")
        lines = F.size(F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != ""))
        return d.select(
            F.col("doc_id").cast("string").alias("page_id"), F.col("source"), subject.alias("page_subject"),
            F.lit(800).alias("page_width"), (lines * 60 + 80).alias("page_height"), "doc_id",
        )

    @cached_property
    def blocks(self) -> DataFrame:
        """One block per line of a document, with injected markers and boxes."""
        subject = F.coalesce(*[F.when(F.col("lang") == k, v) for k, v in SUBJECT_OF_LANGUAGE.items()], F.lit("unknown"))
        lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
        rows = self.spread("documents").select("doc_id", "source", subject.alias("page_subject"), lines.alias("ls"))
        rows = rows.select(
            "doc_id", "source", "page_subject", (F.size("ls") * 60 + 80).alias("page_height"),
            F.posexplode_outer("ls").alias("pos", "line"),
        ).where(F.col("pos").isNotNull())
        n = F.col("pos")
        text = (
            F.when(n % 5 == 0, F.concat((F.floor(n / 5) + 1).cast("string"), F.lit(". "), F.col("line")))
            .when(n % 5 == 3, F.concat(F.lit("① "), F.col("line")))
            .when(n % 5 == 4, F.lit(None).cast("string"))
            .otherwise(F.col("line"))
        )
        page = F.col("doc_id").cast("string")
        return rows.select(
            page.alias("page_id"), "doc_id", "source", "page_subject", F.lit(800).alias("page_width"), "page_height",
            "pos", F.concat(page, F.format_string("-block-%03d", n + 1)).alias("block_id"),
            F.when(n % 5 == 4, "image").otherwise("stem").alias("block_type"),
            ((n % 2) * 400).cast("double").alias("left"), (F.floor(n / 2) * 60).cast("double").alias("top"),
            (F.length("line") % 300 + 40).cast("double").alias("width"), F.lit(40.0).alias("height"),
            n.alias("reading_order"), text.alias("text"), "line",
            (((F.col("doc_id") * 31 + n * 17) % 100) / 100).alias("confidence"),
            F.when((F.col("doc_id") % 5 != 0) | (n > 0), (n % 2 + 1).cast("int")).alias("column_index"),
            F.when(F.col("doc_id") % 4 != 0, (F.floor(n / 2) + 1).cast("int")).alias("question_band_index"),
            F.when(n % 7 == 6, "noop_ocr").when(n % 11 == 10, "empty_segmentation").alias("fallback_reason"),
            F.when(n % 13 == 12, F.concat(F.lit("문항 "), (n % 90 + 1).cast("string"), F.lit(". "), F.col("line"))).alias(
                "display_title"
            ),
            F.lit(False).alias("force_problem_start"),
        )

    @cached_property
    def read_blocks(self) -> DataFrame:
        """Blocks with their lines inside, as page files have them."""
        n = F.col("pos")

        def line(s, i):
            text = (
                F.when((i == 0) & (n % 5 == 0), F.concat((F.floor(n / 5) + 1).cast("string"), F.lit(". "), s))
                .when((i == 1) & (n % 5 == 1), F.concat((n % 9 + 1).cast("string"), F.lit(") "), s))
                .when((i == 2) & (n % 3 == 2), F.concat(F.lit("["), (n % 99 + 1).cast("string"), F.lit("] "), s))
                .otherwise(s)
            )
            box = F.struct(((i % 3) * 30).cast("double").alias("left"), (i * 6).cast("double").alias("top"))
            return F.struct(text.alias("text"), box.alias("bbox"))

        lines = F.transform(F.split("line", "\\. "), line)
        return self.blocks.withColumn("ocr_lines", F.when(F.col("text").isNotNull(), lines))

    @cached_property
    def box_table(self) -> DataFrame:
        return scale.staged(self.boxes)

    @cached_property
    def block_table(self) -> DataFrame:
        """The blocks as a written table, for work that reads them more than once."""
        return scale.staged(self.blocks)

    @cached_property
    def lines(self) -> DataFrame:
        """One line per sentence of a block, some with numbers of their own."""
        rows = self.blocks.where("text is not null").select(
            "page_id", "block_id", "pos", F.posexplode(F.split("line", "\\. ")).alias("line_no", "s")
        )
        i, n = F.col("line_no"), F.col("pos")
        text = (
            F.when((i == 0) & (n % 5 == 0), F.concat((F.floor(n / 5) + 1).cast("string"), F.lit(". "), F.col("s")))
            .when((i == 1) & (n % 5 == 1), F.concat((n % 9 + 1).cast("string"), F.lit(") "), F.col("s")))
            .when((i == 2) & (n % 3 == 2), F.concat(F.lit("["), (n % 99 + 1).cast("string"), F.lit("] "), F.col("s")))
            .otherwise(F.col("s"))
        )
        return rows.select(
            "page_id", "block_id", "line_no", text.alias("text"), (((i * 13 + n * 7) % 100) / 100).alias("confidence"),
            ((i % 3) * 30).cast("double").alias("left"), (i * 6).cast("double").alias("top"),
            (F.length("s") % 200 + 20).cast("double").alias("width"), F.lit(12.0).alias("height"),
        )

    # --------------------------------------------------------------- others
    @cached_property
    def turns(self) -> DataFrame:
        return self.table("conversations")

    @cached_property
    def heights(self) -> DataFrame:
        """One problem per order, one board per customer."""
        subject = (
            F.when(F.col("o_orderpriority") == "1-URGENT", "math")
            .when(F.col("o_orderpriority") == "2-HIGH", "korean")
            .when(F.col("o_orderpriority") == "3-MEDIUM", "science")
            .when(F.col("o_orderpriority") == "5-LOW", "english")
            .otherwise("unknown")
        )
        return self.table("orders").select(
            F.col("o_custkey").alias("board_id"), F.col("o_orderdate").alias("placed_on"),
            F.col("o_orderkey").alias("problem_id"), (F.floor("o_totalprice") / 100000).alias("height_pages"),
            subject.alias("subject"), (F.col("o_orderkey") % 7 == 0).alias("heavy"),
            F.when(F.col("o_orderkey") % 11 == 0, F.col("o_orderstatus") == "F").alias("allowed"),
        )

    @cached_property
    def boxes(self) -> DataFrame:
        """One box per line item, one page per order."""
        order = [F.col(c) for c in self.table("lineitem").columns]
        ranked = scale.rank(self.table("lineitem"), ["l_orderkey"], order, "box_id")
        return ranked.select(
            F.col("l_orderkey").alias("page_id"), "box_id",
            F.col("l_quantity").alias("left"), (F.col("l_linenumber") * 10).cast("double").alias("top"),
            (F.col("l_discount") * 1000).alias("width"), (F.col("l_tax") * 1000).alias("height"),
            (F.col("l_extendedprice") / 100000).alias("fill_ratio"),
        )

    @cached_property
    def marks(self) -> DataFrame:
        """One marked point per event; position is the hour since the first day."""
        start = F.lit("2024-01-01 00:00:00").cast("timestamp").cast("bigint")
        hour = F.floor((F.col("ts").cast("timestamp").cast("bigint") - start) / 3600)
        return self.table("events").select(F.col("user_id").alias("series_id"), hour.cast("bigint").alias("pos"), "event_type")
