"""Drop-folder ingest of page files."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import LongType

from foliospark.operators.flatten import explode_blocks, explode_lines, explode_problems
from foliospark.schema import PAGE_DDL


BATCH_BYTES = 256 * 2**20  # page files of one batch that is held while its tables are written


def page_stream(
    spark: SparkSession, folder: str, *, max_files: int = 1000, max_bytes: int | None = None, json_lines: bool = False
) -> DataFrame:
    """New page files of a folder as a stream; schema given, files in batches bounded by number, or by bytes if given."""
    limit = ("maxFilesPerTrigger", max_files) if max_bytes is None else ("maxBytesPerTrigger", max_bytes)
    return (
        spark.readStream.schema(PAGE_DDL)
        .option("multiLine", not json_lines)
        .option(*limit)
        .json(folder)
        .select("*", F.col("_metadata.file_path").alias("file_path"))
    )


def ingest_stream(
    spark: SparkSession, folder: str, out: str, checkpoint: str, *, table: str = "blocks", max_files: int = 1000,
    json_lines: bool = False,
) -> StreamingQuery:
    """Append the blocks, lines or problems of new page files to a table, each file once.

    Runs over what is there and stops. The checkpoint and the file sink's log
    make a restart neither lose nor repeat files; each table has a checkpoint of
    its own.
    """
    pages = page_stream(spark, folder, max_files=max_files, json_lines=json_lines)
    if table == "blocks":
        rows = explode_blocks(pages)
    elif table == "lines":
        rows = explode_lines(explode_blocks(pages))
    else:
        rows = explode_problems(pages)
    return (
        rows.writeStream.format("parquet")
        .option("path", out)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


TABLES: dict[str, Callable[[DataFrame], DataFrame]] = {
    "blocks": explode_blocks,
    "lines": lambda pages: explode_lines(explode_blocks(pages)),
    "problems": explode_problems,
}
COMMIT = "batch_id bigint, pages bigint, " + ", ".join(f"{name} bigint" for name in TABLES)


def ingest_pages(
    spark: SparkSession, folder: str, out: str, checkpoint: str, *, max_files: int | None = None,
    max_bytes: int = BATCH_BYTES, json_lines: bool = False,
) -> StreamingQuery:
    """Append blocks, lines and problems of new page files to the three tables under ``out``, from one read.

    Each batch is parsed once, held while its rows are written, and counted by the writes themselves. A batch has a
    folder of its own in every table, named by its number, and a row in ``commits``, written last. If a batch is run again
    after a failure, it replaces what it left, so nothing is lost or doubled; ``ingested`` shows committed batches only.
    A batch is bounded by bytes, so that what is held stays in memory; ``max_files`` bounds it by number instead.
    Runs over what is there and stops.
    """

    def write(pages: DataFrame, batch_id: int) -> None:
        pages = pages.persist()
        seen = {name: Observation(name) for name in TABLES}
        for name, rows_of in TABLES.items():
            rows = rows_of(pages).observe(seen[name], F.count(F.lit(1)).alias("n"))
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{out}/{name}/batch_id={batch_id}")
        counts = (pages.count(), *[seen[name].get["n"] for name in TABLES])
        commit = pages.sparkSession.createDataFrame([(batch_id, *counts)], COMMIT).coalesce(1)
        commit.write.mode("overwrite").parquet(f"{out}/commits/{batch_id}")
        pages.unpersist()

    limit = {"max_bytes": max_bytes} if max_files is None else {"max_files": max_files}
    pages = page_stream(spark, folder, **limit, json_lines=json_lines)
    return (
        pages.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def commits(spark: SparkSession, out: str) -> DataFrame:
    """A row for each finished batch: batch_id and its numbers of pages, blocks, lines and problems."""
    return spark.read.schema(COMMIT).option("recursiveFileLookup", True).parquet(f"{out}/commits")


def ingested(spark: SparkSession, out: str, table: str) -> DataFrame:
    """The rows of finished batches of blocks, lines or problems, with their batch_id."""
    empty = spark.createDataFrame([], PAGE_DDL)
    schema = TABLES[table](empty).schema.add("batch_id", LongType())
    done = commits(spark, out).select("batch_id")
    return spark.read.schema(schema).parquet(f"{out}/{table}").join(done, "batch_id", "left_semi")
