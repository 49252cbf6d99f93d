"""Page files, source files, plan files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.functions import text as tx
from foliospark.scale import Running
from foliospark.schema import ASSET, BLOCK_META, LINE, PAGE_DDL, STYLE
from foliospark.settings import IMAGE_EXTENSIONS, Template


def read_pages(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Page files, each one JSON array of pages or JSON lines.

    The schema is given, so nothing is inferred: missing keys are null, unknown
    keys are left out.
    """
    paths = [path] if isinstance(path, str) else list(path)
    pages = spark.read.schema(PAGE_DDL).option("multiLine", True).json(paths)
    return pages.select("*", F.col("_metadata.file_path").alias("file_path"))


def read_page_lines(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Pages as JSON lines, one page per line; such files can be split between tasks."""
    paths = [path] if isinstance(path, str) else list(path)
    return spark.read.schema(PAGE_DDL).json(paths).select("*", F.col("_metadata.file_path").alias("file_path"))


def nest_pages(
    blocks: DataFrame, grouped: DataFrame, part_items: int | None = None, *, pages: DataFrame | None = None,
    titles: DataFrame | None = None,
) -> DataFrame:
    """Blocks and their problems back to page rows.

    A page of very many blocks becomes several rows with the same page_id, each
    a bounded part that knows the place of its first block; reading them again
    gives the same blocks, positions and problems. Block columns that are absent
    are written as null; a metadata column beside ``block_meta`` replaces its
    entry. ``pages`` adds source path, page metadata and pages without blocks;
    ``titles`` (page_id, unit_id, title, problem_meta) adds what a problem knows.
    """
    size = part_items or scale.PART_ITEMS
    held = lambda n, d: F.col(n).cast(d).alias(n) if n in blocks.columns else F.lit(None).cast(d).alias(n)
    box = F.struct(*[F.col(n).cast("double").alias(n) for n in ("left", "top", "width", "height")])
    old = lambda n, d: F.col("block_meta")[n].cast(d).alias(n) if "block_meta" in blocks.columns else F.lit(None).cast(d).alias(n)
    style = F.struct(F.col("font_size").cast("double").alias("font_size")).cast("struct<font_size:double>") if "font_size" in blocks.columns else None
    known_style = held("style", STYLE) if "style" in blocks.columns or style is None else F.from_json(F.to_json(style), STYLE).alias("style")
    block = F.struct(
        "block_id", "block_type", box.alias("bbox"), F.col("reading_order").cast("int").alias("reading_order"), "text",
        known_style, held("confidence", "double"), held("asset", ASSET), held("ocr_lines", f"array<{LINE}>"),
        held("labels", "array<string>"), held("children", "array<string>"),
        F.struct(*[held(n, d) if n in blocks.columns else old(n, d) for n, d in BLOCK_META.items()]).alias("metadata"),
    )
    facts = [F.min(n).alias(n) for n in ("page_width", "page_height", "page_subject")]  # one value a page; grouped as it is joined below
    rows = scale.folded(blocks, ["page_id"], F.col("reading_order"), {"blocks": block}, totals=facts, part_items=part_items)
    lists = {
        f"{r}_block_ids": F.when(F.col("role") == r, F.col("block_id")) for r in ("stem", "choice", "explanation", "figure")
    }
    units = scale.folded(
        grouped, ["page_id", "unit_id", "problem_index", "subject"], F.col("reading_order"), lists, part_items=part_items
    )
    known = ["title", "problem_meta"] if titles is not None else []
    if titles is not None:
        units = units.join(titles.select("page_id", "unit_id", *known), ["page_id", "unit_id"], "left")
    unit = F.struct("unit_id", "subject", *[F.col("problem_meta").alias("metadata") if n == "problem_meta" else F.col(n) for n in known], *lists)
    held_units = scale.folded(
        units.withColumn("_at", F.col("problem_index")).withColumnRenamed("part", "_unit_part"),
        ["page_id"], F.col("_at"), {"problems": unit}, part_items=part_items,
    )
    made = rows.join(held_units, ["page_id", "part"], "full")
    offset = (F.col("part") * size).cast("int").alias("block_offset")
    width, height, subject = F.col("page_width").cast("int"), F.col("page_height").cast("int"), F.col("page_subject")
    if pages is None:
        return made.select(
            "page_id", width.alias("width_px"), height.alias("height_px"), subject.alias("subject"), "blocks", "problems", offset
        )
    once = pages.where("coalesce(block_offset, 0) = 0") if "block_offset" in pages.columns else pages
    facts = once.select("page_id", "width_px", "height_px", F.col("subject").alias("_subject"), "source_path", "metadata")
    facts = facts.dropDuplicates(["page_id"])
    none = lambda n: F.coalesce(n, F.expr(f"filter({n}, x -> false)"), F.array().cast(made.schema[n].dataType)).alias(n)
    return made.join(facts, "page_id", "full").select(
        "page_id", F.coalesce(width, "width_px").alias("width_px"), F.coalesce(height, "height_px").alias("height_px"),
        F.coalesce(subject, "_subject").alias("subject"), "source_path", none("blocks"), none("problems"), "metadata",
        F.coalesce(offset, F.lit(0)).alias("block_offset"),
    )


def write_pages(
    blocks: DataFrame, grouped: DataFrame, path: str, *, format: str = "json", mode: str = "error",
    pages: DataFrame | None = None, titles: DataFrame | None = None,
) -> None:
    """Write page rows as JSON lines or parquet."""
    nest_pages(blocks, grouped, pages=pages, titles=titles).write.format(format).mode(mode).save(path)


def classify_sources(files: DataFrame) -> DataFrame:
    """Kind of each source file by its extension, in any case (S3); null if not supported."""
    name = F.element_at(F.split("path", "/"), -1)
    extension = F.lower(F.regexp_extract(name, r"\.([^.]+)$", 1))
    return files.withColumns(
        {
            "file_name": name,
            "stem": F.regexp_replace(name, r"\.[^.]+$", ""),
            "source_kind": F.when(extension == "pdf", "pdf").when(extension.isin(*IMAGE_EXTENSIONS), "image"),
        }
    )


def discover_sources(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """Source files of a folder and the files of other types (S3). Contents are not read."""
    listed = (
        spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder)
        .select("path", F.col("length").alias("size"), F.col("modificationTime").alias("modified"))
    )
    named = classify_sources(listed)
    return named.where("source_kind is not null"), named.where("source_kind is null").drop("source_kind")


def number_pages(sources: DataFrame, rows: int | None = None) -> DataFrame:
    """Page ids and numbers of batches of sources.

    ``sources`` has batch_id, source_index (from 1), stem and page_count. Page
    numbers run through the batch. The source index is part of the id unless
    the batch has one source.
    """
    cut = scale.with_group_facts(
        scale.by_position(sources, "source_index", rows), ["batch_id"],
        [F.count(F.lit(1)).cast("int").alias("batch_total_sources")],
    )
    counted = scale.running(
        cut, ["batch_id"], [F.col("source_index")], {"_before": Running("sum", F.col("page_count"), before=True)}
    )
    pages = counted.where("page_count > 0").withColumn("original_page_index", F.explode(F.sequence(F.lit(1), F.col("page_count"))))
    page = F.format_string("-page-%03d", "original_page_index")
    several = F.concat("stem", F.format_string("-%02d", "source_index"), page)
    return pages.withColumns(
        {
            "page_id": F.when(F.col("batch_total_sources") > 1, several).otherwise(F.concat("stem", page)),
            "page_number": (F.col("_before") + F.col("original_page_index")).cast("bigint"),
        }
    ).drop("_before", scale.SLICE)


def union_sources(frames: Sequence[DataFrame]) -> DataFrame:
    """Pages of several sources in one frame, with their source's place."""
    held = [f.withColumn("batch_source_index", F.lit(i)) for i, f in enumerate(frames, start=1)]
    out = held[0]
    for frame in held[1:]:
        out = out.unionByName(frame, allowMissingColumns=True)
    return out


def write_plan(placements: DataFrame, summary: DataFrame, template: Template, path: str, *, board: str = "board_id") -> None:
    """Write placements by board group, their summary and the template.

    Boards are many and small, so files are laid out by a hash of the board, not
    one folder per board.
    """
    shelf = F.pmod(F.xxhash64(board), F.lit(64)).cast("int")
    placements.withColumn("board_shelf", shelf).write.partitionBy("board_shelf").parquet(f"{path}/placements")
    summary.write.parquet(f"{path}/summary")
    spark = placements.sparkSession
    row = (
        template.name, template.board_page_count, template.slot_height, template.left_zone_ratio,
        template.preserve_writing_zone, list(template.overflow_subjects),
    )
    spark.createDataFrame(
        [row],
        "name string, board_page_count int, base_slot_height_pages double, fixed_left_zone_ratio double, "
        "preserve_right_writing_zone boolean, default_overflow_subjects array<string>",
    ).write.parquet(f"{path}/template")


def read_plan(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(f"{path}/placements").drop("board_shelf")


def write_feed(feed: DataFrame, header: DataFrame, path: str) -> None:
    """Write a session feed and its header as JSON lines."""
    feed.write.json(f"{path}/problems")
    header.write.json(f"{path}/sessions")


def redact(settings: DataFrame, column: str = "settings") -> DataFrame:
    """Settings maps without their secrets."""
    return settings.withColumn(column, tx.redact_settings(F.col(column)))
