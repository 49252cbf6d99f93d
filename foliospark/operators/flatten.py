"""Nested pages to flat tables of blocks, lines, problems and members."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import scale

ROLES = ("stem", "choice", "explanation", "figure")


def explode_blocks(pages: DataFrame) -> DataFrame:
    """One row per block, with its source position and the page's size.

    Everything a block holds comes along: its style, picture, labels, children
    and lines, and its metadata as a whole. Pages without blocks have no rows
    here; ``nest_pages`` restores them from the pages.
    """
    rows = pages.select(
        "page_id",
        F.col("width_px").alias("page_width"),
        F.col("height_px").alias("page_height"),
        F.col("subject").alias("page_subject"),
        F.coalesce("block_offset", F.lit(0)).alias("_offset") if "block_offset" in pages.columns else F.lit(0).alias("_offset"),
        F.posexplode("blocks").alias("_pos", "b"),
    ).withColumn("pos", F.col("_offset") + F.col("_pos"))
    meta = ["column_index", "question_band_index", "fallback_reason", "display_title", "force_problem_start",
            "ocr_backend", "ocr_cache_hit", "ocr_cache_miss", "ocr_line_count", "ocr_latency_ms"]
    return rows.select(
        "page_id", "page_width", "page_height", "page_subject", "pos",
        "b.block_id", "b.block_type", "b.bbox.left", "b.bbox.top", "b.bbox.width", "b.bbox.height",
        "b.reading_order", "b.text", "b.confidence", F.col("b.style.font_size").alias("font_size"), "b.ocr_lines",
        "b.style", "b.asset", "b.labels", "b.children", F.col("b.metadata").alias("block_meta"),
        *[f"b.metadata.{m}" for m in meta],
    )


def explode_lines(blocks: DataFrame) -> DataFrame:
    """One row per recognised line; its box is relative to the block."""
    rows = blocks.select("page_id", "block_id", F.posexplode("ocr_lines").alias("line_no", "l"))
    return rows.select(
        "page_id", "block_id", "line_no", "l.text", "l.confidence",
        "l.bbox.left", "l.bbox.top", "l.bbox.width", "l.bbox.height",
    )


def explode_problems(pages: DataFrame) -> DataFrame:
    """One row per problem of a page, with its position in the page."""
    rows = pages.select("page_id", F.posexplode("problems").alias("problem_pos", "p"))
    return rows.select(
        "page_id", "problem_pos", "p.unit_id", "p.subject", "p.title",
        *[f"p.{r}_block_ids" for r in ROLES],
        F.col("p.metadata.problem_number").alias("problem_number"), F.col("p.metadata").alias("problem_meta"),
    )


def problem_members(problems: DataFrame, blocks: DataFrame) -> DataFrame:
    """Ordered member ids of each problem: stem, choice, explanation, figure.

    An id counts once, where it comes first. A problem without ids has all
    blocks of its page. A problem may come in several rows with a ``part``, as
    ``assemble_problems`` gives a very large one; it is one problem all the same.
    """
    none = F.array().cast("array<string>")
    lists = {r: F.coalesce(F.col(f"{r}_block_ids"), none) for r in ROLES}
    if "part" in problems.columns:
        unit = ["page_id", "unit_id"]
        roles = F.array(*[F.struct(F.lit(i).alias("role"), ids.alias("ids")) for i, ids in enumerate(lists.values())])
        listed = problems.select(*unit, "part", F.explode(roles).alias("r")).select(
            *unit, "part", "r.role", F.posexplode("r.ids").alias("i", "block_id")
        )
        first = listed.groupBy(*unit, "block_id").agg(F.min(F.struct("role", "part", "i")).alias("_at"))
        named = scale.rank(first, unit, [F.col("_at")], "_n")
        named = named.select(*unit, (F.col("_n") - 1).cast("int").alias("member_pos"), "block_id")
        sizes = problems.groupBy(*unit).agg(F.sum(sum((F.size(ids) for ids in lists.values()), F.lit(0))).alias("_size"))
        bare = sizes.where("_size = 0").select(*unit)
    else:
        held = problems.withColumn("_ids", F.array_distinct(F.concat(*lists.values())))
        named = held.select("page_id", "unit_id", F.posexplode("_ids").alias("member_pos", "block_id"))
        bare = held.where(F.size("_ids") == 0).select("page_id", "unit_id")
    whole = bare.join(blocks.select("page_id", F.col("pos").alias("member_pos"), "block_id"), "page_id")
    return named.unionByName(whole)


def member_blocks(members: DataFrame, blocks: DataFrame) -> DataFrame:
    """Members with their block's columns; unknown ids vanish."""
    return members.join(blocks, ["page_id", "block_id"])
