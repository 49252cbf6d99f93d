"""Board records: text or image, where they go, how large the letters are."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.functions.geometry import Box, box
from foliospark.functions.numbers import clamp
from foliospark.settings import (
    CANVAS_PAGE_HEIGHT,
    CANVAS_WIDTH,
    FIGURE_TYPES,
    IMAGE_RECORD_TYPES,
    PAGE_RECORD_LEFT_MARGIN,
    PAGE_RECORD_TOP_MARGIN,
    RECORD_LEFT_MARGIN,
    RECORD_TOP_PADDING,
    TEXT_CONFIDENCE,
    TEXT_RECORD_TYPES,
    Template,
)

DEFAULT_TEMPLATE = Template()


def record_mode(block_type: Column, written: Column, confidence: Column, threshold: float = TEXT_CONFIDENCE) -> Column:
    """text or image, given whether the block has text; no confidence counts as 0."""
    is_image = (
        block_type.isin(*IMAGE_RECORD_TYPES)
        | ~written
        | ~block_type.isin(*TEXT_RECORD_TYPES)
        | (F.coalesce(confidence, F.lit(0.0)) < threshold)
    )
    return F.when(is_image, "image").otherwise("text")


def page_record_mode(block_type: Column, text: Column) -> Column:
    """Page export: text if there is any, unless the block is a figure."""
    return F.when(F.coalesce(text != "", F.lit(False)) & ~block_type.isin(*FIGURE_TYPES), "text").otherwise("image")


def style_size(height: Column) -> Column:
    """Font size given to a recognised block."""
    return F.greatest(F.lit(10.0), height * 0.35)


def font_size(style: Column, height: Column, scale_factor: Column) -> Column:
    """Font size of a text record in a problem."""
    base = F.coalesce(F.when(style != 0, style), F.greatest(F.lit(14.0), height * 0.32))
    return clamp(F.bround(base * F.greatest(scale_factor, F.lit(0.25)) * 0.9, 0), 10, 40).cast("int")


def page_font_size(height: Column) -> Column:
    """Font size of a text record on a page board."""
    return clamp(F.bround(height * 0.22, 0), 10, 28).cast("int")


def _normalised(target: Box, pages: int) -> dict[str, Column]:
    tall = CANVAS_PAGE_HEIGHT * pages
    return {
        "x": target.left / CANVAS_WIDTH, "y": target.top / tall,
        "w": target.width / CANVAS_WIDTH, "h": target.height / tall,
    }


def place_blocks(members: DataFrame, template: Template = DEFAULT_TEMPLATE) -> DataFrame:
    """Page coordinates to normalised board coordinates within a problem (P10).

    ``members`` has the block's box, the problem's bound_* box and start_y.
    """
    b, bound = box(), box("bound_")
    room = F.lit(template.content_width)
    ratio = room / F.greatest(bound.width, F.lit(1.0))
    top = F.col("start_y") * CANVAS_PAGE_HEIGHT + RECORD_TOP_PADDING
    target = Box(
        F.lit(RECORD_LEFT_MARGIN) + F.greatest(F.lit(0.0), b.left - bound.left) * ratio,
        top + F.greatest(F.lit(0.0), b.top - bound.top) * ratio,
        F.greatest(F.lit(40.0), F.least(room, b.width * ratio)),
        F.greatest(F.lit(22.0), b.height * ratio),
    )
    return members.withColumns({"scale": ratio, **_normalised(target, template.board_page_count)})


def place_page_blocks(blocks: DataFrame, template: Template = DEFAULT_TEMPLATE) -> DataFrame:
    """Board coordinates when the page is the unit (P10); needs page_width and start_y."""
    b = box()
    ratio = F.lit(CANVAS_WIDTH * template.left_zone_ratio) / F.greatest(F.col("page_width"), F.lit(1))
    target = Box(
        F.lit(PAGE_RECORD_LEFT_MARGIN) + b.left * ratio,
        F.col("start_y") * CANVAS_PAGE_HEIGHT + PAGE_RECORD_TOP_MARGIN + b.top * ratio,
        F.greatest(F.lit(16.0), b.width * ratio),
        F.greatest(F.lit(16.0), b.height * ratio),
    )
    placed = blocks.withColumns({"scale": ratio, **_normalised(target, template.board_page_count)})
    return placed.withColumn("font_size", page_font_size(target.height))


def image_records(placements: DataFrame, template: Template = DEFAULT_TEMPLATE) -> DataFrame:
    """Board coordinates of one picture per placement, as wide as the content zone (P10).

    All records of a board made of pictures only, and the one record of a
    problem without blocks. Needs start_y and content_height.
    """
    target = Box(
        F.lit(RECORD_LEFT_MARGIN).cast("double"), F.col("start_y") * CANVAS_PAGE_HEIGHT + RECORD_TOP_PADDING,
        F.lit(template.content_width).cast("double"), F.col("content_height") * CANVAS_PAGE_HEIGHT,
    )
    return placements.withColumns(_normalised(target, template.board_page_count))


def board_records(placed: DataFrame, placements: DataFrame, template: Template = DEFAULT_TEMPLATE) -> DataFrame:
    """All records of a board: the placed blocks, and one picture for each problem that has none (P10).

    ``placed`` is what ``place_blocks`` gives; ``placements`` has unit_id, start_y and content_height. A picture's
    block_id is null.
    """
    columns = ["unit_id", "block_id", "record_mode", *"xywh"]
    bare = placements.join(placed.select("unit_id").distinct(), "unit_id", "left_anti")
    pictures = image_records(bare, template).withColumns(
        {"block_id": F.lit(None).cast(placed.schema["block_id"].dataType), "record_mode": F.lit("image")}
    )
    return placed.select(*columns).unionByName(pictures.select(*columns))


def record_counts(records: DataFrame, unit: list[str], units: DataFrame | None = None) -> DataFrame:
    """Text and image records per placement; header flag 4 with images, else 3.

    With ``units``, all problems, one without records counts as its one fallback picture.
    """
    image = F.count(F.when(F.col("record_mode") == "image", 1))
    counted = records.groupBy(*unit).agg(
        F.count(F.when(F.col("record_mode") == "text", 1)).alias("text_record_count"), image.alias("image_record_count")
    )
    if units is not None:
        counted = units.select(*unit).distinct().join(counted, unit, "left")
        none = F.col("text_record_count").isNull()
        counted = counted.withColumns({
            "text_record_count": F.when(none, 0).otherwise(F.col("text_record_count")),
            "image_record_count": F.when(none, 1).otherwise(F.col("image_record_count")),
        })
    return counted.withColumn("header_flag", F.when(F.col("image_record_count") > 0, 4).otherwise(3))


def record_inventory(records: DataFrame, first: int = 5, rows: int | None = None) -> DataFrame:
    """Per file: text, image and other records, first text and image previews.

    ``records`` has file_id, record_no, text, image_count and preview.
    """
    is_image = F.col("image_count") > 0
    is_text = F.col("text").isNotNull()
    totals = records.groupBy("file_id").agg(
        F.count(F.lit(1)).alias("record_count"), F.count(F.when(is_text, 1)).alias("text_count"),
        F.count(F.when(is_image, 1)).alias("image_count"),
        F.count(F.when(~is_image & ~is_text, 1)).alias("other_count"),
    )

    def earliest(kind: Column, value: str, name: str) -> DataFrame:
        # Best few of each slice, then of those: a huge file never meets one task.
        cut = scale.by_position(records.where(kind), "record_no", rows)
        few = top_rows(cut, ["file_id", scale.SLICE], "record_no", first)
        best = top_rows(few, ["file_id"], "record_no", first)
        folded = F.sort_array(F.collect_list(F.struct("record_no", value)))
        return best.groupBy("file_id").agg(F.transform(folded, lambda e: e[value]).alias(name))

    texts = earliest(is_text, "text", "text_preview")
    texts = texts.withColumn("text_preview", F.filter("text_preview", lambda s: s != ""))
    images = earliest(is_image, "preview", "image_preview")
    none = F.array().cast("array<string>")
    return totals.join(texts, "file_id", "left").join(images, "file_id", "left").withColumns(
        {"text_preview": F.coalesce("text_preview", none), "image_preview": F.coalesce("image_preview", none)}
    )


def top_rows(df: DataFrame, keys: list[str], order: str, count: int) -> DataFrame:
    """The first rows of each group (K1, K2). Spark keeps only the leading rows per task."""
    from pyspark.sql import Window

    place = F.row_number().over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("_place", place).where(F.col("_place") <= count).drop("_place")
