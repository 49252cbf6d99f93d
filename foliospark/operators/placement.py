"""Problem bounds and heights, slot packing on boards, board checks."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.functions.geometry import Box, box, expand, from_edges
from foliospark.functions.numbers import clamp
from foliospark.operators.grouping import role_counts, with_titles
from foliospark.scale import Running
from foliospark.settings import (
    CANVAS_PAGE_HEIGHT,
    CANVAS_WIDTH,
    EPSILON,
    LANGUAGE_SUBJECTS,
    MIN_PROBLEM_AREA_RATIO,
    PAGE_RECORD_TOP_MARGIN,
    PROBLEM_PADDING,
    Template,
)

DEFAULT_TEMPLATE = Template()


# ------------------------------------------------------------------- bounds
def problem_bounds(member_blocks: DataFrame, problems: DataFrame, padding: float = PROBLEM_PADDING) -> DataFrame:
    """Box around a problem's blocks, padded and clipped to the page.

    ``problems`` has page_id, unit_id, page_width and page_height. A problem
    without blocks covers the whole page.
    """
    b = box()
    edges = member_blocks.groupBy("page_id", "unit_id").agg(
        F.min(b.left).alias("_l"), F.min(b.top).alias("_t"), F.max(b.right).alias("_r"), F.max(b.bottom).alias("_b"),
        F.count(F.lit(1)).alias("member_count"),
        (F.count("question_band_index") > 0 if "question_band_index" in member_blocks.columns else F.lit(False)).alias(
            "has_band"
        ),
    )
    wide, high = F.col("page_width").cast("double"), F.col("page_height").cast("double")
    whole = F.col("_l").isNull()
    raw = from_edges(
        F.coalesce("_l", F.lit(0.0)), F.coalesce("_t", F.lit(0.0)), F.coalesce("_r", wide), F.coalesce("_b", high)
    )
    grown = expand(raw, padding, wide, high)
    held = problems.join(edges, ["page_id", "unit_id"], "left")
    page_box = Box(F.lit(0.0), F.lit(0.0), wide, high)
    return held.withColumns(
        {
            **{f"bound_{n}": F.when(whole, page_box.columns()[n]).otherwise(c) for n, c in grown.columns().items()},
            "member_count": F.coalesce("member_count", F.lit(0)),
            "has_band": F.coalesce("has_band", F.lit(False)),
        }
    ).drop("_l", "_t", "_r", "_b")


def min_area_fallback(bounds: DataFrame) -> DataFrame:
    """A small problem without band data takes the whole page."""
    wide, high = F.col("page_width").cast("double"), F.col("page_height").cast("double")
    area = F.col("bound_width") * F.col("bound_height")
    small = ~F.col("has_band") & (area < wide * high * MIN_PROBLEM_AREA_RATIO)
    page_box = {"left": F.lit(0.0), "top": F.lit(0.0), "width": wide, "height": high}
    return bounds.withColumns(
        {"whole_page": small, **{f"bound_{n}": F.when(small, v).otherwise(F.col(f"bound_{n}")) for n, v in page_box.items()}}
    )


def bounded_members(members: DataFrame, bounds: DataFrame, blocks: DataFrame) -> DataFrame:
    """Members after R11: a whole-page problem has every block of its page."""
    units = bounds.select("page_id", "unit_id", "whole_page")
    kept = scale.keyed_join(
        members, units.where(~F.col("whole_page")).drop("whole_page"), ["page_id", "unit_id"], spread_by=F.col("block_id")
    )
    # Every such problem repeats its page's blocks; the join is split by stretches of the page.
    grown = scale.by_position(blocks, "reading_order")
    spread = grown.groupBy("page_id", scale.SLICE).agg(F.count(F.lit(1)).alias("_n")).drop("_n")
    spread = units.where("whole_page").drop("whole_page").join(spread, "page_id")
    grown = grown.join(spread, ["page_id", scale.SLICE])
    columns = [c for c in kept.columns if c in grown.columns]
    return kept.select(*columns).unionByName(grown.select(*columns))


# ------------------------------------------------------------------ heights
def spread_height(top: Column, bottom: Column, page_height: Column, figure: Column, choice: Column, language: Column,
                  minimum: float = 0.35) -> Column:
    """Height in pages from the blocks' spread and what they hold."""
    norm = F.greatest(F.lit(0.0), (bottom - top) / F.greatest(page_height, F.lit(1)))
    # What figures, choices and language problems add.
    bonus = [F.when(c, v).otherwise(0.0) for c, v in ((figure, 0.18), (choice, 0.08), (language, 0.08))]
    estimate = norm * 1.2 + bonus[0] + bonus[1] + bonus[2]
    return F.bround(F.when(top.isNull(), max(minimum, 0.9)).otherwise(clamp(estimate, minimum, 2.4)), 6)


def crop_height(width: Column, height: Column, template: Template = DEFAULT_TEMPLATE) -> Column:
    """Height in pages of a crop scaled to the content width."""
    scaled = F.lit(template.content_width) * (height / F.greatest(width, F.lit(1)))
    return clamp(scaled / CANVAS_PAGE_HEIGHT, 0.72, 4.8)


def page_height(width: Column, height: Column, template: Template = DEFAULT_TEMPLATE) -> Column:
    """Height in pages of a whole page placed as one unit."""
    zone = CANVAS_WIDTH * template.left_zone_ratio
    scaled = F.lit(zone) * (height / width)
    estimate = F.bround((F.lit(PAGE_RECORD_TOP_MARGIN) + scaled + 32.0) / CANVAS_PAGE_HEIGHT, 4)
    return F.when(width <= 0, template.slot_height).otherwise(F.greatest(F.lit(0.6), estimate))


def is_language(subject: Column) -> Column:
    return F.coalesce(subject.isin(*LANGUAGE_SUBJECTS), F.lit(False))


def reading_heavy(subject: Column, choice_count: Column, figure_count: Column) -> Column:
    """Language subject, or a problem with choices or figures."""
    return is_language(subject) | (choice_count > 0) | (figure_count > 0)


def overflow_allowed(explicit: Column, heavy: Column, subject: Column, template: Template = DEFAULT_TEMPLATE) -> Column:
    """Explicit setting, else reading-heavy, else by subject."""
    return F.coalesce(explicit, heavy | F.coalesce(subject.isin(*template.overflow_subjects), F.lit(False)))


def layout_inputs(grouped: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """Placement inputs of each problem: height, flags, counts, title."""
    b = box()
    member = F.col("role").isNotNull()
    spans = grouped.groupBy("page_id", "problem_index", "page_height").agg(
        F.min(F.when(member, b.top)).alias("_top"),
        F.max(F.when(member, b.bottom)).alias("_bottom"),
        *role_counts("stem", "choice", "figure"),
    )
    first = grouped.where("opens").select("page_id", "problem_index", "unit_id", "block_id", "subject")
    units = with_titles(first, titles).join(spans, ["page_id", "problem_index"])
    figure, choice = F.col("figure_count") > 0, F.col("choice_count") > 0
    return units.withColumns(
        {
            "height_pages": spread_height(
                F.col("_top"), F.col("_bottom"), F.col("page_height"), figure, choice, is_language(F.col("subject"))
            ),
            "heavy": reading_heavy(F.col("subject"), F.col("choice_count"), F.col("figure_count")),
        }
    ).drop("_top", "_bottom", "page_height")


# ------------------------------------------------------------------ placing
def _slots(value: Column, slot: float) -> Column:
    """Slots needed to reach at least ``value`` pages."""
    return F.greatest(F.lit(0), F.ceil((value - EPSILON) / slot)).cast("bigint")


def place(
    heights: DataFrame,
    board: Sequence[str],
    order: Sequence[str],
    template: Template = DEFAULT_TEMPLATE,
    *,
    start: float = 0.0,
    decimals: int = 6,
    rows: int | None = None,
) -> DataFrame:
    """Pack problems one after the other, each on the next free slot.

    ``heights`` has height_pages, subject, heavy and a nullable allowed flag.
    Every start is a whole number of slots, so the cursor is the running sum of
    the slots each problem fills; a board is one group of that sum.
    """
    slot = template.slot_height
    height = F.greatest(F.col("height_pages"), F.lit(0.0))
    first = math.ceil((start - EPSILON) / slot) if start > 0 else 0
    sized = heights.withColumn("_slots", _slots(F.bround(height, decimals), slot))
    order_columns = [F.col(c) for c in order]
    cut, sliced = scale.by_order(sized, board, order_columns, sized_by=heights, rows=rows)
    placed = scale.running(
        cut, board, order_columns,
        {"_end": Running("sum", F.col("_slots")), "seq": Running("sum", F.lit(1).cast("bigint"))},
        sliced=sliced,
    )
    begin = F.col("_end") - F.col("_slots") + first
    overflow = F.greatest(F.lit(0.0), height - slot)
    allowed = overflow_allowed(F.col("allowed"), F.col("heavy"), F.col("subject"), template)
    placed = placed.withColumns(
        {
            "seq": F.col("seq") - 1,
            "start_y": F.bround(begin * F.lit(slot), decimals),
            "content_height": height,
            "next_start_y": F.bround((F.col("_end") + first) * F.lit(slot), decimals),
            "overflow_allowed": allowed,
            "overflow_amount": F.bround(overflow, decimals),
            "overflow_violation": (overflow > 0) & ~allowed,
            "slot_span": F.greatest(F.lit(1), F.col("_slots")).cast("int"),
        }
    )
    placed = placed.withColumn("bottom_y", F.bround(F.col("start_y") + height, decimals))
    return placed.withColumn("over_capacity", F.col("bottom_y") > template.board_page_count).drop(
        "_slots", "_end", scale.SLICE
    )


def placement_summary(placements: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Counts and lowest bottom of a plan; zeros for an empty one."""
    names = placements.columns
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)) if c in names else F.lit(0).cast("bigint")
    return placements.groupBy(*by).agg(
        F.count(F.lit(1)).alias("problem_count"),
        F.count(F.when(F.col("overflow_amount") > 0, 1)).alias("overflow_count"),
        F.count(F.when(F.col("overflow_violation"), 1)).alias("overflow_violation_count"),
        F.coalesce(F.max("bottom_y"), F.lit(0.0)).alias("max_bottom_y"),
        F.coalesce(F.sum("slot_span"), F.lit(0)).alias("slot_count"),
        total("text_record_count").alias("text_record_count"),
        total("image_record_count").alias("image_record_count"),
    )


def placement_flags(placements: DataFrame, board: Sequence[str], template: Template = DEFAULT_TEMPLATE) -> DataFrame:
    """Warnings per placement, and checks against the next one on the board.

    The neighbour is found by its number, so no board is gathered in one task.
    """
    slot = template.slot_height
    following = placements.select(*board, (F.col("seq") - 1).alias("seq"), F.col("start_y").alias("_next"))
    amount = F.greatest(F.lit(0.0), F.col("content_height") - slot)
    steps = F.col("start_y") / slot
    return (
        placements.join(following, [*board, "seq"], "left")
        .withColumns(
            {
                "warn_overflow": amount > 0,
                "warn_violation": F.col("overflow_violation"),
                "warn_capacity": F.col("bottom_y") > template.board_page_count,
                "warn_overlap": F.coalesce(F.col("_next") < F.col("bottom_y") - 1e-6, F.lit(False)),
                "warn_unsnapped": F.abs(steps - F.bround(steps, 0)) > 1e-6,
            }
        )
        .drop("_next")
    )
