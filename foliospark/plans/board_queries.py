"""Bounds, heights, placements and records."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark import scale
from foliospark.functions import text as tx
from foliospark.operators import flatten, grouping, ordering, placement, records
from foliospark.plans import oracle as o
from foliospark.plans.bindings import Tables
from foliospark.plans.grouping_queries import grouped
from foliospark.plans.registry import query

PLACED = [
    "board_id", "problem_id", "seq", "start_y", "content_height", "bottom_y", "next_start_y", "overflow_allowed",
    "overflow_amount", "overflow_violation", "slot_span", "over_capacity",
]
PLACED_SQL = (
    "board_id, problem_id, seq0 AS seq, start_y, content_height, bottom_y, next_start_y, overflow_allowed, "
    "overflow_amount, overflow_violation, slot_span, over_capacity"
)


def order_boards(t: Tables):
    """One board per customer, packed in order of date."""
    return placement.place(t.heights, ["board_id"], ["placed_on", "problem_id"])


@query("slot_packing", f"SELECT {PLACED_SQL} FROM v_placed")
def _(t):
    return order_boards(t).select(*PLACED)


@query("slot_packing_fine", "SELECT problem_id, start_y, next_start_y, slot_span FROM (" + o.placed(
    "v_heights", "board_id", "placed_on, problem_id", slot="0.35") + ")")
def _(t):
    from foliospark.settings import Template

    placed = placement.place(t.heights, ["board_id"], ["placed_on", "problem_id"], Template(slot_height=0.35))
    return placed.select("problem_id", "start_y", "next_start_y", "slot_span")


@query("placement_summary", """
SELECT board_id, count(*) AS problem_count, count(*) FILTER (overflow_amount > 0) AS overflow_count,
       count(*) FILTER (overflow_violation) AS overflow_violation_count, max(bottom_y) AS max_bottom_y,
       CAST(sum(slot_span) AS BIGINT) AS slot_count, CAST(0 AS BIGINT) AS text_record_count,
       CAST(0 AS BIGINT) AS image_record_count
FROM v_placed GROUP BY board_id
""")
def _(t):
    return placement.placement_summary(order_boards(t), ["board_id"])


@query("plan_summary", """
SELECT count(*) AS problem_count, count(*) FILTER (overflow_amount > 0) AS overflow_count,
       count(*) FILTER (overflow_violation) AS overflow_violation_count, max(bottom_y) AS max_bottom_y,
       CAST(sum(slot_span) AS BIGINT) AS slot_count, CAST(0 AS BIGINT) AS text_record_count,
       CAST(0 AS BIGINT) AS image_record_count
FROM v_placed
""")
def _(t):
    return placement.placement_summary(order_boards(t))


@query("placement_flags", """
SELECT problem_id, greatest(0, content_height - 1.2::DOUBLE) > 0 AS warn_overflow, overflow_violation AS warn_violation,
       bottom_y > 50 AS warn_capacity,
       coalesce(lead(start_y) OVER (PARTITION BY board_id ORDER BY seq0) < bottom_y - 1e-6, FALSE) AS warn_overlap,
       abs(start_y / 1.2::DOUBLE - round_even(start_y / 1.2::DOUBLE, 0)) > 1e-6 AS warn_unsnapped
FROM v_placed
""")
def _(t):
    flagged = placement.placement_flags(scale.staged(order_boards(t)), ["board_id"])
    return flagged.select("problem_id", *[c for c in flagged.columns if c.startswith("warn_")])


@query("overflow_allowed", """
SELECT problem_id, coalesce(allowed, heavy OR subject IN ('korean', 'english')) AS overflow_allowed FROM v_heights
""")
def _(t):
    ok = placement.overflow_allowed(F.col("allowed"), F.col("heavy"), F.col("subject"))
    return t.heights.select("problem_id", ok.alias("overflow_allowed"))


@query("crop_heights", """
SELECT page_id, box_id, greatest(0.72::DOUBLE, least(4.8::DOUBLE, (1280 * 0.52::DOUBLE - 84 - 54) * (height / greatest(width, 1)) / 590)) AS height_pages
FROM v_boxes
""")
def _(t):
    h = placement.crop_height(F.col("width"), F.col("height"))
    return t.boxes.select("page_id", "box_id", h.alias("height_pages"))


@query("page_heights", """
SELECT page_id, CASE WHEN page_width <= 0 THEN 1.2::DOUBLE ELSE greatest(0.6::DOUBLE,
       round_even((80 + 1280 * 0.52::DOUBLE * (page_height / page_width) + 32) / 590, 4)) END AS height_pages
FROM v_pages
""")
def _(t):
    h = placement.page_height(F.col("page_width"), F.col("page_height"))
    return t.pages.select("page_id", h.alias("height_pages"))


@query("page_boards", """
SELECT page_id, start_y, next_start_y, slot_span, overflow_violation FROM (""" + o.placed(
    """(SELECT page_id, source AS board_id, doc_id, page_subject AS subject,
       page_subject IN ('korean', 'english') AS heavy, page_subject IN ('korean', 'english') AS allowed,
       greatest(0.6::DOUBLE, round_even((80 + 1280 * 0.52::DOUBLE * (page_height / page_width) + 32) / 590, 4)) AS height_pages
     FROM v_pages)""", "board_id", "doc_id") + ")")
def _(t):
    """A page is the unit; one board per source."""
    pages = t.pages.select(
        "page_id", "doc_id", F.col("source").alias("board_id"), F.col("page_subject").alias("subject"),
        placement.is_language(F.col("page_subject")).alias("heavy"),
        placement.is_language(F.col("page_subject")).alias("allowed"),
        placement.page_height(F.col("page_width"), F.col("page_height")).alias("height_pages"),
    )
    placed = placement.place(pages, ["board_id"], ["doc_id"])
    return placed.select("page_id", "start_y", "next_start_y", "slot_span", "overflow_violation")


# ----------------------------------------------------- problem export on boards
o.cte("v_members", "SELECT * FROM v_grouped WHERE role IS NOT NULL")
o.cte("v_raw_bounds", """
SELECT p.page_id, p.unit_id, p.problem_index, p.subject, 800 AS pw, q.page_height AS ph, q.source, q.doc_id,
       min(m."left") AS l, min(m.top) AS t, max(m."left" + m.width) AS r, max(m.top + m.height) AS b,
       count(m.block_id) AS member_count, count(m.question_band_index) > 0 AS has_band
FROM v_problems p JOIN v_pages q ON p.page_id = q.page_id
LEFT JOIN v_members m ON m.unit_id = p.unit_id
GROUP BY ALL
""")


def bounds_cte(name: str, pad: int) -> None:
    o.cte(name, f"""
SELECT page_id, unit_id, problem_index, subject, pw, ph, source, doc_id, member_count, has_band, bl AS bound_left,
       bt AS bound_top, greatest(0, least(pw, br + {pad}) - bl) AS bound_width, greatest(0, least(ph, bb + {pad}) - bt) AS bound_height
FROM (SELECT *, CASE WHEN l IS NULL THEN 0 ELSE greatest(0, l - {pad}) END AS bl,
             CASE WHEN l IS NULL THEN 0 ELSE greatest(0, t - {pad}) END AS bt,
             coalesce(r, pw) AS br, coalesce(b, ph) AS bb FROM v_raw_bounds)
""")


bounds_cte("v_bounds", 18)
bounds_cte("v_page_bounds", 24)
o.cte("v_final_bounds", """
SELECT page_id, unit_id, problem_index, subject, source, doc_id, small AS whole_page,
       CASE WHEN small THEN 0 ELSE bound_left END AS bound_left, CASE WHEN small THEN 0 ELSE bound_top END AS bound_top,
       CASE WHEN small THEN pw ELSE bound_width END AS bound_width, CASE WHEN small THEN ph ELSE bound_height END AS bound_height
FROM (SELECT *, NOT has_band AND bound_width * bound_height < pw * CAST(ph AS DOUBLE) * 0.12::DOUBLE AS small FROM v_bounds)
""")
o.cte("v_export_heights", """
SELECT *, source AS board_id, subject IN ('korean', 'english') AS heavy, subject IN ('korean', 'english') AS allowed,
       greatest(0.72::DOUBLE, least(4.8::DOUBLE, (1280 * 0.52::DOUBLE - 84 - 54)
           * ((floor(bound_top + bound_height) - floor(bound_top)) / greatest(floor(bound_left + bound_width) - floor(bound_left), 1)) / 590)) AS height_pages
FROM v_final_bounds
""")
o.cte("v_exported", o.placed("v_export_heights", "board_id", "doc_id, problem_index"))
o.cte("v_record_blocks", """
SELECT e.board_id, e.doc_id, e.unit_id, e.problem_index, e.start_y, e.bound_left, e.bound_top, e.bound_width, m.block_id,
       m.block_type, m.text, m.confidence, m."left", m.top, m.width, m.height, m.reading_order
FROM v_exported e JOIN v_grouped m ON e.page_id = m.page_id AND (e.whole_page OR (m.unit_id = e.unit_id AND m.role IS NOT NULL))
""")
MODE = """CASE WHEN block_type IN ('image', 'diagram', 'table', 'decoration', 'formula') OR coalesce(trim(text), '') = ''
       OR block_type NOT IN ('title', 'section', 'stem', 'choice', 'explanation', 'note')
       OR coalesce(confidence, 0) < 0.78 THEN 'image' ELSE 'text' END"""
o.cte("v_records", f"""
SELECT *, {MODE} AS record_mode, 527.6::DOUBLE AS room, 527.6::DOUBLE / greatest(bound_width, 1) AS k FROM v_record_blocks
""".replace("527.6::DOUBLE", "(1280 * 0.52::DOUBLE - 84 - 54)"))


def export_bounds(t: Tables, blocks, padding: float = 18.0):
    units = grouping.problems_of(blocks).join(t.pages.drop("page_subject"), "page_id")
    return placement.problem_bounds(blocks.where("role is not null"), units, padding)


def exported(t: Tables):
    """Problems with bounds, heights and slots; one board per source."""
    blocks = grouped(t)
    bounds = placement.min_area_fallback(export_bounds(t, blocks))
    whole = F.floor(F.col("bound_left") + F.col("bound_width")) - F.floor("bound_left")
    high = F.floor(F.col("bound_top") + F.col("bound_height")) - F.floor("bound_top")
    sized = bounds.withColumns(
        {
            "height_pages": placement.crop_height(whole, high),
            "heavy": placement.is_language(F.col("subject")), "allowed": placement.is_language(F.col("subject")),
            "board_id": F.col("source"),
        }
    )
    placed = placement.place(scale.staged(sized), ["board_id"], ["doc_id", "problem_index"])
    return blocks, scale.staged(placed)


def record_blocks(t: Tables):
    """Every block record of the exported problems."""
    return blocks_of(*exported(t))


def blocks_of(blocks, placed):
    slim = blocks.select(
        "page_id", "unit_id", "block_id", "block_type", "confidence", "left", "top", "width", "height", "reading_order", "role", "is_blank"
    )
    members = placement.bounded_members(
        slim.where("role is not null"), placed, slim.drop("unit_id")
    )
    held = placed.select(
        "page_id", "unit_id", "board_id", "doc_id", "problem_index", "start_y", "bound_left", "bound_top", "bound_width",
        "bound_height",
    )
    joined = scale.keyed_join(members, held, ["page_id", "unit_id"], spread_by=F.col("block_id"), sized_by=slim)
    mode = records.record_mode(F.col("block_type"), ~F.col("is_blank"), F.col("confidence"))
    return records.place_blocks(joined.withColumn("record_mode", mode))


@query("problem_bounds", """
SELECT unit_id, bound_left, bound_top, bound_width, bound_height, member_count, has_band FROM v_bounds
""")
def _(t):
    return export_bounds(t, grouped(t)).select(
        "unit_id", "bound_left", "bound_top", "bound_width", "bound_height", "member_count", "has_band"
    )


@query("page_export_bounds", "SELECT unit_id, bound_left, bound_top, bound_width, bound_height FROM v_page_bounds")
def _(t):
    return export_bounds(t, grouped(t), 24.0).select(
        "unit_id", "bound_left", "bound_top", "bound_width", "bound_height"
    )


@query("min_area_fallback", "SELECT unit_id, whole_page, bound_left, bound_top, bound_width, bound_height FROM v_final_bounds")
def _(t):
    return placement.min_area_fallback(export_bounds(t, grouped(t))).select(
        "unit_id", "whole_page", "bound_left", "bound_top", "bound_width", "bound_height"
    )


@query("problem_export", """
SELECT unit_id, board_id, height_pages, start_y, bottom_y, next_start_y, slot_span, overflow_amount, overflow_violation
FROM v_exported
""")
def _(t):
    return exported(t)[1].select(
        "unit_id", "board_id", "height_pages", "start_y", "bottom_y", "next_start_y", "slot_span", "overflow_amount",
        "overflow_violation",
    )


@query("place_blocks", """
SELECT unit_id, block_id, record_mode, (84 + greatest(0, "left" - bound_left) * k) / 1280 AS x,
       (start_y * 590 + 20 + greatest(0, top - bound_top) * k) / (590 * 50) AS y,
       greatest(40, least(room, width * k)) / 1280 AS w, greatest(22, height * k) / (590 * 50) AS h
FROM v_records
""")
def _(t):
    placed = record_blocks(t)
    return placed.select("unit_id", "block_id", "record_mode", *"xywh")


@query("board_records", """
SELECT unit_id, block_id, record_mode, (84 + greatest(0, "left" - bound_left) * k) / 1280 AS x,
       (start_y * 590 + 20 + greatest(0, top - bound_top) * k) / (590 * 50) AS y,
       greatest(40, least(room, width * k)) / 1280 AS w, greatest(22, height * k) / (590 * 50) AS h
FROM v_records WHERE problem_index % 4 <> 3
UNION ALL
SELECT unit_id, NULL, 'image', 84 / 1280::DOUBLE, (start_y * 590 + 20) / (590 * 50)::DOUBLE, 527.6::DOUBLE / 1280,
       content_height * 590 / (590 * 50)::DOUBLE
FROM v_exported e WHERE problem_index % 4 = 3 OR NOT EXISTS (SELECT 1 FROM v_records r WHERE r.unit_id = e.unit_id)
""")
def _(t):
    """Every fourth problem of a page has lost its blocks and is shown as its picture."""
    blocks, placed = exported(t)
    left = scale.staged(blocks_of(blocks, placed).where(F.col("problem_index") % 4 != 3))
    return records.board_records(left, placed)


@query("record_ids", """
SELECT unit_id, block_id, row_number() OVER (ORDER BY board_id, doc_id, problem_index, reading_order, block_id) - 1 AS record_id
FROM (SELECT board_id, doc_id, problem_index, unit_id, block_id, reading_order FROM v_records
      UNION ALL
      SELECT board_id, doc_id, problem_index, unit_id, NULL, NULL FROM v_exported e
      WHERE NOT EXISTS (SELECT 1 FROM v_records r WHERE r.unit_id = e.unit_id))
""")
def _(t):
    blocks, placed = exported(t)
    slim = blocks.select("page_id", "unit_id", "block_id", "reading_order", "role")
    members = placement.bounded_members(slim.where("role is not null"), placed, slim.drop("unit_id"))
    members = scale.staged(members.select("unit_id", "block_id", "reading_order"))
    units = placed.select("board_id", "doc_id", "problem_index", "unit_id")
    bare = units.join(members.select("unit_id").distinct(), "unit_id", "left_anti")
    rows = scale.keyed_join(members, units, ["unit_id"], spread_by=F.col("block_id")).unionByName(bare, allowMissingColumns=True)
    numbered = ordering.record_ids(rows, ["board_id", "doc_id", "problem_index"], ["reading_order", "block_id"])
    return numbered.select("unit_id", "block_id", "record_id")


@query("record_counts", """
SELECT unit_id, count(*) FILTER (record_mode = 'text') AS text_record_count,
       count(*) FILTER (record_mode = 'image') AS image_record_count,
       CASE WHEN count(*) FILTER (record_mode = 'image') > 0 THEN 4 ELSE 3 END AS header_flag
FROM v_records GROUP BY unit_id
UNION ALL SELECT 'bare-' || s_suppkey, 0, 1, 4 FROM supplier
""")
def _(t):
    """Problems with records, and one without for each supplier."""
    made = record_blocks(t)
    bare = t.table("supplier").select(F.concat(F.lit("bare-"), "s_suppkey").alias("unit_id"))
    return records.record_counts(made, ["unit_id"], made.select("unit_id").unionByName(bare))


@query("image_records", """
SELECT problem_id, 84 / 1280::DOUBLE AS x, (start_y * 590 + 20) / (590 * 50)::DOUBLE AS y, 527.6::DOUBLE / 1280 AS w,
       content_height * 590 / (590 * 50)::DOUBLE AS h
FROM v_placed
""")
def _(t):
    return records.image_records(order_boards(t)).select("problem_id", "x", "y", "w", "h")


@query("record_modes", f"""
SELECT block_id, {MODE} AS record_mode,
       CASE WHEN coalesce(text, '') <> '' AND block_type NOT IN {o.FIGURE} THEN 'text' ELSE 'image' END AS page_record_mode
FROM v_blocks
""")
def _(t):
    return t.blocks.select(
        "block_id",
        records.record_mode(F.col("block_type"), tx.is_filled(F.col("text")), F.col("confidence")).alias("record_mode"),
        records.page_record_mode(F.col("block_type"), F.col("text")).alias("page_record_mode"),
    )


@query("font_sizes", """
SELECT page_id, box_id, CAST(greatest(10, least(40, round_even(greatest(14, height * 0.32::DOUBLE) * greatest(k, 0.25::DOUBLE) * 0.9::DOUBLE, 0))) AS INT) AS font_size,
       CAST(greatest(10, least(28, round_even(height * 0.22::DOUBLE, 0))) AS INT) AS page_font_size,
       greatest(10, height * 0.35::DOUBLE) AS style_size
FROM (SELECT *, 527.6::DOUBLE / greatest(width, 1) AS k FROM v_boxes)
""")
def _(t):
    h, k = F.col("height"), F.lit(527.6) / F.greatest(F.col("width"), F.lit(1))
    return t.boxes.select(
        "page_id", "box_id", records.font_size(F.lit(None).cast("double"), h, k).alias("font_size"),
        records.page_font_size(h).alias("page_font_size"), records.style_size(h).alias("style_size"),
    )


@query("page_records", """
SELECT block_id, (88 + "left" * k) / 1280 AS x, (start_y * 590 + 80 + top * k) / (590 * 50) AS y,
       greatest(16, width * k) / 1280 AS w, greatest(16, b.height * k) / (590 * 50) AS h,
       CAST(greatest(10, least(28, round_even(greatest(16, b.height * k) * 0.22::DOUBLE, 0))) AS INT) AS font_size
FROM (SELECT *, 1280 * 0.52::DOUBLE / greatest(page_width, 1) AS k FROM v_blocks) b
JOIN (SELECT page_id, start_y FROM (""" + o.placed(
    """(SELECT page_id, page_id AS board_id, page_subject AS subject, FALSE AS heavy, FALSE AS allowed,
        greatest(0.6::DOUBLE, round_even((80 + 1280 * 0.52::DOUBLE * (page_height / page_width) + 32) / 590, 4)) AS height_pages
        FROM v_pages)""", "board_id", "page_id") + ")) p ON b.page_id = p.page_id")
def _(t):
    """Page export records; every page on its own board."""
    placed = records.place_page_blocks(t.blocks.withColumn("start_y", F.lit(0.0)))
    return placed.select("block_id", *"xywh", "font_size")


@query("record_inventory", f"""
SELECT file_id, count(*) AS record_count, count(text) AS text_count, count(*) FILTER (image_count > 0) AS image_count,
       count(*) FILTER (image_count = 0 AND text IS NULL) AS other_count,
       coalesce(string_agg(text, '|' ORDER BY record_no) FILTER (rt <= 5 AND text IS NOT NULL AND text <> ''), '') AS text_preview,
       coalesce(string_agg(preview, '|' ORDER BY record_no) FILTER (ri <= 5 AND image_count > 0), '') AS image_preview
FROM (SELECT *, sum(CAST(text IS NOT NULL AS INT)) OVER (PARTITION BY file_id ORDER BY record_no) AS rt,
             sum(CAST(image_count > 0 AS INT)) OVER (PARTITION BY file_id ORDER BY record_no) AS ri
      FROM (SELECT page_id AS file_id, pos AS record_no, text,
                   CASE WHEN block_type = 'image' AND pos % 3 <> 0 THEN 1 ELSE 0 END AS image_count,
                   block_id AS preview FROM v_blocks))
GROUP BY file_id
""")
def _(t):
    rows = t.block_table.select(
        F.col("page_id").alias("file_id"), F.col("pos").alias("record_no"), "text",
        F.when((F.col("block_type") == "image") & (F.col("pos") % 3 != 0), 1).otherwise(0).alias("image_count"),
        F.col("block_id").alias("preview"),
    )
    found = records.record_inventory(rows)
    return found.withColumns({n: F.array_join(n, "|") for n in ("text_preview", "image_preview")})


@query("problem_members", """
SELECT unit_id, member_pos, block_id FROM (
  SELECT unit_id, block_id, CAST(row_number() OVER (PARTITION BY unit_id ORDER BY
         CASE role WHEN 'stem' THEN 0 WHEN 'choice' THEN 1 WHEN 'explanation' THEN 2 ELSE 3 END, reading_order) - 1 AS INT) AS member_pos
  FROM v_grouped WHERE role IS NOT NULL)
UNION ALL
SELECT p.unit_id, b.pos, b.block_id FROM v_problems p JOIN v_blocks b ON p.page_id = b.page_id
WHERE NOT EXISTS (SELECT 1 FROM v_members m WHERE m.unit_id = p.unit_id)
""")
def _(t):
    made = grouping.assemble_problems(grouped(t))
    return flatten.problem_members(made, t.block_table).select("unit_id", "member_pos", "block_id")


@query("member_blocks", """
SELECT m.unit_id, m.block_id, b.reading_order, b.top
FROM v_members m JOIN v_blocks b ON m.page_id = b.page_id AND m.block_id = b.block_id
""")
def _(t):
    members = grouped(t).where("role is not null").select("page_id", "unit_id", "block_id")
    stray = members.withColumn("block_id", F.concat("block_id", F.lit("-none")))
    return flatten.member_blocks(members.unionByName(stray), t.block_table).select(
        "unit_id", "block_id", "reading_order", "top"
    )
