"""Box arithmetic, containment and look-up."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark.functions.geometry import box, polygon_box
from foliospark.functions.numbers import file_size_label
from foliospark.operators import boxes, boxmerge, ordering
from foliospark.plans import oracle as o
from foliospark.plans.registry import query

BOX = ["left", "top", "width", "height"]


def rounded(*names: str, digits: int = 6):
    return [F.round(n, digits).alias(n) for n in names]


@query("normalize_boxes", """
SELECT block_id, round("left" / page_width, 6) AS norm_left, round(top / page_height, 6) AS norm_top,
       round(width / page_width, 6) AS norm_width, round(height / page_height, 6) AS norm_height,
       round("left" / page_width * page_width, 6) AS px_left, round(height / page_height * page_height, 6) AS px_height
FROM v_blocks
""")
def _(t):
    made = boxes.denormalize_boxes(boxes.normalize_boxes(t.blocks))
    return made.select(
        "block_id", *rounded("norm_left", "norm_top", "norm_width", "norm_height", "px_left", "px_height")
    )


@query("expand_boxes", """
SELECT block_id, greatest(0, "left" - 18) AS grown_left, greatest(0, top - 18) AS grown_top,
       greatest(0, least(page_width, "left" + width + 18) - greatest(0, "left" - 18)) AS grown_width,
       greatest(0, least(page_height, top + height + 18) - greatest(0, top - 18)) AS grown_height
FROM v_blocks
""")
def _(t):
    made = boxes.expand_boxes(t.blocks, 18, F.col("page_width"), F.col("page_height"))
    return made.select("block_id", "grown_left", "grown_top", "grown_width", "grown_height")


@query("polygon_boxes", """
SELECT page_id, box_id, "left" - 1 AS "left", top AS top, width + 3 AS width, height + 2 AS height FROM v_boxes
""".replace("width + 3", 'greatest(0, "left" + width + 2 - ("left" - 1))').replace("height + 2", "greatest(0, top + height + 2 - top)"))
def _(t):
    b = box()

    def point(x, y):
        return F.struct(x.alias("x"), y.alias("y"))

    corners = F.array(
        point(b.left, b.top), point(b.right + 2, b.top + 1), point(b.right, b.bottom + 2), point(b.left - 1, b.bottom)
    )
    made = t.boxes.withColumn("polygon", corners)
    return made.select("page_id", "box_id", *[c.alias(n) for n, c in polygon_box(F.col("polygon")).columns().items()])


@query("even_line_boxes", f"""
SELECT page_id, block_id, line_no, text, CAST(0 AS DOUBLE) AS "left", round(line_no * tall, 6) AS top, width, round(tall, 6) AS height
FROM (SELECT page_id, block_id, width, height / greatest(len(ls), 1) AS tall,
             CAST(unnest(range(len(ls))) AS INT) AS line_no, {o.strip("unnest(ls)")} AS text
      FROM (SELECT *, string_split(coalesce(line, '') || ', ', ', ') AS ls FROM v_blocks))
WHERE text <> ''
""")
def _(t):
    rows = t.blocks.select(
        "page_id", "block_id", "width", "height",
        F.split(F.concat(F.coalesce("line", F.lit("")), F.lit(", ")), ", ").alias("lines"),
    )
    made = boxes.even_line_boxes(rows)
    return made.select("page_id", "block_id", "line_no", "text", "left", *rounded("top"), "width", *rounded("height"))


@query("tokens_to_lines", f"""
SELECT block_id, {o.strip("text")} AS text, CASE WHEN conf = -1 THEN 0 ELSE conf / 100 END AS confidence
FROM (SELECT block_id, text, CASE WHEN pos % 6 = 0 THEN -1 ELSE CAST((doc_id * 7 + pos * 13) % 101 AS DOUBLE) END AS conf FROM v_blocks)
WHERE {o.strip("text")} <> ''
""")
def _(t):
    conf = F.when(F.col("pos") % 6 == 0, -1.0).otherwise(((F.col("doc_id") * 7 + F.col("pos") * 13) % 101).cast("double"))
    return boxes.tokens_to_lines(t.blocks.select("block_id", "text", conf.alias("conf")))


@query("block_area_stats", """
SELECT block_id, CAST(page_width AS BIGINT) * page_height AS page_area_px,
       round_even(width * height / greatest(page_width * CAST(page_height AS DOUBLE), 1), 6) AS block_area_ratio,
       width * height / greatest(page_width * CAST(page_height AS DOUBLE), 1) >= 0.05 AS large_block
FROM v_blocks
""")
def _(t):
    made = boxes.block_area_stats(t.blocks, t.pages, threshold=0.05)
    return made.select("block_id", "page_area_px", "block_area_ratio", "large_block")


@query("band_boxes", """
SELECT page_id, box_id, round(l, 6) AS "left", round(t, 6) AS top, round(greatest(0, r - l), 6) AS width, round(greatest(0, b - t), 6) AS height
FROM (SELECT page_id, box_id,
             CASE WHEN il IS NULL THEN cl ELSE greatest(0, (CASE WHEN narrow THEN cl ELSE x0 END) - 8) END AS l,
             CASE WHEN il IS NULL THEN bt ELSE greatest(0, greatest(0, bt - 24) - 8) END AS t,
             CASE WHEN il IS NULL THEN cl + 300 ELSE least(900, (CASE WHEN narrow THEN cl + 300 ELSE x1 END) + 8) END AS r,
             CASE WHEN il IS NULL THEN bb ELSE least(1200, least(1000, bb + 24) + 8) END AS b
      FROM (SELECT *, x1 - x0 < 300 * 0.72::DOUBLE AS narrow
            FROM (SELECT *, cl + greatest(0, il - 24) AS x0, cl + least(300, ir + 24) AS x1
                  FROM (SELECT page_id, box_id, "left" AS cl, top * 10 AS bt, top * 10 + height + 5 AS bb,
                               CASE WHEN box_id % 5 > 0 THEN width END AS il,
                               CASE WHEN box_id % 5 > 0 THEN width + height * 4 END AS ir FROM v_boxes))))
""")
def _(t):
    ink = F.col("box_id") % 5 > 0
    rows = t.boxes.select(
        "page_id", "box_id", F.col("left").alias("column_left"), F.lit(0.0).alias("column_top"),
        F.lit(300.0).alias("column_width"), F.lit(1000.0).alias("column_height"), (F.col("top") * 10).alias("band_top"),
        (F.col("top") * 10 + F.col("height") + 5).alias("band_bottom"), F.when(ink, F.col("width")).alias("ink_left"),
        F.when(ink, F.col("width") + F.col("height") * 4).alias("ink_right"), F.lit(900).alias("page_width"),
        F.lit(1200).alias("page_height"),
    )
    return boxes.band_boxes(rows).select("page_id", "box_id", *rounded(*BOX))


@query("slice_boxes", """
SELECT page_id, box_id, CASE WHEN fits THEN round(l, 6) END AS "left", CASE WHEN fits THEN round(t, 6) END AS top,
       CASE WHEN fits THEN round(greatest(0, r - l), 6) END AS width, CASE WHEN fits THEN round(greatest(0, b - t), 6) END AS height
FROM (SELECT page_id, box_id, hi - lo >= 60 AS fits, greatest(0, (CASE WHEN narrow THEN pl ELSE x0 END) - 6) AS l,
             least(900, (CASE WHEN narrow THEN pl + 300 ELSE x1 END) + 6) AS r,
             greatest(0, 50 + lo + greatest(0, it - 20) - 6) AS t, least(1200, 50 + lo + least(hi - lo, ib + 20) + 6) AS b
      FROM (SELECT *, x1 - x0 < 300 * 0.7::DOUBLE AS narrow
            FROM (SELECT *, pl + greatest(0, il - 20) AS x0, pl + least(300, ir + 20) AS x1
                  FROM (SELECT page_id, box_id, "left" AS pl, greatest(0, floor(top)) AS lo,
                               least(400, floor(top + height * 3)) AS hi, width AS il, width + height * 4 AS ir,
                               height / 2 AS it, height * 2 AS ib FROM v_boxes))))
""")
def _(t):
    h = F.col("height")
    rows = t.boxes.select(
        "page_id", "box_id", F.col("left").alias("parent_left"), F.lit(50.0).alias("parent_top"),
        F.lit(300.0).alias("parent_width"), F.lit(400.0).alias("parent_height"), F.col("top").alias("slice_top"),
        (F.col("top") + h * 3).alias("slice_bottom"), F.col("width").alias("ink_left"),
        (F.col("width") + h * 4).alias("ink_right"), (h / 2).alias("ink_top"), (h * 2).alias("ink_bottom"),
        F.lit(900).alias("page_width"), F.lit(1200).alias("page_height"),
    )
    return boxes.slice_boxes(rows).select("page_id", "box_id", *rounded(*BOX))


o.cte("v_candidate_boxes", """
SELECT *, count(*) OVER (PARTITION BY page_id) AS n
FROM (SELECT *, "left" + width AS r, top + height AS b, width * height < 12000 * 0.75::DOUBLE AND fill_ratio >= 0.22 AS good,
             count(*) OVER (PARTITION BY page_id) AS n0,
             count(*) FILTER (width * height < 12000 * 0.75::DOUBLE AND fill_ratio >= 0.22) OVER (PARTITION BY page_id) AS g
      FROM v_boxes)
WHERE n0 <= 1 OR g = 0 OR good
""")
o.cte("v_frames", """
SELECT a.page_id, a.box_id FROM v_candidate_boxes a
WHERE a.n > 1 AND (a.r - a."left") * (a.b - a.top) >= 12000 * 0.08::DOUBLE AND EXISTS (
  SELECT 1 FROM v_candidate_boxes c WHERE c.page_id = a.page_id AND c.box_id <> a.box_id
  AND a."left" <= c."left" AND a.top <= c.top AND a.r >= c.r AND a.b >= c.b)
""")


@query("prune_containers", """
SELECT page_id, box_id FROM v_candidate_boxes c
WHERE NOT EXISTS (SELECT 1 FROM v_frames f WHERE f.page_id = c.page_id AND f.box_id = c.box_id)
   OR (SELECT count(*) FROM v_frames f WHERE f.page_id = c.page_id) >= c.n
""")
def _(t):
    return boxes.prune_containers(t.box_table, F.lit(12000.0)).select("page_id", "box_id")


@query("band_lookup", """
SELECT page_id, box_id, coalesce(first(fill) , 0.25) AS fill_ratio FROM (
  SELECT b.page_id, b.box_id, arg_min(c.fill_ratio, c.box_id) AS fill
  FROM v_boxes b LEFT JOIN (SELECT * FROM v_boxes WHERE box_id % 2 = 0) c
    ON b.page_id = c.page_id AND abs(c."left" - b."left" - 0.5) < 2 AND abs(c.top - b.top) < 2
  GROUP BY b.page_id, b.box_id) GROUP BY page_id, box_id, fill
""".replace("coalesce(first(fill) , 0.25)", "coalesce(fill, 0.25)").replace(") GROUP BY page_id, box_id, fill", ")"))
def _(t):
    candidates = t.box_table.where(F.col("box_id") % 2 == 0).select(
        "page_id", (F.col("left") - 0.5).alias("left"), "top", F.col("box_id").alias("candidate_no"), "fill_ratio"
    )
    return boxes.band_lookup(t.box_table, candidates).select("page_id", "box_id", "fill_ratio")


@query("geometry_types", """
SELECT page_id, box_id, CASE WHEN down < 0.12 AND aspect > 2 THEN 'title' WHEN share > 0.18 AND dev > 35 THEN 'image'
       WHEN aspect > 4.5 AND height < 90 * 0.08::DOUBLE THEN 'formula' WHEN share < 0.01 AND height < 90 * 0.09::DOUBLE THEN 'note'
       ELSE 'stem' END AS block_type, round_even(aspect, 4) AS aspect_ratio, round_even(share, 6) AS area_ratio
FROM (SELECT *, width / greatest(height, 1) AS aspect, width * height / 9900 AS share, (top - 10) / 90 AS down,
             fill_ratio * 20 AS dev FROM v_boxes)
""")
def _(t):
    rows = t.boxes.withColumns(
        {
            "region_left": F.lit(0.0), "region_top": F.lit(10.0), "region_width": F.lit(110.0), "region_height": F.lit(90.0),
            "stddev": F.col("fill_ratio") * 20,
        }
    )
    made = boxes.geometry_type(rows)
    return made.select("page_id", "box_id", "block_type", "aspect_ratio", "area_ratio")


@query("enumerate_blocks", """
SELECT *, count(*) OVER (PARTITION BY page_id, column_index, source_band_index) > 1 AS split_from_band,
       count(*) OVER (PARTITION BY page_id, column_index, source_band_index) AS band_split_count,
       row_number() OVER (PARTITION BY page_id, column_index ORDER BY source_band_index, split_pos) AS question_band_index,
       row_number() OVER (PARTITION BY page_id, column_index, source_band_index ORDER BY split_pos) AS band_split_index,
       printf('%s-block-%03d', page_id, row_number() OVER (PARTITION BY page_id ORDER BY column_index, source_band_index, split_pos)) AS block_id
FROM (SELECT page_id, pos % 2 + 1 AS column_index, pos // 6 + 1 AS source_band_index, pos AS split_pos FROM v_blocks)
""")
def _(t):
    rows = t.block_table.select(
        "page_id", (F.col("pos") % 2 + 1).alias("column_index"), F.floor(F.col("pos") / 6 + 1).cast("int").alias("source_band_index"),
        F.col("pos").alias("split_pos"),
    )
    return ordering.enumerate_blocks(rows)


@query("file_sizes", """
SELECT doc_id, CASE WHEN n IS NULL OR n <= 0 THEN '0KB' WHEN n >= 1048576 THEN printf('%.1fMB', n / 1048576)
       ELSE CAST(CAST(greatest(1, floor(n / 1024 + 0.5)) AS BIGINT) AS VARCHAR) || 'KB' END AS label
FROM (SELECT doc_id, CAST(n_chars * 97 - 5000 AS DOUBLE) AS n FROM documents)
""")
def _(t):
    return t.table("documents").select("doc_id", file_size_label(F.col("n_chars") * 97 - 5000).alias("label"))


o.cte("v_parts_boxes", """
SELECT l_partkey AS page_id, CAST(l_orderkey % 1900 AS DOUBLE) AS "left", CAST(l_orderkey * 7 % 2300 AS DOUBLE) AS top,
       CAST(l_quantity AS DOUBLE) AS width, CAST(l_linenumber * 6 AS DOUBLE) AS height
FROM lineitem
""")


def merging(source: str, gap_x: float, gap_y: float) -> str:
    """The rule as it stands, a box at a time: ``rest`` are the boxes of a round still to come, ``done`` the settled ones."""
    across = "(least(x.r, rest[1].r) - greatest(x.l, rest[1].l))"
    down = "(least(x.b, rest[1].b) - greatest(x.t, rest[1].t))"
    area_x, area_b = "(x.r - x.l) * (x.b - x.t)", "(rest[1].r - rest[1].l) * (rest[1].b - rest[1].t)"
    holds = "(x.l <= rest[1].l AND x.t <= rest[1].t AND x.r >= rest[1].r AND x.b >= rest[1].b)"
    held = "(x.l >= rest[1].l AND x.t >= rest[1].t AND x.r <= rest[1].r AND x.b <= rest[1].b)"
    close = (
        f"NOT (({holds} OR {held}) AND greatest({area_x}, {area_b}) >= 1.4::DOUBLE * least({area_x}, {area_b}))"
        f" AND ({across} > 0 OR {down} > 0 OR abs(rest[1].t - x.t) <= {gap_y}"
        f" OR (rest[1].t - x.b BETWEEN 0 AND {gap_y} AND {across} > -{gap_x}) OR (rest[1].l - x.r BETWEEN 0 AND {gap_x} AND {down} > -{gap_y}))"
    )
    grown = (
        "struct_pack(t := least(done[i].t, rest[1].t), l := least(done[i].l, rest[1].l), n := done[i].n,"
        " r := greatest(done[i].r, rest[1].r), b := greatest(done[i].b, rest[1].b))"
    )
    return f"""
, given AS (
    SELECT page_id, list_sort(list(struct_pack(t := top, l := "left", n := n, r := "left" + width, b := top + height))) AS boxes
    FROM (SELECT *, CAST(row_number() OVER (PARTITION BY page_id ORDER BY "left" + width, top + height) AS BIGINT) AS n FROM {source}) GROUP BY page_id
), states AS (
    SELECT page_id, 0 AS step, boxes AS rest, list_slice(boxes, 1, 0) AS done, len(boxes) AS before FROM given
    UNION ALL
    SELECT page_id, step + 1,
           CASE WHEN len(rest) > 0 THEN list_slice(rest, 2, len(rest))
                ELSE list_sort(list_transform(done, lambda x, k: struct_pack(t := x.t, l := x.l, n := CAST(k AS BIGINT), r := x.r, b := x.b))) END,
           CASE WHEN len(rest) = 0 THEN list_slice(done, 1, 0) WHEN i IS NULL THEN done || [rest[1]]
                ELSE list_slice(done, 1, i - 1) || [{grown}] || list_slice(done, i + 1, len(done)) END,
           CASE WHEN len(rest) = 0 THEN len(done) ELSE before END
    FROM (SELECT *, list_position(list_transform(done, lambda x: {close}), TRUE) AS i FROM states WHERE len(rest) > 0 OR len(done) < before)
), ended AS (
    SELECT page_id, list_sort(list_transform(arg_max(done, step), lambda x, k: struct_pack(t := x.t, l := x.l, n := CAST(k AS BIGINT), r := x.r, b := x.b))) AS boxes
    FROM states WHERE len(rest) = 0 GROUP BY page_id
)
SELECT page_id, CAST(no AS INT) AS box_no, x.l AS "left", x.t AS top, x.r - x.l AS width, x.b - x.t AS height
FROM (SELECT page_id, unnest(boxes) AS x, unnest(range(len(boxes))) AS no FROM ended)
"""


@query("merge_page_boxes", merging("v_parts_boxes", 20, 5))
def _(t):
    """Boxes of a page, one per line item of a part, joined where they touch."""
    k = F.col("l_orderkey")
    flat = t.table("lineitem").select(
        F.col("l_partkey").alias("page_id"), (k % 1900).alias("left"), (k * 7 % 2300).alias("top"), F.col("l_quantity").alias("width"),
        (F.col("l_linenumber") * 6).alias("height"),
    )
    return boxmerge.merge_page_boxes(flat, gap_x=20.0, gap_y=5.0)


o.cte("v_line_boxes", """
SELECT page_id, CAST(i % 3 * 260 AS DOUBLE) AS "left", CAST(i // 3 * 120 + length(line) % 17 AS DOUBLE) AS top,
       CAST(length(line) % 150 + 20 AS DOUBLE) AS width, CAST(length(line) % 40 + 10 AS DOUBLE) AS height
FROM (SELECT CAST(doc_id AS VARCHAR) AS page_id, pos AS i, line FROM v_split)
""")


@query("merge_boxes", merging("v_line_boxes", 20, 5))
def _(t):
    """Boxes of a page, one per line of a document, joined where they touch."""
    lines = F.filter(F.transform(F.split("text", "\n"), lambda s: F.trim(s)), lambda s: s != "")
    made = F.transform(
        lines,
        lambda s, i: F.struct(
            ((i % 3) * 260).cast("double").alias("left"), ((F.floor(i / 3) * 120) + (F.length(s) % 17)).cast("double").alias("top"),
            (F.length(s) % 150 + 20).cast("double").alias("width"), (F.length(s) % 40 + 10).cast("double").alias("height"),
        ),
    )
    pages = t.spread("documents").select(F.col("doc_id").cast("string").alias("page_id"), made.alias("boxes"))
    rows = boxes.merge_boxes(pages, gap_x=20.0, gap_y=5.0).select("page_id", F.posexplode("boxes").alias("box_no", "b"))
    return rows.select("page_id", "box_no", "b.*")
