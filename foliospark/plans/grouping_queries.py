"""Reading order, markers, problems, and the slots they take."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark import scale
from foliospark.functions import text as tx
from foliospark.operators import flatten, grouping, ordering, placement
from foliospark.plans import oracle as o
from foliospark.plans.bindings import Tables
from foliospark.plans.registry import query


def tags(t: Tables):
    """Tagged blocks as a table. Tagging looks at one row at a time, so texts are read once."""
    return t.once("tags", lambda: scale.staged(grouping.tag_blocks(t.read_blocks).drop("text", "line", "display_title")))


def titles(t: Tables):
    return tags(t).select("page_id", "block_id", "display_title_text")


def tagged(t: Tables):
    """Tags in reading order; titles stay behind, so what is sorted and moved is narrow."""
    return ordering.reading_order(tags(t).drop("display_title_text"))


def grouped(t: Tables):
    """Blocks with their problem; written, as several steps read them."""
    return t.once("grouped", lambda: scale.staged(grouping.group_problems(scale.staged(tagged(t)))))


def layout(t: Tables):
    made = placement.layout_inputs(grouped(t)).withColumn("allowed", F.lit(None).cast("boolean"))
    return scale.staged(made)


@query("reading_order", "SELECT page_id, block_id, reading_order FROM v_ordered")
def _(t):
    return ordering.reading_order(t.block_table).select("page_id", "block_id", "reading_order")


@query("sorted_blocks", """
SELECT page_id, block_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY reading_order, top, "left", pos) AS BIGINT) AS place
FROM v_blocks
""")
def _(t):
    order = [F.col(c) for c in ("reading_order", "top", "left", "pos")]
    return scale.rank(t.blocks, ["page_id"], order, "place").select("page_id", "block_id", "place")


@query("line_numbers", "SELECT * FROM v_numbers")
def _(t):
    return grouping.line_numbers(t.lines, t.block_table)


@query("block_markers", """
SELECT page_id, block_id, block_type, CAST(number AS DOUBLE) AS problem_number, number_source AS problem_number_source,
       problem_marker, choice_marker, marker_conflict, is_start, title
FROM v_tagged
""")
def _(t):
    return tags(t).select(
        "page_id", "block_id", "block_type", F.col("problem_number").cast("double").alias("problem_number"),
        "problem_number_source", "problem_marker", "choice_marker", "marker_conflict", "is_start", F.col("display_title_text").alias("title"),
    )


@query("text_markers", f"""
SELECT block_id, line_no, {o.marker("text")} AS problem_marker, {o.choice("text")} AS choice_marker,
       CAST({o.number("text")} AS DOUBLE) AS problem_number,
       coalesce(regexp_matches({o.strip("text")}, '^[1-9]\\)'), FALSE) AS overlap_marker
FROM v_lines
""")
def _(t):
    c = F.col("text")
    return t.lines.select(
        "block_id", "line_no", tx.has_problem_marker(c).alias("problem_marker"),
        tx.has_choice_marker(c).alias("choice_marker"),
        tx.problem_number(c).cast("double").alias("problem_number"),
        tx.has_overlap_marker(c).alias("overlap_marker"),
    )


@query("display_titles", f"""
SELECT block_id, coalesce({o.unmarked("s")}, s) AS title
FROM (SELECT block_id, coalesce({o.strip(o.filled("display_title"))}, {o.strip(o.filled("text"))}) AS s FROM v_blocks)
""")
def _(t):
    return t.blocks.select("block_id", tx.display_title_of(F.col("display_title"), F.col("text")).alias("title"))


@query("infer_subject", f"SELECT page_id, {o.SUBJECT_FACT} AS subject FROM v_blocks GROUP BY page_id")
def _(t):
    return grouping.infer_subject(t.blocks)


@query("group_problems", "SELECT page_id, block_id, problem_index, unit_id, role, block_type, fallback AS fallback_grouping, subject FROM v_grouped")
def _(t):
    return grouped(t).select(
        "page_id", "block_id", "problem_index", "unit_id", "role", "block_type", "fallback_grouping", "subject"
    )


@query("problems", "SELECT * REPLACE (CAST(problem_number AS DOUBLE) AS problem_number) FROM v_problems")
def _(t):
    made = grouping.problems_of(grouped(t), titles(t))
    return made.withColumn("problem_number", F.col("problem_number").cast("double"))


@query("fallback_grouping", """
SELECT page_id, block_id, page_id || '-problem-' || row_number() OVER (PARTITION BY page_id
           ORDER BY reading_order) AS unit_id
FROM v_ordered
QUALIFY count(question_band_index) OVER (PARTITION BY page_id) > 0 OR count(*) OVER (PARTITION BY page_id) > 1
""")
def _(t):
    """Every block counts; those that would start a problem have their text blanked."""
    blank = (F.col("pos") % 5).isin(0, 3)
    plain = t.block_table.withColumns(
        {"display_title": F.lit(None).cast("string"), "text": F.when(~blank, F.col("text"))}
    )
    found = grouping.group_problems(scale.staged(grouping.tag_blocks(ordering.reading_order(plain))))
    return found.where("fallback_grouping").select("page_id", "block_id", "unit_id")


@query("conversation_problems", """
SELECT CAST(conv_id AS VARCHAR) AS page_id, turn, CAST(sum(CAST(role = 'user' OR r = 1 AS INT))
       OVER (PARTITION BY conv_id ORDER BY turn) AS BIGINT) AS problem_index
FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) AS r FROM conversations)
""")
def _(t):
    """The grouping rule on real ordered data: a user turn forces a start."""
    turns = t.turns.select(
        F.col("conv_id").cast("string").alias("page_id"), F.col("turn").alias("pos"),
        F.concat_ws("-", "conv_id", "turn").alias("block_id"), F.lit("stem").alias("block_type"),
        F.lit(0.0).alias("left"), F.col("turn").cast("double").alias("top"), F.lit(1.0).alias("width"),
        F.lit(1.0).alias("height"), F.col("turn").alias("reading_order"), F.lit(None).cast("string").alias("text"),
        F.lit(None).cast("int").alias("column_index"), F.lit(None).cast("int").alias("question_band_index"),
        (F.col("role") == "user").alias("force_problem_start"), F.lit("unknown").alias("page_subject"), "turn",
    )
    tagged_turns = grouping.tag_blocks(ordering.reading_order(turns))
    marked = grouping.group_problems(tagged_turns)
    return marked.select("page_id", "turn", "problem_index")


@query("assemble_problems", """
SELECT unit_id, CAST(0 AS BIGINT) AS part,
       coalesce(string_agg(block_id, ',' ORDER BY reading_order) FILTER (role = 'stem'), '') AS stem_block_ids,
       coalesce(string_agg(block_id, ',' ORDER BY reading_order) FILTER (role = 'choice'), '') AS choice_block_ids,
       coalesce(string_agg(block_id, ',' ORDER BY reading_order) FILTER (role = 'explanation'), '') AS explanation_block_ids,
       coalesce(string_agg(block_id, ',' ORDER BY reading_order) FILTER (role = 'figure'), '') AS figure_block_ids
FROM v_grouped GROUP BY unit_id
""")
def _(t):
    made = grouping.assemble_problems(grouped(t))
    return made.select(
        "unit_id", "part", *[F.array_join(f"{r}_block_ids", ",").alias(f"{r}_block_ids") for r in flatten.ROLES]
    )


DIAGNOSTICS = """
SELECT page_id, bool_or(fallback) AS fallback_grouping, bool_or(is_start) AS has_text_markers,
       count(question_band_index) > 0 AS has_band_metadata, count(*) AS block_count, max(problem_index) AS problem_count,
       count(*) FILTER (problem_marker) AS problem_marker_count, count(*) FILTER (choice_marker) AS choice_marker_count,
       count(*) FILTER (marker_conflict) AS marker_conflict_count, count(*) FILTER (force_problem_start) AS forced_start_count,
       count(number) AS problem_number_count, count(fallback_reason) AS fallback_reason_count,
       arg_min(number_source, reading_order) FILTER (number_source IS NOT NULL) AS problem_number_source,
       CASE WHEN bool_or(fallback) THEN 'fallback' ELSE 'marker' END AS grouping_mode,
       CASE WHEN bool_or(fallback) THEN 'fallback_grouping' ELSE 'marker_grouping' END AS grouping_source,
       CASE WHEN bool_or(fallback) THEN concat_ws(',', 'no_text_markers',
            CASE WHEN count(question_band_index) > 0 THEN 'band_metadata_present' END,
            CASE WHEN count(*) > 1 THEN 'multi_block_page' END) ELSE 'text_markers_detected' END AS trigger_reasons,
       count(*) FILTER (number_source = 'ocr_top_left') AS ocr_top_left,
       count(*) FILTER (number_source = 'ocr_line') AS ocr_line,
       count(*) FILTER (number_source = 'text_prefix') AS text_prefix
FROM v_grouped GROUP BY page_id
"""


def flat_diagnostics(d):
    counts = [
        F.coalesce(F.try_element_at("number_source_counts", F.lit(s)), F.lit(0)).alias(s)
        for s in ("ocr_top_left", "ocr_line", "text_prefix")
    ]
    return d.select("*", *counts).withColumn("trigger_reasons", F.array_join("trigger_reasons", ",")).drop(
        "number_source_counts"
    )


@query("grouping_diagnostics", DIAGNOSTICS)
def _(t):
    return flat_diagnostics(grouping.grouping_diagnostics(grouped(t)))


@query("page_summary", f"""
SELECT * FROM ({DIAGNOSTICS}) JOIN (
    SELECT page_id, min(subject) AS subject, count(CASE WHEN opens THEN number END) AS numbered_problem_count
    FROM v_grouped GROUP BY page_id) USING (page_id)
""")
def _(t):
    return flat_diagnostics(grouping.page_summary(grouped(t)))


@query("page_problems", """
SELECT p.page_id, p.unit_id, p.problem_index, p.title, CAST(p.problem_number AS DOUBLE) AS problem_number, p.problem_number_source,
       CAST(0 AS BIGINT) AS part, stem_block_ids, choice_block_ids, figure_block_ids
FROM v_problems p JOIN (
    SELECT unit_id, coalesce(string_agg(block_id, ',' ORDER BY reading_order) FILTER (role = 'stem'), '') AS stem_block_ids,
           coalesce(string_agg(block_id, ',' ORDER BY reading_order) FILTER (role = 'choice'), '') AS choice_block_ids,
           coalesce(string_agg(block_id, ',' ORDER BY reading_order) FILTER (role = 'figure'), '') AS figure_block_ids
    FROM v_grouped GROUP BY unit_id) g ON p.unit_id = g.unit_id
""")
def _(t):
    made = grouping.page_problems(grouped(t), titles(t)).withColumn("problem_number", F.col("problem_number").cast("double"))
    names = [f"{r}_block_ids" for r in ("stem", "choice", "figure")]
    return made.withColumns({n: F.array_join(n, ",") for n in names})


@query("layout_inputs", "SELECT * FROM v_layout")
def _(t):
    return placement.layout_inputs(grouped(t), titles(t))


o.cte("v_layout_heights", """
SELECT l.*, p.source AS board_id, p.doc_id, CAST(NULL AS BOOLEAN) AS allowed
FROM v_layout l JOIN v_pages p ON l.page_id = p.page_id
""")
o.cte("v_board", o.placed("v_layout_heights", "page_id", "problem_index"))


@query("board_placements", """
SELECT unit_id, seq0 AS seq, start_y, content_height, bottom_y, next_start_y, overflow_allowed, overflow_amount,
       overflow_violation, slot_span, over_capacity
FROM v_board
""")
def _(t):
    """One board per document."""
    return placement.place(layout(t), ["page_id"], ["problem_index"]).select(
        "unit_id", "seq", "start_y", "content_height", "bottom_y", "next_start_y", "overflow_allowed",
        "overflow_amount", "overflow_violation", "slot_span", "over_capacity",
    )


@query("board_summary", """
SELECT page_id AS board_id, count(*) AS problem_count, count(*) FILTER (overflow_amount > 0) AS overflow_count,
       count(*) FILTER (overflow_violation) AS overflow_violation_count, max(bottom_y) AS max_bottom_y,
       CAST(sum(slot_span) AS BIGINT) AS slot_count
FROM v_board GROUP BY page_id
""")
def board_summary(t):
    """Cut every document into problems, pack them, report slots and overflow per board."""
    placed = placement.place(layout(t), ["page_id"], ["problem_index"])
    summary = placement.placement_summary(placed, ["page_id"])
    return summary.drop("text_record_count", "image_record_count").withColumnRenamed("page_id", "board_id")
