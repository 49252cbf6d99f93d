"""The bindings in SQL, for checking results with another engine."""

from __future__ import annotations

import re

S = r"\s"  # the other engine's white-space class (the given texts hold ASCII spaces only)
NAME = re.compile(r"\bv_[a-z_]+\b")

CTES: dict[str, str] = {}


def cte(name: str, body: str) -> None:
    CTES[name] = body.strip()


def sql(body: str) -> str:
    """Put the views a query names, and those they name, in front of it.

    A query that begins with a comma goes on with views of its own, which may be recursive.
    """
    needed: list[str] = []

    def visit(text: str) -> None:
        for name in NAME.findall(text):
            if name in CTES and name not in needed:
                visit(CTES[name])
                if name not in needed:
                    needed.append(name)

    visit(body)
    if not needed:
        return body
    head = ",\n".join(f"{n} AS MATERIALIZED (\n{CTES[n]}\n)" for n in needed)
    return f"WITH {'RECURSIVE ' if body.lstrip().startswith(',') else ''}{head}\n{body}"


SUBJECT = (
    "CASE lang WHEN 'en' THEN 'english' WHEN 'fr' THEN 'social' WHEN 'de' THEN 'science' "
    "WHEN 'es' THEN 'math' ELSE 'unknown' END"
)
SPLIT = "list_filter(list_transform(string_split(text, chr(10)), lambda s: trim(s)), lambda s: s <> '')"

cte("v_pages", f"""
SELECT CAST(doc_id AS VARCHAR) AS page_id, source, {SUBJECT} AS page_subject, 800 AS page_width,
       CAST(len({SPLIT}) AS INT) * 60 + 80 AS page_height, doc_id
FROM documents
""")
cte("v_split", f"""
SELECT doc_id, source, {SUBJECT} AS page_subject, CAST(len(ls) AS INT) * 60 + 80 AS page_height,
       CAST(unnest(range(len(ls))) AS INT) AS pos, unnest(ls) AS line
FROM (SELECT *, {SPLIT} AS ls FROM documents)
""")
cte("v_blocks", """
SELECT CAST(doc_id AS VARCHAR) AS page_id, doc_id, source, page_subject, 800 AS page_width, page_height, pos,
       printf('%d-block-%03d', doc_id, pos + 1) AS block_id,
       CASE WHEN pos % 5 = 4 THEN 'image' ELSE 'stem' END AS block_type,
       CAST(pos % 2 * 400 AS DOUBLE) AS "left", CAST(pos // 2 * 60 AS DOUBLE) AS top,
       CAST(length(line) % 300 + 40 AS DOUBLE) AS width, CAST(40 AS DOUBLE) AS height,
       pos AS reading_order,
       CASE WHEN pos % 5 = 0 THEN (pos // 5 + 1) || '. ' || line
            WHEN pos % 5 = 3 THEN '① ' || line
            WHEN pos % 5 = 4 THEN NULL ELSE line END AS text,
       line, CAST((doc_id * 31 + pos * 17) % 100 AS DOUBLE) / 100 AS confidence,
       CASE WHEN doc_id % 5 <> 0 OR pos > 0 THEN pos % 2 + 1 END AS column_index,
       CASE WHEN doc_id % 4 <> 0 THEN pos // 2 + 1 END AS question_band_index,
       CASE WHEN pos % 7 = 6 THEN 'noop_ocr' WHEN pos % 11 = 10 THEN 'empty_segmentation' END AS fallback_reason,
       CASE WHEN pos % 13 = 12 THEN '문항 ' || (pos % 90 + 1) || '. ' || line END AS display_title,
       FALSE AS force_problem_start
FROM v_split
""")
cte("v_lines", """
SELECT page_id, block_id, line_no,
       CASE WHEN line_no = 0 AND pos % 5 = 0 THEN (pos // 5 + 1) || '. ' || s
            WHEN line_no = 1 AND pos % 5 = 1 THEN (pos % 9 + 1) || ') ' || s
            WHEN line_no = 2 AND pos % 3 = 2 THEN '[' || (pos % 99 + 1) || '] ' || s
            ELSE s END AS text,
       CAST((line_no * 13 + pos * 7) % 100 AS DOUBLE) / 100 AS confidence,
       CAST(line_no % 3 * 30 AS DOUBLE) AS "left", CAST(line_no * 6 AS DOUBLE) AS top,
       CAST(length(s) % 200 + 20 AS DOUBLE) AS width, CAST(12 AS DOUBLE) AS height
FROM (SELECT page_id, block_id, pos, CAST(unnest(range(len(ss))) AS INT) AS line_no, unnest(ss) AS s
      FROM (SELECT *, string_split(line, '. ') AS ss FROM v_blocks WHERE text IS NOT NULL))
""")
cte("v_heights", """
SELECT o_custkey AS board_id, o_orderdate AS placed_on, o_orderkey AS problem_id,
       floor(o_totalprice) / 100000 AS height_pages,
       CASE o_orderpriority WHEN '1-URGENT' THEN 'math' WHEN '2-HIGH' THEN 'korean' WHEN '3-MEDIUM' THEN 'science'
            WHEN '5-LOW' THEN 'english' ELSE 'unknown' END AS subject,
       o_orderkey % 7 = 0 AS heavy,
       CASE WHEN o_orderkey % 11 = 0 THEN o_orderstatus = 'F' END AS allowed
FROM orders
""")
cte("v_boxes", """
SELECT l_orderkey AS page_id,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_partkey, l_suppkey, l_linenumber, l_quantity,
           l_extendedprice, l_discount, l_tax, l_returnflag, l_linestatus, l_shipdate) AS box_id,
       l_quantity AS "left", CAST(l_linenumber * 10 AS DOUBLE) AS top, l_discount * 1000 AS width,
       l_tax * 1000 AS height, l_extendedprice / 100000 AS fill_ratio
FROM lineitem
""")
cte("v_marks", """
SELECT user_id AS series_id, CAST(floor((epoch(ts) - epoch(TIMESTAMP '2024-01-01 00:00:00')) / 3600) AS BIGINT) AS pos,
       event_type
FROM events
""")


# ------------------------------------------------------------- text fragments
from foliospark.functions.text import WHITE_SPACE  # noqa: E402
from foliospark.settings import (  # noqa: E402
    CHOICE_PATTERN,
    CHOICE_PREFIXES,
    FORMULA_MARKS,
    GENERIC_TITLE_PATTERN,
    KOREAN_SUBJECT_WORDS,
    MATH_SUBJECT_WORDS,
    PROBLEM_PATTERN,
    SCIENCE_SUBJECT_WORDS,
    SECTION_SUFFIXES,
)

PROBLEM = PROBLEM_PATTERN.replace("{s}", S)
CHOICE = CHOICE_PATTERN.replace("{s}", S)
GENERIC_TITLE = GENERIC_TITLE_PATTERN.replace("{s}", S)


def strip(x: str) -> str:
    return f"trim({x}, '{WHITE_SPACE}')"


def filled(x: str) -> str:
    return f"CASE WHEN {strip(x)} <> '' THEN {x} END"


def marker(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{PROBLEM}'), FALSE)"


def choice(x: str) -> str:
    return f"coalesce(regexp_matches({x}, '{CHOICE}'), FALSE)"


def number(x: str) -> str:
    return f"TRY_CAST(nullif(regexp_extract({x}, '{PROBLEM}', 1) || regexp_extract({x}, '{PROBLEM}', 2), '') AS INT)"


def unmarked(x: str) -> str:
    return f"nullif({strip(f"regexp_replace({x}, '{PROBLEM}', '')")}, '')"


def any_of(x: str, words) -> str:
    return "(" + " OR ".join(f"contains({x}, '{w}')" for w in words) + ")"


def text_type(x: str) -> str:
    body = f"coalesce({strip(x)}, '')"
    starts = " OR ".join(f"starts_with({body}, '{p}')" for p in CHOICE_PREFIXES)
    ends = " OR ".join(f"ends_with({body}, '{p}')" for p in SECTION_SUFFIXES)
    return (
        f"CASE WHEN {body} = '' THEN 'unknown' WHEN {any_of(body, FORMULA_MARKS)} THEN 'formula' "
        f"WHEN {starts} THEN 'choice' WHEN length({body}) <= 24 AND ({ends}) THEN 'section' ELSE 'stem' END"
    )


SUBJECT_FACT = (
    f"CASE WHEN bool_or({any_of('lower(text)', MATH_SUBJECT_WORDS)}) THEN 'math' "
    f"WHEN bool_or({any_of('lower(text)', SCIENCE_SUBJECT_WORDS)}) THEN 'science' "
    f"WHEN bool_or({any_of('lower(text)', KOREAN_SUBJECT_WORDS)}) THEN 'korean' ELSE min(page_subject) END"
)
FIGURE = "('image', 'diagram', 'table')"

# ------------------------------------------------------- ordering and grouping
cte("v_ordered", """
SELECT * EXCLUDE (reading_order, c),
       CAST(row_number() OVER (PARTITION BY page_id ORDER BY
           CASE WHEN c THEN column_index END NULLS FIRST,
           CASE WHEN c THEN coalesce(question_band_index, reading_order) END NULLS FIRST,
           round_even(top, 4), round_even("left", 4),
           CASE WHEN NOT c THEN reading_order END NULLS FIRST, pos) - 1 AS INT) AS reading_order
FROM (SELECT *, bool_and(column_index IS NOT NULL) OVER (PARTITION BY page_id) AS c FROM v_blocks)
""")
cte("v_candidates", f"""
SELECT l.page_id, l.block_id, l.line_no, {number("l.text")} AS n,
       greatest(0, l.top / greatest(b.height, 1)) AS down, greatest(0, l."left" / greatest(b.width, 1)) AS across
FROM v_lines l JOIN v_blocks b ON l.block_id = b.block_id AND l.page_id = b.page_id
""")
cte("v_numbers", """
SELECT page_id, block_id, n AS line_number, CASE WHEN outside THEN 'ocr_line' ELSE 'ocr_top_left' END AS line_source
FROM (SELECT *, row_number() OVER (PARTITION BY page_id, block_id ORDER BY outside, score, line_no) AS r
      FROM (SELECT *, NOT (down <= 0.32 AND across <= 0.18) AS outside,
                   down * 2.4 + across + line_no * 0.05::DOUBLE AS score
            FROM v_candidates WHERE n IS NOT NULL))
WHERE r = 1
""")
cte("v_marked", f"""
SELECT *, {number("source_text")} AS text_number, {marker("raw")} AS raw_marker, {choice("raw")} AS choice_marker
FROM (SELECT o.*, n.line_number, n.line_source, {strip(filled("o.text"))} AS raw,
             coalesce({strip(filled("o.display_title"))}, {strip(filled("o.text"))}) AS source_text
      FROM v_ordered o LEFT JOIN v_numbers n ON o.page_id = n.page_id AND o.block_id = n.block_id)
""")
cte("v_typed", f"""
SELECT *,
       CASE WHEN coalesce(text, '') = '' THEN block_type
            WHEN NOT force_problem_start AND number IS NULL AND (block_type = 'choice' OR {choice("text")}) THEN 'choice'
            WHEN force_problem_start OR (block_type <> 'choice' AND (number IS NOT NULL OR (block_type IN ('title', 'section')
                 AND (raw IS NOT NULL OR coalesce(display_title, '') <> '')))) THEN 'title'
            ELSE block_type END AS new_type
FROM (SELECT *, coalesce(line_number, text_number) AS number,
             coalesce(line_source, CASE WHEN text_number IS NOT NULL THEN 'text_prefix' END) AS number_source
      FROM v_marked)
""")
cte("v_tagged", f"""
SELECT * EXCLUDE (block_type, new_type, raw_marker, text_number), new_type AS block_type,
       raw_marker OR ((raw IS NULL OR source_text <> raw) AND {marker("source_text")}) AS problem_marker,
       choice_marker AND (raw_marker OR number IS NOT NULL) AS marker_conflict,
       coalesce({unmarked("source_text")}, source_text) AS title,
       force_problem_start OR (new_type <> 'choice' AND (number IS NOT NULL OR (new_type IN ('title', 'section')
           AND (raw IS NOT NULL OR coalesce(display_title, '') <> '')))) AS is_start
FROM v_typed
""")
cte("v_facts", f"""
SELECT page_id, NOT bool_or(is_start) AND (count(question_band_index) > 0 OR count(*) > 1) AS fallback,
       {SUBJECT_FACT} AS subject
FROM v_tagged GROUP BY page_id
""")
cte("v_grouped", f"""
SELECT *, page_id || '-problem-' || problem_index AS unit_id,
       CASE WHEN block_type IN ('title', 'stem', 'formula', 'section') THEN 'stem' WHEN block_type = 'choice' THEN 'choice'
            WHEN block_type IN {FIGURE} THEN 'figure' WHEN block_type = 'explanation' THEN 'explanation'
            WHEN fallback OR coalesce(text, '') <> '' THEN 'stem' END AS role
FROM (SELECT t.*, f.fallback, f.subject, t.is_start OR t.reading_order = 0 OR f.fallback AS opens,
             CAST(sum(CAST(t.is_start OR t.reading_order = 0 OR f.fallback AS INT))
                  OVER (PARTITION BY t.page_id ORDER BY t.reading_order) AS BIGINT) AS problem_index
      FROM v_tagged t JOIN v_facts f ON t.page_id = f.page_id)
""")
cte("v_problems", """
SELECT page_id, unit_id, problem_index, min(subject) AS subject, max(CASE WHEN opens THEN title END) AS title,
       max(CASE WHEN opens THEN number END) AS problem_number,
       max(CASE WHEN opens THEN number_source END) AS problem_number_source, bool_or(fallback) AS fallback_grouping,
       count(*) FILTER (role = 'stem') AS stem_count, count(*) FILTER (role = 'choice') AS choice_count,
       count(*) FILTER (role = 'explanation') AS explanation_count, count(*) FILTER (role = 'figure') AS figure_count
FROM v_grouped GROUP BY ALL
""".replace("GROUP BY ALL", "GROUP BY page_id, unit_id, problem_index"))
cte("v_spread", """
SELECT g.page_id, g.unit_id, g.problem_index, min(g.subject) AS subject,
       max(CASE WHEN opens THEN title END) AS title,
       min(CASE WHEN role IS NOT NULL THEN top END) AS t, max(CASE WHEN role IS NOT NULL THEN top + height END) AS b,
       max(page_height) AS h, count(*) FILTER (role = 'stem') AS stem_count,
       count(*) FILTER (role = 'choice') AS choice_count, count(*) FILTER (role = 'figure') AS figure_count
FROM v_grouped g GROUP BY g.page_id, g.unit_id, g.problem_index
""")
cte("v_layout", """
SELECT page_id, unit_id, problem_index, subject, title, stem_count, choice_count, figure_count,
       round_even(CASE WHEN t IS NULL THEN 0.9 ELSE greatest(0.35, least(2.4, greatest(0, (b - t) / greatest(h, 1)) * 1.2::DOUBLE
           + CASE WHEN figure_count > 0 THEN 0.18::DOUBLE ELSE 0 END + CASE WHEN choice_count > 0 THEN 0.08::DOUBLE ELSE 0 END
           + CASE WHEN subject IN ('korean', 'english') THEN 0.08::DOUBLE ELSE 0 END)) END, 6) AS height_pages,
       subject IN ('korean', 'english') OR choice_count > 0 OR figure_count > 0 AS heavy
FROM v_spread
""")


def placed(source: str, board: str, order: str, slot: str = "1.2", columns: str = "*", digits: int = 6) -> str:
    """Slot packing over a source with height_pages, subject, heavy, allowed."""
    return f"""
SELECT * EXCLUDE (h, k, e, ok), seq - 1 AS seq0, h AS content_height,
       round_even((e - k) * {slot}::DOUBLE, {digits}) AS start_y,
       round_even(e * {slot}::DOUBLE, {digits}) AS next_start_y, ok AS overflow_allowed,
       round_even(greatest(0, h - {slot}::DOUBLE), {digits}) AS overflow_amount,
       h - {slot}::DOUBLE > 0 AND NOT ok AS overflow_violation, CAST(greatest(1, k) AS INT) AS slot_span,
       round_even(round_even((e - k) * {slot}::DOUBLE, {digits}) + h, {digits}) AS bottom_y,
       round_even(round_even((e - k) * {slot}::DOUBLE, {digits}) + h, {digits}) > 50 AS over_capacity
FROM (SELECT *, CAST(sum(k) OVER (PARTITION BY {board} ORDER BY {order}) AS BIGINT) AS e,
             row_number() OVER (PARTITION BY {board} ORDER BY {order}) AS seq
      FROM (SELECT {columns}, greatest(height_pages, 0) AS h,
                   coalesce(allowed, heavy OR subject IN ('korean', 'english')) AS ok,
                   CAST(greatest(0, ceil((round_even(greatest(height_pages, 0), {digits}) - 1e-9::DOUBLE) / {slot}::DOUBLE)) AS BIGINT) AS k
            FROM {source}))
"""


cte("v_placed", placed("v_heights", "board_id", "placed_on, problem_id"))
