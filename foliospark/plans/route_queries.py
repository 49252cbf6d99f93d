"""Page diagnostics, risk, routes, caches, corrections."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark import scale
from foliospark.functions import text as tx
from foliospark.functions.numbers import to_bool, to_number, to_optional_float, to_optional_int
from foliospark.operators import cache, grouping, ordering, repair, rollup, routing, session
from foliospark.plans import oracle as o
from foliospark.plans.bindings import Tables
from foliospark.plans.grouping_queries import grouped, tags
from foliospark.plans.registry import query

# ------------------------------------------------------------- diagnostics
o.cte("v_reasons", """
SELECT page_id, string_agg(reason, ',' ORDER BY seen) AS reasons, arg_min(reason, seen) AS first_reason, count(*) AS n
FROM (SELECT page_id, fallback_reason AS reason, min(pos) AS seen FROM v_blocks WHERE fallback_reason IS NOT NULL GROUP BY ALL)
GROUP BY page_id
""")
RATIO = "width * height / greatest(page_width * CAST(page_height AS DOUBLE), 1)"
o.cte("v_seg", f"""
SELECT p.page_id, coalesce(s.n, 0) AS block_count, coalesce(text_n, 0) AS text_block_count, coalesce(image_n, 0) AS image_block_count,
       coalesce(large_n, 0) AS large_block_count, coalesce(round_even(large_n / greatest(s.n, 1), 6), 0) AS large_block_ratio,
       coalesce(round_even(mx, 6), 0) AS max_block_area_ratio, coalesce(round_even(mean, 6), 0) AS mean_block_area_ratio,
       coalesce(r.reasons, '') AS fallback_reasons, r.first_reason AS fallback_reason,
       CAST(coalesce(r.n, 0) AS INT) AS fallback_reason_count
FROM v_pages p
LEFT JOIN (SELECT page_id, count(*) AS n, count(*) FILTER (trim(text) <> '') AS text_n, count(*) FILTER (block_type IN {o.FIGURE}) AS image_n,
                  count(*) FILTER ({RATIO} >= 0.05) AS large_n, max({RATIO}) AS mx, sum({RATIO}) / count(*) AS mean
           FROM v_blocks GROUP BY page_id) s ON p.page_id = s.page_id
LEFT JOIN v_reasons r ON p.page_id = r.page_id
""")


@query("segmentation_stats", "SELECT * FROM v_seg")
def _(t):
    made = routing.segmentation_stats(t.block_table, t.pages, threshold=0.05)
    return made.withColumn("fallback_reasons", F.array_join("fallback_reasons", ","))


def read_blocks(t: Tables, blocks=None):
    """Blocks with recogniser facts."""
    n = F.col("pos")
    return (t.block_table if blocks is None else blocks).withColumns(
        {
            "ocr_backend": F.when(n % 4 == 1, "tesseract").when(n % 4 == 2, "paddle"),
            "ocr_cache_hit": n % 3 == 0, "ocr_cache_miss": n % 3 == 1, "ocr_line_count": F.when(n % 5 != 4, (n % 5).cast("int")),
            "ocr_lines": F.when(n % 2 == 0, F.array_repeat(F.struct(F.lit("x").alias("text")), (n % 3).cast("int"))),
            "ocr_latency_ms": F.when(n % 2 == 0, n.cast("double")),
            "confidence": F.when(n % 9 != 8, F.col("confidence")),
        }
    )


o.cte("v_read", """
SELECT * EXCLUDE (confidence), CASE WHEN pos % 4 = 1 THEN 'tesseract' WHEN pos % 4 = 2 THEN 'paddle' END AS ocr_backend,
       pos % 3 = 0 AS ocr_cache_hit, pos % 3 = 1 AS ocr_cache_miss,
       coalesce(CASE WHEN pos % 5 <> 4 THEN pos % 5 END, CASE WHEN pos % 2 = 0 THEN pos % 3 END, 0) AS ocr_line_count,
       CASE WHEN pos % 2 = 0 THEN pos END AS ocr_latency_ms, CASE WHEN pos % 9 <> 8 THEN confidence END AS confidence
FROM v_blocks
""")
o.cte("v_ocr", f"""
SELECT page_id, count(*) FILTER (w) AS text_block_count, count(*) FILTER (w AND blank) AS empty_text_block_count,
       count(*) FILTER (w AND blank) / greatest(count(*) FILTER (w), 1) AS empty_text_ratio,
       count(*) FILTER (w AND weak) AS low_confidence_block_count,
       count(*) FILTER (w AND weak) / greatest(count(*) FILTER (w), 1) AS low_confidence_ratio,
       round(avg(confidence) FILTER (w), 6) AS avg_confidence, CAST(sum(ocr_line_count) AS BIGINT) AS recognized_line_count,
       count(*) FILTER (ocr_cache_hit) AS ocr_cache_hit_count, count(*) FILTER (ocr_cache_miss) AS ocr_cache_miss_count,
       round(avg(ocr_latency_ms), 6) AS latency_ms_avg, count(*) FILTER (ocr_backend IS NULL) AS none_blocks,
       count(*) FILTER (ocr_backend = 'tesseract') AS tesseract_blocks
FROM (SELECT *, block_type NOT IN {o.FIGURE} AS w, coalesce(trim(text), '') = '' AS blank,
             confidence IS NULL OR confidence < 0.55 OR coalesce(trim(text), '') = '' AS weak FROM v_read)
GROUP BY page_id
""")


@query("ocr_diagnostics", "SELECT * FROM v_ocr")
def _(t):
    made = routing.ocr_diagnostics(read_blocks(t))
    count = lambda k: F.coalesce(F.try_element_at("backend_counts", F.lit(k)), F.lit(0))
    return made.withColumns(
        {
            "avg_confidence": F.round("avg_confidence", 6), "latency_ms_avg": F.round("latency_ms_avg", 6),
            "none_blocks": count("none"), "tesseract_blocks": count("tesseract"),
        }
    ).drop("backend_counts")


def diagnostics(t: Tables):
    """All inputs of the risk score, one row per page."""
    blocks, tagged = grouped(t), tags(t)
    read = read_blocks(t, tagged)
    seg = routing.segmentation_stats(tagged, t.pages, threshold=0.05)
    ocr = routing.ocr_diagnostics(read).select("page_id", "empty_text_ratio", "low_confidence_ratio", "avg_confidence")
    found = grouping.grouping_diagnostics(blocks).select(
        "page_id", "problem_count", "problem_marker_count", "marker_conflict_count",
        F.when(F.col("fallback_grouping"), F.col("problem_count")).otherwise(0).alias("fallback_problem_count"),
    )
    image = routing.full_page_images(tagged)
    page = F.col("page_id").cast("bigint")
    return (
        seg.select("page_id", "block_count", "large_block_ratio", "max_block_area_ratio", "fallback_reasons")
        .join(ocr, "page_id", "left").join(found, "page_id", "left").join(image, "page_id", "left")
        .withColumns({"document_split_applied": page % 6 == 0, "candidate_count": (page % 4).cast("int")})
    )


o.cte("v_diag", f"""
SELECT s.page_id, s.block_count, s.large_block_ratio, s.max_block_area_ratio, s.fallback_reasons, e.empty_text_ratio,
       e.low_confidence_ratio, e.avg_confidence, g.problem_count, g.markers, g.conflicts, g.fallbacks,
       coalesce(i.image, FALSE) AS image, CAST(s.page_id AS BIGINT) AS p
FROM v_seg s LEFT JOIN v_ocr e ON s.page_id = e.page_id
LEFT JOIN (SELECT page_id, max(problem_index) AS problem_count, count(*) FILTER (problem_marker) AS markers,
                  count(*) FILTER (marker_conflict) AS conflicts, CASE WHEN bool_or(fallback) THEN max(problem_index) ELSE 0 END AS fallbacks
           FROM v_grouped GROUP BY page_id) g ON s.page_id = g.page_id
LEFT JOIN (SELECT page_id, count(*) = 1 AND bool_or(block_type IN {o.FIGURE} AND width * height >= page_width * CAST(page_height AS DOUBLE) * 0.75::DOUBLE) AS image
           FROM v_blocks GROUP BY page_id) i ON s.page_id = i.page_id
""")


def score(*terms: tuple[str, str]) -> str:
    total = " + ".join(f"CASE WHEN {c} THEN {w}::DOUBLE ELSE 0::DOUBLE END" for c, w in terms)
    return f"round_even(greatest(0, least(1, {total})), 4)"


o.cte("v_risk", f"""
SELECT *, greatest(segmentation_risk, ocr_risk, grouping_risk) AS overall_risk,
       CASE WHEN greatest(segmentation_risk, ocr_risk, grouping_risk) >= 0.66 THEN 'red'
            WHEN greatest(segmentation_risk, ocr_risk, grouping_risk) >= 0.33 THEN 'yellow' ELSE 'green' END AS tier
FROM (SELECT page_id, p, block_count,
       {score(("block_count <= 1", "0.48"), ("large_block_ratio >= 0.5 OR max_block_area_ratio >= 0.72", "0.4"),
              ("p % 6 = 0", "0.12"), ("p % 4 = 1", "0.18"), ("fallback_reasons <> ''", "0.5"))} AS segmentation_risk,
       {score(("p % 10 = 0", "0.34"), ("empty_text_ratio >= 0.5", "0.4"), ("low_confidence_ratio >= 0.5", "0.45"),
              ("avg_confidence < 0.55", "0.3"))} AS ocr_risk,
       {score(("block_count > 1 AND coalesce(markers, 0) = 0", "0.45"), ("conflicts > 0", "0.48"), ("fallbacks > 0", "0.52"),
              ("block_count > 1 AND problem_count = block_count", "0.42"), ("image", "0.6"))} AS grouping_risk,
       concat_ws(',', CASE WHEN block_count <= 1 THEN 'sparse_segmentation' END,
           CASE WHEN large_block_ratio >= 0.5 OR max_block_area_ratio >= 0.72 THEN 'large_block_dominance' END,
           nullif(fallback_reasons, ''), CASE WHEN p % 10 = 0 THEN 'ocr_disabled' END,
           CASE WHEN empty_text_ratio >= 0.5 THEN 'textless_blocks' END,
           CASE WHEN low_confidence_ratio >= 0.5 THEN 'low_ocr_confidence' END,
           CASE WHEN avg_confidence < 0.55 THEN 'low_avg_confidence' END,
           CASE WHEN block_count > 1 AND coalesce(markers, 0) = 0 THEN 'no_problem_markers' END,
           CASE WHEN conflicts > 0 THEN 'marker_conflicts' END, CASE WHEN fallbacks > 0 THEN 'fallback_grouping' END,
           CASE WHEN block_count > 1 AND problem_count = block_count THEN 'problem_per_block' END,
           CASE WHEN image THEN 'full_page_image' END) AS reasons
FROM v_diag)
""")


def risks(t: Tables):
    mode = F.when(F.col("page_id").cast("bigint") % 10 == 0, "noop").otherwise("auto")
    return routing.page_risk(diagnostics(t), mode)


@query("page_risk", """
SELECT page_id, segmentation_risk, ocr_risk, grouping_risk, overall_risk, tier, reasons FROM v_risk
""")
def _(t):
    return risks(t).select(
        "page_id", "segmentation_risk", "ocr_risk", "grouping_risk", "overall_risk", "tier",
        F.array_join("reasons", ",").alias("reasons"),
    )


@query("page_risk_parity", """
SELECT page_id, CAST(CASE WHEN block_count <= 1 THEN 0.48 ELSE 0 END AS DOUBLE) AS segmentation_risk,
       CAST(CASE WHEN block_count > 1 THEN 0.45 ELSE 0 END AS DOUBLE) AS grouping_risk
FROM v_seg
""")
def _(t):
    """The score as if no diagnostics had been stored: only block counts speak."""
    none = lambda d: F.lit(None).cast(d)
    bare = routing.segmentation_stats(t.block_table, t.pages).select("page_id", "block_count").withColumns(
        {
            "large_block_ratio": F.lit(0.0), "max_block_area_ratio": F.lit(0.0), "document_split_applied": F.lit(False),
            "candidate_count": F.lit(0), "fallback_reasons": F.array().cast("array<string>"), "empty_text_ratio": none("double"),
            "low_confidence_ratio": none("double"), "avg_confidence": none("double"), "problem_count": none("int"),
            "problem_marker_count": F.lit(0), "marker_conflict_count": F.lit(0), "fallback_problem_count": F.lit(0),
            "full_page_image": F.lit(False),
        }
    )
    return routing.page_risk(bare, "auto").select("page_id", "segmentation_risk", "grouping_risk")


o.cte("v_routes", """
SELECT *, CASE WHEN patch THEN 'ai_patch' ELSE 'local_only' END AS route,
       CASE WHEN NOT patch AND tier = 'yellow' THEN 'local_retry' END AS next_best_action,
       CASE WHEN forced THEN 'forced,' || reasons ELSE reasons END AS trigger_reasons
FROM (SELECT *, forced OR (enabled AND tier = 'red') AS patch
      FROM (SELECT *, p % 3 > 0 AS enabled, p % 3 > 0 AND p % 7 = 0 AS forced FROM v_risk))
""")


def routes(t: Tables):
    page = F.col("page_id").cast("bigint")
    enabled = page % 3 > 0
    mode = F.when(page % 7 == 0, " Force ").otherwise("auto")
    return routing.decide_route(risks(t), enabled, mode).withColumn("enabled", enabled)


@query("decide_route", """
SELECT page_id, patch AS should_patch, route, next_best_action,
       CASE WHEN forced AND reasons = '' THEN 'forced' ELSE trigger_reasons END AS trigger_reasons FROM v_routes
""")
def _(t):
    return routes(t).select(
        "page_id", "should_patch", "route", "next_best_action", F.array_join("trigger_reasons", ",").alias("trigger_reasons")
    )


o.cte("v_status", """
SELECT *, CASE WHEN NOT enabled THEN 'disabled' WHEN NOT patch AND next_best_action = 'local_retry' THEN 'local_retry_recommended'
            WHEN NOT patch THEN 'not_needed' WHEN block_count > 18 THEN 'too_many_blocks'
            WHEN p % 13 = 0 THEN 'provider_pending' WHEN p % 5 = 0 THEN 'cache_hit' WHEN p % 11 = 0 THEN 'missing_api_key'
            WHEN p % 17 = 0 THEN 'error' WHEN p % 19 = 0 THEN 'invalid_response' ELSE 'applied' END AS status
FROM v_routes
""")


def statuses(t: Tables):
    page = F.col("page_id").cast("bigint")
    facts = routes(t).withColumns(
        {
            "provider": F.when(page % 13 == 0, "other").otherwise(" OpenAI"), "cached_valid": page % 5 == 0,
            "has_key": page % 11 != 0, "call_error": F.when(page % 17 == 0, "timeout"),
            "response_error": F.when(page % 19 == 0, "bad"),
        }
    )
    return routing.repair_status(facts)


@query("repair_status", """
SELECT page_id, status, status IN ('error', 'invalid_response', 'applied') AS attempted,
       status IN ('cache_hit', 'applied') AS applied, status = 'cache_hit' AS cache_hit FROM v_status
""")
def _(t):
    return statuses(t).select("page_id", "status", "attempted", "applied", "cache_hit")


@query("repair_reasons", f"""
SELECT page_id, concat_ws(',', CASE WHEN n > 1 THEN 'ocr_disabled' END, CASE WHEN n > 1 AND NOT starts THEN 'no_problem_markers' END,
       CASE WHEN n > 1 AND fb THEN 'fallback_grouping' END, CASE WHEN n > 1 AND problems = n THEN 'problem_per_block' END,
       CASE WHEN n > 1 AND written > 0 AND low / written >= 0.5 THEN 'low_confidence' END,
       CASE WHEN n > 1 AND over THEN 'choice_problem_marker_overlap' END) AS reasons
FROM (SELECT page_id, count(*) AS n, max(problem_index) AS problems, bool_or(is_start) AS starts, bool_or(fallback) AS fb,
             count(*) FILTER (block_type NOT IN {o.FIGURE}) AS written,
             count(*) FILTER (block_type NOT IN {o.FIGURE} AND (coalesce(trim(text), '') = '' OR confidence IS NULL OR confidence < 0.55)) AS low,
             bool_or(coalesce(regexp_matches(trim(text), '^[1-9]\\)'), FALSE)) AS over
      FROM v_grouped GROUP BY page_id)
""")
def _(t):
    made = routing.repair_reasons(grouped(t), "none")
    return made.withColumn("reasons", F.array_join("reasons", ","))


# ------------------------------------------------------------------- caches
def keyed_documents(t: Tables):
    docs = t.spread("documents").select("doc_id", "text", (F.col("doc_id") % 10).cast("string").alias("lang_no"))
    return cache.with_cache_key(docs, F.col("text"), F.lit(" auto engine"))


def text_cache(t: Tables):
    """Cache of every third document's text."""
    some = keyed_documents(t).where("doc_id % 3 = 0")
    return some.groupBy("cache_key", "backend").agg(F.min("doc_id").alias("payload"))


o.cte("v_keyed", "SELECT doc_id, text, sha1(text) AS cache_key, 'auto_engine' AS backend FROM documents")
o.cte("v_cache", "SELECT cache_key, backend, min(doc_id) AS payload FROM v_keyed WHERE doc_id % 3 = 0 GROUP BY ALL")


LOOKUP = """
SELECT k.doc_id, k.cache_key, k.backend, CAST(c.payload AS DOUBLE) AS payload, c.payload IS NOT NULL AS cache_hit, c.payload IS NULL AS cache_miss
FROM v_keyed k LEFT JOIN v_cache c ON k.cache_key = c.cache_key AND k.backend = c.backend
"""


@query("cache_lookup", LOOKUP)
def _(t):
    found = cache.cache_lookup(keyed_documents(t), text_cache(t), spread_by=F.col("doc_id"))
    return found.select(
        "doc_id", "cache_key", "backend", F.col("payload").cast("double").alias("payload"), "cache_hit", "cache_miss"
    )


@query("clustered_cache_lookup", LOOKUP)
def _(t):
    """Look-up in a cache that lies in buckets of its key and is not moved."""
    path = scale.fresh_path(t.spark, "cache")
    held = cache.save_cache(text_cache(t), "cache_" + path.rsplit("-", 1)[1], buckets=8, path=path)
    found = cache.clustered_lookup(scale.staged(keyed_documents(t)), held, spread_by=F.col("doc_id"), buckets=8)
    return found.select(
        "doc_id", "cache_key", "backend", F.col("payload").cast("double").alias("payload"), "cache_hit", "cache_miss"
    )


@query("cache_fill", """
SELECT cache_key, backend, min(doc_id) AS doc_id FROM v_keyed k
WHERE NOT EXISTS (SELECT 1 FROM v_cache c WHERE c.cache_key = k.cache_key AND c.backend = k.backend) GROUP BY ALL
""")
def _(t):
    results = keyed_documents(t).select("cache_key", "backend", F.col("doc_id").alias("pick"), "doc_id")
    return cache.cache_fill(results, text_cache(t))


@query("cache_summary", f"""
SELECT source, count(*) FILTER (block_type NOT IN {o.FIGURE}) AS eligible_block_count,
       count(*) FILTER (ocr_cache_hit) AS ocr_cache_hit_count, count(*) FILTER (ocr_cache_miss) AS ocr_cache_miss_count
FROM v_read GROUP BY source
""")
def _(t):
    read = read_blocks(t).withColumnRenamed("ocr_cache_hit", "cache_hit").withColumnRenamed("ocr_cache_miss", "cache_miss")
    return cache.cache_summary(read, ["source"])


@query("rollup_lines", f"""
SELECT page_id, block_id, count(*) AS line_confidence_count, round(avg(confidence), 6) AS line_confidence_mean,
       min(confidence) AS line_confidence_min, max(confidence) AS line_confidence_max,
       string_agg(text, chr(10) ORDER BY line_no) AS text, CAST(count(*) AS INT) AS line_count,
       CAST(length({o.strip("string_agg(text, chr(10) ORDER BY line_no)")}) AS INT) AS text_length,
       {o.strip("string_agg(text, chr(10) ORDER BY line_no)")} = '' AS empty_text
FROM (SELECT * REPLACE (CASE WHEN line_no % 3 = 0 THEN chr(9) || ' ' ELSE text END AS text) FROM v_lines) GROUP BY page_id, block_id
""")
def _(t):
    """Every third line is white space only."""
    lines = t.lines.withColumn("text", F.when(F.col("line_no") % 3 == 0, F.lit("\t ")).otherwise(F.col("text")))
    made = rollup.rollup_lines(lines, ["page_id", "block_id"])
    return made.drop("confidence").withColumn("line_confidence_mean", F.round("line_confidence_mean", 6))


# -------------------------------------------------------------- corrections
def numbered_blocks(t: Tables):
    return t.block_table


def answers(t: Tables):
    """One correction per labelled document: good ones and each kind of bad one."""
    doc = F.col("doc_id")
    block = lambda n: F.concat(doc.cast("string"), F.format_string("-block-%03d", n))
    one, two, three = block(F.lit(1)), block(F.lit(2)), block(F.lit(3))
    good = (F.col("quality") == 1) | (doc % 5 == 4)
    starts = (
        F.when(good, F.array(one)).when(doc % 5 == 0, F.array().cast("array<string>"))
        .when(doc % 5 == 1, F.array(one, F.concat(F.lit("x-"), doc.cast("string")), F.lit("a-none")))
        .when(doc % 5 == 2, F.array(one, one)).otherwise(F.array(two, one))
    )
    choices = F.when(~good & (doc % 10 == 2), F.array(one)).when(doc % 3 == 0, F.array(two)).otherwise(F.array().cast("array<string>"))
    figures = F.when(doc % 2 == 0, F.array(three, one)).otherwise(F.array().cast("array<string>"))
    titles = F.array(F.struct(two.alias("block_id"), F.lit(" 문항 7. renamed ").alias("title")))
    payload = F.to_json(F.struct(
        starts.alias("problem_start_block_ids"), choices.alias("choice_block_ids"), figures.alias("figure_block_ids"),
        titles.alias("display_titles"),
    ))
    rows = t.table("labels").select(doc.cast("string").alias("page_id"), payload.alias("payload"))
    return repair.parse_repairs(rows).withColumn("trigger_reasons", F.array(F.lit("low_ocr_confidence")))


o.cte("v_answers", """
SELECT page_id, doc_id, CASE WHEN good THEN [b1] WHEN doc_id % 5 = 0 THEN [] WHEN doc_id % 5 = 1 THEN [b1, 'x-' || doc_id, 'a-none']
       WHEN doc_id % 5 = 2 THEN [b1, b1] ELSE [b2, b1] END AS starts,
       CASE WHEN NOT good AND doc_id % 10 = 2 THEN [b1] WHEN doc_id % 3 = 0 THEN [b2] ELSE [] END AS choices,
       CASE WHEN doc_id % 2 = 0 THEN [b3, b1] ELSE [] END AS figures, b2 AS titled
FROM (SELECT CAST(doc_id AS VARCHAR) AS page_id, doc_id, quality = 1 OR doc_id % 5 = 4 AS good, printf('%d-block-001', doc_id) AS b1,
             printf('%d-block-002', doc_id) AS b2, printf('%d-block-003', doc_id) AS b3 FROM labels)
""")
o.cte("v_checked", """
SELECT *, CASE WHEN len(starts) = 0 THEN 'problem_start_block_ids must include at least one block'
            WHEN len(unknown) > 0 THEN 'unknown block ids returned: [' || array_to_string(list_transform(unknown, lambda s: '''' || s || ''''), ', ') || ']'
            WHEN len(list_intersect(starts, choices)) > 0 THEN 'problem start and choice block ids overlap'
            WHEN len(list_distinct(starts)) <> len(starts) THEN 'problem_start_block_ids must be unique'
            WHEN starts <> list_sort(starts) THEN 'problem_start_block_ids must be in reading order' END AS error
FROM (SELECT a.*, list_sort(list_distinct(list_filter(list_concat(list_concat(starts, choices), figures), lambda s: NOT list_contains(coalesce(k.ids, []), s)))) AS unknown
      FROM v_answers a LEFT JOIN (SELECT page_id, list(block_id) AS ids FROM v_blocks GROUP BY page_id) k ON a.page_id = k.page_id)
""")


@query("validate_repairs", "SELECT page_id, error, error IS NULL AS ok FROM v_checked")
def _(t):
    return repair.validate_repairs(answers(t), t.block_table).select("page_id", "error", "ok")


def repaired(t: Tables):
    checked = repair.validate_repairs(answers(t), t.block_table).where("ok")
    return repair.apply_repairs(t.block_table, scale.staged(checked))


o.cte("v_repaired", f"""
SELECT b.* EXCLUDE (block_type, display_title, force_problem_start),
       CASE WHEN c.page_id IS NULL THEN block_type
            WHEN list_contains(starts, block_id) THEN CASE WHEN block_type IN {o.FIGURE} THEN block_type ELSE 'title' END
            WHEN list_contains(choices, block_id) THEN 'choice'
            WHEN list_contains(figures, block_id) THEN CASE WHEN block_type IN ('diagram', 'table') THEN block_type ELSE 'image' END
            WHEN block_type IN ('title', 'section') AND coalesce(trim(text), '') = '' THEN 'stem' ELSE block_type END AS block_type,
       CASE WHEN block_id = c.titled THEN '문항 7. renamed' ELSE display_title END AS display_title,
       coalesce(list_contains(starts, block_id), FALSE) AS force_problem_start,
       CASE WHEN list_contains(starts, block_id) THEN 'problem_start' WHEN list_contains(choices, block_id) THEN 'choice'
            WHEN list_contains(figures, block_id) THEN 'figure' END AS ai_grouping_role,
       CASE WHEN c.page_id IS NOT NULL THEN 'ai_fallback' END AS grouping_source
FROM v_blocks b LEFT JOIN (SELECT * FROM v_checked WHERE error IS NULL) c ON b.page_id = c.page_id
""")


@query("apply_repairs", """
SELECT block_id, block_type, display_title, force_problem_start, ai_grouping_role, grouping_source FROM v_repaired
""")
def _(t):
    return repaired(t).select(
        "block_id", "block_type", "display_title", "force_problem_start", "ai_grouping_role", "grouping_source"
    )


@query("id_set_operations", """
SELECT page_id, array_to_string(list_sort(list_distinct(list_intersect(starts, figures))), ',') AS both_ids,
       array_to_string(list_sort(list_distinct(list_filter(starts, lambda s: NOT list_contains(figures, s)))), ',') AS start_only
FROM v_answers
""")
def _(t):
    a, b = F.col("problem_start_block_ids"), F.col("figure_block_ids")
    return answers(t).select(
        "page_id", F.array_join(F.sort_array(F.array_intersect(a, b)), ",").alias("both_ids"),
        F.array_join(F.sort_array(F.array_except(a, b)), ",").alias("start_only"),
    )


o.cte("v_signed", """
SELECT page_id, sha1(concat_ws('|', page_id, page_width, page_height, count(*), sum(('0x' || substr(h, 1, 13))::HUGEINT),
       sum(('0x' || substr(h, 14, 13))::HUGEINT), sum(('0x' || substr(h, 27, 13))::HUGEINT))) AS page_signature
FROM (SELECT page_id, page_width, page_height, sha1(concat_ws(chr(31), pos, block_id, block_type, coalesce(text, ''),
             printf('%.4f', confidence), printf('%.1f', "left"), printf('%.1f', top), printf('%.1f', width), printf('%.1f', height),
             coalesce(fallback_reason, ''), coalesce(display_title, ''), coalesce('=' || column_index, 'none'),
             coalesce('=' || question_band_index, 'none'), '=auto',
             CASE pos % 3 WHEN 0 THEN 'none' WHEN 1 THEN '=' ELSE '=paddle' END)) AS h FROM v_blocks)
GROUP BY page_id, page_width, page_height
""")


def signed_blocks(t: Tables):
    """Blocks of one mode, with a recogniser that is missing, empty or named."""
    n = F.col("pos") % 3
    return t.block_table.withColumns({"ocr_mode": F.lit("auto"), "ocr_backend": F.when(n == 1, "").when(n == 2, "paddle")})


@query("page_signature", "SELECT * FROM v_signed")
def _(t):
    return repair.page_signature(signed_blocks(t))


@query("repair_lookup", """
SELECT page_id, sha1('{"provider":"openai","model":"model-1","trigger_reasons":["low_ocr_confidence"],"page_signature":"'
       || page_signature || '"}') AS repair_key, CAST(page_id AS BIGINT) % 3 = 0 AS cached FROM v_signed
""")
def _(t):
    """Pages with a correction cached under the same signature and reasons."""
    signed = repair.page_signature(signed_blocks(t))
    reasons = t.pages.select("page_id", F.array(F.lit("low_ocr_confidence")).alias("trigger_reasons"))
    keyed = scale.staged(repair.repair_key(reasons, signed, "openai", "model-1"))
    known = keyed.where(F.col("page_id").cast("bigint") % 3 == 0).select("repair_key", F.col("page_id").alias("payload"))
    return repair.repair_lookup(keyed, known).select("page_id", "repair_key", "cached")


@query("review_payload", """
SELECT o.page_id, CAST(0 AS BIGINT) AS part, CAST(count(*) AS INT) AS block_count, string_agg(
       '{"order": ' || (reading_order + 1) || ', "block_id": ' || to_json(o.block_id) || ', "block_type": ' || to_json(block_type)
       || ', "text": ' || to_json(substr(coalesce(text, ''), 1, 300)) || ', "confidence": ' || round_even(confidence, 3)
       || ', "bbox": {"left": ' || "left" || ', "top": ' || top || ', "width": ' || width || ', "height": ' || height || '}'
       || CASE WHEN h.ls IS NOT NULL THEN ', "ocr_lines": ' || to_json(h.ls) ELSE '' END
       || CASE WHEN coalesce(CAST(column_index AS VARCHAR), CAST(question_band_index AS VARCHAR), fallback_reason) IS NOT NULL THEN ', "meta": {' ||
          concat_ws(', ', '"column_index": ' || column_index, '"question_band_index": ' || question_band_index,
                    '"fallback_reason": ' || to_json(fallback_reason)) || '}' ELSE '' END || '}', chr(10) ORDER BY reading_order) AS payload
FROM v_ordered o LEFT JOIN (
  SELECT page_id, block_id, list(substr(trim(text), 1, 80) ORDER BY line_no) AS ls FROM v_lines WHERE line_no < 3 AND trim(text) <> '' GROUP BY ALL) h
  ON o.page_id = h.page_id AND o.block_id = h.block_id
GROUP BY o.page_id
""")
def _(t):
    return repair.review_payload(ordering.reading_order(t.block_table), t.lines)


o.cte("v_due", """
SELECT *, CASE WHEN block_type = 'image' THEN 'none' WHEN before >= 20 THEN 'skipped_limit' WHEN weak THEN 'due' ELSE 'none' END AS attempt
FROM (SELECT *, coalesce(sum(CAST(block_type <> 'image' AND weak AS INT)) OVER (PARTITION BY source ORDER BY doc_id, pos
             ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
      FROM (SELECT *, coalesce(trim(text), '') = '' OR coalesce(confidence < 0.3, FALSE) AS weak
            FROM (SELECT * EXCLUDE (text), CASE WHEN pos % 5 <> 2 THEN text END AS text FROM v_blocks)))
""")


def budgeted(t: Tables):
    rows = t.block_table.withColumn("text", F.when(F.col("pos") % 5 != 2, F.col("text")))
    return ordering.attempt_budget(rows, "source", ["doc_id", "pos"], 20, 0.3)


@query("attempt_budget", "SELECT block_id, attempt FROM v_due")
def _(t):
    return budgeted(t).select("block_id", "attempt")


def read_again(batches):
    """A stand-in reader: text from the block id, an error on some blocks, nothing on others."""
    for batch in batches:
        place = batch["pos"]
        out = batch[["page_id", "block_id"]].copy()
        out["result_text"] = ("read " + batch["block_id"]).where(place % 4 != 1, "")
        out["result_confidence"] = 0.9
        out["result_error"] = None
        out.loc[place % 6 == 2, "result_error"] = "no answer"
        out["result_lines"] = [[{"text": text, "confidence": 0.5}] for text in out["result_text"]]
        yield out


@query("enrich_blocks", f"""
SELECT block_id, ai_status, CASE WHEN ai_status = 'applied' THEN 'read ' || block_id ELSE text END AS text,
       CASE WHEN ai_status = 'applied' THEN {o.text_type("'read ' || block_id")} WHEN coalesce(text, '') = '' THEN 'image' ELSE block_type END AS block_type,
       CASE WHEN ai_status = 'applied' THEN 'ai_fallback' WHEN coalesce(text, '') = '' AND block_type <> 'image' THEN
            CASE ai_status WHEN 'failed' THEN 'ai_fallback_failed' WHEN 'skipped_limit' THEN 'ai_fallback_limit_reached' ELSE 'ai_fallback_unavailable' END
            ELSE fallback_reason END AS fallback_reason,
       CASE WHEN ai_status = 'applied' THEN 0.9 ELSE confidence END AS confidence,
       CASE WHEN attempt = 'due' THEN CASE WHEN coalesce(trim(text), '') = '' THEN 'ocr_empty' ELSE 'ocr_low_confidence' END END AS ai_reason,
       CASE WHEN attempt = 'due' AND pos % 6 = 2 THEN 'no answer' END AS ai_error,
       CASE WHEN ai_status = 'applied' THEN 'read ' || block_id END AS read_lines,
       CASE WHEN ai_status = 'applied' THEN greatest(10, height * 0.35::DOUBLE) END AS read_size
FROM (SELECT *, CASE WHEN attempt = 'skipped_limit' THEN 'skipped_limit' WHEN attempt = 'due' AND pos % 6 <> 2 AND pos % 4 <> 1 THEN 'applied'
                     WHEN attempt = 'due' AND pos % 6 = 2 THEN 'failed' WHEN attempt = 'due' THEN 'unavailable' END AS ai_status FROM v_due)
""")
def _(t):
    made = enriched(t)
    got = F.col("ai_status") == "applied"
    lines = F.when(got, F.array_join(F.transform("ocr_lines", lambda e: e["text"]), "|")).alias("read_lines")
    size = F.when(got, F.col("font_size")).alias("read_size")
    return made.select(
        "block_id", "ai_status", "text", "block_type", "fallback_reason", "confidence", "ai_reason", "ai_error", lines, size
    )


def enriched(t: Tables):
    return repair.enrich_blocks(scale.staged(budgeted(t)), read_again)


@query("enrich_totals", """
SELECT source, count(*) FILTER (attempt = 'due') AS attempt_count,
       count(*) FILTER (attempt = 'due' AND pos % 6 <> 2 AND pos % 4 <> 1) AS success_count,
       count(*) FILTER (block_type <> 'image' AND coalesce(text, '') = '' AND NOT (attempt = 'due' AND pos % 6 <> 2 AND pos % 4 <> 1)) AS image_fallback_count
FROM v_due GROUP BY source
""")
def _(t):
    return repair.enrich_totals(enriched(t), ["source"])


@query("attempts_unlimited", """
SELECT block_id, CASE WHEN block_type <> 'image' AND weak THEN 'due' ELSE 'none' END AS attempt FROM v_due
""")
def _(t):
    rows = t.block_table.withColumn("text", F.when(F.col("pos") % 5 != 2, F.col("text")))
    return ordering.attempt_budget(rows, "source", ["doc_id", "pos"], None, 0.3).select("block_id", "attempt")


# --------------------------------------------------------------- text rules
@query("text_types", f"SELECT block_id, line_no, {o.text_type('text')} AS block_type FROM v_lines")
def _(t):
    return t.lines.select("block_id", "line_no", tx.text_block_type(F.col("text")).alias("block_type"))


HINTS = "CASE pos % 8 WHEN 0 THEN 'choice' WHEN 1 THEN 'figure' WHEN 2 THEN 'stem' WHEN 3 THEN 'table' WHEN 4 THEN 'title' WHEN 5 THEN 'unknown' END"
o.cte("v_hinted", f"""
SELECT *, {HINTS} AS hint, {o.text_type("text")} AS inferred, coalesce(trim(text), '') <> '' AS written, t0 NOT IN {o.FIGURE} AS eligible
FROM (SELECT * EXCLUDE (text, block_type), CASE WHEN pos % 7 <> 3 THEN text END AS text,
             CASE WHEN block_type = 'image' AND pos % 2 = 0 THEN 'image' WHEN pos % 3 = 0 THEN 'note' ELSE 'stem' END AS t0 FROM v_blocks)
""")


@query("resolve_block_types", """
SELECT block_id, CASE WHEN NOT eligible THEN t0 WHEN written AND hint = 'choice' THEN 'choice' WHEN written AND hint = 'figure' THEN 'image'
       WHEN written AND hint = 'title' THEN 'title' WHEN written THEN CASE WHEN inferred <> 'stem' OR t0 = 'stem' THEN inferred ELSE t0 END
       WHEN hint = 'figure' OR t0 = 'stem' THEN 'image' ELSE t0 END AS block_type,
       CASE WHEN eligible AND NOT written AND hint = 'figure' THEN 'claude_figure_hint'
            WHEN eligible AND NOT written AND t0 = 'stem' THEN 'noop_ocr' ELSE fallback_reason END AS fallback_reason,
       CASE WHEN eligible AND written AND hint IN ('choice', 'figure', 'title') THEN 'claude_hint' END AS block_type_source
FROM v_hinted
""")
def _(t):
    n = F.col("pos")
    names = {0: "choice", 1: "figure", 2: "stem", 3: "table", 4: "title", 5: "unknown"}
    rows = t.blocks.withColumns(
        {
            "text": F.when(n % 7 != 3, F.col("text")),
            "block_type": F.when((F.col("block_type") == "image") & (n % 2 == 0), "image").when(n % 3 == 0, "note").otherwise("stem"),
            "type_hint": F.coalesce(*[F.when(n % 8 == k, v) for k, v in names.items()]),
        }
    )
    made = repair.resolve_block_types(rows, "noop")
    return made.select("block_id", "block_type", "fallback_reason", "block_type_source")


@query("plain_block_types", f"""
SELECT block_id, CASE WHEN block_type = 'image' THEN 'image' WHEN coalesce(trim(text), '') <> '' THEN {o.text_type("text")} ELSE 'image' END AS block_type
FROM v_blocks
""")
def _(t):
    return repair.plain_block_types(t.blocks).select("block_id", "block_type")


@query("normalize_text", """
SELECT doc_id, array_to_string(list_filter(list_transform(string_split(replace(text, chr(13), chr(10)), chr(10)), lambda s: trim(s)), lambda s: s <> ''), chr(10)) AS text
FROM (SELECT doc_id, replace(text, '. ', '.' || chr(13) || ' ') AS text FROM documents)
""")
def _(t):
    raw = F.replace(F.col("text"), F.lit(". "), F.lit(".\r "))
    return t.table("documents").select("doc_id", tx.normalize_text(raw).alias("text"))


@query("normalize_titles", f"""
SELECT block_id, CASE WHEN raw <> '' AND NOT contains(lower(raw), 'problem') AND NOT regexp_matches(raw, '{o.GENERIC_TITLE}') THEN raw
       WHEN pos % 3 = 0 THEN '문항 ' || (pos + 1) ELSE printf('문항 %02d', pos + 1) || ' · ' || page_id END AS title
FROM (SELECT block_id, pos, page_id, trim(coalesce(CASE pos % 4 WHEN 0 THEN '문항 ' || pos WHEN 1 THEN page_id || ' Problem 3' WHEN 2 THEN '문항 4 · ' || page_id ELSE line END, '')) AS raw FROM v_blocks)
""")
def _(t):
    n = F.col("pos")
    raw = (
        F.when(n % 4 == 0, F.concat(F.lit("문항 "), n.cast("string")))
        .when(n % 4 == 1, F.concat("page_id", F.lit(" Problem 3")))
        .when(n % 4 == 2, F.concat(F.lit("문항 4 · "), F.col("page_id")))
        .otherwise(F.col("line"))
    )
    made = tx.normalize_title(raw, n, F.col("page_id"), F.when(n % 3 == 0, n + 1))
    return t.blocks.select("block_id", made.alias("title"))


@query("resolve_enums", """
SELECT o_orderkey, CASE WHEN w IN ('1-urgent', '5-low') THEN w ELSE 'unknown' END AS level,
       CASE WHEN lower(o_orderstatus) IN ('o', 'f') THEN lower(o_orderstatus) ELSE 'none' END AS state
FROM (SELECT *, trim(lower(' ' || o_orderpriority || ' ')) AS w FROM orders)
""")
def _(t):
    padded = F.concat(F.lit(" "), F.col("o_orderpriority"), F.lit(" "))
    return t.table("orders").select(
        "o_orderkey", tx.resolve_enum(padded, ["1-urgent", "5-low"], "unknown").alias("level"),
        tx.resolve_enum(F.col("o_orderstatus"), ["o", "f"], "none", trim=False).alias("state"),
    )


@query("slugs", "SELECT page_id, regexp_replace(trim(url), '[^\\p{L}\\p{N}._-]', '_', 'g') AS slug FROM pages")
def _(t):
    return t.table("pages").select("page_id", tx.slug(F.col("url")).alias("slug"))


@query("redact_settings", """
SELECT p_partkey, '<redacted>' AS api_key, p_name AS name, '<redacted>' AS tokens, p_brand AS brand FROM part
""")
def _(t):
    settings = F.create_map(
        F.lit("apiKey"), F.col("p_type"), F.lit("name"), F.col("p_name"), F.lit("max_Tokens"), F.col("p_size").cast("string"),
        F.lit("brand"), F.col("p_brand"),
    )
    made = t.table("part").select("p_partkey", tx.redact_settings(settings).alias("m"))
    return made.select(
        "p_partkey", F.col("m.apiKey").alias("api_key"), F.col("m.name").alias("name"),
        F.col("m.max_Tokens").alias("tokens"), F.col("m.brand").alias("brand"),
    )


@query("coerce_values", """
SELECT event_id, CASE WHEN event_id % 4 = 0 THEN TRUE WHEN event_id % 4 = 1 THEN FALSE ELSE TRUE END AS flag,
       CASE WHEN event_id % 3 <> 0 THEN CAST(user_id AS DOUBLE) END AS whole, CASE WHEN event_id % 3 <> 1 THEN value END AS number,
       CAST(CASE WHEN event_id % 5 = 0 THEN 0 WHEN event_id % 5 = 1 THEN 7 ELSE value END AS DOUBLE) AS finite
FROM events
""")
def _(t):
    n = F.col("event_id")
    value = F.col("value").cast("string")
    return t.table("events").select(
        "event_id",
        to_bool(F.when(n % 4 == 0, " Yes").when(n % 4 == 1, "OFF").when(n % 4 == 2, "maybe"), True).alias("flag"),
        to_optional_int(F.when(n % 3 == 0, "").otherwise(F.col("user_id").cast("string"))).cast("double").alias("whole"),
        to_optional_float(F.when(n % 3 != 1, value)).alias("number"),
        to_number(F.when(n % 5 == 0, " ").when(n % 5 == 1, "many").otherwise(value), 7).alias("finite"),
    )


@query("normalize_paths", """
SELECT page_id, CASE page_id % 4 WHEN 0 THEN url WHEN 1 THEN 'file:///C:/x/' || page_id || '.png' WHEN 2 THEN 'a/b/' || page_id ELSE '' END AS path
FROM pages
""")
def _(t):
    n = F.col("page_id")
    raw = (
        F.when(n % 4 == 0, F.col("url")).when(n % 4 == 1, F.concat(F.lit("C:\\x\\"), n.cast("string"), F.lit(".png")))
        .when(n % 4 == 2, F.concat(F.lit("a\\b/"), n.cast("string")))
    )
    return t.table("pages").select("page_id", tx.normalize_path(raw).alias("path"))
