"""How risky each page's extraction is, and what to do about it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.functions.numbers import clamp, share
from foliospark.settings import FIGURE_TYPES, LARGE_BLOCK_RATIO, LOW_CONFIDENCE, MAX_REPAIR_BLOCKS, REPAIR_PROVIDERS


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


def _exact_mean(value: Column) -> Column:
    """Mean free of the noise that the order of addition leaves, as thresholds are compared with it."""
    return F.bround(F.sum(value.cast("decimal(18,9)")).cast("double") / F.count(value), 12)


def _is_figure() -> Column:
    return F.col("block_type").isin(*FIGURE_TYPES)


def _blank(blocks: DataFrame) -> Column:
    """Whether a block has no text; taken from its tag if it has been tagged."""
    return F.col("is_blank") if "is_blank" in blocks.columns else ~tx.is_filled(F.col("text"))


def page_reasons(blocks: DataFrame) -> DataFrame:
    """Distinct fallback reasons of each page in order of first use.

    Reduced to one row per page and reason before anything is folded.
    """
    reason = tx.strip(F.col("fallback_reason"))
    first = (
        blocks.select("page_id", "pos", reason.alias("reason"))
        .where("reason <> ''")
        .groupBy("page_id", "reason")
        .agg(F.min("pos").alias("_at"))
    )
    folded = F.sort_array(F.collect_list(F.struct("_at", "reason")))
    return first.groupBy("page_id").agg(F.transform(folded, lambda e: e["reason"]).alias("fallback_reasons"))


def segmentation_stats(blocks: DataFrame, pages: DataFrame, threshold: float = LARGE_BLOCK_RATIO) -> DataFrame:
    """Block counts, sizes and fallback reasons of every page, also of empty ones (A1)."""
    area = F.greatest(F.col("page_width").cast("double") * F.col("page_height"), F.lit(1.0))
    ratio = F.col("width") * F.col("height") / area
    large = _count_if(ratio >= threshold)
    stats = blocks.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("block_count"),
        _count_if(~_blank(blocks)).alias("text_block_count"),
        _count_if(_is_figure()).alias("image_block_count"),
        large.alias("large_block_count"),
        F.bround(large / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("large_block_ratio"),
        F.bround(F.max(ratio), 6).alias("max_block_area_ratio"),
        F.bround(F.sum(ratio) / F.greatest(F.count(F.lit(1)), F.lit(1)), 6).alias("mean_block_area_ratio"),
    )
    joined = pages.select("page_id").join(stats, "page_id", "left").join(page_reasons(blocks), "page_id", "left")
    counts = ["block_count", "text_block_count", "image_block_count", "large_block_count"]
    ratios = ["large_block_ratio", "max_block_area_ratio", "mean_block_area_ratio"]
    none = F.array().cast("array<string>")
    return joined.fillna(0, counts).fillna(0.0, ratios).withColumns(
        {
            "fallback_reasons": F.coalesce("fallback_reasons", none),
            "fallback_reason": F.try_element_at("fallback_reasons", F.lit(1)),
            "fallback_reason_count": F.coalesce(F.size("fallback_reasons"), F.lit(0)),
        }
    ).withColumn("fallback_reason_count", F.greatest(F.col("fallback_reason_count"), F.lit(0)))


def ocr_diagnostics(blocks: DataFrame) -> DataFrame:
    """What recognition gave per page, over blocks that are not figures (A2).

    Uses the columns ocr_line_count, ocr_lines, ocr_backend, ocr_cache_hit,
    ocr_cache_miss and ocr_latency_ms where present. A block without a line
    count has as many lines as it holds.
    """
    names = blocks.columns
    has = lambda n, d: F.col(n) if n in names else F.lit(None).cast(d)
    written = ~_is_figure()
    blank = _blank(blocks)
    weak = F.col("confidence").isNull() | (F.col("confidence") < LOW_CONFIDENCE) | blank
    flagged = blocks.withColumns(
        {
            "_written": written, "_blank": written & blank, "_weak": written & weak,
            "_conf": F.when(written, F.col("confidence")),
            "_backend": F.coalesce(F.when(has("ocr_backend", "string") != "", has("ocr_backend", "string")), F.lit("none")),
        }
    )
    n = _count_if(F.col("_written"))
    own = F.when(F.col("ocr_lines").isNotNull(), F.size("ocr_lines")) if "ocr_lines" in names else F.lit(None).cast("int")
    line_count = F.coalesce(has("ocr_line_count", "int"), own)
    stats = flagged.groupBy("page_id").agg(
        n.alias("text_block_count"), _count_if(F.col("_blank")).alias("empty_text_block_count"),
        share(_count_if(F.col("_blank")), n).alias("empty_text_ratio"),
        _count_if(F.col("_weak")).alias("low_confidence_block_count"),
        share(_count_if(F.col("_weak")), n).alias("low_confidence_ratio"), _exact_mean(F.col("_conf")).alias("avg_confidence"),
        F.coalesce(F.sum(line_count), F.lit(0)).alias("recognized_line_count"),
        _count_if(has("ocr_cache_hit", "boolean")).alias("ocr_cache_hit_count"),
        _count_if(has("ocr_cache_miss", "boolean")).alias("ocr_cache_miss_count"),
        F.avg(has("ocr_latency_ms", "double")).alias("latency_ms_avg"),
    )
    backends = flagged.groupBy("page_id", "_backend").agg(F.count(F.lit(1)).alias("_n"))
    backends = backends.groupBy("page_id").agg(
        F.map_from_entries(F.sort_array(F.collect_list(F.struct("_backend", "_n")))).alias("backend_counts")
    )
    return stats.join(backends, "page_id")


def full_page_images(blocks: DataFrame) -> DataFrame:
    """Whether a page is one figure that covers at least three quarters of it."""
    page_area = F.col("page_width").cast("double") * F.col("page_height")
    covers = _is_figure() & (F.col("width") * F.col("height") >= page_area * 0.75)
    return blocks.groupBy("page_id").agg(((F.count(F.lit(1)) == 1) & F.max(covers)).alias("full_page_image"))


def _score(*terms: tuple[Column, float]) -> Column:
    total = F.lit(0.0)
    for condition, weight in terms:
        total = total + F.when(condition, weight).otherwise(0.0)
    return F.bround(clamp(total, 0.0, 1.0), 4)


def page_risk(diagnostics: DataFrame, ocr_mode: Column | str) -> DataFrame:
    """Segmentation, recognition, grouping and overall risk, tier and reasons.

    ``diagnostics`` has one row per page with block_count, large_block_ratio,
    max_block_area_ratio, document_split_applied, candidate_count,
    fallback_reasons, empty_text_ratio, low_confidence_ratio, avg_confidence,
    problem_count, problem_marker_count, marker_conflict_count,
    fallback_problem_count and full_page_image.
    """
    mode = F.lower(tx.strip(F.lit(ocr_mode) if isinstance(ocr_mode, str) else ocr_mode))
    c = F.col
    no = F.lit(False)
    reasons = F.coalesce("fallback_reasons", F.array().cast("array<string>"))
    sparse = c("block_count") <= 1
    dominant = F.coalesce((c("large_block_ratio") >= 0.5) | (c("max_block_area_ratio") >= 0.72), no)
    disabled = F.coalesce(mode.isin("none", "noop"), no)
    textless = F.coalesce(c("empty_text_ratio") >= 0.5, no)
    weak = F.coalesce(c("low_confidence_ratio") >= 0.5, no)
    low_mean = F.coalesce(c("avg_confidence") < 0.55, no)
    many = c("block_count") > 1
    unmarked = many & (F.coalesce("problem_marker_count", F.lit(0)) == 0)
    conflicts = F.coalesce(c("marker_conflict_count") > 0, no)
    fallback = F.coalesce(c("fallback_problem_count") > 0, no)
    each = many & (c("problem_count") == c("block_count"))
    image = F.coalesce("full_page_image", no)

    # The weight of each finding.
    scored = diagnostics.withColumns(
        {
            "segmentation_risk": _score(
                (sparse, 0.48), (dominant, 0.4), (F.coalesce("document_split_applied", no), 0.12),
                (c("candidate_count") == 1, 0.18), (F.size(reasons) > 0, 0.5),
            ),
            "ocr_risk": _score((disabled, 0.34), (textless, 0.4), (weak, 0.45), (low_mean, 0.3)),
            "grouping_risk": _score((unmarked, 0.45), (conflicts, 0.48), (fallback, 0.52), (each, 0.42), (image, 0.6)),
            "reasons": F.array_distinct(
                F.concat(
                    F.array_compact(F.array(
                        F.when(sparse, "sparse_segmentation"), F.when(dominant, "large_block_dominance"),
                    )),
                    reasons,
                    F.array_compact(F.array(
                        F.when(disabled, "ocr_disabled"), F.when(textless, "textless_blocks"),
                        F.when(weak, "low_ocr_confidence"), F.when(low_mean, "low_avg_confidence"),
                        F.when(unmarked, "no_problem_markers"), F.when(conflicts, "marker_conflicts"),
                        F.when(fallback, "fallback_grouping"), F.when(each, "problem_per_block"),
                        F.when(image, "full_page_image"),
                    )),
                )
            ),
        }
    )
    scored = scored.withColumn("overall_risk", F.greatest("segmentation_risk", "ocr_risk", "grouping_risk"))
    return scored.withColumn("tier", risk_tier(F.col("overall_risk")))


def risk_tier(risk: Column) -> Column:
    return F.when(risk >= 0.66, "red").when(risk >= 0.33, "yellow").otherwise("green")


def decide_route(risk: DataFrame, enabled: Column | bool, mode: Column | str) -> DataFrame:
    """Patch or stay local, next action and trigger reasons."""
    enabled = F.lit(enabled) if isinstance(enabled, bool) else F.coalesce(enabled, F.lit(False))
    mode = F.lower(tx.strip(F.lit(mode) if isinstance(mode, str) else F.coalesce(mode, F.lit(""))))
    forced = (mode == "force") & enabled
    patch = forced | (enabled & (F.col("tier") == "red"))
    return risk.withColumns(
        {
            "should_patch": patch,
            "route": F.when(patch, "ai_patch").otherwise("local_only"),
            "next_best_action": F.when(~patch & (F.col("tier") == "yellow"), "local_retry"),
            "trigger_reasons": F.when(
                forced, F.array_distinct(F.concat(F.array(F.lit("forced")), F.col("reasons")))
            ).otherwise(F.col("reasons")),
        }
    )


def repair_status(routes: DataFrame, *, max_blocks: int = MAX_REPAIR_BLOCKS) -> DataFrame:
    """Outcome of the correction step per page, first gate that applies.

    ``routes`` has enabled, should_patch, next_best_action, block_count,
    provider, cached_valid (a cached correction that validates), has_key,
    call_error and response_error.
    """
    c = F.col
    no = F.lit(False)
    known = F.coalesce(F.lower(tx.strip(c("provider"))).isin(*REPAIR_PROVIDERS), no)
    too_many = (c("block_count") > max_blocks) if max_blocks > 0 else no
    cached = F.coalesce(c("cached_valid"), no)
    status = (
        F.when(~c("enabled"), "disabled")
        .when(~c("should_patch") & (c("next_best_action") == "local_retry"), "local_retry_recommended")
        .when(~c("should_patch"), "not_needed")
        .when(too_many, "too_many_blocks")
        .when(~known, "provider_pending")
        .when(cached, "cache_hit")
        .when(~F.coalesce(c("has_key"), no), "missing_api_key")
        .when(c("call_error").isNotNull(), "error")
        .when(c("response_error").isNotNull(), "invalid_response")
        .otherwise("applied")
    )
    made = routes.withColumn("status", status)
    return made.withColumns(
        {
            "attempted": c("status").isin("error", "invalid_response", "applied"),
            "applied": c("status").isin("cache_hit", "applied"),
            "cache_hit": c("status") == "cache_hit",
        }
    )


def repair_reasons(tagged: DataFrame, ocr_mode: str, *, forced: bool = False) -> DataFrame:
    """The other list of reasons to correct a page.

    ``tagged`` has grouped blocks with their tags. A page of one block has no
    reason but a forced one.
    """
    written = ~_is_figure()
    weak = written & (F.col("is_blank") | F.col("confidence").isNull() | (F.col("confidence") < LOW_CONFIDENCE))
    flagged = tagged.withColumns({"_written": written, "_weak": weak, "_overlap": F.col("overlap_marker")})
    facts = flagged.groupBy("page_id").agg(
        F.count(F.lit(1)).alias("_n"), F.max("problem_index").alias("_problems"), F.max("is_start").alias("_starts"),
        F.max("fallback_grouping").alias("_fallback"), _count_if(F.col("_written")).alias("_writ"),
        _count_if(F.col("_weak")).alias("_low"), F.max("_overlap").alias("_over"),
    )
    many = F.col("_n") > 1
    disabled = F.lit(ocr_mode.strip().lower() in ("none", "noop"))
    return facts.select(
        "page_id",
        F.array_compact(
            F.array(
                F.when(F.lit(forced), "forced"),
                F.when(many & disabled, "ocr_disabled"),
                F.when(many & ~F.col("_starts"), "no_problem_markers"),
                F.when(many & F.col("_fallback"), "fallback_grouping"),
                F.when(many & (F.col("_problems") == F.col("_n")), "problem_per_block"),
                F.when(many & (F.col("_writ") > 0) & (F.col("_low") / F.col("_writ") >= 0.5), "low_confidence"),
                F.when(many & F.col("_over"), "choice_problem_marker_overlap"),
            )
        ).alias("reasons"),
    )
