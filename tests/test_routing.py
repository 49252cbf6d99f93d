"""Risk, routes, corrections, enrichment and caches."""

import json

import pytest
from pyspark.sql import functions as F

from foliospark.operators import cache, ordering, repair, routing

DIAG = (
    "page_id string, block_count int, large_block_ratio double, max_block_area_ratio double, document_split_applied boolean, "
    "candidate_count int, fallback_reasons array<string>, empty_text_ratio double, low_confidence_ratio double, avg_confidence double, "
    "problem_count int, problem_marker_count int, marker_conflict_count int, fallback_problem_count int, full_page_image boolean"
)


def test_saved_run(spark):
    """Six image blocks, recogniser off, one problem per block."""
    df = spark.createDataFrame([("p", 6, 0.0, 0.0, False, 0, [], 0.0, 0.0, None, 6, 0, 0, 6, False)], DIAG)
    r = routing.decide_route(routing.page_risk(df, "noop"), False, "auto").first()
    assert (r.segmentation_risk, r.ocr_risk, r.grouping_risk, r.overall_risk, r.tier) == (0.0, 0.34, 1.0, 1.0, "red")
    assert r.reasons == ["ocr_disabled", "no_problem_markers", "fallback_grouping", "problem_per_block"]
    assert (r.route, r.next_best_action, r.should_patch) == ("local_only", None, False)


@pytest.mark.parametrize(
    ("risk", "enabled", "mode", "route", "action"),
    [("red", True, "auto", "ai_patch", None), ("yellow", True, "auto", "local_only", "local_retry"), ("green", True, " FORCE", "ai_patch", None),
     ("green", False, "force", "local_only", None), ("yellow", True, "force", "ai_patch", None)],
)
def test_routes(spark, risk, enabled, mode, route, action):
    df = spark.createDataFrame([(risk, ["a"])], "tier string, reasons array<string>")
    r = routing.decide_route(df, enabled, mode).first()
    assert (r.route, r.next_best_action) == (route, action)
    assert r.trigger_reasons == (["forced", "a"] if mode.strip().lower() == "force" and enabled else ["a"])


STATUS = (
    "enabled boolean, should_patch boolean, next_best_action string, block_count int, provider string, cached_valid boolean, "
    "has_key boolean, call_error string, response_error string"
)


@pytest.mark.parametrize(
    ("facts", "status"),
    [
        ((False, True, None, 1, "openai", True, True, None, None), "disabled"), ((True, False, None, 1, "openai", True, True, None, None), "not_needed"),
        ((True, False, "local_retry", 1, "openai", True, True, None, None), "local_retry_recommended"),
        ((True, True, None, 19, "openai", True, True, None, None), "too_many_blocks"), ((True, True, None, 18, "x", True, True, None, None), "provider_pending"),
        ((True, True, None, 1, " Claude ", True, True, None, None), "cache_hit"), ((True, True, None, 1, "openai", None, False, None, None), "missing_api_key"),
        ((True, True, None, 1, "openai", False, True, "t", None), "error"), ((True, True, None, 1, "openai", False, True, None, "b"), "invalid_response"),
        ((True, True, None, 1, "openai", False, True, None, None), "applied"),
    ],
)
def test_status(spark, facts, status):
    assert routing.repair_status(spark.createDataFrame([facts], STATUS)).first().status == status


@pytest.fixture(scope="module")
def blocks(spark):
    rows = [("p", i, f"b{i}", k, t, i) for i, (k, t) in enumerate([("stem", "x"), ("image", None), ("title", None), ("table", None), ("stem", "y")])]
    return spark.createDataFrame(rows, "page_id string, pos int, block_id string, block_type string, text string, reading_order int").withColumns(
        {"display_title": F.lit(None).cast("string"), "force_problem_start": F.lit(True)}
    )


def answer(spark, page="p", **lists):
    names = {"starts": "problem_start_block_ids", "choices": "choice_block_ids", "figures": "figure_block_ids", "titles": "display_titles"}
    df = spark.createDataFrame([(page, json.dumps({names[k]: v for k, v in lists.items()}))], "page_id string, payload string")
    return repair.parse_repairs(df).withColumn("trigger_reasons", F.array(F.lit("r")))


@pytest.mark.parametrize(
    ("lists", "error"),
    [
        ({"choices": ["b1"]}, "problem_start_block_ids must include at least one block"),
        ({"starts": ["z", "b0"], "figures": ["a"]}, "unknown block ids returned: ['a', 'z']"),
        ({"starts": ["b0"], "choices": ["b0"]}, "problem start and choice block ids overlap"),
        ({"starts": ["b0", "b0"]}, "problem_start_block_ids must be unique"),
        ({"starts": ["b4", "b0"]}, "problem_start_block_ids must be in reading order"), ({"starts": ["b0", "b4"], "choices": ["b1"]}, None),
    ],
)
def test_validation(spark, blocks, lists, error):
    r = repair.validate_repairs(answer(spark, **lists), blocks).first()
    assert (r.error, r.ok) == (error, error is None)


@pytest.mark.parametrize("rows", [None, 2])
def test_apply(spark, blocks, rows):
    titles = [{"block_id": "b0", "title": "one"}, {"block_id": "b0", "title": " two "}, {"block_id": "b4", "title": " "}]
    good = answer(spark, starts=["b0", "b1"], choices=["b1", "b4"], figures=["b4", "b3"], titles=titles)
    other = blocks.withColumn("page_id", F.lit("q"))
    got = {(r.page_id, r.block_id): r for r in repair.apply_repairs(blocks.unionByName(other), good, rows=rows).collect()}
    assert [got["p", f"b{i}"].block_type for i in range(5)] == ["title", "image", "stem", "table", "choice"]
    assert [got["p", f"b{i}"].force_problem_start for i in range(5)] == [True, True, False, False, False]
    assert [got["q", f"b{i}"].block_type for i in range(5)] == ["stem", "image", "title", "table", "stem"]
    assert got["q", "b2"].force_problem_start and got["p", "b0"].display_title == "two" and got["p", "b4"].display_title is None


def test_budget_and_enrichment(spark):
    rows = [("r", i, "p", f"b{i}", "image" if i == 1 else "stem", None if i % 2 == 0 else "words", 0.9) for i in range(8)]
    df = spark.createDataFrame(rows, "run string, pos int, page_id string, block_id string, block_type string, text string, confidence double")
    df = df.withColumn("fallback_reason", F.lit(None).cast("string"))
    for size in (None, 3):
        due = ordering.attempt_budget(df, "run", ["pos"], 3, 0.5, rows=size)
        got = [r.attempt for r in due.orderBy("pos").collect()]
        assert got == ["due", "none", "due", "none", "due", "skipped_limit", "skipped_limit", "skipped_limit"]

    def reader(batches):
        for b in batches:
            b = b[["page_id", "block_id"]].copy()
            b["result_text"] = ["1) q" if i == "b0" else "" for i in b["block_id"]]
            b["result_confidence"] = 0.5
            b["result_error"] = [None if i != "b4" else "x" for i in b["block_id"]]
            b["result_lines"] = None
            yield b

    got = {r.block_id: r for r in repair.enrich_blocks(due, reader).collect()}
    assert [got[f"b{i}"].ai_status for i in (0, 2, 4, 5, 6)] == ["applied", "unavailable", "failed", "skipped_limit", "skipped_limit"]
    assert [got[f"b{i}"].fallback_reason for i in (0, 2, 4, 5, 6)] == [
        "ai_fallback", "ai_fallback_unavailable", "ai_fallback_failed", None, "ai_fallback_limit_reached"
    ]
    assert (got["b0"].block_type, got["b0"].text, got["b0"].confidence) == ("choice", "1) q", 0.5)
    off = {r.block_id: r for r in repair.enrich_blocks(due, None, requested=False).collect()}
    assert off["b0"].fallback_reason == "ocr_empty" and off["b0"].block_type == "image" and off["b3"].block_type == "stem"
    named = {r.block_id: r.ai_status for r in repair.enrich_blocks(due, None, named_model=True).collect()}
    assert named["b0"] == "requested"


def test_signature_follows_content_not_partitioning(spark):
    rows = [("p", 100, 100, i, f"b{i}", "stem", f"t{i}", 0.5, 1.0, 2.0, 3.0, 4.0, None, None) for i in range(20)]
    names = (
        "page_id string, page_width int, page_height int, pos int, block_id string, block_type string, text string, confidence double, "
        "left double, top double, width double, height double, fallback_reason string, display_title string"
    )
    df = spark.createDataFrame(rows, names)
    one = repair.page_signature(df.coalesce(1)).first().page_signature
    assert repair.page_signature(df.repartition(7)).first().page_signature == one
    moved = df.withColumn("pos", F.when(F.col("pos") == 0, 1).when(F.col("pos") == 1, 0).otherwise(F.col("pos")))
    assert repair.page_signature(moved).first().page_signature != one


def test_review_payload_is_json(spark):
    blocks = spark.createDataFrame(
        [("p", 0, "b0", "stem", 'say "x"\n' + "y" * 400, None, 0.25, 1.0, 2.0, 3.0, 1), ("p", 1, "b1", "image", None, 0.12345, 0.0, 0.0, 1.0, 1.0, None)],
        "page_id string, reading_order int, block_id string, block_type string, text string, confidence double, left double, top double, width double, height double, column_index int",
    )
    lines = spark.createDataFrame([("p", "b0", i, t) for i, t in enumerate(["  a ", " ", "c" * 99, "d"])], "page_id string, block_id string, line_no int, text string")
    rows = repair.review_payload(blocks, lines).collect()
    first, second = (json.loads(s) for s in rows[0].payload.split("\n"))
    assert first["order"] == 1 and len(first["text"]) == 300 and first["confidence"] is None and first["meta"] == {"column_index": 1}
    assert first["ocr_lines"] == ["a", "c" * 80] and first["bbox"]["left"] == 0.2
    assert second["confidence"] == 0.123 and "ocr_lines" not in second and "meta" not in second and second["text"] == ""
    parts = repair.review_payload(blocks, lines, part_items=1).collect()
    assert len(parts) == 2 and sum(r.block_count for r in parts) == 2


def test_cache_round(spark):
    df = spark.createDataFrame([(i, f"t{i % 4}") for i in range(40)], "n int, text string")
    keyed = cache.with_cache_key(df, F.col("text"), F.lit(" a b "))
    assert keyed.first().backend == "a_b"
    empty = keyed.select("cache_key", "backend", F.lit(0).alias("payload")).where("false")
    filled = cache.cache_fill(keyed.select("cache_key", "backend", F.col("n").alias("pick"), F.col("n").alias("payload")), empty)
    assert sorted(r.payload for r in filled.collect()) == [0, 1, 2, 3]
    some = filled.where("payload < 2")
    for size in (None, 3):
        got = cache.cache_lookup(keyed, some, spread_by=F.col("n"), rows=size).collect()
        assert len(got) == 40 and all(r.cache_hit == (r.n % 4 < 2) and r.cache_miss != r.cache_hit for r in got)
    again = cache.cache_fill(keyed.select("cache_key", "backend", F.col("n").alias("pick"), F.col("n").alias("payload")), filled)
    assert again.count() == 0
