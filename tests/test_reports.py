from foliospark.operators import records, session
from foliospark.sources import sessions


def test_request_fields_of_bad_and_mixed_payloads(spark):
    rows = [
        (1, None), (2, "no json"), (3, "[1]"), (4, '{"aiFallback": 5, "ai_fallback": {"model": "m", "maxTokens": 7}}'),
        (5, '{"model": "top", "aiFallback": {"model": "m", "temperature": "0.5"}, "ai_fallback": {"temperature": 1}}'),
        (6, '{"model": null, "aiFallback": {"ai_fallback_model": "deep"}, "failOnAiError": true, "max_tokens": ""}'),
    ]
    made = sessions.request_options(spark.createDataFrame(rows, "id int, payload string"))
    found = {r.id: r.options for r in made.collect()}
    for i in (1, 2, 3):
        assert (found[i].model, found[i].provider, found[i].enabled, found[i].max_tokens) == ("", "openai", False, None)
    assert (found[4].model, found[4].max_tokens) == ("m", 7)
    assert (found[5].model, found[5].temperature) == ("top", 0.5)
    assert (found[6].model, found[6].fail_on_error, found[6].max_tokens) == ("deep", True, None)
    assert made.columns == ["id", "payload", "options"]


def test_problem_without_blocks_is_a_picture(spark):
    placed = spark.createDataFrame([("u1", "b1", "text", 0.1, 0.2, 0.3, 0.4)], "unit_id string, block_id string, record_mode string, x double, y double, w double, h double")
    units = spark.createDataFrame([("u1", 0.0, 1.0), ("u2", 1.2, 0.5), (None, 2.4, 0.5)], "unit_id string, start_y double, content_height double")
    found = sorted(map(tuple, records.board_records(placed, units).collect()), key=str)
    assert [(r[0], r[1], r[2]) for r in found] == [("u1", "b1", "text"), ("u2", None, "image"), (None, None, "image")]
    assert records.board_records(placed.limit(0), units).count() == 3


def test_cache_counts_of_keys_without_blocks_are_zero(spark):
    pages = spark.createDataFrame(
        [(1, None, "r", "t", True, True, False, False, False), (2, "ok", None, None, False, False, True, True, True)],
        "batch int, status string, route string, tier string, has_route boolean, has_profile boolean, attempted boolean, applied boolean, cache_hit boolean",
    )
    blocks = spark.createDataFrame([(1, True, None), (1, False, True), (1, True, False)], "batch int, ocr_cache_hit boolean, ocr_cache_miss boolean")
    found = {r.batch: (r.ocr_cache_hit_count, r.ocr_cache_miss_count) for r in session.repair_usage(pages, ["batch"], blocks).collect()}
    assert found == {1: (2, 1), 2: (0, 0)}
