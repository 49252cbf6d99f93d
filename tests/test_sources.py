"""Files in and out, batch and stream."""

import json
import shutil

import pytest
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.operators import flatten, grouping, ordering, placement
from foliospark.settings import Template
from foliospark.sources import pages as files
from foliospark.sources import sessions
from foliospark.streaming import ingest


def page(page_id, texts, **extra):
    blocks = [
        {
            "block_id": f"{page_id}-block-{i + 1:03d}", "block_type": "stem", "bbox": {"left": 1, "top": i * 10.0, "width": 5, "height": 5},
            "reading_order": i, "text": t, "confidence": None, "ocr_lines": [{"text": t, "bbox": {"left": 0, "top": 0, "width": 1, "height": 1}}],
            "metadata": {"column_index": 1, "later_key": {"x": 1}},
        }
        for i, t in enumerate(texts)
    ]
    return {"page_id": page_id, "width_px": 100, "height_px": 200, "subject": "math", "blocks": blocks, "problems": [], **extra}


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps([page("p1", ["1. a", "b"]), page("p2", [])], indent=2))
    (tmp_path / "in" / "b.json").write_text(json.dumps([page("p3", ["2) c"], unknown=3, metadata={"block_count": 1})]))
    return tmp_path


def test_read_and_flatten(spark, folder):
    pages = files.read_pages(spark, str(folder / "in"))
    assert pages.count() == 3 and pages.where("file_path like '%b.json'").first().metadata.block_count == 1
    blocks = flatten.explode_blocks(pages)
    assert [(r.page_id, r.pos, r.text, r.column_index) for r in blocks.orderBy("page_id", "pos").collect()] == [
        ("p1", 0, "1. a", 1), ("p1", 1, "b", 1), ("p3", 0, "2) c", 1)
    ]
    assert flatten.explode_lines(blocks).count() == 3


@pytest.mark.parametrize("part", [None, 1])
def test_round_trip(spark, folder, part):
    blocks = flatten.explode_blocks(files.read_pages(spark, str(folder / "in")))
    ordered = ordering.reading_order(blocks)
    grouped = grouping.group_problems(grouping.tag_blocks(ordered))
    out = str(folder / f"out{part}")
    files.nest_pages(ordered, grouped, part).write.json(out)
    back = files.read_page_lines(spark, out)
    again = flatten.explode_blocks(back)
    keep = ["page_id", "block_id", "text", "reading_order", "left", "column_index"]
    assert sorted(map(tuple, again.select(keep).collect())) == sorted(map(tuple, ordered.select(keep).collect()))
    units = flatten.explode_problems(back)
    assert sorted(r.unit_id for r in units.collect()) == ["p1-problem-1"] * (2 if part else 1) + ["p3-problem-1"]
    members = flatten.problem_members(units.where("page_id = 'p1'"), again)
    assert sorted(r.block_id for r in members.collect()) == ["p1-block-001", "p1-block-002"]


def test_nothing_is_lost_on_the_way(spark, tmp_path):
    """Every field of a page, also of one without blocks, is the same after flattening, nesting, writing and reading."""
    box = {"left": 1.0, "top": 2.0, "width": 3.0, "height": 4.0}
    block = {
        "block_id": "b0", "block_type": "stem", "bbox": box, "reading_order": 0, "text": "1. a", "confidence": 0.5, "labels": ["x"],
        "style": {"font_size": 11.0, "weight": "bold", "italic": True, "color": "#000", "align": "left", "math_like": False},
        "asset": {"asset_id": "a", "asset_type": "crop", "source_path": "s.png", "crop_box": box, "width_px": 3, "height_px": 4, "mime_type": "image/png"},
        "ocr_lines": [{"text": "1. a", "confidence": 0.5, "bbox": box}], "children": ["c"],
        "metadata": {"column_index": 1, "ocr_backend": "t", "fill_ratio": 0.25, "grouping_reason": ["r"], "ocr_cache_hit": True},
    }
    pages = [
        {"page_id": "p", "width_px": 10, "height_px": 20, "subject": "math", "source_path": "in.pdf", "blocks": [block], "problems": [],
         "metadata": {"ocr_mode": "auto", "column_count": 2}},
        {"page_id": "empty", "width_px": 1, "height_px": 2, "subject": "unknown", "source_path": "e.pdf", "blocks": [], "problems": [], "metadata": {"block_count": 0}},
    ]
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.json").write_text(json.dumps(pages, indent=2))
    read = files.read_pages(spark, str(tmp_path / "in"))
    blocks = flatten.explode_blocks(read)
    grouped = grouping.group_problems(grouping.tag_blocks(blocks))
    files.write_pages(blocks, grouped, str(tmp_path / "out"), pages=read)
    back = {r.page_id: r for r in files.read_page_lines(spark, str(tmp_path / "out")).collect()}
    for r in read.collect():
        for name in ("width_px", "height_px", "subject", "source_path", "blocks", "metadata"):
            assert back[r.page_id][name] == r[name], name
    assert [u.unit_id for u in back["p"].problems] == ["p-problem-1"] and back["empty"].problems == []


def test_positions_survive_parts(spark, folder):
    blocks = spark.range(25).select(
        F.lit("p").alias("page_id"), F.lit(9).alias("page_width"), F.lit(9).alias("page_height"), F.lit("math").alias("page_subject"),
        F.col("id").cast("int").alias("reading_order"), F.concat(F.lit("b"), "id").alias("block_id"), F.lit("stem").alias("block_type"),
        *[F.lit(1.0).alias(n) for n in ("left", "top", "width", "height")], F.lit("t").alias("text"), F.lit(0.5).alias("confidence"),
        F.col("id").cast("int").alias("pos"), F.lit(None).cast("int").alias("column_index"), F.lit(None).cast("int").alias("question_band_index"),
        F.lit(None).cast("string").alias("display_title"), F.lit(False).alias("force_problem_start"), F.lit(None).cast("string").alias("fallback_reason"),
    )
    grouped = grouping.group_problems(grouping.tag_blocks(blocks))
    for size in (2, 7, None):
        again = flatten.explode_blocks(files.nest_pages(blocks, grouped, size))
        assert sorted((r.pos, r.block_id) for r in again.collect()) == [(i, f"b{i}") for i in range(25)]
        units = grouping.assemble_problems(grouped, size)
        members = flatten.problem_members(units, blocks)
        found = sorted((r.unit_id, r.member_pos, r.block_id) for r in members.collect())
        whole = sorted((r.unit_id, r.member_pos, r.block_id) for r in flatten.problem_members(grouping.assemble_problems(grouped), blocks).collect())
        assert found == whole and len(found) == 25


def test_problem_without_ids_has_the_page(spark, folder):
    blocks = flatten.explode_blocks(files.read_pages(spark, str(folder / "in")))
    none = F.array().cast("array<string>")
    twice = F.array(F.lit("p1-block-002"), F.lit("p1-block-002"), F.lit("gone"))
    units = spark.createDataFrame([("p1", "u"), ("p1", "v")], "page_id string, unit_id string").withColumns(
        {
            "stem_block_ids": F.when(F.col("unit_id") == "v", twice).otherwise(none), "choice_block_ids": none,
            "explanation_block_ids": none, "figure_block_ids": F.when(F.col("unit_id") == "v", F.array(F.lit("p1-block-001"))).otherwise(none),
        }
    )
    members = flatten.problem_members(units, blocks)
    got = sorted((r.unit_id, r.member_pos, r.block_id) for r in members.collect())
    assert got == [("u", 0, "p1-block-001"), ("u", 1, "p1-block-002"), ("v", 0, "p1-block-002"), ("v", 1, "gone"), ("v", 2, "p1-block-001")]
    assert flatten.member_blocks(members, blocks).count() == 4


def test_discover(spark, tmp_path):
    for name in ("x.PDF", "y.Jpeg", "z.docx", "plain"):
        (tmp_path / name).write_text("x")
    known, rejected = files.discover_sources(spark, str(tmp_path))
    assert sorted((r.file_name, r.source_kind, r.size) for r in known.collect()) == [("x.PDF", "pdf", 1), ("y.Jpeg", "image", 1)]
    assert sorted(r.file_name for r in rejected.collect()) == ["plain", "z.docx"]
    assert "content" not in known.columns


@pytest.mark.parametrize("rows", [None, 2])
def test_number_pages(spark, rows):
    sources = [("m", 1, "a", 2), ("m", 2, "b", 0), ("m", 3, "c", 1), ("s", 1, "d", 2)]
    df = spark.createDataFrame(sources, "batch_id string, source_index int, stem string, page_count int")
    got = sorted((r.batch_id, r.page_number, r.page_id, r.original_page_index) for r in files.number_pages(df, rows).collect())
    assert got == [
        ("m", 1, "a-01-page-001", 1), ("m", 2, "a-01-page-002", 2), ("m", 3, "c-03-page-001", 1), ("s", 1, "d-page-001", 1), ("s", 2, "d-page-002", 2)
    ]


def test_plan_files(spark, tmp_path):
    df = spark.createDataFrame([("b", 1, "math", False, None, 1.5)], "board_id string, no int, subject string, heavy boolean, allowed boolean, height_pages double")
    placed = placement.place(df, ["board_id"], ["no"])
    files.write_plan(placed, placement.placement_summary(placed, ["board_id"]), Template(), str(tmp_path / "plan"))
    assert files.read_plan(spark, str(tmp_path / "plan")).first().next_start_y == 2.4
    assert spark.read.parquet(str(tmp_path / "plan" / "template")).first().board_page_count == 50


def test_sessions_in_both_spellings(spark, tmp_path):
    old = {"session_name": "one", "template": {"board_page_count": 60}, "problems": [{"problem_id": "x", "title": "3. t", "start_y_pages": 1.2}]}
    new = {
        "sessionName": "two", "aiFallback": {"mode": "OFF"}, "aiSummary": {"requested": True, "statusCounts": {"applied": 2, "": 1, "bad": -1}},
        "problems": [{"title": "", "excluded": True}],
    }
    for name, body in (("a", old), ("b", new)):
        (tmp_path / f"{name}.json").write_text(json.dumps(body, indent=1))
    df = sessions.read_sessions(spark, str(tmp_path))
    got = {r.session_name: r for r in df.collect()}
    assert got["one"].template.board_page_count == 60.0 and got["one"].template.slot_height == 1.2 and got["two"].template is None
    assert got["two"].repair_config.mode == "off" and got["two"].repair_config.enabled and got["two"].repair_summary.status_counts == {"applied": 2.0}
    units = {r.session_name: r for r in sessions.session_problems(df).collect()}
    assert (units["one"].title, units["one"].problem_number, units["one"].start_y, units["one"].content_height) == ("t", 3, 1.2, 0.9)
    assert (units["two"].problem_id, units["two"].title, units["two"].excluded) == ("problem-01", "문항 1", True)


def test_stream_takes_each_file_once(spark, folder):
    out, log = str(folder / "blocks"), str(folder / "log")
    ingest.ingest_stream(spark, str(folder / "in"), out, log, max_files=1).awaitTermination()
    assert spark.read.parquet(out).count() == 3
    (folder / "in" / "c.json").write_text(json.dumps([page("p4", ["x", "y"])]))
    ingest.ingest_stream(spark, str(folder / "in"), out, log).awaitTermination()
    ingest.ingest_stream(spark, str(folder / "in"), out, log).awaitTermination()
    assert spark.read.parquet(out).count() == 5


def test_one_read_fills_three_tables_and_a_replay_adds_nothing(spark, folder):
    out, log = str(folder / "tables"), str(folder / "tables-log")
    unit = {"unit_id": "u1", "subject": "math", "stem_block_ids": ["p4-block-001"]}
    (folder / "in" / "c.json").write_text(json.dumps([page("p4", ["x"], problems=[unit, {"unit_id": "u2"}])]))

    def rows():
        return {name: ingest.ingested(spark, out, name).count() for name in ("blocks", "lines", "problems")}

    ingest.ingest_pages(spark, str(folder / "in"), out, log, max_files=1).awaitTermination()
    assert rows() == {"blocks": 4, "lines": 4, "problems": 2}
    done = ingest.commits(spark, out).collect()
    assert sorted((r.pages, r.blocks, r.lines, r.problems) for r in done) == [(1, 1, 1, 0), (1, 1, 1, 2), (2, 2, 2, 0)]
    assert sorted(r.page_id for r in ingest.ingested(spark, out, "blocks").collect()) == ["p1", "p1", "p3", "p4"]

    last = max(r.batch_id for r in done)  # as if the run had failed after the batch was written: its commit is lost, it runs again
    shutil.rmtree(folder / "tables" / "commits" / str(last))
    assert sum(rows().values()) < 10
    (folder / "tables-log" / "commits" / str(last)).unlink()
    (folder / "tables-log" / "commits" / f".{last}.crc").unlink(missing_ok=True)
    ingest.ingest_pages(spark, str(folder / "in"), out, log, max_files=1).awaitTermination()
    assert rows() == {"blocks": 4, "lines": 4, "problems": 2} and ingest.commits(spark, out).count() == 3


def test_shared_folder_is_the_named_one(spark):
    assert spark.conf.get("spark.checkpoint.dir") in scale.shared_folder(spark)


def test_batches_are_bounded_by_bytes(spark, folder):
    out, log = str(folder / "by-bytes"), str(folder / "by-bytes-log")
    ingest.ingest_pages(spark, str(folder / "in"), out, log, max_bytes=1).awaitTermination()
    assert sorted(r.pages for r in ingest.commits(spark, out).collect()) == [1, 2]  # a batch for each file
    assert ingest.ingested(spark, out, "lines").count() == 3


def test_pages_are_moved_once(spark):
    """Folded pages meet their problems where they are; only the problems move again."""
    columns = "page_id string, page_width int, page_height int, page_subject string, block_id string, block_type string, left double, top double, width double, height double, reading_order int, text string"
    blocks = spark.createDataFrame([("p", 1, 1, "math", "b", "stem", 0.0, 0.0, 1.0, 1.0, 0, "t")], columns)
    units = spark.createDataFrame([("p", "u", 1, "math", "b", "stem", 0)], "page_id string, unit_id string, problem_index bigint, subject string, block_id string, role string, reading_order int")
    made = files.nest_pages(blocks, units)
    assert [(r.width_px, r.subject, len(r.blocks), len(r.problems)) for r in made.collect()] == [(1, "math", 1, 1)]
    plan = made._jdf.queryExecution().sparkPlan().toString()
    assert "page_width" not in "".join(line for line in plan.splitlines() if "keys=" in line and "HashAggregate" in line).split("functions=")[0]
