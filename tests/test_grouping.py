"""Markers, reading order and grouping against the written rules."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.operators import grouping, ordering

MARKERS = [
    ("1. a", True, False, 1), ("2) b", True, True, 2), ("문항 3. x", True, False, 3), ("문제4) y", True, False, 4),
    ("[5] z", True, False, 5), ("[5]z", False, False, None), ("12.5 kg", False, False, None), ("1000. q", False, False, None),
    ("0. z", False, False, None), ("문항 3", False, False, None), ("1.", True, False, 1), ("① ㄱ", False, True, None),
    ("(1) q", False, True, None), ("A. q", False, True, None), ("h) q", False, True, None), ("ㄱ. q", False, True, None),
    ("B.C", False, True, None), ("⑪ x", False, False, None), ("　8. wide", True, False, 8), ("9. nb", True, False, 9),
]


def test_marker_table(spark):
    df = spark.createDataFrame([(i, m[0]) for i, m in enumerate(MARKERS)], "i int, t string")
    c = F.col("t")
    got = df.select("i", tx.has_problem_marker(c).alias("p"), tx.has_choice_marker(c).alias("c"), tx.problem_number(c).alias("n"))
    for r in got.collect():
        assert (r.p, r.c, r.n) == MARKERS[r.i][1:], MARKERS[r.i][0]


def test_titles_and_types(spark):
    cases = [
        ("3. What?", "What?", "stem"), ("3.", "3.", "stem"), (" A. x", "A. x", "choice"), ("sine", "sine", "formula"),
        ("제1단원", "제1단원", "section"), ("  ", None, "unknown"), ("1) x", "x", "choice"),
    ]
    df = spark.createDataFrame([(i, c[0]) for i, c in enumerate(cases)], "i int, t string")
    none = F.lit(None).cast("string")
    for r in df.select("i", tx.display_title_of(none, F.col("t")).alias("d"), tx.text_block_type(F.col("t")).alias("k")).collect():
        assert (r.d, r.k) == cases[r.i][1:], cases[r.i]


BLOCK = (
    "page_id string, pos int, block_id string, block_type string, left double, top double, width double, height double, "
    "reading_order int, text string, column_index int, question_band_index int, display_title string, "
    "force_problem_start boolean, page_subject string"
)


def pages(spark, layout):
    rows = []
    for page, blocks in layout.items():
        for i, b in enumerate(blocks):
            rows.append((
                page, i, f"{page}-{i}", b.get("kind", "stem"), float(b.get("left", 0)), float(b.get("top", i * 10)), 10.0, 10.0, i,
                b.get("text"), b.get("col"), b.get("band"), b.get("title"), b.get("force", False), "unknown",
            ))
    return spark.createDataFrame(rows, BLOCK)


def grouped(spark, layout, rows=None):
    found = grouping.group_problems(grouping.tag_blocks(ordering.reading_order(pages(spark, layout), rows=rows)), rows=rows)
    return {r.block_id: r for r in found.collect()}


def test_choice_precedence(spark):
    got = grouped(spark, {
        "p": [
            {"text": "1. first", "kind": "stem"}, {"text": "A. q", "kind": "section"}, {"text": "1) x", "kind": "choice"},
            {"text": "2) y", "kind": "stem"}, {"text": None, "kind": "note"}, {"text": None, "kind": "image"},
        ],
    })
    kinds = [got[f"p-{i}"].block_type for i in range(6)]
    assert kinds == ["title", "choice", "choice", "title", "note", "image"]
    assert [got[f"p-{i}"].is_start for i in range(6)] == [True, False, False, True, False, False]
    assert got["p-2"].marker_conflict and got["p-2"].problem_index == 1
    assert [got[f"p-{i}"].role for i in range(6)] == ["stem", "choice", "choice", "stem", None, "figure"]
    assert [got[f"p-{i}"].problem_index for i in range(6)] == [1, 1, 1, 2, 2, 2]


def test_fallback_and_single_block(spark):
    got = grouped(spark, {
        "many": [{"text": "plain"}, {"text": None, "kind": "note"}], "one": [{"text": "plain"}], "band": [{"text": "plain", "band": 1}],
    })
    assert [got[f"many-{i}"].problem_index for i in range(2)] == [1, 2] and got["many-0"].fallback_grouping
    assert got["many-1"].role == "stem"
    assert not got["one-0"].fallback_grouping and got["band-0"].fallback_grouping


def test_forced_start_and_display_title(spark):
    got = grouped(spark, {"p": [{"text": "x"}, {"kind": "choice", "text": "① y", "force": True}, {"text": None, "title": "3. t"}]})
    assert [got[f"p-{i}"].problem_index for i in range(3)] == [1, 2, 3]
    assert got["p-2"].problem_number == 3 and got["p-2"].block_type == "stem"


@pytest.mark.parametrize("rows", [None, 5])
def test_reading_order_and_groups_against_loop(spark, rows):
    rng = random.Random(3)
    layout = {}
    for p in range(12):
        known = p % 3 != 0
        layout[f"p{p}"] = [
            {
                "left": rng.choice([0, 400, 0.00004]), "top": rng.randint(0, 4) * 10, "text": rng.choice(["1. a", "b", "① c", None]),
                "col": rng.randint(1, 2) if known or rng.random() < 0.5 else None, "band": rng.choice([None, 1, 2]) if p % 2 else None,
            }
            for _ in range(rng.randint(1, 30))
        ]
    got = grouped(spark, layout, rows)
    for page, blocks in layout.items():
        by_column = all(b["col"] is not None for b in blocks)

        def key(i, blocks=blocks, by_column=by_column):
            b = blocks[i]
            spot = (round(b["top"], 4), round(b["left"], 4))
            if by_column:
                return (b["col"], i if b["band"] is None else b["band"], *spot)
            return (*spot, i)

        order = sorted(range(len(blocks)), key=key)
        starts = [blocks[i]["text"] == "1. a" for i in order]
        fallback = not any(starts) and (len(blocks) > 1 or any(b["band"] is not None for b in blocks))
        index = 0
        for at, (i, start) in enumerate(zip(order, starts, strict=True)):
            index += fallback or start or at == 0
            r = got[f"{page}-{i}"]
            assert (r.reading_order, r.problem_index, r.fallback_grouping) == (at, index, fallback)


def test_line_numbers_prefer_the_corner(spark):
    blocks = spark.createDataFrame([("p", "b", 100.0, 100.0)], "page_id string, block_id string, width double, height double")
    lines = spark.createDataFrame(
        [("p", "b", 0, "7. far", 90.0, 0.0), ("p", "b", 1, "8. corner", 5.0, 30.0), ("p", "b", 2, "9. corner", 5.0, 10.0)],
        "page_id string, block_id string, line_no int, text string, left double, top double",
    )
    r = grouping.line_numbers(lines, blocks).first()
    assert (r.line_number, r.line_source) == (9, "ocr_top_left")
    nested = lines.groupBy("page_id", "block_id").agg(
        F.sort_array(F.collect_list(F.struct("line_no", "text", F.struct("left", "top").alias("bbox")))).alias("lines")
    ).join(blocks, ["page_id", "block_id"])
    best = nested.select(tx.best_line_number(F.col("lines"), F.col("width"), F.col("height")).alias("b")).first().b
    assert best.number == 9


def test_parts_of_a_long_problem(spark):
    layout = {"p": [{"text": "1. a"}] + [{"text": "b"} for _ in range(24)]}
    found = grouping.group_problems(grouping.tag_blocks(ordering.reading_order(pages(spark, layout), rows=4)), rows=4)
    parts = grouping.assemble_problems(found, part_items=10).orderBy("part").collect()
    assert [len(r.stem_block_ids) for r in parts] == [10, 10, 5]
    assert sum((r.stem_block_ids for r in parts), []) == [f"p-{i}" for i in range(25)]


def test_tagging_lowers_a_text_once(spark):
    """Twenty subject words are looked for in one lower-cased text."""
    blocks = spark.createDataFrame([("p", "b", 0, "stem", "A SIN and 보기")], "page_id string, block_id string, reading_order int, block_type string, text string")
    tagged = grouping.tag_blocks(blocks.withColumns({"width": F.lit(1.0), "height": F.lit(1.0), "page_subject": F.lit("x")}).repartition(1))
    row = tagged.first()
    assert (row.says_math, row.says_korean, row.says_science) == (True, True, False)
    assert tagged._jdf.queryExecution().optimizedPlan().toString().count("lower(") == 1
    assert not [c for c in tagged.columns if c.startswith("_")]
