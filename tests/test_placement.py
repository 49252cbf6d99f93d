"""Slot packing: worked examples and an independent loop."""

import math
import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import placement
from foliospark.settings import Template

HEIGHTS = "board string, no int, subject string, heavy boolean, allowed boolean, height_pages double"


def place(spark, problems, template=None, **options):
    df = spark.createDataFrame(problems, HEIGHTS)
    return placement.place(df, ["board"], ["no"], template or Template(), **options)


def test_worked_example(spark):
    rows = [
        ("b", 1, "math", False, None, 0.92), ("b", 2, "korean", True, None, 1.43), ("b", 3, "science", False, False, 1.24),
    ]
    got = {r.no: r for r in place(spark, rows).collect()}
    expected = {
        1: (0.0, 0.92, 1.2, False, 0.0, False, 1), 2: (1.2, 2.63, 3.6, True, 0.23, False, 2), 3: (3.6, 4.84, 6.0, False, 0.04, True, 2),
    }
    for no, (start, bottom, following, allowed, amount, violation, span) in expected.items():
        r = got[no]
        assert (r.start_y, r.bottom_y, r.next_start_y) == (start, bottom, following)
        assert (r.overflow_allowed, r.overflow_amount, r.overflow_violation, r.slot_span) == (allowed, amount, violation, span)


@pytest.mark.parametrize(
    ("height", "following", "span"), [(0.0, 0.0, 1), (1.2, 1.2, 1), (2.4, 2.4, 2), (-1.0, 0.0, 1), (2.1954, 2.4, 2)]
)
def test_edges(spark, height, following, span):
    r = place(spark, [("b", 1, "math", False, None, height)]).first()
    assert (r.start_y, r.next_start_y, r.slot_span) == (0.0, following, span)


def loop(heights, slot, start=0.0):
    up = lambda v: 0.0 if v <= 0 else round(math.ceil((v - 1e-9) / slot) * slot, 6)
    at, out = up(max(start, 0.0)), []
    for h in heights:
        h = max(h, 0.0)
        bottom = round(at + h, 6)
        following = up(bottom)
        out.append((round(at, 6), bottom, following, max(1, int(round((following - at) / slot)))))
        at = following
    return out


@pytest.mark.parametrize("slot", [1.2, 0.35])
@pytest.mark.parametrize("rows_per_task", [None, 40])
@pytest.mark.parametrize("start", [0.0, 1.7])
def test_against_loop(spark, slot, rows_per_task, start):
    rng = random.Random(5)
    boards = {b: [rng.choice([0.0, 1.2, 2.4, round(rng.uniform(-0.5, 5), 5)]) for _ in range(n)] for b, n in (("big", 200), ("s", 9))}
    rows = [(b, i, "math", False, None, float(h)) for b, hs in boards.items() for i, h in enumerate(hs)]
    got = place(spark, rows, Template(slot_height=slot), start=start, rows=rows_per_task).collect()
    for b, hs in boards.items():
        mine = [(r.start_y, r.bottom_y, r.next_start_y, r.slot_span) for r in sorted((r for r in got if r.board == b), key=lambda r: r.no)]
        expected = loop(hs, slot, start)
        assert len(mine) == len(expected)
        assert all(a == pytest.approx(b) for a, b in zip(mine, expected, strict=True))
        assert [r.seq for r in sorted((r for r in got if r.board == b), key=lambda r: r.no)] == list(range(len(hs)))


def test_flags_find_overlap_and_unsnapped(spark):
    df = spark.createDataFrame(
        [("b", 0, 0.0, 1.0, 1.0, False), ("b", 1, 0.6, 1.0, 1.6, True), ("b", 2, 60.0, 2.0, 62.0, False)],
        "board string, seq int, start_y double, content_height double, bottom_y double, overflow_violation boolean",
    )
    got = {r.seq: r for r in placement.placement_flags(df, ["board"]).collect()}
    assert got[0].warn_overlap and not got[1].warn_overlap
    assert got[1].warn_unsnapped and not got[0].warn_unsnapped
    assert got[2].warn_capacity and got[2].warn_overflow and not got[0].warn_overflow


def test_empty_summary_is_zero(spark):
    r = placement.placement_summary(place(spark, []).where("false")).first()
    assert (r.problem_count, r.overflow_count, r.max_bottom_y) == (0, 0, 0.0)


def test_bad_slot_is_refused():
    with pytest.raises(ValueError, match="slot_height"):
        Template(slot_height=0)


def test_problem_without_blocks_takes_the_page(spark):
    problems = spark.createDataFrame([("p", "u", 800, 600)], "page_id string, unit_id string, page_width int, page_height int")
    none = spark.createDataFrame(
        [], "page_id string, unit_id string, left double, top double, width double, height double, question_band_index int"
    )
    r = placement.min_area_fallback(placement.problem_bounds(none, problems)).first()
    assert (r.bound_left, r.bound_top, r.bound_width, r.bound_height, r.whole_page) == (0, 0, 800, 600, False)


def test_heights(spark):
    df = spark.range(1).select(
        placement.page_height(F.lit(0), F.lit(10)).alias("zero"), placement.crop_height(F.lit(100), F.lit(10000)).alias("tall"),
        placement.spread_height(F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(100), F.lit(False), F.lit(False), F.lit(False)).alias("none"),
    )
    assert tuple(df.first()) == (1.2, 4.8, 0.9)
