import random
import time

import pytest

from foliospark.operators import boxmerge
from foliospark.operators.boxmerge import Edges

SCHEMA = "page_id string, left double, top double, width double, height double, box_no int, right string"


def plain(boxes, gx, gy):
    """Sweep over the boxes by top and left; the first one takes in what it can, then the next."""
    boxes = sorted(boxes, key=lambda b: b[:2])
    while True:
        out, rest = [], boxes
        while rest:
            current, later = rest[0], []
            for b in rest[1:]:
                if boxmerge.belongs(current, b, gx, gy):
                    current = boxmerge.joined(current, b)
                else:
                    later.append(b)
            out.append(current)
            rest = later
        joined, boxes = len(out) < len(boxes), sorted(out, key=lambda b: b[:2])
        if not joined:
            return boxes


def made(dealer, n, span, size, grid=1):
    out = []
    for _ in range(n):
        left, top = (dealer.randrange(0, span, grid) for _ in "lt")
        out.append(Edges(top, left, left + dealer.choice(size), top + dealer.choice(size)))
    return sorted(out)


@pytest.mark.parametrize(("span", "size", "gaps"), [
    (400, [3, 8, 20], (5, 3)), (40_000, [1, 5, 60], (20, 5)), (300, [0, 1], (0, 0)), (60, [5, 50, 60], (2, 2)), (3000, [0, 2, 900, 3000], (4, 4)),
])
def test_random_pages_equal_the_rule(span, size, gaps):
    dealer = random.Random(span)
    for _ in range(150):
        boxes = made(dealer, dealer.randrange(0, 40), span, size, dealer.choice([1, 1, 7]))
        assert boxmerge.merged(boxes, *gaps) == plain(boxes, *gaps), boxes


def test_nested_frames_with_apart_boxes_inside():
    boxes = sorted([Edges(0.0, 0.0, 5000.0 - i * 100, 5000.0 - i * 100) for i in range(0, 40, 9)] + [Edges(i * 40.0 + 1, i * 40.0 + 1, i * 40.0 + 3, i * 40.0 + 3) for i in range(60)])
    assert boxmerge.merged(boxes, 4, 4) == plain(boxes, 4, 4)


def test_tables_of_boxes(spark):
    dealer = random.Random(2)
    pages = {None if p == 0 else f"p{p}": made(dealer, dealer.randrange(1, 30), 900, [5, 30, 60]) for p in range(30)}
    rows = [(p, float(b.left), float(b.top), float(b.right - b.left), float(b.bottom - b.top), 1, "x") for p, bs in pages.items() for b in bs]
    rows += [("p1", None, 1.0, 1.0, 1.0, 1, "x"), ("p1", 1.0, float("nan"), 1.0, 1.0, 1, "x"), ("lone", 5.0, 5.0, None, -3.0, 1, "x")]
    found = boxmerge.merge_page_boxes(spark.createDataFrame(rows, SCHEMA).repartition(3), 20, 10)
    assert found.columns == ["page_id", "box_no", "left", "top", "width", "height"]
    wanted = {(p, i, b.left, b.top, b.right - b.left, b.bottom - b.top) for p, bs in pages.items() for i, b in enumerate(plain(bs, 20, 10))}
    assert {tuple(r) for r in found.collect()} == wanted | {("lone", 0, 5.0, 5.0, 0.0, 0.0)}
    assert boxmerge.merge_page_boxes(spark.createDataFrame([], SCHEMA)).count() == 0


def test_twenty_thousand_boxes_on_a_page_in_seconds():
    """None of them joins, so every box is looked up among all before it; then lines that all join one another."""
    apart = [Edges(i * 50.0, i * 70.0, i * 70.0 + 10, i * 50.0 + 10) for i in range(20_000)]
    lines = [Edges(i * 50.0, 0.0, 900.0, i * 50.0 + 10) for i in range(20_000)]
    pairs = sorted(Edges(i // 2 * 50.0 + i % 2 * 2, i // 2 * 90.0 + i % 2 * 12, i // 2 * 90.0 + i % 2 * 12 + 10, i // 2 * 50.0 + 10) for i in range(20_000))
    began = time.time()
    assert boxmerge.merged(apart, 20, 10) == apart
    assert boxmerge.merged(lines, 20, 10) == [Edges(0.0, 0.0, 900.0, 20_000 * 50.0 - 40)]
    assert len(boxmerge.merged(pairs, 20, 10)) == 10_000
    assert time.time() - began < 60


def test_few_boxes_are_compared_one_by_one(monkeypatch):
    """With and without trees the same, around the limit too; a small page takes no trees."""
    dealer = random.Random(5)
    for n in [*range(0, 20), 63, 64, 65, 66, 90]:
        for size in ([3, 8, 20], [0, 50, 900]):
            boxes = made(dealer, n, dealer.choice([200, 900, 9000]), size, dealer.choice([1, 10]))
            assert boxmerge.merged(boxes, 20, 5) == plain(boxes, 20, 5)
    monkeypatch.setattr(boxmerge, "Shadows", None)
    boxes = made(dealer, 30, 400, [3, 8, 20])
    assert boxmerge.merged(boxes, 20, 5) == plain(boxes, 20, 5)
