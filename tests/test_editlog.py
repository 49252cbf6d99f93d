import random

import pytest

from foliospark.operators import editlog

PROBLEMS = "board_id string, problem_id string, seq long, title string, height_pages double, excluded boolean"
EDITS = "board_id string, edit_no long, problem_id string, action string, target_id string, title string, height_pages double"
ACTIONS = ["up", "down", "drop", "duplicate", "delete", "toggle", "patch", "append"]


def plain(problems, edits):
    """The edits in a plain loop over each board's whole list."""
    boards = {}
    for b, p, _, *rest in sorted(problems, key=lambda r: (r[0], r[2])):
        boards.setdefault(b, []).append([p, p, *rest])
    for b, no, p, action, target, title, height in sorted(edits, key=lambda r: r[1]):
        held = boards.setdefault(b, [])
        ids = [r[0] for r in held]
        if action == "append" and p not in ids:
            held.append([p, None, title, height, False])
        if p not in ids:
            continue
        i = ids.index(p)
        to = i - 1 if action == "up" else i + 1 if action == "down" else ids.index(target) if action == "drop" and target in ids else i
        if 0 <= to < len(held):
            held.insert(to, held.pop(i))
        if action == "duplicate":
            q, o, t, h, x = held[i]
            held.insert(i + 1, [f"{q}-copy-{no}", o, t + " 복제본", h, x])
        if action == "delete" and len(held) > 1:
            held.pop(i)
        if action == "toggle":
            held[i][4] = not held[i][4]
        if action == "patch":
            held[i][2:4] = [title or held[i][2], height if height is not None else held[i][3]]
    return sorted((b, p, o, s, t, h, x) for b, held in boards.items() for s, (p, o, t, h, x) in enumerate(held))


def applied(spark, problems, edits, rows=None):
    out = editlog.apply_edit_log(spark.createDataFrame(problems, PROBLEMS), spark.createDataFrame(edits, EDITS), rows=rows)
    assert out.columns == ["board_id", "problem_id", "origin_id", "seq", "title", "height_pages", "excluded"]
    return sorted(map(tuple, out.collect()), key=lambda r: (r[0], r[1]))


def in_order(rows):
    return sorted(rows, key=lambda r: (r[0], r[1]))


def made(seed, sizes, edits_of):
    """Boards of given sizes with two to five edits for each of some problems, copies and strangers edited too."""
    dealer = random.Random(seed)
    problems, edits = [], []
    for b, size in enumerate(sizes):
        ids = [f"p{i}" for i in range(size)]
        problems += [(f"b{b}", p, i, f"t{p}", i / 4, i % 3 == 0) for i, p in enumerate(ids)]
        chosen = [p for p in dealer.sample(ids, min(size, edits_of)) for _ in range(dealer.randrange(2, 6))]
        dealer.shuffle(chosen)
        for no, p in enumerate(chosen):
            known = [*ids, "stranger", *[f"{q}-copy-{n}" for q in chosen[:3] for n in range(no)]]
            p = p if dealer.random() < 0.8 else dealer.choice(known)
            edits.append((f"b{b}", no * 2, p, dealer.choice(ACTIONS), dealer.choice(known), dealer.choice([None, f"new {no}"]), dealer.choice([None, 2.5])))
    return problems, edits


@pytest.mark.parametrize("seed", range(6))
@pytest.mark.parametrize("rows", [None, 3])
def test_random_edits_equal_a_plain_loop(spark, seed, rows):
    problems, edits = made(seed, [1, 2, 5, 30, 200], 12)
    assert applied(spark, problems, edits, rows) == in_order(plain(problems, edits))


def test_moves_in_turn_and_the_last_problem_stays(spark):
    problems = [("a", p, i, p, 1.0, False) for i, p in enumerate("xyz")]
    edits = [("a", n, *e, None, None) for n, e in enumerate([
        ("x", "down", None), ("x", "down", None), ("x", "down", None), ("z", "drop", "y"), ("y", "drop", "x"), ("z", "delete", None), ("x", "delete", None), ("y", "delete", None), ("y", "up", None),
    ])]
    assert [(r[1], r[3]) for r in applied(spark, problems, edits)] == [("y", 0)]


def test_many_moves_through_one_gap_deal_labels_anew(spark):
    problems = [("a", f"p{i:02d}", i, "t", 1.0, False) for i in range(60)]
    edits = [("a", n, f"p{2 + n % 50:02d}", "drop", "p01" if n % 2 else "p00", None, None) for n in range(300)]
    assert applied(spark, problems, edits) == in_order(plain(problems, edits))


def test_nulls_strangers_and_empty_tables(spark):
    problems = [("a", "x", 0, None, None, None), (None, "y", 0, "t", 1.0, False), ("c", "z", 0, "t", 1.0, True)]
    edits = [
        (None, 1, "y", "delete", None, None, None), ("a", 1, None, "up", None, None, None), ("a", 2, "x", None, None, None, None), ("a", 3, "x", "duplicate", None, None, None),
        ("a", 4, "x", "toggle", None, None, None), ("a", 5, "x", "drop", "x", None, None), ("new", 1, "n", "append", None, "t", 1.5),
    ]
    found = applied(spark, problems[:1] + problems[2:], edits[1:])
    assert found == [("a", "x", "x", 0, None, None, True), ("a", "x-copy-3", "x", 1, None, None, None), ("c", "z", "z", 0, "t", 1.0, True), ("new", "n", None, 0, "t", 1.5, False)]
    kept = editlog.apply_edit_log(spark.createDataFrame(problems, PROBLEMS), spark.createDataFrame(edits[:1], EDITS)).collect()
    assert len(kept) == 3
    assert applied(spark, [], []) == []


def test_untouched_problems_are_not_folded(spark):
    """A board's state is its edits: two named problems in a list of 20,000 are five nodes."""
    named = [dict(problem_id=p, no=n, title="t", height_pages=1.0, excluded=False) for p, n in (("a", 5000), ("b", 15_000))]
    board = editlog.Board(20_000, named)
    assert sum(1 for _ in board.list) == 5
    board.apply(dict(problem_id="a", action="up", no=1, target_id=None))
    board.apply(dict(problem_id="a", action="drop", no=2, target_id="b"))
    assert sum(1 for _ in board.list) == 6
    rows = list(board.rows())
    assert [(r[0], r[2]) for r in rows if r[0]] == [("b", 14_999), ("a", 15_000)]
