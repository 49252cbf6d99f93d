"""Edits of problem lists, one after another.

Each edit acts on the list as the edits before it have left it, so a board's edits are folded in order. The fold does not
see the board's problems: only those that an edit names are held one by one, and every stretch of others between
them is a *run* of old places, split where a problem moves past one of its ends. The state of a board is therefore as
large as its edits, whatever the length of its list. The fold gives the named problems their new places, and for
each run how far it has shifted; all other problems get their places by a running sum of those shifts, slice
by slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.scale import Running
from foliospark.settings import COPY_SUFFIX

GAP = 1 << 40
ROWS = 10_000  # rows of a result batch
FIELDS = "problem_id string, action string, target_id string, title string, height_pages double, excluded boolean"


class Node:
    """A named problem, or a run of old places ``first`` to ``last``; ``label`` grows along the list."""

    __slots__ = ("label", "before", "after", "first", "last", "problem")

    def __init__(self, first: int = 0, last: int = 0, problem: dict | None = None):
        self.first, self.last, self.problem = first, last, problem
        self.before = self.after = None
        self.label = 0


class Sequence:
    """A list in which two members are compared, moved and inserted without counting places.

    Labels leave gaps; when one is used up, all labels are dealt anew.
    """

    def __init__(self):
        self.head, self.tail = Node(), Node()
        self.head.after, self.tail.before, self.tail.label = self.tail, self.head, GAP

    def __iter__(self) -> Iterator[Node]:
        node = self.head.after
        while node is not self.tail:
            yield node
            node = node.after

    def put_after(self, place: Node, node: Node) -> None:
        node.before, node.after = place, place.after
        place.after.before = node
        place.after = node
        if node.after is self.tail:
            self.tail.label = place.label + 2 * GAP
        node.label = (place.label + node.after.label) // 2
        if node.label == place.label:
            for number, each in enumerate(self, 1):
                each.label = number * GAP
            self.tail.label = self.tail.before.label + GAP

    def put_before(self, place: Node, node: Node) -> None:
        self.put_after(place.before, node)

    def take(self, node: Node) -> None:
        node.before.after, node.after.before = node.after, node.before


class Board:
    """The list of one board: ``size`` problems, of which those in ``named`` (in order of seq) are known one by one."""

    def __init__(self, size: int, named: list[dict]):
        self.list, self.size = Sequence(), size
        self.nodes: dict[str, Node] = {}
        at = 0
        for problem in named:
            self._run(at, problem["no"] - 1)
            self.nodes[problem["problem_id"]] = self._last(Node(problem=dict(problem, origin_id=problem["problem_id"])))
            at = problem["no"] + 1
        self._run(at, size - 1)

    def _last(self, node: Node) -> Node:
        self.list.put_before(self.list.tail, node)
        return node

    def _run(self, first: int, last: int) -> None:
        if first <= last:
            self._last(Node(first, last))

    def apply(self, edit: dict) -> None:
        """One edit. Those of a missing problem, past either end, or that would empty the list change nothing."""
        action, node = edit["action"], self.nodes.get(edit["problem_id"])
        if action == "append":
            if node is None and edit["problem_id"] is not None:
                made = {k: edit[k] for k in ("problem_id", "title", "height_pages")} | {"excluded": False, "origin_id": None}
                self.nodes[edit["problem_id"]] = self._last(Node(problem=made))
                self.size += 1
        elif node is None:
            return
        elif action == "up":
            self._step(node, node.before, True)
        elif action == "down":
            self._step(node, node.after, False)
        elif action == "drop":
            self._drop(node, self.nodes.get(edit["target_id"]))
        elif action == "duplicate":
            number = f"{node.problem['problem_id']}-copy-{edit['no']}"
            title = node.problem["title"]
            copy = dict(node.problem, problem_id=number, title=None if title is None else title + COPY_SUFFIX)
            self.nodes[number] = Node(problem=copy)
            self.list.put_after(node, self.nodes[number])
            self.size += 1
        elif action == "delete" and self.size > 1:
            self.list.take(self.nodes.pop(edit["problem_id"]))
            self.size -= 1
        elif action == "toggle":
            node.problem["excluded"] = not node.problem["excluded"]
        elif action == "patch":
            node.problem.update({k: edit[k] for k in ("title", "height_pages") if edit[k] is not None})

    def _step(self, node: Node, other: Node, up: bool) -> None:
        if other is self.list.head or other is self.list.tail:
            return
        if other.problem is None and other.first < other.last:  # only the nearest place of the run is passed
            if up:
                one = Node(other.last, other.last)
                other.last -= 1
                self.list.put_after(other, one)
            else:
                one = Node(other.first, other.first)
                other.first += 1
                self.list.put_before(other, one)
            other = one
        self.list.take(node)
        (self.list.put_before if up else self.list.put_after)(other, node)

    def _drop(self, node: Node, target: Node | None) -> None:
        if target is None or target is node:
            return
        down = node.label < target.label
        self.list.take(node)
        (self.list.put_after if down else self.list.put_before)(target, node)

    def rows(self) -> Iterator[tuple]:
        """(problem_id, origin_id, seq, title, height_pages, excluded, run_at, shift): named problems, then runs in old order."""
        at, runs = 0, []
        for node in self.list:
            if node.problem is None:
                runs.append((node.first, at - node.first))
                at += node.last - node.first + 1
            else:
                p = node.problem
                yield p["problem_id"], p["origin_id"], at, p["title"], p["height_pages"], p["excluded"], None, None
                at += 1
        shift = 0
        for first, moved in sorted(runs):
            yield None, None, None, None, None, None, first, moved - shift
            shift = moved


def apply_edit_log(problems: DataFrame, edits: DataFrame, rows: int | None = None) -> DataFrame:
    """Apply the edits of each board in the order of edit_no, any number to one problem.

    ``problems`` has board_id, problem_id, seq (0..n-1 per board), title, height_pages and excluded. ``edits`` has board_id,
    edit_no (different within a board), problem_id, action, target_id, title and height_pages. Actions: up, down, drop
    (onto target_id: after it when moved down, before it when moved up), duplicate, delete (never a board's last
    problem), toggle, patch (title and height where given) and append. A copy is named ``<id>-copy-<edit_no>`` and can be
    edited by that name. Edits of a problem that is not on the board at that moment change nothing; rows with a
    null board_id are no edits.

    Returns board_id, problem_id, origin_id (the given problem it is or was copied from; null if appended), seq, title,
    height_pages and excluded.
    """
    edits = edits.where("board_id is not null")
    ids = ["board_id", "problem_id"]
    texts = problems.withColumn("problem_id", F.col("problem_id").cast("string"))
    columns = ["problem_id", "seq", "title", F.col("height_pages").cast("double"), "excluded"]
    texts = texts.select("board_id", *columns)
    named = edits.select("board_id", F.explode(F.array(F.col("problem_id").cast("string"), F.col("target_id").cast("string"))).alias("problem_id"))
    named = scale.staged(named.where("problem_id is not null").distinct())
    touched = texts.join(named, ids, "left_semi")
    sizes = texts.join(named.select("board_id").distinct(), "board_id", "left_semi").groupBy("board_id").agg(F.count("*").alias("no"))

    def part(df: DataFrame, kind: int, no: str) -> DataFrame:
        given = [f.strip().split(" ") for f in FIELDS.split(",")]
        held = [F.col(n).cast(t) if n in df.columns else F.lit(None).cast(t).alias(n) for n, t in given]
        return df.select("board_id", F.lit(kind).alias("kind"), F.col(no).cast("bigint").alias("no"), *held)

    stream = part(sizes, 0, "no").unionByName(part(touched, 1, "seq")).unionByName(part(edits, 2, "edit_no"))
    order = ["board_id", "kind", "no", "problem_id", "action"]
    stream = stream.repartition("board_id").sortWithinPartitions(*order)
    types = dict(problems.dtypes)
    schema = f"board_id {types['board_id']}, problem_id string, origin_id string, seq bigint, title string, height_pages double, excluded boolean, run_at bigint, shift bigint"
    made = scale.staged(stream.mapInArrow(_folded, schema))

    rest = texts.join(named, ids, "left_anti").withColumns({"_named": F.lit(1), "_shift": F.lit(0).cast("bigint")})
    steps = made.where("run_at is not null").select("board_id", F.col("run_at").alias("seq"), F.lit(0).alias("_named"), F.col("shift").alias("_shift"))
    cut = scale.by_position(rest.unionByName(steps, allowMissingColumns=True), "seq", rows)
    moved = scale.running(cut, ["board_id"], [F.col("seq"), F.col("_named")], {"_moved": Running("sum", F.col("_shift"))})
    moved = moved.where("_named = 1").withColumns({"seq": F.col("seq") + F.col("_moved"), "origin_id": F.col("problem_id")})
    out = ["board_id", "problem_id", "origin_id", "seq", "title", "height_pages", "excluded"]
    return made.where("run_at is null").select(*out).unionByName(moved.select(*out))


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fold the boards of a task, which come one after another: size, named problems by seq, edits in order."""
    schema, key, size, named, board, out = None, None, 0, [], None, []
    names = ["problem_id", "origin_id", "seq", "title", "height_pages", "excluded", "run_at", "shift"]
    types = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.float64(), pa.bool_(), pa.int64(), pa.int64()]

    def flushed() -> pa.RecordBatch:
        columns = list(zip(*out)) or [()] * 9
        out.clear()
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [schema, *types])], ["board_id", *names])

    def settled() -> None:
        if key is not None:
            out.extend((key, *row) for row in (board or Board(size, named)).rows())

    for batch in batches:
        schema = batch.schema.field("board_id").type
        for row in batch.to_pylist():
            if row["board_id"] != key:
                settled()
                key, size, named, board = row["board_id"], 0, [], None
            if row["kind"] == 0:
                size = row["no"]
            elif row["kind"] == 1:
                named.append(row)
            else:
                board = board or Board(size, named)
                board.apply(row)
            if len(out) >= ROWS:
                yield flushed()
    settled()
    if schema is not None:
        yield flushed()
