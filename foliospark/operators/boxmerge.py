"""Joining the boxes of a page that overlap or lie close, from a flat table of boxes.

A round goes over a page's boxes by top and left; each joins the first settled box it belongs to (``together`` in
``functions.geometry``), or settles. Rounds go on until none joins. A settled box is not looked up by comparing all of them:

* those whose shadow on the horizontal axis overlaps the box's are found in a segment tree over the page's edges,
* those that reach down to it, or nearly, in a tree of bottoms over the settled boxes,
* those whose tops are level with it stand at the end of the settled boxes, since tops only grow.

Each of the three gives its settled boxes in order and on demand, so the first one that belongs is found after
few looks, and a round takes about n log n steps for n boxes. Up to ``FEW`` boxes are compared one by one, as
that takes less time than the trees.
"""

from __future__ import annotations

import heapq
from bisect import bisect_left, insort
from collections.abc import Iterator
from operator import itemgetter
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

NONE = 1 << 60
NEST_RATIO = 1.4
BATCH = 20_000  # boxes of a result batch
FEW = 64  # boxes of a round that need no trees


class Edges(NamedTuple):
    top: float
    left: float
    right: float
    bottom: float

    @property
    def area(self) -> float:
        return (self.right - self.left) * (self.bottom - self.top)


def joined(a: Edges, b: Edges) -> Edges:
    return Edges(min(a.top, b.top), min(a.left, b.left), max(a.right, b.right), max(a.bottom, b.bottom))


def belongs(a: Edges, b: Edges, gap_x: float, gap_y: float) -> bool:
    """``together`` for a settled box ``a`` and a box ``b`` that does not start above it."""
    if joined(a, b) in (a, b) and max(a.area, b.area) >= min(a.area, b.area) * NEST_RATIO:
        return False
    across, down = min(a.right, b.right) - max(a.left, b.left), min(a.bottom, b.bottom) - max(a.top, b.top)
    below, beside = b.top - a.bottom, b.left - a.right
    return (
        across > 0 or down > 0 or abs(b.top - a.top) <= gap_y
        or (0 <= below <= gap_y and across > -gap_x) or (0 <= beside <= gap_x and down > -gap_y)
    )


class Shadows:
    """Which settled boxes lie over a stretch of the axis: a segment tree whose nodes list the boxes that fill them."""

    def __init__(self, cells: int):
        self.size = 1 << max(cells - 1, 0).bit_length()
        self.own: list[list[int]] = [[] for _ in range(2 * self.size)]
        self.least = [NONE] * (2 * self.size)  # of the node and all below

    def _nodes(self, low: int, high: int) -> Iterator[int]:
        low, high = low + self.size, high + self.size
        while low < high:
            if low & 1:
                yield low
                low += 1
            if high & 1:
                high -= 1
                yield high
            low, high = low >> 1, high >> 1

    def add(self, low: int, high: int, number: int) -> None:
        for node in self._nodes(low, high):
            insort(self.own[node], number)
            while node and self.least[node] > number:
                self.least[node] = number
                node >>= 1

    def over(self, low: int, high: int) -> Iterator[int]:
        """Numbers of boxes over any cell from ``low`` to before ``high``, ascending, some more than once."""
        queue, above = [], set()
        for node in self._nodes(low, high):
            if self.least[node] < NONE:
                queue.append((self.least[node], node, -1))
            node >>= 1
            while node and node not in above:
                above.add(node)
                node >>= 1
        queue += [(self.own[node][0], node, 0) for node in above if self.own[node]]
        heapq.heapify(queue)
        while queue:
            number, node, at = heapq.heappop(queue)
            if at >= 0:
                yield number
                if at + 1 < len(self.own[node]):
                    heapq.heappush(queue, (self.own[node][at + 1], node, at + 1))
                continue
            if self.own[node]:
                heapq.heappush(queue, (self.own[node][0], node, 0))
            for child in (2 * node, 2 * node + 1) if node < self.size else ():
                if self.least[child] < NONE:
                    heapq.heappush(queue, (self.least[child], child, -1))


class Bottoms:
    """Bottoms of the settled boxes, as a tree of maxima."""

    def __init__(self, boxes: int):
        self.size = 1 << max(boxes - 1, 0).bit_length()
        self.most = [float("-inf")] * (2 * self.size)

    def set(self, number: int, bottom: float) -> None:
        node = number + self.size
        while node and self.most[node] < bottom:
            self.most[node] = bottom
            node >>= 1

    def reaching(self, height: float) -> Iterator[int]:
        """Numbers of boxes whose bottom is at ``height`` or below it, ascending."""
        stack = [1]
        while stack:
            node = stack.pop()
            if self.most[node] >= height:
                if node >= self.size:
                    yield node - self.size
                else:
                    stack += [2 * node + 1, 2 * node]


def scanned(boxes: list[tuple], gap_x: float, gap_y: float) -> list[tuple]:
    """``settled`` for few boxes: ``belongs`` with every settled box in turn, without making a box for each look."""
    out: list[tuple] = []
    for box in boxes:
        top, left, right, bottom = box
        for at, (t, l, r, b) in enumerate(out):  # noqa: E741
            across = (r if r < right else right) - (l if l > left else left)
            down = (b if b < bottom else bottom) - (t if t > top else top)
            if not (
                across > 0 or down > 0 or abs(top - t) <= gap_y
                or (0 <= top - b <= gap_y and across > -gap_x) or (0 <= left - r <= gap_x and down > -gap_y)
            ):
                continue
            if (l <= left and t <= top and r >= right and b >= bottom) or (l >= left and t >= top and r <= right and b <= bottom):
                one, other = (r - l) * (b - t), (right - left) * (bottom - top)
                if max(one, other) >= min(one, other) * NEST_RATIO:
                    continue
            out[at] = min(t, top), min(l, left), max(r, right), max(b, bottom)
            break
        else:
            out.append(box)
    return out


def settled(boxes: list[Edges], gap_x: float, gap_y: float) -> list[Edges]:
    """One round over boxes in order of top and left."""
    edges = sorted({x for b in boxes for x in (b.left, b.right)})
    cell = {x: i for i, x in enumerate(edges)}
    shadows, bottoms = Shadows(len(edges)), Bottoms(len(boxes))
    tops: list[float] = []
    out: list[Edges] = []
    for box in boxes:
        level = bisect_left(tops, box.top - gap_y)
        found = heapq.merge(
            shadows.over(cell[box.left], cell[box.right]), bottoms.reaching(box.top - gap_y), range(level, len(out))
        )
        at = next((i for i in found if belongs(out[i], box, gap_x, gap_y)), len(out))
        if at == len(out):
            out.append(box)
            tops.append(box.top)
            shadows.add(cell[box.left], cell[box.right], at)
        else:
            old, out[at] = out[at], joined(out[at], box)
            shadows.add(cell[out[at].left], cell[old.left], at)
            shadows.add(cell[old.right], cell[out[at].right], at)
        bottoms.set(at, out[at].bottom)
    return out


def merged(boxes: list[tuple], gap_x: float, gap_y: float) -> list[Edges]:
    """Rounds until no box joins; boxes with one corner keep their order."""
    corner = itemgetter(0, 1)
    boxes, before = sorted(boxes, key=corner), None
    while before != len(boxes):
        before = len(boxes)
        if before <= FEW:
            boxes = sorted(scanned(boxes, gap_x, gap_y), key=corner)
        else:
            boxes = sorted(settled([Edges(*b) for b in boxes], gap_x, gap_y), key=corner)
    return [Edges(*b) for b in boxes]


def merge_page_boxes(boxes: DataFrame, gap_x: float = 48.0, gap_y: float = 28.0) -> DataFrame:
    """The joined boxes of each page: page_id, box_no from 0 by top and left, and the box.

    ``boxes`` has page_id and box columns, a row for each box; other columns are not read. A negative or null extent is
    zero; a row without a left or top (null or NaN) is no box. A null page_id is a page. Boxes with one corner come
    in order of right and bottom. The rule lets any box of a page decide about any other, so the boxes of one page, 32
    bytes each, are one task's.
    """
    extent = [F.greatest(F.coalesce(F.nanvl(F.col(n).cast("double"), F.lit(0.0)), F.lit(0.0)), F.lit(0.0)) for n in ("width", "height")]
    left, top = F.col("left").cast("double"), F.col("top").cast("double")
    given = boxes.where(left.isNotNull() & top.isNotNull() & ~F.isnan(left) & ~F.isnan(top))
    edges = given.select(
        "page_id", top.alias("top"), left.alias("left"), (left + extent[0]).alias("right"), (top + extent[1]).alias("bottom")
    )
    ordered = edges.repartition("page_id").sortWithinPartitions("page_id", "top", "left", "right", "bottom")
    names = ["box_no", "left", "top", "width", "height"]

    def sweep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, page, held, out = None, None, [], []

        def flushed() -> pa.RecordBatch:
            columns = list(zip(*out)) or [()] * 6
            out.clear()
            types = [kind, pa.int32(), *[pa.float64()] * 4]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["page_id", *names])

        def finish() -> None:
            for number, b in enumerate(merged(held, gap_x, gap_y)):
                out.append((page, number, b.left, b.top, b.right - b.left, b.bottom - b.top))
            held.clear()

        for batch in batches:
            kind = batch.schema.field("page_id").type
            for key, *box in zip(*(c.to_pylist() for c in batch.columns)):
                if key != page and held:
                    finish()
                    if len(out) >= BATCH:
                        yield flushed()
                page = key
                held.append(tuple(box))
        if held:
            finish()
        if kind is not None:
            yield flushed()

    types = dict(boxes.dtypes)
    return ordered.mapInArrow(sweep, f"page_id {types['page_id']}, box_no int, left double, top double, width double, height double")
