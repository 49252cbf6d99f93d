"""Low bands join their nearer neighbour (G1), over series of any length.

The rule looks for the topmost low band with a near neighbour, joins it to the nearer one (the upper on a tie) and starts
over. Read downwards, all bands above the one at hand are settled, and only two things about them matter: either the
last one is settled (state *settled*), or it is low and *open*: known by its start and its gap upwards, it takes in bands
from below until it is tall, or until the gap below is no smaller than the one above and it joins upwards.

A long series is cut into slices of band numbers. From any open band that comes in, the bands settle within the few
that fit in a low height; from there on the slice goes one of a few ways. So a slice is summed up by its first few
bands and, for each of them, the state at the slice's end if that band settles. These summaries are folded, one
row for each slice, and tell every slice its incoming state and what becomes of the band it leaves open.
"""

from __future__ import annotations

from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.scale import Running
from foliospark.settings import BandRules

FAR = 1 << 60


class Open(NamedTuple):
    """A low band that may still grow: its start, and the gap above it (``FAR`` if that is not near)."""

    start: int
    above: int


class Walker:
    """Walks down consecutive bands (firsts, lasts) under the rule's two thresholds."""

    def __init__(self, firsts: list[int], lasts: list[int], small: int, near: int):
        self.firsts, self.lasts, self.small, self.near = firsts, lasts, small, near

    def grow(self, i: int, band: Open, end: int) -> tuple[int | None, bool]:
        """Let an open band that ends at ``end`` take in bands from ``i`` on.

        Returns the last band taken once it is settled (None if the bands end first), and whether it joins upwards.
        """
        while i < len(self.firsts):
            below = self.firsts[i] - end
            if below >= band.above or below > self.near:
                return i - 1, band.above <= self.near
            end = self.lasts[i]
            i += 1
            if end - band.start > self.small:
                return i - 1, False
        return None, False

    def opened(self, i: int, end: int) -> Open | None:
        """Band ``i`` after a settled one that ends at ``end``; None if it is tall."""
        if self.lasts[i] - self.firsts[i] > self.small:
            return None
        gap = self.firsts[i] - end
        return Open(self.firsts[i], gap if gap <= self.near else FAR)

    def exits(self, upto: int) -> list[Open | None]:
        """For each of the first ``upto`` bands: what the bands end in if that band is settled there."""
        known: dict[int, Open | None] = {}
        for begin in range(upto):
            path, at, found = [], begin, None
            while at not in known:
                path.append(at)
                if at + 1 == len(self.firsts):
                    break
                band = self.opened(at + 1, self.lasts[at])
                if band is None:
                    at += 1
                    continue
                at, _ = self.grow(at + 2, band, self.lasts[at + 1])
                if at is None:
                    found = band
                    break
            else:
                found = known[at]
            known.update(dict.fromkeys(path, found))
        return [known[i] for i in range(upto)]

    def joins(self, band: Open | None, end: int, tail_joins: bool | None) -> list[bool]:
        """Which bands join the one before them, given what comes in; ``tail_joins`` None: nothing follows."""
        out = [False] * len(self.firsts)
        at = -1
        if band is not None:
            at, _ = self.grow(0, band, end)
            last = len(out) - 1 if at is None else at
            out[: last + 1] = [True] * (last + 1)
            if at is None:
                return out
        while at + 1 < len(out):
            i = at + 1
            band = self.opened(i, self.lasts[at] if at >= 0 else end)
            if band is None:
                at = i
                continue
            at, out[i] = self.grow(i + 1, band, self.lasts[i])
            last = len(out) - 1 if at is None else at
            out[i + 1 : last + 1] = [True] * (last - i)
            if at is None:
                out[i] = band.above <= self.near if tail_joins is None else tail_joins
                break
        return out


def head_of(firsts: list[int], lasts: list[int], small: int) -> int:
    """How many bands it takes until one is settled whatever comes in; all if there are too few."""
    return next((i + 1 for i, last in enumerate(lasts) if last - firsts[0] > small), len(firsts))


def folded(slices: list[dict], small: int, near: int) -> list[tuple[Open | None, int, bool]]:
    """For the slices of a series in order: the state and end that come in, and whether the band left open joins upwards."""
    out: list[list] = []
    waiting: list[int] = []  # slices that end in the band that is open now
    band, end = None, -FAR
    for number, s in enumerate(slices):
        out.append([band, end, False])
        head = Walker(s["firsts"], s["lasts"], small, near)
        at = -1
        if band is not None:
            at, joins = head.grow(0, band, end)
            if at is not None:
                for w in waiting:
                    out[w][2] = joins
                waiting, band = [], None
        while at is not None and at < 0 and band is None:
            band = head.opened(0, end)
            at = 0 if band is None else head.grow(1, band, s["lasts"][0])[0]
            if at is not None:
                band = None
        if at is not None:
            start, above = s["starts"][at], s["aboves"][at]
            band = None if start is None or start != start else Open(int(start), int(above))
        if band is not None:
            waiting.append(number)
        end = s["end"]
    for w in waiting:
        out[w][2] = band.above <= near
    return [tuple(row) for row in out]


def merge_small_bands(bands_frame: DataFrame, rules: BandRules = BandRules(), part_bands: int | None = None) -> DataFrame:
    """Low bands join their nearer neighbour if it is near enough (G1).

    ``bands_frame`` has series_id, first and last; the bands of a series do not overlap, as ``bands`` gives them.
    A task takes a whole series, or ``part_bands`` consecutive bands of one that has more.
    """
    small, near = rules.small_height, rules.near_gap
    key = bands_frame.select(F.col("series_id").alias("s")).schema["s"].dataType.simpleString()
    given = bands_frame.select("series_id", F.col("first").cast("bigint").alias("first"), F.col("last").cast("bigint").alias("last"))
    size = part_bands or scale.GROUP_ROWS
    if given.groupBy("series_id").count().where(F.col("count") > size).isEmpty():

        def whole(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values("first", ignore_index=True)
            joins = Walker(pdf["first"].tolist(), pdf["last"].tolist(), small, near).joins(None, -FAR, None)
            pdf["_group"] = (~pd.Series(joins, dtype=bool)).cumsum()
            merged = pdf.groupby("_group").agg(first=("first", "min"), last=("last", "max"))
            return merged.assign(series_id=pdf["series_id"].iloc[0])[["series_id", "first", "last"]]

        return given.groupBy("series_id").applyInPandas(whole, f"series_id {key}, first bigint, last bigint")

    ranked = scale.rank(given, ["series_id"], [F.col("first")], "_no", rows=size)
    ranked = scale.by_position(ranked.withColumn("_no", F.col("_no") - 1), "_no", size)
    ranked = scale.staged(ranked.withColumn("_key", F.struct(F.lit(0).alias("_"), "series_id")))  # null is a key as well

    def summed(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first")
        firsts, lasts = pdf["first"].tolist(), pdf["last"].tolist()
        head = head_of(firsts, lasts, small)
        exits = Walker(firsts, lasts, small, near).exits(head)
        return pd.DataFrame({
            "series_id": [pdf["series_id"].iloc[0]], scale.SLICE: [pdf[scale.SLICE].iloc[0]], "firsts": [firsts[:head]], "lasts": [lasts[:head]],
            "starts": [[b and b.start for b in exits]], "aboves": [[b and b.above for b in exits]], "end": [lasts[-1]],
        })

    def spread(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(scale.SLICE)
        found = folded(pdf.to_dict("records"), small, near)
        return pd.DataFrame({
            "series_id": pdf["series_id"].iloc[0], scale.SLICE: pdf[scale.SLICE].tolist(), "start": pd.array([b and b.start for b, *_ in found], "Int64"),
            "above": pd.array([b and b.above for b, *_ in found], "Int64"), "end": [e for _, e, _ in found], "tail": [j for *_, j in found],
        })

    def walked(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("first", ignore_index=True)
        row = pdf.iloc[0]
        band = None if pd.isna(row["start"]) else Open(int(row["start"]), int(row["above"]))
        joins = Walker(pdf["first"].tolist(), pdf["last"].tolist(), small, near).joins(band, int(row["end"]), bool(row["tail"]))
        return pdf[["series_id", "first", "last", "_no"]].assign(_cut=[int(not j) for j in joins])

    lists = "firsts array<bigint>, lasts array<bigint>, starts array<bigint>, aboves array<bigint>, end bigint"
    summaries = ranked.groupBy("series_id", scale.SLICE).applyInPandas(summed, f"series_id {key}, {scale.SLICE} bigint, {lists}")
    states = summaries.groupBy("series_id").applyInPandas(
        spread, f"series_id {key}, {scale.SLICE} bigint, start bigint, above bigint, end bigint, tail boolean"
    )
    states = scale.staged(states).select(F.struct(F.lit(0).alias("_"), "series_id").alias("_key"), scale.SLICE, "start", "above", "end", "tail")
    cut = ranked.join(states, ["_key", scale.SLICE]).groupBy("series_id", scale.SLICE).applyInPandas(
        walked, f"series_id {key}, first bigint, last bigint, _no bigint, _cut int"
    )
    numbered = scale.running(scale.by_position(cut, "_no", size), ["series_id"], [F.col("_no")], {"_band": Running("sum", F.col("_cut"))})
    return numbered.groupBy("series_id", "_band").agg(F.min("first").alias("first"), F.max("last").alias("last")).drop("_band")
