"""Series operators against short loops over the same rules."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark.operators import series
from foliospark.settings import BandRules

RULES = BandRules(
    smooth_rows=2, row_density_floor=1.0, row_density_ratio=0.2, min_height=3, break_rows=2, merge_gap=5, small_height=12,
    near_gap=9, split_min_height=30, valley_ratio=0.4, valley_floor=0.5, min_valley_rows=3, min_side_density=0.0001,
    split_depth=2, slice_pad=2, slice_grow=1,
)


@pytest.fixture(scope="module")
def values():
    rng = random.Random(8)
    out = {}
    for k in ("a", "b", "c", "d"):
        vs = []
        while len(vs) < 150:
            vs += [rng.choice([0, 0, rng.randint(3, 9)])] * rng.randint(1, 12)
        out[k] = vs[:150]
    return out


@pytest.fixture(scope="module")
def frame(spark, values):
    return spark.createDataFrame([(k, i, v) for k, vs in values.items() for i, v in enumerate(vs)], "series_id string, pos bigint, value bigint")


def mean(vs, w):
    return [sum(vs[max(0, i - w): i + w + 1]) / len(vs[max(0, i - w): i + w + 1]) for i in range(len(vs))]


@pytest.mark.parametrize("rows", [None, 40])
def test_project_and_smooth(spark, values, frame, rows):
    points = frame.where("value > 0").select("series_id", "pos", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("value"))))
    length = spark.createDataFrame([(k, len(vs)) for k, vs in values.items()], "series_id string, length bigint")
    counts = series.project_counts(points, length, rows=rows)
    got = series.smooth(counts, 3, rows=rows).collect()
    assert len(got) == 600
    for k, vs in values.items():
        smoothed = mean(vs, 3)
        for r in got:
            if r.series_id == k:
                assert r.value == vs[r.pos] and r.smoothed == pytest.approx(smoothed[r.pos])


def band_loop(vs, rules):
    """Bands as the rule says it, in two steps: tolerate sparse rows, then join near bands."""
    limit = max(rules.row_density_floor, max(vs) * rules.row_density_ratio)
    raw, start, last = [], None, None
    for i, v in enumerate(vs):
        if v >= limit:
            start = i if start is None else start
            last = i
        elif start is not None and i - last > rules.break_rows:
            raw.append([start, last])
            start = None
    if start is not None:
        raw.append([start, last])
    joined = []
    for a, b in raw:
        if joined and a - joined[-1][1] <= rules.merge_gap:
            joined[-1][1] = b
        else:
            joined.append([a, b])
    return [(a, b) for a, b in joined if b - a >= rules.min_height]


@pytest.mark.parametrize("rows", [None, 17])
def test_bands(values, frame, rows):
    smoothed = series.smooth(frame, RULES.smooth_rows, rows=rows)
    got = {(r.series_id, r["first"], r["last"]) for r in series.bands(smoothed, RULES, rows=rows).collect()}
    expected = {(k, a, b) for k, vs in values.items() for a, b in band_loop(mean(vs, RULES.smooth_rows), RULES)}
    assert got == expected and expected


def small_band_loop(bands, rules):
    """Take the topmost band that may merge, merge it, start over."""
    bands = [list(b) for b in bands]
    while True:
        for i, (top, bottom) in enumerate(bands):
            above = top - bands[i - 1][1] if i else 10**9
            below = bands[i + 1][0] - bottom if i + 1 < len(bands) else 10**9
            if bottom - top <= rules.small_height and min(above, below) <= rules.near_gap:
                j = i + 1 if below < above else i - 1
                a, b = sorted((i, j))
                bands[a: b + 1] = [[bands[a][0], max(bands[a][1], bands[b][1])]]
                break
        else:
            return [tuple(b) for b in bands]


@pytest.mark.parametrize("part", [None, 4])
def test_small_bands(spark, part):
    rng = random.Random(4)
    layout = {}
    for k in range(40):
        at, bands = 0, []
        for _ in range(rng.randint(1, 12)):
            top = at + rng.randint(1, 14)
            at = top + rng.randint(3, 20)
            bands.append((top, at))
        layout[f"s{k}"] = bands
    df = spark.createDataFrame([(k, a, b) for k, bs in layout.items() for a, b in bs], "series_id string, first bigint, last bigint")
    got = {(r.series_id, r["first"], r["last"]) for r in series.merge_small_bands(df, RULES, part).collect()}
    assert got == {(k, a, b) for k, bs in layout.items() for a, b in small_band_loop(bs, RULES)}


def valley_loop(vs, width, rules):
    n = len(vs)
    smoothed = mean(vs, max(4, rules.smooth_rows // 2))
    margin = max(rules.min_height, int(n * rules.split_margin_ratio))
    top = max(smoothed) if smoothed else 0
    if n < rules.split_min_height or top <= 0 or n - 2 * margin <= rules.min_valley_rows:
        return None
    limit = max(rules.valley_floor, top * rules.valley_ratio)
    best, runs = None, []
    for i in range(margin, n - margin):
        if smoothed[i] <= limit:
            if runs and runs[-1][1] == i - 1:
                runs[-1][1] = i
            else:
                runs.append([i, i])
    for a, b in runs:
        size, at = b - a + 1, (a + b) // 2
        if size < rules.min_valley_rows or at < margin or n - at < margin:
            continue
        if min(sum(vs[:at]) / max(1, at * width), sum(vs[at:]) / max(1, (n - at) * width)) < rules.min_side_density:
            continue
        depth = 1 - min(1, sum(smoothed[a: b + 1]) / size / top)
        score = depth * 2.2 + min(1, size / max(1, rules.min_valley_rows * 1.4)) - abs(at - n / 2) / max(1, n / 2) * 0.45
        if best is None or score > best[0] + 1e-12:
            best = (score, at)
    return best[1] if best else None


@pytest.mark.parametrize("rows", [None, 23])
def test_valley(values, frame, rows):
    smoothed = series.smooth(frame, 4, rows=rows)
    got = {r.series_id: r.split_pos for r in series.valley_splits(smoothed, F.lit(10.0), RULES, rows=rows).collect()}
    assert got == {k: s for k, vs in values.items() if (s := valley_loop(vs, 10.0, RULES)) is not None} and got


def split_loop(vs, low, high, depth, rules):
    at = valley_loop(vs[low:high], 10.0, rules) if depth < rules.split_depth else None
    if at is None:
        return [(low, high)]
    parts = []
    for a, b in ((low, low + at), (low + at, high)):
        marks = [i for i in range(a, b) if vs[i] > 0]
        if b - a < rules.min_height or not marks:
            return [(low, high)]
        pad, grow = int(rules.slice_pad), int(rules.slice_grow)
        c = max(0, max(a, marks[0] - pad) - grow)
        d = min(len(vs), min(b, marks[-1] + 1 + pad) + grow)
        if d - c < (high - low) * rules.min_part_ratio:
            return [(low, high)]
        parts.append((c, d))
    return [p for c, d in parts for p in split_loop(vs, c, d, depth + 1, rules)]


def test_equal_valleys_split_at_the_first(spark):
    """Two valleys with one score, but for the last bits of their sums."""
    low = [2, 3, 3, 0, 0, 0, 0, 0, 2, 2, 2, 0]
    vs = [7] * 16 + low + [7] * 11 + low[::-1] + [7] * 14
    df = spark.createDataFrame([("s", i, v) for i, v in enumerate(vs)], "series_id string, pos bigint, value bigint")
    assert [r.split_pos for r in series.valley_splits(series.smooth(df, 4), F.lit(10.0), RULES).collect()] == [valley_loop(vs, 10.0, RULES)] == [21]
    got = sorted((r.low, r.high) for r in series.recursive_splits(df, F.lit(10.0), RULES).collect())
    assert got == split_loop(vs, 0, len(vs), 0, RULES) and got[0][1] < 30


@pytest.mark.parametrize("rows", [None, 60])
def test_recursive_splits(values, frame, rows):
    got = sorted((r.series_id, r.low, r.high) for r in series.recursive_splits(frame, F.lit(10.0), RULES, rows=rows).collect())
    expected = sorted((k, a, b) for k, vs in values.items() for a, b in split_loop(vs, 0, len(vs), 0, RULES))
    assert got == expected and len(expected) > len(values)


def test_short_series_need_no_index(values, frame, spark, monkeypatch):
    """Only a series longer than a slice is looked up in an index, here one of five."""
    indexed, index = [], series.range_index

    def counted(some, *rest):
        indexed.extend(r.series_id for r in some.select("series_id").distinct().collect())
        return index(some, *rest)

    monkeypatch.setattr(series, "range_index", counted)
    held = values | {"long": values["a"] + values["b"]}
    rows = [(k, i, v) for k, vs in held.items() for i, v in enumerate(vs)]
    df = spark.createDataFrame(rows, frame.schema)
    got = sorted((r.series_id, r.low, r.high) for r in series.recursive_splits(df, F.lit(10.0), RULES, rows=200).collect())
    assert got == sorted((k, a, b) for k, vs in held.items() for a, b in split_loop(vs, 0, len(vs), 0, RULES))
    assert indexed == ["long"]


def test_columns(spark):
    vs = [10] * 45 + [0] * 60 + [10] * 35
    df = spark.createDataFrame([("s", i, v, float(v)) for i, v in enumerate(vs)] + [("t", 0, 1, 1.0)], "series_id string, pos bigint, value bigint, smoothed double")
    got = {r.series_id: r for r in series.split_columns(df).collect()}
    assert (got["s"].column_count, got["s"].split_pos, got["s"].left_width, got["s"].right_width) == (2, 45, 30, 80)
    assert got["t"].column_count == 1 and got["t"].split_pos is None


@pytest.mark.parametrize("few", [True, False])
def test_range_index_is_never_broadcast(spark, few):
    """A long series packs into a tiny file; looking it up moves the parts, not the index."""
    value = F.when(F.col("pos") % 200 < 120, 40).otherwise(0).cast("bigint").alias("value")
    made = spark.range(20_000).select((F.col("id") % 2).alias("series_id"), F.floor(F.col("id") / 2).alias("pos")).select("*", value)
    index = series.range_index(made, 5)
    schema = "series_id bigint, part string, low bigint, high bigint"
    plan = series._with_sums(index, spark.createDataFrame([(0, "", 0, 10_000), (1, "a", 200, 400)], schema), few)
    assert sorted((r.series_id, r.before, r.upto) for r in plan.collect()) == [(0, 0, 240_000), (1, 4_800, 9_600)]
    text = plan._jdf.queryExecution().executedPlan().toString()
    assert ("BroadcastHashJoin" in text) == few
    assert "BuildRight" not in text  # the index is on the right
