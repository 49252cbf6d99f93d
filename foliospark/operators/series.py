"""Density series: counts along an axis, smoothing, runs, bands, splits.

A series is a frame with ``series_id``, an integer ``pos`` from 0 without
holes, and a number per position. All work is cut at positions, so a very long
series is spread over tasks like many short ones.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.operators.bandmerge import merge_small_bands  # noqa: F401
from foliospark.scale import Running
from foliospark.settings import BandRules

RULES = BandRules()
KEY = ["series_id"]
MAX_FEW_PARTS = scale.MAX_BIG_GROUPS  # most parts of series that are broadcast
SCORE_DIGITS = 9  # valleys whose scores agree to so many digits are equal, and the first one wins


def project_counts(points: DataFrame, length: DataFrame | None = None, rows: int | None = None) -> DataFrame:
    """Marked points per position, with zeros in between.

    ``points`` has series_id and pos; ``length`` may give each series' number of
    positions, else it ends at its last point.
    """
    size = rows or scale.GROUP_ROWS
    counts = points.groupBy("series_id", "pos").agg(F.count(F.lit(1)).alias("value"))
    if length is None:
        length = points.groupBy("series_id").agg((F.max("pos") + 1).alias("length"))
    zero = F.lit(0).cast("bigint")
    # Two explodes: first the slices of a series, then the positions of a slice.
    last = F.col("length") - 1
    slices = length.where("length > 0").select(
        "series_id", "length", F.explode(F.sequence(zero, scale.slice_of(last, size))).alias("_s")
    )
    grid = slices.select(
        "series_id", F.explode(F.sequence(F.col("_s") * size, F.least(last, (F.col("_s") + 1) * size - 1))).alias("pos")
    )
    return grid.join(counts, ["series_id", "pos"], "left").withColumn("value", F.coalesce("value", zero))


def smooth(series: DataFrame, window: int, out: str = "smoothed", rows: int | None = None) -> DataFrame:
    """Centred moving average over ``window`` positions to each side, cut at the ends.

    Positions near a slice's border are also given to the neighbouring slice,
    so each slice has all it needs.
    """
    near = F.sequence(
        scale.slice_of(F.greatest(F.lit(0).cast("bigint"), F.col("pos") - window), rows),
        scale.slice_of(F.col("pos") + window, rows),
    )
    spread = series.withColumn(scale.SLICE, F.explode(near))
    frame = Window.partitionBy(*KEY, scale.SLICE).orderBy("pos").rowsBetween(-window, window)
    mean = F.sum("value").over(frame) / F.count("value").over(frame)
    made = spread.withColumn(out, mean)
    return made.where(F.col(scale.SLICE) == scale.slice_of("pos", rows)).drop(scale.SLICE)


def with_series_facts(series: DataFrame, *facts: Column, rows: int | None = None) -> DataFrame:
    cut = scale.by_position(series, "pos", rows)
    return scale.unsliced(scale.with_group_facts(cut, KEY, list(facts)))


def active_runs(series: DataFrame, threshold: Column, column: str = "value", rows: int | None = None) -> DataFrame:
    """Runs of positions at or above a threshold."""
    return scale.islands(series.where(F.col(column) >= threshold), KEY, "pos", 1, rows=rows)


def bands(series: DataFrame, rules: BandRules = RULES, column: str = "smoothed", rows: int | None = None) -> DataFrame:
    """Bands of dense rows; short gaps do not end a band.

    A row is dense if it reaches ``row_density_ratio`` of the series' maximum
    and the floor. A band ends after more than ``break_rows`` sparse rows; bands
    then join over gaps up to ``merge_gap``. Together: a step above the larger
    of both starts a new band. Low bands are left out.
    """
    held = with_series_facts(series, F.max(column).alias("_max"), rows=rows)
    threshold = F.greatest(F.lit(rules.row_density_floor), F.col("_max") * rules.row_density_ratio)
    step = max(rules.break_rows + 1, rules.merge_gap)
    found = scale.islands(held.where(F.col(column) >= threshold), KEY, "pos", step, rows=rows)
    return found.where(F.col("last") - F.col("first") >= rules.min_height)


def mask_bands(
    series: DataFrame, width: float, *, density: float = 0.0035, gap: int = 10, min_height: int = 18,
    rows: int | None = None,
) -> DataFrame:
    """Bands of a bright mask; the threshold is halved for a series without bands."""
    strict = max(2, int(width * density))
    loose = max(2, int(width * density * 0.5))
    held = with_series_facts(series, (F.max("value") >= strict).alias("_any"), rows=rows)
    threshold = F.when(F.col("_any"), strict).otherwise(loose)
    found = scale.islands(held.where(F.col("value") >= threshold), KEY, "pos", gap + 1, rows=rows)
    return found.where(F.col("last") - F.col("first") + 1 >= min_height)


def split_columns(
    series: DataFrame, column: str = "smoothed", *, low: float = 0.3, high: float = 0.7, valley_ratio: float = 0.22,
    gutter: int = 15, min_share: float = 0.2, page_width: Column | None = None, rows: int | None = None,
) -> DataFrame:
    """Where a two-column page splits, or no split.

    The lowest value in the middle of the width, leftmost on ties; accepted if
    low enough against the peak and both columns are wide enough.
    """
    sized = with_series_facts(series, F.count(F.lit(1)).alias("_n"), rows=rows)
    begin = F.floor(F.col("_n") * low)
    end = F.greatest(begin + 1, F.floor(F.col("_n") * high))
    middle = (F.col("pos") >= begin) & (F.col("pos") < end)
    found = sized.groupBy(*KEY, "_n").agg(
        F.max(column).alias("peak"), F.min(F.when(middle, F.struct(F.col(column).alias("v"), "pos"))).alias("_low")
    )
    split = F.col("_low.pos")
    wide = page_width if page_width is not None else F.col("_n")
    left_width = F.greatest(F.lit(0), split - gutter)
    right_width = F.greatest(F.lit(0), F.col("_n") - split - gutter)
    accept = (
        (F.col("_n") > 1) & (F.col("peak") > 0) & (F.col("_low.v") <= F.col("peak") * valley_ratio)
        & (left_width >= wide * min_share) & (right_width >= wide * min_share)
    )
    accept = F.coalesce(accept, F.lit(False))
    return found.select(
        *KEY, F.col("_n").alias("length"), F.when(accept, 2).otherwise(1).alias("column_count"),
        F.when(accept, split).alias("split_pos"), F.when(accept, left_width).otherwise(F.col("_n")).alias("left_width"),
        F.when(accept, right_width).alias("right_width"),
    )


def split_board_rows(
    series: DataFrame, column: str = "smoothed", *, low: float = 0.15, high: float = 0.85, valley_ratio: float = 0.82,
    min_height: int = 18, min_share: float = 0.1, rows: int | None = None,
) -> DataFrame:
    """Row where a tall board candidate splits in two, or no split."""
    sized = with_series_facts(series, F.count(F.lit(1)).alias("_n"), rows=rows)
    begin = F.floor(F.col("_n") * low)
    end = F.greatest(begin + 1, F.floor(F.col("_n") * high))
    middle = (F.col("pos") >= begin) & (F.col("pos") < end)
    found = sized.groupBy(*KEY, "_n").agg(
        F.max(column).alias("peak"), F.min(F.when(middle, F.struct(F.col(column).alias("v"), "pos"))).alias("_low")
    )
    split = F.col("_low.pos")
    lower = F.col("_n") - split
    accept = (
        (F.col("peak") > 0) & (F.col("_low.v") <= F.col("peak") * valley_ratio) & (split >= min_height)
        & (lower >= min_height) & (split >= F.col("_n") * min_share) & (lower >= F.col("_n") * min_share)
    )
    return found.select(*KEY, F.col("_n").alias("length"), F.when(accept, split).alias("split_pos"))


def valley_splits(series: DataFrame, width: Column, rules: BandRules = RULES, rows: int | None = None) -> DataFrame:
    """The best valley to split each series at.

    ``series`` has value (raw) and smoothed. Low stretches away from both ends
    are scored by depth, length and closeness to the middle; the first best
    one wins. ``width`` is the width of the parent box, constant per series.
    """
    held = with_series_facts(
        series.withColumn("_width", width.cast("double")),
        F.count(F.lit(1)).alias("_n"), F.max("smoothed").alias("_max"), F.sum("value").alias("_total"), rows=rows,
    )
    margin = F.greatest(F.lit(rules.min_height), F.floor(F.col("_n") * rules.split_margin_ratio))
    held = held.withColumn("_margin", margin).where(
        (F.col("_n") >= rules.split_min_height) & (F.col("_max") > 0) & (F.col("_width") > 1)
        & (F.col("_n") - F.col("_margin") * 2 > rules.min_valley_rows)
    )
    threshold = F.greatest(F.lit(rules.valley_floor), F.col("_max") * rules.valley_ratio)
    inside = (F.col("pos") >= F.col("_margin")) & (F.col("pos") < F.col("_n") - F.col("_margin"))
    page = [*KEY, "_n", "_max", "_total", "_width", "_margin"]
    low = scale.islands(
        held.where(inside & (F.col("smoothed") <= threshold)), page, "pos", 1, sums={"_depth_sum": F.col("smoothed")},
        rows=rows,
    )
    length = F.col("last") - F.col("first") + 1
    low = low.withColumns({"_length": length, "split_pos": F.floor((F.col("first") + F.col("last")) / 2)}).where(
        (F.col("_length") >= rules.min_valley_rows) & (F.col("split_pos") >= F.col("_margin"))
        & (F.col("_n") - F.col("split_pos") >= F.col("_margin"))
    )
    above = scale.running(
        scale.by_position(series, "pos", rows), KEY, [F.col("pos")], {"_above": Running("sum", F.col("value"), before=True)}
    ).select(*KEY, F.col("pos").alias("split_pos"), "_above")
    low = low.join(above, [*KEY, "split_pos"])
    dense, score = _valley_score(*map(F.col, ("_length", "_depth_sum", "split_pos", "_n", "_max", "_above", "_total", "_width")), rules)
    scored = low.where(dense >= rules.min_side_density).withColumn("score", score)
    best = scored.groupBy(*KEY).agg(F.min(F.struct(_falling(score).alias("s"), "split_pos", "score")).alias("_best"))
    return best.select(*KEY, F.col("_best.split_pos").alias("split_pos"), F.col("_best.score").alias("score"))


def _falling(score: Column) -> Column:
    """Orders scores from the best; equal ones differ in their last bits, by the order in which depths were added."""
    return -F.round(score, SCORE_DIGITS)


def _valley_score(
    length: Column, depth_sum: Column, split: Column, n: Column, peak: Column, above: Column, total: Column, width: Column, rules: BandRules
) -> tuple[Column, Column]:
    """The thinner of the two sides' densities, and how good a low stretch is to split at."""
    top_density = above / F.greatest(F.lit(1.0), split * width)
    bottom_density = (total - above) / F.greatest(F.lit(1.0), (n - split) * width)
    depth = F.lit(1.0) - F.least(F.lit(1.0), (depth_sum / length) / peak)
    off_centre = F.abs(split - n / 2.0) / F.greatest(F.lit(1.0), n / 2.0)
    score = depth * 2.2 + F.least(F.lit(1.0), length / F.lit(max(1.0, rules.min_valley_rows * 1.4))) - off_centre * 0.45
    return F.least(top_density, bottom_density), score


def range_index(series: DataFrame, window: int, rows: int | None = None) -> DataFrame:
    """A table that gives sums and marks of any stretch of a series by looking at its ends.

    Per position: ``cum`` (sum up to and with it), ``ahead`` and ``behind`` (cum of the positions ``window`` after and
    ``window`` + 1 before it, null past the ends), ``ink_prev`` and ``ink_next`` (nearest position with a value above 0, itself
    included), and its slice.
    """
    pos, ink = F.col("pos"), F.when(F.col("value") > 0, F.col("pos"))
    cut = scale.by_position(series.select(*KEY, "pos", "value"), "pos", rows)
    held = scale.running(cut, KEY, [pos], {"cum": Running("sum", F.col("value")), "ink_prev": Running("max", ink)})
    back = scale.by_position(held.drop(scale.SLICE).withColumn("_back", -pos), "_back", rows)
    back = scale.running(back, KEY, [F.col("_back")], {"ink_next": Running("max", -ink)})
    back = scale.unsliced(back).drop("_back").withColumn("ink_next", -F.col("ink_next"))
    zero = F.lit(0).cast("bigint")
    near = F.sequence(scale.slice_of(F.greatest(zero, pos - window), rows), scale.slice_of(pos + window + 1, rows))
    frame = Window.partitionBy(*KEY, scale.SLICE).orderBy("pos")
    spread = back.withColumn(scale.SLICE, F.explode(near)).withColumns(
        {"ahead": F.lead("cum", window).over(frame), "behind": F.lag("cum", window + 1).over(frame)}
    )
    return scale.staged(spread.where(F.col(scale.SLICE) == scale.slice_of("pos", rows)))


def recursive_splits(
    series: DataFrame, width: Column, rules: BandRules = RULES, rows: int | None = None
) -> DataFrame:
    """Split series at valleys, then the parts, to a fixed depth.

    Every level handles all open parts of all series at once. A part is kept whole if it is low, has no valley, or
    would leave a part that is empty, too low or below ``min_part_ratio`` of it. ``width`` is constant per series.
    A series that one task can hold meets its parts there, once a level; one that is longer than a slice is looked
    up in a range index. Returns series_id, part (its path of splits), low and high (exclusive) positions.
    """
    whole = series.groupBy(*KEY).agg(F.count(F.lit(1)).alias("_end"), F.max(width.cast("double")).alias("_w"), F.sum("value").alias("upto"))
    whole = scale.checkpointed(whole)
    long = whole.where(scale.slice_of(F.col("_end") - 1, rows) > 0)
    if long.isEmpty():
        return _short_splits(series, whole, rules)
    ids = long.select(*KEY)
    short = _short_splits(series.join(ids, KEY, "left_anti"), whole.join(ids, KEY, "left_anti"), rules)
    return short.unionByName(_long_splits(series.join(ids, KEY, "left_semi"), long, rules, rows))


def _short_splits(series: DataFrame, whole: DataFrame, rules: BandRules) -> DataFrame:
    """Splits of series that a task can hold. Only positions and values move, once a level."""
    window = max(4, rules.smooth_rows // 2)
    live = whole.select(*KEY, F.lit("").alias("part"), F.lit(0).cast("bigint").alias("low"), F.col("_end").cast("bigint").alias("high"), "_end", "_w")
    out, done = [*KEY, "part", "low", "high"], []
    for _ in range(rules.split_depth):
        cuts = _short_cuts(series, live.where(F.col("high") - F.col("low") >= rules.split_min_height), window, rules)
        sides = scale.checkpointed(_cut_sides(cuts, rules))
        fine = sides.groupBy(*KEY, "part").agg(F.bool_and("ok").alias("_fine")).where("_fine").select(*KEY, "part")
        done.append(live.join(fine, [*KEY, "part"], "left_anti").select(*out))
        children = sides.join(fine, [*KEY, "part"], "left_semi")
        live = scale.checkpointed(children.select(
            *KEY, F.concat("part", "s").alias("part"), F.col("new_low").alias("low"), F.col("new_high").alias("high"), "_end", "_w"
        ))
    for part in done:
        live = live.select(*out).unionByName(part)
    return live


def _short_cuts(series: DataFrame, parts: DataFrame, window: int, rules: BandRules) -> DataFrame:
    """The parts that have a valley, where they split (_at), and the first and last marks of both sides."""
    keys = [*KEY, "part"]
    found = series.select(*KEY, "pos", "value").join(parts.hint("merge"), KEY)
    found = found.where((F.col("pos") >= F.col("low")) & (F.col("pos") < F.col("high")))
    part = Window.partitionBy(*keys).orderBy("pos")
    near, before = part.rowsBetween(-window, window), part.rowsBetween(Window.unboundedPreceding, -1)
    every = part.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    n, pos = F.col("high") - F.col("low"), F.col("pos") - F.col("low")
    found = found.withColumns({
        "smoothed": F.try_divide(F.sum("value").over(near).cast("double"), F.count("value").over(near)),
        "_above": F.coalesce(F.sum("value").over(before), F.lit(0)), "_total": F.sum("value").over(every),
        "_margin": F.greatest(F.lit(rules.min_height), F.floor(n * rules.split_margin_ratio)),
    }).withColumn("_peak", F.max("smoothed").over(every))
    peak, margin = F.col("_peak"), F.col("_margin")
    open_ = (peak > 0) & (F.col("_w") > 1) & (n - margin * 2 > rules.min_valley_rows) & (pos >= margin) & (pos < n - margin)
    sparse = open_ & (F.col("smoothed") <= F.greatest(F.lit(rules.valley_floor), peak * rules.valley_ratio))
    found = found.withColumn("_sparse", F.coalesce(sparse, F.lit(False)))
    # A run of sparse positions is all that follows one that is not.
    found = found.withColumn("_run", F.sum(F.when(F.col("_sparse"), 0).otherwise(1)).over(part.rowsBetween(Window.unboundedPreceding, 0)))
    run = Window.partitionBy(*keys, "_run").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    low = F.col("_sparse")
    found = found.withColumns({
        "_first": F.min(F.when(low, pos)).over(run), "_last": F.max(F.when(low, pos)).over(run),
        "_depth_sum": F.sum(F.when(low, F.col("smoothed"))).over(run),
    })
    length, split = F.col("_last") - F.col("_first") + 1, F.floor((F.col("_first") + F.col("_last")) / 2)
    dense, score = _valley_score(length, F.col("_depth_sum"), split, n, peak, F.col("_above"), F.col("_total"), F.col("_w"), rules)
    good = (
        low & (pos == split) & (length >= rules.min_valley_rows) & (split >= margin) & (n - split >= margin)
        & (dense >= rules.min_side_density)
    )
    best = F.min(F.when(good, F.struct(_falling(score).alias("s"), F.col("pos").alias("at")))).over(Window.partitionBy(*keys))
    found = found.withColumn("_at", best["at"]).where("_at is not null")
    marked = F.when(F.col("value") > 0, F.col("pos"))
    first, last = F.when(F.col("pos") < F.col("_at"), marked), F.when(F.col("pos") >= F.col("_at"), marked)
    return found.groupBy(*keys, "low", "high", "_end", "_w", "_at").agg(
        F.min(first).alias("_a0"), (F.max(first) + 1).alias("_a1"), F.min(last).alias("_b0"), (F.max(last) + 1).alias("_b1")
    )


def _cut_sides(cuts: DataFrame, rules: BandRules) -> DataFrame:
    at = F.col("_at")
    sides = F.array(
        F.struct(F.lit("a").alias("s"), F.col("low").alias("lo"), at.alias("hi"), F.col("_a0").alias("_i0"), F.col("_a1").alias("_i1")),
        F.struct(F.lit("b").alias("s"), at.alias("lo"), F.col("high").alias("hi"), F.col("_b0").alias("_i0"), F.col("_b1").alias("_i1")),
    )
    return _trimmed(cuts.select("*", F.explode(sides).alias("side")).select("*", "side.*").drop("side"), rules)


def _long_splits(series: DataFrame, whole: DataFrame, rules: BandRules, rows: int | None) -> DataFrame:
    """Splits of series of any length. They are written once, as a range index; the smoothed value at a position of a
    part, the sums beside a valley and the marks at a part's ends are looked up there at every level, and never moved
    whole to the driver, however small its file is."""
    window = max(4, rules.smooth_rows // 2)
    index = range_index(series, window, rows)
    zero = F.lit(0).cast("bigint")
    live = scale.checkpointed(whole.select(
        *KEY, F.lit("").alias("part"), zero.alias("low"), F.col("_end").cast("bigint").alias("high"), zero.alias("before"), "upto", "_end", "_w"
    ))
    out, done = [*KEY, "part", "low", "high"], []
    for _ in range(rules.split_depth):
        few = live.count() <= MAX_FEW_PARTS
        cuts = _part_valleys(index, live.where(F.col("high") - F.col("low") >= rules.split_min_height), window, rules, few, rows)
        sides = scale.checkpointed(_sides(index, live.join(cuts, [*KEY, "part"]), rules, few))
        fine = sides.groupBy(*KEY, "part").agg(F.bool_and("ok").alias("_fine")).where("_fine").select(*KEY, "part")
        done.append(live.join(fine, [*KEY, "part"], "left_anti").select(*out))
        children = sides.join(fine, [*KEY, "part"], "left_semi")
        live = scale.checkpointed(_with_sums(index, children.select(
            *KEY, F.concat("part", "s").alias("part"), F.col("new_low").alias("low"), F.col("new_high").alias("high"), "_end", "_w"
        ), few))
    for part in done:
        live = live.select(*out).unionByName(part)
    return live


def _look_up(parts: DataFrame, index: DataFrame, keys: list[str], few: bool) -> DataFrame:
    """Join parts to positions of the index.

    Its file is so small for its rows that Spark would gather it in the driver. A counted few parts go to the index
    instead; with more, both sides are moved by key.
    """
    return F.broadcast(parts).join(index, keys) if few else parts.join(index.hint("merge"), keys)


def _part_valleys(index: DataFrame, parts: DataFrame, window: int, rules: BandRules, few: bool, rows: int | None) -> DataFrame:
    """Where each part splits, as (series_id, part, _at); parts without a valley give no row."""
    keys = [*KEY, "part"]
    first, last = scale.slice_of("low", rows), scale.slice_of(F.greatest(F.col("low"), F.col("high") - 1), rows)
    touched = parts.withColumn(scale.SLICE, F.explode(F.sequence(first, last)))
    found = _look_up(touched, index, [*KEY, scale.SLICE], few).where((F.col("pos") >= F.col("low")) & (F.col("pos") < F.col("high")))
    pos, low, high = F.col("pos"), F.col("low"), F.col("high")
    upper = F.when(pos + window >= high, F.col("upto")).otherwise(F.col("ahead"))
    lower = F.when(pos - window <= low, F.col("before")).otherwise(F.col("behind"))
    count = F.least(pos + window, high - 1) - F.greatest(pos - window, low) + 1
    n = high - low
    margin = F.greatest(F.lit(rules.min_height), F.floor(n * rules.split_margin_ratio))
    facts = ["low", "high", "before", "upto", "_w"]
    smoothed = found.select(*keys, *facts, pos.alias("_p"), (pos - low).alias("pos"), F.try_divide((upper - lower).cast("double"), count).alias("smoothed"))
    held = scale.with_group_facts(scale.by_position(smoothed, "pos", rows), keys, [F.max("smoothed").alias("_peak")])
    held = scale.unsliced(held).withColumn("_margin", margin)
    pos, peak, margin = F.col("pos"), F.col("_peak"), F.col("_margin")
    open_ = (peak > 0) & (F.col("_w") > 1) & (n - margin * 2 > rules.min_valley_rows) & (pos >= margin) & (pos < n - margin)
    sparse = held.where(open_ & (F.col("smoothed") <= F.greatest(F.lit(rules.valley_floor), peak * rules.valley_ratio)))
    runs = scale.islands(sparse, [*keys, *facts, "_peak", "_margin"], "pos", 1, sums={"_depth_sum": F.col("smoothed")}, rows=rows)
    length, split = F.col("last") - F.col("first") + 1, F.floor((F.col("first") + F.col("last")) / 2)
    runs = runs.withColumns({"_length": length, "_split": split}).where(
        (F.col("_length") >= rules.min_valley_rows) & (F.col("_split") >= margin) & (n - F.col("_split") >= margin)
    )
    sums = index.select(*KEY, F.col("pos").alias("_at"), (F.col("cum") - F.col("value")).alias("_cum"))
    runs = runs.withColumn("_at", (low + F.col("_split")).cast("bigint"))
    runs = _look_up(runs, sums, [*KEY, "_at"], few=False)  # runs may be many
    dense, score = _valley_score(
        F.col("_length"), F.col("_depth_sum"), F.col("_split"), n, F.col("_peak"), F.col("_cum") - F.col("before"), F.col("upto") - F.col("before"), F.col("_w"), rules
    )
    best = runs.where(dense >= rules.min_side_density).groupBy(*keys).agg(F.min(F.struct(_falling(score).alias("s"), "_at")).alias("_best"))
    return best.select(*keys, F.col("_best._at").alias("_at"))


def _sides(index: DataFrame, cut: DataFrame, rules: BandRules, few: bool) -> DataFrame:
    """Both sides of each split, trimmed to their marks, padded and grown, and whether each is large enough."""
    marks = index.select(*KEY, F.col("pos").alias("_look"), "ink_prev", "ink_next")
    looks = cut.select("*", F.explode(F.array(
        F.struct(F.lit("a").alias("s"), F.col("low").alias("lo"), F.col("_at").alias("hi")),
        F.struct(F.lit("b").alias("s"), F.col("_at").alias("lo"), F.col("high").alias("hi")),
    )).alias("side")).select("*", "side.*").drop("side")
    first = marks.select(*KEY, F.col("_look").alias("lo"), F.col("ink_next").alias("_i0"))
    last = marks.select(*KEY, (F.col("_look") + 1).alias("hi"), (F.col("ink_prev") + 1).alias("_i1"))
    held = _look_up(_look_up(looks, first, [*KEY, "lo"], few), last, [*KEY, "hi"], few)
    return _trimmed(held, rules)


def _trimmed(held: DataFrame, rules: BandRules) -> DataFrame:
    """Sides from lo to hi with their first mark and the place after their last one, padded and grown."""
    pad, grow, lo, hi = int(rules.slice_pad), int(rules.slice_grow), F.col("lo"), F.col("hi")
    low = F.greatest(F.lit(0), F.greatest(lo, F.col("_i0") - pad) - grow).cast("bigint")
    high = F.least(F.col("_end"), F.least(hi, F.col("_i1") + pad) + grow).cast("bigint")
    fits = (hi - lo >= rules.min_height) & (F.col("_i0") < hi)
    large = (high - low) >= (F.col("high") - F.col("low")) * rules.min_part_ratio
    ok = F.coalesce(fits & large, F.lit(False))
    return held.select(*KEY, "part", "s", "_end", "_w", ok.alias("ok"), low.alias("new_low"), high.alias("new_high"))


def _with_sums(index: DataFrame, parts: DataFrame, few: bool) -> DataFrame:
    """Add each part's sums before its low and up to its high."""
    sums = index.select(*KEY, "pos", "cum", "value")
    starts = sums.select(*KEY, F.col("pos").alias("low"), (F.col("cum") - F.col("value")).alias("before"))
    ends = sums.select(*KEY, (F.col("pos") + 1).alias("high"), F.col("cum").alias("upto"))
    return _look_up(_look_up(parts, starts, [*KEY, "low"], few), ends, [*KEY, "high"], few)
