"""Density series over the event table: one series per user, one position per hour."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark import scale
from foliospark.operators import series
from foliospark.plans import oracle as o
from foliospark.plans.bindings import Tables
from foliospark.plans.registry import query
from foliospark.settings import BandRules

# Thresholds that suit counts of a few events per hour.
SPARSE = BandRules(
    row_density_floor=0.05, row_density_ratio=0.3, min_height=6, break_rows=4, merge_gap=7, small_height=20, near_gap=12,
    split_min_height=60, valley_ratio=0.4, valley_floor=0.02, min_valley_rows=3, min_side_density=0.0001,
)

o.cte("v_series", """
SELECT g.series_id, g.pos, coalesce(c.value, 0) AS value
FROM (SELECT series_id, unnest(range(CAST(max(pos) + 1 AS BIGINT))) AS pos FROM v_marks GROUP BY series_id) g
LEFT JOIN (SELECT series_id, pos, count(*) AS value FROM v_marks GROUP BY series_id, pos) c
  ON g.series_id = c.series_id AND g.pos = c.pos
""")


def moving(window: int) -> str:
    frame = f"(PARTITION BY series_id ORDER BY pos ROWS BETWEEN {window} PRECEDING AND {window} FOLLOWING)"
    return f"SELECT *, CAST(sum(value) OVER {frame} AS DOUBLE) / count(value) OVER {frame} AS smoothed FROM v_series"


o.cte("v_smooth", moving(10))
o.cte("v_smooth_cols", moving(20))
o.cte("v_smooth_rows", moving(7))
o.cte("v_smooth_split", moving(5))


def runs(source: str, step: int, keep: str = "TRUE") -> str:
    """First and last position of runs whose steps are at most ``step``."""
    return f"""
SELECT series_id, min(pos) AS first, max(pos) AS last
FROM (SELECT *, sum(CAST(p IS NULL OR pos - p > {step} AS INT)) OVER (PARTITION BY series_id ORDER BY pos) AS run
      FROM (SELECT *, lag(pos) OVER (PARTITION BY series_id ORDER BY pos) AS p FROM ({source})))
GROUP BY series_id, run HAVING {keep}
"""


def counts(t: Tables):
    return series.project_counts(t.marks)


def smoothed(t: Tables, window: int = 10):
    """Smoothed series as a table; the operators on it take several looks."""
    return scale.staged(series.smooth(counts(t), window))


@query("project_counts", "SELECT * FROM v_series")
def _(t):
    return counts(t)


@query("smooth_series", "SELECT series_id, pos, value, smoothed FROM v_smooth")
def _(t):
    return series.smooth(counts(t), 10)


@query("active_runs", runs("SELECT * FROM v_series WHERE value >= 1", 1))
def _(t):
    return series.active_runs(scale.staged(counts(t)), F.lit(1))


DENSE = """SELECT * FROM (SELECT *, max(smoothed) OVER (PARTITION BY series_id) AS m FROM v_smooth)
WHERE smoothed >= greatest(0.05::DOUBLE, m * 0.3::DOUBLE)"""


@query("row_bands", runs(DENSE, 7, "max(pos) - min(pos) >= 6"))
def _(t):
    return series.bands(smoothed(t), SPARSE)


@query("mask_bands", runs("""SELECT * FROM (SELECT *, max(value) OVER (PARTITION BY series_id) >= 3 AS a FROM v_series)
WHERE value >= CASE WHEN a THEN 3 ELSE 2 END""", 11, "max(pos) - min(pos) + 1 >= 4"))
def _(t):
    return series.mask_bands(scale.staged(counts(t)), 1000.0, min_height=4)


def lowest(source: str, low: float, high: float) -> str:
    return f"""
SELECT series_id, n, max(smoothed) AS peak, arg_min(pos, (smoothed, pos)) FILTER (inside) AS split,
       min(smoothed) FILTER (inside) AS v
FROM (SELECT *, pos >= floor(n * {low}::DOUBLE) AND pos < greatest(floor(n * {low}::DOUBLE) + 1, floor(n * {high}::DOUBLE)) AS inside
      FROM (SELECT *, count(*) OVER (PARTITION BY series_id) AS n FROM {source}))
GROUP BY series_id, n
"""


@query("split_columns", f"""
SELECT series_id, n AS length, CASE WHEN ok THEN 2 ELSE 1 END AS column_count, CASE WHEN ok THEN CAST(split AS DOUBLE) END AS split_pos,
       CASE WHEN ok THEN split - 15 ELSE n END AS left_width, CASE WHEN ok THEN CAST(n - split - 15 AS DOUBLE) END AS right_width
FROM (SELECT *, n > 1 AND peak > 0 AND v <= peak * 0.22::DOUBLE AND split - 15 >= n * 0.2::DOUBLE
             AND n - split - 15 >= n * 0.2::DOUBLE AS ok
      FROM ({lowest("v_smooth_cols", 0.3, 0.7)}))
""")
def _(t):
    made = series.split_columns(smoothed(t, 20))
    return made.withColumns({n: F.col(n).cast("double") for n in ("split_pos", "right_width")})


@query("split_board_rows", f"""
SELECT series_id, n AS length, CASE WHEN peak > 0 AND v <= peak * 0.82::DOUBLE AND split >= 18 AND n - split >= 18
       AND split >= n * 0.1::DOUBLE AND n - split >= n * 0.1::DOUBLE THEN CAST(split AS DOUBLE) END AS split_pos
FROM ({lowest("v_smooth_rows", 0.15, 0.85)})
""")
def _(t):
    made = series.split_board_rows(smoothed(t, 7))
    return made.withColumn("split_pos", F.col("split_pos").cast("double"))


o.cte("v_valley_base", """
SELECT *, greatest(6, CAST(floor(n * 0.18::DOUBLE) AS BIGINT)) AS margin
FROM (SELECT *, count(*) OVER w AS n, max(smoothed) OVER w AS peak, CAST(sum(value) OVER w AS BIGINT) AS total,
             CAST(sum(value) OVER (PARTITION BY series_id ORDER BY pos) - value AS BIGINT) AS above
      FROM v_smooth_split WINDOW w AS (PARTITION BY series_id))
""")
o.cte("v_valley_rows", """
SELECT *, pos - row_number() OVER (PARTITION BY series_id ORDER BY pos) AS run
FROM v_valley_base
WHERE n >= 60 AND peak > 0 AND n - margin * 2 > 3 AND pos >= margin AND pos < n - margin
  AND smoothed <= greatest(0.02::DOUBLE, peak * 0.4::DOUBLE)
""")
o.cte("v_valley_runs", """
SELECT series_id, n, peak, total, margin, (min(pos) + max(pos)) // 2 AS split_pos, count(*) AS len, sum(smoothed) AS s
FROM v_valley_rows GROUP BY series_id, n, peak, total, margin, run HAVING count(*) >= 3
""")
o.cte("v_valleys", """
SELECT r.series_id, r.split_pos,
       (1 - least(1, (s / len) / r.peak)) * 2.2::DOUBLE + least(1, len / (3 * 1.4::DOUBLE))
       - abs(r.split_pos - r.n / 2) / greatest(1, r.n / 2) * 0.45::DOUBLE AS score
FROM v_valley_runs r JOIN v_valley_base b ON r.series_id = b.series_id AND b.pos = r.split_pos
WHERE r.split_pos >= r.margin AND r.n - r.split_pos >= r.margin
  AND least(b.above / greatest(1, r.split_pos * 10.0::DOUBLE), (r.total - b.above) / greatest(1, (r.n - r.split_pos) * 10.0::DOUBLE)) >= 0.0001::DOUBLE
""")


@query("valley_splits", """
SELECT series_id, split_pos, round(score, 6) AS score
FROM (SELECT *, row_number() OVER (PARTITION BY series_id ORDER BY round(score, 9) DESC, split_pos) AS r FROM v_valleys) WHERE r = 1
""")
def _(t):
    found = series.valley_splits(smoothed(t, 5), F.lit(10.0), SPARSE)
    return found.withColumn("score", F.round("score", 6))


_ABOVE = "CASE WHEN i > 1 THEN l[i].a - l[i - 1].b ELSE 1000000000 END"
_BELOW = "CASE WHEN i < len(l) THEN l[i + 1].a - l[i].b ELSE 1000000000 END"


@query("merge_small_bands", f"""
, lists AS (
    SELECT series_id, list(struct_pack(a := first, b := last) ORDER BY first) AS l FROM ({runs(DENSE, 7, "max(pos) - min(pos) >= 6")}) GROUP BY series_id
), rounds AS (
    SELECT series_id, l, 0 AS step FROM lists
    UNION ALL
    SELECT series_id, list_slice(l, 1, lo - 1) || [struct_pack(a := l[lo].a, b := greatest(l[lo].b, l[lo + 1].b))] || list_slice(l, lo + 2, len(l)), step + 1
    FROM (SELECT *, CASE WHEN {_BELOW} < {_ABOVE} THEN i ELSE i - 1 END AS lo
          FROM (SELECT *, list_filter(range(1, len(l) + 1), lambda i: l[i].b - l[i].a <= 20 AND least({_ABOVE}, {_BELOW}) <= 12)[1] AS i FROM rounds)
          WHERE i IS NOT NULL)
)
SELECT series_id, x.a AS first, x.b AS last FROM (SELECT series_id, unnest(arg_max(l, step)) AS x FROM rounds GROUP BY series_id)
""")
def _(t):
    return series.merge_small_bands(scale.staged(series.bands(smoothed(t), SPARSE)), SPARSE)


def split_level(k: int) -> str:
    """One level of splits in SQL: parts p<k> give the whole ones d<k> and the parts p<k + 1>."""
    return f"""
, r{k} AS (
    SELECT p.series_id, part, low, high, high - low AS n, pos, pos - low AS q, value,
           CAST(sum(value) OVER f AS DOUBLE) / count(value) OVER f AS smoothed, sum(value) OVER (PARTITION BY p.series_id, part ORDER BY pos) - value AS above,
           sum(value) OVER (PARTITION BY p.series_id, part) AS total, greatest(6, CAST(floor((high - low) * 0.18::DOUBLE) AS BIGINT)) AS margin
    FROM p{k} p JOIN v_series s ON s.series_id = p.series_id AND pos >= low AND pos < high WHERE high - low >= 60
    WINDOW f AS (PARTITION BY p.series_id, part ORDER BY pos ROWS BETWEEN 5 PRECEDING AND 5 FOLLOWING)
), m{k} AS (
    SELECT *, max(smoothed) OVER (PARTITION BY series_id, part) AS peak FROM r{k}
), l{k} AS (
    SELECT *, q - row_number() OVER (PARTITION BY series_id, part ORDER BY q) AS run FROM m{k}
    WHERE peak > 0 AND n - margin * 2 > 3 AND q >= margin AND q < n - margin AND smoothed <= greatest(0.02::DOUBLE, peak * 0.4::DOUBLE)
), v{k} AS (
    SELECT series_id, part, low, high, n, peak, total, margin, (min(q) + max(q)) // 2 AS split, count(*) AS len, sum(smoothed) AS s
    FROM l{k} GROUP BY series_id, part, low, high, n, peak, total, margin, run HAVING count(*) >= 3
), c{k} AS (
    SELECT v.*, row_number() OVER (PARTITION BY v.series_id, v.part ORDER BY round((1 - least(1, (s / len) / v.peak)) * 2.2::DOUBLE + least(1, len / (3 * 1.4::DOUBLE))
           - abs(split - v.n / 2) / greatest(1, v.n / 2) * 0.45::DOUBLE, 9) DESC, split) AS best
    FROM v{k} v JOIN r{k} r ON r.series_id = v.series_id AND r.part = v.part AND r.q = split
    WHERE split >= v.margin AND v.n - split >= v.margin
      AND least(r.above / greatest(1, split * 10.0::DOUBLE), (v.total - r.above) / greatest(1, (v.n - split) * 10.0::DOUBLE)) >= 0.0001::DOUBLE
), s{k} AS (
    SELECT series_id, part, low, high, 'a' AS side, low AS lo, low + split AS hi FROM c{k} WHERE best = 1
    UNION ALL SELECT series_id, part, low, high, 'b', low + split, high FROM c{k} WHERE best = 1
), i{k} AS (
    SELECT s.series_id, s.part, s.side, any_value(high - low) AS whole, any_value(hi - lo) AS own, count(v.pos) AS marks,
           greatest(0, greatest(any_value(lo), min(v.pos) - 20) - 6) AS new_low,
           least(any_value(z.n), least(any_value(hi), max(v.pos) + 1 + 20) + 6) AS new_high
    FROM s{k} s JOIN (SELECT series_id, count(*) AS n FROM v_series GROUP BY series_id) z ON z.series_id = s.series_id
    LEFT JOIN v_series v ON v.series_id = s.series_id AND v.pos >= lo AND v.pos < hi AND v.value > 0
    GROUP BY s.series_id, s.part, s.side
), k{k} AS (
    SELECT *, bool_and(own >= 6 AND marks > 0 AND new_high - new_low >= whole * 0.12::DOUBLE) OVER (PARTITION BY series_id, part) AS fine FROM i{k}
), d{k} AS (
    SELECT series_id, part, low, high FROM p{k} p WHERE NOT EXISTS (SELECT 1 FROM k{k} x WHERE x.series_id = p.series_id AND x.part = p.part AND x.fine)
), p{k + 1} AS (
    SELECT series_id, part || side AS part, CAST(new_low AS BIGINT) AS low, CAST(new_high AS BIGINT) AS high FROM k{k} WHERE fine
)"""


@query("recursive_splits", f"""
, p0 AS (SELECT series_id, '' AS part, CAST(0 AS BIGINT) AS low, CAST(count(*) AS BIGINT) AS high FROM v_series GROUP BY series_id)
{split_level(0)}{split_level(1)}{split_level(2)}
SELECT * FROM d0 UNION ALL SELECT * FROM d1 UNION ALL SELECT * FROM d2 UNION ALL SELECT * FROM p3
""")
def _(t):
    return series.recursive_splits(scale.staged(counts(t)), F.lit(10.0), SPARSE)
