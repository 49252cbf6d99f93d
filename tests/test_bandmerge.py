import random

import pytest

from foliospark.operators import bandmerge, series
from foliospark.settings import BandRules

RULES = BandRules(small_height=10, near_gap=6)


def plain(bands, rules=RULES):
    """The rule as it stands: join the topmost low band, start over."""
    bands = [list(b) for b in bands]
    while True:
        for i, (top, bottom) in enumerate(bands):
            above = top - bands[i - 1][1] if i else 10**9
            below = bands[i + 1][0] - bottom if i + 1 < len(bands) else 10**9
            if bottom - top <= rules.small_height and min(above, below) <= rules.near_gap:
                at = i if below < above else i - 1
                bands[at : at + 2] = [[bands[at][0], bands[at + 1][1]]]
                break
        else:
            return [tuple(b) for b in bands]


def made(dealer, n, gaps, heights):
    at, out = 0, []
    for _ in range(n):
        top = at + dealer.choice(gaps)
        at = top + dealer.choice(heights)
        out.append((top, at))
    return out


KINDS = [([1, 2, 3, 5, 6, 7, 9], [1, 2, 4, 8, 10, 11, 15]), ([1, 2], [1, 2]), ([3], [3]), ([6, 7], [10, 11]), ([1, 5, 20], [1, 12])]


def in_slices(bands, size):
    """Summaries, fold and walks of slices, as the tasks do them."""
    parts = [bands[i : i + size] for i in range(0, len(bands), size)]
    summaries = []
    for p in parts:
        firsts, lasts = [a for a, _ in p], [b for _, b in p]
        head = bandmerge.head_of(firsts, lasts, RULES.small_height)
        exits = bandmerge.Walker(firsts, lasts, RULES.small_height, RULES.near_gap).exits(head)
        summaries.append({"firsts": firsts[:head], "lasts": lasts[:head], "starts": [b and b.start for b in exits], "aboves": [b and b.above for b in exits], "end": lasts[-1]})
    out = []
    for p, (band, end, tail) in zip(parts, bandmerge.folded(summaries, RULES.small_height, RULES.near_gap)):
        walk = bandmerge.Walker([a for a, _ in p], [b for _, b in p], RULES.small_height, RULES.near_gap)
        for (a, b), joins in zip(p, walk.joins(band, end, tail)):
            out[-1:] = [(out[-1][0], b)] if joins else [*out[-1:], (a, b)]
    return out


@pytest.mark.parametrize("kind", range(len(KINDS)))
def test_slices_of_any_size_equal_the_rule(kind):
    dealer = random.Random(kind)
    for _ in range(400):
        bands = made(dealer, dealer.randrange(1, 25), *KINDS[kind])
        assert [in_slices(bands, size) for size in (1, 2, 3, 7, 100)] == [plain(bands)] * 5, bands


@pytest.mark.parametrize("part", [None, 1, 4])
def test_series_with_null_key_and_single_bands(spark, part):
    dealer = random.Random(9)
    layout = {None if k == 0 else f"s{k}": made(dealer, dealer.randrange(1, 15), *KINDS[k % 5]) for k in range(25)}
    rows = [(k, a, b) for k, bands in layout.items() for a, b in bands]
    found = series.merge_small_bands(spark.createDataFrame(rows, "series_id string, first int, last int").repartition(3), RULES, part)
    assert {tuple(r) for r in found.collect()} == {(k, *b) for k, bands in layout.items() for b in plain(bands)}
    none = spark.createDataFrame([], "series_id string, first int, last int")
    assert series.merge_small_bands(none, RULES, part).count() == 0


def test_a_chain_of_a_million_bands_over_several_slices(spark):
    """Nothing but low, near bands: one chain without a border that is sure to stay."""
    step = spark.range(1_000_000).selectExpr("id % 2 AS series_id", "id * 5 + pmod(xxhash64(id), 2) AS first", "id * 5 + 2 + pmod(xxhash64(id, 1), 2) AS last")
    found = series.merge_small_bands(step, RULES, 120_000).collect()
    given = {0: [], 1: []}
    for r in step.orderBy("first").collect():
        given[r.series_id].append((r["first"], r["last"]))
    whole = []
    for k, bands in given.items():
        walk = bandmerge.Walker([a for a, _ in bands], [b for _, b in bands], RULES.small_height, RULES.near_gap)
        out = []
        for (a, b), joins in zip(bands, walk.joins(None, -bandmerge.FAR, None)):
            if joins:
                out[-1] = (k, out[-1][1], b)
            else:
                out.append((k, a, b))
        whole += out
        assert [b[1:] for b in out[:300]] == plain(bands[:3000])[:300]
    assert sorted(tuple(r) for r in found) == sorted(whole)
