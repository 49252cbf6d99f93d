"""The group-size-safe helpers give the same results whatever the slice size."""

import random

import pytest
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.scale import Running


def rows_of(df, *order):
    return [tuple(r) for r in df.orderBy(*order).collect()]


@pytest.fixture(scope="module")
def skewed(spark):
    """One key has most of the rows."""
    rng = random.Random(1)
    rows = [("hot", i, rng.randint(0, 9), rng.random()) for i in range(300)]
    rows += [(f"k{i % 20}", i // 20, rng.randint(0, 9), rng.random()) for i in range(100)]
    return rows, spark.createDataFrame(rows, "k string, pos bigint, v int, o double")


@pytest.mark.parametrize("size", [7, 50, 10_000])
def test_running_by_position(skewed, size):
    rows, df = skewed
    out = scale.running(
        scale.by_position(df, "pos", size), ["k"], [F.col("pos")],
        {"total": Running("sum", F.col("v")), "before": Running("sum", F.col("v"), before=True), "top": Running("max", F.col("v"))},
        facts={"least": ("min", F.col("v")), "whole": ("sum", F.col("v"))},
    )
    expected = []
    for key in {r[0] for r in rows}:
        mine = sorted(r for r in rows if r[0] == key)
        values = [r[2] for r in mine]
        for i, r in enumerate(mine):
            expected.append((key, r[1], sum(values[: i + 1]), sum(values[:i]), max(values[: i + 1]), min(values), sum(values)))
    got = [(r.k, r.pos, r.total, r.before, r.top, r.least, r.whole) for r in out.collect()]
    assert sorted(got) == sorted(expected)


@pytest.mark.parametrize("size", [40, 10_000])
def test_rank_splits_only_large_groups(skewed, size):
    rows, df = skewed
    out = scale.rank(df, ["k"], [F.col("o")], "n", rows=size)
    expected = []
    for key in {r[0] for r in rows}:
        mine = sorted((r for r in rows if r[0] == key), key=lambda r: r[3])
        expected += [(key, r[1], i + 1) for i, r in enumerate(mine)]
    assert sorted((r.k, r.pos, r.n) for r in out.collect()) == sorted(expected)


def test_rank_without_keys(skewed):
    rows, df = skewed
    out = scale.rank(df, [], [F.col("o")], "n")
    order = sorted(rows, key=lambda r: r[3])
    assert sorted((r.n, r.o) for r in out.collect()) == [(i + 1, r[3]) for i, r in enumerate(order)]


@pytest.mark.parametrize("size", [3, 11, 1000])
@pytest.mark.parametrize("step", [1, 4])
def test_islands(spark, size, step):
    rng = random.Random(size * 10 + step)
    points = {k: sorted(rng.sample(range(200), 80)) for k in ("a", "b", "c")}
    df = spark.createDataFrame([(k, p) for k, ps in points.items() for p in ps], "k string, pos bigint")
    expected = []
    for k, ps in points.items():
        run = [ps[0], ps[0], 1]
        for p in ps[1:]:
            if p - run[1] <= step:
                run = [run[0], p, run[2] + 1]
            else:
                expected.append((k, *run))
                run = [p, p, 1]
        expected.append((k, *run))
    out = scale.islands(df, ["k"], "pos", step, sums={"n": F.lit(1)}, rows=size)
    assert sorted((r.k, r["first"], r["last"], r.n) for r in out.collect()) == sorted(expected)


def test_folded_parts_hold_everything(skewed):
    rows, df = skewed
    out = scale.folded(df, ["k"], F.col("pos"), {"vs": F.col("v")}, part_items=32).collect()
    assert max(len(r.vs) for r in out) <= 32
    hot = [v for r in sorted((r for r in out if r.k == "hot"), key=lambda r: r.part) for v in r.vs]
    assert hot == [r[2] for r in sorted(rows) if r[0] == "hot"]


@pytest.mark.parametrize("how", ["inner", "left"])
def test_keyed_join_salts_hot_keys(skewed, spark, how):
    rows, df = skewed
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "k string, w int")
    out = scale.keyed_join(df, right, ["k"], how, spread_by=F.col("pos"), rows=25)
    plain = df.join(right, "k", how)
    assert sorted((r.k, r.pos, r.w or 0) for r in out.collect()) == sorted((r.k, r.pos, r.w or 0) for r in plain.collect())


def test_group_facts_reach_every_slice(skewed):
    rows, df = skewed
    out = scale.with_group_facts(scale.by_position(df, "pos", 13), ["k"], [F.count(F.lit(1)).alias("n")])
    counts = {}
    for r in rows:
        counts[r[0]] = counts.get(r[0], 0) + 1
    got = out.collect()
    assert len(got) == len(rows) and all(r.n == counts[r.k] for r in got)


def test_staged_tables_can_be_dropped(spark):
    import pathlib

    scale.drop_staged(spark)
    df = scale.staged(spark.range(5))
    path = pathlib.Path(df.inputFiles()[0].removeprefix("file:").replace("///", "/")).parent
    assert path.exists() and df.count() == 5
    assert scale.drop_staged(spark) == 1 and not path.exists()


@pytest.fixture(scope="module")
def with_nulls(spark):
    """A hot key, a null key and null positions, with ties in the order."""
    rows = [("hot", i, i % 7) for i in range(60)] + [(None, i, i % 3) for i in range(40)] + [("k", i, 1) for i in range(5)]
    rows += [("hot", None, 9), (None, None, 9)]
    return rows, spark.createDataFrame(rows, "k string, pos bigint, v int")


@pytest.mark.parametrize("size", [2, 50, None])
def test_null_keys_are_groups_at_every_size(with_nulls, size):
    rows, df = with_nulls
    place = F.coalesce("pos", F.lit(-1))
    ranked = scale.rank(df, ["k"], [F.col("v"), place], "n", rows=size).collect()
    expected = []
    for key in {r[0] for r in rows}:
        mine = sorted((r[2], -1 if r[1] is None else r[1]) for r in rows if r[0] == key)
        expected += [(str(key), v, p, i) for i, (v, p) in enumerate(mine, 1)]
    assert sorted((str(r.k), r.v, -1 if r.pos is None else r.pos, r.n) for r in ranked) == sorted(expected)
    total = scale.running(
        scale.by_position(df, "pos", size), ["k"], [place], {"sum": Running("sum", F.col("v"))}, facts={"all": ("sum", F.col("v"))}
    )
    assert total.count() == len(rows) and set(total.columns) == {"k", "pos", "v", scale.SLICE, "sum", "all"}
    for key in ("hot", None, "k"):
        mine = sorted((-1 if r[1] is None else r[1], r[2]) for r in rows if r[0] == key)
        found = sorted((-1 if r.pos is None else r.pos, r["sum"], r["all"]) for r in total.collect() if r.k == key)
        assert found == [(p, sum(v for _, v in mine[: i + 1]), sum(v for _, v in mine)) for i, (p, _) in enumerate(mine)]
    facts = scale.unsliced(scale.with_group_facts(scale.by_position(df, "pos", size), ["k"], [F.count(F.lit(1)).alias("n")]))
    assert facts.count() == len(rows) and set(facts.columns) == {"k", "pos", "v", "n"}
    runs = scale.islands(df.where("pos is not null"), ["k"], "pos", 1, sums={"v": F.col("v")}, rows=size).collect()
    assert sorted((str(r.k), r["first"], r["last"]) for r in runs) == [("None", 0, 39), ("hot", 0, 59), ("k", 0, 4)]


def test_large_groups_are_cut_into_as_many_slices_as_they_need(with_nulls):
    rows, df = with_nulls
    cut, sliced = scale.by_order(df, ["k"], [F.col("v"), F.col("pos")], rows=10)
    sizes = {(r.k, r[scale.SLICE]): r["count"] for r in cut.groupBy("k", scale.SLICE).count().collect()}
    assert sliced and sum(sizes.values()) == len(rows)
    assert sum(k == "hot" for k, _ in sizes) >= 4 and sum(k is None for k, _ in sizes) >= 3 and ("k", 0) in sizes
    whole, _ = scale.by_order(df, [], [F.col("v")], rows=10)
    assert whole.select(scale.SLICE).distinct().count() >= 5


def test_staged_tables_are_never_gathered(spark):
    """Rows that pack into a few KB are not small; neither side of a join goes to the driver."""
    rows = scale.staged(spark.range(200_000).select(F.col("id").alias("key"), F.lit(1).alias("one")))
    size = rows._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()
    assert int(str(size)) < 10 << 20  # small enough by its file
    counted = rows.groupBy("key").agg(F.count("one").alias("n"))
    for joined in (rows.join(counted, "key"), spark.range(10).withColumnRenamed("id", "key").join(rows, "key")):
        assert "BroadcastHashJoin" not in joined._jdf.queryExecution().executedPlan().toString()
    few = F.broadcast(spark.range(10).withColumnRenamed("id", "key")).join(rows, "key")
    assert "BroadcastHashJoin" in few._jdf.queryExecution().executedPlan().toString() and few.count() == 10
