"""Building blocks that stay within a task's reach when one group is huge.

A page, board, source or series may hold a large share of all rows. Ordered
work (running sums, ranks, runs) is therefore done on *slices*: consecutive
stretches of a group's order, each small enough for one task. Slice totals are
far fewer than rows; a running total over them gives every slice its carry-in.

Slices come from one of two places:

* ``by_position``: the rows carry an integer position (a page's reading order,
  a series index). The slice is ``position div rows``; rows without a position
  are in slice 0. Nothing is measured.
* ``by_order``: the order is arbitrary columns. Group sizes are counted first
  (partial aggregation). Groups above ``rows`` are range-partitioned by their
  order into as many partitions as their counts ask for; the partition number
  is the slice. Other groups are left alone, so a data set without oversized
  groups pays one count and no further shuffle.

A null key is a group like any other, at every size. Where slices are joined,
the keys stand in one struct, in which nulls are equal.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Mapping, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

GROUP_ROWS = 1_000_000  # most rows of one group that one task handles in order
PART_ITEMS = 10_000  # most items folded into one array value
MAX_BIG_GROUPS = 10_000  # most group keys that are broadcast
SLICE = "_slice"
_STAGED: dict[str, list[str]] = {}


class Running(NamedTuple):
    """A running measure: ``kind`` is sum or max; ``before`` leaves out the row itself."""

    kind: str
    value: Column
    before: bool = False


def shared_folder(spark: SparkSession) -> str:
    """The checkpoint folder the session names; a temporary one only for local runs."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not sc.master.startswith("local"):
                raise RuntimeError("set spark.checkpoint.dir to a folder all executors share")
            folder = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(folder)
    return sc.getCheckpointDir()


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` to the checkpoint folder and continue from the written copy."""
    shared_folder(df.sparkSession)
    return df.checkpoint()


def staged(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table in the shared folder and continue from the table.

    For a frame that several steps read: it is computed once, later steps read
    only the columns they need, and a lost executor costs a re-read.

    Such tables pack so well that Spark would take millions of rows for small
    and gather them in the driver; so both sides of their joins are moved by
    key, unless the other side is broadcast by name.
    """
    spark = df.sparkSession
    path = fresh_path(spark, "stage")
    df.write.option("compression", "zstd").parquet(path)
    return spark.read.schema(df.schema).parquet(path).hint("merge")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder, to be deleted with the staged tables."""
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    _STAGED.setdefault(spark.sparkContext.applicationId, []).append(path)
    return path


def drop_staged(spark: SparkSession) -> int:
    """Delete the tables this application has staged; call it when their readers are done."""
    paths = _STAGED.pop(spark.sparkContext.applicationId, [])
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in paths:
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(conf).delete(at, True)
    return len(paths)


def _group(keys: Sequence[str]) -> tuple[str, Column]:
    """Name and value of one column that holds the keys and is never null."""
    return "_group_" + "_".join(keys), F.struct(F.lit(0).alias("_"), *keys)


def _grouped(df: DataFrame, keys: Sequence[str]) -> tuple[DataFrame, str]:
    name, value = _group(keys)
    return (df if name in df.columns else df.withColumn(name, value)), name


def unsliced(df: DataFrame) -> DataFrame:
    """Without the columns that slicing adds."""
    return df.drop(SLICE, *[c for c in df.columns if c.startswith("_group_")])


def slice_of(position: Column | str, rows: int | None = None) -> Column:
    """Slice number of an integer position; 0 where it is null."""
    position = F.col(position) if isinstance(position, str) else position
    position = F.coalesce(position.cast("bigint"), F.lit(0).cast("bigint"))
    rows = rows or GROUP_ROWS
    return ((position - F.pmod(position, F.lit(rows))) / rows).cast("bigint")


def by_position(df: DataFrame, position: str, rows: int | None = None) -> DataFrame:
    return df.withColumn(SLICE, slice_of(position, rows))


def by_order(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    *,
    sized_by: DataFrame | None = None,
    rows: int | None = None,
) -> tuple[DataFrame, bool]:
    """Add a slice column where a group is too large for one task.

    Returns the frame and whether it is sliced. ``sized_by`` may be a cheaper
    frame with the same keys and row counts. Without keys all rows are one
    group and always sliced.
    """
    rows = rows or GROUP_ROWS
    source = sized_by if sized_by is not None else df
    plain, large = None, df
    if keys:
        big = source.groupBy(*keys).count().where(F.col("count") > rows)
        found = big.limit(MAX_BIG_GROUPS + 1).collect()
        if not found:
            return df, False
        if len(found) <= MAX_BIG_GROUPS:
            slices = sum(-(-r["count"] // rows) for r in found)
            df, name = _grouped(df, keys)
            known = df.sparkSession.createDataFrame(found, big.schema)
            known = F.broadcast(known.select(_group(keys)[1].alias(name)))
            large = df.join(known, name, "left_semi")
            plain = df.join(known, name, "left_anti").withColumn(SLICE, F.lit(0).cast("bigint"))
        else:
            slices = -(-big.agg(F.sum("count")).first()[0] // rows)
    else:
        slices = -(-source.count() // rows) or 1
    ranged = large.repartitionByRange(slices, *[F.col(k) for k in keys], *order)
    ranged = checkpointed(ranged.withColumn(SLICE, F.spark_partition_id().cast("bigint")))
    return (ranged if plain is None else ranged.unionByName(plain)), True


FOLDS = {"sum": F.sum, "max": F.max, "min": F.min}


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    measures: Mapping[str, Running],
    *,
    sliced: bool = True,
    facts: Mapping[str, tuple[str, Column]] | None = None,
) -> DataFrame:
    """Add running measures over each group's order, slice by slice if sliced.

    ``facts`` adds group totals, as (sum, max or min, value). Carries and facts
    come from the same one-row-per-slice table, joined on (keys, slice), which
    is how the rows are partitioned for the running measures anyway.
    """
    facts = dict(facts or {})
    held = {f"_v_{name}": m.value for name, m in measures.items()}
    rows = df.withColumns(held)
    if sliced:
        rows, name = _grouped(rows, keys)
        keys = [name]
    parts = [*keys, SLICE] if sliced else list(keys)
    window = Window.partitionBy(*parts).orderBy(*order)
    upto = window.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = window.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)

    local = {}
    for name, m in measures.items():
        value = FOLDS[m.kind](F.col(f"_v_{name}")).over(before if m.before else upto)
        local[name] = F.coalesce(value, F.lit(0)) if m.kind == "sum" else value
    if not sliced:
        return rows.withColumns({**local, **{n: FOLDS[k](v).over(whole) for n, (k, v) in facts.items()}}).drop(*held)

    totals = rows.groupBy(*parts).agg(
        *[FOLDS[m.kind](F.col(f"_v_{n}")).alias(f"_t_{n}") for n, m in measures.items()],
        *[FOLDS[k](v).alias(n) for n, (k, v) in facts.items()],
    )
    earlier = Window.partitionBy(*keys).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
    carries = totals.select(
        *parts,
        *[FOLDS[m.kind](F.col(f"_t_{n}")).over(earlier).alias(f"_c_{n}") for n, m in measures.items()],
        *[FOLDS[k](F.col(n)).over(whole).alias(n) for n, (k, _) in facts.items()],
    )
    out = rows.withColumns(local).join(carries, parts)
    return out.withColumns(
        {
            n: (F.col(n) + F.coalesce(F.col(f"_c_{n}"), F.lit(0)))
            if m.kind == "sum"
            else F.greatest(F.col(n), F.col(f"_c_{n}"))
            for n, m in measures.items()
        }
    ).drop(*held, *[f"_c_{n}" for n in measures], *keys)


def rank(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[Column],
    name: str,
    *,
    sized_by: DataFrame | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Number the rows of each group from 1 in the given order."""
    cut, sliced = by_order(df, keys, order, sized_by=sized_by, rows=rows)
    return running(cut, keys, order, {name: Running("sum", F.lit(1).cast("bigint"))}, sliced=sliced).drop(SLICE)


def with_group_facts(df: DataFrame, keys: Sequence[str], facts: Sequence[Column]) -> DataFrame:
    """Add per-group aggregates to every row of a sliced frame.

    The aggregates are repeated once per slice of their group, so the join runs
    on (keys, slice) and keeps the partitioning that ``running`` needs.
    ``unsliced`` takes the helper columns away.
    """
    df, name = _grouped(df, keys)
    totals = df.groupBy(name).agg(*facts, F.max(SLICE).alias("_last"))
    spread = totals.withColumn(SLICE, F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("_last")))).drop("_last")
    return df.join(spread, [name, SLICE])


def islands(
    active: DataFrame,
    keys: Sequence[str],
    position: str,
    max_step: int,
    *,
    sums: Mapping[str, Column] | None = None,
    rows: int | None = None,
) -> DataFrame:
    """Runs of positions that follow each other by at most ``max_step``.

    Returns keys, ``first``, ``last`` and the named sums. Runs are found inside
    each slice; only a slice's first and last run can continue across a border,
    and those are linked through one row per slice.
    """
    sums = dict(sums or {})
    cut = by_position(active.select(*keys, position, *[v.alias(n) for n, v in sums.items()]), position, rows)
    given = list(keys)
    cut, name = _grouped(cut, keys)
    keys = [name]
    parts = [*keys, SLICE]
    window = Window.partitionBy(*parts).orderBy(position)
    step = F.col(position) - F.lag(position).over(window)
    runs = cut.withColumn("_new", F.when(step <= max_step, 0).otherwise(1))
    runs = runs.withColumn("_run", F.sum("_new").over(window.rowsBetween(Window.unboundedPreceding, 0)))
    local = runs.groupBy(*parts, "_run").agg(
        F.min(position).alias("first"), F.max(position).alias("last"), *[F.sum(n).alias(n) for n in sums]
    )

    by_slice = Window.partitionBy(*keys).orderBy(SLICE)
    edges = local.groupBy(*parts).agg(
        F.min("first").alias("_head"), F.max("first").alias("_tail"), F.max("last").alias("_end")
    )
    edges = edges.withColumn("_joins", F.coalesce(F.col("_head") - F.lag("_end").over(by_slice) <= max_step, F.lit(False)))
    own = F.when(~(F.col("_joins") & (F.col("_head") == F.col("_tail"))), F.col("_tail"))
    edges = edges.withColumn("_origin", F.max(own).over(by_slice.rowsBetween(Window.unboundedPreceding, 0)))
    links = (
        edges.withColumn("_origin", F.lag("_origin").over(by_slice))
        .where("_joins")
        .select(*parts, F.col("_head").alias("first"), "_origin")
    )
    merged = local.join(links, [*parts, "first"], "left")
    return (
        merged.withColumn("_start", F.coalesce("_origin", "first"))
        .groupBy(*keys, "_start")
        .agg(F.max("last").alias("last"), *[F.sum(n).alias(n) for n in sums])
        .select(*[F.col(name)[k].alias(k) for k in given], F.col("_start").alias("first"), "last", *sums)
    )


def folded(
    df: DataFrame,
    keys: Sequence[str],
    position: Column,
    items: Mapping[str, Column],
    *,
    totals: Sequence[Column] = (),
    part_items: int | None = None,
) -> DataFrame:
    """Fold rows into ordered arrays, a bounded number of rows per array.

    A group that fits gives one row with ``part`` 0; a larger one gives one row
    per ``part``. An item that is null is left out of its array.
    """
    size = part_items or PART_ITEMS
    cut = df.withColumns({"_pos": position.cast("bigint"), "part": slice_of(position, size)})
    cut = cut.withColumns({f"_i_{n}": c for n, c in items.items()})
    arrays = [
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col(f"_i_{n}").isNotNull(), F.struct("_pos", F.col(f"_i_{n}").alias("v"))))),
            lambda e: e["v"],
        ).alias(n)
        for n in items
    ]
    return cut.groupBy(*keys, "part").agg(*arrays, *totals)


def keyed_join(
    left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner", *, spread_by: Column,
    sized_by: DataFrame | None = None, rows: int | None = None,
) -> DataFrame:
    """Join rows to one row per key when a key may hold a large share of the left rows.

    Keys with more than ``rows`` left rows are counted first. Their left rows are
    dealt over several salts by ``spread_by`` and their right row is repeated per
    salt. Without such keys this is a plain join.
    """
    rows = rows or GROUP_ROWS
    sizes = (left if sized_by is None else sized_by).groupBy(*keys).count().where(F.col("count") > rows)
    sizes = sizes.select(*keys, F.ceil(F.col("count") / rows).cast("int").alias("_salts"))
    found = sizes.limit(MAX_BIG_GROUPS + 1).collect()
    if not found:
        return left.join(right, list(keys), how)
    if len(found) > MAX_BIG_GROUPS:  # no few keys stand out; the adaptive skew join splits what is uneven
        return left.join(right, list(keys), how)
    sizes = F.broadcast(left.sparkSession.createDataFrame(found, sizes.schema))
    one = F.lit(1)
    salted = left.join(sizes, list(keys), "left").withColumn("_salts", F.coalesce("_salts", one))
    salted = salted.withColumn("_salt", F.pmod(F.xxhash64(spread_by), F.col("_salts")).cast("int")).drop("_salts")
    copies = right.join(sizes, list(keys), "left").withColumn(
        "_salt", F.explode(F.sequence(F.lit(0), F.coalesce("_salts", one) - 1))
    )
    return salted.join(copies.drop("_salts"), [*keys, "_salt"], how).drop("_salt")
