"""Reading order and numbering."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.scale import Running


def reading_order(blocks: DataFrame, rows: int | None = None) -> DataFrame:
    """Re-number each page's blocks from 0 in reading order.

    If every block of the page knows its column: column, band, top, left.
    Otherwise: top, left, previous order. Source position settles ties.
    """
    cut = scale.by_position(blocks, "pos", rows)
    paged = scale.unsliced(
        scale.with_group_facts(cut, ["page_id"], [(F.count("column_index") == F.count(F.lit(1))).alias("_by_column")])
    )
    by_column = F.col("_by_column")
    order = [
        F.when(by_column, F.col("column_index")),
        F.when(by_column, F.coalesce("question_band_index", "reading_order")),
        F.bround("top", 4),
        F.bround("left", 4),
        F.when(~by_column, F.col("reading_order")),
        F.col("pos"),
    ]
    keyed = paged.withColumns({f"_o{i}": c for i, c in enumerate(order)})
    names = [f"_o{i}" for i in range(len(order))]
    ranked = scale.rank(keyed, ["page_id"], [F.col(n) for n in names], "_rank", sized_by=blocks, rows=rows)
    return ranked.withColumn("reading_order", (F.col("_rank") - 1).cast("int")).drop("_rank", "_by_column", *names)


def enumerate_blocks(boxes: DataFrame, rows: int | None = None) -> DataFrame:
    """Band index within the column, split index within the band, block id.

    Input order: column_index, source_band_index, split_pos (an order value of
    the pieces of one band).
    """
    order = [F.col("source_band_index"), F.col("split_pos")]
    page_order = [F.col("column_index"), *order]
    banded = scale.rank(boxes, ["page_id", "column_index"], order, "question_band_index", rows=rows)
    split = scale.rank(
        banded, ["page_id", "column_index", "source_band_index"], [F.col("split_pos")], "band_split_index",
        sized_by=boxes, rows=rows,
    )
    band = F.struct(F.lit(0), "page_id", "column_index", "source_band_index").alias("_band")  # never null, so null bands stay
    counts = boxes.groupBy(band).agg(F.count(F.lit(1)).alias("band_split_count"))
    split = split.withColumn("_band", band).join(counts, "_band").drop("_band")
    numbered = scale.rank(split, ["page_id"], page_order, "_n", sized_by=boxes, rows=rows)
    return numbered.withColumns(
        {
            "split_from_band": F.col("band_split_count") > 1,
            "block_id": F.concat("page_id", F.format_string("-block-%03d", "_n")),
        }
    ).drop("_n")


def record_ids(
    members: DataFrame, problem_order: Sequence[str], block_order: Sequence[str], rows: int | None = None
) -> DataFrame:
    """Consecutive record ids from 0 over problems and their blocks.

    ``members`` has one row per record; a problem without blocks has one row with a null block id, its fallback record.
    The first column of ``problem_order`` is the board. Records are counted by problem, and a record's id is
    the count of all boards before its own, of the problems before its own on the board, and of the records before it in the
    problem. Only counts are put in an overall order: a row per board, a row per problem inside its board. Records
    move once, to their problem. Nulls come first and are keys like any other.
    """
    board, problem, one = problem_order[0], list(problem_order), F.lit(1).cast("bigint")
    counted = scale.staged(members.groupBy(*problem).agg(F.count("*").alias("_n")))
    boards = counted.groupBy(board).agg(F.sum("_n").alias("_n"))
    cut, _ = scale.by_order(boards, [], [F.col(board)], rows=rows)
    boards = scale.running(cut, [], [F.col(board)], {"_boards": Running("sum", F.col("_n"), before=True)}).drop(scale.SLICE, "_n")
    rest = [F.col(c) for c in problem[1:]]
    if rest:
        cut, sliced = scale.by_order(counted, [board], rest, rows=rows)
        counted = scale.running(cut, [board], rest, {"_problems": Running("sum", F.col("_n"), before=True)}, sliced=sliced)
        counted = scale.unsliced(counted)
    else:
        counted = counted.withColumn("_problems", F.lit(0).cast("bigint"))

    def named(df: DataFrame, keys: Sequence[str], name: str) -> DataFrame:
        return df.withColumn(name, F.struct(one.alias("_"), *keys))  # nulls inside a struct are equal

    boards = named(boards, [board], "_board").select("_board", "_boards")
    offsets = named(named(counted, [board], "_board").join(boards, "_board"), problem, "_problem")
    offsets = scale.staged(offsets.select("_problem", "_n", (F.col("_boards") + F.col("_problems")).alias("_offset")))
    records = named(members, problem, "_problem")
    ranked = scale.rank(records, ["_problem"], [F.col(c) for c in block_order], "_rank", sized_by=records.select("_problem"), rows=rows)
    sizes = offsets.where(F.col("_n") > (rows or scale.GROUP_ROWS))
    if sizes.isEmpty():
        placed = ranked.join(offsets.drop("_n"), "_problem")
    else:
        placed = scale.keyed_join(
            ranked, offsets.drop("_n"), ["_problem"], spread_by=F.col("_rank"), sized_by=records.select("_problem"), rows=rows
        )
    return placed.withColumn("record_id", F.col("_offset") + F.col("_rank") - 1).drop("_rank", "_offset", "_problem")


def attempt_budget(
    blocks: DataFrame, run: str, order: Sequence[str], max_attempts: int | None, min_confidence: float | None,
    rows: int | None = None,
) -> DataFrame:
    """Which rows of a run are sent for enrichment and which come too late.

    Image rows take no part. A row is due if it has no text or too little
    confidence. Once ``max_attempts`` rows were due, every later row is skipped;
    None sets no limit.
    """
    from foliospark.functions.text import is_filled

    eligible = F.col("block_type") != "image"
    weak = ~is_filled(F.col("text"))
    if min_confidence is not None:
        weak = weak | F.coalesce(F.col("confidence") < min_confidence, F.lit(False))
    if max_attempts is None:
        return blocks.withColumn("attempt", F.when(eligible & weak, "due").otherwise("none"))
    keys = [F.col(c) for c in order]
    cut, sliced = scale.by_order(blocks, [run], keys, rows=rows)
    due = F.when(eligible & weak, 1).otherwise(0)
    counted = scale.running(cut, [run], keys, {"_due_before": Running("sum", due, before=True)}, sliced=sliced)
    spent = F.col("_due_before") >= max_attempts
    return counted.withColumn(
        "attempt",
        F.when(~eligible, "none").when(spent, "skipped_limit").when(weak, "due").otherwise("none"),
    ).drop("_due_before", scale.SLICE)
