"""Sessions: problems with placements, queues, edits and run summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.functions import text as tx


def _count_if(condition: Column) -> Column:
    return F.count(F.when(condition, 1))


# -------------------------------------------------------------------- feed
def session_feed(problems: DataFrame, placements: DataFrame, boards: DataFrame | None = None) -> DataFrame:
    """Problems with their placement, or defaults without one.

    ``problems`` has one row per unit_id; ``placements`` likewise; ``boards``
    may give a board_path per page_id.
    """
    placed = placements.select(
        "unit_id", "content_height", "overflow_allowed", "start_y", "next_start_y", "overflow_amount",
        "overflow_violation", "slot_span",
    )
    feed = problems.join(placed, "unit_id", "left")
    if boards is not None:
        feed = feed.join(boards.select("page_id", "board_path"), "page_id", "left")
    defaults = {
        "content_height": 1.0, "overflow_allowed": False, "start_y": 0.0, "next_start_y": 0.0, "overflow_amount": 0.0,
        "overflow_violation": False, "slot_span": 1,
    }
    return feed.fillna(defaults)


def feed_titles(feed: DataFrame) -> DataFrame:
    """Own title, else page and number within the page."""
    made = F.concat("page_id", F.lit(" problem "), F.col("problem_index").cast("string"))
    return feed.withColumn("title", F.coalesce(tx.strip(tx.filled(F.col("title"))), made))


def session_header(feed: DataFrame, sources: DataFrame) -> DataFrame:
    """One row per session: counts, source mode and warnings.

    ``feed`` and ``sources`` (one row per page, with source) carry session_id.
    """
    # Distinct sources: one row per (session, source) before counting.
    files = sources.groupBy("session_id", "source").agg(F.count(F.lit(1)).alias("_pages"))
    files = files.groupBy("session_id").agg(
        F.count(F.lit(1)).alias("input_file_count"), F.sum("_pages").alias("source_page_count")
    )
    found = feed.groupBy("session_id").agg(F.count(F.lit(1)).alias("detected_problem_count"))
    joined = files.join(found, "session_id", "left").fillna(0, ["detected_problem_count"])
    weak = (F.col("detected_problem_count") > 0) & (F.col("detected_problem_count") <= F.col("source_page_count"))
    return joined.withColumns(
        {
            "source_mode": F.when(F.col("input_file_count") > 1, "batch").otherwise("single"),
            "weak_split_warning": weak,
        }
    )


def active_problems(problems: DataFrame) -> DataFrame:
    """Problems that are not excluded."""
    return problems.where(~F.coalesce(F.col("excluded"), F.lit(False)))


# ------------------------------------------------------------------- queue
def merge_queue(current: DataFrame, incoming: DataFrame, *, replace: bool = False, rows: int | None = None) -> DataFrame:
    """File queue after adding files; a file is known by name, size and time.

    ``current`` and ``incoming`` have queue_id, seq, name, size and modified.
    Kept files come first, then the incoming ones. ``replace`` keeps only the
    incoming, the last of each key at the place of the first.
    """
    key = F.concat_ws("::", F.col("name"), F.col("size").cast("string"), F.col("modified").cast("string"))
    incoming = incoming.withColumn("file_key", key)
    columns = ["queue_id", "seq", "name", "size", "modified", "file_key"]
    if replace:
        rest = ["name", "size", "modified"]
        single = incoming.groupBy("queue_id", "file_key").agg(
            F.min("seq").alias("_at"), F.max(F.struct("seq", *rest)).alias("_row")
        )
        merged = single.select("queue_id", F.col("_at").alias("seq"), *[f"_row.{c}" for c in rest], "file_key", F.lit(1).alias("_part"))
    else:
        known = incoming.select("queue_id", "file_key").distinct()
        kept = current.withColumn("file_key", key).join(known, ["queue_id", "file_key"], "left_anti")
        merged = kept.select(*columns, F.lit(0).alias("_part")).unionByName(incoming.select(*columns, F.lit(1).alias("_part")))
    ranked = scale.rank(merged, ["queue_id"], [F.col("_part"), F.col("seq"), F.col("file_key")], "position", rows=rows)
    return ranked.drop("_part", "seq")


# -------------------------------------------------------------------- edits
def apply_edits(problems: DataFrame, edits: DataFrame, rows: int | None = None) -> DataFrame:
    """Apply one batch of edits to the problem lists of boards.

    ``problems`` has board_id, problem_id, seq (0..n-1 per board), title,
    height_pages and excluded. ``edits`` has board_id, edit_no, problem_id,
    action, target_id, title and height_pages, at most one edit per problem.
    Actions: up, down, drop (onto target), duplicate, delete, toggle, patch.
    An edit becomes a key between two old places; the keys are ranked anew. A
    board's last problem is not deleted.
    """
    sized = scale.unsliced(scale.with_group_facts(
        scale.by_position(problems, "seq", rows), ["board_id"], [F.count(F.lit(1)).alias("_n")]
    ))
    target = problems.select("board_id", F.col("problem_id").alias("target_id"), F.col("seq").alias("_to"))
    known = edits.select(
        "board_id", "problem_id", "edit_no", "action", "target_id", F.col("title").alias("_title"),
        F.col("height_pages").alias("_height"),
    ).join(target, ["board_id", "target_id"], "left").drop("target_id")
    gone = edits.where("action = 'delete'").join(problems.select("board_id", "problem_id"), ["board_id", "problem_id"], "left_semi")
    gone = gone.groupBy("board_id").agg(F.count(F.lit(1)).alias("_deleted"), F.max("edit_no").alias("_last_delete"))
    held = sized.join(known.join(gone, "board_id", "left"), ["board_id", "problem_id"], "left")

    at, n, act = F.col("seq").cast("double"), F.col("_n"), F.col("action")
    move = (
        F.when((act == "up") & (F.col("seq") > 0), at - 1.5)
        .when((act == "down") & (F.col("seq") < n - 1), at + 1.5)
        .when((act == "drop") & (F.col("_to") > F.col("seq")), F.col("_to") + 0.5)
        .when((act == "drop") & (F.col("_to") < F.col("seq")), F.col("_to") - 0.5)
        .otherwise(at)
    )
    spared = (F.col("_deleted") >= n) & (F.col("edit_no") == F.col("_last_delete"))
    held = held.where((act.isNull()) | (act != "delete") | spared)
    patched = act == "patch"
    base = held.withColumns(
        {
            "_key": move,
            "title": F.when(patched, F.coalesce("_title", "title")).otherwise(F.col("title")),
            "height_pages": F.when(patched, F.coalesce("_height", "height_pages")).otherwise(F.col("height_pages")),
            "excluded": F.when(act == "toggle", ~F.col("excluded")).otherwise(F.col("excluded")),
        }
    )
    copied = F.when(act == "duplicate", F.array(F.lit(False), F.lit(True))).otherwise(F.array(F.lit(False)))
    rows_out = base.withColumn("_copy", F.explode(copied))
    rows_out = rows_out.withColumns(
        {
            "problem_id": F.when(F.col("_copy"), F.concat("problem_id", F.lit("-copy"))).otherwise(F.col("problem_id")),
            "title": F.when(F.col("_copy"), F.concat("title", F.lit(" 복제본"))).otherwise(F.col("title")),
            "_key": F.when(F.col("_copy"), F.col("_key") + 0.25).otherwise(F.col("_key")),
        }
    )
    kept = rows_out.select(
        "board_id", "problem_id", "title", "height_pages", "excluded", "_key", F.coalesce("edit_no", F.lit(-1)).alias("_e")
    )
    ranked = scale.rank(kept, ["board_id"], [F.col("_key"), F.col("_e"), F.col("problem_id")], "_rank", rows=rows)
    return ranked.withColumn("seq", F.col("_rank") - 1).drop("_rank", "_key", "_e")


# ---------------------------------------------------------------- summaries
def _histogram(df: DataFrame, keys: Sequence[str], value: str, name: str) -> DataFrame:
    counted = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("_n"))
    pairs = F.sort_array(F.collect_list(F.struct(F.col(value).alias("k"), F.col("_n").alias("v"))))
    return counted.groupBy(*keys).agg(F.map_from_entries(pairs).alias(name))


def run_summary(pages: DataFrame, blocks: DataFrame, problems: DataFrame) -> DataFrame:
    """Counts per source and in total; the total has a null source (A4).

    ``pages`` has source, attempted, applied, cache_hit, route and tier;
    ``blocks`` and ``problems`` have source, ``blocks`` also ocr_cache_hit and
    ocr_cache_miss where known. Whatever routes and tiers occur are counted; a
    missing one is "unknown".
    """
    def part(df: DataFrame, **columns: Column) -> DataFrame:
        names = [*PAGE_COUNTS, "problem_count", *BLOCK_COUNTS]
        held = df.groupBy("source").agg(*[c.alias(n) for n, c in columns.items()])
        zero = F.lit(0).cast("bigint")
        return held.select("source", *[F.col(n) if n in columns else zero.alias(n) for n in names])

    page_part = part(
        pages, page_count=F.count(F.lit(1)), ai_attempted_page_count=_count_if(F.col("attempted")),
        ai_applied_page_count=_count_if(F.col("applied")), ai_cache_hit_count=_count_if(F.col("cache_hit")),
    )
    block_part = part(
        blocks, block_count=F.count(F.lit(1)), text_block_count=_count_if(F.coalesce(F.col("text") != "", F.lit(False))),
        image_block_count=_count_if(F.col("block_type") == "image"),
        fallback_block_count=_count_if(F.coalesce(F.col("fallback_reason") != "", F.lit(False))),
        **{f"{n}_count": _count_if(F.col(n)) for n in OCR_CACHE if n in blocks.columns},
    )
    problem_part = part(problems, problem_count=F.count(F.lit(1)))
    parts = page_part.unionByName(block_part).unionByName(problem_part)
    summary = parts.rollup("source").agg(
        *[F.sum(c).alias(c) for c in parts.columns if c != "source"], F.grouping_id().cast("int").alias("_all")
    )
    named = F.array(*[
        F.struct(F.lit(k).alias("kind"), F.coalesce(F.when(F.col(k) != "", F.col(k)), F.lit("unknown")).alias("name"))
        for k in ("route", "tier")
    ])
    held = pages.select("source", F.explode(named).alias("e")).select("source", "e.kind", "e.name")
    counted = held.groupBy("source", "kind", "name").agg(F.count(F.lit(1)).alias("_n")).withColumn("_all", F.lit(0))
    whole = counted.groupBy("kind", "name").agg(F.sum("_n").alias("_n"))
    counted = counted.unionByName(whole.withColumns({"source": F.lit(None).cast("string"), "_all": F.lit(1)}))
    pairs = lambda k: F.map_from_entries(F.array_compact(F.collect_list(F.when(F.col("kind") == k, F.struct("name", "_n")))))
    maps = counted.groupBy(F.col("source").alias("_source"), F.col("_all").alias("_level")).agg(
        pairs("route").alias("route_counts"), pairs("tier").alias("tier_counts")
    )
    here = F.col("source").eqNullSafe(F.col("_source")) & (F.col("_all") == F.col("_level"))
    return summary.join(maps, here, "left").drop("_source", "_level", "_all")


OCR_CACHE = ["ocr_cache_hit", "ocr_cache_miss"]
PAGE_COUNTS = ["page_count", "ai_attempted_page_count", "ai_applied_page_count", "ai_cache_hit_count"]
BLOCK_COUNTS = [
    "block_count", "text_block_count", "image_block_count", "fallback_block_count", *[f"{n}_count" for n in OCR_CACHE],
]


def repair_usage(pages: DataFrame, by: Sequence[str], blocks: DataFrame | None = None) -> DataFrame:
    """How corrections went: pages attempted, applied, from cache, and histograms (A5).

    A missing status or route counts as unknown; a tier only counts where the
    page has a profile. ``blocks``, with the same keys and ocr_cache_hit and ocr_cache_miss,
    adds how often their texts came from the cache.
    """
    held = pages.withColumns(
        {
            "_status": F.coalesce(F.when(F.col("status") != "", F.col("status")), F.lit("unknown")),
            "_route": F.when(F.col("has_route"), F.coalesce(F.when(F.col("route") != "", F.col("route")), F.lit("unknown"))),
            "_tier": F.when(
                F.col("has_route") & F.col("has_profile"),
                F.coalesce(F.when(F.col("tier") != "", F.col("tier")), F.lit("unknown")),
            ),
        }
    )
    totals = held.groupBy(*by).agg(
        _count_if(F.col("attempted")).alias("attempted_page_count"), _count_if(F.col("applied")).alias("applied_page_count"),
        _count_if(F.col("cache_hit")).alias("ai_cache_hit_count"),
    )
    for column, name in (("_status", "status_counts"), ("_route", "route_counts"), ("_tier", "route_tier_counts")):
        totals = totals.join(_histogram(held, by, column, name), list(by), "left")
    if blocks is not None:
        counts = [f"{n}_count" for n in OCR_CACHE]
        cached = blocks.groupBy(*by).agg(*[_count_if(F.col(n)).alias(f"{n}_count") for n in OCR_CACHE])
        totals = totals.join(cached, list(by), "left").fillna(0, counts)
    return totals


def merge_status_maps(df: DataFrame, column: str = "status_counts", by: Sequence[str] = ()) -> DataFrame:
    """Sum count maps key by key; bad counts and empty keys are left out."""
    rows = df.select(*by, F.explode(column).alias("status", "n"))
    number = F.col("n").cast("double")
    good = (F.col("status") != "") & number.isNotNull() & ~F.isnan(number) & (number >= 0) & (number != float("inf"))
    return rows.where(good).groupBy(*by, "status").agg(F.sum(number).alias("count"))
