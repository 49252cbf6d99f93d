"""Cutting pages into problems by markers, and what the cut looked like."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.functions import text as tx
from foliospark.scale import Running
from foliospark.settings import FIGURE_TYPES, STEM_TYPES



def line_numbers(lines: DataFrame, blocks: DataFrame) -> DataFrame:
    """Problem number found in a block's lines, best candidate first.

    A line near the block's top-left corner beats any other; within each kind
    the lowest score wins. Returns page_id, block_id, line_number, line_source.
    """
    sized = lines.select(
        "page_id", "block_id", "line_no", F.col("left").alias("_l"), F.col("top").alias("_t"),
        tx.problem_number(F.col("text")).alias("_n"),
    ).where(F.col("_n").isNotNull())
    sized = sized.join(
        blocks.select(
            "page_id", "block_id", F.greatest("width", F.lit(1.0)).alias("_w"), F.greatest("height", F.lit(1.0)).alias("_h")
        ),
        ["page_id", "block_id"],
    )
    down = F.greatest(F.lit(0.0), F.col("_t") / F.col("_h"))
    across = F.greatest(F.lit(0.0), F.col("_l") / F.col("_w"))
    scored = sized.select(
        "page_id", "block_id", "_n", tx.line_rank(down, across, F.col("line_no")).alias("_rank"), "line_no"
    )
    best = scored.groupBy("page_id", "block_id").agg(F.min(F.struct("_rank", "line_no", "_n")).alias("_best"))
    return best.select(
        "page_id", "block_id", F.col("_best._n").alias("line_number"), _line_source(F.col("_best._rank.outside")).alias("line_source"),
    )


def _line_source(outside: Column) -> Column:
    return F.when(outside, "ocr_line").otherwise("ocr_top_left")


def _flag(name: str, df: DataFrame) -> Column:
    return F.coalesce(F.col(name), F.lit(False)) if name in df.columns else F.lit(False)


def tag_blocks(blocks: DataFrame, numbers: DataFrame | None = None) -> DataFrame:
    """Per-block markers, number, resolved type and start flag (T1, T2, A3 inputs).

    Numbers in lines are taken from the blocks' own ``ocr_lines`` where present,
    or from ``numbers`` (see ``line_numbers``) when lines are a separate table.
    """
    if numbers is not None:
        blocks = blocks.join(numbers, ["page_id", "block_id"], "left")
    elif "ocr_lines" in blocks.columns:
        best = tx.best_line_number(F.col("ocr_lines"), F.col("width"), F.col("height"))
        blocks = blocks.withColumn("_best", best).withColumns(
            {
                "line_number": F.col("_best.number"),
                "line_source": F.when(F.col("_best").isNotNull(), _line_source(F.col("_best.rank.outside"))),
            }
        ).drop("_best", "ocr_lines")
    else:
        blocks = blocks.withColumns(
            {"line_number": F.lit(None).cast("int"), "line_source": F.lit(None).cast("string")}
        )
    display = F.col("display_title") if "display_title" in blocks.columns else F.lit(None).cast("string")
    text = F.col("text")
    tagged = blocks.withColumns(
        {
            "_raw": tx.strip(tx.filled(text)),
            "_source": tx.title_source(display, text),
            "_forced": _flag("force_problem_start", blocks),
            "_titled": F.coalesce(display != "", F.lit(False)), "_lowered": F.lower(text),
        }
    ).withColumn("_text_number", tx.problem_number(F.col("_source")))
    text_number = F.col("_text_number")
    tagged = tagged.withColumns(
        {
            "problem_number": F.coalesce("line_number", text_number),
            "problem_number_source": F.coalesce("line_source", F.when(text_number.isNotNull(), "text_prefix")),
            "_raw_marker": tx.has_problem_marker(F.col("_raw")),
            "choice_marker": tx.has_choice_marker(F.col("_raw")),
        }
    )
    numbered = F.col("problem_number").isNotNull()
    is_choice = ~F.col("_forced") & ~numbered & (
        (F.col("block_type") == "choice") | tx.has_choice_marker(text)
    )

    def starts(block_type: Column) -> Column:
        headed = block_type.isin("title", "section") & (F.col("_raw").isNotNull() | F.col("_titled"))
        return F.col("_forced") | ((block_type != "choice") & (numbered | headed))

    resolved = (
        F.when(F.coalesce(text == "", F.lit(True)), F.col("block_type"))
        .when(is_choice, "choice")
        .when(starts(F.col("block_type")), "title")
        .otherwise(F.col("block_type"))
    )
    elsewhere = F.col("_raw").isNull() | (F.col("_source") != F.col("_raw"))
    tagged = tagged.withColumns(
        {
            "block_type": resolved,
            "problem_marker": F.col("_raw_marker") | (elsewhere & tx.has_problem_marker(F.col("_source"))),
            "marker_conflict": F.col("choice_marker") & (F.col("_raw_marker") | numbered),
            "display_title_text": F.when(
                text_number.isNotNull(), F.coalesce(tx.strip_problem_marker(F.col("_source")), F.col("_source"))
            ).otherwise(F.col("_source")),
        }
    )
    words = {f"says_{s}": hit for s, hit in tx.subject_words(F.col("_lowered")).items()}
    tagged = tagged.withColumns(
        {
            "is_start": starts(F.col("block_type")), "has_text": F.coalesce(text != "", F.lit(False)),
            "is_blank": F.col("_raw").isNull(), "overlap_marker": tx.has_overlap_marker(F.col("_raw")), **words,
        }
    )
    return tagged.withColumnRenamed("_forced", "forced_start").drop(
        "_raw", "_source", "_titled", "_lowered", "_text_number", "_raw_marker", "line_number", "line_source"
    )


def block_role(block_type: Column, has_text: Column, fallback: Column) -> Column:
    """Which of a problem's four lists a block joins; null if none."""
    return (
        F.when(block_type.isin(*STEM_TYPES), "stem")
        .when(block_type == "choice", "choice")
        .when(block_type.isin(*FIGURE_TYPES), "figure")
        .when(block_type == "explanation", "explanation")
        .when(fallback | has_text, "stem")
    )


def page_subject(found: dict[str, Column], default: Column) -> Column:
    """First subject whose words occur, else the page's own."""
    out = F.lit(None).cast("string")
    for subject, hit in reversed(list(found.items())):
        out = F.when(hit, subject).otherwise(out)
    return F.coalesce(out, default)


def infer_subject(blocks: DataFrame) -> DataFrame:
    """Subject of each page from its text."""
    words = tx.subject_words(F.col("_lowered"))
    said = blocks.withColumn("_lowered", F.lower("text")).select("page_id", "page_subject", *[c.alias(s) for s, c in words.items()])
    hits = {s: F.max(s) for s in words}
    found = said.groupBy("page_id", "page_subject").agg(page_subject(hits, F.lit(None)).alias("found"))
    return found.select("page_id", F.coalesce("found", "page_subject").alias("subject"))


def group_problems(tagged: DataFrame, rows: int | None = None) -> DataFrame:
    """Assign every block of a page to a problem.

    ``tagged`` comes from ``tag_blocks`` on blocks in reading order. In marker
    mode a problem runs from one start to the next and the first block always
    starts one. A page without starts but with bands, or with several blocks,
    falls back to one problem per block.
    """
    cut = scale.by_position(tagged, "reading_order", rows)
    said = [c for c in cut.columns if c.startswith("says_")]
    band = F.col("question_band_index") if "question_band_index" in tagged.columns else F.lit(None)
    first = F.col("is_start") | (F.col("reading_order") == 0)
    grouped = scale.running(
        cut, ["page_id"], [F.col("reading_order")], {"_run": Running("sum", first.cast("int"))},
        facts={
            "_starts": ("max", F.col("is_start")), "_bands": ("max", band.isNotNull()), "_size": ("sum", F.lit(1)),
            **{f"_page_{c}": ("max", F.col(c)) for c in said},
        },
    )
    grouped = grouped.withColumn("fallback_grouping", ~F.col("_starts") & (F.col("_bands") | (F.col("_size") > 1)))
    alone = F.col("fallback_grouping")
    hits = {c.removeprefix("says_"): F.col(f"_page_{c}") for c in said}
    grouped = grouped.withColumns(
        {
            "problem_index": F.when(alone, F.col("reading_order") + 1).otherwise(F.col("_run")).cast("bigint"),
            "subject": page_subject(hits, F.col("page_subject")),
            "opens": first | alone,
            "role": block_role(F.col("block_type"), F.col("has_text"), alone),
        }
    ).withColumn("unit_id", F.concat("page_id", F.lit("-problem-"), F.col("problem_index").cast("string")))
    return grouped.drop(scale.SLICE, "_run", "_starts", "_bands", "_size", *said, *[f"_page_{c}" for c in said])


def problems_of(grouped: DataFrame, titles: DataFrame | None = None) -> DataFrame:
    """One row per problem: subject and number of its first block, role counts.

    ``titles`` (page_id, block_id, display_title_text) adds the first block's
    title; texts join only then, and are not carried through the grouping.
    """
    counts = grouped.groupBy("page_id", "problem_index").agg(*role_counts("stem", "choice", "explanation", "figure"))
    first = grouped.where("opens").select(
        "page_id", "unit_id", "problem_index", "block_id", "subject", "problem_number", "problem_number_source", "fallback_grouping"
    )
    return with_titles(first, titles).join(counts, ["page_id", "problem_index"])


def with_titles(openers: DataFrame, titles: DataFrame | None) -> DataFrame:
    """Title of each problem's first block, if titles are given."""
    if titles is not None:
        found = titles.select("page_id", "block_id", F.col("display_title_text").alias("title"))
        openers = openers.join(found, ["page_id", "block_id"], "left")
    return openers.drop("block_id")


def role_counts(*roles: str) -> list[Column]:
    return [F.count(F.when(F.col("role") == r, 1)).alias(f"{r}_count") for r in roles]


def assemble_problems(grouped: DataFrame, part_items: int | None = None) -> DataFrame:
    """Problems with their ordered id lists; long problems come in parts (A10)."""
    def ids(role: str) -> Column:
        return F.when(F.col("role") == role, F.col("block_id"))

    return scale.folded(
        grouped, ["page_id", "unit_id", "problem_index"], F.col("reading_order"),
        {f"{r}_block_ids": ids(r) for r in ("stem", "choice", "explanation", "figure")},
        part_items=part_items,
    )


def page_problems(grouped: DataFrame, titles: DataFrame | None = None, part_items: int | None = None) -> DataFrame:
    """The problems of each page, as rows: number, title and ordered block ids.

    A page may hold any number of problems, so they are rows and not one list; a problem with more blocks than
    ``part_items`` has several, told apart by ``part``.
    """
    units = problems_of(grouped, titles).drop("subject", "fallback_grouping", *[f"{r}_count" for r in ("stem", "choice", "explanation", "figure")])
    lists = assemble_problems(grouped, part_items).drop("explanation_block_ids")
    return units.join(lists, ["page_id", "unit_id", "problem_index"])


def grouping_diagnostics(grouped: DataFrame, *more: Column) -> DataFrame:
    """Counts of markers and numbers per page, mode and reasons (A3); ``more`` aggregates are added."""
    def count_if(c: Column) -> Column:
        return F.count(F.when(c, 1))

    sources = ("ocr_top_left", "ocr_line", "text_prefix")
    band = F.count("question_band_index") if "question_band_index" in grouped.columns else F.lit(0)
    page = grouped.groupBy("page_id").agg(
        F.max("fallback_grouping").alias("fallback_grouping"),
        F.max("is_start").alias("has_text_markers"),
        (band > 0).alias("has_band_metadata"),
        F.count(F.lit(1)).alias("block_count"),
        F.max("problem_index").alias("problem_count"),
        count_if(F.col("problem_marker")).alias("problem_marker_count"),
        count_if(F.col("choice_marker")).alias("choice_marker_count"),
        count_if(F.col("marker_conflict")).alias("marker_conflict_count"),
        count_if(F.col("forced_start")).alias("forced_start_count"),
        count_if(F.col("problem_number").isNotNull()).alias("problem_number_count"),
        count_if(F.coalesce(F.col("fallback_reason") != "", F.lit(False))).alias("fallback_reason_count"),
        *[count_if(F.col("problem_number_source") == s).alias(f"_{s}") for s in sources],
        F.min(
            F.when(F.col("problem_number_source").isNotNull(), F.struct("reading_order", "problem_number_source"))
        )["problem_number_source"].alias("problem_number_source"),
        *more,
    )
    fallback = F.col("fallback_grouping")
    present = F.array(*[F.when(F.col(f"_{s}") > 0, F.struct(F.lit(s).alias("k"), F.col(f"_{s}").alias("v"))) for s in sources])
    reasons = F.array(
        F.when(~fallback, "text_markers_detected"),
        F.when(fallback & ~F.col("has_text_markers"), "no_text_markers"),
        F.when(fallback & F.col("has_band_metadata"), "band_metadata_present"),
        F.when(fallback & (F.col("block_count") > 1), "multi_block_page"),
    )
    return page.withColumns(
        {
            "grouping_mode": F.when(fallback, "fallback").otherwise("marker"),
            "grouping_source": F.when(fallback, "fallback_grouping").otherwise("marker_grouping"),
            "trigger_reasons": F.array_compact(reasons),
            "number_source_counts": F.map_from_entries(F.array_compact(present)),
        }
    ).drop(*[f"_{s}" for s in sources])


def page_summary(grouped: DataFrame) -> DataFrame:
    """Id, subject, counts and diagnostics of each page, in one aggregation; its problems are ``page_problems``."""
    return grouping_diagnostics(
        grouped, F.min("subject").alias("subject"),
        F.count(F.when(F.col("opens"), F.col("problem_number"))).alias("numbered_problem_count"),
    )
