"""Corrections of pages: payloads out, answers checked, applied and cached."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from foliospark import scale
from foliospark.functions import text as tx
from foliospark.functions.numbers import half_even
from foliospark.schema import REPAIR_DDL
from foliospark.settings import FIGURE_TYPES

if TYPE_CHECKING:
    import pandas as pd

BLOCK_LISTS = {"start": "problem_start_block_ids", "choice": "choice_block_ids", "figure": "figure_block_ids"}


# ------------------------------------------------------------------ payload
def _json(value: Column) -> Column:
    """JSON text of one value."""
    listed = F.to_json(F.array(value))
    return F.substring(listed, F.lit(2), F.length(listed) - 2)


def _entry(name: str, text: Column) -> Column:
    return F.concat(F.lit(f'"{name}": '), text)


def _object(*entries: Column) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.array_compact(F.array(*entries)), ", "), F.lit("}"))


def review_payload(blocks: DataFrame, lines: DataFrame, part_items: int | None = None) -> DataFrame:
    """Blocks of each page as JSON lines for a reviewer, in reading order.

    Text is cut at 300 characters, numbers are rounded, the first three lines
    are shown without blanks. A page of very many blocks comes in parts.
    """
    shown = F.substring(tx.strip(F.col("text")), 1, 80)
    head = lines.where("line_no < 3").select("page_id", "block_id", "line_no", shown.alias("_s")).where("_s <> ''")
    head = head.groupBy("page_id", "block_id").agg(
        F.transform(F.sort_array(F.collect_list(F.struct("line_no", "_s"))), lambda e: e["_s"]).alias("_lines")
    )
    held = blocks.join(head, ["page_id", "block_id"], "left")
    names = [n for n in ("segmenter", "column_index", "question_band_index", "fallback_reason", "split_from_band") if n in blocks.columns]
    meta = _object(*[F.when(F.col(n).isNotNull(), _entry(n, _json(F.col(n)))) for n in names])
    box = _object(*[_entry(n, _json(half_even(F.col(n), 1))) for n in ("left", "top", "width", "height")])
    any_meta = F.coalesce(*[F.col(n).cast("string") for n in names]).isNotNull() if names else F.lit(False)
    entry = _object(
        _entry("order", (F.col("reading_order") + 1).cast("string")),
        _entry("block_id", _json(F.col("block_id"))),
        _entry("block_type", _json(F.col("block_type"))),
        _entry("text", _json(F.substring(F.coalesce("text", F.lit("")), 1, 300))),
        _entry("confidence", F.coalesce(_json(half_even(F.col("confidence"), 3)), F.lit("null"))),
        _entry("bbox", box),
        F.when(F.col("_lines").isNotNull(), _entry("ocr_lines", F.to_json("_lines"))),
        F.when(any_meta, _entry("meta", meta)),
    )
    folded = scale.folded(held, ["page_id"], F.col("reading_order"), {"_e": entry}, part_items=part_items)
    return folded.select("page_id", "part", F.array_join("_e", "\n").alias("payload"), F.size("_e").alias("block_count"))


# ---------------------------------------------------------------- signature
def page_signature(blocks: DataFrame) -> DataFrame:
    """Fingerprint of a page's blocks for the correction cache.

    Each block is hashed with its position; the hashes are added up in three
    pieces. Sums combine before the shuffle, so page size does not matter.
    """
    text_of = lambda c, f: F.coalesce(F.format_string(f, c), F.lit(""))

    def held(name: str) -> Column:
        """A column that may be absent; null is told from empty."""
        return F.coalesce(F.concat(F.lit("="), F.col(name).cast("string")), F.lit("none")) if name in blocks.columns else F.lit("none")

    row = F.concat_ws(
        "\x1f", F.col("pos").cast("string"), F.col("block_id"), F.col("block_type"), F.coalesce("text", F.lit("")),
        text_of(half_even(F.col("confidence"), 4), "%.4f"),
        *[text_of(half_even(F.col(n), 1), "%.1f") for n in ("left", "top", "width", "height")],
        F.coalesce(F.col("fallback_reason"), F.lit("")), F.coalesce(F.col("display_title"), F.lit("")),
        *[held(n) for n in ("column_index", "question_band_index", "ocr_mode", "ocr_backend")],
    )
    hashed = blocks.select("page_id", "page_width", "page_height", F.sha1(row.cast("binary")).alias("_h"))
    pieces = [F.sum(F.conv(F.substring("_h", s, 13), 16, 10).cast("decimal(20,0)")) for s in (1, 14, 27)]
    sums = hashed.groupBy("page_id", "page_width", "page_height").agg(
        F.count(F.lit(1)).alias("_n"), *[p.alias(f"_p{i}") for i, p in enumerate(pieces)]
    )
    whole = F.concat_ws("|", "page_id", *[F.col(c).cast("string") for c in ("page_width", "page_height", "_n", "_p0", "_p1", "_p2")])
    return sums.select("page_id", F.sha1(whole.cast("binary")).alias("page_signature"))


def repair_key(routes: DataFrame, signatures: DataFrame, provider: str, model: str) -> DataFrame:
    """Cache key of a page's correction: provider, model, reasons and signature."""
    joined = routes.join(signatures, "page_id")
    whole = F.to_json(
        F.struct(
            F.lit(provider).alias("provider"), F.lit(model).alias("model"), F.col("trigger_reasons"), F.col("page_signature")
        )
    )
    return joined.withColumn("repair_key", F.sha1(whole.cast("binary")))


def repair_lookup(keyed: DataFrame, cache: DataFrame) -> DataFrame:
    """Pages with their cached correction, if any (J5). Both sides have one row per key."""
    return keyed.join(cache, "repair_key", "left").withColumn("cached", F.col("payload").isNotNull())


def parse_repairs(answers: DataFrame, column: str = "payload") -> DataFrame:
    """JSON answers to typed lists; a missing list is empty."""
    parsed = answers.withColumn("_r", F.from_json(column, REPAIR_DDL))
    empty = {n: F.coalesce(F.col(f"_r.{n}"), F.array().cast("array<string>")) for n in BLOCK_LISTS.values()}
    return parsed.withColumns({**empty, "display_titles": F.col("_r.display_titles"), "notes": F.col("_r.notes")}).drop("_r")


# --------------------------------------------------------------- validation
def validate_repairs(repairs: DataFrame, blocks: DataFrame) -> DataFrame:
    """Check each correction; the first broken rule is reported (V1).

    Ids are looked up by (page, block), so page size does not matter; what is
    gathered per page is the correction's own list.
    """
    start, choice, figure = (F.col(n) for n in BLOCK_LISTS.values())
    listed = repairs.select("page_id", F.posexplode(F.concat(start, choice, figure)).alias("i", "block_id"), F.size(start).alias("_starts"))
    known = blocks.select("page_id", "block_id", F.col("reading_order").alias("_at"))
    found = listed.join(known, ["page_id", "block_id"], "left")
    facts = found.groupBy("page_id").agg(
        F.sort_array(F.collect_set(F.when(F.col("_at").isNull(), F.col("block_id")))).alias("_unknown"),
        F.transform(
            F.sort_array(F.collect_list(F.when(F.col("i") < F.col("_starts"), F.struct("i", "_at")))), lambda e: e["_at"]
        ).alias("_order"),
    )
    quoted = F.transform("_unknown", lambda s: F.concat(F.lit("'"), s, F.lit("'")))
    error = (
        F.when(F.size(start) == 0, "problem_start_block_ids must include at least one block")
        .when(F.size("_unknown") > 0, F.concat(F.lit("unknown block ids returned: ["), F.array_join(quoted, ", "), F.lit("]")))
        .when(F.size(F.array_intersect(start, choice)) > 0, "problem start and choice block ids overlap")
        .when(F.size(F.array_distinct(start)) != F.size(start), "problem_start_block_ids must be unique")
        .when(F.col("_order") != F.sort_array("_order"), "problem_start_block_ids must be in reading order")
    )
    checked = repairs.join(facts, "page_id", "left").withColumn("error", error)
    return checked.withColumn("ok", F.col("error").isNull()).drop("_unknown", "_order")


# ----------------------------------------------------------------- applying
def apply_repairs(blocks: DataFrame, repairs: DataFrame, rows: int | None = None) -> DataFrame:
    """Blocks with valid corrections applied; other pages stay as they are.

    A start beats a choice beats a figure. Group the result again afterwards.
    """
    roles = F.array(*[
        F.struct(F.lit(rank).alias("rank"), F.lit(role).alias("role"), F.col(name).alias("ids"))
        for rank, (role, name) in enumerate(BLOCK_LISTS.items())
    ])
    named = repairs.select("page_id", F.explode(roles).alias("r")).select(
        "page_id", "r.rank", F.explode("r.ids").alias("block_id")
    )
    named = named.groupBy("page_id", "block_id").agg(F.min("rank").alias("_rank"))
    titles = repairs.select("page_id", F.posexplode("display_titles").alias("i", "t")).select(
        "page_id", "i", F.col("t.block_id").alias("block_id"), tx.strip(F.col("t.title")).alias("_t")
    ).where("block_id <> '' and _t <> ''")
    titles = titles.groupBy("page_id", "block_id").agg(F.max(F.struct("i", "_t"))["_t"].alias("_title"))
    touched = repairs.select("page_id", F.lit(True).alias("_touched"), "trigger_reasons")
    held = scale.keyed_join(blocks, touched, ["page_id"], "left", spread_by=F.col("block_id"), rows=rows)
    held = held.join(named, ["page_id", "block_id"], "left").join(titles, ["page_id", "block_id"], "left")

    kind, rank, on = F.col("block_type"), F.col("_rank"), F.coalesce("_touched", F.lit(False))
    kept = lambda n, d: F.col(n) if n in blocks.columns else F.lit(None).cast(d)
    given = F.when(rank == 0, "problem_start").when(rank == 1, "choice").when(rank == 2, "figure")
    changed = (
        F.when(rank == 0, F.when(kind.isin(*FIGURE_TYPES), kind).otherwise("title"))
        .when(rank == 1, "choice")
        .when(rank == 2, F.when(kind.isin("diagram", "table"), kind).otherwise("image"))
        .when(kind.isin("title", "section") & ~tx.is_filled(F.col("text")), "stem")
        .otherwise(kind)
    )
    return held.withColumns(
        {
            "block_type": F.when(on, changed).otherwise(kind),
            "force_problem_start": F.when(on, F.coalesce(rank == 0, F.lit(False))).otherwise(F.col("force_problem_start")),
            "ai_grouping_role": F.when(on, given).otherwise(kept("ai_grouping_role", "string")),
            "display_title": F.coalesce(F.col("_title"), F.col("display_title")),
            "grouping_source": F.when(on, "ai_fallback").otherwise(kept("grouping_source", "string")),
            "grouping_reason": F.when(on, F.col("trigger_reasons")).otherwise(kept("grouping_reason", "array<string>")),
        }
    ).drop("_rank", "_title", "_touched", "trigger_reasons")


# --------------------------------------------------------------- enrichment
RESULT_LINES = "array<struct<text:string,confidence:double>>"
RESULT_DDL = (
    "page_id string, block_id string, result_text string, result_confidence double, result_error string, "
    f"result_lines {RESULT_LINES}"
)


def enrich_blocks(
    blocks: DataFrame,
    fn: Callable[[Iterator["pd.DataFrame"]], Iterator["pd.DataFrame"]] | None,
    *,
    requested: bool = True,
    named_model: bool = False,
) -> DataFrame:
    """Let a user function read the blocks that are due.

    ``blocks`` comes from ``attempt_budget``. ``fn`` maps batches of due rows to
    batches with page_id, block_id, result_text, result_confidence,
    result_error and result_lines; it is called once per partition, so it can
    load a model once. Only the due rows reach Python and the join; all others
    are put beside them as they are. What was read replaces text, lines, font
    size and type; ``ai_error`` holds a failed call's message, ``became_image``
    tells rows that end as images for want of text.
    """
    due = F.col("attempt") == "due"
    nothing = {n: F.lit(None).cast(d) for n, d in (
        ("result_text", "string"), ("result_confidence", "double"), ("result_error", "string"), ("result_lines", RESULT_LINES),
    )}
    if requested and fn is not None:
        results = blocks.where(due).mapInPandas(fn, RESULT_DDL)
        asked_rows = blocks.where(due).join(results, ["page_id", "block_id"], "left")
        held = asked_rows.unionByName(blocks.where(~due | due.isNull()).withColumns(nothing))
    else:
        held = blocks.withColumns(nothing)
    asked = due & F.lit(requested)
    text = tx.strip(F.coalesce(F.col("result_text"), F.lit("")))
    failed = F.col("result_error").isNotNull()
    got = asked & ~failed & (text != "")
    status = (
        F.when(F.lit(requested) & (F.col("attempt") == "skipped_limit"), "skipped_limit")
        .when(got, "applied")
        .when(asked & failed, "failed")
        .when(asked & F.lit(fn is None and named_model), "requested")
        .when(asked, "unavailable")
    )
    held = held.withColumns({"ai_status": status, "_got": F.coalesce(got, F.lit(False)), "_t": text})
    merged = F.when(F.col("_got"), F.col("_t")).otherwise(F.col("text"))
    empty = ~F.coalesce(merged != "", F.lit(False)) & (F.col("block_type") != "image")
    reason = (
        F.when(F.col("_got"), "ai_fallback")
        .when(empty & ~F.lit(requested), "ocr_empty")
        .when(empty & (F.col("ai_status") == "failed"), "ai_fallback_failed")
        .when(empty & (F.col("ai_status") == "skipped_limit"), "ai_fallback_limit_reached")
        .when(empty, "ai_fallback_unavailable")
        .otherwise(F.col("fallback_reason"))
    )
    own_lines = F.col("ocr_lines").cast(RESULT_LINES) if "ocr_lines" in blocks.columns else F.lit(None).cast(RESULT_LINES)
    own_size = F.col("font_size") if "font_size" in blocks.columns else F.lit(None).cast("double")
    new_size = F.greatest(F.lit(10.0), F.col("height") * 0.35) if "height" in blocks.columns else own_size
    weak = F.when(asked, F.when(tx.is_filled(F.col("text")), "ocr_low_confidence").otherwise("ocr_empty"))
    return held.withColumns(
        {
            "ai_reason": weak, "ai_error": F.when(asked, F.col("result_error")), "became_image": F.coalesce(empty, F.lit(False)),
            "ocr_lines": F.when(F.col("_got"), F.col("result_lines")).otherwise(own_lines),
            "font_size": F.when(F.col("_got"), new_size).otherwise(own_size),
            "fallback_reason": reason,
            "confidence": F.when(F.col("_got"), F.col("result_confidence")).otherwise(F.col("confidence")),
            "block_type": F.when(F.col("_got"), tx.text_block_type(F.col("_t"))).when(empty, "image").otherwise(F.col("block_type")),
            "text": merged,
        }
    ).drop(*nothing, "_got", "_t")


def enrich_totals(enriched: DataFrame, by: list[str]) -> DataFrame:
    """Attempts, successes and rows that became images for want of text, per run."""
    count = lambda c: F.count(F.when(c, 1))
    return enriched.groupBy(*by).agg(
        count(F.col("ai_reason").isNotNull()).alias("attempt_count"), count(F.col("ai_status") == "applied").alias("success_count"),
        count(F.col("became_image")).alias("image_fallback_count"),
    )


def resolve_block_types(blocks: DataFrame, backend: str) -> DataFrame:
    """Block type from a recogniser's hint and the text (T4).

    ``blocks`` has type_hint. A mapped hint wins. Else the text decides, but a
    plain stem only replaces a stem. Without text, a figure hint or a stem from
    a recogniser that is off or sees whole images gives an image.
    """
    from itertools import chain

    from foliospark.settings import TYPE_HINTS

    mapping = F.create_map(*chain.from_iterable((F.lit(k), F.lit(v)) for k, v in TYPE_HINTS.items()))
    hint = F.coalesce(F.col("type_hint"), F.lit(""))
    mapped = F.when(~hint.isin("", "unknown", "stem"), F.try_element_at(mapping, hint))
    written = tx.is_filled(F.col("text"))
    inferred = tx.text_block_type(F.col("text"))
    kind = F.col("block_type")
    eligible = ~kind.isin(*FIGURE_TYPES)
    named = backend.strip().lower()
    imaging = named in ("none", "noop", "claude", "anthropic")
    no_text = "noop_ocr" if named in ("none", "noop") else "claude_no_text"
    figure, stem_image = hint == "figure", F.lit(imaging) & (kind == "stem")
    resolved = (
        F.when(~eligible, kind)
        .when(written & mapped.isNotNull(), mapped)
        .when(written, F.when((inferred != "stem") | (kind == "stem"), inferred).otherwise(kind))
        .when(figure | stem_image, "image")
        .otherwise(kind)
    )
    reason = (
        F.when(eligible & ~written & figure, "claude_figure_hint")
        .when(eligible & ~written & stem_image, no_text)
        .otherwise(F.col("fallback_reason"))
    )
    source = F.when(eligible & written & mapped.isNotNull(), "claude_hint")
    return blocks.withColumns({"_kind": resolved, "fallback_reason": reason, "block_type_source": source}).drop(
        "block_type"
    ).withColumnRenamed("_kind", "block_type")


def plain_block_types(blocks: DataFrame) -> DataFrame:
    """Simpler typing: the text decides, no text is an image (T4)."""
    kind = F.when(F.col("block_type") == "image", "image").when(
        tx.is_filled(F.col("text")), tx.text_block_type(F.col("text"))
    ).otherwise("image")
    return blocks.withColumn("block_type", kind)
