"""Session files written in either of two spellings."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.functions import text as tx
from foliospark.functions.numbers import finite_or, to_bool, to_optional_float, to_optional_int
from foliospark.functions.text import normalize_path

_PROBLEM = (
    "id string, problem_id string, title string, problemNumber double, problem_number double, subject string, "
    "imagePath string, image_path string, sourceImagePath string, source_image_path string, sourceFileName string, "
    "source_file_name string, boardRenderPath string, board_render_path string, actualHeightPages double, "
    "actual_content_height_pages double, overflowAllowed boolean, overflow_allowed boolean, readingHeavy boolean, "
    "reading_heavy boolean, sourcePageId string, source_page_id string, startYPages double, start_y_pages double, "
    "snappedNextStartYPages double, snapped_next_start_y_pages double, overflowAmountPages double, "
    "overflow_amount_pages double, overflowViolation boolean, overflow_violation boolean, slotSpanCount double, "
    "slot_span_count double, recordMode string, record_mode string, textRecordCount double, text_record_count double, "
    "imageRecordCount double, image_record_count double, excluded boolean, isExcluded boolean"
)
_TEMPLATE = (
    "name string, base_slot_height_pages double, baseSlotHeight double, board_page_count double, boardPageCount double, "
    "fixed_left_zone_ratio double, fixedLeftRatio double"
)
_CONFIG = (
    "enabled boolean, mode string, provider string, model string, threshold double, aiThreshold double, "
    "max_regions double, maxRegions double, timeout_ms double, timeoutMs double, save_debug boolean, saveDebug boolean, "
    "fail_on_error boolean, failOnError boolean"
)
_SUMMARY = (
    "requested boolean, mode string, provider string, model string, threshold double, max_regions double, "
    "maxRegions double, timeout_ms double, timeoutMs double, attempted_page_count double, attemptedPageCount double, "
    "applied_page_count double, appliedPageCount double, status_counts map<string,double>, statusCounts map<string,double>"
)


def _struct(fields: str) -> str:
    return "struct<" + ", ".join(f"{n}:{t}" for n, t in (f.strip().split(" ", 1) for f in _fields(fields))) + ">"


def _fields(text: str) -> list[str]:
    out, depth, start = [], 0, 0
    for i, ch in enumerate(text):
        depth += (ch == "<") - (ch == ">")
        if ch == "," and depth == 0:
            out.append(text[start:i])
            start = i + 1
    return [*out, text[start:]]


SESSION_DDL = (
    "session_name string, sessionName string, data_source string, dataSource string, generated_at string, "
    "generatedAt string, output_dir string, outputDir string, source_mode string, sourceMode string, "
    "export_mode string, exportMode string, record_mode string, recordMode string, input_file_count double, "
    "inputFileCount double, source_page_count double, sourcePageCount double, detected_problem_count double, "
    "detectedProblemCount double, input_files array<string>, inputFiles array<string>, edb_path string, edbPath string, "
    "pages_json_path string, pagesJsonPath string, placements_json_path string, placementsJsonPath string, "
    "rendered_page_file_uris array<string>, renderedPageFileUris array<string>, rendered_page_paths array<string>, "
    "renderedPagePaths array<string>, edb_file_uri string, edbFileUri string, warning_messages array<string>, warningMessages array<string>, "
    f"template {_struct(_TEMPLATE)}, ai_fallback {_struct(_CONFIG)}, aiFallback {_struct(_CONFIG)}, "
    f"ai_summary {_struct(_SUMMARY)}, aiSummary {_struct(_SUMMARY)}, problems array<{_struct(_PROBLEM)}>"
)

# Defaults of the two known providers.
PROVIDER_MODELS = {"openai": "gpt-5.4-mini", "gemini": "gemini-2.5-flash"}
PROVIDER_THRESHOLDS = {"openai": 0.72, "gemini": 0.72}
DEFAULT_MAX_REGIONS = 18
PROVIDER_TIMEOUTS_MS = {"openai": 12000, "gemini": 15000}


def _or(*texts: Column, default: str = "") -> Column:
    """First text that is neither null nor empty."""
    return F.coalesce(*[F.when(t != "", t) for t in texts], F.lit(default))


def _given(*values: Column) -> Column:
    """First value that is not null."""
    return F.coalesce(*values)


def _flag(*values: Column) -> Column:
    return F.coalesce(*values, F.lit(False))


def read_sessions(spark: SparkSession, path: str) -> DataFrame:
    """Session files, one JSON object each, in one spelling and with defaults."""
    return normalize_sessions(spark.read.schema(SESSION_DDL).option("multiLine", True).json(path))


def normalize_sessions(raw: DataFrame) -> DataFrame:
    """Both spellings to one; camel case before snake case or the reverse, as each field has it."""
    c = F.col
    problems = F.coalesce("problems", F.array().cast(f"array<{_struct(_PROBLEM)}>"))
    template = c("template")
    return raw.select(
        _or(c("session_name"), c("sessionName"), default="session").alias("session_name"),
        _or(c("data_source"), c("dataSource"), default="manual").alias("data_source"),
        _or(c("generated_at"), c("generatedAt")).alias("generated_at"),
        _or(c("output_dir"), c("outputDir")).alias("output_dir"),
        _or(c("source_mode"), c("sourceMode"), default="single").alias("source_mode"),
        _or(c("export_mode"), c("exportMode"), default="question").alias("export_mode"),
        _or(c("record_mode"), c("recordMode"), default="mixed").alias("record_mode"),
        finite_or(_given(c("input_file_count"), c("inputFileCount")), 0.0).alias("input_file_count"),
        finite_or(_given(c("source_page_count"), c("sourcePageCount")), 0.0).alias("source_page_count"),
        finite_or(_given(c("detected_problem_count"), c("detectedProblemCount")), F.size(problems)).alias("detected_problem_count"),
        F.coalesce("input_files", "inputFiles", F.array().cast("array<string>")).alias("input_files"),
        _or(c("pages_json_path"), c("pagesJsonPath")).alias("pages_path"),
        _or(c("placements_json_path"), c("placementsJsonPath")).alias("placements_path"),
        _or(c("edb_path"), c("edbPath")).alias("board_path"),
        normalize_path(_or(c("edb_file_uri"), c("edbFileUri"), c("edb_path"))).alias("board_file_uri"),
        F.transform(
            F.coalesce(
                "rendered_page_file_uris", "renderedPageFileUris", "rendered_page_paths", "renderedPagePaths",
                F.array().cast("array<string>"),
            ),
            lambda u: normalize_path(F.coalesce(u, F.lit(""))),
        ).alias("rendered_page_uris"),
        F.coalesce("warning_messages", "warningMessages", F.array().cast("array<string>")).alias("warning_messages"),
        F.when(
            template.isNotNull(),
            F.struct(
                _or(template["name"], default="생성 세션").alias("name"),
                finite_or(_given(template["base_slot_height_pages"], template["baseSlotHeight"]), 1.2).alias("slot_height"),
                finite_or(_given(template["board_page_count"], template["boardPageCount"]), 50.0).alias("board_page_count"),
                finite_or(_given(template["fixed_left_zone_ratio"], template["fixedLeftRatio"]), 0.5).alias("left_zone_ratio"),
            ),
        ).alias("template"),
        _config(F.coalesce("ai_fallback", "aiFallback"), F.coalesce("ai_summary", "aiSummary")).alias("repair_config"),
        _summary(F.coalesce("ai_summary", "aiSummary")).alias("repair_summary"),
        problems.alias("problems"),
    )


# Names of request fields, in the order in which they count, and of the nested object.
REQUEST_FIELDS = {
    "enabled": ["aiFallbackEnabled", "ai_fallback_enabled", "enabled"],
    "mode": ["aiFallbackMode", "ai_fallback_mode", "mode"],
    "provider": ["aiFallbackProvider", "ai_fallback_provider", "provider"],
    "model": ["aiFallbackModel", "ai_fallback_model", "model"],
    "prompt": ["aiFallbackPrompt", "ai_fallback_prompt", "prompt"],
    "max_tokens": ["aiFallbackMaxTokens", "ai_fallback_max_tokens", "maxTokens", "max_tokens"],
    "temperature": ["aiFallbackTemperature", "ai_fallback_temperature", "temperature"],
    "threshold": ["aiFallbackThreshold", "ai_fallback_threshold", "threshold"],
    "max_regions": ["aiFallbackMaxRegions", "ai_fallback_max_regions", "maxRegions", "max_regions"],
    "timeout_ms": ["aiFallbackTimeoutMs", "ai_fallback_timeout_ms", "timeoutMs", "timeout_ms"],
    "save_debug": ["aiFallbackSaveDebug", "ai_fallback_save_debug", "saveDebug", "save_debug"],
    "fail_on_error": ["failOnAiError", "fail_on_ai_error"],
}
NESTED = ["aiFallback", "ai_fallback"]


def request_options(requests: DataFrame, payload: str = "payload") -> DataFrame:
    """Correction settings of each request, added to its row as ``options``.

    A field of the request itself goes before one of its nested object, whatever the spelling; the nested
    object is the first of the two names that is an object. Text that is no JSON object has the defaults,
    as has a null; a number that cannot be read is null.
    """
    flat = ", ".join(f"`{n}` string" for names in REQUEST_FIELDS.values() for n in names)
    whole = f"{flat}, " + ", ".join(f"`{n}` {_struct(flat.replace('`', ''))}" for n in NESTED)
    read = requests.withColumn("_request", F.from_json(F.col(payload).cast("string"), whole))
    r = F.col("_request")
    nested = F.coalesce(*[r[n] for n in NESTED])
    field = lambda name: F.coalesce(*[r[n] for n in REQUEST_FIELDS[name]], *[nested[n] for n in REQUEST_FIELDS[name]])
    options = F.struct(
        to_bool(field("enabled")).alias("enabled"),
        field("mode").alias("mode"),
        F.coalesce(field("provider"), F.lit("openai")).alias("provider"),
        F.coalesce(field("model"), F.lit("")).alias("model"),
        F.coalesce(field("prompt"), F.lit("")).alias("prompt"),
        *[to_optional_int(field(n)).alias(n) for n in ("max_tokens", "max_regions", "timeout_ms")],
        *[to_optional_float(field(n)).alias(n) for n in ("temperature", "threshold")],
        *[to_bool(field(n)).alias(n) for n in ("save_debug", "fail_on_error")],
    )
    return read.withColumn("options", options).drop("_request")


def _config(config: Column, summary: Column) -> Column:
    mode = F.lower(tx.strip(_given(config["mode"], summary["mode"], F.lit("auto"))))
    provider = F.when(
        F.lower(tx.strip(_given(config["provider"], summary["provider"], F.lit("openai")))) == "gemini", "gemini"
    ).otherwise("openai")
    by_provider = lambda values: F.when(provider == "gemini", values["gemini"]).otherwise(values["openai"])
    model = tx.strip(_given(config["model"], summary["model"]))
    threshold = finite_or(
        _given(config["threshold"], config["aiThreshold"], summary["threshold"]), by_provider(PROVIDER_THRESHOLDS)
    )
    regions = finite_or(
        _given(config["max_regions"], config["maxRegions"], summary["max_regions"], summary["maxRegions"]), DEFAULT_MAX_REGIONS
    )
    timeout = finite_or(
        _given(config["timeout_ms"], config["timeoutMs"], summary["timeout_ms"], summary["timeoutMs"]), by_provider(PROVIDER_TIMEOUTS_MS)
    )
    return F.struct(
        _given(config["enabled"], summary["requested"], mode != "off").alias("enabled"),
        F.when(mode.isin("auto", "force", "off"), mode).otherwise("auto").alias("mode"),
        provider.alias("provider"),
        F.coalesce(F.when(model != "", model), by_provider(PROVIDER_MODELS)).alias("model"),
        F.least(F.lit(1.0), F.greatest(F.lit(0.0), threshold)).alias("threshold"),
        F.greatest(F.lit(1), F.floor(regions + 0.5)).cast("int").alias("max_regions"),
        F.greatest(F.lit(1000), F.floor(timeout + 0.5)).cast("int").alias("timeout_ms"),
        _flag(config["save_debug"], config["saveDebug"]).alias("save_debug"),
        _flag(config["fail_on_error"], config["failOnError"]).alias("fail_on_error"),
    )


def _summary(summary: Column) -> Column:
    counts = F.coalesce(summary["status_counts"], summary["statusCounts"], F.create_map().cast("map<string,double>"))
    whole = lambda a, b: F.greatest(F.lit(0), F.floor(finite_or(_given(a, b), 0.0) + 0.5)).cast("int")
    words = lambda name, default: _or(tx.strip(_or(summary[name], default=default)), default=default)
    return F.struct(
        _flag(summary["requested"]).alias("requested"),
        F.lower(words("mode", "auto")).alias("mode"),
        F.lower(words("provider", "openai")).alias("provider"),
        words("model", PROVIDER_MODELS["openai"]).alias("model"),
        summary.isNotNull().alias("provided"),
        whole(summary["attempted_page_count"], summary["attemptedPageCount"]).alias("attempted_page_count"),
        whole(summary["applied_page_count"], summary["appliedPageCount"]).alias("applied_page_count"),
        F.map_filter(counts, lambda k, v: (k != "") & (v >= 0) & (v != float("inf"))).alias("status_counts"),
    )


def session_problems(sessions: DataFrame) -> DataFrame:
    """One row per problem of a session, in one spelling and with defaults."""
    rows = sessions.select("session_name", F.posexplode("problems").alias("index", "p"))
    p, index = F.col("p"), F.col("index")
    raw_title = tx.strip(F.coalesce(p["title"], F.lit("")))
    parsed, rest = tx.parsed_title(raw_title)
    stated = _given(p["problemNumber"], p["problem_number"])
    number = F.coalesce(F.when((stated > 0) & (stated == F.floor(stated)), stated).cast("int"), parsed)
    image = lambda *names: normalize_path(_or(*[p[n] for n in names]))
    amount = lambda a, b, d: finite_or(_given(p[a], p[b]), d)
    return rows.select(
        "session_name", "index",
        _or(p["id"], p["problem_id"], F.format_string("problem-%02d", index + 1)).alias("problem_id"),
        F.coalesce(F.when(rest != "", rest), tx.problem_label(number, index)).alias("title"),
        number.alias("problem_number"),
        _or(p["subject"], default="unknown").alias("subject"),
        image("imagePath", "image_path", "sourceImagePath").alias("image_path"),
        image("sourceImagePath", "source_image_path", "imagePath").alias("source_image_path"),
        _or(p["sourceFileName"], p["source_file_name"]).alias("source_file_name"),
        image("boardRenderPath", "board_render_path").alias("board_render_path"),
        amount("actualHeightPages", "actual_content_height_pages", 0.9).alias("content_height"),
        _flag(p["overflowAllowed"], p["overflow_allowed"]).alias("overflow_allowed"),
        _flag(p["readingHeavy"], p["reading_heavy"]).alias("reading_heavy"),
        _or(p["sourcePageId"], p["source_page_id"]).alias("source_page_id"),
        amount("startYPages", "start_y_pages", 0.0).alias("start_y"),
        amount("snappedNextStartYPages", "snapped_next_start_y_pages", 0.0).alias("next_start_y"),
        amount("overflowAmountPages", "overflow_amount_pages", 0.0).alias("overflow_amount"),
        _flag(p["overflowViolation"], p["overflow_violation"]).alias("overflow_violation"),
        amount("slotSpanCount", "slot_span_count", 1.0).alias("slot_span"),
        _or(p["recordMode"], p["record_mode"]).alias("record_mode"),
        amount("textRecordCount", "text_record_count", 0.0).alias("text_record_count"),
        amount("imageRecordCount", "image_record_count", 0.0).alias("image_record_count"),
        _flag(p["excluded"], p["isExcluded"]).alias("excluded"),
    )
