"""Sources, sessions, queues, edits, summaries."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliospark import scale
from foliospark.functions import text as tx
from foliospark.operators import editlog, flatten, grouping, placement, session
from foliospark.plans import oracle as o
from foliospark.plans.bindings import Tables
from foliospark.plans.board_queries import order_boards
from foliospark.plans.grouping_queries import grouped, layout, titles
from foliospark.plans.registry import query
from foliospark.plans.route_queries import statuses
from foliospark.settings import Template
from foliospark.sources import pages as page_files
from foliospark.sources import sessions
from foliospark.streaming import ingest

# ------------------------------------------------------------------ sources


@query("classify_sources", """
SELECT path, regexp_replace(path, '^.*/', '') AS file_name, regexp_replace(regexp_replace(path, '^.*/', ''), '\\.[^.]+$', '') AS stem,
       CASE WHEN k = 0 THEN 'pdf' WHEN k IN (1, 2, 3) THEN 'image' END AS source_kind
FROM (SELECT s_suppkey % 6 AS k, '/in/' || s_nationkey || '/' || s_name ||
      CASE s_suppkey % 6 WHEN 0 THEN '.PDF' WHEN 1 THEN '.jpg' WHEN 2 THEN '.Tiff' WHEN 3 THEN '.webp' WHEN 4 THEN '.docx' ELSE '' END AS path FROM supplier)
""")
def _(t):
    k = F.col("s_suppkey") % 6
    ending = F.when(k == 0, ".PDF").when(k == 1, ".jpg").when(k == 2, ".Tiff").when(k == 3, ".webp").when(k == 4, ".docx").otherwise("")
    files = t.table("supplier").select(F.concat(F.lit("/in/"), F.col("s_nationkey"), F.lit("/"), F.col("s_name"), ending).alias("path"))
    return page_files.classify_sources(files)


o.cte("v_sources", """
SELECT c_nationkey AS batch_id, row_number() OVER (PARTITION BY c_nationkey ORDER BY c_custkey) AS source_index,
       'scan' || c_custkey AS stem, c_custkey % 4 AS page_count FROM customer
UNION ALL SELECT 1000 + s_suppkey, 1, 'lone' || s_suppkey, 3 FROM supplier
""")


@query("number_pages", """
SELECT batch_id, page_id, n + before AS page_number, batch_total_sources, original_page_index FROM (
  SELECT batch_id, CAST(n AS INT) AS original_page_index, n, CAST(before AS BIGINT) AS before, CAST(total AS INT) AS batch_total_sources,
         CASE WHEN total > 1 THEN printf('%s-%02d-page-%03d', stem, source_index, n) ELSE printf('%s-page-%03d', stem, n) END AS page_id
  FROM (SELECT *, unnest(range(1, page_count + 1)) AS n
        FROM (SELECT *, count(*) OVER (PARTITION BY batch_id) AS total,
                     sum(page_count) OVER (PARTITION BY batch_id ORDER BY source_index) - page_count AS before FROM v_sources)))
""")
def _(t):
    scans = t.table("customer").select(
        F.col("c_nationkey").cast("bigint").alias("batch_id"), "c_custkey", F.concat(F.lit("scan"), F.col("c_custkey")).alias("stem"),
        (F.col("c_custkey") % 4).cast("int").alias("page_count"),
    )
    scans = scale.rank(scans, ["batch_id"], [F.col("c_custkey")], "source_index").drop("c_custkey")
    lone = t.table("supplier").select(
        (F.col("s_suppkey") + 1000).alias("batch_id"), F.concat(F.lit("lone"), F.col("s_suppkey")).alias("stem"),
        F.lit(3).alias("page_count"), F.lit(1).cast("bigint").alias("source_index"),
    )
    made = page_files.number_pages(scans.unionByName(lone))
    return made.select("batch_id", "page_id", "page_number", "batch_total_sources", "original_page_index")


@query("union_sources", """
SELECT page_id, 1 AS batch_source_index FROM v_pages WHERE source = 'src1'
UNION ALL SELECT page_id, 2 FROM v_pages WHERE source <> 'src1'
""")
def _(t):
    first, rest = t.pages.where("source = 'src1'"), t.pages.where("source <> 'src1'")
    return page_files.union_sources([first, rest]).select("page_id", "batch_source_index")


def page_folder(t: Tables) -> str:
    """Blocks and problems of all documents written as page files."""
    def write() -> str:
        path = scale.fresh_path(t.spark, "pages")
        blocks = t.read_blocks.withColumn("ocr_lines", F.transform("ocr_lines", lambda e: F.struct(
            e["text"].alias("text"), F.lit(None).cast("double").alias("confidence"),
            F.lit(None).cast("struct<left:double,top:double,width:double,height:double>").alias("bbox"),
        ))).drop("doc_id", "source", "line")
        page_files.write_pages(blocks, grouped(t), path)
        return path

    return t.once("page_folder", write)


@query("page_files", """
SELECT page_id, block_id, CAST(row_number() OVER (PARTITION BY page_id ORDER BY pos) - 1 AS INT) AS pos, text, "left", top, height,
       CAST(column_index AS DOUBLE) AS column_index, display_title, page_width, page_height, page_subject FROM v_blocks
""")
def _(t):
    """Written pages read back and flattened."""
    return flatten.explode_blocks(page_files.read_page_lines(t.spark, page_folder(t))).select(
        "page_id", "block_id", "pos", "text", "left", "top", "height",
        F.col("column_index").cast("double").alias("column_index"), "display_title", "page_width", "page_height",
        "page_subject",
    )


@query("page_file_problems", """
SELECT page_id, unit_id, subject, count(*) FILTER (role = 'stem') AS stems, count(*) FILTER (role = 'choice') AS choices,
       count(*) FILTER (role = 'figure') AS figures FROM v_grouped GROUP BY page_id, unit_id, subject
""")
def _(t):
    units = flatten.explode_problems(page_files.read_page_lines(t.spark, page_folder(t)))
    return units.select(
        "page_id", "unit_id", "subject", F.size("stem_block_ids").alias("stems"), F.size("choice_block_ids").alias("choices"),
        F.size("figure_block_ids").alias("figures"),
    )


@query("page_array_files", """
SELECT page_id, CAST(n_chars AS INT) AS width_px, 3 AS n_blocks, 'b-' || page_id || '-2' AS last_id, source AS source_path
FROM (SELECT CAST(doc_id AS VARCHAR) AS page_id, n_chars, source FROM documents)
""")
def _(t):
    """Files that hold one JSON array of a hundred pages each, read back."""
    page_id = F.col("doc_id").cast("string")
    page = F.struct(
        page_id.alias("page_id"), F.col("n_chars").cast("int").alias("width_px"), F.col("source").alias("source_path"),
        F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: F.struct(F.concat(F.lit("b-"), page_id, F.lit("-"), i.cast("string")).alias("block_id"))).alias("blocks"),
    )
    path = scale.fresh_path(t.spark, "arrays")
    shelf = F.expr("doc_id div 100").alias("shelf")
    arrays = t.table("documents").groupBy(shelf).agg(F.to_json(F.collect_list(page), {"pretty": "true"}).alias("value"))
    arrays.write.partitionBy("shelf").text(path)
    found = page_files.read_pages(t.spark, path)
    return found.select(
        "page_id", "width_px", F.size("blocks").alias("n_blocks"), F.element_at("blocks", -1)["block_id"].alias("last_id"), "source_path"
    )


LINES_SQL = "SELECT page_id, block_id, CAST(line_no - 1 AS INT) AS line_no, text FROM v_lines"


@query("explode_lines", LINES_SQL.replace("line_no - 1", "line_no"))
def _(t):
    pages = page_files.read_page_lines(t.spark, page_folder(t))
    return flatten.explode_lines(flatten.explode_blocks(pages)).select("page_id", "block_id", "line_no", "text")


@query("ingest_lines", LINES_SQL.replace("line_no - 1", "line_no"))
def _(t):
    """The lines of the written page files taken in as a stream."""
    out, log = scale.fresh_path(t.spark, "lines"), scale.fresh_path(t.spark, "log")
    ingest.ingest_stream(t.spark, page_folder(t), out, log, table="lines", json_lines=True).awaitTermination()
    return t.spark.read.parquet(out).select("page_id", "block_id", "line_no", "text")


@query("ingest_stream", "SELECT page_id, block_id, text, reading_order FROM v_blocks")
def _(t):
    """The written page files taken in as a stream, each file once."""
    out, log = scale.fresh_path(t.spark, "blocks"), scale.fresh_path(t.spark, "log")
    ingest.ingest_stream(t.spark, page_folder(t), out, log, json_lines=True).awaitTermination()
    return t.spark.read.parquet(out).select("page_id", "block_id", "text", "reading_order")


def ingested_folder(t: Tables) -> str:
    """The written page files taken in batch by batch, all three tables at once."""
    def take_in() -> str:
        out, log = scale.fresh_path(t.spark, "taken"), scale.fresh_path(t.spark, "log")
        ingest.ingest_pages(t.spark, page_folder(t), out, log, json_lines=True).awaitTermination()
        return out

    return t.once("ingested_folder", take_in)


@query("ingest_problems", """
SELECT page_id, unit_id, subject, count(*) FILTER (role = 'stem') AS stems, count(*) FILTER (role = 'choice') AS choices,
       count(*) FILTER (role = 'figure') AS figures FROM v_grouped GROUP BY page_id, unit_id, subject
""")
def _(t):
    units = ingest.ingested(t.spark, ingested_folder(t), "problems")
    return units.select(
        "page_id", "unit_id", "subject", F.size("stem_block_ids").alias("stems"), F.size("choice_block_ids").alias("choices"),
        F.size("figure_block_ids").alias("figures"),
    )


@query("ingest_counts", """
SELECT (SELECT count(DISTINCT page_id) FROM v_blocks) AS pages, (SELECT count(*) FROM v_blocks) AS blocks, (SELECT count(*) FROM v_lines) AS lines,
       (SELECT count(*) FROM (SELECT DISTINCT page_id, unit_id FROM v_grouped)) AS problems
""")
def _(t):
    """What the writes of all batches counted."""
    names = ["pages", "blocks", "lines", "problems"]
    return ingest.commits(t.spark, ingested_folder(t)).agg(*[F.sum(n).alias(n) for n in names])


@query("plan_files", """
SELECT problem_id, start_y, next_start_y, slot_span FROM v_placed
""")
def _(t):
    placed = scale.staged(order_boards(t))
    path = scale.fresh_path(t.spark, "plan")
    page_files.write_plan(placed, placement.placement_summary(placed, ["board_id"]), Template(), path)
    return page_files.read_plan(t.spark, path).select("problem_id", "start_y", "next_start_y", "slot_span")


# ----------------------------------------------------------------- sessions
def raw_sessions(t: Tables):
    """One session per order, the even ones in one spelling and the odd ones in the other."""
    k, price = F.col("o_orderkey"), F.col("o_totalprice")
    odd = k % 2 == 1
    name = F.concat(F.lit("s"), k.cast("string"))
    old = F.struct(
        name.alias("session_name"), F.lit(2).alias("input_file_count"), F.array(F.lit("a"), F.lit("b")).alias("input_files"),
        F.lit("C:\\out\\b.brd").alias("edb_file_uri"), F.struct(F.lit(0.9).alias("base_slot_height_pages")).alias("template"),
        F.struct(F.lit(" FORCE ").alias("mode"), F.lit("Gemini").alias("provider"), F.lit(3.5).alias("threshold")).alias("ai_fallback"),
        F.array(
            F.struct(
                F.lit("p1").alias("problem_id"), F.concat((k % 9 + 1).cast("string"), F.lit(". find x")).alias("title"),
                F.col("o_orderpriority").alias("subject"), (price / 100000).alias("actual_content_height_pages"),
                (k % 3 == 0).alias("overflow_allowed"), F.lit("a\\b.png").alias("image_path"), (k % 5 == 0).alias("excluded"),
            ),
            F.struct(
                F.lit(None).cast("string").alias("problem_id"), F.lit("문항 12 · rest").alias("title"), F.lit("").alias("subject"),
                F.lit(None).cast("double").alias("actual_content_height_pages"), F.lit(None).cast("boolean").alias("overflow_allowed"),
                F.lit("http://x/y").alias("image_path"), F.lit(None).cast("boolean").alias("excluded"),
            ),
        ).alias("problems"),
    )
    new = F.struct(
        name.alias("sessionName"), F.lit("page").alias("exportMode"), F.lit("off").alias("unknownKey"),
        F.struct(F.lit("off").alias("mode"), F.lit(25.4).alias("maxRegions")).alias("aiFallback"),
        F.array(
            F.struct(
                F.concat(F.lit("id"), k.cast("string")).alias("id"), F.lit("page_1-Problem 7").alias("title"), (k % 4).alias("problemNumber"),
                (price / 100000).alias("actualHeightPages"), F.lit(True).alias("isExcluded"),
            )
        ).alias("problems"),
    )
    text = F.when(odd, F.to_json(new)).otherwise(F.to_json(old))
    made = t.table("orders").select(F.from_json(text, sessions.SESSION_DDL).alias("s")).select("s.*")
    return sessions.normalize_sessions(made)


@query("sessions", """
SELECT 's' || o_orderkey AS session_name, CASE WHEN odd THEN 'page' ELSE 'question' END AS export_mode,
       CAST(CASE WHEN odd THEN 0 ELSE 2 END AS DOUBLE) AS input_file_count, CASE WHEN odd THEN 0 ELSE 2 END AS files,
       CASE WHEN odd THEN '' ELSE 'file:///C:/out/b.brd' END AS board_file_uri, CAST(CASE WHEN odd THEN 1 ELSE 2 END AS DOUBLE) AS detected_problem_count,
       CAST(CASE WHEN NOT odd THEN 0.9 END AS DOUBLE) AS slot_height, CAST(CASE WHEN NOT odd THEN 50 END AS DOUBLE) AS board_page_count,
       CASE WHEN odd THEN 'off' ELSE 'force' END AS mode, CASE WHEN odd THEN 'openai' ELSE 'gemini' END AS provider,
       CAST(CASE WHEN odd THEN 0.72 ELSE 1 END AS DOUBLE) AS threshold, CASE WHEN odd THEN 25 ELSE 18 END AS max_regions,
       CASE WHEN odd THEN 12000 ELSE 15000 END AS timeout_ms, NOT odd AS enabled
FROM (SELECT *, o_orderkey % 2 = 1 AS odd FROM orders)
""")
def _(t):
    s, c = raw_sessions(t), "repair_config"
    return s.select(
        "session_name", "export_mode", "input_file_count", F.size("input_files").alias("files"), "board_file_uri",
        "detected_problem_count", "template.slot_height", "template.board_page_count", f"{c}.mode", f"{c}.provider",
        f"{c}.threshold", f"{c}.max_regions", f"{c}.timeout_ms", f"{c}.enabled",
    )


@query("session_files", """
SELECT 's' || o_orderkey AS session_name, CASE WHEN odd THEN '' ELSE 'pages.json' END AS pages_path,
       CASE WHEN odd THEN 'placed.json' ELSE '' END AS placements_path, CASE WHEN odd THEN '' ELSE 'b.brd' END AS board_path,
       CASE WHEN odd THEN 'file:///C:/r/1.png,http://x/2' ELSE '' END AS rendered_page_uris,
       CASE WHEN odd THEN 'force' ELSE 'auto' END AS mode, CASE WHEN odd THEN 'gemini' ELSE 'openai' END AS provider,
       CASE WHEN odd THEN 'm' || o_orderkey ELSE 'gpt-5.4-mini' END AS model, odd AS provided,
       CAST(CASE WHEN odd THEN o_orderkey % 50 ELSE 0 END AS INT) AS attempted_page_count
FROM (SELECT *, o_orderkey % 2 = 1 AS odd FROM orders)
""")
def _(t):
    """File names and the correction summary of one session per order, in either spelling."""
    k = F.col("o_orderkey")
    name = F.concat(F.lit("s"), k.cast("string"))
    old = F.struct(name.alias("session_name"), F.lit("pages.json").alias("pages_json_path"), F.lit("b.brd").alias("edb_path"))
    new = F.struct(
        name.alias("sessionName"), F.lit("placed.json").alias("placementsJsonPath"),
        F.array(F.lit("C:\\r\\1.png"), F.lit("http://x/2")).alias("renderedPageFileUris"),
        F.struct(
            F.lit(" FORCE").alias("mode"), F.lit("Gemini ").alias("provider"), F.concat(F.lit(" m"), k.cast("string")).alias("model"),
            (k % 50).alias("attemptedPageCount"),
        ).alias("aiSummary"),
    )
    text = F.when(k % 2 == 1, F.to_json(new)).otherwise(F.to_json(old))
    made = sessions.normalize_sessions(t.table("orders").select(F.from_json(text, sessions.SESSION_DDL).alias("s")).select("s.*"))
    s = "repair_summary"
    return made.select(
        "session_name", "pages_path", "placements_path", "board_path", F.array_join("rendered_page_uris", ",").alias("rendered_page_uris"),
        *[f"{s}.{n}" for n in ("mode", "provider", "model", "provided", "attempted_page_count")],
    )


@query("request_options", """
SELECT event_id, event_id % 4 = 0 AS enabled, CASE event_id % 3 WHEN 0 THEN 'force' WHEN 1 THEN 'auto' END AS mode,
       CASE WHEN event_id % 3 = 1 THEN 'gemini' ELSE 'openai' END AS provider,
       CASE event_id % 3 WHEN 0 THEN 'top' WHEN 1 THEN 'low' ELSE '' END AS model,
       CASE WHEN event_id % 3 = 0 THEN CAST(event_id % 100 AS INT) END AS max_regions,
       CASE WHEN event_id % 3 = 1 THEN CAST(event_id % 8 AS DOUBLE) / 8 END AS threshold, event_id % 3 = 1 AS save_debug
FROM events
""")
def _(t):
    """Requests whose settings stand at the top, in a nested object, or both."""
    n = F.col("event_id")
    flag = F.when(n % 4 == 0, "on").otherwise("0").alias("aiFallbackEnabled")
    low = F.struct(F.lit("low").alias("model"), F.lit("auto").alias("mode"))
    top = F.struct(flag, F.lit("top").alias("model"), F.lit("force").alias("ai_fallback_mode"), (n % 100).alias("maxRegions"), low.alias("ai_fallback"))
    nested = F.struct(
        F.lit("low").alias("aiFallbackModel"), F.lit("auto").alias("mode"), F.lit("gemini").alias("provider"),
        (n % 8 / 8).alias("threshold"), F.lit(True).alias("saveDebug"), F.lit(False).alias("enabled"),
    )
    deep = F.struct(flag, nested.alias("ai_fallback"), F.lit("auto").alias("aiFallback"))
    text = F.when(n % 3 == 0, F.to_json(top)).when(n % 3 == 1, F.to_json(deep)).otherwise(F.to_json(F.struct(flag)))
    made = sessions.request_options(t.table("events").select("event_id", text.alias("payload")))
    names = ["enabled", "mode", "provider", "model", "max_regions", "threshold", "save_debug"]
    return made.select("event_id", *[f"options.{c}" for c in names])


@query("session_problems", """
SELECT 's' || o_orderkey AS session_name, i AS "index",
       CASE WHEN odd THEN 'id' || o_orderkey WHEN i = 0 THEN 'p1' ELSE 'problem-02' END AS problem_id,
       CASE WHEN odd THEN '문항 ' || CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 ELSE 7 END WHEN i = 0 THEN 'find x' ELSE '문항 12' END AS title,
       CAST(CASE WHEN odd THEN CASE WHEN o_orderkey % 4 > 0 THEN o_orderkey % 4 ELSE 7 END WHEN i = 0 THEN o_orderkey % 9 + 1 ELSE 12 END AS INT) AS problem_number,
       CASE WHEN odd OR i = 1 THEN 'unknown' ELSE o_orderpriority END AS subject,
       CASE WHEN odd THEN '' WHEN i = 0 THEN 'a/b.png' ELSE 'http://x/y' END AS image_path,
       CASE WHEN i = 1 THEN 0.9 ELSE o_totalprice / 100000 END AS content_height,
       NOT odd AND i = 0 AND o_orderkey % 3 = 0 AS overflow_allowed, odd OR (i = 0 AND o_orderkey % 5 = 0) AS excluded, CAST(1 AS DOUBLE) AS slot_span
FROM (SELECT *, o_orderkey % 2 = 1 AS odd FROM orders), (SELECT unnest([0, 1]) AS i) WHERE NOT odd OR i = 0
""")
def _(t):
    return sessions.session_problems(raw_sessions(t)).select(
        "session_name", "index", "problem_id", "title", "problem_number", "subject", "image_path", "content_height",
        "overflow_allowed", "excluded", "slot_span",
    )


@query("parse_titles", """
SELECT block_id, CAST(CASE pos % 5 WHEN 0 THEN pos // 5 % 999 + 1 WHEN 1 THEN pos % 999 + 1 WHEN 2 THEN pos % 999 END AS DOUBLE) AS number,
       CASE pos % 5 WHEN 0 THEN 'tail' WHEN 1 THEN '' WHEN 2 THEN '' WHEN 3 THEN 'problem' ELSE 'x 3.' END AS rest
FROM v_blocks
""")
def _(t):
    n = F.col("pos")
    raw = (
        F.when(n % 5 == 0, F.concat(F.lit(" 문항 "), (F.floor(n / 5) % 999 + 1).cast("string"), F.lit(") tail ")))
        .when(n % 5 == 1, F.concat(F.lit("문항 "), (n % 999 + 1).cast("string"), F.lit(" - more")))
        .when(n % 5 == 2, F.concat(F.lit("page_Problem "), (n % 999).cast("string")))
        .when(n % 5 == 3, F.lit(" problem")).otherwise(F.lit("x 3. "))
    )
    number, rest = tx.parsed_title(raw)
    return t.blocks.select("block_id", number.cast("double").alias("number"), rest.alias("rest"))


o.cte("v_feed", """
SELECT p.page_id, p.unit_id, p.problem_index, p.subject, coalesce(nullif(trim(p.title), ''), p.page_id || ' problem ' || p.problem_index) AS title,
       coalesce(b.content_height, 1.0) AS content_height, coalesce(b.overflow_allowed, FALSE) AS overflow_allowed,
       coalesce(b.start_y, 0) AS start_y, coalesce(b.next_start_y, 0) AS next_start_y, coalesce(b.overflow_amount, 0) AS overflow_amount,
       coalesce(b.overflow_violation, FALSE) AS overflow_violation, coalesce(b.slot_span, 1) AS slot_span,
       CASE WHEN CAST(p.page_id AS BIGINT) % 2 = 0 THEN 'board-' || p.page_id END AS board_path
FROM v_problems p LEFT JOIN (SELECT * FROM v_board WHERE problem_index % 3 > 0) b ON p.unit_id = b.unit_id
""")


def feed(t: Tables):
    placed = placement.place(layout(t), ["page_id"], ["problem_index"]).where("problem_index % 3 > 0")
    boards = t.pages.where("doc_id % 2 = 0").select("page_id", F.concat(F.lit("board-"), "page_id").alias("board_path"))
    units = grouping.problems_of(grouped(t), titles(t)).select("page_id", "unit_id", "problem_index", "subject", "title")
    return session.feed_titles(session.session_feed(units, placed, boards))


@query("session_feed", "SELECT * FROM v_feed")
def _(t):
    return feed(t)


@query("session_header", """
SELECT p.session_id, p.input_file_count, p.source_page_count, coalesce(f.n, 0) AS detected_problem_count,
       CASE WHEN p.input_file_count > 1 THEN 'batch' ELSE 'single' END AS source_mode,
       coalesce(f.n, 0) > 0 AND coalesce(f.n, 0) <= p.source_page_count AS weak_split_warning
FROM (SELECT doc_id // 4 AS session_id, count(DISTINCT source) AS input_file_count, count(*) AS source_page_count FROM v_pages GROUP BY 1) p
LEFT JOIN (SELECT CAST(page_id AS BIGINT) // 4 AS session_id, count(*) AS n FROM v_problems GROUP BY 1) f ON p.session_id = f.session_id
""")
def _(t):
    sources = t.pages.select(F.floor(F.col("doc_id") / 4).alias("session_id"), "source")
    units = grouping.problems_of(grouped(t)).select(F.floor(F.col("page_id").cast("bigint") / 4).alias("session_id"))
    return session.session_header(units, sources)


@query("active_problems", "SELECT problem_id FROM v_heights WHERE problem_id % 4 <> 0")
def _(t):
    return session.active_problems(t.heights.withColumn("excluded", F.col("problem_id") % 4 == 0)).select("problem_id")


# ------------------------------------------------------------- queue, edits
o.cte("v_current", """
SELECT o_custkey AS queue_id, o_orderkey AS seq, 'f' || (o_orderkey % 7) AS name, o_orderkey % 3 AS size, o_orderkey // 5000 AS modified,
       concat_ws('::', 'f' || (o_orderkey % 7), o_orderkey % 3, o_orderkey // 5000) AS file_key
FROM orders WHERE o_orderkey % 2 = 0
""")
o.cte("v_incoming", """
SELECT o_custkey AS queue_id, o_orderkey AS seq, 'f' || (o_orderkey % 7) AS name, o_orderkey % 3 AS size, o_orderkey // 5000 AS modified,
       concat_ws('::', 'f' || (o_orderkey % 7), o_orderkey % 3, o_orderkey // 5000) AS file_key
FROM orders WHERE o_orderkey % 2 = 1
""")


def files(t: Tables, part: int):
    k = F.col("o_orderkey")
    return t.table("orders").where(k % 2 == part).select(
        F.col("o_custkey").alias("queue_id"), k.alias("seq"), F.concat(F.lit("f"), (k % 7).cast("string")).alias("name"),
        (k % 3).alias("size"), F.floor(k / 5000).alias("modified"),
    )


@query("merge_queue", """
SELECT queue_id, name, size, modified, file_key, row_number() OVER (PARTITION BY queue_id ORDER BY part, seq) AS position
FROM (SELECT *, 0 AS part FROM v_current c WHERE NOT EXISTS (SELECT 1 FROM v_incoming i WHERE i.queue_id = c.queue_id AND i.file_key = c.file_key)
      UNION ALL SELECT *, 1 FROM v_incoming)
""")
def _(t):
    return session.merge_queue(files(t, 0), files(t, 1))


@query("merge_queue_replace", """
SELECT queue_id, name, size, modified, file_key, row_number() OVER (PARTITION BY queue_id ORDER BY seq) AS position
FROM (SELECT queue_id, file_key, min(seq) AS seq, arg_max(name, seq) AS name, arg_max(size, seq) AS size, arg_max(modified, seq) AS modified
      FROM v_incoming GROUP BY queue_id, file_key)
""")
def _(t):
    return session.merge_queue(files(t, 0), files(t, 1), replace=True)


o.cte("v_list", """
SELECT board_id, problem_id, 'p' || problem_id AS title, height_pages, problem_id % 6 = 0 AS excluded,
       row_number() OVER (PARTITION BY board_id ORDER BY problem_id) - 1 AS seq, count(*) OVER (PARTITION BY board_id) AS n,
       CASE problem_id % 9 WHEN 0 THEN 'up' WHEN 1 THEN 'down' WHEN 2 THEN 'drop' WHEN 3 THEN 'duplicate' WHEN 4 THEN 'delete'
            WHEN 5 THEN 'toggle' WHEN 6 THEN 'patch' END AS action
FROM v_heights
""")
o.cte("v_edited", """
SELECT l.*, t.seq AS to_seq, count(*) FILTER (l.action = 'delete') OVER w AS deleted,
       max(CASE WHEN l.action = 'delete' THEN l.problem_id END) OVER w AS last_delete
FROM v_list l LEFT JOIN v_list t ON l.action = 'drop' AND t.board_id = l.board_id AND t.seq = 0
WINDOW w AS (PARTITION BY l.board_id)
""")


@query("apply_edits", """
SELECT board_id, problem_id, title, height_pages, excluded, row_number() OVER (PARTITION BY board_id ORDER BY k, e, problem_id) - 1 AS seq
FROM (
  SELECT board_id, CAST(problem_id AS VARCHAR) || CASE WHEN copy THEN '-copy' ELSE '' END AS problem_id,
         CASE WHEN action = 'patch' THEN 'new' ELSE title END || CASE WHEN copy THEN ' 복제본' ELSE '' END AS title,
         CASE WHEN action = 'patch' THEN 2.5 ELSE height_pages END AS height_pages,
         CASE WHEN action = 'toggle' THEN NOT excluded ELSE excluded END AS excluded,
         CASE WHEN action = 'up' AND seq > 0 THEN seq - 1.5 WHEN action = 'down' AND seq < n - 1 THEN seq + 1.5
              WHEN action = 'drop' AND to_seq < seq THEN to_seq - 0.5 ELSE seq END + CASE WHEN copy THEN 0.25 ELSE 0 END AS k,
         CASE WHEN action IS NULL THEN -1 ELSE e0 END AS e
  FROM (SELECT *, e0p AS e0, unnest(CASE WHEN action = 'duplicate' THEN [FALSE, TRUE] ELSE [FALSE] END) AS copy
        FROM (SELECT *, problem_id AS e0p FROM v_edited)
        WHERE action IS NULL OR action <> 'delete' OR (deleted >= n AND problem_id = last_delete)))
""")
def _(t):
    k = F.col("problem_id")
    listed = scale.rank(t.heights, ["board_id"], [k], "seq").withColumn("seq", F.col("seq") - 1)
    listed = scale.staged(listed.select(
        "board_id", k.cast("string").alias("problem_id"), "seq", F.concat(F.lit("p"), k.cast("string")).alias("title"),
        "height_pages", (k % 6 == 0).alias("excluded"), k.alias("number"),
    ))
    first = listed.where("seq = 0").select("board_id", F.col("problem_id").alias("target_id"))
    actions = {0: "up", 1: "down", 2: "drop", 3: "duplicate", 4: "delete", 5: "toggle", 6: "patch"}
    n = F.col("number")
    edits = listed.withColumn("action", F.coalesce(*[F.when(n % 9 == i, a) for i, a in actions.items()])).where("action is not null")
    edits = edits.join(first, "board_id").select(
        "board_id", n.alias("edit_no"), "problem_id", "action", F.when(F.col("action") == "drop", F.col("target_id")).alias("target_id"),
        F.lit("new").alias("title"), F.lit(2.5).alias("height_pages"),
    )
    return session.apply_edits(listed.drop("number"), scale.staged(edits))


EDIT_ACTIONS = ("up", "down", "drop", "duplicate", "delete", "toggle", "patch", "down", "drop", "up")
o.cte("v_edit_log", f"""
SELECT board_id, row_number() OVER (PARTITION BY board_id ORDER BY (number * 31 + k * 17) % 101, number, k) AS edit_no, problem_id,
       {list(EDIT_ACTIONS)}[1 + (number + k * k) % {len(EDIT_ACTIONS)}] AS action, target_id, title, height_pages
FROM (SELECT board_id, CAST(problem_id AS VARCHAR) AS problem_id, problem_id AS number, unnest(range(1, 1 + problem_id % 6)) AS k,
             CAST(first_value(problem_id) OVER w AS VARCHAR) AS lowest, CAST(lead(problem_id, 2) OVER w AS VARCHAR) AS later FROM v_heights
      WINDOW w AS (PARTITION BY board_id ORDER BY problem_id)),
     LATERAL (SELECT CASE WHEN k % 2 = 0 THEN lowest ELSE later END AS target_id, 'edit ' || k AS title, k / 4 AS height_pages)
UNION ALL SELECT DISTINCT board_id, 1000000, 'extra', 'append', NULL, 'new', 1.58 FROM v_heights
UNION ALL SELECT DISTINCT board_id, 1000001, 'extra', 'up', NULL, NULL, NULL FROM v_heights
""")
_AT = "list_position(list_transform(l, lambda x: x.problem_id), e.problem_id)"
_TO = "list_position(list_transform(l, lambda x: x.problem_id), e.target_id)"


@query("apply_edit_log", f"""
, logged AS (
    SELECT *, row_number() OVER (PARTITION BY board_id ORDER BY edit_no) AS step FROM v_edit_log
), lists AS (
    SELECT board_id, list(struct_pack(problem_id := CAST(problem_id AS VARCHAR), origin_id := CAST(problem_id AS VARCHAR), title := title,
                                      height_pages := CAST(height_pages AS DOUBLE), excluded := excluded) ORDER BY seq) AS l
    FROM v_list GROUP BY board_id
), states AS (
    SELECT board_id, CAST(0 AS BIGINT) AS step, l FROM lists
    UNION ALL
    SELECT board_id, step, CASE
        WHEN action = 'append' THEN l || [struct_pack(problem_id := pid, origin_id := CAST(NULL AS VARCHAR), title := title, height_pages := CAST(height AS DOUBLE), excluded := FALSE)]
        WHEN i IS NULL THEN l
        WHEN action = 'up' AND i > 1 THEN list_slice(l, 1, i - 2) || [l[i], l[i - 1]] || list_slice(l, i + 1, len(l))
        WHEN action = 'down' AND i < len(l) THEN list_slice(l, 1, i - 1) || [l[i + 1], l[i]] || list_slice(l, i + 2, len(l))
        WHEN action = 'drop' AND j > i THEN list_slice(l, 1, i - 1) || list_slice(l, i + 1, j) || [l[i]] || list_slice(l, j + 1, len(l))
        WHEN action = 'drop' AND j < i THEN list_slice(l, 1, j - 1) || [l[i]] || list_slice(l, j, i - 1) || list_slice(l, i + 1, len(l))
        WHEN action = 'duplicate' THEN list_slice(l, 1, i) || [struct_pack(problem_id := pid || '-copy-' || edit_no, origin_id := l[i].origin_id,
             title := l[i].title || ' 복제본', height_pages := l[i].height_pages, excluded := l[i].excluded)] || list_slice(l, i + 1, len(l))
        WHEN action = 'delete' AND len(l) > 1 THEN list_slice(l, 1, i - 1) || list_slice(l, i + 1, len(l))
        WHEN action IN ('toggle', 'patch') THEN list_slice(l, 1, i - 1) || [struct_pack(problem_id := pid, origin_id := l[i].origin_id,
             title := CASE WHEN action = 'patch' THEN title ELSE l[i].title END,
             height_pages := CASE WHEN action = 'patch' THEN CAST(height AS DOUBLE) ELSE l[i].height_pages END,
             excluded := CASE WHEN action = 'toggle' THEN NOT l[i].excluded ELSE l[i].excluded END)] || list_slice(l, i + 1, len(l))
        ELSE l END
    FROM (SELECT s.board_id, e.step, e.action, e.problem_id AS pid, e.edit_no, e.title, e.height_pages AS height, s.l, {_AT} AS i, {_TO} AS j
          FROM states s JOIN logged e ON e.board_id = s.board_id AND e.step = s.step + 1)
), ended AS (
    SELECT board_id, arg_max(l, step) AS l FROM states GROUP BY board_id
)
SELECT board_id, p.problem_id, p.origin_id, seq, p.title, p.height_pages, p.excluded
FROM (SELECT board_id, unnest(l) AS p, unnest(range(len(l))) AS seq FROM ended)
""")
def _(t):
    """Up to five edits of each problem, those of a board mixed, and an appended problem that moves up."""
    k, number = F.col("k"), F.col("problem_id")
    listed = scale.rank(t.heights.select("board_id", "problem_id", "height_pages"), ["board_id"], [number], "seq")
    listed = scale.staged(listed.withColumn("seq", F.col("seq") - 1))
    lowest = listed.where("seq = 0").select("board_id", F.col("problem_id").alias("_lowest"))
    later = listed.select("board_id", (F.col("seq") - 2).alias("seq"), F.col("problem_id").alias("_later"))
    each = listed.where("problem_id % 6 > 0").join(lowest, "board_id").join(later, ["board_id", "seq"], "left")
    each = each.withColumn("k", F.explode(F.sequence(F.lit(1).cast("bigint"), number % 6)))
    each = scale.rank(each, ["board_id"], [F.pmod(number * 31 + k * 17, F.lit(101)), number, k], "edit_no")
    actions = F.array(*map(F.lit, EDIT_ACTIONS))
    edits = each.select(
        "board_id", "edit_no", number.cast("string").alias("problem_id"), F.element_at(actions, (1 + (number + k * k) % len(EDIT_ACTIONS)).cast("int")).alias("action"),
        F.when(k % 2 == 0, F.col("_lowest")).otherwise(F.col("_later")).cast("string").alias("target_id"), F.concat(F.lit("edit "), k).alias("title"), (k / 4).alias("height_pages"),
    )
    boards = listed.select("board_id").distinct()
    for no, action, title, height in ((1_000_000, "append", "new", 1.58), (1_000_001, "up", None, None)):
        edits = edits.unionByName(boards.select(
            "board_id", F.lit(no).alias("edit_no"), F.lit("extra").alias("problem_id"), F.lit(action).alias("action"), F.lit(None).cast("string").alias("target_id"),
            F.lit(title).cast("string").alias("title"), F.lit(height).cast("double").alias("height_pages"),
        ))
    titled = listed.select("board_id", "problem_id", "seq", F.concat(F.lit("p"), number).alias("title"), "height_pages", (number % 6 == 0).alias("excluded"))
    return editlog.apply_edit_log(titled, scale.staged(edits))


# ---------------------------------------------------------------- summaries
@query("run_summary", """
SELECT source, CAST(sum(page_count) AS BIGINT) AS page_count, CAST(sum(a) AS BIGINT) AS ai_attempted_page_count, CAST(sum(b) AS BIGINT) AS ai_applied_page_count,
       CAST(sum(c) AS BIGINT) AS ai_cache_hit_count, CAST(sum(lo) AS BIGINT) AS route_local_only, CAST(sum(pa) AS BIGINT) AS route_ai_patch,
       CAST(sum(g) AS BIGINT) AS tier_green, CAST(sum(y) AS BIGINT) AS tier_yellow, CAST(sum(r) AS BIGINT) AS tier_red,
       CAST(sum(problems) AS BIGINT) AS problem_count, CAST(sum(blocks) AS BIGINT) AS block_count, CAST(sum(texts) AS BIGINT) AS text_block_count,
       CAST(sum(images) AS BIGINT) AS image_block_count, CAST(sum(fallbacks) AS BIGINT) AS fallback_block_count,
       CAST(sum(un) AS BIGINT) AS route_unknown, CAST(sum(hits) AS BIGINT) AS ocr_cache_hit_count, CAST(sum(misses) AS BIGINT) AS ocr_cache_miss_count
FROM (SELECT p.source, 1 AS page_count, CAST(s.status IN ('error', 'invalid_response', 'applied') AS INT) AS a,
             CAST(s.status IN ('cache_hit', 'applied') AS INT) AS b, CAST(s.status = 'cache_hit' AS INT) AS c,
             CAST(s.route = 'local_only' AND s.p % 10 > 0 AS INT) AS lo, CAST(s.route = 'ai_patch' AND s.p % 10 > 0 AS INT) AS pa,
             CAST(s.p % 10 = 0 AS INT) AS un, coalesce(b.hits, 0) AS hits, coalesce(b.misses, 0) AS misses, CAST(s.tier = 'green' AS INT) AS g,
             CAST(s.tier = 'yellow' AS INT) AS y, CAST(s.tier = 'red' AS INT) AS r, coalesce(u.n, 0) AS problems, coalesce(b.n, 0) AS blocks,
             coalesce(b.texts, 0) AS texts, coalesce(b.images, 0) AS images, coalesce(b.fallbacks, 0) AS fallbacks
      FROM v_pages p JOIN v_status s ON p.page_id = s.page_id
      LEFT JOIN (SELECT page_id, count(*) AS n FROM v_problems GROUP BY 1) u ON p.page_id = u.page_id
      LEFT JOIN (SELECT page_id, count(*) AS n, count(text) AS texts, count(*) FILTER (block_type = 'image') AS images, count(fallback_reason) AS fallbacks,
                        count(*) FILTER (pos % 3 = 0) AS hits, count(*) FILTER (pos % 3 = 1) AS misses
                 FROM v_blocks GROUP BY 1) b ON p.page_id = b.page_id)
GROUP BY ROLLUP (source)
""")
def _(t):
    source = t.pages.select("page_id", "source")
    routed = statuses(t).join(source, "page_id")
    routed = routed.withColumn("route", F.when(F.col("page_id").cast("bigint") % 10 != 0, F.col("route")))
    blocks = t.block_table.withColumns({"ocr_cache_hit": F.col("pos") % 3 == 0, "ocr_cache_miss": F.col("pos") % 3 == 1})
    units = grouping.problems_of(grouped(t)).select("page_id").join(source, "page_id")
    made = session.run_summary(scale.staged(routed), blocks, units)
    of = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0)).alias(f"{m.split('_')[0]}_{k}")
    flat = [of("route_counts", k) for k in ("local_only", "ai_patch", "unknown")] + [of("tier_counts", k) for k in ("green", "yellow", "red")]
    return made.select(*[c for c in made.columns if not c.endswith(("route_counts", "tier_counts"))], *flat)


@query("repair_usage", """
SELECT CAST(page_id AS BIGINT) % 20 AS batch, count(*) FILTER (status IN ('error', 'invalid_response', 'applied')) AS attempted_page_count,
       count(*) FILTER (status IN ('cache_hit', 'applied')) AS applied_page_count, count(*) FILTER (status = 'cache_hit') AS ai_cache_hit_count,
       count(*) FILTER (status = 'disabled') AS disabled, count(*) FILTER (p % 8 = 0) AS unknown, count(*) FILTER (route = 'ai_patch') AS patched,
       count(*) FILTER (tier = 'red' AND p % 3 > 0) AS red, CAST(coalesce(sum(hits), 0) AS BIGINT) AS ocr_cache_hit_count,
       CAST(coalesce(sum(misses), 0) AS BIGINT) AS ocr_cache_miss_count
FROM (SELECT * EXCLUDE (status), status, p AS q FROM v_status)
LEFT JOIN (SELECT page_id AS block_page, count(*) FILTER (pos % 3 = 0) AS hits, count(*) FILTER (pos % 3 = 1) AS misses
           FROM v_blocks GROUP BY 1) ON page_id = block_page
GROUP BY 1
""".replace("count(*) FILTER (status = 'disabled') AS disabled", "count(*) FILTER (status = 'disabled' AND p % 8 <> 0) AS disabled"))
def _(t):
    page = F.col("page_id").cast("bigint")
    rows = statuses(t).withColumns(
        {"batch": page % 20, "has_route": F.lit(True), "has_profile": page % 3 > 0, "status": F.when(page % 8 != 0, F.col("status"))}
    )
    at = F.col("pos") % 3
    read = t.block_table.select((page % 20).alias("batch"), (at == 0).alias("ocr_cache_hit"), (at == 1).alias("ocr_cache_miss"))
    made = session.repair_usage(scale.staged(rows), ["batch"], read)
    get = lambda m, k: F.coalesce(F.try_element_at(m, F.lit(k)), F.lit(0))
    return made.select(
        "batch", "attempted_page_count", "applied_page_count", "ai_cache_hit_count", get("status_counts", "disabled").alias("disabled"),
        get("status_counts", "unknown").alias("unknown"), get("route_counts", "ai_patch").alias("patched"),
        get("route_tier_counts", "red").alias("red"), "ocr_cache_hit_count", "ocr_cache_miss_count",
    )


@query("merge_status_maps", """
SELECT event_type AS status, CAST(sum(k) AS DOUBLE) AS count
FROM (SELECT event_type, CAST(json_extract(props, '$.k') AS INT) - 20 AS k, event_id FROM events) WHERE k >= 0 AND event_id % 7 > 0 GROUP BY 1
""")
def _(t):
    k = F.get_json_object("props", "$.k").cast("double") - 20
    name = F.when(F.col("event_id") % 7 > 0, F.col("event_type")).otherwise("")
    rows = t.table("events").select(F.create_map(name, k).alias("status_counts"))
    return session.merge_status_maps(rows)


@query("board_titles", """
SELECT problem_id, CASE WHEN problem_id % 3 = 0 AND t <> '' THEN t WHEN problem_id % 3 = 0 THEN '문항 ' || (problem_id + 1)
       WHEN t = '' OR t = '문항 4' THEN '문항 4' ELSE '문항 4 · ' || t END AS heading
FROM (SELECT problem_id, CASE problem_id % 4 WHEN 0 THEN '' WHEN 1 THEN '문항 4' ELSE 'x' || problem_id END AS t FROM v_heights)
""")
def _(t):
    n = F.col("problem_id")
    title = F.when(n % 4 == 0, " ").when(n % 4 == 1, "문항 4").otherwise(F.concat(F.lit("x"), n.cast("string")))
    number = F.when(n % 3 != 0, F.lit(4))
    return t.heights.select("problem_id", tx.problem_heading(title, number, n).alias("heading"))


@query("fine_packing", "SELECT problem_id, start_y, next_start_y, bottom_y FROM (" + o.placed(
    "(SELECT * FROM v_heights WHERE problem_id % 4 <> 0)", "board_id", "placed_on, problem_id", digits=2) + ")")
def _(t):
    """Repacking of the active problems with positions kept to two decimals."""
    kept = session.active_problems(t.heights.withColumn("excluded", F.col("problem_id") % 4 == 0))
    placed = placement.place(kept, ["board_id"], ["placed_on", "problem_id"], decimals=2)
    return placed.select("problem_id", "start_y", "next_start_y", "bottom_y")
