"""Registered queries of this folder, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from foliospark.llm import (
    chunks, classlm, html, idfile, packing, prefixes, quality, rules, secrets, simhash, sql, templates, urls, whitening,
)
from foliospark.llm.common import table

TOKENIZER = "word_bpe_49k.json"
BYTE_TOKENIZER = "byte_bpe_50k.json"
URL_RULES = [("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/")]


def op1_html_extraction(spark: SparkSession, folder: str) -> DataFrame:
    return html.extract(table(spark, folder, "pages"), ["page_id", "url"])


def op2_simhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.close_groups(table(spark, folder, "documents"))
    mark = F.lower(F.lpad(F.hex(F.col("bits").getItem(0)), 16, "0"))
    return found.select("doc_id", mark.alias("fingerprint"), "component_id")


def op3_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held_out = quality.fold_of(F.col("doc_id"), 5) == 0
    model = quality.train_on(docs, table(spark, folder, "labels").where(~held_out))
    found = quality.scored(docs, ["doc_id"], "text", model)
    return found.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= quality.CUT).cast("int").alias("predicted"))


def op4_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = templates.contaminated(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.drop("mark")


def op5_class_ngrams(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = classlm.score(docs, quality.fold_of(F.col("doc_id"), 7) != 2)
    return found.select(
        "doc_id", (~F.col("train")).alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op6_secret_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secrets(table(spark, folder, "documents"))
    def of_kind(kind):
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    kinds = [of_kind(k).alias(f"n_{k}") for k in ("assign", "access", "hex")]
    base = F.sha2(secrets.listed(F.col("base")).cast("binary"), 256)
    return found.select("doc_id", *kinds, base.alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"))


def op7_url_filter(spark: SparkSession, folder: str) -> DataFrame:
    pages = table(spark, folder, "pages")
    judged = urls.judge(pages.select("page_id", "url"), URL_RULES, urls.page_links(pages))
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op8_substring_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return chunks.repeats(table(spark, folder, "documents")).drop("mark")


def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return rules.host_verdicts(table(spark, folder, "documents")).select("doc_id", *rules.COUNTS, "base_failed", "kept")


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), public_tokenizers.path(TOKENIZER))


def op11_token_id_files(spark: SparkSession, folder: str) -> DataFrame:
    manifest = idfile.write(table(spark, folder, "documents"), public_tokenizers.path(BYTE_TOKENIZER))
    return idfile.read(spark, manifest)


def op12_embedding_whitening(spark: SparkSession, folder: str) -> DataFrame:
    rows, model = whitening.whiten(table(spark, folder, "embeddings"), ["vec_id"])
    error = model.identity_error if model else 0.0
    shares = F.array(*[F.lit(float(v / model.trace)) for v in model.sizes] if model else []).cast("array<double>")
    each = rows.select("vec_id", "deviation", F.posexplode("whitened").alias("at", "whitened"))
    return each.select(
        "vec_id", (F.col("at") + 1).alias("component"), F.lit(model.n if model else 0).cast("long").alias("n"), "deviation", "whitened",
        shares[F.col("at")].alias("explained"), F.lit(error).alias("identity_error"),
    )


def op13_conversation_trie(spark: SparkSession, folder: str) -> DataFrame:
    return prefixes.trie(prefixes.regrouped(prefixes.turn_rows(table(spark, folder, "conversations"))))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_html_extraction, op2_simhash_near_dedup, op3_quality_classifier, op4_benchmark_decontamination, op5_class_ngrams, op6_secret_scan, op7_url_filter,
        op8_substring_dedup, op9_quality_rules, op10_packing, op11_token_id_files, op12_embedding_whitening, op13_conversation_trie,
    )
}

ORACLES: dict[str, str] = {"op7_url_filter": sql.URLS, "op9_quality_rules": sql.RULES, "op13_conversation_trie": sql.TRIE}
