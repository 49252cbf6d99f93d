import shutil
import zlib
from collections import defaultdict

import corpus_pipeline
from foliospark.llm import packing, quality, secrets, templates
from test_packing import check

from foliospark.llm.common import raw  # noqa: F401

FOLDER = "/root/testdata/sf0.001"


def test_stages_follow_plain_rules(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality_classifier", "simhash_near_dedup", "benchmark_decontamination", "secret_scan", "packing"]
    seen = {}
    for name, step in corpus_pipeline.STAGES:
        found = step(spark, docs, FOLDER)
        if name != "packing":
            assert found.schema == docs.schema
        seen[name] = (docs.collect(), found.collect())
        docs = spark.createDataFrame(seen[name][1], found.schema)

    before, after = seen["quality_classifier"]
    model = quality.train_on(spark.createDataFrame(before), spark.read.parquet(f"{FOLDER}/labels.parquet"))
    assert {r.doc_id for r in after} == {r.doc_id for r in before if model.score(r.text.encode()) >= 0.3}

    before, after = seen["simhash_near_dedup"]
    shingles = {r.doc_id: {tuple(w[i : i + 5]) for w in [r.text.lower().split()] for i in range(len(w) - 4)} for r in before}
    kept = {r.doc_id for r in after}
    same = {}
    for r in before:
        same.setdefault(r.text, r.doc_id)
    assert all(i in kept or i not in same.values() or _has_mate(i, shingles, kept) for i in shingles)
    assert len({r.text for r in after}) == len(after)

    before, after = seen["benchmark_decontamination"]
    gone = {r.doc_id for r in before} - {r.doc_id for r in after}
    bench = [[templates.EDGES.sub("", w).lower() for w in r.text.split()][1:-1] for r in spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()]
    leaks = {r.doc_id for r in before if any(_inside(b, [templates.EDGES.sub("", w).lower() for w in r.text.split()]) for b in bench)}
    assert gone >= leaks and len(gone - leaks) <= 2

    before, after = seen["secret_scan"]
    texts = {r.doc_id: r.text for r in after}
    assert texts.keys() == {r.doc_id for r in before}
    assert all(not secrets.base_spans(t) for t in texts.values())
    assert all(texts[r.doc_id] == r.text for r in before if not secrets.scan(r.text)[0] and not secrets.scan(r.text)[2])
    assert all(r.n_chars == len(r.text) for r in after)

    before, after = seen["packing"]
    assert max(check(after, [(r.doc_id, r.text) for r in before])) == packing.WINDOW


def _inside(item, words):
    return any(words[i : i + len(item)] == item for i in range(len(words) - len(item) + 1))


def _has_mate(i, shingles, kept):
    return any(len(shingles[i] & shingles[j]) >= 0.7 * max(1, len(shingles[i] | shingles[j])) for j in kept) or not shingles[i]


def test_odd_and_empty_tables(spark, odd, empty, tmp_path):
    for name in ("labels", "benchmark"):
        shutil.copy(f"{FOLDER}/{name}.parquet", tmp_path / f"{name}.parquet")
    for docs in (odd, empty):
        for name, step in corpus_pipeline.STAGES:
            found = step(spark, docs, str(tmp_path))
            if name != "packing":
                assert found.columns == docs.columns, name
            found.collect()
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        rows = corpus_pipeline.run(spark, str(tmp_path)).collect()
        by = defaultdict(int)
        for r in rows:
            by[r.sequence_id] += r.length
        assert all(n == 2048 or n & (n - 1) == 0 for n in by.values())
        assert all(zlib.crc32(b"") != r.ids_crc32 for r in rows)
