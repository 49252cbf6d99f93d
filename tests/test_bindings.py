"""The given tables seen as layout tables, on texts that the small tables lack."""

import duckdb
from check import canonical

from foliospark.plans import catalog
from foliospark.plans.bindings import Tables

# Lines that begin or end with the digits of their own place, and lines with spaces around them.
LINES = ["0 zero 10", "1232 one 11", " two 22 ", "3 three 33", "4 four", "  ", "5 five 55", "6", " 7 seven 7 "]
TEXT_QUERIES = ["display_titles", "normalize_titles", "expand_boxes", "merge_boxes", "text_markers"]


def test_lines_keep_their_digits(spark, tmp_path):
    made = spark.createDataFrame([(i, "\n".join(LINES[i:]), "en", "src1") for i in range(4)], "doc_id bigint, text string, lang string, source string")
    made.write.parquet(f"{tmp_path}/documents.parquet")
    tables = Tables(spark, str(tmp_path))
    kept = [r.line for r in tables.blocks.where("doc_id = 0").orderBy("pos").collect()]
    assert kept == [s.strip(" ") for s in LINES if s.strip(" ")]
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    for name in TEXT_QUERIES:
        q = catalog.QUERIES[name]
        assert canonical(q.build(tables).toPandas()) == canonical(db.execute(q.oracle).df()), name
