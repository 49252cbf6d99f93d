import duckdb

from foliospark.llm import queries


def test_queries_match_their_sql(spark, tmp_path):
    pages = [
        (0, "http://m.site.org/en/a", '<link href="https://site.net/a" rel=canonical>'),
        (1, "http://site.org/en/b", "<meta http-equiv='Refresh' content='0; URL=http://m.site.org/en/a'>"),
        (2, "http://x.example.net/en/d", "<link rel='canonical' href='//y.net/d'>"),
        (3, "http://z.org/fr/d?x#y", "<link rel='canonical' href='/d'>"), (4, None, None), (5, "no scheme", ""), (6, "http://Y.net", None),
    ]
    docs = [(i, "a b c " * i + "\nx #\nx #\n\n " + "é|" * i, f"s{i % 3}" if i % 5 else None) for i in range(40)] + [(None, None, "s0"), (1, "", "s1")]
    docs += [(100 + i, " ".join(f"w{j}" for j in range(60 + i)), "s9") for i in range(20)]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(str(tmp_path / "pages.parquet"))
    spark.createDataFrame(docs, "doc_id long, text string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    db = duckdb.connect()
    for name in ("pages", "documents"):
        db.execute(f"CREATE VIEW {name} AS SELECT * FROM '{tmp_path}/{name}.parquet/*.parquet'")
    for name, sql in queries.ORACLES.items():
        mine = queries.QUERIES[name](spark, str(tmp_path))
        names = sorted(mine.columns)
        theirs = db.execute(f"SELECT {', '.join(names)} FROM ({sql})").fetchall()
        assert sorted(map(repr, map(tuple, mine.select(names).collect()))) == sorted(map(repr, theirs)), name


def test_every_query_reads_the_small_tables(spark):
    for name, query in queries.QUERIES.items():
        found = query(spark, "/root/testdata/sf0.001")
        assert found.count() > 0, name
