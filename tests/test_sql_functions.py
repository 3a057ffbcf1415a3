"""The functions as SQL text give what their DataFrame versions give."""

import pytest
from pyspark.sql import functions as F

from mnemospark.functions import sql
from mnemospark.functions import text as T
from mnemospark.operators import chunking

TEXTS = [
    (0, "Running tests\n\n# A heading\nwe chose postgres.\r\nnext", ["chose", "run", ""]), (1, None, ["x"]), (2, "", []), (3, "no terms here " * 60, None),
    (4, "# Title\n" + "line of words\n" * 300 + "\n## Next one\n" + "far away zebra\n" * 40, ["zebra", "next"]), (5, " \n\n ", ["a"]), (6, "(a.b) A.B a.b" + " pad" * 100 + " a.b", ["a.b"])]


@pytest.fixture(scope="module")
def texts(spark):
    sql.register(spark)
    df = spark.createDataFrame(TEXTS, "doc_id int, text string, terms array<string>")
    df.createOrReplaceTempView("texts_of_test")
    return df


def test_chunks_as_sql(spark, texts):
    got = spark.sql("SELECT t.doc_id, c.chunk_no, c.start_line, c.end_line, c.body FROM texts_of_test t, LATERAL chunks(t.text) c").collect()
    want = chunking.chunk(texts).select("doc_id", "chunk_no", "start_line", "end_line", "text").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 5
    counted = spark.sql("SELECT t.doc_id, count(*) AS n FROM texts_of_test t, LATERAL chunks(t.text) c GROUP BY t.doc_id HAVING n > 2").collect()
    assert [r.doc_id for r in counted] == [4]


def test_terms_as_sql(spark, texts):
    got = {r.doc_id: r.t for r in spark.sql("SELECT doc_id, tokenize(text) AS t FROM texts_of_test").collect()}
    assert got == {r.doc_id: r.t or [] for r in texts.select("doc_id", T.tokenize(F.col("text")).alias("t")).collect()}
    assert "run" in got[0]


def test_snippets_as_sql(spark, texts):
    got = {r.doc_id: r.s for r in spark.sql("SELECT doc_id, snippet(text, terms) AS s FROM texts_of_test").collect()}
    assert got == {r.doc_id: r.s for r in texts.select("doc_id", T.snippet(F.col("text"), F.coalesce("terms", F.array().cast("array<string>"))).alias("s")).collect()}
    assert "zebra" in got[4]


def test_chunks_of_documents_as_sql(spark):
    from mnemospark.plans import queries

    sql.register(spark)
    spark.read.parquet("/root/testdata/sf0.001/documents.parquet").createOrReplaceTempView("documents_of_test")
    got = spark.sql("SELECT d.doc_id, c.start_line, c.end_line, md5(cast(c.body AS binary)) AS body FROM documents_of_test d, LATERAL chunks(d.text) c WHERE c.body IS NOT NULL").collect()
    want = {tuple(r) for r in queries.chunk_lines(spark, "/root/testdata/sf0.001").collect()}
    assert want <= {tuple(r) for r in got}  # chunk_lines leaves out chunks that aren't printable
