"""The registered queries against DuckDB, and the pipeline against its stages' models."""

import glob
import os

import duckdb
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from __spark_entry__ import oracle_sql, queries
from tidewatch.llm import queries as llm

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables are not there")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return con


@pytest.mark.parametrize("name", sorted(llm.ORACLE))
def test_query(spark, duck, name):
    found = queries()[name](spark, SF)
    columns = sorted(found.columns)
    want = duck.execute(f"SELECT {', '.join(columns)} FROM ({oracle_sql()[name]})").fetchall()
    assert sorted(map(tuple, found.select(columns).collect())) == sorted(want)


@pytest.mark.parametrize("name", sorted(set(llm.QUERIES) - set(llm.ORACLE)))
def test_one_row_for_every_document(spark, name):
    found = queries()[name](spark, SF)
    ids = found.select("doc_id").distinct().count()
    assert ids == spark.read.parquet(f"{SF}/documents.parquet").count()


def test_all_operators_are_registered():
    assert {n.split("_")[0] for n in llm.QUERIES} == {f"op{n}" for n in range(1, 14)}
    assert "pipeline" in queries()


def test_held_out_toxicity(spark):
    sf = "/root/testdata/sf0.1"
    scored = queries()["op4_toxicity"](spark, sf).where("held_out")
    both = scored.join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    hit, said, toxic = both.agg(F.sum(F.col("predicted") * F.col("toxic")), F.sum("predicted"), F.sum("toxic")).first()
    assert hit >= 0.9 * toxic and hit >= 0.9 * said


def test_pipeline_stages(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "line_dedup", "simhash", "secrets", "packing"]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        before = docs
        stage(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
        if k < 4:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
            assert docs.join(before, "doc_id", "left_anti").isEmpty()
            assert docs.where(F.length("text") != F.col("n_chars")).isEmpty()
        if name in ("line_dedup", "secrets"):
            assert docs.count() == before.count()
    assert docs.select("doc_id").distinct().count() == before.count()
    assert corpus_pipeline.run(spark, SF).count() == docs.count()


def test_pipeline_on_odd_documents(spark, tmp_path):
    rows = [(None, None, None, None, None), (None, "a b c d", "en", "s", 7), (1, "", "en", "s", 0), (1, "", "en", "s", 0),
            (2, "password=abcdefgh1\nx", "en", "s", 20), (3, "password=abcdefgh1\nx", "en", "s", 20), (4, "word " * 9000, "en", "s", 1)]
    kept = "doc_id long, text string, lang string, source string, n_chars long"
    for data in (rows, []):
        folder = tmp_path / str(len(data))
        docs = spark.createDataFrame(data, kept)
        docs.write.parquet(str(folder / "documents.parquet"))
        spark.createDataFrame([(1, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(folder / "labels.parquet"))
        found = corpus_pipeline.run(spark, str(folder)).collect()
        assert {r.doc_id for r in found} == ({None, 1, 2, 4} if data else set())
        # of the two rows of one id and text one is left, in one piece
        assert sum(r.doc_id == 1 for r in found) == (1 if data else 0)
