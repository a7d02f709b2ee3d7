import importlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from netloom.llm import pii
from tests.llm.test_line_dedup import brute as repeated
from tests.llm.test_ngram_join import brute as near
from tests.llm.test_packing import hold

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns = docs.columns
    kept = [docs]
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, kept[-1], SF)
        if k < 4:
            assert out.columns == columns and out.schema.simpleString() == docs.schema.simpleString(), name
        kept.append(spark.createDataFrame(out.collect(), out.schema))
    good, lines, alone, masked, packed = kept[1:]
    truth = spark.read.parquet(f"{SF}/labels.parquet").join(docs, "doc_id")
    lost = truth.join(good, "doc_id", "left_anti")
    assert lost.where("quality = 1").count() <= 2 and truth.where("quality = 0").join(good, "doc_id", "left_semi").count() <= 2
    gone = repeated([(r.doc_id, r.text) for r in good.collect()])
    for r in good.join(lines.select("doc_id", F.col("text").alias("new")), "doc_id", "left").collect():
        want = "\n".join(x for k, x in enumerate(r.text.split("\n")) if (r.doc_id, k) not in gone)
        assert r.new == want or r.new is None and not want.strip()
    rows = [(r.doc_id, r.text) for r in lines.collect()]
    assert sorted(r.doc_id for r in alone.collect()) == sorted(set(near(rows)[1]))  # one of each class of links, the first
    assert alone.join(lines, ["doc_id", "text"], "left_anti").count() == 0
    assert all(not pii.find(r.text)[1] for r in masked.collect())
    hold(packed.collect(), [(r.doc_id, r.text) for r in masked.collect()], 2048)
    whole = corpus_pipeline.run(spark, SF)
    assert sorted(map(tuple, whole.select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(tuple, packed.select("doc_id", "piece", "ids_crc32").collect()))


def test_empty_table(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SF}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = list(__spark_entry__.queries())
    for n in range(1, 11):
        assert any(x.startswith(f"op{n}_") for x in names)
    assert "pipeline" in names and set(__spark_entry__.oracle_sql()) <= set(names)
    assert importlib.import_module("netloom.llm.queries")


@pytest.mark.parametrize("name", ["op5_preferences", "op10_topk"])
def test_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for t in ("conversations", "embeddings"):
        con.execute(f"create view {t} as select * from '{SF}/{t}.parquet'")
    want = con.sql(__spark_entry__.oracle_sql()[name])
    got = __spark_entry__.queries()[name](spark, SF)
    cols = sorted(got.columns)
    assert sorted(want.columns) == cols
    assert sorted(tuple(map(str, r)) for r in want.project(", ".join(f'"{c}"' for c in cols)).fetchall()) == sorted(tuple(map(str, r)) for r in got.select(cols).collect())
