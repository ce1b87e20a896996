import os

import pytest

import __spark_entry__ as entry
from weftline.streaming import filters

SF = "/root/testdata/sf0.001"


def test_entry_and_queries_are_consistent(spark):
    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) > 50
    if os.path.isdir(SF):
        assert entry.entry(spark).count() > 0


@pytest.mark.skipif(not os.path.isdir(SF), reason="no test data")
def test_streams(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "crawled_at")
    docs.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(docs.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("cleaned", filters.clean_stream(s), "append"), ("firsts", filters.first_copies(s, "crawled_at", "1000 days"), "append")):
        run = df.drop("w").writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
        run.awaitTermination(120)
    assert spark.table("firsts").count() == docs.select("text").distinct().count()
    assert 0 < spark.table("cleaned").count() < docs.count()
