"""Tables that come as a folder of many files, as large ones do."""

import os

import oracle

from boxloom.plans import load_all

SF = "/root/testdata/sf0.001"


def test_a_stream_reads_a_table_of_many_files(spark, tmp_path):
    queries, sql = load_all()
    spark.read.parquet(f"{SF}/pages.parquet").repartition(3).write.parquet(str(tmp_path / "pages.parquet"))
    names = [n for n in os.listdir(tmp_path / "pages.parquet") if n.endswith(".parquet")]
    assert len(names) == 3
    con = oracle.connect(SF)
    assert oracle.compare(queries["stream_score"](spark, str(tmp_path)), con, sql["stream_score"]) == ""
