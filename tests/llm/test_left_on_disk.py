"""What the steps of the training-data operators leave in the shared folder."""

import pytest

from boxloom.llm import jaccard, substrings


@pytest.mark.parametrize("operator", [substrings.removals, jaccard.one_of_each])
def test_tables_with_texts_or_windows_go_with_their_last_reader(spark, documents, monkeypatch, operator):
    made = []
    for module in (substrings, jaccard):
        real = module.stored
        monkeypatch.setattr(module, "stored", lambda df, real=real: made.append(real(df)) or made[-1])
    operator(documents)
    path = spark._jvm.org.apache.hadoop.fs.Path
    conf = spark._jsc.hadoopConfiguration()
    for df in made:
        if {"signatures", "sketch", "text", "earliest", "places", "prefix"} & set(df.columns):
            assert not any(path(f).getFileSystem(conf).exists(path(f)) for f in df.inputFiles()), df.columns
