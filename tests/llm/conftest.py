import pytest
from samples import DOCS, as_documents, corpus


@pytest.fixture(scope="session")
def texts() -> list[tuple]:
    return corpus()


@pytest.fixture(scope="session")
def documents(spark, texts):
    return as_documents(spark, texts)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], DOCS)
