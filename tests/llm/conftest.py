import pytest

from postmill.llm.queries import read

SMALL = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string"


@pytest.fixture(scope="session", autouse=True)
def workers_find_the_package(spark):
    read(spark, SMALL, "region")


@pytest.fixture
def docs(spark):
    """A frame of (doc_id, text), with more columns if a schema names them."""

    def make(*rows, schema=SCHEMA, parts=2):
        return spark.createDataFrame(list(rows), schema).repartition(parts)

    return make


@pytest.fixture(scope="session")
def documents(spark):
    return read(spark, SMALL, "documents")


def words_of(text):
    """Words between ASCII white space, by plain Python."""
    return (text or "").encode().split()
