import pytest

from tests.llm import cases


@pytest.fixture(scope="module")
def docs(spark):
    return cases.documents(spark)


@pytest.fixture(scope="module")
def none(spark):
    return cases.no_documents(spark)
