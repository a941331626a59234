import pytest
from llm_helpers import make_docs


@pytest.fixture
def docs_of(spark):
    return lambda rows, **more: make_docs(spark, rows, **more)
