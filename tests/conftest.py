import os
import sys
import tempfile

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from tabledoc import build_session  # noqa: E402

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="session")
def spark():
    session = build_session(
        "local[4]", "tabledoc-tests",
        spark__sql__shuffle__partitions="4",
        spark__driver__memory="4g",
        spark__ui__showConsoleProgress="false",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="tabledoc-tests-"),
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture(scope="session")
def sf_dir():
    return SF_DIR


@pytest.fixture(scope="session")
def pages_of(spark):
    """Pages from HTML texts, numbered from 1."""

    def make(*htmls):
        rows = [(i, f"http://x.example/{i}", h) for i, h in enumerate(htmls, 1)]
        return spark.createDataFrame(rows, "page_id bigint, url string, html string")

    return make


@pytest.fixture(scope="session")
def docs_of(spark):
    def make(*texts):
        return spark.createDataFrame(list(enumerate(texts, 1)), "doc_id bigint, text string")

    return make
