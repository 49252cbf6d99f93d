import datetime
import pathlib
import sys

import pytest

sys.path.insert(0, str(pathlib.Path(__file__).parent))

from conftest_llm import prose  # noqa: E402

SCHEMA = (
    "doc_id bigint, text string, lang string, source string, n_chars bigint, _text string, bits string, mark int, "
    "`group` string, key string, host string, score string, number date"
)


@pytest.fixture(scope="session")
def odd(spark):
    """Null ids, null, empty, blank and very long texts, repeated rows, ties, and extra columns with names that
    operators use themselves."""
    texts = [
        (1, prose(1, 80)), (1, prose(1, 80)), (2, prose(1, 80)), (None, prose(2, 60)), (None, None), (3, None), (4, ""),
        (5, " \n\t "), (6, prose(3, 30_000)), (7, "é" * 5000), (None, prose(2, 60)), (1, prose(4, 70)), (8, "x"),
    ]
    rest = ("en", None, 3, "t", "b", 1, "g", "k", "h", "s", datetime.date(2020, 1, 1))
    return spark.createDataFrame([(i, t, *rest) for i, t in texts], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
