import sys
from pathlib import Path

import pytest

HERE = Path(__file__).resolve().parent
sys.path[:0] = [str(HERE), str(HERE.parent), str(HERE.parents[1])]


@pytest.fixture(scope="session")
def spark(spark):
    from corrobora.llm.runtime import prepare
    return prepare(spark)


@pytest.fixture
def docs_frame(spark):
    """Rows (doc_id, text) as documents with columns that clash with the operators' own names."""
    def make(rows):
        frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), "x", 1, 2, 3, "y") for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, removed string, n_entities int, id int, row int, new string")
        return frame
    return make
