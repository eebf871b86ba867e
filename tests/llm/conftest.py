import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parent.parent.parent
sys.path[:0] = [str(ROOT), str(ROOT / "tests" / "llm")]

DOCUMENTS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture
def documents(spark):
    """Makes a table of documents from (doc_id, text) or (doc_id, text, lang) rows."""

    def make(rows, extra=False):
        full = [(r[0], r[1], r[2] if len(r) > 2 else "en", "s", len(r[1]) if r[1] is not None else None) for r in rows]
        df = spark.createDataFrame(full, DOCUMENTS)
        if extra:  # columns whose names the operators use inside
            df = df.selectExpr("*", "1 as part", "'x' as words", "2 as _id", "3 as score", "array(1) as bands", "map('a', 1) as root")
        return df

    return make
