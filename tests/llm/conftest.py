import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, fp bigint, secrets string"


@pytest.fixture(scope="session")
def make(spark):
    """Documents with extra columns whose names clash with those that operators add."""

    def build(rows):
        return spark.createDataFrame([(d, t, "en", None, None if t is None else len(t), 7, "x") for d, t in rows], SCHEMA)

    return build
