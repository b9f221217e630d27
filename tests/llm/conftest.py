import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).parent))


@pytest.fixture(scope="session", autouse=True)
def shipped(spark):
    from epifold.sources.ship import ship

    ship(spark)


@pytest.fixture(scope="session")
def frame(spark):
    """Documents with every column of the table and some with the names of results."""

    def make(rows, parts=3):
        schema = (
            "doc_id long, text string, lang string, source string, n_chars long, "
            "component_id string, kept string, key string, rep string, score string, ids string, copy string, k1 string"
        )
        full = [(*r, *(None,) * (5 - len(r)), *("x",) * 8) for r in rows]
        return spark.createDataFrame(full, schema).repartition(parts)

    return make
