"""Every query that has SQL gives the SQL's rows on the smallest tables; every other query runs."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
import __spark_entry__ as entry
import oracle

FOLDER = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not Path(FOLDER).exists(), reason="no test tables")
NAMES = sorted(n for n in entry.queries() if not n.startswith(("p6", "p7", "p8", "p9")))


@pytest.fixture(scope="module")
def duck():
    return oracle.connect(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, duck, name):
    said = oracle.compare(spark, duck, name, entry.queries()[name], entry.oracle_sql().get(name), FOLDER)
    assert said.startswith(("same", "rows only")), said


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
