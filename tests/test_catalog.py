import os
import subprocess
import sys

import pytest

import compare
from sondage.plans import catalog

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.FOLDER), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    return compare.database()


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query_equals_its_sql(spark, db, name):
    names, rows = compare.rows_of(catalog.QUERIES[name](spark, compare.FOLDER))
    if name in catalog.ORACLES:
        assert (names, rows) == compare.rows_of_sql(db, catalog.ORACLES[name])
    else:
        assert rows


def test_entry_has_rows(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_the_core_needs_no_llm_folder():
    code = "import sys; sys.modules['sondage.llm'] = None; import __spark_entry__ as e; assert 'b_and' in e.queries() and 'p1_found' not in e.queries()"
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    subprocess.run([sys.executable, "-c", code], cwd=root, check=True)
