import os

import pytest

import compare
from sondage.llm import queries, sql

pytestmark = pytest.mark.skipif(not os.path.isdir(compare.FOLDER), reason="no test tables here")

COLUMNS = {
    "p1_found": ["term", "mark"],
    "p3_found": ["doc_id", "term"],
    "p4_found": ["term", "doc_id"],
    "p5_found": ["point_id_a", "point_id_b"],
    "p6_found": ["doc_id"],
    "p7_found": ["doc_id", "item_id"],
    "p8_found": ["doc_id"],
}


@pytest.mark.parametrize("name", sorted(sql.ORACLES))
def test_query_equals_its_sql(spark, name):
    assert compare.rows_of(queries.QUERIES[name](spark, compare.FOLDER)) == compare.rows_of_sql(compare.database(), sql.ORACLES[name])


@pytest.mark.parametrize("name", sorted(COLUMNS))
def test_columns(spark, name):
    df = queries.QUERIES[name](spark, compare.FOLDER)
    assert df.columns == COLUMNS[name] and df.count() == df.distinct().count()
