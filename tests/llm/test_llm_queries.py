import pytest

pytest.importorskip("celldays.llm")
from celldays.llm.queries import QUERIES, SQL
from queries import FOLDER, database, same

pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.mark.parametrize("name", sorted(SQL))
def test_equal(spark, name):
    same(spark, database(), QUERIES[name], SQL[name])


@pytest.mark.parametrize("name", [k for k in QUERIES if k not in SQL])
def test_runs(spark, name):
    assert QUERIES[name](spark, str(FOLDER)).toArrow().num_rows > 0
