import pytest

import __spark_entry__ as entry
from queries import FOLDER, database, same

CORE = {k: v for m in entry._modules() if "llm" not in m.__name__ for k, v in m.SQL.items()}
OTHER = [k for m in entry._modules() if "llm" not in m.__name__ for k in m.QUERIES if k not in CORE]
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="no test tables here")


@pytest.fixture(scope="module")
def db():
    return database()


@pytest.mark.parametrize("name", sorted(CORE))
def test_equal(spark, db, name):
    same(spark, db, entry.queries()[name], CORE[name])


@pytest.mark.parametrize("name", OTHER)
def test_runs(spark, name):
    entry.queries()[name](spark, str(FOLDER)).write.format("noop").mode("overwrite").save()
