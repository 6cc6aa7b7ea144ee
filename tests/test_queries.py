import pytest

from plinth.plans.catalogue import ORACLE, QUERIES
from tests.oracle import assert_same, views


@pytest.fixture(scope="module")
def tables(sf_dir):
    return views(sf_dir)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, sf_dir, tables, name):
    df = QUERIES[name](spark, sf_dir)
    if name in ORACLE:
        assert_same(df, tables, ORACLE[name])
    else:
        assert df.count() > 0


def test_row_hash_is_deterministic(spark, sf_dir):
    assert QUERIES["q_row_hash"](spark, sf_dir).collect() == QUERIES["q_row_hash"](spark, sf_dir).collect()


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_import_needs_no_session():
    import subprocess
    import sys

    code = "import __spark_entry__ as e; import plinth.functions.vectorised, plinth.operators.spatial, plinth.sources.readers, plinth.streaming.events; print(len(e.queries()))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True, cwd=__file__.rsplit("/", 2)[0]).stdout.split()[-1]) > 150
