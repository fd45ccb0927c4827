"""Every registered query with a SQL twin gives the same rows as DuckDB."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from __spark_entry__ import entry, oracle_sql, queries  # noqa: E402
from riftsplit.queries import SQL  # noqa: E402
from tools.check_oracles import compare  # noqa: E402


# the queries of the training-data operators are tested beside them
NAMES = sorted(SQL)


@pytest.mark.parametrize("name", NAMES)
def test_matches_sql(spark, duck, sf_dir, name):
    df = queries()[name](spark, sf_dir)
    rows = [tuple(r) for r in df.collect()]
    rel = duck.execute(oracle_sql()[name])
    cols = [d[0] for d in rel.description]
    assert compare(rows, df.columns, rel.fetchall(), cols) == ""


def test_every_sql_has_a_query():
    assert set(oracle_sql()) <= set(queries())


def test_entry(spark):
    out = entry(spark)
    assert out.count() == 5
    assert {"size_train_size", "scaffold_shared_scaffolds"} <= set(out.columns)
    assert all(r["scaffold_shared_scaffolds"] == 0 for r in out.collect())
