"""Every catalogue query with an oracle agrees with DuckDB at sf0.01;
every query without one runs and returns rows."""

import os
import sys

import pytest

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from conftest import SF01
from oracle_check import compare

from postlens.plans import registry

registry.load_all()
ROWS_ONLY = sorted(set(registry.QUERIES) - set(registry.ORACLE_SQL))


@pytest.mark.parametrize("name", sorted(registry.ORACLE_SQL))
def test_oracle_pair(spark, name):
    told = compare(spark, SF01, [name], verbose=False)[name]
    assert told[0] == "ok", told


@pytest.mark.parametrize("name", ROWS_ONLY)
def test_rows_only(spark, name):
    import __spark_entry__ as ent
    assert ent.queries()[name](spark, SF01).count() > 0


def test_entry(spark):
    import __spark_entry__ as ent
    df = ent.entry(spark)
    assert df.count() > 0
    assert df.columns == ["term", "idx", "df", "idf"]
