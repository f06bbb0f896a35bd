"""Every registered query runs, and equals its SQL where there is one."""

import pytest

import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent))
sys.path.insert(0, str(Path(__file__).parents[1]))

from compare import duck, spark_rows

from marginalia import catalog

DIR = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, name):
    got = spark_rows(catalog.queries()[name](spark, DIR))
    sql = catalog.oracle_sql().get(name)
    if sql:
        assert got == duck(sql, DIR)
    else:
        assert got[0]
