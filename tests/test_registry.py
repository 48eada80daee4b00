"""Every registered query of the grid library against its SQL on the smallest tables."""

import compare
import pytest

from wattline.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return compare.connect(SF)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_query(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    names, rows = compare.oracle_rows(duck, registry.oracle_sql()[name])
    assert sorted(df.columns) == names
    assert compare.alike(compare.rows_of(df), rows)
