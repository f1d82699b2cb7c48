"""Every registered query against its DuckDB SQL on the smallest tables."""

import os

import pytest

from checks import ALL
from checks.compare import compare, duck

SF = "/root/testdata/sf0.001"



@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.skipif(not os.path.isdir(SF), reason="driver tables are not there")
@pytest.mark.parametrize("name", list(ALL))
def test_equals_sql(spark, con, name):
    line = compare(spark, con, name, *ALL[name], SF)
    assert line.startswith(("ok", "rows")), line
