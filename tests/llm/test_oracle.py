import pytest

import __spark_entry__
from tests.compare import difference
from windloom.llm.oracle import ORACLE

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(spark, name):
    assert difference(__spark_entry__.queries()[name](spark, SF), SF, ORACLE[name]) == ""
