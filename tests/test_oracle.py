import pytest

import __spark_entry__
from tests.compare import difference
from windloom.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, name):
    assert difference(__spark_entry__.queries()[name](spark, SF), SF, registry.ORACLE[name]) == ""


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
