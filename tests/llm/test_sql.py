import pytest

from stowage.llm import registry
from tests.conftest import same_rows


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_query_equals_its_sql(spark, small, duck, name):
    same_rows(registry.QUERIES[name](spark, small), duck, registry.ORACLES[name])
