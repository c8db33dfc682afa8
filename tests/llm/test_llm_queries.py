import pytest
from oracle import compare

from mnemora.llm import plans

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(plans.queries()))
def test_query(spark, name):
    if name in plans.oracle_sql():
        compare(spark, SF, plans.queries()[name], plans.oracle_sql()[name])
    else:
        assert plans.queries()[name](spark, SF).count() > 0
