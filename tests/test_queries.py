"""Every query outside llm against its SQL."""

import pytest
from oracle_check import differences

from parcela.plans import oracle, registry


@pytest.mark.parametrize("name", list(registry.QUERIES))
def test_query_matches_sql(spark, sf_dir, duck, name):
    assert differences(registry.QUERIES[name](spark, sf_dir), duck, oracle.ORACLE[name]) == ""


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
