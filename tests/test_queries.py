"""Every query against its SQL on the smallest tables."""

import pytest

from lodestone.plans import registry

from .conftest import SF
from .oracle import differences

NAMES = list(registry.queries())


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, name):
    df = registry.queries()[name](spark, SF)
    sql = registry.oracle_sql().get(name)
    if sql is None:
        assert df.count() > 0
    else:
        assert differences(df, SF, sql) == ""
    spark.catalog.clearCache()


def test_entry_point_names():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries()) and set(NAMES) <= set(entry.queries())
    assert set(NAMES) - set(registry.oracle_sql()) == {"hypervector_fusion", "hdc_project"}  # Gaussian hyperplanes have no SQL
