"""Every core query with SQL against that SQL, and those without for rows."""

import pytest

from tests.compare import same
from wharfline.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_agrees_with_sql(spark, sf, name):
    same(spark, sf, catalog.queries()[name], catalog.oracle_sql()[name])


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql())))
def test_has_rows(spark, sf, name):
    # the smallest tables hold no pair of records that merges
    assert catalog.queries()[name](spark, sf).count() >= (0 if name == "identity_clusters" else 1)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
