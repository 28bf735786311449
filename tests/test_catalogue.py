"""Every core query against its SQL twin on the smallest tables."""

import pytest
from oracle import compare

from codeloom.plans import CATALOGUES

QUERIES = {k: f for m in CATALOGUES for k, f in m.QUERIES.items()}
ORACLE = {k: s for m in CATALOGUES for k, s in m.ORACLE.items()}


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_matches_sql(spark, sf, name):
    compare(spark, name, sf, QUERIES[name], ORACLE[name])


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLE)))
def test_runs(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
