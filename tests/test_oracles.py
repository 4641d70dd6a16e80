"""Every registered query of the library that has SQL gives that SQL's rows."""

import pytest
from oracle import compare

from triagelake.plans import alignment_plans, catalog, quality_plans, text_plans

DATA = "/root/testdata"
LARGER = {**text_plans.REGISTRY.oracles, **quality_plans.REGISTRY.oracles, **alignment_plans.REGISTRY.oracles}
CASES = [(n, "sf0.001") for n in sorted(catalog.ORACLES)] + [(n, "sf0.01") for n in sorted(LARGER)]


@pytest.mark.parametrize(("name", "sf"), CASES)
def test_query_equals_sql(spark, name, sf):
    assert compare(spark, catalog.QUERIES[name], catalog.ORACLES[name], f"{DATA}/{sf}") == ""


def test_every_query_has_sql():
    assert set(catalog.ORACLES) == set(catalog.QUERIES)
