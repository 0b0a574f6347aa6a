"""What searches exchange: the lines' columns, not the bodies written of them."""

from __future__ import annotations

import pytest

from shelfmark.plans import catalogue, discoveries, feeds  # noqa: F401  (add their queries to the catalogue)

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", ["market_search_offers", "market_search_status"])
def test_bodies_are_written_behind_the_grouping(spark, name):
    plan = catalogue.QUERIES[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    at = plan.index("\n", plan.index("Aggregate [search_id"))
    assert "permalink" in plan[:at] and "permalink" not in plan[at:]
