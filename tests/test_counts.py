"""Statistics of counts read their tables once and give what the rows give."""

from __future__ import annotations

import pytest

from tessera.functions import text
from tessera.plans import decisions, registry
from tests.test_oracle import SF, pytestmark  # noqa: F401


@pytest.mark.parametrize("name", ["area_agreements", "triangulation"])
def test_ratings_are_read_once(spark, name):
    plan = registry.queries()[name](spark, SF)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("received_at#") and sum("Relation [" in line and "feedback#" in line for line in plan.splitlines()) == 1


def test_counts_are_those_of_the_evidence(spark):
    keys = ["trait", "llm_code", "human_code", "llm_families"]
    rows = lambda df: sorted(map(tuple, df.groupBy(*keys).sum("n").collect()), key=repr)
    want = decisions.evidence(spark, SF).groupBy(*keys).count().withColumnRenamed("count", "n")
    assert rows(decisions.coded_counts(spark, SF, True).where("first")) == rows(want) == rows(decisions.coded_counts(spark, SF))


def test_families_of_spaced_text(spark):
    t = "글,길이! 문장 구조 AK어휘 XY 문단…연결"
    r = spark.createDataFrame([(t,), (None,), ("",)], "t string")
    for x in r.select(text.named_families(text.spaced(r.t)), text.families(text.tokens(r.t))).collect():
        assert x[0] == x[1]
