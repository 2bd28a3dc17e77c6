"""The shop pages' plans: many tasks, each page parsed once, and only what is asked of it."""

import pytest

from suasion.plans import shop

SMOKE = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def pages(spark):
    return shop.shop(spark, SMOKE)


def test_pages_of_a_small_file_are_dealt_to_all_cores(pages, spark):
    assert pages.rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
    assert sum(n > 0 for n in pages.rdd.glom().map(len).collect()) > 1


@pytest.mark.parametrize("name", ["sc1_styles", "sc3_signals", "fn27_offers", "cl3_price_snapshot", "cl5_observations"])
def test_pages_are_parsed_once_without_a_join(spark, name):
    plan = shop.QUERIES[name](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("MapInArrow") == 1
    assert "Join" not in plan
    assert "InMemoryRelation" not in plan


def test_parts_that_nobody_asks_for_are_not_made(spark):
    assert shop.shop(spark, SMOKE, "meta").columns == ["page_id", "url", "meta"]
    assert shop.shop(spark, SMOKE, "nodes").columns == ["page_id", "url", "nodes"]


def test_each_rule_reads_what_the_last_one_left_once(spark):
    plan = shop.QUERIES["fn31_fixtures"](spark, SMOKE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("order|account|member") <= 8  # counted and replaced once in each of two scans, replaced once in the scrubbed text
