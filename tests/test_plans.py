"""The scale design, checked on physical plans (no execution needed)."""

import pytest

from conftest import SF_SMALL

STREAMING = {"stream_progress", "stream_scores", "stream_severity_counts", "stream_daily_counts"}


def _plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def _queries():
    from revline.plans.catalog import QUERIES
    return sorted(q for q in QUERIES if q not in STREAMING)


@pytest.mark.parametrize("name", _queries())
def test_no_cross_joins(spark, name):
    from revline.plans.catalog import QUERIES
    plan = _plan(QUERIES[name](spark, SF_SMALL))
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name


def test_flagship_parses_once_and_prunes_the_scan(spark):
    from revline.plans.catalog import QUERIES
    plan = _plan(QUERIES["repo_scores"](spark, SF_SMALL))
    assert plan.count("MapInPandas") == 1
    assert "ReadSchema: struct<p_partkey:bigint,p_size:int>" in plan


def test_all_detectors_share_one_parse(spark):
    from revline.plans.catalog import QUERIES
    plan = _plan(QUERIES["all_findings"](spark, SF_SMALL))
    assert plan.count("MapInPandas") == 1 and plan.count("Generate explode") == 1


def test_top_k_limits_before_the_shuffle(spark):
    from revline.plans.catalog import QUERIES
    plan = _plan(QUERIES["top5_per_repo"](spark, SF_SMALL))
    assert plan.count("WindowGroupLimit") >= 2  # partial (map side) and final


def test_rule_scan_has_no_join(spark):
    from revline.plans.catalog import QUERIES
    plan = _plan(QUERIES["rule_findings"](spark, SF_SMALL))
    assert "Join" not in plan


def test_script_rules_do_not_parse(spark):
    from revline.plans.catalog import QUERIES
    assert "MapInPandas" not in _plan(QUERIES["script_findings"](spark, SF_SMALL))


def test_as_of_and_dedup_are_aggregates_not_windows(spark):
    from revline.plans.catalog import QUERIES
    for name in ("file_as_of", "all_findings"):
        plan = _plan(QUERIES[name](spark, SF_SMALL))
        assert "Window" not in plan and "Aggregate" in plan, name


def test_filters_reach_the_scan(spark):
    from revline.plans.catalog import QUERIES
    plan = _plan(QUERIES["approved_fixes"](spark, SF_SMALL))
    assert "PushedFilters: [IsNotNull(o_totalprice), GreaterThan(o_totalprice,250000.0)]" in plan
    rules = _plan(QUERIES["config_effective"](spark, SF_SMALL))
    assert "ReadSchema: struct<c_custkey:bigint,c_acctbal:double,c_mktsegment:string>" in rules


def test_texts_that_meet_policies_are_dealt_by_the_size_of_the_table(spark, monkeypatch):
    from revline.plans import catalog
    from revline.sources import tables
    docs = tables.load(spark, SF_SMALL, "documents")
    assert tables.parts(docs, 1000) > 100 and tables.parts(docs, 1 << 40) == spark.sparkContext.defaultParallelism * 2
    monkeypatch.setattr(catalog, "parts", lambda df: 37)
    plan = _plan(catalog.QUERIES["policy_topk"](spark, SF_SMALL))
    assert plan.count("Exchange hashpartitioning") == 1 and ", 37), REPARTITION_BY_NUM" in plan  # pairs are counted inside the parts
    plan = _plan(catalog.QUERIES["policy_weighted_topk"](spark, SF_SMALL))
    assert plan.count("Exchange hashpartitioning") == plan.count(", 37), REPARTITION_BY_NUM") > 0
