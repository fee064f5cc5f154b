"""What plans read, shuffle and measure; results are held by the tests of queries."""

from __future__ import annotations

from eventloom.plans import catalog

D = "/root/testdata/sf0.001"


def optimized(df) -> list[str]:
    return df._jdf.queryExecution().optimizedPlan().toString().splitlines()


def test_streams_are_cut_by_date_before_they_are_united(spark):
    lines = optimized(catalog.queries()["K06_K49_assembled"](spark, D))
    union = next(i for i, x in enumerate(lines) if "Union" in x)
    assert not any("Join" in x for x in lines[:union])


def executed(spark, name: str) -> str:
    """The plan with what exchanges share."""
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        return catalog.queries()[name](spark, D)._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")


def test_reactions_make_only_wanted_measures_and_shuffle_bars_once(spark):
    plan = executed(spark, "K21_baselines")
    assert "RowFrame, -60" not in plan
    assert plan.count("hashpartitioning(ticker#") == 1
    assert "RowFrame, -60" in executed(spark, "F12_F13_reactions")


def test_curve_makes_its_trades_once(spark):
    assert executed(spark, "F18_equity_curve").count("Generate explode") == 1


def test_flags_count_rows_once(spark):
    for name in ("K34_flags", "K34_distribution_flags"):
        assert executed(spark, name).count("Window [last(") == 1


def test_bundles_share_what_does_not_depend_on_them(spark):
    lines = optimized(catalog.queries()["K31_E15_D16_matrix"](spark, D))
    above = lines[: next(i for i, x in enumerate(lines) if "Generate" in x)]
    assert not any(", pricing) as binary" in x for x in above)
