"""Shape of the physical plans, and agreement of the plans under skew without broadcasts."""

import re

import pytest
from compare import executed_plan
from pyspark.sql import functions as F
from rows import as_dict, counts, members

from __spark_entry__ import queries
from fieldtally.fixture import mapping
from fieldtally.operators import totals
from fieldtally.plans import areas, species, study

QUERIES = queries()
def test_valley_counts_need_no_outer_join(spark, testdata):
    plan = executed_plan(QUERIES["valley_counts"](spark, testdata))
    assert "Outer" not in plan and "Exchange hashpartitioning" not in plan


def test_period_and_predicates_reach_the_scans(spark, testdata, capsys):
    QUERIES["winter_means"](spark, testdata).explain("formatted")
    plan = capsys.readouterr().out
    assert "GreaterThanOrEqual(o_orderdate,1995-04-01T00:00)" in plan
    assert "LessThan(o_orderdate,2001-04-01T00:00)" in plan
    assert "In(o_orderstatus, [F,O])" in plan and "In(l_linenumber, [1,2,3,4,5])" in plan
    lines = next(s for s in re.findall(r"ReadSchema: struct<(.*)>", plan) if "l_" in s)
    assert set(re.findall(r"(l_\w+):", lines)) == {
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"
    }


def test_species_list_is_read_from_the_same_cells(spark, testdata):
    plan = executed_plan(QUERIES["species_shares"](spark, testdata))
    assert "ReusedExchange" in plan and "TakeOrderedAndProject" in plan


@pytest.fixture
def no_broadcast(spark):
    """Every join shuffles, and a partition counts as skewed early."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "64KB",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64KB",
    }
    for key, value in settings.items():
        spark.conf.set(key, value)
    yield
    for key in settings:
        spark.conf.unset(key)


def _skewed(spark):
    """A third of all rows at one location, of one species; written numbers repeat by rule."""
    base = spark.range(0, 300_000, 1, 8).selectExpr(
        "CAST(1995 + id % 11 AS int) AS season_start",
        "concat('round ', id % 6) AS round",
        "if(id % 3 = 0, 'hot', concat('place ', id % 40)) AS location",
        "if(id % 3 = 0, 'common', concat('species ', id % 25)) AS taxon",
        "'ducks' AS taxon_group",
        "'D' AS taxon_group_code",
        "1 + id * 7919 % 97 AS individuals",
        "sha2(CAST(id AS string), 256) AS note",
    )
    m = members(
        spark,
        [("SEST", "hot"), ("ZR", "hot")]
        + [(("SEST", "ZSVAL", "ZS", "NOH")[i % 4], f"place {i}") for i in range(40)],
    )
    return base, m


def test_hot_location_is_split(spark, no_broadcast):
    df, m = _skewed(spark)
    found = areas.valley_counts(df, m, study.WITH_WADERS)
    plan = executed_plan(found.select("location", "area_code", "individuals", "note"))
    assert "BroadcastHashJoin" not in plan
    assert "skew=true" in plan


def test_plans_agree_under_skew_with_and_without_broadcast(spark, no_broadcast):
    df, m = _skewed(spark)
    choice = species.SpeciesChoice(5, (), {"common": 2000})
    plans = {
        "winter": lambda: areas.winter_means(df, m, study.WITH_WADERS),
        "joined": lambda: areas.joined_round_totals(df, m, study.WITH_WADERS),
        "one_pass": lambda: areas.area_round_totals(df, m, study.WITH_WADERS),
        "shares": lambda: species.species_shares(df, m, study.WITH_WADERS, choice),
    }

    def run():
        return {
            k: sorted(map(str, p().select([F.round(c, 9).alias(c) if t == "double" else F.col(c)
                                           for c, t in p().dtypes]).collect()))
            for k, p in plans.items()
        }

    shuffled = run()
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert run() == shuffled


def test_both_round_total_plans_agree(spark):
    df, m = _skewed(spark)
    one = areas.area_round_totals(df, m, study.WITH_WADERS)
    three = areas.joined_round_totals(df, m, study.WITH_WADERS).select(*one.columns)
    assert one.exceptAll(three).count() == 0 and three.exceptAll(one).count() == 0


def test_nested_areas_hold_each_other(spark, testdata):
    """Without repeated memberships: site <= valley <= region in every cell."""
    t = mapping.SurveyTables(spark, testdata)
    single = t.members().filter("area_code <> 'ZR'")
    cells = areas.area_round_totals(t.counts(mapping.STUDY), single, mapping.STUDY)
    assert cells.filter("site_total > valley_total OR valley_total > region_total").count() == 0


def test_composition_sums_to_the_total(spark, testdata):
    t = mapping.SurveyTables(spark, testdata)
    of = mapping.WITH_WADERS
    parts = species.composition(t.counts(of), t.members(), of, area="valley")
    summed = as_dict(parts.groupBy("season_start").agg(F.sum("mean").alias("m")),
                     "season_start", "m")
    valley = areas.valley_counts(t.counts(of), t.members(), of)
    whole = as_dict(totals.fixed_effort_means(valley, ["season_start"]), "season_start", "mean")
    assert summed == pytest.approx(whole)


def test_fixed_effort_is_at_most_the_mean_of_present_rounds(spark):
    df = counts(spark, [(s, r, "a", 5 + s % 3) for s in range(2000, 2010)
                        for r in list("abcdef")[: 1 + s % 6]])
    present = totals.means_over_rounds(
        totals.round_totals(df, ["season_start", "round"]), ["season_start"], {"present": "total"}
    )
    fixed = totals.fixed_effort_means(df, ["season_start"])
    for r in present.join(fixed, "season_start").collect():
        full = 1 + r.season_start % 6 == 6
        assert r["mean"] == pytest.approx(r.present) if full else r["mean"] < r.present
