"""Every registered query: its result against its SQL, and the shape of the plan it ran with."""

import re

import compare
import pytest

from __spark_entry__ import entry, oracle_sql, queries
from fieldtally.fixture import catalog
from fieldtally.fixture import oracle as sql

QUERIES = catalog.queries()
ORACLE = sql.oracle_sql()

#: Reads of the largest table: once, unless sources are compared or merged, or rows without a
#: match are kept.
READS = {
    "area_right_join": 2,
    "bucketed_star_counts": 0,
    "counts_by_csv": 0,
    "ordered_counts": 0,
    "changed_rows": 2,
    "changes_per_survey": 2,
    "changed_seasons": 3,
    "listings": 2,
    "rows_per_area_name": 3,
    "replaced_location_areas": 0,
    "merge_sources": 2,
    "rank_side_by_side": 2,
    "site_type_totals": 3,
    "reclassified_totals": 3,
    "site_type_trend": 3,
    "taxon_groups": 0,
    "area_membership": 0,
    "cluster_membership": 0,
    "area_classes": 0,
}

IN_ARROW = {"weekly_band", "weekly_residual_scale", "weekly_spline", "round_spline"}


def test_every_query_has_sql_and_is_registered():
    assert set(QUERIES) == set(ORACLE)
    assert set(QUERIES) <= set(queries()) and set(ORACLE) <= set(oracle_sql())


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, testdata, oracle, name):
    df = QUERIES[name](spark, testdata)
    assert compare.differences(df, oracle, ORACLE[name]) is None
    plan = compare.executed_plan(df)
    scans = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert sum("l_" in s for s in scans) == READS.get(name, 1)
    assert "CartesianProduct" not in plan and "NestedLoop" not in plan
    assert "Python" not in plan and "ArrowEval" not in plan
    # Blocks of the tiled band and small systems of equations go to numpy, nothing else does.
    assert ("InArrow" in plan) == (name in IN_ARROW)


#: Types of the plans' own columns, before results are made comparable.
TYPES = {
    "season_start": "int", "individuals": "bigint", "sample_date": "date", "valid_from": "date",
    "valid_to": "date", "round_order": "int", "max_site": "bigint", "max_valley": "bigint",
    "max_region": "bigint", "site_total": "bigint", "valley_total": "bigint",
    "region_total": "bigint", "total_counts": "bigint", "total_second": "bigint",
    "cluster_order": "int", "n_rows": "bigint", "n_areas": "bigint", "mean": "double",
    "winter_mean": "double", "moving_mean": "double", "fit": "double", "se": "double",
    "lower": "double", "upper": "double", "step": "int", "position": "int", "n_points": "bigint",
}


@pytest.mark.parametrize("name", sorted(catalog.PLANS))
def test_types_of_the_plans(spark, testdata, name):
    kinds = dict(catalog.PLANS[name](catalog.Tables(spark, testdata)).dtypes)
    assert {c: k for c, k in kinds.items() if c in TYPES} == {c: TYPES[c] for c in kinds if c in TYPES}
    assert "void" not in kinds.values()


def test_entry(spark, testdata):
    df = entry(spark)
    assert df.columns[0] == "season_start"
    assert df.count() > 0
