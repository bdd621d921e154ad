"""Rows made to show one rule each."""

import datetime as dt

import pytest
from pyspark.sql import functions as F
from rows import ROUNDS, as_dict, counts, members

from fieldtally import fixed_values as fixed
from fieldtally.operators import checks, joins, merging, ranking, shaping, totals
from fieldtally.plans import areas, clusters, merged, species, study

STUDY = study.Study(1990, 2024, excluded_codes=("S",))


def test_round_missing_in_one_area_blanks_its_mean(spark):
    df = counts(
        spark,
        [(2000, r, "valley spot", 10) for r in ROUNDS]
        + [(2000, r, "site spot", 5) for r in ROUNDS[:5]],
    )
    m = members(spark, [("ZSVAL", "valley spot"), ("SEST", "site spot")])
    for plan in (areas.area_round_totals, areas.joined_round_totals):
        cells = as_dict(plan(df, m, STUDY), "round", "site_total")
        assert cells["Maart"] is None and cells["Oktober"] == 5
    row = areas.winter_means(df, m, STUDY).collect()[0]
    assert row.mean_site is None and row.max_site is None and row.mean_site_valley_share is None
    assert row.max_valley == 15 and row.mean_valley == pytest.approx(85 / 6)


def test_missing_count_blanks_the_total(spark):
    df = counts(spark, [(2000, "Maart", "a", 10), (2000, "Maart", "a", None)])
    m = members(spark, [("SEST", "a")])
    row = areas.area_round_totals(df, m, STUDY).collect()[0]
    assert (row.site_total, row.valley_total, row.region_total) == (None, None, None)


def test_null_location_matches_null_membership(spark):
    df = counts(spark, [(2000, "Maart", None, 7), (2000, "Maart", "a", 1)])
    m = members(spark, [("SEST", None)])
    assert areas.valley_counts(df, m, STUDY).count() == 1
    row = areas.area_round_totals(df, m, STUDY).collect()[0]
    assert (row.site_total, row.region_total) == (7, 8)


def test_natural_join_checks_the_shared_columns(spark):
    left = spark.createDataFrame([("x", 1), (None, 2)], "taxon string, v int")
    right = spark.createDataFrame([("x", "g"), ("x", "h"), (None, "n")], "taxon string, g string")
    found = joins.natural_left_join(left, right, expect=["taxon"])
    assert sorted((r.v, r.g) for r in found.collect()) == [(1, "g"), (1, "h"), (2, "n")]
    with pytest.raises(ValueError):
        joins.natural_left_join(left, right.withColumn("v", F.lit(1)), expect=["taxon"])


def test_colliding_columns_are_refused(spark):
    df = spark.createDataFrame([(1, 2)], "k int, v int")
    with pytest.raises(ValueError):
        joins.null_safe_join(df, df, ["k"])


@pytest.mark.parametrize("how", ["left", "right", "full"])
def test_null_safe_outer_joins_keep_one_key(spark, how):
    a = spark.createDataFrame([(None, 1), (2, 2)], "k int, a int")
    b = spark.createDataFrame([(None, 5), (3, 6)], "k int, b int")
    found = {(r.k, r.a, r.b) for r in joins.null_safe_join(a, b, ["k"], how).collect()}
    wanted = {(None, 1, 5)}
    wanted |= {(2, 2, None)} if how in ("left", "full") else set()
    wanted |= {(3, None, 6)} if how in ("right", "full") else set()
    assert found == wanted


def test_chained_left_join_keeps_the_seasons_of_the_first_series(spark):
    first, second, third = (
        spark.createDataFrame(rows, f"season int, {name} int")
        for name, rows in (
            ("a", [(1, 10), (2, 20), (None, 30)]),
            ("b", [(2, 21), (3, 31)]),
            ("c", [(1, 12), (None, 32)]),
        )
    )
    found = joins.chained_join([first, second, third], ["season"], "left").collect()
    assert {tuple(r) for r in found} == {
        (1, 10, None, 12), (2, 20, 21, None), (None, 30, None, 32),
    }


def test_location_in_two_groups_counts_twice(spark):
    df = counts(spark, [(2000, "Maart", "a", 10)])
    m = members(spark, [("SEST", "a"), ("ZR", "a")])
    row = areas.area_round_totals(df, m, STUDY).collect()[0]
    assert (row.site_total, row.valley_total, row.region_total) == (10, 20, 10)
    stats = species.species_season_stats(df, m, STUDY).collect()[0]
    assert (stats.n, stats.total, stats["mean"]) == (2, 20, 10.0)


def test_membership_dates_are_ignored_unless_asked_for(spark):
    df = counts(spark, [(2000, "Maart", "a", 10)]).withColumn(
        "sample_date", F.lit(dt.date(2001, 3, 15))
    )
    m = members(spark, [("SEST", "a")]).withColumn("valid_to", F.lit(dt.date(1999, 1, 1)))
    assert areas.valley_counts(df, m, STUDY).count() == 1
    assert areas.valley_counts(df, m, STUDY, as_of="sample_date").count() == 0


@pytest.mark.parametrize("as_of", [None, "sample_date"])
def test_right_join_keeps_memberships_without_counts(spark, as_of):
    df = counts(spark, [(2000, "Maart", "a", 10), (2000, "Maart", None, 3)]).withColumn(
        "sample_date", F.lit(dt.date(2001, 3, 15))
    )
    m = members(spark, [("SEST", "a"), ("WETL", "b"), ("ZS", None)])
    found = joins.in_areas(df, m, how="right", as_of=as_of)
    assert {(r.area_code, r.location, r.individuals) for r in found.collect()} == {
        ("SEST", "a", 10),
        ("ZS", None, 3),
        ("WETL", "b", None),
    }


def test_filters_drop_missing_values(spark):
    df = counts(
        spark,
        [
            (2000, "Maart", "a", 1, "gull", fixed.GULLS_AND_TERNS, "M"),
            (2000, "Maart", "a", 2, "odd", None, None),
            (2000, "Maart", "a", 3),
            (None, "Maart", "a", 4),
            (1990, "Maart", "a", 5),
            (2024, "Maart", "a", 6),
        ],
    )
    kept = study.period_counts(df, STUDY)
    assert [r.individuals for r in kept.collect()] == [3]
    assert study.exclude_codes(df, STUDY).filter("individuals = 2").count() == 0


def test_areas_without_counts(spark):
    df = counts(spark, [(2000, "Maart", "a", 1)])
    m = members(spark, [("SEST", "a"), ("SEST", "b"), ("ZS", "b")])
    found = joins.areas_without_counts(m, df)
    assert sorted(r.area_code for r in found.collect()) == ["SEST", "ZS"]
    assert found.columns == m.columns


def test_class_of_unlisted_code_is_null(spark):
    m = members(spark, [("SEST", "a"), ("ZZ", "b")])
    assert as_dict(study.area_classes(m, STUDY), "area_code", "area_class") == {
        "SEST": "Sigmagebied",
        "ZZ": None,
    }
    df = counts(spark, [(2000, "Maart", "b", 4)])
    found = areas.class_winter_means(df, m, STUDY).collect()
    assert [(r.area_class, r.winter_mean) for r in found] == [(None, 4.0)]


def test_two_kinds_of_mean(spark):
    df = counts(spark, [(2000, r, "a", 12) for r in ROUNDS[:3]])
    present = totals.means_over_rounds(
        totals.round_totals(df, ["season_start", "round"]), ["season_start"], {"mean": "total"}
    )
    assert present.collect()[0]["mean"] == 12.0
    assert totals.fixed_effort_means(df, ["season_start"]).collect()[0]["mean"] == 6.0


def test_two_kinds_of_share(spark):
    df = counts(
        spark,
        [
            (2000, "Januari", "site", 1), (2000, "Januari", "other", 1),
            (2000, "Februari", "site", 1), (2000, "Februari", "other", 3),
        ],
    )
    m = members(spark, [("SEST", "site"), ("ZSVAL", "other")])
    shares = areas.area_shares(df, m, STUDY).collect()[0]
    assert shares.mean_site_valley_share == pytest.approx((1 / 2 + 1 / 4) / 2)
    choice = species.SpeciesChoice(5, (), {})
    row = species.species_shares(df, m, STUDY, choice).collect()[0]
    assert row.site_valley_share == pytest.approx(2 / 6)


def test_cluster_rules(spark):
    df = counts(spark, [(2000, "Maart", "a", 6), (2000, "Maart", "b", 12)])
    m = members(spark, [("SEST", "a"), ("WETL", "b")])
    c = members(
        spark,
        [("KBR", "a", "Polders van Kruibeke"), ("XX", "b", "Nowhere"), ("OV", "empty", "Overige")],
    )
    rows = {r.cluster: (r.n_rows, r.short_name) for r in
            clusters.cluster_row_counts(df, m, c, STUDY).collect()}
    assert rows == {
        "Polders van Kruibeke": (1, "KBR"),
        "Nowhere": (1, "Nowhere"),
        "Overige": (1, "Overige"),
    }
    means = {r.cluster: (r.cluster_order, r["mean"]) for r in
             clusters.cluster_means(df, m, c, STUDY).collect()}
    assert means == {"KBR": (5, 1.0), None: (None, 2.0)}


def test_overlapping_classes(spark):
    df = counts(spark, [(2000, "Maart", "a", 1), (2000, "Maart", "b", 2)])
    m = members(spark, [("ZS", "a"), ("SEST", "b")])
    found = as_dict(areas.overlapping_class_totals(df, m, STUDY), "area_class", "total")
    assert found == {"Estuarium": 1, "Estuarium + Sigma": 3}


def test_moving_mean_counts_rows_not_years(spark):
    df = spark.createDataFrame(
        [("c", y, float(v)) for v, y in enumerate((2000, 2001, 2002, 2003, 2006))],
        "c string, y int, v double",
    )
    found = as_dict(shaping.moving_mean(df, ["c"], "y", "v", 5), "y", "moving_mean")
    assert found == {2000: None, 2001: None, 2002: None, 2003: None, 2006: 2.0}


def test_ties_go_to_the_first_name(spark):
    df = counts(spark, [(2000, "Maart", "a", 5, t) for t in ("c", "a", "b")])
    assert [r.taxon for r in ranking.top_n(df, "taxon", 2).collect()] == ["a", "b"]


def test_missing_totals_rank_last(spark):
    df = counts(spark, [(2000, "Maart", "a", None, "x"), (2000, "Maart", "a", 1, "y")])
    found = ranking.top_n(df, "taxon", 2).collect()
    assert [(r.taxon, r.total) for r in found] == [("y", 1), ("x", None)]


def test_rest_bucket_keeps_the_sum(spark):
    df = counts(spark, [(2000, "Maart", "a", v, t) for t, v in (("x", 6), ("y", 12), ("z", 3))])
    m = members(spark, [("SEST", "a")])
    found = as_dict(species.composition(df, m, STUDY, 2, "rest"), "species", "mean")
    assert found == {"x": 1.0, "y": 2.0, "rest": 0.5}
    stacked = species.stacked_composition(df, m, STUDY, 2, "rest").collect()
    assert max(r.ymax for r in stacked) == pytest.approx(21 / 6)
    assert {r.species: (r.ymin, r.ymax) for r in stacked} == {
        "y": (0.0, 2.0),
        "x": (2.0, 3.0),
        "rest": (3.0, 3.5),
    }


def test_top_species_come_from_the_valley(spark):
    df = counts(
        spark,
        [(2000, "Maart", "a", 1, "in"), (2000, "Maart", "elsewhere", 99, "out")],
    )
    m = members(spark, [("SEST", "a")])
    assert [r.taxon for r in species.top_species(df, m, STUDY, 5).collect()] == ["in"]
    shares = species.species_shares(df, m, STUDY, species.SpeciesChoice(5, (), {})).collect()
    assert [r.taxon for r in shares] == ["in"]


def test_later_start_wins(spark):
    df = counts(
        spark,
        [(s, "Maart", "a", v, t) for t, v in (("x", 5), ("late", 4), ("skip", 3), ("z", 1))
         for s in (1995, 2000)],
    )
    m = members(spark, [("SEST", "a")])
    choice = species.SpeciesChoice(3, ("skip",), {"late": 1998})
    found = {(r.taxon, r.season_start)
             for r in species.species_shares(df, m, STUDY, choice).collect()}
    assert found == {("x", 1995), ("x", 2000), ("late", 2000)}


def test_second_source_months_and_seasons(spark):
    raw = spark.createDataFrame(
        [("p", "duck", dt.date(2020, 1, 10), 3, "Laridae"),
         ("p", "duck", dt.date(2020, 7, 10), 4, "ducks")],
        "location string, taxon string, sample_date date, individuals bigint, taxon_group string",
    )
    found = merging.wrangle_second_source(raw, "area", fixed.ROUNDS, {"Laridae": "gulls"})
    assert [(r.season_start, r.round, r.taxon_group) for r in found.collect()] == [
        (2020, "Januari", "gulls"),
        (2020, None, "ducks"),
    ]
    winter = merging.wrangle_second_source(raw, "area", fixed.ROUNDS, {}, "winter_start")
    assert [r.season_start for r in winter.collect()] == [2019, 2020]
    assert totals.fixed_effort_means(found, ["season_start"]).collect()[0]["mean"] == 7 / 6


def _second(spark, rows):
    return spark.createDataFrame(
        [(loc, area, None, s, "Maart", t, n, "ducks") for loc, area, s, t, n in rows],
        "location string, area_name string, sample_date date, season_start int, round string, "
        "taxon string, individuals bigint, taxon_group string",
    )


def test_replaced_location(spark):
    df = counts(
        spark,
        [(2012, "Maart", "old", 1), (2013, "Maart", "old", 2), (2013, "Maart", "b", 3),
         (None, "Maart", "old", 4)],
    )
    second = _second(spark, [("new", "A", 2013, "duck", 10)])
    found = merging.replace_location(df, "old", 2012, second)
    assert {(r.season_start, r.location, r.individuals) for r in found.collect()} == {
        (2012, "old", 1), (2013, "b", 3), (2013, "new", 10),
    }
    assert "area_name" not in found.columns


def test_reclassified_location_counts_once_per_membership(spark):
    df = counts(spark, [(2000, "Maart", "old", 6), (2000, "Maart", "b", 12)])
    m = members(spark, [("WETL", "old", "wet"), ("ZSVAL", "old", "valley"), ("SEST", "b", "est")])
    second = _second(spark, [("new", "est", 2000, "duck", 18)])
    args = (df, m, second, STUDY, "old", 2012, ("est", "wet"))
    before = as_dict(merged.site_type_totals(*args), "site_type", "mean")
    assert before == {"wet": 1.0, "est": 5.0}
    after = as_dict(merged.site_type_totals(*args, reclassify="est"), "site_type", "mean")
    assert after == {"est": 7.0}


def test_rank_side_by_side_fills_the_shorter_list(spark):
    a = counts(spark, [(2000, "Maart", "a", v, t) for t, v in (("x", 1), ("y", 2))])
    b = counts(spark, [(2000, "Maart", "a", 9, "z")])
    found = ranking.rank_side_by_side(a, b, "taxon", 20, ("first", "second"))
    assert [tuple(r) for r in found.orderBy("position").collect()] == [
        (1, "y", 2, "z", 9),
        (2, "x", 1, None, None),
    ]


def test_union_fills_missing_columns(spark):
    m = members(spark, [("SEST", "a")])
    found = merging.append_membership(m, _second(spark, [("n", "A", 2000, "d", 1)] * 2))
    assert [(r.area_code, r.area_name, r.location) for r in found.collect()] == [
        ("SEST", "SEST", "a"),
        (None, "A", "n"),
    ]


def test_quartiles_interpolate(spark):
    df = spark.createDataFrame(
        [(k,) for k, n in (("a", 1), ("b", 2), ("c", 3), ("d", 10)) for _ in range(n)], "k string"
    )
    assert tuple(checks.describe_counts(df, "k").collect()[0]) == (1, 1.75, 2.5, 4.0, 4.75, 10)


def test_completeness(spark):
    df = spark.createDataFrame(
        [(1, "a", 1.0), (1, "b", 2.0), (2, "a", None)], "s int, t string, v double"
    )
    row = checks.completeness(df, ["s", "t"], "v").collect()[0]
    assert (row.n_rows, row.n_missing, row.n_complete, row.is_complete) == (3, 1, 4, False)


def test_row_count_checks(spark):
    df = counts(
        spark,
        [(2000, "Maart", "a", 1), (1980, "Maart", "a", 1), (2000, "Maart", "b", 1),
         (2000, "Maart", "a", 1, "gull", fixed.GULLS_AND_TERNS, "M")],
    )
    m = members(spark, [("SEST", "a"), ("ZR", "a")])
    found = study.row_count_checks(df, m, STUDY, {"all": 4, "period": 3})
    assert {r.frame: (r.n_rows, r.n_expected, r.agrees) for r in found.collect()} == {
        "all": (4, 4, True),
        "period": (2, 3, False),
        "valley": (2, None, None),
    }


def test_unknown_groups(spark):
    df = counts(spark, [(2000, "Maart", "a", 1), (2000, "Maart", "a", 2, "x", "-", "-")])
    found = checks.unknown_groups(df, fixed.UNKNOWN_GROUP)
    assert [r.individuals for r in found.collect()] == [2]


def test_assert_schema(spark):
    df = spark.createDataFrame([(1,)], "a int")
    assert checks.assert_schema(df, df.schema) is df
    with pytest.raises(ValueError):
        checks.assert_schema(df.withColumn("b", F.lit(1)), df.schema)


def test_target_gap(spark):
    df = counts(spark, [(s, "Maart", "a", 10) for s in range(2000, 2006)])
    m = members(spark, [("ZS", "a")])
    found = areas.target_gap(df, m, STUDY, 40).filter("area_class = 'Estuarium'")
    assert as_dict(found, "season_start", "gap") == {
        2000: None, 2001: None, 2002: None, 2003: None, 2004: -30.0, 2005: -30.0,
    }


def test_counted_areas_count_an_area_once_per_class(spark):
    df = counts(spark, [(2000, r, "a", 1) for r in ROUNDS] + [(2000, "Maart", "b", 1)])
    m = members(spark, [("SEST", "a"), ("WETL", "a"), ("ZS", "a"), ("ZS", "b")])
    assert areas.counted_areas(df, m, STUDY).collect()[0].n_areas == 3
    by_class = as_dict(areas.counted_areas_by_class(df, m, STUDY), "area_class", "n_areas")
    assert by_class == {"Sigmagebied": 1, "Estuarium": 2}
