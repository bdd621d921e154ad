"""Star join, CSV reading, snapshots and chart tables."""

import datetime as dt
from pathlib import Path

import pytest
from pyspark.sql import functions as F
from rows import counts, members

from fieldtally import __main__ as cli
from fieldtally import fixed_values as fixed
from fieldtally.operators import totals
from fieldtally.plans import areas, charts, clusters, ingest, merged, species, study
from fieldtally.sources import snapshots, warehouse

DAY = dt.date(2025, 1, 23)


def _write_star(spark, base):
    """A fact table and its six dimensions, in the columns of the warehouse."""
    rows = {
        # survey, location, season, event, sample, taxon, count, set
        "FactAnalyseSetOccurrence": [
            (1, 1, 1, 1, 1, 1, 10, 2),
            (1, 1, 1, 1, 1, 2, 0, 2),  # no individuals
            (1, 1, 1, 1, 1, 2, 5, 9),  # another analysis set
            (1, 1, 1, 1, 2, 1, 6, 2),  # sample not validated
            (1, 1, 1, 1, 3, 1, 7, 2),  # sample not covered
            (1, None, 1, 1, 1, 1, 8, 2),  # no location
            (1, 1, 1, 1, 4, 1, 9, 2),  # validation unknown
            (1, 1, 1, 1, 5, 2, 3, 4),
        ],
        "DimSurvey": [(1, "S", "Survey")],
        "DimLocationWV": [(1, "R", "Region", "L", "Lake"), (None, "R", "Region", "N", "None")],
        "DimSeason": [(1, "1999/00")],
        "DimEvent": [(1, "JAN", "Januari", 4)],
        "DimSample": [
            (1, dt.date(2000, 1, 15), "V", "CHECKED"),
            (2, dt.date(2000, 1, 15), "V", "OPEN"),
            (3, dt.date(2000, 1, 15), "N", "CHECKED"),
            (4, dt.date(2000, 1, 15), "V", None),
            (5, dt.date(2000, 1, 16), "O", "CHECKED"),
        ],
        "DimTaxonWV": [(1, "duck", "Anas", "D", "Ducks"), (2, "goose", "Anser", "G", "Geese")],
        "FactLocationGroup": [
            ("SEST", "x", "t", "T", "L", "Lake", dt.date(1990, 1, 1), None, 0),
            ("SEST", "x", "t", "T", "L", "Pond", dt.date(1990, 1, 1), None, 1),
            ("KBR", "y", "t", "T", "L", "Lake", dt.date(1990, 1, 1), None, 0),
        ],
    }
    for name, data in rows.items():
        columns = fixed.WAREHOUSE_COLUMNS[name]
        schema = ", ".join(f"{source} {kind}" for source, (_, kind) in columns.items())
        spark.createDataFrame(data, schema).write.parquet(f"{base}/{name}")
    return warehouse.read_tables(spark, str(base), list(rows))


def test_star_counts(spark, tmp_path):
    found = warehouse.warehouse_counts(_write_star(spark, tmp_path))
    assert found.columns == list(warehouse.COUNT_COLUMNS)
    assert [tuple(r) for r in found.orderBy("taxon").collect()] == [
        ("S", "Survey", "R", "Region", "L", "Lake", "1999/00", "JAN", "Januari", 4,
         dt.date(2000, 1, 15), "V", "duck", "Anas", 10),
        ("S", "Survey", "R", "Region", "L", "Lake", "1999/00", "JAN", "Januari", 4,
         dt.date(2000, 1, 16), "O", "goose", "Anser", 3),
    ]


def test_star_predicates_reach_the_scans(spark, tmp_path):
    found = warehouse.warehouse_counts(_write_star(spark, tmp_path)).select("taxon")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(Taxoncount,0)" in plan
    assert "In(Analysesetkey, [2,3,4])" in plan
    assert "EqualTo(samplestatus,CHECKED)" in plan


def test_membership_and_groups(spark, tmp_path):
    tables = _write_star(spark, tmp_path)
    bridge = tables["FactLocationGroup"]
    assert [r.location for r in warehouse.membership(bridge, fixed.AREA_CODES).collect()] == [
        "Lake"
    ]
    assert [r.area_code for r in warehouse.membership(bridge, fixed.CLUSTER_CODES).collect()] == [
        "KBR"
    ]
    groups = warehouse.taxon_groups(tables["DimTaxonWV"])
    assert groups.columns == ["taxon", "taxon_group_code", "taxon_group"]
    assert groups.count() == 2


def test_ingest_and_publish_from_the_command_line(spark, tmp_path, monkeypatch):
    warehouse_dir, out = tmp_path / "warehouse", tmp_path / "out"
    _write_star(spark, warehouse_dir)
    monkeypatch.setattr(cli, "build_session", lambda name: spark)
    cli.main(["ingest", "--warehouse", str(warehouse_dir), "--out", str(out),
              "--day", "2025-01-23"])
    counted = spark.read.parquet(f"{out}/counts/snapshot=2025-01-23")
    assert sorted((r.taxon, r.taxon_group, r.season_start) for r in counted.collect()) == [
        ("duck", "Ducks", 1999),
        ("goose", "Geese", 1999),
    ]
    assert ingest.rows_per_survey(counted).collect()[0].n_rows == 2
    second = tmp_path / "second.csv"
    second.write_text("location,species name,date,number,family\nP,duck,2014-01-05,12,x\n")
    published = []
    monkeypatch.setattr(charts, "write_charts", lambda c, base, day: published.append((set(c), base)))
    cli.main([
        "publish", "--counts", f"{out}/counts/snapshot=2025-01-23",
        "--areas", f"{out}/areas/snapshot=2025-01-23",
        "--clusters", f"{out}/clusters/snapshot=2025-01-23",
        "--second", f"Sigma-Estuarien={second}", "--out", str(out), "--day", "2025-01-23",
    ])
    names, base = published[0]
    assert "species_by_cluster" in names and base == f"{out}/charts"
    folded = spark.read.parquet(f"{out}/folded_counts/snapshot=2025-01-23")
    assert folded.agg(F.sum("individuals"), F.sum("n_rows")).collect()[0][:] == (13, 2)


# fmt: off
CSV = '''"","ProjectCode","Project","RegioCode","Regio","GebiedsCode","Gebied","Telseizoen",\
"TellingCode","Telling","TellingSortOrder","Teldatum","Telvolledigheid","NedNaam","WetNaam",\
"Aantal","Groepscode","Groep"
"1","M","Mid",NA,"","L","Lake","1999/00","JAN","Januari",4,2000-01-15,"V","duck","Anas",1e+05,"D","Ducks"
"2","M","Mid","R","Region","L","Lake","x","JAN","Januari",4,2000-01-15,"V","duck","Anas",12,NA,
"3","M","Mid","R","Region","L","Lake","1999/00","JAN","Januari",4,NA,"V","duck","Anas",1.5,"D","Ducks"
'''


def test_counts_csv(spark, tmp_path):
    path = tmp_path / "counts.csv"
    path.write_text(CSV)
    found = snapshots.read_counts(spark, str(path))
    assert "_c0" not in found.columns
    assert found.dtypes == [(n, k) for n, k in fixed.COUNTS_HEADER.values()]
    first, second, third = found.orderBy("individuals", ascending=False).collect()
    assert (first.individuals, first.region_code, first.region) == (100000, None, None)
    assert first.sample_date == dt.date(2000, 1, 15)
    assert (second.individuals, second.taxon_group, second.taxon_group_code) == (12, None, None)
    assert (third.individuals, third.sample_date) == (None, None)
    starts = study.with_season_start(found).collect()
    assert sorted(str(r.season_start) for r in starts) == ["1999", "1999", "None"]


def test_csv_without_a_listed_column_is_refused(spark, tmp_path):
    path = tmp_path / "bad.csv"
    path.write_text("location,date\na,2000-01-01\n")
    with pytest.raises(ValueError, match="species name"):
        snapshots.read_second_source(spark, str(path))


def test_second_source_csv(spark, tmp_path):
    path = tmp_path / "second.csv"
    path.write_text(
        "id,date,species name,number,family,location\n"
        "1,2018-10-14,duck,3,Anatidae,Polder\n"
        "2,2018-10-14 08:30:00,goose,,Anatidae,Polder\n"
    )
    found = snapshots.read_second_source(spark, str(path)).orderBy("taxon").collect()
    assert tuple(found[0]) == ("Polder", "duck", dt.date(2018, 10, 14), 3, "Anatidae")
    assert (found[1].sample_date, found[1].individuals) == (dt.date(2018, 10, 14), None)


def test_csv_snapshot_reads_back(spark, tmp_path):
    rows = [("SEST", "x", "t", "T", "L", "Lake", dt.date(1990, 1, 1), None)]
    schema = ", ".join(f"{n} {k}" for n, k in fixed.MEMBERSHIP_HEADER.values())
    df = spark.createDataFrame(rows, schema)
    path = snapshots.write_csv_snapshot(
        snapshots.with_exported_names(df, fixed.MEMBERSHIP_HEADER), str(tmp_path), "areas", DAY
    )
    assert path.endswith("areas/snapshot=2025-01-23")
    assert [tuple(r) for r in snapshots.read_membership(spark, path).collect()] == rows


def test_counts_by_season_prune_partitions(spark, tmp_path):
    df = spark.createDataFrame(
        [("1999/00", "Maart", "a", 1), ("2000/01", "Maart", "a", 2), ("x", "Maart", "a", 3)],
        "season string, round string, location string, individuals bigint",
    )
    path = snapshots.write_counts(df, str(tmp_path), DAY)
    back = spark.read.parquet(path)
    assert back.count() == 3
    late = back.filter((F.col("season_start") > 1999) & (F.col("season_start") < 2024))
    plan = late._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(season_start" in plan
    assert [r.individuals for r in late.collect()] == [2]


def test_chart_data_of_a_day_is_replaced_whole(spark, tmp_path):
    base, by = str(tmp_path), ("taxon",)
    df = spark.createDataFrame([("x", 1), ("y", 2)], "taxon string, v int")
    other = snapshots.write_chart_data(df, base, dt.date(2025, 1, 22), "means", by)
    path = snapshots.write_chart_data(df, base, DAY, "means", by)
    less = spark.createDataFrame([("y", 3)], "taxon string, v int")
    assert snapshots.write_chart_data(less, base, DAY, "means", by) == path
    assert [(r.taxon, r.v) for r in spark.read.parquet(path).collect()] == [("y", 3)]
    assert spark.read.parquet(other).count() == 2


ODD_TEXT = ['Polder "Noord", deel 2', 'Plas "De Put"', "back\\slash\\", "a,b", 'x "', "'", "é  x"]


def test_odd_text_makes_the_round_trip(spark, tmp_path):
    schema = ", ".join(f"{n} {k}" for n, k in fixed.MEMBERSHIP_HEADER.values())
    rows = [("SEST", t, "t", "T", str(i), t, dt.date(1990, 1, 1), None) for i, t in enumerate(ODD_TEXT)]
    df = spark.createDataFrame(rows, schema)
    named = snapshots.with_exported_names(df, fixed.MEMBERSHIP_HEADER)
    path = snapshots.write_csv_snapshot(named, str(tmp_path), "areas", DAY)
    back = snapshots.read_membership(spark, path).collect()
    assert sorted(map(tuple, back), key=str) == sorted(rows, key=str)


def test_doubled_quotes_and_line_breaks(spark, tmp_path):
    path = tmp_path / "second.csv"
    path.write_text(
        "id,date,species name,number,family,location\n"
        '1,2018-10-14,"duck ""wild"", grey",3,Anatidae,"Polder ""Noord"", deel 2"\n'
        '2,2018-10-14,goose,4,Anatidae,"two\nlines"\n'
    )
    found = snapshots.read_second_source(spark, str(path), multiline=True).orderBy("individuals").collect()
    assert [(r.taxon, r.location) for r in found] == [
        ('duck "wild", grey', 'Polder "Noord", deel 2'),
        ("goose", "two\nlines"),
    ]
    first = snapshots.read_second_source(spark, str(path)).where("individuals = 3").collect()
    assert first[0].location == 'Polder "Noord", deel 2'


def test_unparsed_cells_are_counted(spark, tmp_path):
    path = tmp_path / "second.csv"
    path.write_text(
        "id,date,species name,number,family,location\n"
        "1,10/01/2020,duck,3,Anatidae,Polder\n"
        "2,2018-10-14,goose,many,NA,Polder\n"
        "3,,goose,1e+05,Anatidae,\n"
    )
    cells = snapshots.unparsed_cells(spark, str(path), fixed.SECOND_SOURCE_HEADER)
    found = {r["column"]: (r.n_cells, r.n_unparsed) for r in cells.collect()}
    assert found["sample_date"] == (2, 1) and found["individuals"] == (3, 1)
    assert found["taxon"] == (3, 0) and found["taxon_group"] == (2, 0) and found["location"] == (2, 0)


def _sample(spark):
    rounds = list(fixed.ROUNDS.values())
    taxa = [("duck", "ducks", "D"), ("Kievit", "waders", "S"), ("Wulp", "waders", "S"),
            ("gull", fixed.GULLS_AND_TERNS, "M")]
    places = ["est", "wet", "valley", "harbour", "elsewhere", fixed.REPLACED_LOCATION]
    return counts(
        spark,
        [
            (season, rnd, place, 1 + (7 * s + 3 * i + 5 * j + 11 * k) % 40, *taxon)
            for s, season in enumerate(range(1998, 2016))
            for i, rnd in enumerate(rounds)
            for j, place in enumerate(places)
            for k, taxon in enumerate(taxa)
            for _ in range(1 + (i + j) % 2)
        ],
    )


def _areas(spark):
    return members(
        spark,
        [("SEST", "est", "Sigma-Estuarien"), ("WETL", "wet", "Sigma-Wetland"),
         ("ZSVAL", "valley"), ("NOH", "harbour"), ("ZR", "est"),
         ("WETL", fixed.REPLACED_LOCATION, "Sigma-Wetland")],
    )


def _second(spark):
    return spark.createDataFrame(
        [("Polder", "Sigma-Estuarien", dt.date(2014, 1, 5), 2014, "Januari", "duck", 12, "ducks")],
        "location string, area_name string, sample_date date, season_start int, round string, "
        "taxon string, individuals bigint, taxon_group string",
    )


def _rows(df):
    return sorted(
        (tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()),
        key=str,
    )


def test_plans_agree_on_folded_counts(spark):
    full, m = _sample(spark), _areas(spark)
    folded = totals.fold_counts(full)
    assert folded.count() < full.count()
    of = study.WITHOUT_WADERS
    choice = species.SpeciesChoice()
    groups = members(spark, [("KBR", "est", "Polders van Kruibeke"), ("DU", "wet", "Durme")])
    second = _second(spark)
    for plan in (
        areas.winter_means,
        areas.joined_round_totals,
        areas.class_winter_means,
        areas.class_round_totals,
        areas.moving_winter_mean,
        areas.counted_areas,
        areas.counted_areas_by_class,
        species.species_season_stats,
        species.top_concentrations,
        species.composition,
        species.stacked_composition,
        lambda c, a, s: species.top_species(c, a, s, 3),
        lambda c, a, s: species.species_shares(c, a, s, choice),
        lambda c, a, s: species.species_by_class(c, a, s, choice),
        lambda c, a, s: species.species_by_cluster(c, a, groups, s, choice),
        lambda c, a, s: clusters.cluster_means(c, a, groups, s),
        lambda c, a, s: clusters.cluster_counts_renamed(c, a, groups, s),
        lambda c, a, s: merged.site_type_totals(c, a, second, s),
        lambda c, a, s: merged.rows_per_area_name(c, a, second),
        lambda c, a, s: merged.replaced_rows(c),
        lambda c, a, s: study.row_count_checks(c, a, s, {}),
    ):
        assert _rows(plan(full, m, of)) == _rows(plan(folded, m, of))


def test_publish_writes_every_chart_and_aggregates_once(spark, tmp_path):
    full, m = _sample(spark), _areas(spark)
    groups = members(spark, [("KBR", "est", "Polders van Kruibeke"), ("DU", "wet", "Durme")])
    spark.conf.set("spark.sql.shuffle.partitions", "2")  # dozens of small jobs
    charts.publish(full, m, groups, _second(spark), str(tmp_path), DAY)
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    runs = spark._jsparkSession.sharedState().statusStore().executionsList()
    plans = [runs.apply(i).physicalPlanDescription() for i in range(runs.size())]
    reads = [p for p in plans if f"{tmp_path}/folded_counts" in p and f"{tmp_path}/c" in p]
    assert 0 < len(reads) <= 16, len(reads)
    wanted = charts.all_charts(full, m, groups, _second(spark))
    tmp_path = Path(tmp_path, "charts", f"snapshot={DAY.isoformat()}")
    written = {p.name for p in tmp_path.iterdir()}
    assert written == {f"chart={n}" for n in wanted} | {
        f"chart={n}_curve" for n, c in wanted.items() if c.smooth
    }
    for name in ("site_means_without_waders", "species_by_cluster", "moving_means_and_target"):
        back = spark.read.parquet(f"{tmp_path}/chart={name}")
        points = wanted[name].points
        assert _rows(back.select(*points.columns)) == _rows(points)
    folder = tmp_path / "chart=species_mean_site"
    assert {p.name for p in folder.iterdir() if p.is_dir()} == {
        "taxon=duck", "taxon=Kievit", "taxon=Wulp"
    }
    kievit = spark.read.parquet(f"{folder}/taxon=Kievit")
    assert kievit.agg(F.min("season_start")).collect()[0][0] == 1999
    curve = spark.read.parquet(f"{tmp_path}/chart=site_means_without_waders_curve")
    assert curve.count() == 80 and curve.filter("fit IS NULL OR se IS NULL").count() == 0
