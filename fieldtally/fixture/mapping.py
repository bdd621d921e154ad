"""The test tables seen as a count survey.

Order lines are counts, orders are samples, suppliers' nations are locations, parts are taxa and
market segments are surveys. ``fixture.oracle`` states the same mapping in SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally import fixed_values as fixed
from fieldtally.functions.labels import relabel, season_label, season_of_date, within_winters
from fieldtally.operators.merging import wrangle_second_source
from fieldtally.plans.species import SpeciesChoice
from fieldtally.plans.study import Study
from fieldtally.session import shared_path
from fieldtally.sources import ordered, snapshots
from fieldtally.sources.warehouse import COUNT_COLUMNS, SAMPLE_KEY, membership, star_counts, write_bucketed

STATUSES = ("F", "O")
SKIP_COVERAGE = ("4-NOT SPECIFIED",)
ANALYSIS_SETS = (1, 2, 3, 4, 5)
EXTRA_SUFFIX = "_EXTRA"
REPLACED = "NATION_1"
REPLACED_AFTER = 1997
UNRANKED = ("blue anvil",)
SECOND_GROUPS = {"PROMO family": "PROMO"}
CHOICE = SpeciesChoice(
    n=12, left_out=("blue bolt",), later={"cold gear": 1996, "red widget": 1997}
)
CLUSTER_NAMES = {
    "BW": "Burchtse Weel",
    "DM": "Dijlemonding",
    "DU": "Durme",
    "KM": "Kalkense Meersen",
    "KBR": "Polders Kruibeke",
    "NG": "Haven bij Kruibeke",
    "OV": "Overige",
    "WZ": "Elders",
}
AREA_NAMES = {"SEST": "Sigma-Estuarien", "WETL": "Sigma-Wetland"}

STUDY = Study(1994, 2001, excluded_groups=("PROMO",), excluded_codes=("SMALL",))
WITH_WADERS = Study(1996, 2001, excluded_groups=("PROMO",))
PER_SPECIES = Study(1994, 2001, excluded_groups=("PROMO",))
#: All seasons of the tables: with one point per season a curve needs each of them.
CURVES = Study(1993, 2001, excluded_groups=("PROMO",), excluded_codes=("SMALL",))
SPECIES_CURVES = Study(1993, 2001, excluded_groups=("PROMO",))
CURVE_LIMITS = {"site_share_of_valley": (0, 0.5), "moving_means": (0, 2000), "site_types": (0, 1500)}

SCHEMAS = {
    "region": "r_regionkey int, r_name string",
    "nation": "n_nationkey int, n_name string, n_regionkey int",
    "customer": "c_custkey bigint, c_mktsegment string",
    "supplier": "s_suppkey bigint, s_nationkey int",
    "part": "p_partkey bigint, p_name string, p_brand string, p_type string",
    "orders": "o_orderkey bigint, o_custkey bigint, o_orderstatus string, "
    "o_orderdate timestamp_ntz, o_orderpriority string",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, "
    "l_quantity double, l_returnflag string, l_shipdate timestamp_ntz",
}

_SEASONAL = ("season_start", *COUNT_COLUMNS[6:], "taxon_group_code", "taxon_group")
COLUMNS = ("location_code", "location", *_SEASONAL)


class SurveyTables:
    """Counts, memberships and the second source read from one directory of test tables."""

    def __init__(self, spark: SparkSession, directory: str):
        self.spark = spark
        self.directory = directory

    def table(self, name: str) -> DataFrame:
        """One test table, its used columns declared rather than inferred from the file."""
        return self.spark.read.schema(SCHEMAS[name]).parquet(f"{self.directory}/{name}.parquet")

    def _fact(self) -> DataFrame:
        return self.table("lineitem").selectExpr(
            "l_orderkey AS sample_key",
            "l_suppkey AS location_key",
            "l_partkey AS taxon_key",
            "l_linenumber AS analysis_set",
            "CAST(l_quantity AS bigint) AS individuals",
        )

    def _samples(self, after: int | None = None, before: int | None = None) -> DataFrame:
        orders = self.table("orders")
        if after is not None:
            orders = orders.filter(within_winters("o_orderdate", after, before))
        return orders.selectExpr(
            "o_orderkey AS sample_key",
            "o_custkey AS survey_key",
            "CAST(o_orderdate AS date) AS sample_date",
            "o_orderpriority AS coverage",
            "o_orderstatus AS sample_status",
            "month(o_orderdate) AS event_key",
        ).withColumn("season_key", season_of_date("sample_date", "winter_start"))

    def _surveys(self) -> DataFrame:
        return self.table("customer").selectExpr(
            "c_custkey AS survey_key",
            "substring(c_mktsegment, 1, 3) AS survey_code",
            "c_mktsegment AS survey",
        )

    def _suppliers(self) -> DataFrame:
        return self.table("supplier").selectExpr(
            "s_suppkey AS location_key", "s_nationkey AS nation_key"
        )

    def _nations(self) -> DataFrame:
        return self.table("nation").selectExpr(
            "n_nationkey AS nation_key",
            "CAST(n_nationkey AS string) AS location_code",
            "n_name AS location",
            "n_regionkey AS region_key",
        )

    def _regions(self) -> DataFrame:
        return self.table("region").selectExpr(
            "r_regionkey AS region_key",
            "CAST(r_regionkey AS string) AS region_code",
            "r_name AS region",
        )

    def _events(self) -> DataFrame:
        """The six count rounds: a table of fixed size."""
        rows = [
            (month, str(month), name, order)
            for order, (month, name) in enumerate(fixed.ROUNDS.items(), start=1)
        ]
        return self.spark.createDataFrame(
            rows, "event_key int, round_code string, round string, round_order int"
        )

    def _seasons(self) -> DataFrame:
        """The season dimension: a row per season of four hundred years, as a calendar has them."""
        seasons = self.spark.range(1800, 2200).selectExpr("CAST(id AS int) AS season_key")
        return seasons.withColumn("season", season_label("season_key"))

    def taxa(self) -> DataFrame:
        return self.table("part").selectExpr(
            "p_partkey AS taxon_key",
            "p_name AS taxon",
            "p_brand AS scientific_name",
            "p_type AS taxon_group_code",
            "p_type AS taxon_group",
        )

    def star_counts(self, buckets: int | None = None) -> DataFrame:
        """The full star: six dimensions, fifteen columns; of bucketed tables, if buckets are given."""
        fact, samples = self._fact(), self._samples()
        if buckets:
            fact, samples = (write_bucketed(df, SAMPLE_KEY, buckets) for df in (fact, samples))
        return star_counts(
            fact,
            samples,
            [
                (self._surveys(), "survey_key"),
                (self._suppliers(), "location_key"),
                (self._nations(), "nation_key"),
                (self._regions(), "region_key"),
                (self._seasons(), "season_key"),
                (self._events(), "event_key"),
                (self.taxa().drop("taxon_group_code", "taxon_group"), "taxon_key"),
            ],
            STATUSES,
            SKIP_COVERAGE,
            ANALYSIS_SETS,
        )

    def counts(
        self, study: Study | None = None, extra: tuple = (), columns: tuple = COLUMNS
    ) -> DataFrame:
        """Counts with season, round and taxon group; of the study's seasons if one is given.

        Season and round come from the sample itself. ``extra`` adds dimensions.
        """
        samples = self._samples(*((study.after, study.before) if study else ()))
        seasonal = (
            samples.filter(F.col("event_key").isin(*fixed.ROUNDS))
            .withColumnRenamed("season_key", "season_start")
            .withColumns(
                {
                    "season": season_label("season_start"),
                    "round_code": F.col("event_key").cast("string"),
                    "round": relabel("event_key", fixed.ROUNDS),
                    "round_order": relabel(
                        "event_key", {m: i for i, m in enumerate(fixed.ROUNDS, start=1)}
                    ),
                }
            )
        )
        return star_counts(
            self._fact(),
            seasonal,
            [
                (self._suppliers(), "location_key"),
                (self._nations(), "nation_key"),
                (self.taxa(), "taxon_key"),
                *extra,
            ],
            STATUSES,
            SKIP_COVERAGE,
            ANALYSIS_SETS,
            columns,
        )

    def earlier_counts(self, by_parity: bool = False) -> DataFrame:
        """An earlier reading: other locations for one round, a lost and a doubled taxon, no coverage.

        ``by_parity``: in odd seasons alone, so that even ones are as they were.
        """
        counts = self.counts_with_survey()
        if by_parity:
            odd = F.col("season_start") % 2 == 1
            return self._earlier(counts.where(odd)).unionByName(counts.where(~odd))
        return self._earlier(counts)

    @staticmethod
    def _earlier(counts: DataFrame) -> DataFrame:
        moved = F.when(F.col("round") == "Maart", F.lit("NATION_0")).otherwise(F.col("location"))
        coverage = F.when(F.col("coverage") != "5-LOW", F.col("coverage"))
        copies = F.when(F.col("taxon") == "cold gear", 0).when(F.col("taxon") == "blue bolt", 2).otherwise(1)
        once = F.explode(F.array_repeat(F.lit(1), copies.cast("int"))).alias("copy")
        return counts.withColumns({"location": moved, "coverage": coverage}).select("*", once).drop("copy")

    def counts_by_csv(self) -> DataFrame:
        """Counts exported to CSV, with line breaks and quotes in a text, and read again by splits."""
        text = F.concat(F.col("location"), F.lit('\n"plas", deel '), F.col("round_order").cast("string"))
        counts = self.star_counts().withColumn("location", text)
        lookup = {name: F.lit(None).cast("string") for name in ("taxon_group_code", "taxon_group")}
        exported = snapshots.with_exported_names(counts.withColumns(lookup), fixed.COUNTS_HEADER)
        path = shared_path(self.spark, "counts-csv")
        exported.write.options(header=True, nullValue="NA", quote='"', escape='"').csv(path)
        return snapshots.read_counts(self.spark, path).drop(*lookup)

    def ordered_counts(self, keys: tuple[str, ...]) -> DataFrame:
        """Counts written in the order of the keys, and read with their place."""
        path = ordered.write_ordered(self.star_counts(), shared_path(self.spark, "ordered"), keys)
        return ordered.read_ordered(self.spark, path)

    def counts_with_survey(self) -> DataFrame:
        return self.counts(
            extra=((self._surveys(), "survey_key"),), columns=(*COLUMNS, "survey")
        )

    def counts_from_label(self) -> DataFrame:
        """Counts whose season is known by its label only; some labels do not start with a year."""
        lost = F.when(F.col("round") == "Maart", F.concat(F.lit("winter "), "season"))
        return self.counts().withColumn("season", F.coalesce(lost, "season")).drop("season_start")

    def counts_without_group(self) -> DataFrame:
        return self.counts().drop("taxon_group_code", "taxon_group")

    def taxon_lookup(self) -> DataFrame:
        """Group of each taxon name: that of its first key; names of group LARGE are unlisted."""
        first = self.taxa().groupBy("taxon").agg(
            F.min_by("taxon_group", "taxon_key").alias("taxon_group")
        )
        return first.filter(F.col("taxon_group") != "LARGE").select(
            "taxon", F.substring("taxon_group", 1, 2).alias("taxon_group_code"), "taxon_group"
        )

    def _groups(self, tests: dict[str, str], names: dict[str, str], extra: str) -> DataFrame:
        """Rows of the bridge table: a nation is in each group whose test it meets.

        Nation 24 has a second location, which nobody counts, in the group ``extra``. Odd nations
        have left the group NOH: their rows are marked as deleted.
        """
        hits = [
            f"if({test}, named_struct('code', '{code}', 'suffix', ''), NULL)"
            for code, test in tests.items()
        ]
        hits.append(
            f"if(n_nationkey = 24, named_struct('code', '{extra}', 'suffix', '{EXTRA_SUFFIX}'), "
            "NULL)"
        )
        rows = self.table("nation").selectExpr(
            "n_nationkey", "n_name", f"explode(array_compact(array({', '.join(hits)}))) AS g"
        )
        return rows.selectExpr(
            "g.code AS area_code",
            "'A' AS area_type_code",
            "'area' AS area_type",
            "concat(CAST(n_nationkey AS string), g.suffix) AS location_code",
            "concat(n_name, g.suffix) AS location",
            "DATE '1990-01-01' AS valid_from",
            "if(n_nationkey % 3 = 0, DATE '1998-03-31', NULL) AS valid_to",
            "if(g.code = 'NOH' AND n_nationkey % 2 = 1, 1, 0) AS is_deleted",
        ).withColumn("area_name", relabel("area_code", names, keep_unlisted=True))

    def members(self) -> DataFrame:
        """Membership in the area groups; region 0 overlaps two groups, two nations are in none."""
        tests = {
            "SEST": "n_regionkey = 0",
            "WETL": "n_regionkey = 1",
            "ZSVAL": "n_regionkey = 2",
            "ZS": "n_regionkey = 3",
            "NOH": "n_regionkey = 4",
            "ZR": "n_regionkey = 0 AND n_nationkey % 10 = 0",
        }
        return membership(self._groups(tests, AREA_NAMES, "ZSVAL"), fixed.AREA_CODES)

    def clusters(self) -> DataFrame:
        tests = {code: f"n_nationkey % 8 = {i}" for i, code in enumerate(fixed.CLUSTER_CODES)}
        return membership(self._groups(tests, CLUSTER_NAMES, "OV"), fixed.CLUSTER_CODES)

    def _second_rows(self, flags: tuple[str, ...]) -> DataFrame:
        lines = self.table("lineitem").filter(F.col("l_returnflag").isin(*flags))
        rows = lines.withColumnRenamed("l_partkey", "p_partkey").join(
            self.table("part"), "p_partkey"
        )
        return rows.selectExpr(
            "if(l_returnflag = 'R', 'NORTH', 'SOUTH') AS location",
            "p_name AS taxon",
            "CAST(l_shipdate AS date) AS sample_date",
            "CAST(l_quantity AS bigint) AS individuals",
            "if(p_type = 'PROMO', 'PROMO family', p_type) AS taxon_group",
        )

    def second_raw(self) -> DataFrame:
        """The second source with the names of its own."""
        return self._second_rows(("R", "A"))

    def second(self, rule: str = "calendar_year") -> DataFrame:
        """The second source read once, the area worked out from the location."""
        return wrangle_second_source(
            self._second_rows(("R", "A")),
            relabel("location", {"NORTH": "Sigma-Estuarien", "SOUTH": "Sigma-Wetland"}),
            fixed.ROUNDS,
            SECOND_GROUPS,
            rule,
        )
