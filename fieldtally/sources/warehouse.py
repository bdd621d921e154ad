"""Counts and memberships from a star-schema warehouse."""

from __future__ import annotations

import uuid
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldtally import fixed_values as fixed

COUNT_COLUMNS = (
    "survey_code",
    "survey",
    "region_code",
    "region",
    "location_code",
    "location",
    "season",
    "round_code",
    "round",
    "round_order",
    "sample_date",
    "coverage",
    "taxon",
    "scientific_name",
    "individuals",
)


def read_tables(spark: SparkSession, base: str, tables: Sequence[str]) -> dict[str, DataFrame]:
    """Warehouse tables kept as Parquet under ``base``, with the column names used here.

    Schemas are declared, so that no file footer is read while the query is put together.
    """
    found = {}
    for name in tables:
        columns = fixed.WAREHOUSE_COLUMNS[name]
        schema = ", ".join(f"{source} {kind}" for source, (_, kind) in columns.items())
        found[name] = _renamed(spark.read.schema(schema).parquet(f"{base}/{name}"), name)
    return found


def _renamed(df: DataFrame, table: str) -> DataFrame:
    names = {source: name for source, (name, _) in fixed.WAREHOUSE_COLUMNS[table].items()}
    return df.withColumnsRenamed(names)


def read_jdbc_table(
    spark: SparkSession,
    url: str,
    table: str,
    properties: Mapping[str, str],
    split_on: str | None = None,
    bounds: tuple[int, int] | None = None,
    parts: int = 1,
) -> DataFrame:
    """A warehouse table over JDBC; a large one is read in ``parts`` ranges of a numeric key."""
    if split_on is None:
        df = spark.read.jdbc(url, table, properties=dict(properties))
    elif bounds is None:
        raise ValueError("bounds of the key are needed to split a table")
    else:
        low, high = bounds
        df = spark.read.jdbc(
            url, table, split_on, low, high, parts, properties=dict(properties)
        )
    return _renamed(df, table)


#: The table of counts, that of samples, and the key by which they meet.
FACT, SAMPLES, SAMPLE_KEY = "FactAnalyseSetOccurrence", "DimSample", "sample_key"


def write_bucketed(
    df: DataFrame, key: str, buckets: int, name: str | None = None, path: str | None = None
) -> DataFrame:
    """The frame as a table bucketed and sorted by a key, read back.

    Each bucket is one file, made by one task: rows are dealt as the buckets are. Without a name a new
    one is taken; without a path the table is in the warehouse.
    """
    spark = df.sparkSession
    name = name or f"bucketed_{uuid.uuid4().hex}"
    writer = df.repartition(buckets, key).write.mode("overwrite").bucketBy(buckets, key).sortBy(key)
    (writer.option("path", path) if path else writer).saveAsTable(name)
    return spark.table(name)


def with_buckets(
    tables: Mapping[str, DataFrame], buckets: int, key: str = SAMPLE_KEY, base: str | None = None
) -> dict[str, DataFrame]:
    """The warehouse with counts and samples bucketed by the key they meet at.

    For samples too large to broadcast that several readings join with the counts: the two tables are
    shuffled once, here, and no join of them shuffles either side again. Spark builds a Bloom filter of
    the samples that pass their predicates and applies it to the scan of the counts, where
    `session.SETTINGS` allow it; its size is bounded by `runtime.bloomFilter.maxNumBits`. A bucket is
    read by one task, so a sample with very many counts is better joined without buckets, where
    adaptive execution splits it.
    """
    made = {
        name: write_bucketed(tables[name], key, buckets, path=f"{base}/{name}" if base else None)
        for name in (FACT, SAMPLES)
    }
    return {**tables, **made}


def star_counts(
    fact: DataFrame,
    samples: DataFrame,
    dimensions: Sequence[tuple[DataFrame, str]],
    statuses: Sequence[str] = fixed.VALIDATED_STATUS,
    skip_coverage: Sequence[str] = fixed.UNCOVERED_CODES,
    analysis_sets: Sequence[int] = fixed.MIDMONTH_ANALYSIS_SETS,
    columns: Sequence[str] = COUNT_COLUMNS,
) -> DataFrame:
    """Inner joins of the counts with their samples and dimensions, then the listed columns.

    Predicates are stated on the two tables they belong to, so they reach the scans. Joins are
    chained in the order given, each dimension on its own: its size is then the size of its
    files, and small ones are broadcast while samples, which grow with the counts, may be
    shuffled. Keys are compared with ``=``: a null key finds nothing.
    """
    kept_samples = samples.filter(
        F.col("sample_status").isin(*statuses) & ~F.col("coverage").isin(*skip_coverage)
    )
    kept_counts = fact.filter(
        (F.col("individuals") > 0) & F.col("analysis_set").isin(*analysis_sets)
    )
    joined = reduce(
        lambda left, dim: left.join(dim[0], dim[1], "inner"),
        dimensions,
        kept_counts.join(kept_samples, "sample_key", "inner"),
    )
    return joined.select(*columns)


def warehouse_counts(tables: Mapping[str, DataFrame]) -> DataFrame:
    """The counts of the warehouse: one fact table, six dimensions."""
    return star_counts(
        tables[FACT],
        tables[SAMPLES],
        [
            (tables["DimSurvey"], "survey_key"),
            (tables["DimLocationWV"], "location_key"),
            (tables["DimSeason"], "season_key"),
            (tables["DimEvent"], "event_key"),
            (tables["DimTaxonWV"].drop("taxon_group_code", "taxon_group"), "taxon_key"),
        ],
    )


def taxon_groups(taxa: DataFrame) -> DataFrame:
    """Group code and name per common name; a repeated name is kept as often as it occurs."""
    return taxa.select("taxon", "taxon_group_code", "taxon_group")


def membership(groups: DataFrame, codes: Sequence[str]) -> DataFrame:
    """Locations of the listed area groups or clusters, deleted rows left out."""
    return groups.filter((F.col("is_deleted") == 0) & F.col("area_code").isin(*codes)).select(
        *[name for name, _ in fixed.MEMBERSHIP_HEADER.values()]
    )
