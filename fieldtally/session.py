"""Session settings for large runs.

They are given to the builder, not set by the library: plans run under any session, and a session
that was already configured keeps its own values.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Mapping

from pyspark.sql import SparkSession

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
SETTINGS = {
    # Merge small and split hot shuffle partitions at run time.
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "128MB",
    # Start wide: adaptive execution merges what turns out to be small.
    "spark.sql.shuffle.partitions": "4000",
    "spark.sql.files.maxPartitionBytes": "256MB",
    # Dimensions and memberships under this size are broadcast, larger ones are shuffled.
    "spark.sql.autoBroadcastJoinThreshold": "64MB",
    # Samples that pass their predicates are looked up in a Bloom filter while counts are read.
    "spark.sql.optimizer.runtime.bloomFilter.enabled": "true",
    "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold": "1GB",
    "spark.sql.optimizer.runtime.bloomFilter.creationSideThreshold": "1GB",
    # Dates and seasons must not depend on the zone of a machine.
    "spark.sql.session.timeZone": "UTC",
}


def build_session(name: str, settings: Mapping[str, str] | None = None) -> SparkSession:
    builder = SparkSession.builder.appName(name)
    for key, value in {**SETTINGS, **(settings or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's own path, where they share it."""
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", os.environ.get("PYTHONPATH", "")).split(os.pathsep) if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = os.pathsep.join([*paths, ROOT])


def shared_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that all executors share; beside the warehouse, if none is named."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    base = base or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_shared"
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"
