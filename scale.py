"""Times survey queries on replicated order lines, a third of them at one place and of one taxon.

SCALE_SF_DIR   directory of the test tables (default /root/testdata/sf0.1)
SCALE_COPIES   copies of the order lines (default 40: 24 million lines of sf0.1)
SCALE_OUT      folder for the replicated tables (default: a new temporary folder)
SCALE_RUNS     timed runs per query, of which the median counts (default 3)
SCALE_SERIES   series of 33 points for the trend (default 8000)

Prints one JSON line: seconds of the first run and median of the others, per query.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time
from pathlib import Path

from pyspark.sql import functions as F

sys.path.insert(0, str(Path(__file__).resolve().parent))

from bench import session  # noqa: E402
from fieldtally.fixture import catalog, mapping  # noqa: E402
from fieldtally.operators import trend  # noqa: E402

QUERIES = (
    "winter_means", "area_round_totals", "joined_round_totals", "species_shares",
    "species_by_cluster", "site_type_totals", "smoothed_band", "species_mean_trend",
)


def replicate(spark, source: str, target: str, copies: int) -> int:
    """The tables of `source`, order lines repeated; every third copy has one place and taxon."""
    for name in mapping.SCHEMAS:
        table = spark.read.parquet(f"{source}/{name}.parquet")
        if name == "lineitem":
            table = table.withColumn("copy", F.explode(F.sequence(F.lit(1), F.lit(copies))))
            hot = F.col("copy") % 3 == 0
            table = table.withColumns(
                {k: F.when(hot, F.lit(1).cast(table.schema[k].dataType)).otherwise(F.col(k))
                 for k in ("l_suppkey", "l_partkey")}
            ).drop("copy").repartition(32)
        table.write.parquet(f"{target}/{name}.parquet")
    return spark.read.parquet(f"{target}/lineitem.parquet").count()


def timed(make, runs: int) -> list[float]:
    seconds = []
    for _ in range(runs + 1):
        start = time.perf_counter()
        make().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - start)
    return [round(seconds[0], 2), round(statistics.median(seconds[1:]), 2)]


def main() -> None:
    spark = session(os.environ.get("BENCH_CPUS", "8"))
    source = os.environ.get("SCALE_SF_DIR", "/root/testdata/sf0.1")
    target = os.environ.get("SCALE_OUT") or tempfile.mkdtemp(prefix="scale-")
    runs = int(os.environ.get("SCALE_RUNS", "3"))
    lines = replicate(spark, source, target, int(os.environ.get("SCALE_COPIES", "40")))
    queries = catalog.queries()
    found = {n: timed(lambda q=queries[n]: q(spark, target), runs) for n in QUERIES}
    n = int(os.environ.get("SCALE_SERIES", "8000"))
    points = spark.range(n * 33).selectExpr(
        f"id % {n} AS s", f"CAST(id DIV {n} AS int) AS x", "CAST(hash(id) % 100 AS double) AS y"
    )
    for name in ("smoothed_trend", "smoothed_band"):
        fit = getattr(trend, name)
        found[f"{n}_series_{name}"] = timed(lambda f=fit: f(points, ["s"], "x", "y"), runs)
    print(json.dumps({"lines": lines, "spark": spark.version, "first_and_median": found}))
    spark.stop()


if __name__ == "__main__":
    main()
