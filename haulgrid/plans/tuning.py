"""Measured variants of a query: storage layout, caching, pruning, broadcast and adaptive execution."""

from __future__ import annotations

import time
from collections.abc import Callable
from statistics import median

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from haulgrid.operators.validate import differences
from haulgrid.session import settings
from haulgrid.sources.lake import Lake


def timed(run: Callable[[], object], runs: int = 3) -> float:
    """The median of all runs but the first."""
    took = []
    for _ in range(runs):
        t = time.perf_counter()
        run()
        took.append(time.perf_counter() - t)
    return median(took[1:] or took)


def compare(name: str, baseline: Callable[[], DataFrame], tuned: Callable[[], DataFrame], spark: SparkSession, before: dict | None = None, after: dict | None = None) -> dict:
    """Times both forms, each under its own settings, and checks that they return the same rows."""
    with settings(spark, before or {}):
        slow = timed(lambda: baseline().write.format("noop").mode("overwrite").save())
    with settings(spark, after or {}):
        fast = timed(lambda: tuned().write.format("noop").mode("overwrite").save())
        same = differences(tuned(), baseline()) == (0, 0)
    return {"name": name, "baseline_s": slow, "tuned_s": fast, "faster_pct": round(100 * (slow - fast) / slow, 2), "same": same}


def broadcast_experiment(spark: SparkSession, plain: Callable[[], DataFrame], hinted: Callable[[], DataFrame]) -> dict:
    off = {"spark.sql.autoBroadcastJoinThreshold": "-1"}
    return compare("broadcast", plain, hinted, spark, off, off)


def adaptive_experiment(spark: SparkSession, query: Callable[[], DataFrame]) -> dict:
    return compare("adaptive", query, query, spark, {"spark.sql.adaptive.enabled": "false"}, {"spark.sql.adaptive.enabled": "true"})


def caching_experiment(spark: SparkSession, df: DataFrame, query: Callable[[DataFrame], DataFrame]) -> dict:
    """The same query on a table and on its cached copy; the cache is emptied after."""
    held = df.select("*").cache()
    try:
        held.count()
        return compare("caching", lambda: query(df), lambda: query(held), spark)
    finally:
        held.unpersist()


def pruning_experiment(lake: Lake, layer: str, name: str, year: int) -> dict:
    """The rows of a year by the partition column, and by the same condition in a form that can't be pruned."""
    df = lake.read(layer, name)
    whole = df.where((F.col("year") + F.rand(1).cast("int")) == year)
    return compare("pruning", lambda: whole.groupBy("month").count(), lambda: df.where(F.col("year") == year).groupBy("month").count(), lake.spark)


def storage_experiment(lake: Lake, df: DataFrame, partition_by: tuple[str, ...], queries: dict[str, Callable[[DataFrame], DataFrame]]) -> dict:
    """Write time, size and query times of a partitioned and of a flat copy."""
    out = {}
    for name, columns in (("partitioned", partition_by), ("flat", ())):
        t = time.perf_counter()
        lake.replace(df, "benchmark", name, columns)
        size, files = lake.size("benchmark", name)
        out[name] = {"write_s": time.perf_counter() - t, "bytes": size, "files": files}
        out[name] |= {q: timed(lambda f=f, name=name: f(lake.read("benchmark", name)).collect(), 2) for q, f in queries.items()}
    return out


def plan_text(df: DataFrame) -> str:
    return df._jdf.queryExecution().toString()
