"""Ingest-log diagnostics: counts, start-to-end pairing, durations, nearest-rank percentiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def event_counts(log: DataFrame) -> DataFrame:
    return log.groupBy(F.coalesce("event", F.lit("unknown")).alias("event")).agg(F.count(F.lit(1)).alias("n"))


def status_counts(log: DataFrame, of: str = "file_completed") -> DataFrame:
    """How often files were completed with each status."""
    return log.where(F.col("event") == of).groupBy(F.coalesce(F.nullif("status", F.lit("")), F.lit("unknown")).alias("status")).agg(F.count(F.lit(1)).alias("n"))


def durations(log: DataFrame, key: str = "path", at: str = "ts", order: str = "line", starts: str = "file_started", ends: tuple[str, ...] = ("file_completed", "file_error")) -> DataFrame:
    """Seconds from the last start before each end of the same key; never negative. A start serves every end after it."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    start = F.last(F.when(F.col("event") == starts, F.col(at)), ignorenulls=True).over(w)
    seconds = F.greatest(F.lit(0.0), (F.unix_micros(at) - F.unix_micros("started")) / 1e6)
    return log.withColumn("started", start).where(F.col("event").isin(*ends) & F.col("started").isNotNull()).withColumn("seconds", seconds)


def nearest_ranks(rows: DataFrame, group: list[str], value: str, shares: dict[str, float], steps: float = 10.0) -> DataFrame:
    """Per group the element ``round((n - 1) * p)`` (half to even) of the ascending values, for each named share.

    Counts of equal steps tell in which step a rank lies; only that step's rows are put in order, so
    no task holds a group's values.
    """
    step = F.floor(F.col(value) * steps)
    own = rows.where(F.col(value).isNotNull()).withColumn("__step", step)
    counts = own.groupBy(*group, "__step").agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*group)
    run = counts.withColumn("__upto", F.sum("__n").over(w.orderBy("__step").rowsBetween(Window.unboundedPreceding, 0))).withColumn("__all", F.sum("__n").over(w))
    ranks = F.explode(F.array(*[F.struct(F.lit(name).alias("name"), F.bround((F.col("__all") - 1) * F.lit(p), 0).cast("long").alias("rank")) for name, p in shares.items()]))
    wanted = run.withColumn("__w", ranks).where("__w.rank < __upto and __w.rank >= __upto - __n")
    wanted = wanted.select(*group, "__step", F.col("__w.name").alias("__name"), (F.col("__w.rank") - F.col("__upto") + F.col("__n") + 1).alias("__place"))
    near = own.select(*group, "__step", value).join(wanted, [*group, "__step"])
    hit = near.withColumn("__r", F.row_number().over(Window.partitionBy(*group, "__name").orderBy(value))).where("__r = __place")
    return hit.groupBy(*group).agg(*[F.max(F.when(F.col("__name") == name, F.col(value))).alias(name) for name in shares])


def duration_stats(timed: DataFrame, group: list[str], seconds: str = "seconds") -> DataFrame:
    """Count, mean, p50, p95 and maximum."""
    out = timed.groupBy(*group).agg(F.count(F.lit(1)).alias("n"), F.avg(seconds).alias("avg_s"), F.max(seconds).alias("max_s"))
    return out.join(nearest_ranks(timed, group, seconds, {"p50_s": 0.5, "p95_s": 0.95}), group, "left")


def slowest(timed: DataFrame, n: int = 10, tie: str = "line") -> DataFrame:
    return timed.orderBy(F.desc("seconds"), tie).limit(n)


def outcomes(results: DataFrame) -> DataFrame:
    return results.agg(F.count_if(F.col("error").isNull()).alias("succeeded"), F.count_if(F.col("error").isNotNull()).alias("failed"))
