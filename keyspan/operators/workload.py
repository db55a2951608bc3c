"""Summaries of measured operations (op, ms, ok, tag, sqlstate)."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked_percentiles(samples: DataFrame, group: str, value: str, shares: dict[str, float]) -> DataFrame:
    """For each group the value at place floor((n - 1) * share) of its sorted values, by rank, without collecting them."""
    w = Window.partitionBy(group)
    ranked = samples.select(group, value).withColumn("_rn", F.row_number().over(w.orderBy(value)) - 1).withColumn("_n", F.count("*").over(w))
    return ranked.groupBy(group).agg(*(F.max(F.when(F.col("_rn") == F.floor((F.col("_n") - 1) * F.lit(p)), F.col(value))).alias(name) for name, p in shares.items()))


def summary(samples: DataFrame, op: str = "op", ms: str = "ms", ok: str = "ok") -> DataFrame:
    """Count, successes, failures, mean, median, 95th percentile and maximum of each operation."""
    totals = samples.groupBy(op).agg(F.count("*").alias("n"), F.count_if(ok).alias("succeeded"), F.count_if(~F.col(ok)).alias("failed"), F.avg(ms).alias("mean_ms"), F.max(ms).alias("max_ms"))
    return totals.join(ranked_percentiles(samples, op, ms, {"p50_ms": 0.5, "p95_ms": 0.95}), op)


def error_class(sqlstate: Column, message: Column) -> Column:
    """The class of a SQLSTATE, or timeout, or client."""
    return F.when(F.length(sqlstate) >= 2, F.substring(sqlstate, 1, 2)).when(F.lower(message).contains("timeout") | F.lower(message).contains("deadline"), "timeout").otherwise("client")


def tag_classes(samples: DataFrame) -> DataFrame:
    """Of each operation and tag, how many went well (class ok) and how many failed in each class (op, tag, ok, sqlstate, message)."""
    kind = F.when(F.col("ok"), "ok").otherwise(error_class(F.coalesce("sqlstate", F.lit("")), F.coalesce("message", F.lit(""))))
    return samples.groupBy("op", F.coalesce("tag", F.lit("")).alias("tag"), kind.alias("class")).agg(F.count("*").alias("n"))


def histogram(samples: DataFrame, value: str, buckets: Sequence[float], labels: Sequence[str] = ()) -> DataFrame:
    """Cumulative counts at or below each bound, with sum and count, as a metrics collector keeps them."""
    bound = [F.count_if(F.col(value) <= b).alias(f"le_{k}") for k, b in enumerate(buckets)]
    found = [*bound, F.count("*").alias("n"), F.sum(value).alias("total")]
    return samples.groupBy(*labels).agg(*found) if labels else samples.agg(*found)


def rate(samples: DataFrame, ts: str, seconds: int, labels: Sequence[str] = ()) -> DataFrame:
    """Events of each time bucket, by second."""
    return samples.groupBy(F.window(ts, f"{seconds} seconds").alias("w"), *labels).agg((F.count("*") / F.lit(seconds)).alias("rate")).select(F.col("w.start").alias("bucket"), *labels, "rate")


def bucket_quantile(buckets: Sequence[float], counts: Sequence[Column], share: float) -> Column:
    """A quantile by linear interpolation within cumulative buckets."""
    wanted = counts[-1] * F.lit(share)
    out = F.lit(float(buckets[-1]))
    for k in reversed(range(len(buckets))):
        low, below = (float(buckets[k - 1]), counts[k - 1]) if k else (0.0, F.lit(0))
        width = F.nullif(counts[k] - below, F.lit(0))
        out = F.when(counts[k] >= wanted, F.coalesce(F.lit(low) + (float(buckets[k]) - low) * (wanted - below) / width, F.lit(float(buckets[k])))).otherwise(out)
    return out
