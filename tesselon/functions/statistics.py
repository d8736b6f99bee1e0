"""Descriptive statistics as grouped aggregates and windows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


#: Rows of a group that a running average copies while it grows; blocks of these are then put together.
EMA_ROWS = 256


def mean(x) -> Column:
    return F.coalesce(F.avg(x), F.lit(0.0))


def variance(x) -> Column:
    """Of a sample; 0 for fewer than two values."""
    return F.coalesce(F.when(F.count(x) > 1, F.var_samp(x)), F.lit(0.0))


def std_dev(x) -> Column:
    return F.sqrt(variance(x))


def percentile(x, p: float) -> Column:
    """Linear interpolation, p from 0 to 100."""
    return F.coalesce(F.percentile(x, F.lit(p / 100)), F.lit(0.0))


def median(x) -> Column:
    return percentile(x, 50)


def summary(x) -> list[Column]:
    """All at once; the percentiles share one buffer of the group's different values."""
    x = F.col(x) if isinstance(x, str) else x
    zero = F.lit(0.0)
    points = (50, 25, 75, 90, 95, 99)
    found = F.percentile(x, F.array(*[F.lit(p / 100) for p in points]))
    at = {p: F.coalesce(F.get(found, F.lit(k)), zero) for k, p in enumerate(points)}
    return [
        F.count(x).alias("count"), F.coalesce(F.sum(x), zero).alias("sum"), mean(x).alias("mean"), at[50].alias("median"),
        F.coalesce(F.min(x), zero).alias("min"), F.coalesce(F.max(x), zero).alias("max"), variance(x).alias("variance"), std_dev(x).alias("std_dev"),
        *[at[p].alias(f"p{p}") for p in (25, 50, 75, 90, 95, 99)],
    ]


def modes(df: DataFrame, by: Sequence[str], value: str) -> DataFrame:
    """All most frequent values of each group."""
    counts = df.groupBy(*by, value).agg(F.count("*").alias("n"))
    best = counts.groupBy(*by).agg(F.max("n").alias("most"))
    joined = counts.join(best, list(by)) if by else counts.crossJoin(F.broadcast(best))
    return joined.where("n = most").drop("most")


def histogram(df: DataFrame, value: str, bins: int) -> DataFrame:
    """Counts of equal-width bins [low, high); the greatest value lies beyond the last."""
    bounds = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"))
    width = (F.col("hi") - F.col("lo")) / bins
    placed = df.where(F.col(value).isNotNull()).crossJoin(F.broadcast(bounds)).withColumn("bin", F.when(width > 0, F.floor((F.col(value) - F.col("lo")) / width)).otherwise(0).cast("int"))
    return placed.where(F.col("bin") < bins).groupBy("bin", (F.col("lo") + F.col("bin") * width).alias("low")).agg(F.count("*").alias("n"))


def moving_average(value: str, width: int, order: Sequence, by: Sequence = ()) -> Column:
    return F.avg(value).over(Window.partitionBy(*by).orderBy(*order).rowsBetween(1 - width, 0))


def exponential_average(df: DataFrame, by: Sequence[str], order: Sequence[str], value: str, alpha: float, out: str = "ema") -> DataFrame:
    """(by, order, value, out): a recurrence over each group's rows in order, seeded with the first value."""
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(value).cast("double").alias("__v")))).alias("__rows"))
    size = F.size("__rows")
    parts = F.transform(F.sequence(F.lit(0), F.floor((size - 1) / EMA_ROWS).cast("int")), lambda k: F.slice("__rows", k * EMA_ROWS + 1, F.lit(EMA_ROWS)))

    def step(acc, x):
        now = F.when(acc["last"].isNull(), x["__v"]).otherwise(alpha * x["__v"] + (1 - alpha) * acc["last"])
        return F.struct(F.concat(acc["all"], F.array(now)).alias("all"), now.alias("last"))

    def part(acc, xs):
        start = F.struct(F.array().cast("array<double>").alias("all"), acc["last"].alias("last"))
        done = F.aggregate(xs, start, step)
        return F.get(F.transform(F.array(done), lambda d: F.struct(F.concat(acc["all"], F.array(d["all"])).alias("all"), d["last"].alias("last"))), F.lit(0))

    start = F.struct(F.array().cast("array<array<double>>").alias("all"), F.lit(None).cast("double").alias("last"))
    values = F.flatten(F.aggregate(parts, start, part, lambda acc: acc["all"]))
    pairs = rows.withColumn("__ema", values).select(*by, F.explode(F.arrays_zip("__rows", "__ema")).alias("__x"))
    return pairs.select(*by, *[F.col(f"__x.__rows.{o}").alias(o) for o in order], F.col("__x.__rows.__v").alias(value), F.col("__x.__ema").alias(out))


def z_score(value: str, by: Sequence = ()) -> Column:
    w = Window.partitionBy(*by)
    sd = F.stddev_samp(value).over(w)
    return F.when(F.coalesce(sd, F.lit(0.0)) == 0, 0.0).otherwise((F.col(value) - F.avg(value).over(w)) / sd)
