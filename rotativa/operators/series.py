"""Time series of a corpus: months, gap-filled days, moving averages, shares, peaks, combined outlets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotativa.session import bounded_broadcast


def monthly(rows: DataFrame, date: str, kind: str) -> DataFrame:
    """(month, kind, n): volume by month (kind null) and by month and kind, in one pass of grouping sets."""
    dated = rows.where(F.col(date).isNotNull()).select(F.date_format(date, "yyyy-MM").alias("month"), F.col(kind).alias("kind"))
    return dated.rollup("month", "kind").agg(F.count("*").alias("n"), F.grouping_id().alias("_g")).where("_g < 3").where("_g = 1 or kind is not null").drop("_g")


def calendar(rows: DataFrame, day: str) -> DataFrame:
    """One row for each day from the first to the last; bounded by the range, not the rows."""
    return rows.agg(F.min(day).alias("_a"), F.max(day).alias("_b")).where("_a is not null").select(F.explode(F.sequence("_a", "_b", F.expr("interval 1 day"))).alias(day))


def daily(rows: DataFrame, day: str, value: Column, group: str | None = None) -> DataFrame:
    """(day, [group,] volume, mean): dense days of the whole range; a day without rows has volume 0 and no mean."""
    keys = [day, group] if group else [day]
    stats = rows.where(F.col(day).isNotNull()).groupBy(*keys).agg(F.count("*").alias("volume"), F.avg(value).alias("mean"))
    axis = calendar(rows, day)
    if group:
        axis = axis.crossJoin(bounded_broadcast(rows.select(group).where(F.col(group).isNotNull()).distinct()))  # days x groups is the result itself
    return axis.join(stats, keys, "left").select(*keys, F.coalesce("volume", F.lit(0)).cast("long").alias("volume"), F.round("mean", 3).alias("mean"))


def moving_average(series: DataFrame, day: str, value: str, width: int = 3, group: str | None = None) -> DataFrame:
    """``series`` with ``value_ma``: centred mean over ``width`` rows, missing values left out."""
    order = (Window.partitionBy(group) if group else Window.partitionBy()).orderBy(day).rowsBetween(-(width // 2), width // 2)
    return series.withColumn(f"{value}_ma", F.round(F.avg(F.col(value).cast("double")).over(order), 3))


def shares(rows: DataFrame, day: str, kind: str) -> DataFrame:
    """(day, kind, n, pct): share of each kind in its day, in per cent."""
    counted = rows.where(F.col(kind).isNotNull() & F.col(day).isNotNull()).groupBy(day, kind).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy(day)), 1))


def peaks(series: DataFrame, day: str, volume: str, sigmas: float = 1.5) -> DataFrame:
    """Days whose volume is above the mean by that many population standard deviations, empty days included."""
    stats = series.agg(F.avg(F.col(volume).cast("double")).alias("_m"), F.stddev_pop(F.col(volume).cast("double")).alias("_s"))
    return series.crossJoin(F.broadcast(stats)).where(F.col(volume) > F.col("_m") + F.lit(sigmas) * F.col("_s")).drop("_m", "_s")  # one row


def combined(rows: DataFrame, day: str, volume: str, mean: str) -> DataFrame:
    """(day, volume, mean): several outlets' series put together, the mean weighted by volume."""
    known = F.when(F.col(mean).isNotNull(), F.col(volume))
    total = F.sum(known)
    return rows.groupBy(day).agg(F.sum(volume).alias("volume"), F.round(F.when(total > 0, F.sum(F.col(mean) * known) / total), 3).alias("mean"))


def event_windows(events: DataFrame, time: str, size: str, slide: str | None, *keys: str) -> DataFrame:
    """(start, keys, n): tumbling or sliding counts."""
    return events.groupBy(F.window(time, size, slide) if slide else F.window(time, size), *keys).agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), *keys, "n")


def sessions(events: DataFrame, time: str, gap: str, key: str) -> DataFrame:
    """(key, start, end, n): runs of events less than ``gap`` apart."""
    return events.groupBy(F.session_window(time, gap).alias("w"), key).agg(F.count("*").alias("n")).select(key, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")
