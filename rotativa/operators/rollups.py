"""Roll-ups of annotated documents: by declared type of actor, by candidate, by outlet and month; ranges and medians."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotativa.session import bounded_broadcast


def typed_forms(seeds: DataFrame, name: str = "nombre", forms: str = "formas", kind: str = "tipo") -> DataFrame:
    """(form, kind): every declared name and form in lower case; of a form declared twice the last name's kind."""
    every = seeds.select(name, kind, F.explode(F.concat(F.array(name), F.coalesce(F.from_json(forms, "array<string>"), F.array().cast("array<string>")))).alias("form"))
    rows = every.select(F.lower(F.trim("form")).alias("form"), F.coalesce(F.nullif(kind, F.lit("")), F.lit("otro")).alias("kind"), F.col(name).alias("_n")).where("form is not null and form != ''")
    return rows.groupBy("form").agg(F.max_by("kind", F.struct("_n", "kind")).alias("kind"))


def coverage(index: DataFrame, typed: DataFrame, default: str = "otro") -> DataFrame:
    """(kind, actor, n): documents of each actor under its declared kind."""
    counted = index.groupBy(F.col("entity").alias("actor")).agg(F.countDistinct("doc_id").alias("n"))
    joined = counted.withColumn("form", F.lower(F.trim("actor"))).join(bounded_broadcast(typed), "form", "left")
    return joined.select(F.coalesce("kind", F.lit(default)).alias("kind"), "actor", "n")


def most_common(value: str, key: str) -> Column:
    """Aggregate over (value, n) rows: the value of greatest n, ties by the lesser value."""
    return F.min_by(value, F.struct((-F.col(key)).alias("n"), F.col(value).alias("v")))


def compared(mentions: DataFrame, notes: DataFrame, labels: tuple[str, ...] = ("positivo", "negativo", "neutro")) -> DataFrame:
    """(actor, n, *labels, score, emotion, frame, affective) over the documents that name each actor.

    ``mentions(actor, doc_id)`` and ``notes(doc_id, label, score, emotion, frame)``; the dominant emotion and frame
    come from counts by value, so no actor's documents are gathered in one place.
    """
    rows = mentions.distinct().join(notes, "doc_id")
    counted = rows.groupBy("actor").agg(F.count("*").alias("n"), *[F.count_if(F.col("label") == x).alias(x) for x in labels], F.round(F.avg("score"), 3).alias("score"))
    for name in ("emotion", "frame"):
        by_value = rows.where(F.col(name).isNotNull()).groupBy("actor", name).agg(F.count("*").alias("_k"))
        counted = counted.join(by_value.groupBy("actor").agg(most_common(name, "_k").alias(name)), "actor", "left")
    p, n, u = (F.col(x).cast("double") for x in labels)
    affective = F.when(p + n > 0, F.round((p + n) / (p + n + u) * (1 - F.abs(p - n) / (p + n)), 3)).otherwise(0.0)
    return counted.withColumn("affective", affective)


def histogram(rows: DataFrame, group: str, value: str) -> DataFrame:
    """(group, value, n, pct) of the rows with a value."""
    counted = rows.where(F.col(value).isNotNull() & F.col(group).isNotNull()).groupBy(group, value).agg(F.count("*").alias("n"))
    return counted.withColumn("pct", F.round(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy(group)), 1))


def flagged(rows: DataFrame, group: str, flags: tuple[str, ...]) -> DataFrame:
    """(group, n, *flags) of the rows that have any of the flags at all; a missing flag is false."""
    some = F.lit(False)
    for f in flags:
        some = some | F.col(f).isNotNull()
    return rows.where(some).groupBy(F.coalesce(group, F.lit("?")).alias(group)).agg(F.count("*").alias("n"), *[F.count_if(F.col(f)).alias(f) for f in flags])


def confusion(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(a, b, n) of the pairs of which both labels are given."""
    given = lambda c: F.col(c).isNotNull() & (F.col(c) != "")
    return pairs.where(given(a) & given(b)).groupBy(a, b).agg(F.count("*").alias("n"))


def dense_range(series: DataFrame, at: str, weight: str, share: float = 0.98) -> DataFrame:
    """(first, last, days, median): the shortest stretch of places that holds ``share`` of the weight, and the weighted median.

    ``series`` has one row for each place (a day), so its length is that of the calendar.
    """
    before = Window.orderBy(at).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    summed = series.groupBy(at).agg(F.sum(weight).alias("_w")).withColumn("_c", F.sum("_w").over(before))
    total = summed.agg(F.sum("_w").alias("_t"))
    held = summed.crossJoin(F.broadcast(total))  # one row
    ends = held.select(F.col(at).alias("_last"), F.col("_c").alias("_end"))
    starts = held.select(F.col(at).alias("_first"), (F.col("_c") - F.col("_w")).alias("_start"), (F.col("_c") - F.col("_w") + F.lit(share) * F.col("_t")).alias("_need"))
    # the first end that holds enough, by one pass over both lists in order of their sums
    merged = starts.select(F.col("_need").alias("_x"), F.lit(0).alias("_kind"), "_first", F.lit(None).cast(series.schema[at].dataType).alias("_last")).unionByName(ends.select(F.col("_end").cast("double").alias("_x"), F.lit(1).alias("_kind"), F.lit(None).cast(series.schema[at].dataType).alias("_first"), "_last"))
    ahead = Window.orderBy("_x", "_kind", "_last").rowsBetween(Window.currentRow, Window.unboundedFollowing)
    spans = merged.withColumn("_to", F.first("_last", ignorenulls=True).over(ahead)).where("_kind = 0 and _to is not null and _to >= _first")
    best = spans.agg(F.min(F.struct(F.datediff("_to", "_first").alias("d"), F.col("_first").alias("f"), F.col("_to").alias("t"))).alias("b"))
    median = held.where(F.col("_c") >= F.col("_t") / 2).agg(F.min(at).alias("median"))
    return best.crossJoin(median).select(F.col("b.f").alias("first"), F.col("b.t").alias("last"), (F.col("b.d") + 1).alias("days"), "median")  # one row each
