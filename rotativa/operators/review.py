"""Entities under review: how sure an extracted name is, what is to be looked at, and what was decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotativa.functions import text as T
from rotativa.session import bounded_broadcast

#: Names of the levels from sure to doubtful.
LEVELS = ("verde", "amarillo", "rojo")


def certainty(documents: Column, declared: Column) -> Column:
    """1 for declared names, else a score that rises with the documents: 0.30, 0.55, 0.80, 1.00."""
    return F.when(declared, F.lit(1.0)).otherwise(F.round(F.least(F.lit(1.0), F.lit(0.05) + F.lit(0.25) * documents.cast("double")), 3))


def queue(index: DataFrame, seeds: DataFrame) -> DataFrame:
    """(entity, n, score, level) of the entities that are not sure; ``seeds(form)`` holds the declared forms."""
    forms = bounded_broadcast(seeds.select(F.lower("form").alias("_f"), F.lit(True).alias("_declared")).where("_f is not null").distinct())
    counted = index.groupBy("entity").agg(F.count("*").alias("n"))
    scored = counted.withColumn("_f", F.lower("entity")).join(forms, "_f", "left").select("entity", "n", certainty(F.col("n"), F.coalesce("_declared", F.lit(False))).alias("score"))
    return scored.withColumn("level", T.labelled(F.col("score"), 0.75, 0.45, LEVELS)).where(F.col("level") != LEVELS[0])


def merged(stored: DataFrame, queued: DataFrame, pending: str) -> DataFrame:
    """The stored names with the queue put in: a decided name stays as it is, a pending one takes the new score."""
    both = stored.select("name", "decision", "score").join(queued.select(F.col("entity").alias("name"), F.col("score").alias("_new")), "name", "full")
    open_ = F.coalesce("decision", F.lit(pending)) == pending
    return both.select("name", F.coalesce("decision", F.lit(pending)).alias("decision"), F.when(open_, F.coalesce("_new", "score")).otherwise(F.col("score")).alias("score"))


def reviewed(index: DataFrame, decisions: DataFrame, dropped: str, renamed: str) -> DataFrame:
    """(entity, doc_id) of the index after review: dropped names go, renamed ones join the new name's documents.

    ``decisions(name, decision, new_name)`` holds one row for each name; it is joined by name, so its size is free.
    """
    joined = index.select("entity", "doc_id").join(decisions, F.col("entity") == F.col("name"), "left").where(F.coalesce(F.col("decision"), F.lit("")) != dropped)
    moved = (F.col("decision") == renamed) & (F.coalesce("new_name", F.lit("")) != "")
    return joined.select(F.when(moved, F.col("new_name")).otherwise(F.col("entity")).alias("entity"), "doc_id").distinct()


def latest_decisions(rows: DataFrame, name: str, order: str) -> DataFrame:
    """(name, decision, new_name): the last entry of each name."""
    return rows.groupBy(F.col(name).alias("name")).agg(F.max_by(F.struct("decision", "nombre_nuevo"), order).alias("d")).select("name", "d.decision", F.col("d.nombre_nuevo").alias("new_name"))


def entity_confidence(known: Column, verified: Column, extractor: Column, model: Column) -> Column:
    """1 for verified names, else 0.3 for a declared one, 0.25 of the extractor's and 0.45 of the model's confidence."""
    return F.when(verified, F.lit(1.0)).otherwise(F.round(F.lit(0.3) * known.cast("double") + F.lit(0.25) * extractor + F.lit(0.45) * model, 3))


def tone_confidence(model: Column, neutral: Column) -> Column:
    """The model's confidence, a tenth more for neutral texts, at most 1."""
    return F.when(neutral, F.least(F.lit(1.0), model + F.lit(0.1))).otherwise(model)


def recognition_confidence(percent: Column, mended: Column) -> Column:
    """Text recognition's 0 to 100 as 0 to 1, a little more where it was mended afterwards."""
    base = F.greatest(F.lit(0.0), F.least(F.lit(1.0), percent / F.lit(100.0)))
    return F.round(F.when(mended, F.least(F.lit(1.0), base + F.lit(0.15))).otherwise(base), 3)
