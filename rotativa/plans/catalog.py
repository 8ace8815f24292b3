"""Registered queries of the core and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from rotativa.operators import timestamps
from rotativa.plans import reference_queries, rollup_queries
from rotativa.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]


def p6_found(spark: SparkSession, directory: str) -> DataFrame:
    notes = table(spark, directory, "notas", "id", "medio", "url", "fecha_publicacion", "fecha_captura")
    results = table(spark, directory, "resultados", "resultado_id", "medio", "url", "fecha")
    return timestamps.instants(notes, results, table(spark, directory, "medios"))


def queries() -> dict[str, Query]:
    return {"p6_found": p6_found} | reference_queries.QUERIES | rollup_queries.QUERIES


def oracle_sql() -> dict[str, str]:
    return reference_queries.SQL | rollup_queries.SQL
