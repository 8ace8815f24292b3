"""Registered queries of the corpus operators."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotativa.llm import boilerplate, encoding, leakage, mojibake, names, repeated_lines, residue, spans, truncation
from rotativa.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
#: Folder of the public vocabulary files.
TOKENIZERS = os.environ.get("ROTATIVA_TOKENIZERS", "/opt/tokenizers")


def _pages(spark: SparkSession, directory: str) -> tuple[DataFrame, list[str]]:
    pages = boilerplate.page_rows(table(spark, directory, "notas", "id", "url", "cuerpo"), table(spark, directory, "capturas", "captura_id", "url_final", "texto"))
    outlets = table(spark, directory, "medios", "medio", "dominio").distinct().collect()
    return pages, [x for row in outlets for x in row if x]


def p1_found(spark: SparkSession, directory: str) -> DataFrame:
    pages, brands = _pages(spark, directory)
    bad = residue.residue(table(spark, directory, "notas", "id", "cuerpo", "titular"), columns=("cuerpo",)).select(F.lit("notas").alias("tabla"), "id")
    return boilerplate.furniture(pages.join(bad, ["tabla", "id"], "left_anti"), brands)


def p1_content(spark: SparkSession, directory: str) -> DataFrame:
    return boilerplate.main_content(*_pages(spark, directory))


def p2_found(spark: SparkSession, directory: str) -> DataFrame:
    return residue.residue(table(spark, directory, "notas", "id", "cuerpo", "titular"))


def p3_found(spark: SparkSession, directory: str) -> DataFrame:
    return repeated_lines.occurrences(table(spark, directory, "notas", "id", "medio", "cuerpo")).distinct()


def p3_clean(spark: SparkSession, directory: str) -> DataFrame:
    return repeated_lines.without_repeated(table(spark, directory, "notas", "id", "medio", "cuerpo"))


def _texts(spark: SparkSession, directory: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, directory, "notas", "id", "medio", "cuerpo"), table(spark, directory, "publicaciones", "seq", "plataforma", "texto")


def p4_found(spark: SparkSession, directory: str) -> DataFrame:
    return truncation.truncated(*_texts(spark, directory), outlets=table(spark, directory, "medios", "medio", "dominio"))


def p4_rates(spark: SparkSession, directory: str) -> DataFrame:
    return truncation.rates(*_texts(spark, directory), outlets=table(spark, directory, "medios", "medio", "dominio"))


def p5_found(spark: SparkSession, directory: str) -> DataFrame:
    return mojibake.garbled(table(spark, directory, "notas", "id", "medio", "cuerpo", "titular")).select("id", "campo").distinct()


def p5_repaired(spark: SparkSession, directory: str) -> DataFrame:
    return mojibake.repaired(table(spark, directory, "notas", "id", "medio", "cuerpo", "titular"))


def p7_found(spark: SparkSession, directory: str) -> DataFrame:
    return names.variants(table(spark, directory, "entidades_interes", "ent_id", "nombre", "formas"), table(spark, directory, "revision_entidades", "rev_id", "nombre"))


def p7_members(spark: SparkSession, directory: str) -> DataFrame:
    return names.members(table(spark, directory, "entidades_interes", "ent_id", "nombre", "formas"), table(spark, directory, "revision_entidades", "rev_id", "nombre"))


def p8_ids(spark: SparkSession, directory: str) -> DataFrame:
    return encoding.encode(table(spark, directory, "documents", "doc_id", "text"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


def p9_found(spark: SparkSession, directory: str) -> DataFrame:
    found = leakage.leaks(table(spark, directory, "documents", "doc_id", "text"), table(spark, directory, "eval_items", "item_id", "text"))
    return found.select("doc_id", "item_id").distinct()


def p9_passages(spark: SparkSession, directory: str) -> DataFrame:
    return leakage.passages(table(spark, directory, "documents", "doc_id", "text"), table(spark, directory, "eval_items", "item_id", "text"))


def p10_found(spark: SparkSession, directory: str) -> DataFrame:
    return spans.document_pairs(table(spark, directory, "documents", "doc_id", "text"))


def p10_shares(spark: SparkSession, directory: str) -> DataFrame:
    return spans.shares(table(spark, directory, "documents", "doc_id", "text"))


def p10_passages(spark: SparkSession, directory: str) -> DataFrame:
    return spans.passages(table(spark, directory, "documents", "doc_id", "text"))


def p10_classes(spark: SparkSession, directory: str) -> DataFrame:
    return spans.membership(table(spark, directory, "documents", "doc_id", "text"))


def queries() -> dict[str, Query]:
    return {"p1_found": p1_found, "p1_content": p1_content, "p2_found": p2_found, "p3_found": p3_found, "p3_clean": p3_clean, "p4_found": p4_found, "p4_rates": p4_rates, "p5_found": p5_found, "p5_repaired": p5_repaired, "p7_found": p7_found, "p7_members": p7_members, "p8_ids": p8_ids, "p9_found": p9_found, "p9_passages": p9_passages, "p10_found": p10_found, "p10_shares": p10_shares, "p10_passages": p10_passages, "p10_classes": p10_classes}


#: Lines of ``notas`` with the key under which two lines are the same, and the lines repeated in a ``medio``.
_REPEATED = r"""
WITH a AS (SELECT id, medio, string_split(cuerpo, chr(10)) AS x FROM notas WHERE cuerpo IS NOT NULL),
l AS (SELECT id, medio, unnest(range(len(x))) AS linea, unnest(x) AS line FROM a),
n AS (SELECT id, medio, CAST(linea AS INTEGER) AS linea, line, regexp_replace(lower(trim(regexp_replace(line,
  '[\s\x{0b}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}\x{feff}]+', ' ', 'g'))), '\p{Nd}+', '0', 'g') AS k FROM l),
t AS (SELECT medio, count(*) AS total FROM notas GROUP BY medio),
f AS (SELECT n.medio, k FROM n JOIN t ON n.medio IS NOT DISTINCT FROM t.medio WHERE k <> ''
  GROUP BY n.medio, k, total HAVING count(DISTINCT id) >= 6 AND count(DISTINCT id) * 1000000 >= total * 30000)
"""


def oracle_sql() -> dict[str, str]:
    return {
        "p3_found": _REPEATED + "SELECT DISTINCT id, linea FROM n JOIN f ON n.medio IS NOT DISTINCT FROM f.medio AND n.k = f.k",
        "p3_clean": _REPEATED
        + """, m AS (SELECT n.*, f.k IS NOT NULL AS repeated FROM n LEFT JOIN f ON n.medio IS NOT DISTINCT FROM f.medio AND n.k = f.k),
c AS (SELECT id, coalesce(string_agg(line, chr(10) ORDER BY linea) FILTER (WHERE NOT repeated), '') AS cuerpo, CAST(count(*) FILTER (WHERE repeated) AS INTEGER) AS removed FROM m GROUP BY id)
SELECT notas.id, c.cuerpo, coalesce(c.removed, 0) AS removed FROM notas LEFT JOIN c ON notas.id = c.id""",
    }
