"""Lines repeated across one site's documents.

Lines are normalised and hashed; distinct documents are counted for each source and hash (each document
sends a line once, so counting is a partial sum before the shuffle), the counts meet a threshold on
number and share of the source's documents, and the frequent hashes are joined back on the lines.

A source's frequent lines number at most (mean lines of a document) / ``share``, so the set is small; it is
still broadcast only after a check of its size. No group is collected: a source that holds a third of all
rows costs partial sums only.

Defined results: null and empty texts have no lines; blank lines never count; a line twice in one document
counts once but both places are reported; rows with a null source form a source of their own; repeated
ids count as rows of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotativa.session import bounded_broadcast

MIN_DOCUMENTS = 6
MIN_SHARE = 0.03
#: White space, the no-break kinds included.
BLANKS = "[\\s\\u0085\\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]+"


def normal_line(line: Column) -> Column:
    """Equal for lines that are the same but for outer and inner white space, case and digits."""
    return F.regexp_replace(F.lower(F.trim(F.regexp_replace(line, BLANKS, " "))), r"\p{Nd}+", "0")


def _hash(line: Column) -> Column:
    return F.struct(F.xxhash64(line).alias("x"), F.hash(line).alias("y"))


def frequent_lines(documents: DataFrame, source: str, text: str, min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """(source, h, documents, share) of the lines repeated within a source."""
    own = F.filter(F.transform(F.split(text, "\n"), normal_line), lambda x: x != "")
    lines = documents.where(F.col(text).isNotNull()).select(source, F.explode(F.array_distinct(F.transform(own, _hash))).alias("h"))
    counts = lines.groupBy(source, "h").agg(F.count("*").alias("documents")).where(F.col("documents") >= min_documents)
    totals = documents.groupBy(source).agg(F.count("*").alias("total")).withColumnRenamed(source, "_source")
    joined = counts.join(bounded_broadcast(totals), F.col(source).eqNullSafe(F.col("_source")))
    # the integer form of documents / total >= share, free of rounding
    return joined.where(F.col("documents") * 1_000_000 >= F.col("total") * F.lit(round(min_share * 1_000_000))).select(source, "h", "documents", (F.col("documents") / F.col("total")).alias("share"))


def occurrences(documents: DataFrame, key: str = "id", source: str = "medio", text: str = "cuerpo", min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """(key, linea): every place of a line repeated within its source."""
    frequent = frequent_lines(documents, source, text, min_documents, min_share).select(F.col(source).alias("_source"), F.col("h").alias("_h"))
    lines = documents.where(F.col(text).isNotNull()).select(key, source, F.posexplode(F.transform(F.split(text, "\n"), lambda x: _hash(normal_line(x)))).alias("linea", "h"))
    return lines.join(bounded_broadcast(frequent), F.col(source).eqNullSafe(F.col("_source")) & (F.col("h") == F.col("_h")), "left_semi").select(key, "linea")


def without_repeated(documents: DataFrame, key: str = "id", source: str = "medio", text: str = "cuerpo", min_documents: int = MIN_DOCUMENTS, min_share: float = MIN_SHARE) -> DataFrame:
    """(key, text, removed): each document rebuilt without its source's repeated lines.

    The source's frequent hashes come to the document as one set, so texts are not shuffled.
    """
    frequent = frequent_lines(documents, source, text, min_documents, min_share).groupBy(source).agg(F.collect_set("h").alias("_set")).withColumnRenamed(source, "_source")
    joined = documents.select(key, source, text).join(bounded_broadcast(frequent), F.col(source).eqNullSafe(F.col("_source")), "left")
    lines = F.split(text, "\n")
    kept = F.filter(lines, lambda x: ~F.array_contains("_set", _hash(normal_line(x))))
    rebuilt = F.when(F.col("_set").isNull(), F.col(text)).otherwise(F.array_join(kept, "\n"))
    removed = F.when(F.col(text).isNull() | F.col("_set").isNull(), 0).otherwise(F.size(lines) - F.size(kept))
    return joined.select(key, rebuilt.alias(text), removed.cast("int").alias("removed"))
