"""Entities of a corpus: mentions, noise, the index of entities and documents, canonical names, prominence."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotativa.functions import text as T
from rotativa.session import bounded_broadcast

#: Runs of capitalised words.
NAME = r"\p{Lu}[\p{Ll}\p{Lu}]+(?: \p{Lu}[\p{Ll}\p{Lu}]+)+"


def mentions(documents: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, entity, at): every run of capitalised words with its ordinal in the text."""
    found = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(NAME), 0)
    return documents.select(key, F.posexplode(found).alias("at", "entity")).select(key, "entity", "at")


def noise(entity: Column, connectors: tuple[str, ...], most: int = 5) -> Column:
    """The first reason for which a string is no entity, else null."""
    tokens = F.split(F.trim(entity), " ")
    first = F.lower(F.element_at(tokens, 1))
    return (
        F.when(F.trim(entity) == "", "vacia")
        .when(F.lower(entity).isin(*connectors), "conector")
        .when(entity.rlike(r"\d"), "cifra")
        .when(entity.rlike(r"^[¿¡?!]"), "signo")
        .when(entity.rlike(r"^\p{Ll}"), "minuscula")
        .when(first.isin(*connectors), "comienzo")
        .when(F.length(entity) <= 2, "corta")
        .when(F.size(tokens) > most, "larga")
    )


def entity_index(documents: DataFrame, connectors: tuple[str, ...] = ()) -> DataFrame:
    """(entity, doc_id, n): distinct pairs of clean entities and documents with their mentions."""
    clean = mentions(documents).where(noise(F.col("entity"), connectors).isNull())
    return clean.groupBy("entity", "doc_id").agg(F.count("*").alias("n"))


def canonical(index: DataFrame, names: DataFrame) -> DataFrame:
    """The index under canonical names; ``names(variant, canonical)``, unmatched entities stay."""
    keyed = bounded_broadcast(names.select(T.fold_trim(F.col("variant")).alias("_v"), "canonical").groupBy("_v").agg(F.min("canonical").alias("canonical")))
    joined = index.withColumn("_v", T.fold_trim(F.col("entity"))).join(keyed, "_v", "left")
    return joined.select(F.coalesce("canonical", "entity").alias("entity"), "doc_id", "n").groupBy("entity", "doc_id").agg(F.sum("n").alias("n"))


def fragment(entity: Column, words: dict[str, tuple[str, ...]], most: int = 5) -> Column:
    """The first reason for which a string is no name, else null.

    ``words`` holds lists in lower case: ``connectors``, ``verbs`` (of saying), ``common`` (offices and common nouns),
    ``kept`` (abbreviations with digits that are names), ``openings`` (prepositions and articles) and ``signals``
    (words that betray two pieces run together).
    """
    bare = F.trim(entity)
    low = F.lower(bare)
    parts = F.split(low, r"\s+")
    first = F.element_at(parts, 1)
    return (
        F.when(bare == "", "vacia")
        .when(low.isin(*words["connectors"]), "conector")
        .when(low.isin(*words["verbs"]), "verbo")
        .when(low.isin(*words["common"]), "generico")
        .when(low.isin(*words["kept"]), F.lit(None))
        .when(bare.rlike(r"[0-9]"), "cifra")
        .when(bare.rlike(r"^[¿¡?!]"), "signo")
        .when(bare.rlike(r"^\p{Ll}"), "minuscula")
        .when(first.isin(*words["openings"]), "comienzo")
        .when(first.isin(*words["verbs"]), "verbo")
        .when(F.length(bare) <= 2, "corta")
        .when(entity.contains("\n"), "salto")
        .when(low.rlike("(ó|aron|ieron)$") & ~low.contains(" "), "conjugada")
        .when(F.size(parts) > most, "larga")
        .when((F.size(parts) >= 3) & F.arrays_overlap(parts, F.array(*[F.lit(w) for w in words["signals"]])), "fragmento")
    )


def name_tokens(name: Column, particles: tuple[str, ...]) -> Column:
    """The folded tokens of a name that tell it from others: longer than two letters and no particles."""
    return F.array_sort(F.array_distinct(F.filter(F.regexp_extract_all(T.fold(name), F.lit(T.RUN), 0), lambda x: (F.length(x) > 2) & ~x.isin(*particles))))


def canonical_people(names: DataFrame, seeds: DataFrame, particles: tuple[str, ...]) -> DataFrame:
    """(name, canonical): declared forms first, then each name goes to the first fuller name that holds all of its tokens.

    Fuller names come first (more tokens, then by name). The first name in that order whose tokens hold another's is
    held by no fuller one, so one join is enough: names meet on their rarest token, an equi-join in place of a
    comparison of all pairs. ``names(name)`` is distinct, ``seeds(form, canonical)`` are the declared forms.
    """
    rows = names.where("name is not null").select("name", name_tokens(F.col("name"), particles).alias("t"), T.fold_trim(F.col("name")).alias("_f"))
    declared = seeds.where("form is not null").select(T.fold_trim(F.col("form")).alias("_f"), "canonical").groupBy("_f").agg(F.max("canonical").alias("seed"))
    rows = rows.join(declared, "_f", "left")
    free = rows.where("seed is null and size(t) > 0").select("name", "t")
    tokens = free.select("name", "t", F.explode("t").alias("k"))
    common = tokens.groupBy("k").agg(F.count("*").alias("df"))
    rarest = tokens.join(common, "k").groupBy("name").agg(F.min_by(F.struct("k", "t"), F.struct("df", "k")).alias("r")).select("name", F.col("r.k").alias("k"), F.col("r.t").alias("t"))
    fuller = tokens.select("k", F.col("name").alias("_other"), F.col("t").alias("_wide"))
    held = rarest.join(fuller, "k").where(F.size(F.array_except("t", "_wide")) == 0)
    found = held.groupBy("name").agg(F.min_by("_other", F.struct((-F.size("_wide")).alias("n"), "_other")).alias("leader"))
    return rows.join(found, "name", "left").select("name", F.coalesce("seed", "leader", "name").alias("canonical"))


def linked(names: DataFrame, candidates: DataFrame, particles: tuple[str, ...], least: float = 0.5) -> DataFrame:
    """(name, ent_id, score): the candidate with the greatest share of tokens in common with each name, ties by the lesser id.

    ``names(name)`` is distinct, ``candidates(ent_id, form)`` holds the forms of a stored candidate table. Names and
    candidates meet on a token, so only pairs that share one are scored.
    """
    a = names.where("name is not null").select("name", name_tokens(F.col("name"), particles).alias("t"))
    b = candidates.where("form is not null").select("ent_id", "form", name_tokens(F.col("form"), particles).alias("u")).distinct()
    met = a.select("name", "t", F.explode("t").alias("k")).join(b.select("ent_id", "form", "u", F.explode("u").alias("k")), "k")
    shared = met.groupBy("name", "ent_id", "form").agg(F.count("*").alias("n"), F.first(F.size("t")).alias("p"), F.first(F.size("u")).alias("q"))
    scored = shared.select("name", "ent_id", F.round(F.col("n") / (F.col("p") + F.col("q") - F.col("n")), 3).alias("score"))
    best = scored.groupBy("name").agg(F.min_by(F.struct("ent_id", "score"), F.struct((-F.col("score")).alias("s"), "ent_id")).alias("b"))
    return best.select("name", "b.ent_id", "b.score").where(F.col("score") >= least)


def containment_groups(index: DataFrame) -> DataFrame:
    """(entity, leader): a shorter name goes to the most frequent longer name that holds its last words.

    Each name is expanded to the suffixes of its token list, so the containment is an equi-join.
    """
    names = index.groupBy("entity").agg(F.count("*").alias("docs")).withColumn("_t", F.split("entity", " "))
    longer = names.where(F.size("_t") > 2).select("entity", "docs", F.explode(F.transform(F.sequence(F.lit(2), F.size("_t") - 1), lambda n: F.array_join(F.slice("_t", -n, n), " "))).alias("short"))
    best = longer.groupBy("short").agg(F.max_by("entity", F.struct("docs", F.length("entity"), "entity")).alias("leader"))
    return names.join(best, names["entity"] == best["short"], "left").select("entity", F.coalesce("leader", "entity").alias("leader"))


def outlet_actors(index: DataFrame, documents: DataFrame, actors: int = 8) -> DataFrame:
    """(source, actor, n): documents of each outlet that name each of the most named actors."""
    top = index.groupBy("entity").agg(F.count("*").alias("docs")).orderBy(F.desc("docs"), "entity").limit(actors).select("entity")
    rows = index.join(F.broadcast(top), "entity", "left_semi").join(documents.select("doc_id", "source"), "doc_id")
    return rows.groupBy(F.coalesce("source", F.lit("?")).alias("source"), F.col("entity").alias("actor")).agg(F.count("*").alias("n"))


def prominence(documents: DataFrame, actors: dict[str, tuple[str, ...]]) -> DataFrame:
    """(doc_id, actor, first_at, position, mentions, rank): whole-word folded mentions, ranked by the first."""
    folded = T.fold(F.coalesce(F.col("text"), F.lit("")))
    plain = lambda x: x.lower().translate(str.maketrans(T.MARKED, T.FOLDED))
    rows = None
    spread = []
    for order, (actor, forms) in enumerate(actors.items()):
        pattern = r"(?<![\p{L}\p{N}_])(?:" + "|".join(re.escape(plain(f)) for f in sorted(forms, key=len, reverse=True)) + r")(?![\p{L}\p{N}_])"
        # what stands before the first match, in characters (a regular expression's own places count UTF-16 units)
        first = F.length(F.element_at(F.split("_f", pattern, 2), 1)) + 1
        spread.append(F.struct(F.lit(actor).alias("actor"), F.lit(order).alias("ord"), first.alias("at"), F.regexp_count("_f", F.lit(pattern)).alias("mentions")))
    held = documents.select("doc_id", folded.alias("_f"), F.length("text").alias("_n"))
    rows = held.select("doc_id", "_n", F.explode(F.array(*spread)).alias("a")).select("doc_id", "_n", "a.*").where("mentions > 0")
    rank = F.row_number().over(Window.partitionBy("doc_id").orderBy("at", "ord"))
    return rows.select("doc_id", "actor", (F.col("at") - 1).alias("first_at"), F.round((F.col("at") - 1).cast("double") / F.greatest("_n", F.lit(1)), 3).alias("position"), "mentions", rank.alias("rank"))


def prominence_summary(ranked: DataFrame) -> DataFrame:
    """(actor, docs, first, position): documents, times named first, mean relative place."""
    return ranked.groupBy("actor").agg(F.count("*").alias("docs"), F.sum(F.when(F.col("rank") == 1, 1).otherwise(0)).alias("first"), F.round(F.avg("position"), 3).alias("position"))


#: Pairs of quotation marks around 20 to 500 characters; single ones stand after and before no letter.
QUOTES = ("«([^«»]{20,500})»", "“([^“”]{20,500})”", '"([^"]{20,500})"', r"(?:^|[^\p{L}\p{N}])'([^']{20,500})'(?:$|[^\p{L}\p{N}])")


def shared_quotes(documents: DataFrame, least_words: int = 5, least_documents: int = 2) -> DataFrame:
    """(quote, documents): quotations of 20 to 500 characters that stand in several documents, each counted once."""
    text = F.coalesce("text", F.lit(""))
    found = F.concat(*[F.regexp_extract_all(text, F.lit(p), 1) for p in QUOTES])
    rows = documents.select("doc_id", F.explode(F.array_distinct(F.transform(found, lambda q: F.trim(q)))).alias("quote")).where(T.word_count(F.col("quote")) >= least_words)
    return rows.groupBy("quote").agg(F.count("*").alias("documents")).where(F.col("documents") >= least_documents)
