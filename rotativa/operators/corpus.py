"""Corpus maintenance: relevance, cleaning, de-duplication, merging, extraction quality, confidence, origin."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotativa.functions import text as T
from rotativa.session import bounded_broadcast, cut


def relevant(text: Column, any_of: tuple[str, ...] = (), none_of: tuple[str, ...] = ()) -> Column:
    """Whether the folded text holds one of the terms, if any are given, and none of the excluded ones."""
    folded = T.fold(F.coalesce(text, F.lit("")))
    plain = lambda xs: [x.lower().translate(str.maketrans(T.MARKED, T.FOLDED)) for x in xs]
    keep = F.lit(True)
    if any_of:
        hit = F.lit(False)
        for x in plain(any_of):
            hit = hit | folded.contains(x)
        keep = keep & hit
    for x in plain(none_of):
        keep = keep & ~folded.contains(x)
    return keep


def clean_body(text: Column, furniture: str) -> Column:
    """Lines that are neither blank nor match ``furniture``, trimmed, with a blank line between."""
    lines = F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.regexp_replace(x, r"^[\s\u00a0]+|[\s\u00a0]+$", ""))
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~F.lower(x).rlike(furniture)), "\n\n")


def first_captures(notes: DataFrame, key: str, text: str, order: str) -> DataFrame:
    """Rows kept when they come in ``order``: the first of each key, then the first of each content.

    A text without content is never a repetition. Each content's winner is an aggregate of keys (partial
    minima before the shuffle), so a content that a third of all rows share costs one row for a partition.
    """
    hashed = notes.select(key, F.struct(order, T.content_hash(F.col(text)).alias("_h")).alias("_r"))
    # each text is hashed once; what is kept of it is its number and sixteen digits
    firsts = cut(hashed.groupBy(key).agg(F.min("_r").alias("_r")).select(f"_r.{order}", "_r._h"))
    repeated = firsts.where("_h != ''").groupBy("_h").agg(F.min(order).alias("_winner"))
    kept = firsts.where("_h = ''").select(order).unionByName(repeated.select(F.col("_winner").alias(order)))
    return notes.join(kept, order, "left_semi")


def not_stored(new: DataFrame, stored: DataFrame, key: str) -> DataFrame:
    """Rows of ``new`` whose key is not stored yet."""
    return new.join(stored.select(key).distinct(), key, "left_anti")


def merge_columns(stored: DataFrame, updates: DataFrame, key: str, columns: tuple[str, ...]) -> DataFrame:
    """Stored rows with the given columns replaced where the update has a value."""
    renamed = updates.select(key, *[F.col(c).alias(f"_{c}") for c in columns])
    joined = stored.join(renamed, key, "left")
    return joined.select(*[F.coalesce(f"_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns])


def upsert(stored: DataFrame, new: DataFrame, key: tuple[str, ...]) -> DataFrame:
    """Union by key; the new row wins."""
    both = stored.withColumn("_p", F.lit(0)).unionByName(new.withColumn("_p", F.lit(1)))
    rest = [c for c in stored.columns if c not in key]
    return both.groupBy(*key).agg(F.max_by(F.struct(*rest), "_p").alias("_r")).select(*key, "_r.*")


def extraction_quality(notes: DataFrame, key: str, text: str, headline: str, interface: str, wall: str, least: int = 120, short: int = 250) -> DataFrame:
    """(key, words, score, verdict, reasons): how far a text looks like a well extracted article, and what speaks against it.

    ``interface`` and ``wall`` are patterns of interface phrases and of a wall before the content.
    """
    body = F.coalesce(F.col(text), F.lit(""))
    lines = F.filter(F.transform(F.split(body, "\n"), lambda x: F.trim(x)), lambda x: F.length(x) > 15)
    base = notes.select(
        key,
        F.coalesce(F.col(headline), F.lit("")).alias("_t"),
        T.word_count(body).alias("words"),
        F.regexp_count(F.lower(body), F.lit(interface)).alias("_ui"),
        F.lower(body).rlike(wall).alias("_wall"),
        F.size(lines).alias("_lines"),
        F.size(F.array_distinct(lines)).alias("_unique"),
        F.length(body).alias("_chars"),
        F.length(F.regexp_replace(body, r"[\p{L}\p{N}\s.,;:!?¡¿()\"'«»“”–—-]", "")).alias("_odd"),
    )
    density = F.col("_ui").cast("double") * 100.0 / F.greatest("words", F.lit(1))
    repeated = (F.col("_lines") > 0) & (F.col("_unique").cast("double") / F.greatest("_lines", F.lit(1)) < 0.6)
    odd = F.col("_odd").cast("double") / F.greatest("_chars", F.lit(1)) > 0.08
    named = F.array(
        F.when(F.col("words") == 0, "sin texto"),
        F.when(F.col("words").between(1, least - 1), "cuerpo corto").when(F.col("words").between(least, short - 1), "cuerpo breve"),
        F.when((F.col("words") > 0) & F.col("_wall"), "muro"),
        F.when((F.col("words") > 0) & (density > 1.2), F.when(density > 3, "mucha interfaz").otherwise("algo de interfaz")),
        F.when((F.col("words") > 0) & repeated, "lineas repetidas"),
        F.when((F.col("words") > 0) & odd, "signos extraños"),
        F.when((F.col("words") > 0) & (F.trim("_t") == ""), "sin titular"),
    )
    lost = (
        F.when(F.col("words") < least, 0.35).when(F.col("words") < short, 0.12).otherwise(0.0)
        + F.when(density > 3, 0.30).when(density > 1.2, 0.12).otherwise(0.0)
        + F.when(F.col("_wall"), 0.40).otherwise(0.0)
        + F.when(repeated, 0.20).otherwise(0.0)
        + F.when(odd, 0.15).otherwise(0.0)
        + F.when(F.trim("_t") == "", 0.08).otherwise(0.0)
    )
    score = F.when(F.col("words") == 0, 0.0).otherwise(F.round(F.greatest(F.lit(0.0), F.lit(1.0) - lost), 2))
    scored = base.select(key, "words", score.alias("score"), F.array_join(F.array_compact(named), "; ").alias("reasons"))
    return scored.withColumn("verdict", F.when(F.col("words") == 0, "malo").otherwise(T.labelled(F.col("score"), 0.75, 0.45, ("confiable", "revisar", "malo"))))


def confidence(notes: DataFrame, key: str, text: str, headline: str, date: str, method: str, generic: str) -> DataFrame:
    """(key, score, level, reasons): deductions for short text, missing date or headline and generic extraction."""
    missing = lambda c: F.trim(F.coalesce(F.col(c).cast("string"), F.lit(""))) == ""
    checks = [(T.word_count(F.col(text)) < 40, 0.5, "texto breve"), (missing(date), 0.2, "sin fecha"), (missing(headline), 0.2, "sin titular"), (F.coalesce(F.col(method), F.lit("")) == generic, 0.1, "extraccion generica")]
    lost = F.lit(0.0)
    for c, n, _ in checks:
        lost = lost + F.when(c, n).otherwise(0.0)
    reasons = F.array_compact(F.array(*[F.when(c, r) for c, _, r in checks]))
    scored = notes.select(key, F.round(F.greatest(F.lit(0.0), F.lit(1.0) - lost), 2).alias("score"), F.array_join(reasons, "; ").alias("reasons"))
    return scored.withColumn("level", T.labelled(F.col("score"), 0.75, 0.45, ("verde", "amarillo", "rojo")))


def origin(rows: DataFrame, url: str, outlets: DataFrame, home: str, top_level: dict[str, str]) -> DataFrame:
    """Rows with (country, domestic, foreign, provenance): outlet table first, then the host's last label."""
    known = outlets.select(F.col("dominio").alias("_host"), F.col("pais").alias("_table"))
    label = F.element_at(F.split("_host", r"\."), -1)
    pairs = F.create_map(*[F.lit(x) for p in top_level.items() for x in p])
    joined = rows.withColumn("_host", T.host(F.col(url))).join(bounded_broadcast(known), "_host", "left").withColumn("_tld", F.when(F.col("_host") != "", F.try_element_at(pairs, label)))
    country = F.coalesce("_table", "_tld")
    out = joined.withColumn("country", country).withColumn("domestic", F.coalesce(country == home, F.lit(False))).withColumn("foreign", F.coalesce(country != home, F.lit(False)))
    return out.withColumn("provenance", F.when(F.col("_table").isNotNull(), "tabla").when(F.col("_tld").isNotNull(), "dominio").otherwise("desconocido")).select(*rows.columns, "country", "domestic", "foreign", "provenance")


def unwrapped_url(url: Column, parameter: str = "url") -> Column:
    """The target of a redirecting link, else the link itself."""
    return F.coalesce(T.query_value(url, parameter), url)


def adapter(rows: DataFrame, url: str, adapters: DataFrame, default: str = "generico") -> DataFrame:
    """Rows with the name of the first adapter (by ``ord``) whose domain stands in the url's host.

    Each host is looked up by its own suffixes, an equi-join in place of a containment join.
    """
    parts = F.split("_host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    hosts = rows.select(T.host(F.col(url)).alias("_host")).distinct()
    found = hosts.select("_host", F.explode(suffixes).alias("dominio")).join(bounded_broadcast(adapters), "dominio").groupBy("_host").agg(F.min_by("medio", "ord").alias("adapter"))
    return rows.withColumn("_host", T.host(F.col(url))).join(found, "_host", "left").withColumn("adapter", F.coalesce("adapter", F.lit(default))).drop("_host")


def audience(posts: DataFrame, views: int = 0, interactions: int = 0, likes: int = 0, top: int | None = None) -> DataFrame:
    """Posts at or above the thresholds with their interactions, the most viewed first."""
    n = lambda c: F.coalesce(F.col(c), F.lit(0))
    rows = posts.withColumn("interacciones", n("likes") + n("comentarios") + n("compartidos"))
    rows = rows.where((n("vistas") >= views) & (F.col("interacciones") >= interactions) & (n("likes") >= likes))
    return rows.orderBy(F.desc("vistas"), F.desc("interacciones"), "seq").limit(top) if top else rows


def latest(rows: DataFrame, keys: tuple[str, ...], order: str) -> DataFrame:
    """The last row of each key by ``order``: an aggregate, not a window over whole groups."""
    rest = [c for c in rows.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), order).alias("_r")).select(*keys, "_r.*").select(*rows.columns)


def search_slices(first: str, last: str, days: int, terms: DataFrame) -> DataFrame:
    """(term, start, end): every term with every closed slice of the range; terms are the study's own list."""
    slices = terms.select("term", F.explode(F.sequence(F.to_date(F.lit(first)), F.to_date(F.lit(last)), F.make_interval(days=F.lit(days)))).alias("start"))
    return slices.withColumn("end", F.least(F.date_add("start", days - 1), F.to_date(F.lit(last))))


def search_hits(hits: DataFrame, excluded_hosts: tuple[str, ...], first: Column, last: Column, day: Column, terms: tuple[str, ...]) -> DataFrame:
    """Hits first by source and order for each url, in the range or undated, with a term in the headline or none."""
    ranked = hits.withColumn("_day", day).withColumn("_o", F.struct(F.when(F.col("fuente").startswith("medio:"), 2).when(F.col("fuente") == "google_news", 0).otherwise(1), F.col("resultado_id")))
    rest = [c for c in ranked.columns if c not in ("url", "_o")]
    one = ranked.where(F.coalesce(F.col("url"), F.lit("")) != "").groupBy("url").agg(F.min_by(F.struct(*rest), "_o").alias("_r")).select("url", "_r.*")
    lowered = F.lower(F.coalesce("titular", F.lit("")))
    named = F.trim(lowered) == ""
    for t in terms:
        named = named | lowered.contains(t.lower())
    return one.where(~T.host(F.col("url")).isin(*excluded_hosts) & (F.col("_day").isNull() | F.col("_day").between(first, last)) & named).drop("_day")


def kappa(labels: DataFrame, a: str, b: str) -> DataFrame:
    """(n, agreement, kappa, strength): chance-corrected agreement of two labelings, missing ones left out."""
    pairs = labels.where(F.coalesce(F.col(a), F.lit("")) != "").where(F.coalesce(F.col(b), F.lit("")) != "").groupBy(F.col(a).alias("a"), F.col(b).alias("b")).agg(F.count("*").alias("n"))
    left, right = pairs.groupBy("a").agg(F.sum("n").alias("na")), pairs.groupBy("b").agg(F.sum("n").alias("nb"))
    expected = left.join(right, F.col("a") == F.col("b")).agg(F.coalesce(F.sum(F.col("na").cast("double") * F.col("nb")), F.lit(0.0)).alias("e"))
    totals = pairs.agg(F.sum("n").alias("n"), F.sum(F.when(F.col("a") == F.col("b"), F.col("n")).otherwise(0)).alias("same")).where("n is not null")
    po, pe = F.col("same").cast("double") / F.col("n"), F.col("e") / (F.col("n").cast("double") * F.col("n"))
    k = F.when(pe >= 1, 1.0).otherwise(F.round((po - pe) / (F.lit(1.0) - pe), 3))
    rows = totals.crossJoin(expected).select("n", F.round(po, 3).alias("agreement"), k.alias("kappa"))  # one row each
    bands = F.when(F.col("kappa") < 0, "pobre").when(F.col("kappa") <= 0.2, "leve").when(F.col("kappa") <= 0.4, "aceptable").when(F.col("kappa") <= 0.6, "moderada").when(F.col("kappa") <= 0.8, "sustancial").otherwise("casi perfecta")
    return rows.withColumn("strength", bands)


def seeded_sample(rows: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash of the key: the same rows on every run and layout."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string"))), key).limit(n)


def evolved(stored: DataFrame, wanted: str) -> DataFrame:
    """The stored table with the columns of ``wanted`` (a DDL list) that it lacks, empty; others stay as they are."""
    from pyspark.sql.types import StructType

    missing = [f for f in StructType.fromDDL(wanted).fields if f.name not in stored.columns]
    return stored.select("*", *[F.lit(None).cast(f.dataType).alias(f.name) for f in missing])
