"""Lexicon-based signals of a text: polarity, tone towards actors, emotions, frames, subjectivity, intensity.

All are column expressions over the token array, so that a corpus is annotated in one scan without
shuffle; corpus figures are grouped sums after it. Lexicons are parameters.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotativa.functions import text as T


@dataclass(frozen=True)
class Lexicon:
    """Word lists of one study."""

    positive: tuple[str, ...] = ()
    negative: tuple[str, ...] = ()
    negators: tuple[str, ...] = ()
    emotions: dict[str, tuple[str, ...]] = field(default_factory=dict)
    frames: dict[str, tuple[str, ...]] = field(default_factory=dict)
    subjective: tuple[str, ...] = ()
    factual: tuple[str, ...] = ()
    groups: dict[str, tuple[str, ...]] = field(default_factory=dict)
    #: Tokens before a word in which a negator turns its sign.
    reach: int = 3
    threshold: float = 0.15


def signs(tokens: Column, lexicon: Lexicon) -> Column:
    """+1, -1 or 0 of each token, turned by a negator among the tokens before it."""

    def sign(x: Column, i: Column) -> Column:
        start = F.greatest(i - lexicon.reach, F.lit(0))
        turned = F.exists(F.slice(tokens, start + 1, i - start), lambda t: t.isin(*lexicon.negators)) if lexicon.negators else F.lit(False)
        base = F.when(x.isin(*lexicon.positive), 1).when(x.isin(*lexicon.negative), -1).otherwise(0)
        return F.when(base == 0, 0).otherwise(F.when(turned, -base).otherwise(base))

    return F.transform(tokens, sign)


def polarity(tokens: Column, lexicon: Lexicon) -> Column:
    """Struct(positive, negative, score, intensity, label); the score is (p - n) / (p + n)."""

    def sizes(t: Column) -> Column:
        signed = signs(t, lexicon)
        return T.let(signed, lambda s: F.struct(F.size(F.filter(s, lambda x: x > 0)).alias("p"), F.size(F.filter(s, lambda x: x < 0)).alias("n"), F.size(t).alias("size")))

    def score(c: Column) -> Column:
        p, n = c["p"], c["n"]
        value = F.when(p + n > 0, F.round((p - n).cast("double") / (p + n), 3)).otherwise(0.0)
        intensity = F.round((p + n).cast("double") * 100.0 / F.greatest(c["size"], F.lit(1)), 2)
        return F.struct(p.alias("positive"), n.alias("negative"), value.alias("score"), intensity.alias("intensity"))

    def label(c: Column) -> Column:
        name = F.when(c["score"] > lexicon.threshold, "positivo").when(c["score"] < -lexicon.threshold, "negativo").otherwise("neutro")
        return F.struct(c["positive"].alias("positive"), c["negative"].alias("negative"), c["score"].alias("score"), c["intensity"].alias("intensity"), name.alias("label"))

    # each step is bound once; written out, the expression would evaluate the signs a dozen times
    return T.let(tokens, lambda t: T.let(sizes(t), lambda c: T.let(score(c), label)))


def polarity_of(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, positive, negative, score, intensity, label) of each document."""
    held = documents.select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    return held.select("doc_id", polarity(F.col("tokens"), lexicon).alias("p")).select("doc_id", "p.*")


def polarity_towards(documents: DataFrame, actors: dict[str, str], lexicon: Lexicon, window: int = 25, *extra: str) -> DataFrame:
    """(doc_id, actor, mentions, score, label): polarity of the words around each mention, put together.

    The window takes ``window`` tokens before a mention and as many from it on; windows that overlap count twice.
    """
    held = documents.select("doc_id", *extra, T.runs(F.col("text")).alias("tokens"))
    per_actor = F.array(*[F.struct(F.lit(a).alias("actor"), F.lit(k).alias("key")) for a, k in actors.items()])
    rows = held.where(F.exists("tokens", lambda t: t.isin(*actors.values()))).select("doc_id", *extra, "tokens", F.explode(per_actor).alias("a")).select("doc_id", *extra, "tokens", "a.actor", "a.key")
    places = F.filter(F.transform("tokens", lambda x, i: F.when(x == F.col("key"), i + 1)), lambda i: i.isNotNull())
    rows = rows.withColumn("places", places).where(F.size("places") > 0)
    near = F.flatten(F.transform("places", lambda p: F.slice("tokens", F.greatest(p - window, F.lit(1)), F.least(F.size("tokens"), p + window - 1) - F.greatest(p - window, F.lit(1)) + 1)))
    near = F.filter(near, lambda x: x.rlike(T.WORD))
    scored = rows.withColumn("near", near).select("doc_id", *extra, "actor", F.size("places").alias("mentions"), polarity(F.col("near"), lexicon).alias("p"))
    return scored.select("doc_id", *extra, "actor", "mentions", "p.score", "p.label")


def outlet_bias(documents: DataFrame, actors: dict[str, str], lexicon: Lexicon, window: int = 25, least: float = 0.1) -> DataFrame:
    """(source, n_a, tone_a, n_b, tone_b, bias, favours): mean tone towards two actors by outlet."""
    scored = polarity_towards(documents, actors, lexicon, window, "source")
    a, b = list(actors)[:2]
    stats = [x for name, k in ((a, "a"), (b, "b")) for x in (F.sum(F.when(F.col("actor") == name, 1).otherwise(0)).alias(f"n_{k}"), F.round(F.avg(F.when(F.col("actor") == name, F.col("score"))), 3).alias(f"tone_{k}"))]
    grouped = scored.groupBy("source").agg(*stats)
    bias = F.round(F.col("tone_a") - F.col("tone_b"), 3)
    return grouped.withColumn("bias", bias).withColumn("favours", F.when(F.col("bias") >= least, a).when(F.col("bias") <= -least, b))


def counts(tokens: Column, lists: dict[str, tuple[str, ...]]) -> list[Column]:
    def held(w: tuple[str, ...]) -> Column:
        return F.size(F.filter(tokens, lambda x: x.isin(*w)))

    return [held(w).alias(k) for k, w in lists.items()]


def dominant(names: list[str]) -> Column:
    """Name of the greatest of the columns; ties go to the first, none above zero gives null."""
    top = F.greatest(*[F.col(f"`{n}`") for n in names]) if len(names) > 1 else F.col(f"`{names[0]}`")
    return F.when(top > 0, F.coalesce(*[F.when(F.col(f"`{n}`") == top, F.lit(n)) for n in names]))


def emotions(documents: DataFrame, lexicon: Lexicon, *extra: str) -> DataFrame:
    """(doc_id, one count for each emotion, hits, dominant, subjectivity, discourse)."""
    names = list(lexicon.emotions)
    held = documents.select("doc_id", *extra, T.tokens(F.col("text"), 3).alias("tokens"))
    rows = held.select("doc_id", *extra, *counts(F.col("tokens"), lexicon.emotions | {"_s": lexicon.subjective, "_f": lexicon.factual}))
    subjectivity = F.round(F.col("_s").cast("double") / (F.col("_s") + F.col("_f") + 1), 3)
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    out = rows.withColumn("hits", total).withColumn("dominant", dominant(names)).withColumn("subjectivity", subjectivity)
    return out.withColumn("discourse", T.labelled(F.col("subjectivity"), 0.6, 0.3, ("subjetivo", "mixto", "factual"))).drop("_s", "_f")


def sentence_subjectivity(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, sentences, subjective, share): sentences longer than twenty characters with a subjective word."""
    sentences = F.filter(F.transform(F.split(F.coalesce("text", F.lit("")), "[.!?]+"), lambda s: F.trim(s)), lambda s: F.length(s) > 20)
    hit = F.filter("sentences", lambda s: F.arrays_overlap(T.tokens(s, 3), F.array(*[F.lit(w) for w in lexicon.subjective])))
    rows = documents.select("doc_id", sentences.alias("sentences")).select("doc_id", F.size("sentences").alias("sentences"), F.size(hit).alias("subjective"))
    return rows.withColumn("share", F.round(F.col("subjective").cast("double") / F.greatest("sentences", F.lit(1)), 3))


def intensity(documents: DataFrame, absolutes: tuple[str, ...]) -> DataFrame:
    """(doc_id, superlatives, exclamations, absolutes, repeated, score); the score is at most one."""
    held = documents.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), T.tokens(F.col("text")).alias("tokens"))
    rows = held.select(
        "doc_id",
        F.size(F.filter("tokens", lambda x: x.rlike("^[a-záéíóúüñ]+ísim[oa]s?$"))).alias("superlatives"),
        F.regexp_count("text", F.lit("!")).alias("exclamations"),
        F.size(F.filter("tokens", lambda x: x.isin(*absolutes))).alias("absolutes"),
        F.col("text").rlike(r"[!?]{2,}").alias("repeated"),
    )
    score = F.least(F.lit(1.0), F.lit(0.1) * F.least("superlatives", F.lit(5)) + F.lit(0.05) * F.least("exclamations", F.lit(5)) + F.lit(0.08) * F.least("absolutes", F.lit(5)) + F.when(F.col("repeated"), 0.15).otherwise(0.0))
    return rows.withColumn("score", F.round(score, 3))


def frames(documents: DataFrame, lexicon: Lexicon, *extra: str) -> DataFrame:
    """(doc_id, one count for each frame, total, frame): words that begin with a frame's markers."""
    names = list(lexicon.frames)
    held = documents.select("doc_id", *extra, T.runs(F.col("text")).alias("tokens"))

    def begun(markers: tuple[str, ...]) -> Column:
        return F.size(F.filter("tokens", lambda x: x.rlike("^(?:" + "|".join(map(T.quoted, markers)) + ")")))

    found = [begun(m).alias(n) for n, m in lexicon.frames.items()]
    rows = held.select("doc_id", *extra, *found)
    return rows.withColumn("total", sum((F.col(n) for n in names[1:]), F.col(names[0]))).withColumn("frame", dominant(names))


def outlet_frames(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(source, one count for each dominant frame): a pivot over the known frames."""
    return frames(documents, lexicon, "source").where("frame is not null").groupBy("source").pivot("frame", list(lexicon.frames)).count().na.fill(0)


def intergroup(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(doc_id, one count for each word group, density): hits for each hundred tokens."""
    held = documents.select("doc_id", T.tokens(F.col("text")).alias("tokens"))
    names = list(lexicon.groups)
    rows = held.select("doc_id", F.size("tokens").alias("_n"), *counts(F.col("tokens"), lexicon.groups))
    total = sum((F.col(n) for n in names[1:]), F.col(names[0]))
    return rows.withColumn("density", F.round(total.cast("double") * 100.0 / F.greatest("_n", F.lit(1)), 2)).drop("_n")


def affective_polarization(documents: DataFrame, lexicon: Lexicon) -> DataFrame:
    """(source, positive, negative, neutral, index): share of signed documents times their balance."""
    labels = documents.select("source", polarity(T.tokens(F.col("text")), lexicon)["label"].alias("label"))
    n = lambda x: F.sum(F.when(F.col("label") == x, 1).otherwise(0))
    rows = labels.groupBy("source").agg(n("positivo").alias("positive"), n("negativo").alias("negative"), n("neutro").alias("neutral"))
    signed = (F.col("positive") + F.col("negative")).cast("double")
    index = F.when(signed > 0, (signed / (signed + F.col("neutral"))) * (F.lit(1.0) - F.abs(F.col("positive") - F.col("negative")) / signed)).otherwise(0.0)
    return rows.withColumn("index", F.round(index, 3))


def tone_slope(series: DataFrame, group: str, period: str, value: str, rise: float = 0.5) -> DataFrame:
    """(group, periods, slope, trend): least-squares slope over the index of the period."""
    from pyspark.sql import Window

    indexed = series.withColumn("_i", (F.row_number().over(Window.partitionBy(group).orderBy(period)) - 1).cast("double"))
    rows = indexed.groupBy(group).agg(F.count("*").alias("periods"), F.round(F.regr_slope(F.col(value).cast("double"), F.col("_i")), 4).alias("slope"))
    return rows.withColumn("trend", F.when(F.col("slope") > rise, "sube").when(F.col("slope") < -rise, "baja").otherwise("estable"))


def distribution(rows: DataFrame, group: str, label: str) -> DataFrame:
    """(group, label, n, pct): share of each label within its group, in per cent."""
    counted = rows.where(F.col(label).isNotNull()).groupBy(group, label).agg(F.count("*").alias("n"))
    totals = counted.groupBy(group).agg(F.sum("n").alias("_t")).withColumnRenamed(group, "_g")
    joined = counted.join(totals, F.col(group).eqNullSafe(F.col("_g")))
    return joined.select(group, label, "n", F.round(F.col("n").cast("double") * 100.0 / F.col("_t"), 1).alias("pct"))


def compared(rows: DataFrame, group: str, label: str, a: str, b: str) -> DataFrame:
    """(label, pct_a, pct_b, delta): the label shares of two groups side by side; a label missing in one has 0."""
    shares = distribution(rows.where(F.col(group).isin(a, b)), group, label)
    pct = lambda x: F.coalesce(F.max(F.when(F.col(group) == x, F.col("pct"))), F.lit(0.0))
    return shares.groupBy(label).agg(pct(a).alias("pct_a"), pct(b).alias("pct_b")).withColumn("delta", F.round(F.col("pct_b") - F.col("pct_a"), 1))


def stored_annotations(notes: DataFrame, key: str, column: str, schema: str) -> DataFrame:
    """(key, fields of the stored JSON); rows without it or with a malformed one are left out."""
    return notes.where(F.col(column).isNotNull()).select(key, F.from_json(column, schema).alias("_j")).where("_j is not null").select(key, "_j.*")


def charged_words(documents: DataFrame, actors: dict[str, str], lexicon: Lexicon, window: int = 4) -> DataFrame:
    """(actor, word, charge, n): charged words within ``window`` tokens of an actor, gathered inside the token array."""
    words = [*lexicon.positive, *lexicon.negative]
    empty = F.array().cast("array<string>")
    tokens = documents.select("doc_id", T.tokens(F.col("text")).alias("t"))

    def near(token: str) -> Column:
        def around(x: Column, i: Column) -> Column:
            start = F.greatest(i - window + 1, F.lit(1))
            held = F.concat(F.slice("t", start, i + 1 - start), F.when(i + 1 < F.size("t"), F.slice("t", i + 2, F.lit(window))).otherwise(empty))
            return F.when(x == token, F.filter(held, lambda y: y.isin(*words))).otherwise(empty)

        return F.flatten(F.transform("t", around))

    spread = F.array(*[F.struct(F.lit(a).alias("actor"), near(t).alias("w")) for a, t in actors.items()])
    rows = tokens.where(F.arrays_overlap("t", F.array(*[F.lit(t) for t in actors.values()]))).select(F.explode(spread).alias("s")).select("s.actor", F.explode("s.w").alias("word"))
    charge = F.when(F.col("word").isin(*lexicon.positive), 1).otherwise(-1)
    return rows.groupBy("actor", "word").agg(F.count("*").alias("n")).select("actor", "word", charge.alias("charge"), "n")
