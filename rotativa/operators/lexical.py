"""Term statistics of a corpus: frequencies, n-grams, collocates, networks, concordances, dispersion.

Every operator takes ``documents(doc_id, text)``. Tokens are made once per operator by
built-in expressions; counts are partial sums before the shuffle; windows of neighbours are taken inside
the document's array, so no document is joined with another and no position table is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotativa.functions import text as T


def token_table(documents: DataFrame, stopwords: tuple[str, ...] = (), least: int = 3, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, tokens) with stopwords removed."""
    kept = T.tokens(F.col(text), least)
    if stopwords:
        kept = F.filter(kept, lambda x: ~x.isin(*stopwords))
    return documents.select(key, kept.alias("tokens"))


def term_frequencies(documents: DataFrame, stopwords: tuple[str, ...] = (), top: int | None = None) -> DataFrame:
    """(term, tf, df): uses and documents of each term, the most used first, ties by term."""
    counted = token_table(documents, stopwords).select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    table = counted.groupBy("term").agg(F.sum("n").alias("tf"), F.count("*").alias("df"))
    return table.orderBy(F.desc("tf"), "term").limit(top) if top else table


def document_terms(documents: DataFrame, stopwords: tuple[str, ...] = (), top: int = 5) -> DataFrame:
    """(doc_id, term, n, rank): the most used terms of each document."""
    counted = token_table(documents, stopwords).select("doc_id", F.explode("tokens").alias("term")).groupBy("doc_id", "term").agg(F.count("*").alias("n"))
    order = Window.partitionBy("doc_id").orderBy(F.desc("n"), "term")
    return counted.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)


def ngram_frequencies(documents: DataFrame, n: int = 2, stopwords: tuple[str, ...] = (), least: int = 2, top: int | None = None) -> DataFrame:
    """(ngram, n): n-grams inside one document; the top is taken first, then the least frequency."""
    grams = token_table(documents, stopwords).select(F.explode(T.ngrams(F.col("tokens"), n)).alias("ngram")).groupBy("ngram").agg(F.count("*").alias("n"))
    grams = grams.orderBy(F.desc("n"), "ngram").limit(top) if top else grams
    return grams.where(F.col("n") >= least)


def _neighbours(tokens: Column, at: Column, window: int) -> Column:
    """The tokens within ``window`` places of place ``at`` (from 1), without that place."""
    before = F.slice(tokens, F.greatest(at - window, F.lit(1)), at - F.greatest(at - window, F.lit(1)))
    after = F.when(at < F.size(tokens), F.slice(tokens, at + 1, F.lit(window))).otherwise(F.array().cast("array<string>"))
    return F.concat(before, after)


def neighbour_counts(documents: DataFrame, word: str, window: int = 5, stopwords: tuple[str, ...] = ()) -> DataFrame:
    """(term, freq): how often each term stands within ``window`` places of the word; the stream keeps stopwords."""
    held = token_table(documents).where(F.array_contains("tokens", word))
    # neighbours are gathered inside the array, so that no row carries a document's tokens again
    around = F.flatten(F.transform("tokens", lambda x, i: F.when(x == word, _neighbours(F.col("tokens"), i + 1, window)).otherwise(F.array().cast("array<string>"))))
    near = held.select(F.explode(F.filter(around, lambda x: ~x.isin(word, *stopwords))).alias("term"))
    return near.groupBy("term").agg(F.count("*").alias("freq"))


def collocates(documents: DataFrame, word: str, window: int = 5, stopwords: tuple[str, ...] = (), top: int = 30) -> DataFrame:
    """(term, freq, pmi): the most frequent neighbours, of which the most closely bound are kept.

    pmi = log2((freq / windows) / (P(term) P(word) + 1e-10) + 1e-10), rounded to three places.
    """
    near = neighbour_counts(documents, word, window, stopwords)
    near = near.orderBy(F.desc("freq"), "term").limit(3 * top)
    counted = token_table(documents, stopwords).select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("tf"))
    totals = counted.agg(F.sum("tf").alias("total"), F.coalesce(F.max(F.when(F.col("term") == word, F.col("tf"))), F.lit(1)).alias("of_word"))
    windows = token_table(documents).agg(F.sum(F.size(F.filter("tokens", lambda x: x == word))).alias("windows"))
    joined = near.join(counted, "term", "left").crossJoin(F.broadcast(totals)).crossJoin(F.broadcast(windows))  # one row each
    share = (F.coalesce("tf", F.lit(1)).cast("double") / F.col("total")) * (F.col("of_word").cast("double") / F.col("total"))
    pmi = F.log2((F.col("freq").cast("double") / F.col("windows")) / (share + F.lit(1e-10)) + F.lit(1e-10))
    return joined.select("term", "freq", F.round(pmi, 3).alias("pmi")).orderBy(F.desc("pmi"), "term").limit(top)


def lexical_network(documents: DataFrame, window: int = 5, stopwords: tuple[str, ...] = (), top_nodes: int = 40, least: int = 2) -> DataFrame:
    """(source, target, weight): ordered pairs of terms within the window, each adjacency counted from both ends."""
    held = token_table(documents, stopwords)
    counted = held.select(F.explode("tokens").alias("term")).groupBy("term").agg(F.count("*").alias("n"))
    top = [r["term"] for r in counted.orderBy(F.desc("n"), "term").limit(top_nodes).collect()]  # ``top_nodes`` words
    # pairs are made inside the array, both ends cut to the top terms before anything is spread out
    among = lambda i: F.filter(_neighbours(F.col("tokens"), i + 1, window), lambda y: y.isin(*top))
    pair = "array<struct<source:string,target:string>>"
    made = F.flatten(F.transform("tokens", lambda x, i: F.when(x.isin(*top), F.transform(among(i), lambda y: F.struct(F.least(x, y).alias("source"), F.greatest(x, y).alias("target")))).otherwise(F.array().cast(pair))))
    pairs = held.select(F.explode(made).alias("p")).select("p.source", "p.target")
    return pairs.groupBy("source", "target").agg(F.count("*").alias("weight")).where(F.col("weight") >= least)


def concordance(documents: DataFrame, literal: str, width: int = 60) -> DataFrame:
    """(doc_id, at, left, match, right): every literal occurrence, case ignored, with its context on one line."""
    lowered = F.lower(F.coalesce("text", F.lit("")))
    found = documents.where(lowered.contains(literal)).select("doc_id", "text", F.explode(T.occurrences(lowered, literal)).alias("at"))
    flat = lambda x: F.trim(F.regexp_replace(x, r"[\r\n]+", " "))
    left = F.substring(F.col("text"), F.greatest(F.col("at") - width, F.lit(0)) + 1, F.least(F.col("at"), F.lit(width)))
    return found.select("doc_id", "at", flat(left).alias("left"), F.substring(F.col("text"), F.col("at") + 1, F.lit(len(literal))).alias("match"), flat(F.substring(F.col("text"), F.col("at") + len(literal) + 1, F.lit(width))).alias("right"))


def dispersion(documents: DataFrame, literals: list[str]) -> DataFrame:
    """(literal, doc_id, at, position): relative place of each occurrence in the texts joined in key order.

    The running offset is a prefix sum in three steps: texts are cut to ranges of the key and these to wider ones,
    whose lengths are summed first, so no single task orders the whole corpus.
    """
    sized = documents.select("doc_id", F.lower(F.coalesce("text", F.lit(""))).alias("low")).withColumn("size", F.length("low") + 1).withColumn("block", F.floor(F.col("doc_id") / 1000))
    blocks = sized.groupBy("block").agg(F.sum("size").alias("block_size"))
    # blocks of blocks keep the one ordered list short: a row for each million keys
    blocks = blocks.withColumn("outer", F.floor(F.col("block") / 1000))
    outers = blocks.groupBy("outer").agg(F.sum("block_size").alias("outer_size"))
    earlier = F.sum("outer_size").over(Window.orderBy("outer").rowsBetween(Window.unboundedPreceding, -1))
    outers = outers.select("outer", F.coalesce(earlier, F.lit(0)).alias("outer_start"), F.sum("outer_size").over(Window.partitionBy(F.lit(1))).alias("total"))
    before = F.sum("block_size").over(Window.partitionBy("outer").orderBy("block").rowsBetween(Window.unboundedPreceding, -1))
    starts = blocks.withColumn("inner_start", F.coalesce(before, F.lit(0))).join(outers, "outer").select("block", (F.col("outer_start") + F.col("inner_start")).alias("block_start"), "total")
    inside = F.sum("size").over(Window.partitionBy("block").orderBy("doc_id").rowsBetween(Window.unboundedPreceding, -1))
    placed = sized.withColumn("inside", F.coalesce(inside, F.lit(0))).join(starts, "block")
    spread = F.array(*[F.struct(F.lit(x).alias("literal"), T.occurrences(F.col("low"), x).alias("places")) for x in literals])
    rows = placed.select("doc_id", "inside", "block_start", "total", F.explode(spread).alias("o")).select("doc_id", "inside", "block_start", "total", "o.literal", F.explode("o.places").alias("at"))
    return rows.select("literal", "doc_id", "at", F.round((F.col("block_start") + F.col("inside") + F.col("at")).cast("double") / F.greatest(F.col("total") - 1, F.lit(1)), 6).alias("position"))


def term_months(documents: DataFrame, literals: list[str], date: str = "fecha") -> DataFrame:
    """(literal, month, n): literal occurrences by month of the document."""
    low = F.lower(F.coalesce("text", F.lit("")))
    spread = F.array(*[F.struct(F.lit(x).alias("literal"), F.regexp_count(low, F.lit(T.quoted(x))).alias("n")) for x in literals])
    rows = documents.where(F.col(date).isNotNull()).select(F.date_format(date, "yyyy-MM").alias("month"), F.explode(spread).alias("o"))
    return rows.groupBy("o.literal", "month").agg(F.sum("o.n").alias("n"))
