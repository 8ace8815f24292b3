"""Texts cut off by field limits or mid-transfer, by hashed logistic regression on artificial cuts.

Two statistics are counted over all texts: for each word (hashed to a fixed number of buckets) how often it
stands before the end of a text and how often a sentence ends with it there, and for each source (an
outlet under its brand and its domain, or a platform) the lengths at which its texts pile up (field limits). Then intact values of a bounded sample are cut on purpose, at a limit or anywhere, with or
without a mark; a logistic regression on hashed features of the closing (last characters and words, how
sentences end with that word, punctuation and marks, distance to a limit, opening of the last line) is
fitted to tell the cut ones from the intact ones, and every record is scored.

Both statistics and the weights have fixed bounds (buckets, limits found, features), so they are broadcast;
texts are read in place and never shuffled.

Defined results: null, empty and blank texts are not cut; a text that ends in a tag, link, mention, laugh,
picture character or whole site line without a full stop is not cut; ties and repeated rows score alike.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rotativa.llm.arrays import slices
from rotativa.session import bounded_broadcast, cut

#: Buckets of the word statistics and of the hashed features.
WORD_BUCKETS, FEATURE_BUCKETS = 1 << 21, 1 << 16
#: Rows of the training sample (a bound, not a share).
TRAINING_ROWS = 30_000
#: Bytes of the training sample, at most; a sample of very long texts has fewer rows.
TRAINING_BYTES = 64 << 20
#: A length is a limit if at least this many texts have it and it holds this multiple of its neighbours' mean.
LIMIT_TEXTS, LIMIT_RATIO, NEIGHBOURS = 6, 5.0, 15
THRESHOLD = 0.5

MARK = re.compile(r"\s*(?:\[(?:\.\.\.|…)\]|\(\.\.\.\)|(?<![.…])(?:\.\.\.|…))\s*$")
MARK_SQL = r"\s*(?:\[(?:\.\.\.|…)\]|\(\.\.\.\)|(?<![.…])(?:\.\.\.|…))\s*$"
_LAUGH = re.compile(r"^(?:(?:ja|je|ji|ha|he|rs|k){2,}\w?|lol|xd+|jaj\w*)[.!]*$", re.IGNORECASE)
_CODE = re.compile(r"^(?=[0-9a-f.]*\d)(?=\d*[a-f.])[0-9a-f.]{7,}$")
_STOP = frozenset(".!?…\"”»’)]")
_TRIM = "\"'“”«»‘’()[]{}¿¡.,;:!?…—–-*_"


def bucket(word: str) -> int:
    return zlib.crc32(word.strip(_TRIM).lower().encode("utf-8", "surrogatepass")) & (WORD_BUCKETS - 1)


def ends_sentence(token: str) -> bool:
    stripped = token.rstrip("\"”»’)]")
    return stripped[-1:] in (".", "!", "?", "…")


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    uses, ends = np.zeros(WORD_BUCKETS, np.int64), np.zeros(WORD_BUCKETS, np.int64)
    known: dict[str, tuple[int, bool]] = {}
    for batch in batches:
        for part in slices(batch, 0):
            lists = pc.ascii_split_whitespace(pc.utf8_trim_whitespace(pc.fill_null(part.column(0), "")))
            rows = pc.list_parent_indices(lists).to_numpy()
            # a text's last word is left out, as it may be a part of a word
            inner = np.append(rows[1:] == rows[:-1], False) if len(rows) else np.empty(0, bool)
            counts = lists.flatten().filter(pa.array(inner)).value_counts()
            for word, n in zip(counts.field(0).to_pylist(), counts.field(1).to_pylist(), strict=True):
                if (found := known.get(word)) is None:
                    if len(known) > 500_000:
                        known.clear()
                    found = known[word] = (bucket(word), ends_sentence(word))
                uses[found[0]] += n
                ends[found[0]] += n * found[1]
    at = np.flatnonzero(uses)
    yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(uses[at]), pa.array(ends[at])], ["bucket", "uses", "ends"])


def word_counts(texts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(uses, sentence ends) of each word bucket over all texts, their last words left out."""
    rows = texts.select("texto").mapInArrow(_count_words, "bucket int, uses long, ends long").groupBy("bucket").agg(F.sum("uses").alias("uses"), F.sum("ends").alias("ends")).toPandas()
    uses, ends = np.zeros(WORD_BUCKETS, np.int64), np.zeros(WORD_BUCKETS, np.int64)
    uses[rows["bucket"]], ends[rows["bucket"]] = rows["uses"], rows["ends"]
    return uses, ends  # 2 x 16 MB whatever the corpus


def _whole(text: Column) -> Column:
    return F.regexp_replace(text, MARK_SQL, "")


def limits(texts: DataFrame, homes: dict[str, str] | None = None) -> dict[tuple[str, str], set[int]]:
    """Lengths without closing mark at which the texts of a source pile up, by (grupo, source).

    A source that is too small to show a limit by itself has those of its whole group at which its own texts pile up.
    """
    lengths = texts.select("grupo", "fuente", F.length(_whole(F.col("texto"))).alias("n")).where("n > 20").groupBy("grupo", "fuente", "n").agg(F.count("*").alias("texts"))
    names = texts.sparkSession.createDataFrame(sorted((homes or {}).items()), "fuente string, _home string")
    source = F.coalesce("_home", "fuente", F.lit("")).alias("source")
    # one row for each source and length, so the texts are read once for both counts
    own = cut(lengths.join(bounded_broadcast(names), "fuente", "left").groupBy("grupo", source, "n").agg(F.sum("texts").alias("texts")))

    def piled(rows: DataFrame, *key: str) -> DataFrame:
        near = Window.partitionBy(*key).orderBy("n").rangeBetween(-NEIGHBOURS, NEIGHBOURS)
        around = (F.sum("texts").over(near) - F.col("texts")) / (2 * NEIGHBOURS)
        return rows.withColumn("around", around).where(F.col("texts") >= LIMIT_RATIO * (F.col("around") + 0.5))

    pooled = piled(own.groupBy("grupo", "n").agg(F.sum("texts").alias("texts")), "grupo").where(F.col("texts") >= LIMIT_TEXTS).select("grupo", "n", F.lit(True).alias("_pooled"))
    found: dict[tuple[str, str], set[int]] = {}
    for row in piled(own, "grupo", "source").join(pooled, ["grupo", "n"], "left").where((F.col("texts") >= LIMIT_TEXTS) | F.col("_pooled")).collect():
        found.setdefault((row["grupo"], row["source"]), set()).add(row["n"])
    return found


def _kind(token: str) -> str:
    if not token:
        return "none"
    if token.startswith(("http://", "https://", "www.")) or re.match(r"^[\w-]+(\.[\w-]+)+/\S*$", token):
        return "link"
    if token[0] == "#":
        return "tag"
    if token[0] == "@":
        return "mention"
    if _LAUGH.match(token):
        return "laugh"
    last = token[-1]
    if _CODE.match(token):
        return "code"
    if last.isalpha():
        return "letter"
    if last.isdigit():
        return "digit"
    if last in _STOP:
        return "stop" if ends_sentence(token) else "quote"
    if last in ",;:-–—¿¡(«“":
        return "open"
    return "sign"


def features(text: str, grupo: str, bounds: set[int], uses: np.ndarray, ends: np.ndarray) -> list[str]:
    """Names of the binary features of a text's closing."""
    whole = MARK.sub("", text)
    mark = text[len(whole) :].strip()
    whole = whole.rstrip()
    line = whole[whole.rfind("\n") + 1 :]
    tokens = line.split()
    last, before = tokens[-1] if tokens else "", tokens[-2] if len(tokens) > 1 else ""
    kind = _kind(last)
    at_limit = len(text) in bounds or len(MARK.sub("", text)) in bounds
    n, e = int(uses[bucket(last)]), int(ends[bucket(last)])
    known = "0" if n == 0 else "1" if n <= 2 else "2" if n <= 20 else "3"
    rate = e / n if n else 0.0
    ending = "none" if n == 0 else str(min(5, int(rate * 20))) if rate < 0.3 else "high" if rate < 0.8 else "sure"
    stop = next((i for i, t in enumerate(reversed(tokens[:-1])) if ends_sentence(t)), len(tokens))
    since = "0" if stop == 0 else "1-3" if stop < 4 else "4-8" if stop < 9 else "9+"
    whole_line = "one" if stop >= len(tokens) else "several"
    marked = "mark" if mark else "bare"
    loose = "m=spaced" if mark and text[: len(text.rstrip()) - len(mark)].endswith((" ", "\n")) else f"m={marked}"
    upper = "caps" if len(line) > 6 and line == line.upper() else "mixed"
    opening = " ".join(tokens[:2]).lower()
    place = "post" if grupo != "notas" else "note"
    inner = last.strip(_TRIM).lower()
    short = "short" if len(inner) <= 3 else "long"
    f = [
        f"k={kind}",
        f"k={kind}|{marked}",
        f"k={kind}|l={at_limit}",
        f"k={kind}|l={at_limit}|{marked}|{place}",
        f"{loose}|{mark}|k={kind}",
        f"n={known}|k={kind}|{marked}",
        f"n={known}|l={at_limit}|{kind}",
        f"e={ending}|k={kind}|{marked}",
        f"e={ending}|l={at_limit}|{kind}|{place}",
        f"e={ending}|{whole_line}|{kind}",
        f"s={since}|k={kind}|{place}",
        f"{whole_line}|{place}|k={kind}|t={min(len(tokens), 12)}",
        f"w={inner}|{kind}",
        f"b={before.lower()} {inner}",
        f"p={before.strip(_TRIM).lower()}|{kind}|{short}",
        f"x={inner[-2:]}|{kind}",
        f"c={last[-1:]}",
        f"o={opening}|{kind == 'stop'}",
        f"o={opening[:6]}|{place}",
        f"u={upper}|{kind}",
        f"g={grupo}|k={kind}",
        f"up={last[:1].isupper()}|n={known}|e={ending}|{kind}",
        f"up={last[:1].isupper()}|n={known}|{kind}|{place}",
    ]
    return f


def hashed(names: list[str]) -> list[int]:
    return [zlib.crc32(x.encode("utf-8", "surrogatepass")) & (FEATURE_BUCKETS - 1) for x in names]


def cut_text(text: str, bounds: list[int], rng: random.Random) -> str | None:
    """The text cut on purpose inside a word or sentence, at a limit if there is one below its length."""
    below = [b for b in bounds if b < len(text) - 1]
    if below and rng.random() < 0.7:
        at = rng.choice(below)
    elif len(text) > 30:
        at = rng.randrange(15, len(text) - 3)
    else:
        return None
    if at < 10:
        return None
    head = text[:at]
    shown = head.rstrip()
    if not shown or ends_sentence(shown.split()[-1]) and text[at : at + 1] in ("", " ", "\n"):
        return None
    # a cut right at the end of a line is no cut inside a sentence
    if text[at : at + 1] == "\n" or head.endswith("\n"):
        return None
    return head + rng.choice(["", "", "", "…", "...", " [...]"])


def fit(rows: list[tuple[str, str, str]], bounds: dict[tuple[str, str], set[int]], uses: np.ndarray, ends: np.ndarray, epochs: int = 6) -> np.ndarray:
    """Weights of the logistic regression; the last one is the bias."""
    rng = random.Random(7)
    x, y = [], []
    for grupo, source, text in rows:
        own = bounds.get((grupo, source), set())
        bare = MARK.sub("", text)
        sound = ends_sentence(text.rstrip().split()[-1]) and not MARK.search(text)
        if not sound and (len(text) in own or len(bare) in own or MARK.search(text) and not ends_sentence(bare.rstrip()[-1:] or "x")):
            continue  # a true cut, as it seems
        x.append(hashed(features(text, grupo, own, uses, ends)))
        y.append(0.0)
        base = text.rstrip()
        if (made := cut_text(base, sorted(own), rng)) is not None and rng.random() < 0.6:
            x.append(hashed(features(made, grupo, own, uses, ends)))
            y.append(1.0)
    weights = np.zeros(FEATURE_BUCKETS + 1)
    if not x:
        weights[-1] = -20.0
        return weights
    matrix, target = np.array(x), np.array(y)
    grown = np.full(FEATURE_BUCKETS + 1, 1e-6)
    order = np.arange(len(target))
    shuffle = np.random.default_rng(7)
    for _ in range(epochs):
        shuffle.shuffle(order)
        for start in range(0, len(order), 256):
            at = order[start : start + 256]
            score = weights[matrix[at]].sum(axis=1) + weights[-1]
            error = (1 / (1 + np.exp(-np.clip(score, -30, 30))) - target[at]) / len(at)
            gradient = np.bincount(matrix[at].ravel(), np.repeat(error, matrix.shape[1]), FEATURE_BUCKETS + 1)
            gradient[-1] = error.sum()
            gradient += 1e-6 * weights
            grown += gradient * gradient
            weights -= 0.3 * gradient / np.sqrt(grown)
    return weights


def _score(batches: Iterator[pa.RecordBatch], shared: tuple) -> Iterator[pa.RecordBatch]:
    bounds, homes, uses, ends, weights = shared
    none: set[int] = set()
    for batch in batches:
        scores = []
        for grupo, text, source in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
            at = hashed(features(text, grupo, bounds.get((grupo, homes.get(source, source or "")), none), uses, ends))
            scores.append(float(weights[at].sum() + weights[-1]))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(4), pa.array(1 / (1 + np.exp(-np.clip(scores, -30, 30))), pa.float64())], ["tabla", "id", "fuente", "score"])


def text_rows(notes: DataFrame, posts: DataFrame) -> DataFrame:
    """(tabla, id, grupo, texto, fuente) of both tables, blank texts left out."""
    a = notes.select(F.lit("notas").alias("tabla"), F.col("id").cast("long").alias("id"), F.lit("notas").alias("grupo"), F.col("cuerpo").alias("texto"), F.col("medio").alias("fuente"))
    b = posts.select(F.lit("publicaciones").alias("tabla"), F.col("seq").cast("long").alias("id"), F.coalesce("plataforma", F.lit("")).alias("grupo"), "texto", F.col("plataforma").alias("fuente"))
    return a.unionByName(b).where(r"texto rlike '\\S'")


def outlet_homes(outlets: DataFrame | None) -> dict[str, str]:
    """Domain of each outlet's brand, so that both names are one source; outlets are few."""
    if outlets is None:
        return {}
    return {r["medio"]: r["dominio"] for r in outlets.where("medio is not null and dominio is not null").groupBy("medio").agg(F.min("dominio").alias("dominio")).collect()}


def scores(notes: DataFrame, posts: DataFrame, training_rows: int = TRAINING_ROWS, outlets: DataFrame | None = None) -> DataFrame:
    """(tabla, id, fuente, score) of every text that is not blank; ``outlets(medio, dominio)`` joins an outlet's names."""
    texts = text_rows(notes, posts)
    homes = outlet_homes(outlets)
    uses, ends = word_counts(texts)
    bounds = limits(texts, homes)
    half = training_rows // 2
    rows = []
    for tabla, source in (("notas", notes), ("publicaciones", posts)):
        part = texts.where(F.col("tabla") == tabla)
        # thinned to half as much again as the sample first, so that few rows are ordered and sent; the count comes from the files' footers
        share = min(1.0, 1.5 * half / max(1, source.count()))
        chosen = part.select("grupo", "fuente", "texto", F.xxhash64("id", "texto").alias("h")).where(F.pmod("h", F.lit(1 << 20)) < F.lit(int(share * (1 << 20))))
        chosen = chosen.orderBy("h", "texto").limit(half)
        held = F.sum(F.octet_length("texto")).over(Window.orderBy("h", "texto"))  # at most ``half`` rows
        chosen = chosen.withColumn("held", held).where(F.col("held") <= TRAINING_BYTES // 2)
        rows += [(r["grupo"], homes.get(r["fuente"], r["fuente"] or ""), r["texto"]) for r in chosen.select("grupo", "fuente", "texto").collect()]
    weights = fit(rows, bounds, uses, ends)
    shared = notes.sparkSession.sparkContext.broadcast((bounds, homes, uses, ends, weights))
    return texts.mapInArrow(lambda b: _score(b, shared.value), "tabla string, id long, fuente string, score double")


def truncated(notes: DataFrame, posts: DataFrame, threshold: float = THRESHOLD, outlets: DataFrame | None = None) -> DataFrame:
    """(tabla, id): the texts whose end was lost."""
    return scores(notes, posts, outlets=outlets).where(F.col("score") > threshold).select("tabla", "id").distinct()


def rates(notes: DataFrame, posts: DataFrame, threshold: float = THRESHOLD, outlets: DataFrame | None = None) -> DataFrame:
    """(tabla, fuente, textos, cortados, cuota): how often each source truncates; blank texts do not count."""
    lost = (F.col("score") > threshold).cast("long")
    grouped = scores(notes, posts, outlets=outlets).groupBy("tabla", "fuente").agg(F.count("*").alias("textos"), F.sum(lost).alias("cortados"))
    return grouped.withColumn("cuota", F.round(F.col("cortados") / F.col("textos"), 6))
