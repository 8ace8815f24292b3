"""Text decoded with the wrong character encoding: detection by EM, repair by posterior.

A latent chain says how a field was garbled: nothing, written in encoding E and read in encoding D (once or
twice), or letters lost to a replacement sign. The evidence of a record is the gain in log-likelihood of its
words when they are read back through a chain, under a model of characters in context counted over the whole
corpus. Expectation-maximisation learns for each source and field how frequent each chain is, so that weak
evidence of one record is pooled with the others of its source and field; the posterior decides, and the
most probable chain repairs each record word by word.

The character model (kinds of neighbours x character) and the chain shares (sources x fields x chains) are
bounded by the alphabet and the number of sources, not by the rows. Texts are read twice in place and never
shuffled; only records with evidence enter the EM.

Defined results: null, empty and plain ASCII fields without lost letters are clean; a partly garbled field
counts; words that no chain makes more probable stay as they are; lost letters stay lost.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotativa.llm.arrays import slices
from rotativa.llm.residue import fields
from rotativa.session import bounded_broadcast, cut

#: (written, read) pairs; several pairs are applied one after the other.
CHAINS: tuple[tuple[tuple[str, str], ...], ...] = (
    (("utf-8", "cp1252"),),
    (("utf-8", "cp1252"), ("utf-8", "cp1252")),
    (("utf-8", "mac_roman"),),
    (("utf-8", "cp850"),),
    (("utf-8", "cp437"),),
    (("utf-8", "gb18030"),),
    (("utf-8", "cp1251"),),
    (("utf-8", "cp1250"),),
    (("utf-8", "iso8859_15"),),
    (("utf-8", "iso8859_2"),),
    (("utf-8", "koi8_r"),),
    (("utf-8", "big5"),),
    (("utf-8", "shift_jis"),),
    (("cp1252", "mac_roman"),),
    (("cp1252", "cp850"),),
    (("cp1252", "cp437"),),
    (("cp1252", "cp1251"),),
    (("cp1252", "cp1250"),),
    (("cp1252", "iso8859_7"),),
    (("mac_roman", "cp1252"),),
    (("cp850", "cp1252"),),
    (("cp437", "cp1252"),),
    (("utf-8", "cp1252"), ("utf-8", "cp1252"), ("utf-8", "cp1252")),
)
LOST = len(CHAINS)
#: Nats that a valid multi-byte sequence adds: other signs form one by chance only.
STRUCTURE = 3.0
ROUNDS = 4
#: Weight of the shares over all sources in the shares of one.
POOL = 50.0
#: Evidence in nats of a lost letter: a replacement sign, and a question mark inside a word.
SIGN_GAIN, MARK_GAIN = 14.0, 8.0
#: Signs that stand in sound text next to letters.
TYPOGRAPHIC = frozenset("\u00a0\u00ad\u2010\u2011\u2012\u2013\u2014\u2015\u2018\u2019\u201a\u201c\u201d\u201e\u2026\u00ab\u00bb\u2022\u20ac\u00a9\u00ae\u2122")
BOUNDARY, LOWER, UPPER, DIGIT, OTHER = range(5)


@lru_cache(maxsize=64)
def _bytes_of(codec: str) -> dict[str, int]:
    """Character to byte of a single-byte encoding; bytes without a character stand for themselves."""
    table = {}
    for b in range(256):
        char = bytes([b]).decode(codec, "replace")
        table[chr(b) if char == "�" else char] = b
    for b in range(0x80, 0xA0):
        table.setdefault(chr(b), b)
    return table


def _unread(word: str, written: str, read: str) -> str | None:
    """The word as it was before it was written in one encoding and read in another; None if that fails."""
    if read in ("gb18030", "big5", "shift_jis"):
        try:
            return word.encode(read).decode(written)
        except UnicodeError:
            return None
    table = _bytes_of(read)
    out, run = [], bytearray()

    def flush() -> bool:
        if run:
            try:
                out.append(run.decode(written))
            except UnicodeError:
                return False
            run.clear()
        return True

    for char in word:
        b = table.get(char)
        if char < "\x80" or b is None or b < 0x80:
            if not flush():
                return None
            out.append(char)
        else:
            run.append(b)
    return "".join(out) if flush() else None


def unread(word: str, chain: int) -> str | None:
    for written, read in reversed(CHAINS[chain]):
        word = _unread(word, written, read)
        if word is None:
            return None
    return word


@lru_cache(maxsize=65536)
def _kind(char: str) -> int:
    if char == " ":
        return BOUNDARY
    if char.isdigit():
        return DIGIT
    if char.isalpha():
        return UPPER if char != char.lower() else LOWER
    return OTHER


def contexts(word: str) -> list[tuple[int, str, int]]:
    """(kind before, character, kind after) of each character beyond ASCII."""
    wide = f" {word} "
    return [(_kind(wide[i - 1]), c, _kind(wide[i + 1])) for i, c in enumerate(wide) if c >= "\x80"]


def _words(column: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(distinct words with a character beyond ASCII or a question mark, word of each use, row of each use)."""
    parts = pc.ascii_split_whitespace(pc.fill_null(column, ""))
    rows = pc.list_parent_indices(parts).to_numpy()
    coded = parts.flatten().dictionary_encode()
    distinct = coded.dictionary
    odd = pc.match_substring_regex(distinct, r"[^\x00-\x7f]|\?").to_numpy(zero_copy_only=False)
    which = coded.indices.to_numpy()
    uses = odd[which]
    new = np.cumsum(odd) - 1
    return distinct.filter(pa.array(odd)).to_pylist(), new[which[uses]], rows[uses]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: Counter = Counter()
    for batch in batches:
        for part in slices(batch, 2):
            words, which, _ = _words(part.column(2))
            for word, n in zip(words, np.bincount(which, minlength=len(words)).tolist(), strict=True):
                for context in contexts(word):
                    total[context] += n
    if total:
        before, char, after = zip(*total, strict=True)
        yield pa.RecordBatch.from_arrays([pa.array(before, pa.int32()), pa.array(char), pa.array(after, pa.int32()), pa.array(list(total.values()), pa.int64())], ["before", "char", "after", "n"])


class Model:
    """Log-probability of characters in context, with an alphabet-wide floor."""

    def __init__(self, counts: dict[tuple[int, str, int], int]) -> None:
        self.total = sum(counts.values()) + 1
        by_char: Counter = Counter()
        for (_, char, _), n in counts.items():
            by_char[char] += n
        self.counts, self.by_char = counts, by_char
        self.cache: dict[str, dict[int, float]] = {}

    def logp(self, word: str) -> float:
        # half a use in context is lent by the character's use anywhere
        return sum(math.log((self.counts.get(c, 0) + 0.02 * self.by_char.get(c[1], 0) / 25 + 0.01) / self.total) for c in contexts(word))

    def gains(self, word: str) -> dict[int, float]:
        """Gain of each chain that makes the word more probable."""
        if word in self.cache:
            return self.cache[word]
        found = {}
        if not word.isascii():
            base = self.logp(word)
            for chain in range(len(CHAINS)):
                back = unread(word, chain)
                if back is not None and back != word and "�" not in back and back.isprintable() and sound(word, back, chain) and (gain := self.logp(back) - base) > 0:
                    found[chain] = gain + STRUCTURE * (CHAINS[chain][0][0] == "utf-8")
        lost = word.count("�") * SIGN_GAIN + marks(word) * MARK_GAIN
        if lost:
            found[LOST] = lost
        if len(self.cache) > 500_000:
            self.cache.clear()
        self.cache[word] = found
        return found


def sound(word: str, back: str, chain: int) -> bool:
    """Whether a reading may count. Chains that swap single characters must give a letter of the common Latin blocks where no typographic sign stands."""
    if CHAINS[chain][0][0] == "utf-8":
        return True
    wide = f" {word} "
    return any(b.isalpha() and b < "\u0180" and a not in TYPOGRAPHIC and (a.isalpha() or wide[i].isalpha() or wide[i + 2].isalpha()) for i, (a, b) in enumerate(zip(word, back, strict=True)) if a != b)


def marks(word: str) -> int:
    """Question marks that stand where a letter was: between letters, and not in an address."""
    if "?" not in word or "/" in word or "=" in word or "&" in word:
        return 0
    return sum(1 for i in range(1, len(word) - 1) if word[i] == "?" and word[i - 1].isalpha() and word[i + 1].isalpha() and word[i + 1].islower())


def _evidence(batches: Iterator[pa.RecordBatch], counts: list) -> Iterator[pa.RecordBatch]:
    model = Model(dict(counts))
    for batch in batches:
        for part in slices(batch, 2):
            words, which, rows = _words(part.column(2))
            gains = [model.gains(w) for w in words]
            good = np.array([bool(g) for g in gains], bool)
            hit = np.flatnonzero(good[which]) if len(which) else []
            table: dict[int, np.ndarray] = {}
            for at in hit:
                row = table.setdefault(int(rows[at]), np.zeros(LOST + 1))
                for chain, gain in gains[which[at]].items():
                    row[chain] += gain
            if table:
                at = pa.array(list(table))
                yield pa.RecordBatch.from_arrays([part.column(0).take(at), part.column(1).take(at), part.column(3).take(at), pa.array([v.tolist() for v in table.values()], pa.list_(pa.float64()))], ["key", "campo", "source", "gain"])


def character_counts(texts: DataFrame) -> list[tuple[tuple[int, str, int], int]]:
    """Uses of each character in context over all texts; bounded by 25 contexts x the alphabet."""
    counted = texts.mapInArrow(_count, "before int, char string, after int, n long").groupBy("before", "char", "after").agg(F.sum("n").alias("n"))
    return [((r["before"], r["char"], r["after"]), r["n"]) for r in counted.collect()]


def posteriors(notes: DataFrame, key: str = "id", source: str = "medio", columns: tuple[str, ...] = ("cuerpo", "titular"), rounds: int = ROUNDS) -> DataFrame:
    """(key, campo, chain, posterior) of the fields with evidence; chain -1 is the clean one."""
    texts = fields(notes.withColumn("_source", F.coalesce(F.col(source), F.lit(""))), key, columns, "_source").select(F.col(key).cast("long").alias("key"), "campo", "texto", F.col("_source").alias("source"))
    shared = notes.sparkSession.sparkContext.broadcast(character_counts(texts))
    evidence = cut(texts.mapInArrow(lambda b: _evidence(b, shared.value), "key long, campo string, source string, gain array<double>"))
    sizes = texts.groupBy("source", "campo").agg(F.count("*").alias("size"))
    groups = cut(sizes.select("source", "campo", "size"))
    total = groups.agg(F.sum("size")).first()[0] or 1
    share = [1e-3] * (LOST + 1)
    shares = groups.select("source", "campo", F.array(*[F.lit(x) for x in share]).alias("share"))
    scored = None
    for turn in range(rounds):
        joined = evidence.join(bounded_broadcast(shares), ["source", "campo"])
        # chain shares + gain, against the clean share; shifted by the greatest for stability
        raw = F.zip_with("share", "gain", lambda p, g: F.when(g > 0, F.log(p) + g))
        clean = F.log(F.lit(1.0) - F.least(F.aggregate("share", F.lit(0.0), lambda a, p: a + p), F.lit(0.95)))
        top = F.greatest(F.array_max("raw"), F.col("clean"))
        weight = F.transform("raw", lambda x: F.coalesce(F.exp(x - F.col("top")), F.lit(0.0)))
        scored = joined.withColumn("raw", raw).withColumn("clean", clean).withColumn("top", top).withColumn("w", weight)
        scored = scored.withColumn("z", F.aggregate("w", F.exp(F.col("clean") - F.col("top")), lambda a, x: a + x)).withColumn("post", F.transform("w", lambda x: x / F.col("z")))
        if turn == rounds - 1:
            break
        sums = scored.groupBy("source", "campo").agg(*[F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(LOST + 1)])
        whole = scored.agg(*[F.coalesce(F.sum(F.col("post")[k]), F.lit(0.0)).alias(f"s{k}") for k in range(LOST + 1)]).first()
        overall = [(whole[k] + 0.1) / (total + 1) for k in range(LOST + 1)]
        joined = groups.join(bounded_broadcast(sums), ["source", "campo"], "left")
        shares = cut(joined.select("source", "campo", F.array(*[(F.coalesce(f"s{k}", F.lit(0.0)) + POOL * overall[k]) / (F.col("size") + POOL) for k in range(LOST + 1)]).alias("share")))
    best = F.array_max(F.transform("post", lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
    result = scored.withColumn("best", best).withColumn("garbled", F.aggregate("post", F.lit(0.0), lambda a, x: a + x))
    return result.select(F.col("key").alias(key), "campo", (-F.col("best.i")).cast("int").alias("chain"), F.col("garbled").alias("posterior"))


def garbled(notes: DataFrame, key: str = "id", source: str = "medio", columns: tuple[str, ...] = ("cuerpo", "titular")) -> DataFrame:
    """(key, campo, chain, posterior) of the fields that are garbled more likely than not."""
    return posteriors(notes, key, source, columns).where("posterior > 0.5")


def repair_text(text: str | None, chain: int, model: Model) -> str | None:
    """The text with each word that the chain makes more probable read back."""
    if text is None or not 0 <= chain < LOST:
        return text
    out = []
    for line in text.split("\n"):
        words = line.split(" ")
        out.append(" ".join(unread(w, chain) if chain in model.gains(w) else w for w in words))
    return "\n".join(out)


def repaired(notes: DataFrame, key: str = "id", source: str = "medio", columns: tuple[str, ...] = ("cuerpo", "titular")) -> DataFrame:
    """(key, campo, chain, texto) of the garbled fields, read back as far as possible.

    The chains come to the texts by a join on the key; other texts are dropped before it shuffles.
    """
    found = cut(garbled(notes, key, source, columns))
    texts = fields(notes, key, columns).join(found.select(key, "campo", "chain"), [key, "campo"])
    shared = notes.sparkSession.sparkContext.broadcast(character_counts(fields(notes, key, columns).select(F.col(key).cast("long").alias("key"), "campo", "texto")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(dict(shared.value))
        for batch in batches:
            mended = [repair_text(t, c, model) for t, c in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(3), pa.array(mended, pa.string())], [key, "campo", "chain", "texto"])

    return texts.select(key, "campo", "texto", "chain").mapInArrow(run, f"`{key}` long, campo string, chain int, texto string")
