"""Text expressions shared by the operators; all run inside code generation."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Latin letters with marks and the letters they fold to.
MARKED = "áàâäãåéèêëíìîïóòôöõúùûüñçýÿ"
FOLDED = "aaaaaaeeeeiiiiooooouuuuncyy"

#: Runs of word characters, and the words kept of them.
RUN = r"[\p{L}\p{N}_]+"
WORD = "^[a-záéíóúüñ]+$"
LONG_WORD = "^[a-záéíóúüñ]{3,}$"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of the value, which is evaluated once however often the body uses it."""
    return F.get(F.transform(F.array(value), lambda x: body(x)), F.lit(0))


def fold(text: Column) -> Column:
    """Lower case without marks; not trimmed."""
    return F.translate(F.lower(text), MARKED, FOLDED)


def fold_trim(text: Column) -> Column:
    return F.trim(fold(text))


def runs(text: Column) -> Column:
    """All runs of letters, digits and underscores, in lower case and order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(RUN), 0)


def tokens(text: Column, least: int = 1) -> Column:
    """Runs that are words of the alphabet, of at least one or three letters."""
    pattern = LONG_WORD if least >= 3 else WORD
    return F.filter(runs(text), lambda x: x.rlike(pattern))


def words(text: Column) -> Column:
    """Parts between white space."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"\s+"), lambda x: x != "")


def word_count(text: Column) -> Column:
    return F.size(words(text))


def content_hash(text: Column) -> Column:
    """Sixteen hexadecimal digits of the text's fingerprint; empty where there is no text."""
    squeezed = F.array_join(words(F.lower(text)), " ")
    return F.when(squeezed == "", "").otherwise(F.substring(F.sha2(squeezed, 256), 1, 16))


def quoted(literal: str) -> str:
    """The literal as a regular expression."""
    return "".join(c if c.isalnum() or c == " " or c == "_" else "\\" + c for c in literal)


def occurrences(text: Column, literal: str) -> Column:
    """Start positions (from 0) of the non-overlapping occurrences of a literal."""
    parts = F.split(text, quoted(literal))
    lengths = F.transform(F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.length(x))
    summed = F.aggregate(
        lengths,
        F.struct(F.array().cast("array<int>").alias("at"), F.lit(0).alias("next")),
        lambda acc, n: F.struct(F.concat(acc["at"], F.array(acc["next"] + n)).alias("at"), (acc["next"] + n + F.lit(len(literal))).alias("next")),
    )
    return summed["at"]


def ngrams(items: Column, n: int) -> Column:
    """Joined runs of ``n`` items; empty where there are fewer."""
    starts = F.when(F.size(items) >= n, F.sequence(F.lit(1), F.size(items) - n + 1)).otherwise(F.array().cast("array<int>"))
    return F.transform(starts, lambda i: F.array_join(F.slice(items, i, n), " "))


def host(url: Column) -> Column:
    """Host of a url in lower case without ``www.``; empty where there is none."""
    return F.regexp_replace(F.regexp_extract(F.lower(F.coalesce(url, F.lit(""))), r"^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1), "www\\.", "")


def query_value(url: Column, name: str) -> Column:
    """Decoded value of a query parameter; null where it is missing."""
    found = F.regexp_extract(url, rf"[?&]{name}=([^&#]*)", 1)
    return F.when(found != "", F.try_url_decode(found))


def labelled(score: Column, high: float, low: float, names: tuple[str, str, str]) -> Column:
    return F.when(score >= high, names[0]).when(score >= low, names[1]).otherwise(names[2])
