"""Encoding of the whole corpus with a public byte-level BPE vocabulary.

Pair occurrence index: the distinct pre-tokens of a partition are laid out as one sequence of ids,
each adjacent pair is mapped to all its positions, and active merge ranks are applied in ascending
order; a merge updates the position lists of the neighbouring pairs only. A pair that holds a merged
id always has a later rank than the merge that made the id, so one ascending pass is complete.

Pre-tokens are found on the UTF-8 bytes with vectorised class tables and counted through Arrow's
dictionary encoding, so Python handles each distinct pre-token once for a worker, not once per use.

Defined results: null and empty texts give an empty list; white space alone is encoded like any text;
special tokens' spellings are ordinary text; rows are kept one to one, repeated ids included.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from rotativa.llm.arrays import ragged, slices, utf8

LETTER, NUMBER, OTHER, SPACE = 1, 2, 3, 4
#: Code points that count as white space.
WHITE = [9, 10, 11, 12, 13, 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Suffixes split off after an apostrophe.
CONTRACTIONS = (b"s", b"t", b"re", b"ve", b"m", b"ll", b"d")
#: Distinct pre-tokens kept by a worker before its cache starts anew.
CACHE_WORDS = 1_000_000


def _class(code: int) -> int:
    if code in WHITE:
        return SPACE
    kind = unicodedata.category(chr(code))[0]
    return LETTER if kind == "L" else NUMBER if kind == "N" else OTHER


_ASCII = np.array([_class(c) if c < 128 else 0 for c in range(256)], np.uint8)


def byte_classes(data: np.ndarray) -> np.ndarray:
    """Class of the character to which each UTF-8 byte belongs."""
    kinds = _ASCII[data]
    lead = np.flatnonzero(data >= 0xC0)
    if not len(lead):
        return kinds
    first = data[lead]
    extra = np.where(first >= 0xF0, 3, np.where(first >= 0xE0, 2, 1))
    padded = np.concatenate([data, np.zeros(3, np.uint8)])
    code = np.where(first >= 0xF0, first & 7, np.where(first >= 0xE0, first & 15, first & 31)).astype(np.int64)
    for k in (1, 2, 3):
        code = np.where(extra >= k, code << 6 | padded[lead + k] & 63, code)
    distinct, back = np.unique(code, return_inverse=True)
    own = np.array([_class(int(c)) for c in distinct], np.uint8)[back]
    kinds[lead] = own
    for k in (1, 2, 3):
        kinds[(lead + k)[extra >= k]] = own[extra >= k]
    return kinds


def pretoken_starts(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Byte positions at which a pre-token starts, over all texts of a slice."""
    n = len(data)
    if not n:
        return np.empty(0, np.int64)
    kinds = byte_classes(data)
    begin = np.zeros(n + 1, bool)
    begin[offsets] = True
    start = begin[:n].copy()
    start[1:] |= kinds[1:] != kinds[:-1]
    # white space before a word: its last character leaves the run, and a plain space joins the word
    space = kinds == SPACE
    last = np.flatnonzero(space & ~begin[1:] & np.append(kinds[1:] != SPACE, False))
    follows = last + 1
    head = last.copy()
    while (inside := (data[head] & 0xC0) == 0x80).any():
        head[inside] -= 1
    start[head] = True
    start[follows[data[last] == 32]] = False
    # contractions: an apostrophe that starts a pre-token and is followed by one of the suffixes
    quote = np.flatnonzero(data == 39)
    if len(quote):
        first = begin[quote] | ((kinds[quote - 1] != OTHER) & (data[quote - 1] != 32))
        quote = quote[first]
        padded = np.concatenate([data, np.zeros(3, np.uint8)])
        ends = np.concatenate([begin, np.ones(3, bool)])
        taken = np.zeros(len(quote), bool)
        for suffix in CONTRACTIONS:
            hit = ~taken
            for k, c in enumerate(suffix, 1):
                hit &= (padded[quote + k] == c) & ~ends[quote + k]
            taken |= hit
            at = quote[hit]
            start[at + 1] = False
            after = at + 1 + len(suffix)
            after = after[after < n]
            start[after] = True
    return np.flatnonzero(start)


@lru_cache(maxsize=2)
def vocabulary(path: str) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines()) if a}


def merge_words(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Ids of each word, by the pair occurrence index over all of them."""
    tokens: list[bytes | None] = []
    right: list[int] = []
    left: list[int] = []
    starts: list[int] = []
    for word in words:
        at = len(tokens)
        starts.append(at)
        tokens.extend(word[i : i + 1] for i in range(len(word)))
        left.extend([-1, *range(at, at + len(word) - 1)])
        right.extend([*range(at + 1, at + len(word)), -1])
    where: dict[int, list[int]] = {}
    for i, j in enumerate(right):
        if j >= 0 and (rank := ranks.get(tokens[i] + tokens[j])) is not None:
            where.setdefault(rank, []).append(i)
    active = list(where)
    heapq.heapify(active)
    while active:
        rank = heapq.heappop(active)
        for i in sorted(where.pop(rank)):
            j = right[i]
            if tokens[i] is None or j < 0 or ranks.get(tokens[i] + tokens[j]) != rank:
                continue
            tokens[i] = merged = tokens[i] + tokens[j]
            tokens[j] = None
            right[i] = after = right[j]
            if after >= 0:
                left[after] = i
            for a, b in ((left[i], i), (i, after)):
                if a >= 0 and b >= 0 and (new := ranks.get(tokens[a] + tokens[b])) is not None:
                    if new not in where:
                        where[new] = []
                        heapq.heappush(active, new)
                    where[new].append(a)
    ids = []
    for at in starts:
        own = []
        while at >= 0:
            own.append(ranks[tokens[at]])
            at = right[at]
        ids.append(own)
    return ids


_CACHE: dict[str, dict[bytes, np.ndarray]] = {}


def encode_column(texts: pa.Array, path: str) -> pa.ListArray:
    """One list of ids for each text."""
    ranks, cache = vocabulary(path), _CACHE.setdefault(path, {})
    data, offsets = utf8(texts)
    starts = pretoken_starts(data, offsets)
    bounds = np.append(starts, len(data)).astype(np.int64)
    if not len(starts):
        return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
    words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
    coded = words.dictionary_encode()
    distinct = coded.dictionary.to_pylist()
    if len(cache) > CACHE_WORDS:
        cache.clear()
    new = [w for w in distinct if w not in cache]
    cache.update(zip(new, (np.array(x, np.int32) for x in merge_words(new, ranks)), strict=True))
    found = [cache[w] for w in distinct]
    length = np.fromiter(map(len, found), np.int64, len(found))
    flat, at = np.concatenate(found), np.cumsum(length) - length
    which = coded.indices.to_numpy()
    ids = flat[ragged(at[which], length[which])]
    # the pre-tokens of text t are those that start in [offsets[t], offsets[t + 1])
    before = np.concatenate([[0], np.cumsum(length[which])])[np.searchsorted(starts, offsets)]
    return pa.ListArray.from_arrays(pa.array(before.astype(np.int32)), pa.array(ids))


def encode(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", out: str = "ids") -> DataFrame:
    """(key, out): the ids of each text. ``path`` names a file of base64 tokens and ranks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), encode_column(part.column(1), path)], [key, out])

    kind = df.schema[key].dataType.simpleString()
    return df.select(f"`{key}`", f"`{text}`").mapInArrow(run, f"`{key}` {kind}, `{out}` array<int>")
