"""Evaluation passages inside corpus documents, by q-gram lemma filtering.

Both sides become words (lower case, marks removed, everything but letters and digits a single
space). A passage of L characters that stands in a document with at most ``edits`` edited characters in at
most ``blocks`` runs shares at least L + 1 - q - edits - blocks * (q - 1) of its character q-grams with it,
all within ``edits`` diagonals of one another. So: hash every q-gram of a document, keep stretches in which
enough positions occur in the item index at all (the lemma summed over items), count the shared q-grams of
the rest for each item in overlapping diagonal bands, and retain the regions that meet the item's own bound.
Every retained region is then aligned with its item in a band around its diagonals (local alignment, an edit
costs ``PENALTY`` matches), all regions of a slice at once; the alignment decides. ``leaks`` asks for an
alignment as long as the item's shortest passage and for a run of equal words in it; ``passages`` asks for
enough words of the item at no more than ``RATE`` edits a character.

Bounds and reach are those of each item, so one item of very short words does not loosen the filter of the
others. The item index is broadcast in blocks of at most ``ITEM_BLOCK`` items and ``ITEM_BYTES`` bytes (one
longer item is a block by itself), so a larger item set is taken as several passes, never as a larger
broadcast. Documents are read in one scan for each block and not shuffled.

Defined results: null, empty and very short texts have no words and match nothing; repeated documents
and items each give their own rows; items of fewer than ``words`` words cannot match; very long texts
are handled whole.
"""

from __future__ import annotations

import unicodedata
import uuid
from collections.abc import Iterator
from functools import reduce
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotativa.llm.arrays import polynomial, slices

Q = 16
WORDS = 13
#: Edited characters of a passage of ``WORDS`` words, for runs of equal words and for fuzzy passages.
EDITS, FUZZY_EDITS = 1, 12
#: Runs in which these edits stand.
BLOCKS = 1
#: Matches that an edit costs in the alignment; edits a character that a fuzzy passage may have.
PENALTY, RATE = 3, 0.15
ITEM_BLOCK, ITEM_BYTES = 20_000, 32 << 20
GAP, MARK, UNKNOWN, BLANK = 0, 1, 2, 32
RESULT = "doc_id long, item_id long, words_shared int, words_aligned int, edits int, doc_start int, doc_end int"

#: Code point to itself (letters, digits), ``MARK`` (dropped) or a blank; filled as code points are met.
_TABLE = np.full(0x110000, UNKNOWN, np.uint32)
_TABLE[GAP] = GAP
#: The item index of the block a worker is at.
_INDEX: dict[str, ItemIndex] = {}


def _folded(raw: np.ndarray) -> np.ndarray:
    codes = _TABLE[raw]
    if (new := raw[codes == UNKNOWN]).size:
        for code in np.unique(new).tolist():
            char = chr(code)
            _TABLE[code] = code if char.isalnum() else MARK if unicodedata.category(char)[0] == "M" else BLANK
        codes = _TABLE[raw]
    return codes


def fold(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(codes, bounds): the words of every text with single blanks between, texts parted by ``GAP``.

    Text t is ``codes[bounds[t]:bounds[t + 1]]``, which starts with a gap and a blank and ends with a blank,
    the last text too.
    """
    whole = "\0".join(["", *((x or "").replace("\0", " ") for x in texts), ""]).lower()
    if not whole.isascii():
        whole = unicodedata.normalize("NFD", whole)
    codes = _folded(np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32))
    codes = codes[codes != MARK]
    gap = codes == GAP
    wide = np.repeat(codes, 1 + 2 * gap)  # blank, gap, blank
    at = np.flatnonzero(wide == GAP)[0::3]
    wide[at], wide[at + 2] = BLANK, BLANK
    blank = wide == BLANK
    keep = np.ones(len(wide), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    codes = wide[keep]
    return codes, np.flatnonzero(codes == GAP)


class ItemIndex:
    """Sorted q-grams of a block of items, with the lemma's bound and reach of each item."""

    def __init__(self, ids: list[int], texts: list[str], q: int, words: int, edits: int, blocks: int) -> None:
        codes, bounds = fold(texts)
        self.ids, self.codes, self.bounds = np.array(ids, np.int64), codes, bounds
        # the shortest passage of that many words in each item, with the blanks on both sides
        self.shortest = np.zeros(len(ids), np.int64)
        blanks = np.flatnonzero(codes == BLANK)
        of = np.searchsorted(bounds, blanks, "right") - 1
        if len(blanks) > words:
            inside = np.flatnonzero(of[words:] == of[:-words])
            span = blanks[inside + words] - blanks[inside] + 1
            least = np.full(len(ids), np.iinfo(np.int64).max)
            np.minimum.at(least, of[inside], span)
            self.shortest = np.where(least < np.iinfo(np.int64).max, least, 0)
        self.bound = np.maximum(self.shortest + 1 - q - edits - blocks * (q - 1), 1)
        self.reach = self.shortest + edits
        grams = polynomial(codes, q)
        owner = np.searchsorted(bounds, np.arange(len(grams)), "right") - 1
        last = np.append(bounds, len(codes))
        inside = (np.arange(len(grams)) + q <= last[owner + 1]) & (codes[: len(grams)] != GAP)
        # what follows the last item is its closing gap
        inside &= owner < len(ids)
        inside[inside] = self.shortest[owner[inside]] >= q
        at = np.flatnonzero(inside)
        order = at[np.argsort(grams[at], kind="stable")]
        self.gram, self.owner = grams[order], owner[order]
        self.place = order - bounds[self.owner]
        self.bloom = np.zeros(1 << 20, bool)
        self.bloom[self.gram & np.uint64((1 << 20) - 1)] = True
        # the weakest bound and the farthest reach of the items that hold each gram
        starts = np.flatnonzero(np.append(True, self.gram[1:] != self.gram[:-1])) if len(order) else np.empty(0, np.int64)
        self.distinct = self.gram[starts]
        self.ends = np.append(starts, len(order))
        self.weakest = np.minimum.reduceat(self.bound[self.owner], starts) if len(starts) else starts
        self.farthest = np.maximum.reduceat(self.reach[self.owner], starts) if len(starts) else starts


class Region(NamedTuple):
    """Part ``start`` to ``end`` of a text that may hold a passage of an item, between two diagonals."""

    text: int
    item: int
    start: int
    end: int
    low: int
    high: int


def regions(codes: np.ndarray, bounds: np.ndarray, index: ItemIndex, q: int, edits: int) -> list[Region]:
    """Regions that meet the lemma's bound of their item, those of one item that run on merged."""
    if not len(index.distinct):
        return []
    grams = polynomial(codes, q)
    known = np.flatnonzero(index.bloom[grams & np.uint64((1 << 20) - 1)])
    which = np.minimum(np.searchsorted(index.distinct, grams[known]), len(index.distinct) - 1)
    hit = index.distinct[which] == grams[known]
    known, which = known[hit], which[hit]
    # the lemma over all items: enough known positions within one passage's length
    near = np.searchsorted(known, known + index.farthest[which]) - np.arange(len(known)) >= index.weakest[which]
    mark = np.zeros(len(known) + 1, np.int64)
    first = np.flatnonzero(near)
    np.add.at(mark, first, 1)
    np.add.at(mark, np.searchsorted(known, known[first] + index.farthest[which[first]]), -1)
    kept = np.cumsum(mark[:-1]) > 0
    known, which = known[kept], which[kept]
    if not len(known):
        return []
    left, count = index.ends[which], index.ends[which + 1] - index.ends[which]
    at = np.repeat(known, count)
    ends = np.cumsum(count)
    hit = np.arange(ends[-1]) - np.repeat(ends - count - left, count)
    text = np.searchsorted(bounds, at, "right") - 1
    here, item = at - bounds[text], index.owner[hit]
    diagonal = here - index.place[hit]
    # bands of twice the step overlap by one, so that diagonals within ``edits`` of one another share a band
    step = edits + 1
    bands = np.concatenate([np.stack([text, item, diagonal // step - half, here, diagonal]) for half in (0, 1)], axis=1)
    bands = bands[:, np.lexsort((bands[3], bands[2], bands[1], bands[0]))]
    apart = (np.diff(bands[:3], axis=1) != 0).any(axis=0) | (np.diff(bands[3]) > index.reach[bands[1, :-1]])
    cuts = np.append(0, np.flatnonzero(apart) + 1)
    size = np.diff(np.append(cuts, bands.shape[1]))
    enough = size >= index.bound[bands[1, cuts]]
    low, high = np.minimum.reduceat(bands[4], cuts), np.maximum.reduceat(bands[4], cuts)
    found = sorted(zip(bands[0, cuts][enough].tolist(), bands[1, cuts][enough].tolist(), bands[3, cuts][enough].tolist(), (bands[3, cuts + size - 1] + q)[enough].tolist(), low[enough].tolist(), high[enough].tolist(), strict=True))
    out: list[Region] = []
    for row in (Region(*r) for r in found):
        for k in range(len(out) - 1, -1, -1):
            before = out[k]
            if before[:2] != row[:2]:
                k = -1
                break
            if row.start <= before.end + index.reach[row.item] and row.low <= before.high + step and row.high >= before.low - step:
                out[k] = Region(row.text, row.item, before.start, max(before.end, row.end), min(before.low, row.low), max(before.high, row.high))
                break
        else:
            k = -1
        if k < 0:
            out.append(row)
    return out


def align(found: list[Region], codes: np.ndarray, bounds: np.ndarray, index: ItemIndex, margin: int, band: int) -> list[tuple[int, int, int, int, int, int]]:
    """(score, edits, start and end in the text, start and end in the item) of the best local alignment of each region.

    All regions advance together, one character of their texts a step; a row holds the band's diagonals. An equal
    character gives 1, an edit costs ``PENALTY``.
    """
    r = np.array(found, np.int64)
    text, item = r[:, 0], r[:, 1]
    size = (bounds[text + 1] - bounds[text], np.append(index.bounds, len(index.codes))[item + 1] - index.bounds[item])
    start, end = np.maximum(r[:, 2] - margin, 0), np.minimum(r[:, 3] + margin, size[0])
    low, width = r[:, 4] - band, int((r[:, 5] - r[:, 4]).max()) + 2 * band + 1
    k = np.arange(width)
    # a diagonal beyond the region's own is not part of its band
    beyond = low[:, None] + k > (r[:, 5] + band)[:, None]
    own, other = codes, np.append(index.codes, np.uint32(GAP))
    zero = np.zeros((len(r), width), np.int64)
    score, edits = zero.copy(), zero.copy()
    first = np.full((len(r), width, 2), -1)
    best = [(0, 0, 0, 0, 0, 0)] * len(r)
    top = np.zeros(len(r), np.int64)
    for n in range(int((end - start).max())):
        here = start + n
        live = here < end
        there = here[:, None] - low[:, None] - k
        inside = (there >= 0) & (there < size[1][:, None]) & live[:, None] & ~beyond
        a = own[np.minimum(bounds[text] + here, len(own) - 1)][:, None]
        b = other[np.where(inside, index.bounds[item][:, None] + there, len(other) - 1)]
        equal = inside & (a == b) & (a != GAP)
        # on the diagonal: equal or substituted; a start where nothing is worth keeping
        new, changed, begun = np.where(equal, score + 1, score - PENALTY), edits + ~equal, first
        fresh = equal & (new <= 1)
        if fresh.any():
            begun = np.where(fresh[:, :, None], np.stack([np.broadcast_to(here[:, None], there.shape), there], axis=2), begun)
            new, changed = np.where(fresh, 1, new), np.where(fresh, 0, changed)
        # a character of the text alone: from the diagonal before
        alone = np.roll(score, 1, axis=1) - PENALTY
        alone[:, 0] = -1
        better = alone > new
        if better.any():
            new, changed = np.where(better, alone, new), np.where(better, np.roll(edits, 1, axis=1) + 1, changed)
            begun = np.where(better[:, :, None], np.roll(first, 1, axis=1), begun)
        new = np.where(inside, new, 0)
        # characters of the item alone: from the diagonals after, in one sweep
        back = new[:, ::-1] + PENALTY * k
        peak = np.maximum.accumulate(back, axis=1)
        source = np.maximum.accumulate(np.where(back == peak, k, 0), axis=1)
        swept = (peak - PENALTY * k)[:, ::-1]
        if (swept > new).any():
            source = (width - 1 - source)[:, ::-1]
            begun, changed = np.take_along_axis(begun, source[:, :, None], axis=1), np.take_along_axis(changed, source, axis=1) + source - k
            new = swept
        score, edits, first = np.where(inside & (new > 0), new, 0), changed, begun
        peak = score.max(axis=1)
        for c in np.flatnonzero(peak > top).tolist():
            j = int(score[c].argmax())
            top[c] = peak[c]
            best[c] = (int(peak[c]), int(edits[c, j]), int(first[c, j, 0]), int(here[c]) + 1, int(first[c, j, 1]), int(there[c, j]) + 1)
    return best


def _run(codes: np.ndarray, other: np.ndarray, region: Region, edits: int) -> tuple[int, int, int]:
    """(words, start, end) of the longest run of equal words within the region's band."""
    best = (0, 0, 0)
    for shift in range(region.low - edits, region.high + edits + 1):
        start = max(region.start, 0, shift)
        end = min(region.end, len(codes), len(other) + shift)
        if end <= start:
            continue
        same = codes[start:end] == other[start - shift : end - shift]
        edges = np.flatnonzero(np.diff(np.concatenate([[False], same, [False]]).astype(np.int8)))
        for a, b in zip(edges[0::2].tolist(), edges[1::2].tolist(), strict=True):
            blanks = np.flatnonzero(codes[start + a : start + b] == BLANK)
            if len(blanks) - 1 > best[0]:
                best = (len(blanks) - 1, start + a + int(blanks[0]), start + a + int(blanks[-1]))
    return best


def find(texts: list[str | None], index: ItemIndex, q: int, words: int, edits: int, fuzzy: bool) -> list[tuple[int, int, int, int, int, int, int]]:
    """(text, item, equal words, aligned words, edits, start, end): the best verified region of each pair."""
    codes, bounds = fold(texts)
    found = regions(codes, bounds, index, q, edits)
    if not found:
        return []
    out: dict[tuple[int, int], tuple[int, int, int, int, int]] = {}
    aligned = align(found, codes, bounds, index, 2 * q if fuzzy else q, edits)
    for region, (score, changed, start, end, a, b) in zip(found, aligned, strict=True):
        own, other = codes[bounds[region.text] : bounds[region.text + 1]], index.codes[index.bounds[region.item] : np.append(index.bounds, len(index.codes))[region.item + 1]]
        covered = int((other[a:b] == BLANK).sum()) - 1
        if fuzzy:
            if covered < words or changed > RATE * (b - a):
                continue
            row = (_run(own, other, region, edits)[0], covered, changed, start, end)
        else:
            if score < index.shortest[region.item]:
                continue
            run = _run(own, other, Region(*region[:2], region.start - q, region.end + q, *region[4:]), edits)
            if run[0] < words:
                continue
            row = (run[0], max(covered, run[0]), changed, *run[1:])
        key = (region.text, region.item)
        if key not in out or row[fuzzy:] > out[key][fuzzy:]:
            out[key] = row
    return [(t, i, *row) for (t, i), row in out.items()]


def _found(documents: DataFrame, items: DataFrame, q: int, words: int, edits: int, item_block: int, fuzzy: bool) -> DataFrame:
    keyed = items.select(F.col("item_id").cast("long"), "text").where("item_id is not null and text is not null")
    count, size = keyed.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    blocks = max(1, -(-count // item_block), -(-(size or 0) // ITEM_BYTES))
    passes = []
    for block in range(blocks):
        part = keyed if blocks == 1 else keyed.where(F.pmod(F.xxhash64("item_id"), F.lit(blocks)) == block)
        rows = part.orderBy("item_id").collect()
        shared = documents.sparkSession.sparkContext.broadcast(([r["item_id"] for r in rows], [r["text"] for r in rows]))
        name = uuid.uuid4().hex

        def run(batches: Iterator[pa.RecordBatch], shared=shared, name=name) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if name not in _INDEX:
                    # a worker that is used again keeps the index of its block
                    _INDEX.clear()
                    _INDEX[name] = ItemIndex(*shared.value, q, words, edits, BLOCKS)
                for piece in slices(batch, 1):
                    found = find(piece.column(1).to_pylist(), _INDEX[name], q, words, edits, fuzzy)
                    if found:
                        t, i, *rest = (np.array(x) for x in zip(*found, strict=True))
                        columns = [piece.column(0).take(pa.array(t)), pa.array(_INDEX[name].ids[i]), *(pa.array(x.astype(np.int32)) for x in rest)]
                        yield pa.RecordBatch.from_arrays(columns, ["doc_id", "item_id", "words_shared", "words_aligned", "edits", "doc_start", "doc_end"])

        passes.append(documents.select(F.col("doc_id").cast("long"), "text").where("text is not null").mapInArrow(run, RESULT))
    return reduce(DataFrame.unionByName, passes)


def leaks(documents: DataFrame, items: DataFrame, q: int = Q, words: int = WORDS, edits: int = EDITS, item_block: int = ITEM_BLOCK) -> DataFrame:
    """One row for each document and item of which at least ``words`` consecutive words leaked into it."""
    return _found(documents, items, q, words, edits, item_block, False)


def passages(documents: DataFrame, items: DataFrame, q: int = Q, words: int = WORDS, edits: int = FUZZY_EDITS, item_block: int = ITEM_BLOCK) -> DataFrame:
    """One row for each document and item with a passage of at least ``words`` of the item's words, edits allowed.

    ``doc_start`` and ``doc_end`` count characters of the document's words with single blanks between.
    """
    return _found(documents, items, q, words, edits, item_block, True)
