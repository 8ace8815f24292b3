"""Page furniture mixed with main content, by differencing each page with its nearest pages by URL.

Pages are put in order of their URL path within each host and table, and each page is aligned with the
``NEIGHBOURS`` pages before and after it: the longest common subsequence of their lines. What two lines share need
not be every letter, so a line stands in the sequence by its keys:

* itself, as it is written on its host (numbers apart);
* a short line, its words with names and numbers masked; a line of listed parts, each part like a short line;
  a line that begins with a head parted by a sign ("Tags:", "3.", "[Video]"), the head;
* a long line, the bands of a MinHash sketch over all its words, so that lines of one wording meet whatever
  fills their slots.

Keys in the common subsequence are shared by that pair of pages. One pair may share a line by chance, and a page
may lie beside pages without one of its lines, so verdicts are per key: the share of the alignments of its pages in
which it was in common, at the lower end of its confidence interval. Lines
whose keys are shared are deleted; of a list, if most of its parts are. A key under which sentences
stand in the midst of paragraphs, or twice on a page, belongs to running text and deletes nothing. A headline without full stop goes
with the heading of its block.

Only hashes are shuffled. Ordering is a range partitioning by (table, host, path, id), so that a host with a third
of all pages, or pages without URL, are spread over tasks; the pages at the borders of the partitions are aligned
across them in a second step, so that the pairs do not depend on the partitions. Verdicts come from partial sums.

Defined results: null and empty texts have no lines, blank lines are never reported; pages without URL form
one group by their table; very long pages are aligned like any other (bit-parallel, linear in memory). Pages that
share most of their long lines are captures of one page and tell nothing of each other.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rotativa.llm.arrays import slices
from rotativa.session import bounded_broadcast, cut

#: Pages that follow a page in URL order and are aligned with it.
NEIGHBOURS = 6
#: Least share of alignments, less ``Z`` deviations, in which a key is in common: of short lines, of long lines, of
#: whole lines of one host.
SHORT_RATE, LONG_RATE, HOST_RATE, Z = 0.0065, 0.0095, 0.03, 2.0
#: Part of their long lines that captures of one page share; part of a list's parts that must be shared.
COPY, PARTS = 0.7, 0.6
#: Keys whose sentences stand inside paragraphs at least this often, as against making a line, are running text.
#: and the share of such lines at which a key is.
INNER_RATIO, RUNNING_SHARE = 0.1, 0.25
#: Tokens of a long line; bands of its sketch, values in each, bands that must be shared, bands of a sentence.
LONG, BANDS, ROWS, LEAST_BANDS, FIRST_BANDS = 8, 8, 3, 2, 4
HOST_KIND, SHORT_KIND, LONG_KIND = 0, 1, 2

_ODD = np.random.default_rng(11).integers(1, 1 << 63, BANDS * ROWS, np.uint64) * np.uint64(2) + np.uint64(1)
_LIST = re.compile(r"\s+[·|>/•–—\-]\s+|\s{2,}")
_HEAD = re.compile(r"^(\d{1,2}[.)]|\[[^\]\n]{2,12}\]|[^\W\d][^.:→–—|·>,;«»\"“”¿?¡!()\d]{1,28}?\s?(?::|→|–|—|·))(?=\s|$)")
_SENTENCE = re.compile(r"(?<=[.!?”»\"])\s+(?=[^\W_a-záéíóúñü]|[«¿¡“\"])")
_TERMINAL = re.compile(r"[.!?…”»\")\]]$")
_SPACE = re.compile(r"[^\S\n ]")
_SIGN = re.compile(r"(?<![^ \n])[^\x00-\x7f]{1,8}(?![^ \n])")
_DIGITS = re.compile(r"\d[\d.,:]*")


def _plain(text: str) -> str:
    """Lower case, without the letters beyond ASCII and the signs that stand for lost ones."""
    return text.encode("ascii", "ignore").decode().replace("?", "").lower()


def masked(text: str) -> str:
    """The words of a line with names and numbers masked; runs of names are one."""
    tokens = text.split()
    upper = len(text) > 5 and text.isupper()
    out: list[str] = []
    for i, token in enumerate(tokens):
        core = token.lstrip("«“\"'(¿¡[")
        if core[:1].isdigit() or core[:1] == "$":
            word = "0"
        elif core in ("Zz", "ZZ"):
            word = "A"
        elif not upper and core[:1].isupper() and (i or (len(tokens) > 1 and tokens[1][:1].isupper())):
            word = "A"
        elif not upper and core[:1].isupper() and token.endswith(",") and len(tokens) < LONG:
            word = "A"
        else:
            word = _plain(core).strip(".,;:\"')]")
        if word and not (word == "A" and out and out[-1] == "A"):
            out.append(word)
    return " ".join(out)


def wordings(lines: list[str]) -> pa.ListArray:
    """The words of whole lines but for names, numbers and quoted titles, which fill a template's slots."""
    texts = pa.array([x.lower() if x.isupper() else x for x in lines], pa.string())
    frame = _words_of(pc.replace_substring_regex(texts, r"«[^»]*(?:»|$)|“[^”]*(?:”|$)", " "))
    # a line that is all quotation has no frame to compare
    few = pc.less(pc.add(pc.count_substring(frame, " "), 1), ROWS)
    whole = pc.if_else(few, _words_of(texts), frame) if pc.any(few).as_py() else frame
    return pc.split_pattern(whole, " ")


def _words_of(texts: pa.Array) -> pa.Array:
    plain = pc.replace_substring_regex(texts, r"(?:\s+[«“\"'(¿¡\[]*\p{Lu}\S*)+", " ")
    plain = pc.replace_substring_regex(pc.utf8_lower(plain), r"[^\x00-\x7f]+|\?", "")
    plain = pc.replace_substring_regex(plain, r"[.,;:\"')(]+(\s|$)|(^|\s)[.,;:\"')(]+", r"\1\2")
    plain = pc.replace_substring_regex(plain, r"(?:^|\s)[^a-z\s]\S*", " ")
    return pc.utf8_trim_whitespace(pc.replace_substring_regex(plain, r"\s+", " "))


def minima(words: pa.ListArray) -> np.ndarray:
    """The MinHash sketch of each sentence's words."""
    if not len(words):
        return np.empty((0, BANDS * ROWS), np.uint64)
    coded = words.flatten().dictionary_encode()
    table = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    starts = words.offsets.to_numpy()[:-1] - words.offsets[0].as_py()
    codes = coded.indices.to_numpy()
    out = np.empty((len(words), BANDS * ROWS), np.uint64)
    for place, odd in enumerate(_ODD):
        mixed = table * odd
        mixed ^= mixed >> np.uint64(32)
        mixed *= odd
        out[:, place] = np.minimum.reduceat(mixed[codes], starts)
    return out


def band_keys(sketch: np.ndarray, bands: int = BANDS) -> np.ndarray:
    """A key for each band of a sketch; lines of the same words have the same keys."""
    out = np.zeros((len(sketch), bands), np.uint64)
    for place in range(bands * ROWS):
        band = place // ROWS
        out[:, band] = (out[:, band] * np.uint64(0x9E3779B97F4A7C15)) ^ sketch[:, place]
    return _of_kind((out * np.uint64(0xBF58476D1CE4E5B9) + np.arange(bands, dtype=np.uint64)).view(np.int64), LONG_KIND)


def _of_kind(keys, kind: int):
    """A key tells its kind by its lowest bits."""
    return keys & ~3 | kind


def _hash(kind: int, text: str) -> int:
    return _of_kind(xxhash.xxh3_64_intdigest(text) - (1 << 63), kind)


def part_keys(parts: list[str]) -> list[str]:
    return [masked(p) if len(p.split()) > 1 else _plain(p) for p in parts]


def line_keys(line: str) -> tuple[list[str], int, int, bool, str] | None:
    """(short keys, how many must be shared of how many parts, looks like a headline, the line to sketch or nothing); None if blank.

    Keys after the parts stand for the line by themselves.
    """
    raw = line.strip()
    if not raw:
        return None
    text = squeezed = " ".join(raw.split())
    tokens = text.split()
    ended = bool(_TERMINAL.search(text))
    parts = [] if ended else [p for p in _LIST.split(raw.strip(" ·|>/•–-")) if p]
    if len(parts) >= 3 and all(len(p.split()) <= 6 and len(p) <= 40 for p in parts):
        return part_keys(parts), -int(-PARTS * len(parts) // 1), len(parts), False, ""
    if (head := _HEAD.match(text)) and len(head[1].split()) <= 7:
        # numbers of items are one head
        name = _DIGITS.sub("0", _plain(head[1]).rstrip(" :")) if head[1][:1].isdigit() else _plain(head[1]).rstrip(" :")
        return [f"{name} *"], 1, 1, not ended and len(tokens) >= 5 and not head[1][:1].isdigit(), ""
    # parts between commas, or words that are all names of something
    parts = [] if ended or len(tokens) < 3 or text.isupper() else squeezed.split(", ")
    if parts and any(len(p.split()) > 3 for p in parts):
        parts = squeezed.split() if sum(t[:1].isupper() for t in tokens) >= 0.75 * len(tokens) else []
    if len(parts) >= 3:
        whole = [masked(text)] if len(tokens) < LONG or all(" " not in p for p in parts) else []
        return [*part_keys(parts), *whole], -int(-PARTS * len(parts) // 1), len(parts), False, ""
    if len(tokens) < LONG:
        # a line of one word keeps it
        return [masked(text) if len(tokens) > 1 else _plain(text)], 1, 1, not ended and len(tokens) >= 5, ""
    return [], 1, 1, not ended, text


class PageKeys(NamedTuple):
    """Keys of a page in order, with the line, the part and the parts wanted of each, and for long lines the key of the
    first sentence; keys of its long lines as they are written; of their first sentences; of sentences inside paragraphs."""

    keys: list[int]
    line: list[int]
    part: list[int]
    wanted: list[int]
    opening: list[int | None]
    long: list[int]
    first: list[int]
    inner: list[int]


def page_keys(texts: list[str], hosts: list[str], brands: list[str]) -> list[PageKeys]:
    """The keys of each page; ``brands`` are masked in its lines."""
    masked_texts = pa.array(texts, pa.string())
    # outlets' names in capitals keep a line in capitals
    for spelt, name in ((sorted({x.upper() for x in brands}), "ZZ"), (sorted({*brands, *(x.lower() for x in brands)}), "Zz")):
        if spelt and len(masked_texts):
            masked_texts = pc.replace_substring_regex(masked_texts, "|".join(re.escape(x) for x in sorted(spelt, key=lambda x: (-len(x), x))), name)
    pages, sentences, starts = [], [], []
    for text, host in zip(masked_texts.to_pylist(), hosts, strict=True):
        # white space of any kind is a blank; a sign that a wrong decoding has changed still parts
        text = _SIGN.sub(lambda m: m[0] if m[0].isalpha() or m[0] in "·•→–—«»" else "·", _SPACE.sub(" ", text))
        rows: list[tuple[int, int, int, int | None, int]] = []
        long: list[int] = []
        inner: list[int] = []
        opener: int | None = None
        for number, line in enumerate(text.split("\n")):
            found = line_keys(line)
            if found is None:
                continue
            short, wanted, parts, headline, whole = found
            own = _hash(HOST_KIND, host + "|" + _DIGITS.sub("0", _plain(" ".join(line.split()))))
            rows.append((number, 0, 1, own, 0))
            keys = [_hash(SHORT_KIND, x) for x in short]
            rows += [(number, i, 1 if i >= parts else wanted, k, 0) for i, k in enumerate(keys)]
            if headline and opener is not None:
                rows.append((number, 0, 1, opener, 0))
            elif not short or not short[0].startswith("0"):
                opener = keys[0] if len(keys) == 1 and len(short[0].split()) <= 4 and not short[0].endswith("*") else None
            if whole:
                long.append(own)
                rows.append((number, 0, LEAST_BANDS, None, len(starts)))
                starts.append(len(sentences))
                sentences += _SENTENCE.split(whole)
                inner += range(starts[-1] + 1, len(sentences))
        pages.append((rows, long, inner))
    # the sketch of a line is the least of its sentences'
    sketch = minima(wordings(sentences))
    bands = band_keys(np.minimum.reduceat(sketch, starts, axis=0) if starts else sketch).tolist()
    each = band_keys(sketch, FIRST_BANDS).tolist()
    firsts = [each[i] for i in starts]
    out = []
    for rows, long, inner in pages:
        page = PageKeys([], [], [], [], [], long, [], [])
        for n, part, wanted, key, at in rows:
            own = [key] if key is not None else bands[at]
            page.keys.extend(own)
            page.line.extend([n] * len(own))
            page.part.extend([part] if key is not None else range(BANDS))
            page.wanted.extend([wanted] * len(own))
            page.opening.extend([None] if key is not None else (firsts[at] * (BANDS // FIRST_BANDS + 1))[:BANDS])
            if key is None:
                page.first.extend(firsts[at])
        # furniture stands once on a page; wording that a page uses again is running text
        page.inner.extend(k for k, n in Counter(page.first).items() if n > 1 for _ in range(n - 1))
        for i in inner:
            page.inner.extend(each[i])
        out.append(page)
    return out


def common_lines(a: list[int], b: list[int]) -> tuple[list[int], list[int]]:
    """Positions in both of a longest common subsequence: bit-parallel rows, then a walk back."""
    where: dict[int, int] = defaultdict(int)
    for j, x in enumerate(b):
        where[x] |= 1 << j
    full = (1 << len(b)) - 1
    row, rows = full, []
    for x in a:
        hit = row & where.get(x, 0)
        row = ((row + hit) | (row - hit)) & full
        rows.append(row)
    left, right = [], []
    i, j = len(a) - 1, len(b) - 1
    while i >= 0 and j >= 0:
        if a[i] == b[j]:
            left.append(i)
            right.append(j)
            i, j = i - 1, j - 1
        # a zero bit at j says that b[: j + 1] gives more in common than b[:j]
        elif rows[i] >> j & 1:
            j -= 1
        else:
            i -= 1
    return left[::-1], right[::-1]


def _lists(values: list[list], kind: pa.DataType) -> pa.ListArray:
    return pa.ListArray.from_arrays(np.cumsum([0, *map(len, values)]).astype(np.int32), pa.array([x for v in values for x in v], kind))


def _pages(batches: Iterator[pa.RecordBatch], brands: list[str]) -> Iterator[pa.RecordBatch]:
    kinds = (pa.int64(), pa.int32(), pa.int16(), pa.int16(), pa.int64(), pa.int64(), pa.int64(), pa.int64())
    for batch in batches:
        for part in slices(batch, 4):
            made = page_keys(part.column(4).to_pylist(), part.column(2).to_pylist(), brands)
            yield pa.RecordBatch.from_arrays([*(part.column(i) for i in range(4)), *(_lists([m[i] for m in made], k) for i, k in enumerate(kinds))], ["tabla", "id", "host", "path", "s", "n", "u", "q", "f", "long", "first", "inner"])


Page = tuple[str, str, list[int], list[int], set[int], set[int]]


def shared_keys(a: Page, b: Page) -> set[int] | None:
    """Keys in the longest common subsequence of two pages; None for captures of one page."""
    if a[5] and b[5] and len(a[5] & b[5]) >= COPY * min(len(a[5]), len(b[5])):
        return None
    common = a[4] & b[4]
    if len(common) < 2:
        return common
    # keys of one page only are in no common subsequence
    x, y = [k for k in a[2] if k in common], [k for k in b[2] if k in common]
    left, _ = common_lines(x, y)
    return {x[i] for i in left}


class Evidence:
    """Alignments of the pages of each (table, key) and those in which the key was in common."""

    def __init__(self) -> None:
        self.seen: dict[tuple[str, int], int] = defaultdict(int)
        self.matched: dict[tuple[str, int], int] = defaultdict(int)

    def pair(self, a: Page, b: Page) -> bool:
        shared = shared_keys(a, b)
        for k in shared or ():
            self.matched[a[0], k] += 2
        return shared is not None

    def page(self, page: Page, alignments: int) -> None:
        if alignments:
            for k in page[4]:
                self.seen[page[0], k] += alignments

    def rows(self) -> pa.RecordBatch:
        keys = list(self.seen.keys() | self.matched.keys())
        columns = [pa.array([k[0] for k in keys], pa.string()), pa.nulls(len(keys), pa.string()), pa.array([k[1] for k in keys], pa.int64())]
        columns += [pa.array([d.get(k, 0) for k in keys], pa.int64()) for d in (self.seen, self.matched)]
        size, none = len(keys), pa.nulls
        self.seen.clear()
        self.matched.clear()
        return pa.RecordBatch.from_arrays([*columns, none(size, pa.int32()), none(size, pa.int64()), none(size, pa.list_(pa.int64())), none(size, pa.list_(pa.int64()))], NAMES)


NAMES = ["tabla", "host", "s", "seen", "matched", "part", "place", "keys", "long"]
KINDS = "tabla string, host string, s long, seen long, matched long, part int, place long, keys array<long>, long array<long>"


def _differences(batches: Iterator[pa.RecordBatch], neighbours: int) -> Iterator[pa.RecordBatch]:
    """Counts of the pairs inside a partition, and the pages of each group near the partition's borders.

    A page with all its neighbours inside the partition is done; of the others the number of alignments made is
    kept with the page, and its pairs across the border are made by ``_across``.
    """
    from pyspark import TaskContext

    part, place = TaskContext.get().partitionId(), 0
    evidence = Evidence()
    # the last pages of the group with their number of alignments, and the first ones
    near: list[list] = []
    first: list[list] = []
    opening = True

    def edge(held: list[list]) -> pa.RecordBatch:
        pages = [h[0] for h in held]
        size = len(held)
        kind = pa.list_(pa.int64())
        return pa.RecordBatch.from_arrays([pa.array([p[0] for p in pages], pa.string()), pa.array([p[1] for p in pages], pa.string()), pa.nulls(size, pa.int64()), pa.array([h[1] for h in held], pa.int64()), pa.nulls(size, pa.int64()), pa.array([part] * size, pa.int32()), pa.array([h[2] for h in held], pa.int64()), pa.array([p[2] for p in pages], kind), pa.array([p[3] for p in pages], kind)], NAMES)

    def close(last: bool) -> Iterator[pa.RecordBatch]:
        held = {h[2]: h for h in first + near}
        # a group between two others cannot go on in another partition
        if held and (last or opening):
            yield edge([held[k] for k in sorted(held)])
        else:
            for h in held.values():
                evidence.page(h[0], h[1])

    for batch in batches:
        for tabla, host, keys, long in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
            page: Page = (tabla, host, keys, long, set(keys), set(long))
            if near and near[-1][0][:2] != page[:2]:
                yield from close(False)
                near, first, opening = [], [], False
            entry = [page, 0, place]
            place += 1
            for other in near:
                if evidence.pair(other[0], page):
                    other[1] += 1
                    entry[1] += 1
            if len(first) < neighbours:
                first.append(entry)
            near.append(entry)
            if len(near) > neighbours:
                done = near.pop(0)
                # one of the first may have neighbours in the partition before
                if not any(done is x for x in first):
                    evidence.page(done[0], done[1])
        if len(evidence.seen) + len(evidence.matched) > 500_000:
            yield evidence.rows()
    yield from close(True)
    yield evidence.rows()


def _across(batches: Iterator[pa.RecordBatch], neighbours: int) -> Iterator[pa.RecordBatch]:
    """Counts of the pages near borders: their pairs across partitions, and all their alignments."""
    evidence = Evidence()
    near: list[list] = []
    for batch in batches:
        for tabla, host, made, part, place, keys, long in zip(*(batch.column(c).to_pylist() for c in ("tabla", "host", "seen", "part", "place", "keys", "long")), strict=True):
            page: Page = (tabla, host, keys, long, set(keys), set(long))
            if near and near[-1][0][:2] != page[:2]:
                for done in near:
                    evidence.page(done[0], done[1])
                near = []
            entry = [page, made, part, place]
            # places count within a partition; what lies between two pages of one partition is no border
            for back, other in enumerate(reversed(near), 1):
                if back > neighbours or (other[2] != part and back > neighbours):
                    break
                if other[2] == part:
                    if place - other[3] != back:
                        break
                    continue
                if evidence.pair(other[0], page):
                    other[1] += 1
                    entry[1] += 1
            near.append(entry)
            if len(near) > 2 * neighbours:
                done = near.pop(0)
                evidence.page(done[0], done[1])
        if len(evidence.seen) + len(evidence.matched) > 500_000:
            yield evidence.rows()
    for done in near:
        evidence.page(done[0], done[1])
    yield evidence.rows()


def _low(matched: str, seen: str) -> Column:
    """Lower end of the confidence interval of a share, from the pairs of pages that were in common (Poisson's deviation)."""
    pairs = F.col(matched) / 2
    return 2 * (pairs - Z * F.sqrt(pairs)) / F.col(seen)


def keys_of(pages: DataFrame, brands: list[str]) -> DataFrame:
    """The ``PageKeys`` of ``pages(tabla, id, host, path, texto)``; only hashes of the texts."""
    many = "s array<long>, n array<int>, u array<short>, q array<short>, f array<long>, long array<long>, first array<long>, inner array<long>"
    texts = pages.where("texto is not null and texto != ''").select("tabla", F.col("id").cast("long").alias("id"), F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "texto")
    return cut(texts.mapInArrow(lambda b: _pages(b, brands), f"tabla string, id long, host string, path string, {many}"))


def evidence(read: DataFrame, neighbours: int = NEIGHBOURS, partitions: int | None = None) -> DataFrame:
    """(tabla, s, seen, matched): for each key, the alignments of the pages that hold it and those in which it was in common."""
    place = ["tabla", "host", "path", "id"]
    keyed = read.select(*place, F.col("s").alias("keys"), "long")
    ordered = (keyed.repartitionByRange(partitions, *place) if partitions else keyed.repartitionByRange(*place)).sortWithinPartitions(*place)
    inside = cut(ordered.select("tabla", "host", "keys", "long").mapInArrow(lambda b: _differences(b, neighbours), KINDS))
    borders = inside.where("part is not null").repartition("tabla", "host").sortWithinPartitions("tabla", "host", "part", "place")
    across = borders.mapInArrow(lambda b: _across(b, neighbours), KINDS)
    counts = inside.where("part is null").unionByName(across).where("seen > 0 or matched > 0")
    return counts.groupBy("tabla", "s").agg(F.sum("seen").alias("seen"), F.sum("matched").alias("matched"))


def furniture(pages: DataFrame, brands: list[str], neighbours: int = NEIGHBOURS, partitions: int | None = None) -> DataFrame:
    """(tabla, id, linea) of the lines that are page furniture; ``pages(tabla, id, host, path, texto)``."""
    read = keys_of(pages, brands)
    # a key is judged by the table in which it is shared most
    best = evidence(read, neighbours, partitions).where("matched > 0").groupBy("s").agg(F.max(_low("matched", "seen")).alias("rate"))
    kind = F.col("s").bitwiseAND(3)
    least = F.when(kind == SHORT_KIND, SHORT_RATE).when(kind == LONG_KIND, LONG_RATE).otherwise(HOST_RATE)
    guilty = bounded_broadcast(best.where(F.col("rate") >= least).select("s"), 1_000_000)
    lines = read.select("tabla", "id", F.explode(F.arrays_zip("s", "n", "u", "q", "f")).alias("l")).select("tabla", "id", "l.s", "l.n", "l.u", "l.q", "l.f")
    hit = cut(lines.join(guilty, "s"))
    # sentences that stand inside paragraphs as well as at their beginning are running text, and so are the keys of
    # lines that mostly begin with such sentences
    asked = bounded_broadcast(hit.where("f is not null").select("f").distinct(), 1_000_000)
    uses = lambda name: read.select(F.explode(name).alias("f")).join(asked, "f", "left_semi").groupBy("f").agg(F.count("*").alias(name))
    running = uses("inner").join(uses("first"), "f", "left").where(F.col("inner") >= INNER_RATIO * F.coalesce("first", F.lit(0))).select("f", F.lit(1).alias("x"))
    text = hit.where("f is not null").select("s", "f").join(running, "f", "left").groupBy("s").agg(F.avg(F.coalesce("x", F.lit(0))).alias("share")).where(F.col("share") >= RUNNING_SHARE).select("s")
    shared = hit.join(text, "s", "left_anti").groupBy("tabla", "id", "n", "q").agg(F.countDistinct("u").alias("c"))
    return shared.where("c >= q").select("tabla", "id", F.col("n").alias("linea")).distinct()


def url_parts(url: str) -> tuple:
    """(host, path) columns of a url column; empty where there is none."""
    whole = F.lower(F.coalesce(F.col(url), F.lit("")))
    return F.regexp_extract(whole, r"^[a-z][a-z0-9+.-]*://(?:www\.)?([^/:?#]+)", 1), F.regexp_extract(whole, r"^[a-z][a-z0-9+.-]*://[^/?#]+([^?#]*)", 1)


def page_rows(notes: DataFrame, captures: DataFrame) -> DataFrame:
    """(tabla, id, host, path, texto) of notes and captured pages."""
    host, path = url_parts("url")
    a = notes.select(F.lit("notas").alias("tabla"), "id", host.alias("host"), path.alias("path"), F.col("cuerpo").alias("texto"))
    host, path = url_parts("url_final")
    return a.unionByName(captures.select(F.lit("capturas").alias("tabla"), F.col("captura_id").alias("id"), host.alias("host"), path.alias("path"), "texto"))


def main_content(pages: DataFrame, brands: list[str]) -> DataFrame:
    """(tabla, id, texto): each page without its furniture; a page of nothing else is empty, a null one null."""
    gone = furniture(pages, brands).groupBy("tabla", "id").agg(F.collect_set("linea").alias("gone"))
    lines = F.filter(F.transform(F.split("texto", "\n"), lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda x: F.col("gone").isNull() | ~F.array_contains("gone", x["i"]))
    return pages.join(gone, ["tabla", "id"], "left").select("tabla", "id", F.array_join(F.transform(lines, lambda x: x["x"]), "\n").alias("texto"))
