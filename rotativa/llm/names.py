"""Variant spellings of names typed by people, linked to declared entities.

Distinct names are compared by MinHash banding over padded q-grams of their tokens; the number of bands is
taken from the collision curve for a wanted recall at a given similarity. Entities enter with their typed
forms and with the short forms people use (surnames, initial and surname, acronym), so that a short name is
near one of them. Candidates are verified by Monge-Elkan similarity (mean best token similarity: the edit
distance as a share of the token, or a shortening, an initial or a nickname) under the condition that no token of the name
contradicts the entity. Star clustering joins entities entered twice: a free entity of greatest degree among its
free neighbours is a star's centre, these are its satellites, and a name goes to its best star.

Names are made distinct before anything else, so an entity that holds a third of all rows costs its distinct
spellings only, and rows come back by a join on the spelling. Bands are joined between names and entities.

Defined results: null, empty and one-letter names link to nothing; equal spellings link whatever their
category; a name equally near two stars links to both; repeated rows each link.
"""

from __future__ import annotations

import json
import math
import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotativa.session import cut

Q = 3
ROWS = 3
#: Bands are as many as give this recall at this Jaccard similarity.
SIMILARITY, RECALL = 0.42, 0.99
LEAST_SCORE, LEAST_TOKEN = 0.8, 0.75

#: Words that join the parts of a name.
PARTICLES = frozenset("de del la las los el y e da do dos das por para en of the and al".split())
#: Titles and offices before a person's name.
TITLES = frozenset(
    "senador senadora concejal candidato candidata alcalde alcaldesa exalcalde exministro exministra ministro ministra gobernador gobernadora presidente presidenta "
    "expresidente vicepresidente dr dra doctor doctora prof profesor profesora ing ingeniero ingeniera lic licenciado licenciada don dona sr sra srta senor senora "
    "representante diputado diputada magistrado magistrada general coronel procurador contralor director directora vocero vocera abogado abogada exsenador exsenadora".split()
)
#: First words of bodies.
BODIES = frozenset(
    "consejo asociacion universidad observatorio instituto movimiento secretaria federacion corporacion alianza ministerio comite fundacion partido sindicato camara "
    "comision agencia unidad superintendencia direccion departamento centro colegio confederacion cooperativa empresa defensoria contraloria procuraduria fiscalia "
    "registraduria gobernacion alcaldia tribunal corte junta red coalicion frente liga union banco grupo oficina".split()
)
#: Nicknames of given names.
NICKNAMES = {
    "jesus": "chucho chuy", "guillermo": "memo guille", "isabel": "chabela chava isa", "francisco": "pacho paco pancho kiko", "jose": "pepe chepe",
    "antonio": "tono", "alejandro": "alejo alex", "rosario": "charo chayo", "mercedes": "meche", "dolores": "lola", "consuelo": "chelo", "eduardo": "lalo edu",
    "ignacio": "nacho", "enrique": "quique kike", "manuel": "manolo manu", "luis": "lucho", "maria": "mari maruja", "beatriz": "bety betty", "concepcion": "concha",
    "roberto": "beto", "alberto": "beto", "gabriel": "gabo", "rafael": "rafa", "fernando": "nando", "carlos": "carlitos", "juan": "juancho", "pedro": "perucho",
    "sebastian": "sebas", "nicolas": "nico", "margarita": "margot marga", "catalina": "cata", "patricia": "paty pati", "teresa": "tere", "graciela": "chela",
    "victoria": "vicky", "cristina": "cris", "sergio": "checo", "vicente": "chente", "gonzalo": "chalo", "hernando": "nando", "santiago": "santi", "leonardo": "leo",
    "daniela": "dani", "daniel": "dani", "federico": "fede", "mauricio": "mauro", "diego": "dieguito", "ximena": "xime", "veronica": "vero", "fabiola": "fabi",
    "gustavo": "tavo", "joaquin": "quincho joaco", "ramon": "moncho", "yolanda": "yoli", "elena": "nena", "lucia": "lucy", "sofia": "sofi", "carolina": "caro",
}
_NICKNAMES = {k: frozenset(v.split()) for k, v in NICKNAMES.items()}


@lru_cache(maxsize=200_000)
def plain(text: str) -> str:
    folded = unicodedata.normalize("NFD", text.lower().replace("&", " y "))
    return "".join(c for c in folded if unicodedata.category(c) != "Mn")


def words(name: str) -> list[str]:
    """Tokens without marks, brackets, particles and titles; digits typed for letters are read as these."""
    text = re.sub(r"\([^)]*\)", " ", plain(name))
    tokens = []
    for token in re.findall(r"[a-z0-9]+\.?", text):
        bare = token.rstrip(".")
        if any(c.isalpha() for c in bare):
            bare = bare.translate(str.maketrans("01345", "oleas"))
        if bare not in PARTICLES or token.endswith("."):
            tokens.append(bare + ("." if token.endswith(".") else ""))
    while len(tokens) > 2 and is_title(tokens[0]):
        tokens = tokens[1:]
    return [t for t in tokens if t.strip(".")]


def is_title(token: str) -> bool:
    bare = token.rstrip(".")
    return bare in TITLES or len(bare) >= 5 and any(abs(len(bare) - len(t)) <= 1 and len(t) >= 5 and edits(bare, t) <= 1 for t in TITLES)


@lru_cache(maxsize=500_000)
def edits(a: str, b: str) -> int:
    """Optimal-string-alignment distance, 2 for anything above 1."""
    if a == b:
        return 0
    if abs(len(a) - len(b)) > 1:
        return 2
    i = 0
    while i < min(len(a), len(b)) and a[i] == b[i]:
        i += 1
    rest_a, rest_b = a[i:], b[i:]
    if rest_a[1:] == rest_b[1:] or rest_a[1:] == rest_b or rest_a == rest_b[1:]:
        return 1
    if len(rest_a) > 1 and len(rest_b) > 1 and rest_a[0] == rest_b[1] and rest_a[1] == rest_b[0] and rest_a[2:] == rest_b[2:]:
        return 1
    return 2


def token_similarity(typed: str, true: str, known: frozenset[str] = frozenset()) -> float:
    """How well a typed token stands for a true one; ``known`` words are not taken for misspellings."""
    a, b = typed.rstrip("."), true.rstrip(".")
    if a == b:
        return 1.0
    if len(a) == 1 or len(b) == 1:
        return 0.9 if a[:1] == b[:1] else 0.0
    if typed.endswith(".") and len(a) < len(b) and b.startswith(a) or typed.endswith(".") and a[0] == b[0] and a[-1] == b[-1] and len(a) <= 4 < len(b):
        return 0.92
    if a in known and b in known:
        return 0.95 if a in _NICKNAMES.get(b, ()) or b in _NICKNAMES.get(a, ()) else 0.0
    if (changed := edits(a, b)) <= 1 and (max(len(a), len(b)) >= 4 or a[0] == b[0] and len(a) == len(b) == 3):
        # the edit distance as a share of the longer token
        return 1 - changed / (max(len(a), len(b)) + 1)
    for x, y in ((a, b), (b, a)):
        for nick in _NICKNAMES.get(y, ()):
            if x == nick or len(nick) >= 4 and edits(x, nick) <= 1:
                return 0.94
    return 0.0


def acronym(tokens: list[str]) -> str:
    return "".join(t[0] for t in tokens)


def is_body(tokens: list[str]) -> bool:
    return any(t in BODIES for t in tokens) or len(tokens) >= 4 and any(len(t) >= 6 and any(edits(t, b) <= 1 for b in BODIES if len(b) >= 6) for t in tokens)


def similarity(name: str, entity: str, given: frozenset[str]) -> float:
    """Monge-Elkan score of a name against an entity's full name; 0 where they contradict each other."""
    typed, true = words(name), words(entity)
    if not typed or not true:
        return 0.0
    if sorted(t.rstrip(".") for t in typed) == sorted(t.rstrip(".") for t in true):
        return 1.0
    if len(typed) == 1 or len(true) == 1:
        one, many, raw = (typed, true, name) if len(typed) == 1 else (true, typed, entity)
        short = one[0].rstrip(".")
        return 0.97 if len(many) >= 3 and 3 <= len(short) <= 7 and (raw.strip().isupper() or len(short) >= 4) and is_body(many) and short == acronym(many) else 0.0
    pairs = sorted(((token_similarity(a, b, given), -i, -j) for i, a in enumerate(typed) for j, b in enumerate(true)), reverse=True)
    taken_a: dict[int, tuple[int, float]] = {}
    taken_b: set[int] = set()
    for score, i, j in pairs:
        if score >= LEAST_TOKEN and -i not in taken_a and -j not in taken_b:
            taken_a[-i] = (-j, score)
            taken_b.add(-j)
    if len(taken_a) < len(typed):
        return 0.0
    score = sum(s for _, s in taken_a.values()) / len(typed)
    if is_body(true):
        return score if len(taken_b) == len(true) else 0.0
    surnames = [j for j, t in enumerate(true) if t.rstrip(".") not in given and len(t.rstrip(".")) > 1] or list(range(len(true)))[-2:]
    spelt = {j for i, (j, _) in taken_a.items() if len(typed[i].rstrip(".")) > 1 and len(true[j].rstrip(".")) > 1}
    matched = [j for j in surnames if j in spelt]
    if not matched or len(matched) == 1 and (len(typed) < 2 or len(surnames) > 1 and matched[0] != surnames[0]):
        return 0.0
    return score


def best_similarity(name: str, forms: list[str], given: frozenset[str]) -> float:
    """Against the entity's name in either direction; a typed form counts where the spelling is the same."""
    full = forms[0]
    score = max(similarity(name, full, given), similarity(full, name, given) if len(words(name)) > len(words(full)) else 0.0)
    if not score:
        own = sorted(t.rstrip(".") for t in words(name))
        if any(len(words(f)) > 1 and sorted(t.rstrip(".") for t in words(f)) == own for f in forms[1:]):
            return 0.9
    return score


def short_forms(name: str, given: frozenset[str]) -> list[str]:
    """The full name and the shorter ones people use for it."""
    tokens = [t.rstrip(".") for t in words(name)]
    out = {" ".join(sorted(tokens))}
    if is_body(tokens):
        out |= {acronym(tokens)}
    elif len(tokens) > 1:
        first = [t for t in tokens if t in given] or tokens[:1]
        last = [t for t in tokens if t not in first]
        for names in (last, last[:1]):
            for g in ([], *[[x] for x in first], *[[x[0]] for x in first]):
                out.add(" ".join(sorted([*g, *names])))
        out |= {" ".join(sorted([g, *last[:1], *(x[0] for x in last[1:2])])) for g in first}
        out |= {" ".join(sorted([first[0], second[0], *last[:1]])) for second in first[1:]}
        out |= {" ".join(sorted([nick, *last])) for g in first for nick in _NICKNAMES.get(g, ())} | {" ".join(sorted([nick, *last[:1]])) for g in first for nick in _NICKNAMES.get(g, ())}
    return sorted(x for x in out if x)


def bands(rows: int = ROWS, similarity_: float = SIMILARITY, recall: float = RECALL) -> int:
    """Bands at which two sets of that similarity meet with that probability: 1 - (1 - s^r)^b."""
    return math.ceil(math.log(1 - recall) / math.log(1 - similarity_**rows))


def signatures(texts: list[str], rows: int, count: int, q: int = Q) -> list[list[int]]:
    """One hash for each band of a text's padded q-grams."""
    rng = np.random.default_rng(11)
    size = rows * count
    a, b = rng.integers(1, 2**61, size, np.uint64) | np.uint64(1), rng.integers(0, 2**61, size, np.uint64)
    out = []
    with np.errstate(over="ignore"):
        for text in texts:
            grams = {f"{'^' * (q - 1)}{t}$"[i : i + q] for t in text.split() for i in range(len(t) + 1)}
            if not grams:
                out.append([])
                continue
            h = np.array([xxhash.xxh3_64_intdigest(g) for g in sorted(grams)], np.uint64)
            mixed = h[:, None] * a + b
            mixed ^= mixed >> np.uint64(31)
            low = (mixed * np.uint64(0xBF58476D1CE4E5B9)).min(axis=0).reshape(count, rows)
            band = np.zeros(count, np.uint64)
            for r in range(rows):
                band = (band ^ low[:, r]) * np.uint64(0x9E3779B97F4A7C15)
                band ^= band >> np.uint64(29)
            out.append(band.view(np.int64).tolist())
    return out


def _names(batches: Iterator[pa.RecordBatch], count: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        names = batch.column(0).to_pylist()
        texts = [" ".join(sorted(t.rstrip(".") for t in words(n))) for n in names]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signatures(texts, ROWS, count), pa.list_(pa.int64()))], ["nombre", "bands"])


def typed_forms(name: str, forms: str | None) -> list[str]:
    try:
        more = json.loads(forms) if forms else []
    except ValueError:
        more = []
    return [name, *(f for f in more if isinstance(f, str) and f != name)] if isinstance(more, list) else [name]


def _entities(batches: Iterator[pa.RecordBatch], count: int, given: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for key, name, forms in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            typed = typed_forms(name or "", forms)
            texts = set(short_forms(typed[0], given)) | {" ".join(sorted(t.rstrip(".") for t in words(f))) for f in typed}
            rows += [(key, typed, s) for s in signatures(sorted(texts), ROWS, count) if s]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.list_(pa.string())), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["ent_id", "forms", "bands"])


def _verified(batches: Iterator[pa.RecordBatch], given: frozenset[str]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        scores = [best_similarity(n, f, given) for n, f in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores, pa.float64())], ["nombre", "ent_id", "score"])


def _ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, opens, closes): the words that open a person's name of three or more, and those that close one."""
    for batch in batches:
        opens, closes = Counter(), Counter()
        for name in batch.column(0).to_pylist():
            tokens = [t.rstrip(".") for t in words(name)]
            if is_body(tokens) or "," in name or len(tokens) < 3:
                continue
            opens.update(tokens[: len(tokens) - 2])
            closes.update(tokens[-2:])
        keys = list(opens | closes)
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in (opens, closes))], ["token", "opens", "closes"])


def given_names(entities: DataFrame) -> frozenset[str]:
    """Given names among the declared persons: words that open a name of three or more and close none.

    They are counted over all names by partial sums; what is gathered is the vocabulary of given names.
    """
    counted = entities.select("nombre").where("nombre is not null").mapInArrow(_ends, "token string, opens long, closes long").groupBy("token").agg(F.sum("opens").alias("o"), F.sum("closes").alias("c"))
    return frozenset(r["token"] for r in counted.where("o > 0 and c = 0 and length(token) > 1").select("token").collect()) | frozenset(_NICKNAMES)


def links(entities: DataFrame, reviews: DataFrame) -> DataFrame:
    """(nombre, ent_id, score): every distinct spelling with the entities that it can mean."""
    count = bands()
    given = given_names(entities)
    spelt = entities.select("nombre").unionByName(reviews.select("nombre")).where("length(trim(nombre)) > 1").distinct()
    by_band = F.posexplode("bands").alias("band", "h")
    left = spelt.mapInArrow(lambda b: _names(b, count), "nombre string, bands array<long>").select("nombre", by_band)
    declared = entities.select(F.col("ent_id").cast("long"), "nombre", "formas").where("nombre is not null")
    right = cut(declared.mapInArrow(lambda b: _entities(b, count, given), "ent_id long, forms array<string>, bands array<long>"))
    pairs = left.join(right.select("ent_id", by_band).distinct(), ["band", "h"]).select("nombre", "ent_id").distinct()
    forms = right.groupBy("ent_id").agg(F.first("forms").alias("forms"))
    checked = pairs.join(forms, "ent_id").select("nombre", "ent_id", "forms").mapInArrow(lambda b: _verified(b, given), "nombre string, ent_id long, score double")
    return checked.where(F.col("score") >= LEAST_SCORE)


def stars(entities: DataFrame, linked: DataFrame) -> DataFrame:
    """(ent_id, star): star clustering of the entities, each with the centre of its star.

    In each round a free entity of greatest degree among its free neighbours becomes a centre (ties by the lesser
    id), and the free neighbours of centres become their satellites, of the greatest one if there are several. The
    free entity of greatest degree of all always becomes a centre, so the rounds end; no centre is a satellite.
    """
    own = entities.select(F.col("ent_id").cast("long"), "nombre").where("ent_id is not null")
    edges = own.withColumnRenamed("ent_id", "a").join(linked.withColumnRenamed("ent_id", "b"), "nombre").where("a != b").select("a", "b")
    edges = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    degree = edges.groupBy("a").agg(F.count("*").alias("d"))
    rank = lambda d, i: F.struct(F.col(d).alias("d"), (-F.col(i)).alias("i"))
    free = cut(edges.join(degree.select("a", F.col("d").alias("da")), "a").join(degree.select(F.col("a").alias("b"), F.col("d").alias("db")), "b").select("a", "b", rank("da", "a").alias("ra"), rank("db", "b").alias("rb")))
    placed = own.select("ent_id").distinct().join(free.select(F.col("a").alias("ent_id")).distinct(), "ent_id", "left_anti").select("ent_id", F.col("ent_id").alias("star"))
    alone = own.select("ent_id").where("false")
    while True:
        # entities whose neighbours are all placed are free by themselves
        centres = cut(free.groupBy("a").agg(F.max("rb").alias("top"), F.first("ra").alias("ra")).where("ra > top").select("a").unionByName(alone.select(F.col("ent_id").alias("a"))).distinct())
        if centres.isEmpty():
            break
        satellites = cut(free.join(centres.select(F.col("a").alias("b")), "b", "left_semi").groupBy("a").agg((-F.max("rb")["i"]).alias("star")).join(centres, "a", "left_anti"))
        gone = cut(centres.unionByName(satellites.select("a")))
        placed = placed.unionByName(centres.select(F.col("a").alias("ent_id"), F.col("a").alias("star"))).unionByName(satellites.select(F.col("a").alias("ent_id"), "star"))
        rest = free.join(gone, "a", "left_anti")
        kept = cut(rest.join(gone.select(F.col("a").alias("b")), "b", "left_anti").select("a", "b", "ra", "rb"))
        alone = cut(rest.select("a").distinct().join(kept.select("a").distinct(), "a", "left_anti").select(F.col("a").alias("ent_id")))
        free = kept
    return placed


def members(entities: DataFrame, reviews: DataFrame) -> DataFrame:
    """(clave, star): every row with the stars that it belongs to; the pairs of a star's rows need not be made to be known."""
    star, rows = _members(entities, reviews)
    return rows.select("clave", "star")


def variants(entities: DataFrame, reviews: DataFrame) -> DataFrame:
    """(clave_a, clave_b): rows that mean the same, the first one a declared entity."""
    star, rows = _members(entities, reviews)
    pairs = star.withColumnRenamed("ent_id", "clave_a").join(rows.withColumnRenamed("clave", "clave_b"), "star").where("clave_a < clave_b")
    return pairs.select("clave_a", "clave_b").distinct()


def _members(entities: DataFrame, reviews: DataFrame) -> tuple[DataFrame, DataFrame]:
    linked = cut(links(entities, reviews))
    star = cut(stars(entities, linked))
    scored = linked.join(star, "ent_id").groupBy("nombre", "star").agg(F.max("score").alias("score"))
    best = scored.groupBy("nombre").agg(F.max("score").alias("best"))
    chosen = scored.join(best, "nombre").where(F.col("score") >= F.col("best") - 0.005).select("nombre", "star")
    rows = entities.select(F.col("ent_id").cast("long").alias("clave"), "nombre").unionByName(reviews.select(F.col("rev_id").cast("long").alias("clave"), "nombre"))
    return star, rows.join(chosen, "nombre").select("clave", "star").unionByName(star.select(F.col("ent_id").alias("clave"), "star")).where("clave is not null").distinct()
