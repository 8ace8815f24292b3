r"""Template residue and texts standing in for content that never came.

Message templates are mined with a fixed-depth prefix tree. A field is taken apart into its sentences and
lines; each is masked (quotations, numbers, addresses and marks with digits, runs of names, letters beyond ASCII) and takes
the path of its number of tokens and its first ``DEPTH`` tokens; the leaf is the template. Counts of all leaves
come from partial sums over the whole table:

* a leaf is *supported* if it stands in at least ``SUPPORT`` records that differ in their other field (bodies
  under different titles, titles over different bodies), so that captures of one article do not support themselves;
* a record is *bare* if nearly all of its tokens lie in supported leaves: it says nothing of its own;
* a template is a notice if it stands in bare records: the lower confidence bound of that share decides, which
  asks for the same certainty at every size. Furniture and an article's sentences mostly stand beside text of
  their own, so they are never notices, whatever they say.

Each template is so classified once, and its verdict goes to all records that hold its leaf by a join. Templates
seen too seldom are judged by closeness to the notices: the weights of tokens, log-odds between the mined notices
together with some known ones (``KNOWN``) and all other text. The known ones hold half of the weight at least, so that
filler and titles, which are seldom mined, weigh the same in a large table as in a small one. A title's own template, which has no text beside
it, counts as a notice if it is supported, is free of names and is close to the notices. Unresolved slots,
which can stand inside any ordinary record, are detected apart, on the raw field.

The model's notices are a sample of at most ``SAMPLE`` bare records and ``SAMPLE_BYTES`` bytes; everything else is counted over all
records. Hashes are shuffled, not texts; a field is scanned twice.

Defined results: null, empty and blank fields are no residue; a field counts once whatever it holds;
square brackets, braces, error numbers and scripts that an article merely reports on are no residue.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rotativa.llm.arrays import slices
from rotativa.session import cut

#: Tokens of a unit that make its path in the tree, beside their number.
DEPTH = 8
#: Records with different other fields that support a leaf; share of a bare record's tokens in supported leaves.
SUPPORT, BARE = 4, 0.8
#: Share of bare records, at the lower end of its confidence interval of ``Z`` deviations, that makes a notice.
NOTICE_SHARE, Z = 0.5, 1.64
#: Bare records, and bytes of them, that the token weights are fitted to, at most.
SAMPLE, SAMPLE_BYTES = 20_000, 32 << 20
#: A known notice counts as so many units at least; what a token not seen in notices takes off and the most that any token
#: adds, so that no single one decides; the least sum and mean of a notice.
KNOWN_WEIGHT, STRANGE, MOST, LEAST_SCORE, LEAST_MEAN = 5, 1.0, 3.0, 4.0, 0.8
#: What a field must hold for a slot to be looked for (no lookaround, so that it runs in one pass).
_SLOT_HINT = r"[{$%@#_*<]|\[[^.\]]|\bNaN|undefined|XX"

#: Unresolved slots of common template languages and editors' placeholders.
SLOTS = (
    r"\{\{[^{}\n]{0,80}\}\}",
    r"\{%[^\n]{0,100}?%\}",
    r"<%[^\n]{0,100}?%>",
    r"<\?(?:php|=)",
    r"<!--[^\n]{0,80}-->",
    r"\$\{[\w.\- ]{1,60}\}",
    r"\{[\p{L}_][\w.]{0,60}\}",
    r"\{\d{1,3}\}",
    r"%%\w{1,60}%%",
    r"@@\w{1,60}@@",
    r"(?<![\w#])#\p{L}\w{0,60}#",
    r"__[\p{Lu}\d_]{2,60}__",
    r"\[\[[\w .]{1,60}\]\]",
    r"\*\|\w{1,40}\|\*",
    r"<TK\b[^>\n]{0,60}>|\[TK\b[^\]\n]{0,60}\]",
    r"\[\p{Lu}{3,}(?: \p{Lu}+)*\](?<!\[VIDEO\])(?<!\[FOTOS\])(?<!\[AUDIO\])(?<!\[SIC\])(?<!\[FOTO\])",
    r"(?i)\[(?:nombre|insertar|insert|falta|completar|agregar|poner|fecha|ciudad|lugar|cifra|dato|cargo|autor|titular|t.tulo|texto aqu|pendiente|por confirmar|your|name)\b[^\]\n]{0,60}\]",
    r"\[(?:gallery|caption|embed|shortcode|video|audio)\b [^\]\n]{0,80}=[^\]\n]{0,80}\]",
    r"\[object Object\]",
    r"(?<![\w/])NaN(?!\w)",
    r"(?<![\w.])undefined(?![\w])",
    r"(?<![\w%])%[sd](?![\w%])",
    r"\bX{2} de X{2,}\b|\b20XX\b|\bX{4,}\b|\bXX/XX/",
)

#: Notices of errors, denial, robot checks and scripts, filler and test text, as they are usually worded.
KNOWN = """404 Not Found
Error 404
HTTP Error 500 Internal Server Error
HTTP 502 Bad Gateway nginx
503 Service Unavailable
Request ID 1
Access Denied. You don't have permission to access this page on this server
Acceso denegado. No tiene permiso para ver esta página en este servidor
Acceso restringido. Usted no tiene autorización para acceder
Página no encontrada
La página que buscas no existe o fue movida
Esta nota ya no está disponible
Contenido no disponible
Page not found
Not found. The requested URL was not found on this server
Vaya, algo salió mal. Inténtalo de nuevo en unos minutos
Something went wrong. Please try again later
Servicio no disponible, vuelva más tarde
Código de error 1
Ray ID 1
Just a moment
Cargando
Loading please wait
Checking your browser. Verify you are human
Verificando que no es un robot. Complete la verificación para continuar
Hemos detectado tráfico inusual desde su red
JavaScript requerido
Please enable JavaScript and cookies to continue
Active JavaScript en su navegador para ver este contenido
Necesita activar Java Script para leer la nota
Su navegador no admite scripts
Error al conectar con la base de datos
Warning mysql undefined index
Traceback most recent call last File line in module KeyError TypeError
Fatal error uncaught exception
Texto de prueba
Esto es una prueba
Prueba prueba
Test test testing
NO PUBLICAR test
No borrar
Contenido pendiente de redacción
Titular pendiente
Título de la nota aquí
Aquí va el cuerpo de la nota
Sin título borrador
Borrador
Párrafo de relleno
Sample text placeholder
bla bla bla
asdf qwerty
null
undefined
Untitled draft"""

#: Words of the customary Latin filler.
FILLER = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua enim ad minim veniam quis nostrud exercitation ullamco laboris nisi aliquip ex ea commodo consequat duis aute irure in reprehenderit voluptate velit esse cillum eu fugiat nulla pariatur excepteur sint occaecat cupidatat non proident sunt culpa qui officia deserunt mollit anim id est laborum"



_SLOT = regex.compile("|".join(f"(?:{s})" for s in SLOTS))


def has_slot(text: str) -> bool:
    return _SLOT.search(text) is not None


def units(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(masked sentences and lines, the row of each); 0 stands for numbers, addresses and quotations, 1 for names."""
    x = pc.replace_substring_regex(texts, r"«[^»\n]*»|“[^”\n]*”", "0")
    x = pc.split_pattern(pc.replace_substring_regex(x, r"([.!?…]) +", "\\1\n"), "\n")
    rows = pc.list_parent_indices(x).to_numpy(zero_copy_only=False)
    x = pc.replace_substring_regex(x.flatten(), r"\S*[0-9/]\S*", "0")
    # a unit of capitalised words only has no names that stand out
    named = pc.match_substring_regex(x, r"(?:^|\s)\p{P}*\p{Ll}")
    x = pc.utf8_lower(pc.if_else(named, pc.replace_substring_regex(x, r"(?:\s+\p{Lu}\p{Ll}\S*)+", " 1"), x))
    x = pc.replace_substring_regex(pc.replace_substring_regex(x, r"[^a-z01\s]+", ""), r"\s+", " ")
    return pc.utf8_trim_whitespace(x), rows


def leaves(masked: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(hash of the path, number of tokens) of each masked unit; an empty unit has no tokens."""
    coded = masked.dictionary_encode()
    unique = coded.dictionary
    count = (pc.count_substring(unique, " ").to_numpy(zero_copy_only=False) + (pc.binary_length(unique).to_numpy(zero_copy_only=False) > 0)).astype(np.int64)
    opening = pc.replace_substring_regex(unique, rf"^((?:\S+ ){{{DEPTH - 1}}}\S+) .*$", r"\1")
    path = pd.util.hash_array(opening.to_numpy(zero_copy_only=False).astype(object), categorize=False) if len(unique) else np.empty(0, np.uint64)
    with np.errstate(over="ignore"):
        path = (path ^ count.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)).view(np.int64)
    index = coded.indices.to_numpy(zero_copy_only=False)
    return path[index], count[index]


def _paths(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(record, leaves, sizes, slot, token, n): the leaves of each record, and rows with the counts of tokens."""
    for batch in batches:
        for part in slices(batch, 1):
            texts = pc.fill_null(part.column(1), "")
            hinted = pc.match_substring_regex(texts, _SLOT_HINT).to_pylist()
            slot = [hint and has_slot(texts[i].as_py()) for i, hint in enumerate(hinted)]
            masked, rows = units(texts)
            path, size = leaves(masked)
            kept = size > 0
            offsets = pa.array(np.searchsorted(rows[kept], np.arange(part.num_rows + 1)).astype(np.int32))
            lists = [pa.ListArray.from_arrays(offsets, pa.array(x[kept].astype(t))) for x, t in ((path, np.int64), (size, np.int32))]
            tokens = pc.split_pattern(masked.filter(pa.array(kept)), " ").flatten().value_counts()
            many, few = part.num_rows, len(tokens)
            yield pa.RecordBatch.from_arrays([part.column(0), *lists, pa.array(slot, pa.bool_()), pa.nulls(many, pa.string()), pa.nulls(many, pa.int64())], ["r", "leaf", "size", "slot", "token", "n"])
            yield pa.RecordBatch.from_arrays([pa.nulls(few, pa.int64()), pa.nulls(few, lists[0].type), pa.nulls(few, lists[1].type), pa.nulls(few, pa.bool_()), tokens.field(0), tokens.field(1)], ["r", "leaf", "size", "slot", "token", "n"])


def token_weights(notices: Counter, others: Counter) -> dict[str, float]:
    """Log-odds of the tokens of notices against all other text; a token of other text only has none."""
    n, m, size = sum(notices.values()), sum(others.values()), len(notices) + 1
    return {t: min(math.log((k + 0.5) / (n + 0.5 * size)) - math.log((others.get(t, 0) + 0.5) / (m + 0.5 * size)), MOST) for t, k in notices.items()}


def known_tokens() -> Counter:
    masked, _ = units(pa.array(KNOWN.split("\n")))
    lines = Counter(t for x in masked.to_pylist() for t in x.split())
    return Counter({t: KNOWN_WEIGHT * n for t, n in (lines + Counter(set(FILLER.split()))).items()})


def with_known(found: Counter) -> Counter:
    """Mined tokens together with the known ones, which weigh as much as all mined ones however many records were mined."""
    known = known_tokens()
    share = max(1.0, sum(found.values()) / sum(known.values()))
    return found + Counter({t: n * share for t, n in known.items()})


def scores(masked: pa.Array, weights: dict[str, float]) -> tuple[np.ndarray, np.ndarray]:
    """(sum, mean) of the weights of each unit's tokens."""
    tokens = pc.split_pattern(masked, " ")
    coded = tokens.flatten().dictionary_encode()
    table = np.array([weights.get(t, -STRANGE) if t else 0.0 for t in coded.dictionary.to_pylist()])
    if not len(table):
        return np.zeros(0), np.zeros(0)
    offsets = tokens.offsets.to_numpy()
    total = np.add.reduceat(table[coded.indices.to_numpy(zero_copy_only=False)], offsets[:-1])
    return total, total / np.diff(offsets)


def _close(batches: Iterator[pa.RecordBatch], weights: dict[str, float], least: float) -> Iterator[pa.RecordBatch]:
    """(record, leaf, sure, nameless): the units close to the notices, for sure if close enough or worded like a known one."""
    known = pa.array(sorted(filter(None, units(pa.array(KNOWN.split("\n")))[0].to_pylist())), pa.string())
    for batch in batches:
        for part in slices(batch, 1):
            masked, rows = units(pc.fill_null(part.column(1), ""))
            total, mean = scores(masked, weights)
            sure = (total >= LEAST_SCORE) & (mean >= LEAST_MEAN) | pc.is_in(masked, known).to_numpy(zero_copy_only=False)
            at = np.flatnonzero(sure | (total >= least) & (mean >= LEAST_MEAN / 2))
            if len(at):
                path, _ = leaves(masked.take(pa.array(at)))
                nameless = [" 1 " not in f" {x} " for x in masked.take(pa.array(at)).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows[at])), pa.array(path), pa.array(sure[at]), pa.array(nameless, pa.bool_())], ["r", "leaf", "sure", "nameless"])


def fields(notes: DataFrame, key: str, columns: tuple[str, ...], *others: str) -> DataFrame:
    """(key, campo, texto, *others) of the fields that are not null."""
    pairs = F.array(*[F.struct(F.lit(c).alias("campo"), F.col(c).alias("texto")) for c in columns])
    return notes.select(key, *others, F.explode(pairs).alias("f")).select(key, "f.campo", "f.texto", *others).where("texto is not null")


def residue(notes: DataFrame, key: str = "id", columns: tuple[str, ...] = ("cuerpo", "titular"), body: str = "cuerpo", title: str = "titular") -> DataFrame:
    """(key, campo): the fields with residue; ``body`` and ``title`` are counted, those of ``columns`` are reported."""
    pair = F.array(*[F.struct(F.lit(a).alias("campo"), F.col(a).alias("texto"), F.xxhash64(b).alias("o")) for a, b in ((body, title), (title, body))])
    texts = notes.select(F.col(key).cast("long").alias("k"), F.explode(pair).alias("f")).select("k", "f.campo", "f.texto", "f.o").where("texto is not null and texto != ''")
    texts = texts.select(F.xxhash64("k", "campo", "texto").alias("r"), "texto", "k", "campo", "o")
    read = cut(texts.select("r", "texto").mapInArrow(_paths, "r long, leaf array<long>, size array<int>, slot boolean, token string, n long"))
    records = read.where("r is not null")
    whose = texts.select("r", "k", "campo", "o")
    held = records.select("r", F.arrays_zip("leaf", "size").alias("u")).join(whose.select("r", "campo", "o").distinct(), "r").select("r", "campo", "o", F.explode("u").alias("u")).select("r", "campo", "o", "u.leaf", "u.size")
    held = cut(held)
    support = held.groupBy("campo", "leaf", "o").agg(F.count("*").alias("x")).groupBy("campo", "leaf").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)
    support = cut(support)
    # a record says nothing of its own where nearly all of its tokens lie in supported leaves
    covered = held.where(F.col("campo") == body).join(support.where(F.col("campo") == body).select("leaf", F.lit(True).alias("s")), "leaf", "left")
    bare = covered.groupBy("r").agg((F.sum(F.when(F.col("s"), F.col("size")).otherwise(0)) >= BARE * F.sum("size")).alias("bare")).where("bare").select("r")
    bare = cut(bare)
    in_bare = held.join(bare, "r", "left_semi").groupBy("leaf", "o").agg(F.count("*").alias("x")).groupBy("leaf").agg(F.count("*").alias("b"))
    share = F.col("b") / F.col("n")
    # Wilson's lower bound
    low = (share + Z * Z / (2 * F.col("n")) - Z * F.sqrt(share * (1 - share) / F.col("n") + Z * Z / (4 * F.col("n") * F.col("n")))) / (1 + Z * Z / F.col("n"))
    notice = cut(support.where(F.col("campo") == body).join(in_bare, "leaf").where(low >= NOTICE_SHARE).select("leaf"))
    # token weights: a sample of the units of bare records with a notice, against all text
    mined = held.where(F.col("campo") == body).join(notice, "leaf", "left_semi").select("r").distinct()
    sample = texts.join(mined.join(bare, "r", "left_semi"), "r", "left_semi").select("r", "texto").dropDuplicates(["texto"]).orderBy("r").limit(SAMPLE)
    sample = sample.withColumn("held", F.sum(F.octet_length("texto")).over(Window.orderBy("r"))).where(F.col("held") <= SAMPLE_BYTES)  # at most ``SAMPLE`` rows
    guilty = {row["leaf"] for row in notice.orderBy("leaf").limit(SAMPLE).collect()}
    found: Counter = Counter()
    drawn = [row["texto"] for row in sample.select("texto").toLocalIterator()]
    if drawn:
        masked, _ = units(pa.array(drawn, pa.string()))
        path, _ = leaves(masked)
        found.update(t for x, p in zip(masked.to_pylist(), path.tolist(), strict=True) if p in guilty for t in x.split())
    seen = with_known(found)
    others = Counter({row["token"]: row["n"] for row in read.where(F.col("token").isin(list(seen))).groupBy("token").agg(F.sum("n").alias("n")).collect()})
    weights = token_weights(seen, Counter({t: max(others.get(t, 0) - found.get(t, 0), 0) for t in others}) if others else Counter())
    close = cut(texts.select("r", "texto").mapInArrow(lambda b: _close(b, weights, LEAST_SCORE / 2), "r long, leaf long, sure boolean, nameless boolean"))
    titles = support.where(F.col("campo") == title).select("leaf")
    guilty_records = (
        records.where("slot").select("r")
        .unionByName(held.join(notice, "leaf", "left_semi").select("r"))
        .unionByName(close.where("sure").select("r"))
        .unionByName(close.where("nameless").select("r", "leaf").join(titles, "leaf", "left_semi").join(whose.where(F.col("campo") == title).select("r"), "r", "left_semi").select("r"))
        .distinct()
    )
    return whose.where(F.col("campo").isin(list(columns))).join(guilty_records, "r", "left_semi").select(F.col("k").alias(key), "campo")
