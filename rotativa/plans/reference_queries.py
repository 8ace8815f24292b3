"""Queries of the corpus operators over the test tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rotativa.functions import text as T
from rotativa.operators import corpus, entities, graph, lexical, series, similarity, tone
from rotativa.plans import study as S
from rotativa.sources.tables import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def register(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return register


def _list(words: tuple[str, ...]) -> str:
    return "(" + ", ".join("'" + w.replace("'", "''") + "'" for w in words) + ")"


def docs(spark: SparkSession, directory: str, *columns: str) -> DataFrame:
    return table(spark, directory, "documents", "doc_id", *columns)


RUNS = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+')"
TOKENS = f"list_filter({RUNS}, lambda x: regexp_full_match(x, '[a-záéíóúüñ]+'))"
TOKENS3 = f"list_filter({RUNS}, lambda x: regexp_full_match(x, '[a-záéíóúüñ]{{3,}}'))"
FOLD = f"translate(lower({{}}), '{T.MARKED}', '{T.FOLDED}')"
SQUEEZED = r"array_to_string(list_filter(regexp_split_to_array(lower(coalesce({}, '')), '\s+'), lambda x: x <> ''), ' ')"


def _in(words: tuple[str, ...], x: str = "x") -> str:
    return f"{x} IN {_list(words)}"


# ---------------------------------------------------------------- corpus


@query("SELECT medio, count(*) AS n FROM notas GROUP BY medio")
def notes_by_outlet(spark, d):
    return table(spark, d, "notas", "medio").groupBy("medio").agg(F.count("*").alias("n"))


@query("SELECT count(*) AS total, count(*) FILTER (WHERE coalesce(cuerpo, '') <> '') AS with_body, count(sentimiento) AS analysed, count(*) FILTER (WHERE coalesce(cuerpo, '') <> '' AND sentimiento IS NULL) AS pending FROM notas")
def analysis_progress(spark, d):
    body = F.coalesce("cuerpo", F.lit("")) != ""
    return table(spark, d, "notas", "cuerpo", "sentimiento").agg(F.count("*").alias("total"), F.count_if(body).alias("with_body"), F.count("sentimiento").alias("analysed"), F.count_if(body & F.col("sentimiento").isNull()).alias("pending"))


_WHOLE = "coalesce(titular, '') || ' ' || coalesce(cuerpo, '')"
_RELEVANT = "(" + " OR ".join(f"contains({FOLD.format(_WHOLE)}, '{w.translate(str.maketrans(T.MARKED, T.FOLDED))}')" for w in S.RELEVANT) + ") AND NOT (" + " OR ".join(f"contains({FOLD.format(_WHOLE)}, '{w.translate(str.maketrans(T.MARKED, T.FOLDED))}')" for w in S.EXCLUDED) + ")"


def _whole() -> F.Column:
    return F.concat(F.coalesce("titular", F.lit("")), F.lit(" "), F.coalesce("cuerpo", F.lit("")))


@query(f"SELECT id FROM notas WHERE {_RELEVANT}")
def relevance_filter(spark, d):
    return table(spark, d, "notas", "id", "titular", "cuerpo").where(corpus.relevant(_whole(), S.RELEVANT, S.EXCLUDED)).select("id")


@query(f"SELECT count(*) AS irrelevant FROM notas WHERE NOT ({_RELEVANT})")
def irrelevant_count(spark, d):
    return table(spark, d, "notas", "titular", "cuerpo").where(~corpus.relevant(_whole(), S.RELEVANT, S.EXCLUDED)).agg(F.count("*").alias("irrelevant"))


_HASH = f"CASE WHEN {SQUEEZED.format('cuerpo')} = '' THEN '' ELSE substr(sha256({SQUEEZED.format('cuerpo')}), 1, 16) END"


@query(f"SELECT id, {_HASH} AS fingerprint FROM notas")
def content_fingerprint(spark, d):
    return table(spark, d, "notas", "id", "cuerpo").select("id", T.content_hash(F.col("cuerpo")).alias("fingerprint"))


@query(f"""WITH h AS (SELECT id, url, {_HASH} AS h FROM notas), k AS (SELECT h.* FROM h JOIN (SELECT min(id) AS id FROM h GROUP BY url) f ON h.id = f.id)
SELECT id, url FROM k WHERE h = '' OR id IN (SELECT min(id) FROM k WHERE h <> '' GROUP BY h)""")
def content_dedupe(spark, d):
    return corpus.first_captures(table(spark, d, "notas", "id", "url", "cuerpo"), "url", "cuerpo", "id").select("id", "url")


@query("SELECT resultado_id, url FROM resultados r WHERE coalesce(url, '') <> '' AND NOT EXISTS (SELECT 1 FROM notas n WHERE n.url = r.url)")
def pending_urls(spark, d):
    hits = table(spark, d, "resultados", "resultado_id", "url").where("coalesce(url, '') != ''")
    return corpus.not_stored(hits, table(spark, d, "notas", "url"), "url").select("resultado_id", "url")


@query("""SELECT plataforma, id, max(seq) AS seq, max_by(vistas, seq) AS vistas, max_by(likes, seq) AS likes FROM publicaciones GROUP BY plataforma, id""")
def latest_metrics(spark, d):
    posts = table(spark, d, "publicaciones", "plataforma", "id", "seq", "vistas", "likes")
    return posts.groupBy("plataforma", "id").agg(F.max("seq").alias("seq"), F.max_by("vistas", "seq").alias("vistas"), F.max_by("likes", "seq").alias("likes"))


@query(rf"""SELECT id, array_to_string(list_filter(list_transform(string_split(coalesce(cuerpo, ''), chr(10)), lambda x: regexp_replace(x, '^[\s\x{{a0}}]+|[\s\x{{a0}}]+$', '', 'g')), lambda x: x <> '' AND NOT regexp_matches(lower(x), '{S.FURNITURE}')), chr(10) || chr(10)) AS cuerpo FROM notas""")
def clean_body(spark, d):
    return table(spark, d, "notas", "id", "cuerpo").select("id", corpus.clean_body(F.col("cuerpo"), S.FURNITURE).alias("cuerpo"))


_WORDS = r"list_filter(regexp_split_to_array(coalesce(cuerpo, ''), '\s+'), lambda x: x <> '')"


@query(rf"""WITH b AS (SELECT id, coalesce(titular, '') AS t, len({_WORDS}) AS words, len(regexp_extract_all(lower(coalesce(cuerpo, '')), '{S.INTERFACE}')) AS ui, regexp_matches(lower(coalesce(cuerpo, '')), '{S.WALL}') AS wall,
  list_filter(list_transform(string_split(coalesce(cuerpo, ''), chr(10)), lambda x: trim(x)), lambda x: length(x) > 15) AS l, length(coalesce(cuerpo, '')) AS chars,
  length(regexp_replace(coalesce(cuerpo, ''), '[\p{{L}}\p{{N}}\s.,;:!?¡¿()"''«»“”–—-]', '', 'g')) AS odd FROM notas),
s AS (SELECT id, CAST(words AS INTEGER) AS words, CASE WHEN words = 0 THEN 0.0 ELSE round(CAST(greatest(0.0, 1.0 - (
  CASE WHEN words < 120 THEN 0.35 WHEN words < 250 THEN 0.12 ELSE 0.0 END
  + CASE WHEN wall THEN 0.40 ELSE 0.0 END + CASE WHEN ui * 100.0 / greatest(words, 1) > 3 THEN 0.30 WHEN ui * 100.0 / greatest(words, 1) > 1.2 THEN 0.12 ELSE 0.0 END
  + CASE WHEN len(l) > 0 AND len(list_distinct(l)) / CAST(len(l) AS DOUBLE) < 0.6 THEN 0.20 ELSE 0.0 END
  + CASE WHEN odd / CAST(greatest(chars, 1) AS DOUBLE) > 0.08 THEN 0.15 ELSE 0.0 END + CASE WHEN trim(t) = '' THEN 0.08 ELSE 0.0 END)) AS DOUBLE), 2) END AS score,
  CASE WHEN words = 0 THEN 'sin texto' ELSE concat_ws('; ', CASE WHEN words < 120 THEN 'cuerpo corto' WHEN words < 250 THEN 'cuerpo breve' END, CASE WHEN wall THEN 'muro' END, CASE WHEN ui * 100.0 / greatest(words, 1) > 3 THEN 'mucha interfaz' WHEN ui * 100.0 / greatest(words, 1) > 1.2 THEN 'algo de interfaz' END,
    CASE WHEN len(l) > 0 AND len(list_distinct(l)) / CAST(len(l) AS DOUBLE) < 0.6 THEN 'lineas repetidas' END, CASE WHEN odd / CAST(greatest(chars, 1) AS DOUBLE) > 0.08 THEN 'signos extraños' END, CASE WHEN trim(t) = '' THEN 'sin titular' END) END AS reasons FROM b)
SELECT id, words, CAST(score AS DOUBLE) AS score, reasons, CASE WHEN words = 0 THEN 'malo' WHEN score >= 0.75 THEN 'confiable' WHEN score >= 0.45 THEN 'revisar' ELSE 'malo' END AS verdict FROM s""")
def extraction_quality(spark, d):
    return corpus.extraction_quality(table(spark, d, "notas", "id", "titular", "cuerpo"), "id", "cuerpo", "titular", S.INTERFACE, S.WALL)


def _summary_sql(base: str, key: str, value: str) -> str:
    return f"SELECT {key}, count(*) AS n, round(avg({value}), 3) AS mean FROM ({base}) GROUP BY {key}"


@query(_summary_sql(SQL["extraction_quality"], "verdict", "score"))
def quality_summary(spark, d):
    return extraction_quality(spark, d).groupBy("verdict").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("mean"))


@query(rf"""WITH b AS (SELECT id, len({_WORDS}) < 40 AS a, trim(coalesce(fecha_publicacion, '')) = '' AS b, trim(coalesce(titular, '')) = '' AS c, coalesce(metodo_extraccion, '') = 'trafilatura' AS e FROM notas),
s AS (SELECT *, round(greatest(0.0, 1.0::DOUBLE - (CASE WHEN a THEN 0.5::DOUBLE ELSE 0 END + CASE WHEN b THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN c THEN 0.2::DOUBLE ELSE 0 END + CASE WHEN e THEN 0.1::DOUBLE ELSE 0 END)), 2) AS score FROM b)
SELECT id, CAST(score AS DOUBLE) AS score, concat_ws('; ', CASE WHEN a THEN 'texto breve' END, CASE WHEN b THEN 'sin fecha' END, CASE WHEN c THEN 'sin titular' END, CASE WHEN e THEN 'extraccion generica' END) AS reasons,
  CASE WHEN score >= 0.75 THEN 'verde' WHEN score >= 0.45 THEN 'amarillo' ELSE 'rojo' END AS level FROM s""")
def confidence_light(spark, d):
    return corpus.confidence(table(spark, d, "notas", "id", "titular", "cuerpo", "fecha_publicacion", "metodo_extraccion"), "id", "cuerpo", "titular", "fecha_publicacion", "metodo_extraccion", "trafilatura")


_HOST = r"replace(regexp_extract(lower(coalesce({}, '')), '^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)', 1), 'www.', '')"
_TLD = "CASE regexp_extract(h, '([^.]*)$', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in S.TOP_LEVEL.items()) + " END"


@query(f"""WITH b AS (SELECT resultado_id, {_HOST.format('url')} AS h FROM resultados), j AS (SELECT resultado_id, pais AS p, CASE WHEN h <> '' THEN {_TLD} END AS t FROM b LEFT JOIN medios ON dominio = h)
SELECT resultado_id, coalesce(p, t) AS country, coalesce(coalesce(p, t) = 'CO', false) AS domestic, coalesce(coalesce(p, t) <> 'CO', false) AS "foreign", CASE WHEN p IS NOT NULL THEN 'tabla' WHEN t IS NOT NULL THEN 'dominio' ELSE 'desconocido' END AS provenance FROM j""")
def outlet_origin(spark, d):
    return corpus.origin(table(spark, d, "resultados", "resultado_id", "url"), "url", table(spark, d, "medios", "dominio", "pais"), "CO", S.TOP_LEVEL).drop("url")


@query(f'SELECT country, provenance, count(*) AS n FROM ({SQL["outlet_origin"]}) GROUP BY country, provenance')
def origin_summary(spark, d):
    return outlet_origin(spark, d).groupBy("country", "provenance").agg(F.count("*").alias("n"))


@query(f"SELECT coalesce(nullif(medio, ''), {_HOST.format('url')}) AS outlet, count(*) AS n FROM resultados GROUP BY 1")
def hits_by_outlet(spark, d):
    hits = table(spark, d, "resultados", "medio", "url")
    return hits.groupBy(F.coalesce(F.nullif("medio", F.lit("")), T.host(F.col("url"))).alias("outlet")).agg(F.count("*").alias("n"))


@query(f"""WITH a AS (SELECT row_number() OVER (ORDER BY medio) AS ord, medio, dominio FROM medios), r AS (SELECT resultado_id, {_HOST.format('url')} AS h FROM resultados)
SELECT resultado_id, coalesce(min_by(medio, ord), 'generico') AS adapter FROM r LEFT JOIN a ON h = dominio OR ends_with(h, '.' || dominio) GROUP BY resultado_id""")
def adapter_lookup(spark, d):
    from pyspark.sql import Window

    adapters = table(spark, d, "medios", "medio", "dominio").withColumn("ord", F.row_number().over(Window.orderBy("medio")))  # the list of outlets
    return corpus.adapter(table(spark, d, "resultados", "resultado_id", "url"), "url", adapters).select("resultado_id", "adapter")


@query("SELECT seq, plataforma, vistas, likes + comentarios + compartidos AS interacciones FROM (SELECT seq, plataforma, vistas, coalesce(likes, 0) AS likes, coalesce(comentarios, 0) AS comentarios, coalesce(compartidos, 0) AS compartidos FROM publicaciones) WHERE coalesce(vistas, 0) >= 1000 AND likes + comentarios + compartidos >= 50")
def audience_filter(spark, d):
    return corpus.audience(table(spark, d, "publicaciones", "seq", "plataforma", "vistas", "likes", "comentarios", "compartidos"), 1000, 50).select("seq", "plataforma", "vistas", F.col("interacciones"))


@query("SELECT seq, vistas, coalesce(likes, 0) + coalesce(comentarios, 0) + coalesce(compartidos, 0) AS interacciones FROM publicaciones ORDER BY vistas DESC NULLS LAST, interacciones DESC, seq LIMIT 20")
def top_posts(spark, d):
    return corpus.audience(table(spark, d, "publicaciones", "seq", "vistas", "likes", "comentarios", "compartidos"), top=20).select("seq", "vistas", "interacciones")


@query("SELECT 'publicacion' AS origen, coalesce(nullif(url, ''), plataforma || ':' || id) AS url, substr(texto, 1, 120) AS titular, texto AS cuerpo, autor FROM publicaciones")
def posts_as_notes(spark, d):
    posts = table(spark, d, "publicaciones", "url", "plataforma", "id", "texto", "autor")
    return posts.select(F.lit("publicacion").alias("origen"), F.coalesce(F.nullif("url", F.lit("")), F.concat("plataforma", F.lit(":"), "id")).alias("url"), F.substring("texto", 1, 120).alias("titular"), F.col("texto").alias("cuerpo"), "autor")


@query("""SELECT t.term, s.start::DATE AS start, least(s.start::DATE + 6, DATE '2026-07-31') AS "end" FROM (SELECT lower(nombre) AS term FROM entidades_interes WHERE nombre IS NOT NULL GROUP BY 1) t, generate_series(DATE '2025-09-01', DATE '2026-07-31', INTERVAL 7 DAY) s(start)""")
def search_plan(spark, d):
    terms = table(spark, d, "entidades_interes", "nombre").where("nombre is not null").select(F.lower("nombre").alias("term")).distinct()
    return corpus.search_slices("2025-09-01", "2026-07-31", 7, terms)


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY url ORDER BY CASE WHEN starts_with(fuente, 'medio:') THEN 2 WHEN fuente = 'google_news' THEN 0 ELSE 1 END, resultado_id) AS k, try_cast(CASE WHEN regexp_matches(fecha, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') THEN substr(fecha, 1, 10) END AS DATE) AS day FROM resultados WHERE coalesce(url, '') <> '')
SELECT resultado_id, url FROM r WHERE k = 1 AND {_HOST.format('url')} NOT IN ('elfaroharsoigan.co.example') AND (day IS NULL OR day BETWEEN DATE '2025-10-01' AND DATE '2026-06-30') AND (trim(coalesce(titular, '')) = '' OR contains(lower(titular), 'tribunal') OR contains(lower(titular), 'comisión'))""")
def search_hits(spark, d):
    day = F.when(F.col("fecha").rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}"), F.expr("try_to_date(substring(fecha, 1, 10), 'yyyy-MM-dd')"))
    hits = table(spark, d, "resultados", "resultado_id", "url", "titular", "fecha", "fuente")
    return corpus.search_hits(hits, ("elfaroharsoigan.co.example",), F.lit("2025-10-01").cast("date"), F.lit("2026-06-30").cast("date"), day, ("tribunal", "comisión")).select("resultado_id", "url")


@query(r"""SELECT captura_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, array_to_string(list_filter(list_transform(regexp_extract_all(html, '(?is)<p(?:\s[^>]*)?>(.*?)</p>', 1), lambda x: trim(regexp_replace(x, '<[^>]*>', '', 'g'))), lambda x: length(x) > 30), chr(10)) AS body FROM capturas WHERE html IS NOT NULL""")
def html_article(spark, d):
    from rotativa.sources import html

    return html.articles(table(spark, d, "capturas", "captura_id", "html"))


@query("SELECT e.ent_id, e.nombre, CAST(i.i AS INTEGER) AS ord, json_extract_string(e.formas, '$[' || i.i || ']') AS forma FROM entidades_interes e, generate_series(0, CAST(json_array_length(e.formas) AS BIGINT) - 1) i(i) WHERE e.formas IS NOT NULL")
def seed_forms(spark, d):
    seeds = table(spark, d, "entidades_interes", "ent_id", "nombre", "formas")
    return seeds.select("ent_id", "nombre", F.posexplode(F.from_json("formas", "array<string>")).alias("ord", "forma"))


@query("""SELECT nombre, categoria, count(*) AS n, max(score) AS best, max_by(decision, rev_id) AS decision FROM revision_entidades GROUP BY nombre, categoria""")
def review_merge(spark, d):
    rows = table(spark, d, "revision_entidades", "rev_id", "nombre", "categoria", "score", "decision")
    return rows.groupBy("nombre", "categoria").agg(F.count("*").alias("n"), F.max("score").alias("best"), F.max_by("decision", "rev_id").alias("decision"))


_PAIRS = "SELECT nombre, max(CASE WHEN categoria <> '' THEN categoria END) AS a, min(CASE WHEN categoria <> '' THEN categoria END) AS b FROM revision_entidades GROUP BY nombre"


@query(f"""WITH p AS (SELECT a, b, count(*) AS n FROM ({_PAIRS}) WHERE coalesce(a, '') <> '' AND coalesce(b, '') <> '' GROUP BY a, b), t AS (SELECT sum(n) AS n, sum(CASE WHEN a = b THEN n ELSE 0 END) AS same FROM p),
e AS (SELECT coalesce(sum(x.n * CAST(y.n AS DOUBLE)), 0) AS e FROM (SELECT a, sum(n) AS n FROM p GROUP BY a) x JOIN (SELECT b, sum(n) AS n FROM p GROUP BY b) y ON a = b),
k AS (SELECT CAST(n AS BIGINT) AS n, same / CAST(n AS DOUBLE) AS po, e / (CAST(n AS DOUBLE) * n) AS pe FROM t, e)
SELECT n, round(po, 3) AS agreement, CASE WHEN pe >= 1 THEN 1.0 ELSE round((po - pe) / (1.0 - pe), 3) END::DOUBLE AS kappa, CASE WHEN round((po - pe) / (1.0 - pe), 3) < 0 THEN 'pobre' WHEN round((po - pe) / (1.0 - pe), 3) <= 0.2 THEN 'leve' WHEN round((po - pe) / (1.0 - pe), 3) <= 0.4 THEN 'aceptable' WHEN round((po - pe) / (1.0 - pe), 3) <= 0.6 THEN 'moderada' WHEN round((po - pe) / (1.0 - pe), 3) <= 0.8 THEN 'sustancial' ELSE 'casi perfecta' END AS strength FROM k""")
def category_kappa(spark, d):
    known = F.when(F.col("categoria") != "", F.col("categoria"))
    pairs = table(spark, d, "revision_entidades", "nombre", "categoria").groupBy("nombre").agg(F.max(known).alias("a"), F.min(known).alias("b"))
    return corpus.kappa(pairs, "a", "b")


@query("SELECT doc_id FROM documents ORDER BY md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR))), doc_id LIMIT 30")
def coding_sample(spark, d):
    return corpus.seeded_sample(docs(spark, d), "doc_id", 30)


# ---------------------------------------------------------------- lexical

_TERMS = f"SELECT doc_id, unnest({TOKENS3}) AS term FROM documents"


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM ({_TERMS}) WHERE NOT term IN {_list(S.STOPWORDS)} GROUP BY term")
def term_frequencies(spark, d):
    return lexical.term_frequencies(docs(spark, d, "text"), S.STOPWORDS)


@query(f"SELECT term, count(*) AS tf, count(DISTINCT doc_id) AS df FROM ({_TERMS}) WHERE NOT term IN {_list(S.STOPWORDS)} GROUP BY term ORDER BY tf DESC, term LIMIT 25")
def top_terms(spark, d):
    return lexical.term_frequencies(docs(spark, d, "text"), S.STOPWORDS, 25)


@query(f"SELECT doc_id, term, n, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, term) AS INTEGER) AS rank FROM (SELECT doc_id, term, count(*) AS n FROM ({_TERMS}) WHERE NOT term IN {_list(S.STOPWORDS)} GROUP BY doc_id, term)) WHERE rank <= 5")
def document_terms(spark, d):
    return lexical.document_terms(docs(spark, d, "text"), S.STOPWORDS)


def _ngram_sql(n: int) -> str:
    return f"SELECT ngram, count(*) AS n FROM (SELECT array_to_string(t[i:i + {n - 1}], ' ') AS ngram FROM (SELECT t, unnest(generate_series(1, len(t) - {n - 1})) AS i FROM (SELECT {TOKENS3} AS t FROM documents) WHERE len(t) >= {n})) GROUP BY ngram"


@query(_ngram_sql(2) + " HAVING count(*) >= 2")
def bigrams(spark, d):
    return lexical.ngram_frequencies(docs(spark, d, "text"), 2)


@query(f"SELECT * FROM ({_ngram_sql(3)} ORDER BY n DESC, ngram LIMIT 30) WHERE n >= 2")
def top_trigrams(spark, d):
    return lexical.ngram_frequencies(docs(spark, d, "text"), 3, top=30)


_PLACED = f"(SELECT doc_id, t, unnest(generate_series(1, len(t))) AS i FROM (SELECT doc_id, {TOKENS3} AS t FROM documents))"


@query(f"""WITH p AS (SELECT t, i FROM {_PLACED} WHERE t[i] = 'tribunal'), nb AS (SELECT unnest(list_concat(t[greatest(i - 6, 1):i - 1], t[i + 1:i + 6])) AS term FROM p),
f AS (SELECT term, count(*) AS freq FROM nb WHERE term <> 'tribunal' AND NOT term IN {_list(S.STOPWORDS)} GROUP BY term ORDER BY freq DESC, term LIMIT 45),
c AS (SELECT term, count(*) AS tf FROM ({_TERMS}) WHERE NOT term IN {_list(S.STOPWORDS)} GROUP BY term), t AS (SELECT sum(tf) AS total, coalesce(max(CASE WHEN term = 'tribunal' THEN tf END), 1) AS w FROM c)
SELECT f.term, freq, round(log2((freq / CAST((SELECT count(*) FROM p) AS DOUBLE)) / ((coalesce(tf, 1) / CAST(total AS DOUBLE)) * (w / CAST(total AS DOUBLE)) + 1e-10) + 1e-10), 3) AS pmi FROM f LEFT JOIN c ON f.term = c.term, t ORDER BY pmi DESC, f.term LIMIT 15""")
def collocates_pmi(spark, d):
    return lexical.collocates(docs(spark, d, "text"), "tribunal", 6, S.STOPWORDS, 15)


_KEPT = f"(SELECT doc_id, list_filter({TOKENS3}, lambda x: NOT x IN {_list(S.STOPWORDS)}) AS t FROM documents)"


@query(f"""WITH p AS (SELECT t, unnest(generate_series(1, len(t))) AS i FROM {_KEPT}), top AS (SELECT t[i] AS term FROM p GROUP BY 1 ORDER BY count(*) DESC, term LIMIT 40),
e AS (SELECT t[i] AS a, unnest(list_concat(t[greatest(i - 5, 1):i - 1], t[i + 1:i + 5])) AS b FROM p WHERE t[i] IN (SELECT term FROM top))
SELECT least(a, b) AS source, greatest(a, b) AS target, count(*) AS weight FROM e WHERE b IN (SELECT term FROM top) GROUP BY 1, 2 HAVING count(*) >= 2""")
def lexical_network(spark, d):
    return lexical.lexical_network(docs(spark, d, "text"), 5, S.STOPWORDS)


@query(r"""WITH p AS (SELECT doc_id, text, string_split(lower(text), 'querella') AS s FROM documents WHERE contains(lower(text), 'querella')),
o AS (SELECT doc_id, text, CAST(length(array_to_string(s[1:k], 'querella')) AS INTEGER) AS "at" FROM (SELECT *, unnest(generate_series(1, len(s) - 1)) AS k FROM p))
SELECT doc_id, "at", trim(regexp_replace(substr(text, greatest("at" - 60, 0) + 1, least("at", 60)), '[\r\n]+', ' ', 'g')) AS "left", substr(text, "at" + 1, 8) AS match, trim(regexp_replace(substr(text, "at" + 9, 60), '[\r\n]+', ' ', 'g')) AS "right" FROM o""")
def kwic(spark, d):
    return lexical.concordance(docs(spark, d, "text"), "querella", 60)


@query(r"""WITH o AS (SELECT doc_id, lower(coalesce(text, '')) AS low, sum(length(coalesce(text, '')) + 1) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS start, sum(length(coalesce(text, '')) + 1) OVER () AS total FROM documents),
w AS (SELECT unnest(['hospital', 'querella']) AS literal), p AS (SELECT literal, doc_id, start, total, string_split(low, literal) AS s FROM o, w WHERE contains(low, literal)),
q AS (SELECT *, CAST(list_sum(list_transform(s[1:k], lambda x: length(x))) + (k - 1) * length(literal) AS INTEGER) AS "at" FROM (SELECT *, unnest(generate_series(1, len(s) - 1)) AS k FROM p))
SELECT literal, doc_id, "at", round((coalesce(start, 0) + "at") / CAST(greatest(total - 1, 1) AS DOUBLE), 6) AS position FROM q""")
def dispersion(spark, d):
    return lexical.dispersion(docs(spark, d, "text"), ["hospital", "querella"])


@query("SELECT literal, strftime(fecha, '%Y-%m') AS month, CAST(sum(len(string_split(lower(coalesce(text, '')), literal)) - 1) AS BIGINT) AS n FROM documents, (SELECT unnest(['tribunal', 'hospital']) AS literal) WHERE fecha IS NOT NULL GROUP BY 1, 2")
def term_months(spark, d):
    return lexical.term_months(docs(spark, d, "text", "fecha"), ["tribunal", "hospital"])


# ---------------------------------------------------------------- tone

_SIGN = f"CASE WHEN {_in(S.LEXICON.positive, 't[i]')} THEN 1 WHEN {_in(S.LEXICON.negative, 't[i]')} THEN -1 ELSE 0 END"


def _signed(tokens_sql: str, keys: str) -> str:
    """p and n of token arrays ``t`` by ``keys``."""
    return f"""SELECT {keys}, len(t) AS size, coalesce(len(list_filter(s, lambda x: x > 0)), 0) AS p, coalesce(len(list_filter(s, lambda x: x < 0)), 0) AS n FROM (
  SELECT {keys}, t, list_transform(generate_series(1, len(t)), lambda i: {_SIGN} * CASE WHEN len(list_filter(t[greatest(i - {S.LEXICON.reach}, 1):i - 1], lambda x: {_in(S.LEXICON.negators)})) > 0 THEN -1 ELSE 1 END) AS s FROM ({tokens_sql}))"""


_SCORE = "CASE WHEN p + n > 0 THEN round((p - n) / CAST(p + n AS DOUBLE), 3) ELSE 0.0 END"
_LABEL = "CASE WHEN score > 0.15 THEN 'positivo' WHEN score < -0.15 THEN 'negativo' ELSE 'neutro' END"
_POLARITY = f"SELECT doc_id, CAST(p AS INTEGER) AS positive, CAST(n AS INTEGER) AS negative, CAST({_SCORE} AS DOUBLE) AS score, round((p + n) * 100.0::DOUBLE / greatest(size, 1), 2) AS intensity FROM ({_signed(f'SELECT doc_id, {TOKENS} AS t FROM documents', 'doc_id')})"


@query(f"SELECT *, {_LABEL} AS label FROM ({_POLARITY})")
def polarity_lexicon(spark, d):
    return tone.polarity_of(docs(spark, d, "text"), S.LEXICON)


_TOWARDS = f"""SELECT doc_id, source, actor, mentions, CAST({_SCORE} AS DOUBLE) AS score FROM ({_signed(f'''SELECT doc_id, source, actor, CAST(len(pl) AS INTEGER) AS mentions, list_filter(flatten(list_transform(pl, lambda p: t[greatest(p - 25, 1):least(len(t), p + 24)])), lambda x: regexp_full_match(x, '[a-záéíóúüñ]+')) AS t
  FROM (SELECT doc_id, source, actor, t, list_filter(generate_series(1, len(t)), lambda i: t[i] = k) AS pl FROM (SELECT doc_id, source, {RUNS} AS t FROM documents), (VALUES {', '.join(f"('{a}', '{k}')" for a, k in S.ACTORS.items())}) v(actor, k)) WHERE len(pl) > 0''', 'doc_id, source, actor, mentions')})"""


@query(f"SELECT doc_id, actor, mentions, score, {_LABEL} AS label FROM ({_TOWARDS})")
def polarity_towards(spark, d):
    return tone.polarity_towards(docs(spark, d, "text"), S.ACTORS, S.LEXICON)


@query(f"""WITH g AS (SELECT source, CAST(count(*) FILTER (WHERE actor = 'Tribunal') AS BIGINT) AS n_a, round(avg(score) FILTER (WHERE actor = 'Tribunal'), 3) AS tone_a, CAST(count(*) FILTER (WHERE actor = 'Sindicato') AS BIGINT) AS n_b, round(avg(score) FILTER (WHERE actor = 'Sindicato'), 3) AS tone_b FROM ({_TOWARDS}) GROUP BY source)
SELECT *, round(tone_a - tone_b, 3) AS bias, CASE WHEN round(tone_a - tone_b, 3) >= 0.1 THEN 'Tribunal' WHEN round(tone_a - tone_b, 3) <= -0.1 THEN 'Sindicato' END AS favours FROM g""")
def outlet_bias(spark, d):
    return tone.outlet_bias(docs(spark, d, "text", "source"), S.ACTORS, S.LEXICON)


def _counts(lists: dict[str, tuple[str, ...]]) -> str:
    return ", ".join(f"CAST(len(list_filter(t, lambda x: {_in(w)})) AS INTEGER) AS {k}" for k, w in lists.items())


def _dominant(names: list[str]) -> str:
    return f"CASE WHEN greatest({', '.join(names)}) > 0 THEN CASE " + " ".join(f"WHEN {n} = greatest({', '.join(names)}) THEN '{n}'" for n in names) + " END END"


_EMOTIONS = list(S.LEXICON.emotions)


@query(f"""WITH c AS (SELECT doc_id, {_counts(S.LEXICON.emotions | {'s_': S.LEXICON.subjective, 'f_': S.LEXICON.factual})} FROM (SELECT doc_id, {TOKENS3} AS t FROM documents)), r AS (SELECT *, round(s_ / CAST(s_ + f_ + 1 AS DOUBLE), 3) AS subjectivity FROM c)
SELECT doc_id, {', '.join(_EMOTIONS)}, {' + '.join(_EMOTIONS)} AS hits, {_dominant(_EMOTIONS)} AS dominant, subjectivity, CASE WHEN subjectivity >= 0.6 THEN 'subjetivo' WHEN subjectivity >= 0.3 THEN 'mixto' ELSE 'factual' END AS discourse FROM r""")
def emotions(spark, d):
    return tone.emotions(docs(spark, d, "text"), S.LEXICON)


@query(rf"""WITH s AS (SELECT doc_id, list_filter(list_transform(regexp_split_to_array(coalesce(text, ''), '[.!?]+'), lambda x: trim(x)), lambda x: length(x) > 20) AS s FROM documents),
h AS (SELECT doc_id, len(s) AS sentences, len(list_filter(s, lambda y: len(list_filter(regexp_extract_all(lower(y), '[\p{{L}}\p{{N}}_]+'), lambda x: regexp_full_match(x, '[a-záéíóúüñ]{{3,}}') AND {_in(S.LEXICON.subjective)})) > 0)) AS subjective FROM s)
SELECT doc_id, CAST(sentences AS INTEGER) AS sentences, CAST(subjective AS INTEGER) AS subjective, round(subjective / CAST(greatest(sentences, 1) AS DOUBLE), 3) AS share FROM h""")
def sentence_subjectivity(spark, d):
    return tone.sentence_subjectivity(docs(spark, d, "text"), S.LEXICON)


_ABSOLUTES = ("nadie", "siempre", "nunca", "todo", "nothing")


@query(rf"""WITH c AS (SELECT doc_id, CAST(len(list_filter(t, lambda x: regexp_full_match(x, '[a-záéíóúüñ]+ísim[oa]s?'))) AS INTEGER) AS superlatives, CAST(len(string_split(coalesce(text, ''), '!')) - 1 AS INTEGER) AS exclamations, CAST(len(list_filter(t, lambda x: {_in(_ABSOLUTES)})) AS INTEGER) AS absolutes, regexp_matches(coalesce(text, ''), '[!?]{{2,}}') AS repeated FROM (SELECT doc_id, text, {TOKENS} AS t FROM documents))
SELECT *, round(least(1.0::DOUBLE, 0.1::DOUBLE * least(superlatives, 5) + 0.05::DOUBLE * least(exclamations, 5) + 0.08::DOUBLE * least(absolutes, 5) + CASE WHEN repeated THEN 0.15::DOUBLE ELSE 0.0::DOUBLE END), 3) AS score FROM c""")
def intensity(spark, d):
    return tone.intensity(docs(spark, d, "text"), _ABSOLUTES)


_FRAMES = list(S.LEXICON.frames)
_FRAME_SQL = f"SELECT *, {' + '.join(_FRAMES)} AS total, {_dominant(_FRAMES)} AS frame FROM (SELECT doc_id, source, " + ", ".join(f"CAST(len(list_filter(t, lambda x: regexp_matches(x, '^(?:{'|'.join(m)})'))) AS INTEGER) AS {k}" for k, m in S.LEXICON.frames.items()) + f" FROM (SELECT doc_id, source, {RUNS} AS t FROM documents))"


@query(f"SELECT * EXCLUDE (source) FROM ({_FRAME_SQL})")
def frames(spark, d):
    return tone.frames(docs(spark, d, "text"), S.LEXICON)


@query("SELECT source, " + ", ".join(f"CAST(count(*) FILTER (WHERE frame = '{k}') AS BIGINT) AS {k}" for k in _FRAMES) + f" FROM ({_FRAME_SQL}) WHERE frame IS NOT NULL GROUP BY source")
def outlet_frames(spark, d):
    return tone.outlet_frames(docs(spark, d, "text", "source"), S.LEXICON)


@query(f"SELECT doc_id, {', '.join(S.LEXICON.groups)}, round(({' + '.join(S.LEXICON.groups)}) * 100.0::DOUBLE / greatest(size, 1), 2) AS density FROM (SELECT doc_id, len(t) AS size, {_counts(S.LEXICON.groups)} FROM (SELECT doc_id, {TOKENS} AS t FROM documents))")
def intergroup(spark, d):
    return tone.intergroup(docs(spark, d, "text"), S.LEXICON)


@query(f"""WITH l AS (SELECT source, {_LABEL} AS label FROM (SELECT doc_id, score FROM ({_POLARITY})) JOIN documents USING (doc_id)), c AS (SELECT source, CAST(count(*) FILTER (WHERE label = 'positivo') AS BIGINT) AS positive, CAST(count(*) FILTER (WHERE label = 'negativo') AS BIGINT) AS negative, CAST(count(*) FILTER (WHERE label = 'neutro') AS BIGINT) AS neutral FROM l GROUP BY source)
SELECT *, round(CASE WHEN positive + negative > 0 THEN ((positive + negative) / CAST(positive + negative + neutral AS DOUBLE)) * (1.0 - abs(positive - negative) / CAST(positive + negative AS DOUBLE)) ELSE 0.0 END, 3) AS index FROM c""")
def affective_polarization(spark, d):
    return tone.affective_polarization(docs(spark, d, "text", "source"), S.LEXICON)


@query("""WITH m AS (SELECT event_type, date_trunc('day', ts)::DATE AS day, avg(value) AS v FROM events GROUP BY 1, 2), i AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY day) - 1 AS i FROM m), g AS (SELECT event_type, count(*) AS periods, round(regr_slope(v, i), 4) AS slope FROM i GROUP BY 1)
SELECT *, CASE WHEN slope > 0.5 THEN 'sube' WHEN slope < -0.5 THEN 'baja' ELSE 'estable' END AS trend FROM g""")
def tone_slope(spark, d):
    days = table(spark, d, "events", "ts", "event_type", "value").groupBy("event_type", F.to_date("ts").alias("day")).agg(F.avg("value").alias("v"))
    return tone.tone_slope(days, "event_type", "day", "v")


# ---------------------------------------------------------------- series


@query("SELECT strftime(fecha, '%Y-%m') AS month, CAST(NULL AS VARCHAR) AS kind, count(*) AS n FROM documents WHERE fecha IS NOT NULL GROUP BY 1 UNION ALL SELECT strftime(fecha, '%Y-%m'), tipo, count(*) FROM documents WHERE fecha IS NOT NULL AND tipo IS NOT NULL GROUP BY 1, 2")
def monthly_series(spark, d):
    return series.monthly(docs(spark, d, "fecha", "tipo"), "fecha", "tipo")


_DAILY = """WITH r AS (SELECT fecha::DATE AS day, n_chars FROM documents WHERE fecha IS NOT NULL), c AS (SELECT unnest(generate_series((SELECT min(day) FROM r), (SELECT max(day) FROM r), INTERVAL 1 DAY))::DATE AS day),
s AS (SELECT day, count(*) AS volume, avg(CAST(n_chars AS DOUBLE)) AS mean FROM r GROUP BY day), g AS (SELECT c.day, CAST(coalesce(volume, 0) AS BIGINT) AS volume, round(mean, 3) AS mean FROM c LEFT JOIN s ON c.day = s.day)"""


def _daily(spark, d):
    rows = docs(spark, d, "fecha", "n_chars").where("fecha is not null").select(F.to_date("fecha").alias("day"), "n_chars")
    return series.daily(rows, "day", F.col("n_chars").cast("double"))


@query(_DAILY + " SELECT *, round(avg(CAST(volume AS DOUBLE)) OVER (ORDER BY day ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 3) AS volume_ma FROM g")
def daily_series(spark, d):
    return series.moving_average(_daily(spark, d), "day", "volume")


@query(_DAILY + " SELECT day, volume, mean FROM g, (SELECT avg(CAST(volume AS DOUBLE)) AS m, stddev_pop(CAST(volume AS DOUBLE)) AS s FROM g) WHERE volume > m + 1.5 * s")
def volume_peaks(spark, d):
    return series.peaks(_daily(spark, d), "day", "volume")


@query("SELECT fecha::DATE AS day, tipo AS kind, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY fecha::DATE), 1) AS pct FROM documents WHERE fecha IS NOT NULL AND tipo IS NOT NULL GROUP BY 1, 2")
def daily_shares(spark, d):
    return series.shares(docs(spark, d, "fecha", "tipo").select(F.to_date("fecha").alias("day"), F.col("tipo").alias("kind")), "day", "kind")


@query("""WITH s AS (SELECT source, fecha::DATE AS day, count(*) AS volume, avg(CAST(n_chars AS DOUBLE)) AS mean FROM documents WHERE fecha IS NOT NULL GROUP BY 1, 2)
SELECT day, CAST(sum(volume) AS BIGINT) AS volume, round(sum(mean * CASE WHEN mean IS NOT NULL THEN volume END) / sum(CASE WHEN mean IS NOT NULL THEN volume END), 3) AS mean FROM s GROUP BY day""")
def combined_outlets(spark, d):
    rows = docs(spark, d, "fecha", "n_chars", "source").where("fecha is not null").groupBy("source", F.to_date("fecha").alias("day")).agg(F.count("*").alias("volume"), F.avg(F.col("n_chars").cast("double")).alias("mean"))
    return series.combined(rows, "day", "volume", "mean")


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def event_days(spark, d):
    return series.event_windows(table(spark, d, "events", "ts", "event_type"), "ts", "1 day", None, "event_type")


@query("""WITH e AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 1 HOUR THEN 0 ELSE 1 END AS b FROM events WHERE ts IS NOT NULL AND user_id IS NOT NULL), g AS (SELECT *, sum(b) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM e)
SELECT user_id, min(ts) AS start, max(ts) + INTERVAL 1 HOUR AS "end", count(*) AS n FROM g GROUP BY user_id, s""")
def event_sessions(spark, d):
    return series.sessions(table(spark, d, "events", "ts", "user_id").where("user_id is not null"), "ts", "1 hour", "user_id")


# ---------------------------------------------------------------- entities and graphs

_NAME = r"\p{Lu}[\p{Ll}\p{Lu}]+(?: \p{Lu}[\p{Ll}\p{Lu}]+)+"
_MENTIONS = f"(SELECT doc_id, unnest(regexp_extract_all(coalesce(text, ''), '{_NAME}')) AS entity FROM documents)"
_NOISE = rf"""CASE WHEN trim(entity) = '' THEN 'vacia' WHEN lower(entity) IN {_list(S.CONNECTORS)} THEN 'conector' WHEN regexp_matches(entity, '\d') THEN 'cifra' WHEN regexp_matches(entity, '^[¿¡?!]') THEN 'signo' WHEN regexp_matches(entity, '^\p{{Ll}}') THEN 'minuscula'
 WHEN lower(string_split(trim(entity), ' ')[1]) IN {_list(S.CONNECTORS)} THEN 'comienzo' WHEN length(entity) <= 2 THEN 'corta' WHEN len(string_split(trim(entity), ' ')) > 5 THEN 'larga' END"""
_INDEX = f"SELECT entity, doc_id, count(*) AS n FROM {_MENTIONS} WHERE {_NOISE} IS NULL GROUP BY entity, doc_id"


@query(f"SELECT entity, {_NOISE} AS reason, count(*) AS n FROM {_MENTIONS} GROUP BY 1, 2 HAVING reason IS NOT NULL")
def entity_noise(spark, d):
    return entities.mentions(docs(spark, d, "text")).select("entity", entities.noise(F.col("entity"), S.CONNECTORS).alias("reason")).where("reason is not null").groupBy("entity", "reason").agg(F.count("*").alias("n"))


@query(_INDEX)
def entity_index(spark, d):
    return entities.entity_index(docs(spark, d, "text"), S.CONNECTORS)


@query(rf"""WITH i AS ({_INDEX}), f AS (SELECT {FOLD.format("trim(json_extract_string(e.formas, '$[' || g.i || ']'))")} AS v, min(e.nombre) AS canonical FROM entidades_interes e, generate_series(0, CAST(json_array_length(e.formas) AS BIGINT) - 1) g(i) WHERE e.formas IS NOT NULL GROUP BY 1)
SELECT coalesce(canonical, entity) AS entity, doc_id, CAST(sum(n) AS BIGINT) AS n FROM i LEFT JOIN f ON v = {FOLD.format('trim(entity)')} GROUP BY 1, 2""")
def canonical_index(spark, d):
    forms = table(spark, d, "entidades_interes", "nombre", "formas").select(F.explode(F.from_json("formas", "array<string>")).alias("variant"), F.col("nombre").alias("canonical"))
    return entities.canonical(entity_index(spark, d), forms)


@query(f"""WITH i AS ({_INDEX}), n AS (SELECT entity, count(*) AS docs, string_split(entity, ' ') AS t FROM i GROUP BY entity), s AS (SELECT entity, docs, array_to_string(t[-k:], ' ') AS short FROM (SELECT *, unnest(generate_series(2, len(t) - 1)) AS k FROM n WHERE len(t) > 2)),
b AS (SELECT short, entity AS leader FROM s QUALIFY row_number() OVER (PARTITION BY short ORDER BY docs DESC, length(entity) DESC, entity DESC) = 1)
SELECT n.entity, coalesce(leader, n.entity) AS leader FROM n LEFT JOIN b ON n.entity = short""")
def containment_groups(spark, d):
    return entities.containment_groups(entity_index(spark, d))


@query(f"""WITH i AS ({_INDEX}), top AS (SELECT entity FROM i GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 8)
SELECT coalesce(source, '?') AS source, entity AS actor, count(*) AS n FROM i JOIN documents USING (doc_id) WHERE entity IN (SELECT entity FROM top) GROUP BY 1, 2""")
def outlet_actor_matrix(spark, d):
    return entities.outlet_actors(entity_index(spark, d), docs(spark, d, "source"))


@query()
def prominence_rank(spark, d):
    return entities.prominence(docs(spark, d, "text"), S.PEOPLE)


@query()
def prominence_summary(spark, d):
    return entities.prominence_summary(prominence_rank(spark, d))


@query(r"""WITH q AS (SELECT doc_id, unnest(list_distinct(list_transform(list_concat(regexp_extract_all(coalesce(text, ''), '«([^«»]{20,500})»', 1), regexp_extract_all(coalesce(text, ''), '“([^“”]{20,500})”', 1), regexp_extract_all(coalesce(text, ''), '"([^"]{20,500})"', 1), regexp_extract_all(coalesce(text, ''), '(?:^|[^\p{L}\p{N}])''([^'']{20,500})''(?:$|[^\p{L}\p{N}])', 1)), lambda x: trim(x)))) AS quote FROM documents)
SELECT quote, count(*) AS documents FROM q WHERE len(list_filter(regexp_split_to_array(quote, '\s+'), lambda x: x <> '')) >= 5 GROUP BY quote HAVING count(*) >= 2""")
def shared_quotes(spark, d):
    return entities.shared_quotes(docs(spark, d, "text"))


_EDGES = f"WITH i AS ({_INDEX}) SELECT a.entity AS src, b.entity AS dst, count(*) AS weight FROM i a JOIN i b ON a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY 1, 2 HAVING count(*) >= 2"


def _edges(spark, d):
    return graph.cooccurrence(entity_index(spark, d), "doc_id", "entity", 2)


@query(_EDGES)
def cooccurrence_edges(spark, d):
    return _edges(spark, d)


_WAYS = f"e AS ({_EDGES}), w AS (SELECT src, dst, weight FROM e UNION ALL SELECT dst, src, weight FROM e)"


@query(f"WITH {_WAYS}, g AS (SELECT src AS node, count(*) AS degree, CAST(sum(weight) AS BIGINT) AS strength FROM w GROUP BY src) SELECT *, round(degree / CAST(greatest((SELECT count(*) FROM g) - 1, 1) AS DOUBLE), 4) AS centrality FROM g")
def graph_degrees(spark, d):
    return graph.degrees(_edges(spark, d))


@query(f"WITH {_WAYS}, s AS (SELECT count(DISTINCT src) AS nodes, (SELECT count(*) FROM e) AS edges FROM w) SELECT nodes, edges, round(CASE WHEN nodes > 1 THEN 2.0::DOUBLE * edges / (CAST(nodes AS DOUBLE) * (nodes - 1)) ELSE 0.0 END, 4) AS density, round(CASE WHEN nodes > 0 THEN 2.0::DOUBLE * edges / nodes ELSE 0.0 END, 4) AS mean_degree FROM s")
def graph_summary(spark, d):
    return graph.summary(_edges(spark, d))


@query(f"WITH RECURSIVE {_WAYS}, r(node, reached) AS (SELECT DISTINCT src, src FROM w UNION SELECT r.node, w.dst FROM r JOIN w ON r.reached = w.src) SELECT node, min(reached) AS component FROM r GROUP BY node")
def graph_components(spark, d):
    return graph.components(_edges(spark, d))


@query()
def graph_pagerank(spark, d):
    return graph.pagerank(_edges(spark, d)).select("node", F.round("rank", 9).alias("rank"))


@query(f"""WITH {_WAYS}, dg AS (SELECT src AS node, count(*) AS k FROM w GROUP BY src), t AS (SELECT a.src AS node, count(*) / 2 AS c FROM w a JOIN w b ON a.src = b.src AND a.dst <> b.dst JOIN w c ON c.src = a.dst AND c.dst = b.dst GROUP BY a.src)
SELECT dg.node, CAST(coalesce(c, 0) AS BIGINT) AS triangles, round(CASE WHEN k > 1 THEN 2.0::DOUBLE * coalesce(c, 0) / (CAST(k AS DOUBLE) * (k - 1)) ELSE 0.0 END, 4) AS coefficient FROM dg LEFT JOIN t ON dg.node = t.node""")
def graph_clustering(spark, d):
    return graph.cooccurrence_clustering(entity_index(spark, d), "doc_id", "entity", 2)


# ---------------------------------------------------------------- similarity


@query(rf"""WITH u AS (SELECT min(doc_id) AS doc_id, any_value(text) AS text FROM documents WHERE trim(coalesce(text, '')) <> '' GROUP BY sha256(text)), t AS (SELECT doc_id, list_filter({RUNS}, lambda x: length(x) >= 2) AS t FROM u),
g AS (SELECT doc_id, unnest(list_concat(t, CASE WHEN len(t) > 1 THEN list_transform(generate_series(1, len(t) - 1), lambda i: t[i] || ' ' || t[i + 1]) ELSE [] END)) AS term FROM t), r AS (SELECT doc_id, term, count(*) AS n FROM g GROUP BY 1, 2),
v AS (SELECT term, sum(n) AS tf, count(*) AS df FROM r GROUP BY term HAVING count(*) >= 2 ORDER BY tf DESC, term LIMIT 200000), x AS (SELECT doc_id, r.term, (1 + ln(n)) * (ln((1.0 + (SELECT count(*) FROM u)) / (1.0 + df)) + 1.0) AS w FROM r JOIN v ON r.term = v.term),
y AS (SELECT doc_id, term, w / sqrt(sum(w * w) OVER (PARTITION BY doc_id)) AS w FROM x)
SELECT a.doc_id AS doc_id_a, b.doc_id AS doc_id_b, round(sum(a.w * b.w), 4) AS similarity FROM y a JOIN y b ON a.term = b.term AND a.doc_id < b.doc_id GROUP BY 1, 2 HAVING round(sum(a.w * b.w), 4) >= 0.8""")
def similar_pairs(spark, d):
    return similarity.similar_pairs(docs(spark, d, "text"))


@query()
def authorship_attribution(spark, d):
    return similarity.attribution(docs(spark, d, "text", "source", "lang"), "source", "lang is null")


@query()
def embedding_clusters(spark, d):
    from rotativa.sources.tables import table as t

    e = t(spark, d, "embeddings")
    vector = next(f.name for f in e.schema.fields if f.dataType.typeName() == "array")
    return similarity.clusters(e, e.columns[0], vector)


@query()
def corpus_topics(spark, d):
    return similarity.topics(docs(spark, d, "text"), S.STOPWORDS)


# ---------------------------------------------------------------- roll-ups of annotations

_LABELLED = f"(SELECT doc_id, source, lang, strftime(fecha, '%Y-%m') AS month, {_LABEL} AS label FROM ({_POLARITY}) JOIN documents USING (doc_id))"


def _labelled(spark, d):
    rows = docs(spark, d, "text", "source", "lang", "fecha")
    return rows.select("doc_id", "source", "lang", F.date_format("fecha", "yyyy-MM").alias("month"), tone.polarity(T.tokens(F.col("text")), S.LEXICON)["label"].alias("label"))


def _distribution_sql(group: str) -> str:
    return f"SELECT {group}, label, n, round(n * 100.0::DOUBLE / sum(n) OVER (PARTITION BY {group}), 1) AS pct FROM (SELECT {group}, label, count(*) AS n FROM {_LABELLED} GROUP BY 1, 2)"


@query(_distribution_sql("source"))
def tone_by_outlet(spark, d):
    return tone.distribution(_labelled(spark, d), "source", "label")


@query(_distribution_sql("month"))
def tone_by_month(spark, d):
    return tone.distribution(_labelled(spark, d), "month", "label")


@query(f"""WITH s AS ({_distribution_sql('lang')}), c AS (SELECT label, coalesce(max(CASE WHEN lang = 'es' THEN pct END), 0.0) AS pct_a, coalesce(max(CASE WHEN lang = 'en' THEN pct END), 0.0) AS pct_b FROM s WHERE lang IN ('es', 'en') GROUP BY label)
SELECT *, round(pct_b - pct_a, 1) AS delta FROM c""")
def tone_compared(spark, d):
    return tone.compared(_labelled(spark, d), "lang", "label", "es", "en")


@query("""SELECT json_extract_string(sentimiento, '$.polaridad') AS polaridad, count(*) AS n, round(avg(CAST(json_extract_string(sentimiento, '$.score') AS DOUBLE)), 3) AS score FROM notas WHERE sentimiento IS NOT NULL GROUP BY 1""")
def stored_polarity(spark, d):
    rows = tone.stored_annotations(table(spark, d, "notas", "id", "sentimiento"), "id", "sentimiento", "polaridad string, score double")
    return rows.groupBy("polaridad").agg(F.count("*").alias("n"), F.round(F.avg("score"), 3).alias("score"))


_STORED = """SELECT DISTINCT id, categoria, json_extract_string(ner, '$.' || categoria || '[' || g.i || ']') AS entidad FROM notas, (VALUES ('personas'), ('lugares'), ('organizaciones')) v(categoria), generate_series(0, CAST(json_array_length(ner, '$.' || categoria) AS BIGINT) - 1) g(i) WHERE ner IS NOT NULL AND json_array_length(ner, '$.' || categoria) > 0"""


@query(_STORED)
def stored_entities(spark, d):
    rows = tone.stored_annotations(table(spark, d, "notas", "id", "ner"), "id", "ner", "personas array<string>, lugares array<string>, organizaciones array<string>")
    lists = F.array(*[F.struct(F.lit(c).alias("categoria"), F.col(c).alias("l")) for c in ("personas", "lugares", "organizaciones")])
    return rows.select("id", F.explode(lists).alias("x")).select("id", "x.categoria", F.explode("x.l").alias("entidad")).distinct()


@query(f"SELECT categoria, entidad, count(*) AS n, string_agg(CAST(id AS VARCHAR), '; ' ORDER BY id) AS notas FROM ({_STORED}) GROUP BY 1, 2")
def entity_export(spark, d):
    ids = F.transform(F.array_sort(F.collect_set("id")), lambda x: x.cast("string"))
    return stored_entities(spark, d).groupBy("categoria", "entidad").agg(F.count("*").alias("n"), F.array_join(ids, "; ").alias("notas"))


@query(f"SELECT coalesce(nullif(medio, ''), '?') AS medio, entidad, count(*) AS n FROM ({_STORED}) s JOIN notas USING (id) WHERE categoria = 'personas' GROUP BY 1, 2")
def outlet_people(spark, d):
    people = stored_entities(spark, d).where("categoria = 'personas'")
    return people.join(table(spark, d, "notas", "id", "medio"), "id").groupBy(F.coalesce(F.nullif("medio", F.lit("")), F.lit("?")).alias("medio"), "entidad").agg(F.count("*").alias("n"))


@query("""SELECT coalesce(nullif(medio, ''), '?') AS medio, coalesce(json_extract_string(confianza, '$.nivel'), 'sin dato') AS nivel, count(*) AS n FROM notas GROUP BY 1, 2""")
def stored_confidence(spark, d):
    level = F.get_json_object("confianza", "$.nivel")
    return table(spark, d, "notas", "medio", "confianza").groupBy(F.coalesce(F.nullif("medio", F.lit("")), F.lit("?")).alias("medio"), F.coalesce(level, F.lit("sin dato")).alias("nivel")).agg(F.count("*").alias("n"))


@query(f"""WITH i AS ({_INDEX}), r AS (SELECT strftime(fecha, '%Y-%m') AS period, doc_id, entity FROM i JOIN documents USING (doc_id) WHERE fecha IS NOT NULL), e AS (SELECT a.period, a.entity AS src, b.entity AS dst FROM r a JOIN r b ON a.period = b.period AND a.doc_id = b.doc_id AND a.entity < b.entity GROUP BY 1, 2, 3 HAVING count(*) >= 2),
n AS (SELECT period, count(DISTINCT x) AS nodes FROM (SELECT period, src AS x FROM e UNION ALL SELECT period, dst FROM e) GROUP BY period), c AS (SELECT period, count(*) AS edges FROM e GROUP BY period)
SELECT period, nodes, edges, round(CASE WHEN nodes > 1 THEN 2.0::DOUBLE * edges / (CAST(nodes AS DOUBLE) * (nodes - 1)) ELSE 0.0 END, 4) AS density FROM c JOIN n USING (period)""")
def graph_by_month(spark, d):
    months = docs(spark, d, "fecha").where("fecha is not null").select("doc_id", F.date_format("fecha", "yyyy-MM").alias("month"))
    return graph.by_period(entity_index(spark, d), months, "doc_id", "entity", "month", 2)


@query(f"WITH e AS ({_EDGES}), m AS (SELECT node FROM (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e) GROUP BY node ORDER BY sum(weight) DESC, node LIMIT 1), n AS (SELECT node FROM m UNION SELECT dst FROM e JOIN m ON src = node UNION SELECT src FROM e JOIN m ON dst = node) SELECT src, dst, weight FROM e WHERE src IN (SELECT node FROM n) AND dst IN (SELECT node FROM n)")
def graph_ego(spark, d):
    edges = _edges(spark, d)
    top = graph.degrees(edges).orderBy(F.desc("strength"), "node").first()
    return graph.ego(edges, top["node"] if top else "")


@query("SELECT lang, count(*) AS documents, min(fecha)::DATE AS first_day, max(fecha)::DATE AS last_day, CAST(sum(coalesce(n_chars, 0)) AS BIGINT) AS chars FROM documents GROUP BY lang")
def corpus_info(spark, d):
    return docs(spark, d, "lang", "fecha", "n_chars").groupBy("lang").agg(F.count("*").alias("documents"), F.to_date(F.min("fecha")).alias("first_day"), F.to_date(F.max("fecha")).alias("last_day"), F.sum(F.coalesce("n_chars", F.lit(0))).alias("chars"))


@query("SELECT time_bucket(INTERVAL 1 DAY, ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_event_days(spark, d):
    from rotativa.streaming import incremental

    out = incremental.state_folder(spark, "event-days")
    events = incremental.event_stream(spark, f"{d}/events.parquet").select("ts", "event_type")
    # the last windows stay open under a watermark, so the stream counts by batch and the counts are summed
    incremental.count_batches(events, out, "ts", "1 day", "event_type")
    return spark.read.parquet(out).groupBy("start", "event_type").agg(F.sum("n").alias("n"))
