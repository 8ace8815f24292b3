"""Queries of review, roll-ups, whole-graph measures, extraction and upkeep, each with the SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rotativa.functions import text as T
from rotativa.operators import corpus, entities, graph, review, rollups, tone
from rotativa.plans import reference_queries as R
from rotativa.plans import study as S
from rotativa.sources import feeds, html
from rotativa.sources.tables import table

query, QUERIES, SQL = R.query, R.QUERIES, R.SQL

# ---------------------------------------------------------------- stored notes


@query("SELECT id, url, medio, titular, length(cuerpo) AS chars FROM notas ORDER BY id")
def all_notes(spark, d):
    return table(spark, d, "notas", "id", "url", "medio", "titular", "cuerpo").select("id", "url", "medio", "titular", F.length("cuerpo").cast("long").alias("chars")).orderBy("id")


@query("SELECT id, medio, titular FROM notas WHERE coalesce(cuerpo, '') <> '' AND social_transformer IS NULL")
def pending_notes(spark, d):
    return table(spark, d, "notas", "id", "medio", "titular", "cuerpo", "social_transformer").where("coalesce(cuerpo, '') != '' and social_transformer is null").select("id", "medio", "titular")


@query("SELECT coalesce(nullif(medio, ''), '?') AS medio, count(*) AS n FROM notas GROUP BY 1 ORDER BY n DESC, medio LIMIT 20")
def top_outlets(spark, d):
    rows = table(spark, d, "notas", "medio").groupBy(F.coalesce(F.nullif("medio", F.lit("")), F.lit("?")).alias("medio")).agg(F.count("*").alias("n"))
    return rows.orderBy(F.desc("n"), "medio").limit(20)


@query("SELECT medio, dominio, pais, CAST(row_number() OVER (ORDER BY medio) AS INTEGER) AS ord FROM medios")
def outlet_list(spark, d):
    from pyspark.sql import Window

    return table(spark, d, "medios", "medio", "dominio", "pais").withColumn("ord", F.row_number().over(Window.orderBy("medio")))  # the list of outlets


@query(f"SELECT id, score, verdict FROM ({SQL['extraction_quality']}) ORDER BY score, id LIMIT 50")
def worst_extractions(spark, d):
    return R.extraction_quality(spark, d).select("id", "score", "verdict").orderBy("score", "id").limit(50)


@query(f"SELECT id, url FROM notas WHERE {R._RELEVANT}")
def purged_notes(spark, d):
    """What a purge of irrelevant notes leaves."""
    return table(spark, d, "notas", "id", "url", "titular", "cuerpo").where(corpus.relevant(R._whole(), S.RELEVANT, S.EXCLUDED)).select("id", "url")


@query(f"SELECT coalesce(nullif(medio, ''), '?') AS medio, count(*) AS offered, count(*) FILTER (WHERE id IN (SELECT id FROM ({SQL['content_dedupe']}))) AS inserted, count(*) FILTER (WHERE id NOT IN (SELECT id FROM ({SQL['content_dedupe']}))) AS repeated FROM notas GROUP BY 1")
def insert_counts(spark, d):
    kept = R.content_dedupe(spark, d).select("id", F.lit(True).alias("new"))
    rows = table(spark, d, "notas", "id", "medio").join(kept, "id", "left").groupBy(F.coalesce(F.nullif("medio", F.lit("")), F.lit("?")).alias("medio"))
    return rows.agg(F.count("*").alias("offered"), F.count_if(F.col("new")).alias("inserted"), F.count_if(F.col("new").isNull()).alias("repeated"))


# ---------------------------------------------------------------- seeds and types

_FORMS = """(SELECT nombre, tipo, nombre AS forma FROM entidades_interes UNION ALL SELECT nombre, tipo, json_extract_string(formas, '$[' || i.i || ']') FROM entidades_interes, generate_series(0, CAST(json_array_length(formas) AS BIGINT) - 1) i(i) WHERE formas IS NOT NULL)"""
_TYPED = f"(SELECT lower(trim(forma)) AS form, max_by(coalesce(nullif(tipo, ''), 'otro'), struct_pack(n := nombre, k := coalesce(nullif(tipo, ''), 'otro'))) AS kind FROM {_FORMS} WHERE trim(coalesce(forma, '')) <> '' AND nombre IS NOT NULL GROUP BY 1)"


def _seeds(spark, d) -> DataFrame:
    return table(spark, d, "entidades_interes", "nombre", "tipo", "formas").where("nombre is not null")


@query(f"SELECT form, kind FROM {_TYPED}")
def actor_types(spark, d):
    return rollups.typed_forms(_seeds(spark, d))


@query(f"SELECT coalesce(kind, 'otro') AS kind, entity AS actor, count(DISTINCT doc_id) AS n FROM ({R._INDEX}) LEFT JOIN {_TYPED} ON form = lower(trim(entity)) GROUP BY 1, 2")
def coverage_by_type(spark, d):
    return rollups.coverage(R.entity_index(spark, d), rollups.typed_forms(_seeds(spark, d)))


@query(f"SELECT coalesce(kind, 'otro') AS kind, count(DISTINCT entity) AS actors, count(*) AS mentions FROM ({R._INDEX}) LEFT JOIN {_TYPED} ON form = lower(trim(entity)) GROUP BY 1")
def type_totals(spark, d):
    counted = coverage_by_type(spark, d)
    return counted.groupBy("kind").agg(F.count("*").alias("actors"), F.sum("n").alias("mentions"))


@query(f"""WITH new AS (SELECT DISTINCT nombre, lower(trim(forma)) AS form FROM {_FORMS} WHERE trim(coalesce(forma, '')) <> '' AND nombre IS NOT NULL)
SELECT nombre, count(*) AS forms, min(form) AS first_form FROM new GROUP BY nombre""")
def seed_upsert(spark, d):
    """Seeds folded by name, as an upsert of typed forms leaves them."""
    every = _seeds(spark, d).select("nombre", F.explode(F.concat(F.array("nombre"), F.coalesce(F.from_json("formas", "array<string>"), F.array().cast("array<string>")))).alias("form"))
    forms = every.select("nombre", F.lower(F.trim("form")).alias("form")).where("form is not null and form != ''").distinct()
    return forms.groupBy("nombre").agg(F.count("*").alias("forms"), F.min("form").alias("first_form"))


# ---------------------------------------------------------------- review

_QUEUE = f"""SELECT entity, n, score, CASE WHEN score >= 0.75 THEN 'verde' WHEN score >= 0.45 THEN 'amarillo' ELSE 'rojo' END AS level FROM (
  SELECT entity, n, CAST(CASE WHEN form IS NOT NULL THEN 1.0 ELSE round(least(1.0::DOUBLE, 0.05::DOUBLE + 0.25::DOUBLE * n), 3) END AS DOUBLE) AS score
  FROM (SELECT entity, count(*) AS n FROM ({R._INDEX}) GROUP BY entity) LEFT JOIN (SELECT DISTINCT lower(forma) AS form FROM {_FORMS} WHERE forma IS NOT NULL) ON form = lower(entity)) WHERE score < 0.75"""


def _declared(spark, d) -> DataFrame:
    every = table(spark, d, "entidades_interes", "nombre", "formas")
    return every.select(F.explode(F.concat(F.array("nombre"), F.coalesce(F.from_json("formas", "array<string>"), F.array().cast("array<string>")))).alias("form")).where("form is not null")


@query(_QUEUE)
def review_queue(spark, d):
    return review.queue(R.entity_index(spark, d), _declared(spark, d))


@query("SELECT rev_id, nombre, categoria, score, n_articulos FROM revision_entidades WHERE decision = 'pendiente' ORDER BY score, n_articulos DESC, rev_id")
def review_pending(spark, d):
    rows = table(spark, d, "revision_entidades", "rev_id", "nombre", "categoria", "decision", "score", "n_articulos").where("decision = 'pendiente'").drop("decision")
    return rows.orderBy("score", F.desc("n_articulos"), "rev_id")


_LATEST = "SELECT nombre AS name, max_by(decision, rev_id) AS decision, max_by(nombre_nuevo, rev_id) AS new_name FROM revision_entidades GROUP BY nombre"


@query(f"SELECT * FROM ({_LATEST}) WHERE decision <> 'pendiente'")
def review_decisions(spark, d):
    rows = table(spark, d, "revision_entidades", "rev_id", "nombre", "decision", "nombre_nuevo")
    return review.latest_decisions(rows, "nombre", "rev_id").where("decision != 'pendiente'")


@query("SELECT decision, count(*) AS n FROM revision_entidades GROUP BY decision")
def review_statistics(spark, d):
    return table(spark, d, "revision_entidades", "decision").groupBy("decision").agg(F.count("*").alias("n"))


_LOGGED = "(SELECT nombre AS entity, rev_id AS doc_id FROM revision_entidades WHERE coalesce(nombre, '') <> '')"


@query(f"SELECT DISTINCT CASE WHEN decision = 'renombrada' AND coalesce(new_name, '') <> '' THEN new_name ELSE entity END AS entity, doc_id FROM {_LOGGED} LEFT JOIN ({_LATEST}) ON name = entity WHERE coalesce(decision, '') <> 'descartada'")
def review_applied(spark, d):
    rows = table(spark, d, "revision_entidades", "rev_id", "nombre", "decision", "nombre_nuevo")
    index = rows.where("coalesce(nombre, '') != ''").select(F.col("nombre").alias("entity"), F.col("rev_id").alias("doc_id"))
    return review.reviewed(index, review.latest_decisions(rows, "nombre", "rev_id"), "descartada", "renombrada")


@query(f"""WITH s AS (SELECT name, decision, score FROM (SELECT nombre AS name, max_by(decision, rev_id) AS decision, max_by(score, rev_id) AS score FROM revision_entidades WHERE nombre IS NOT NULL GROUP BY nombre))
SELECT coalesce(name, entity) AS name, coalesce(decision, 'pendiente') AS decision, CASE WHEN coalesce(decision, 'pendiente') = 'pendiente' THEN coalesce(q.score, s.score) ELSE s.score END AS score FROM s FULL JOIN ({_QUEUE}) q ON name = entity""")
def review_merged(spark, d):
    rows = table(spark, d, "revision_entidades", "rev_id", "nombre", "decision", "score").where("nombre is not null")
    stored = rows.groupBy(F.col("nombre").alias("name")).agg(F.max_by("decision", "rev_id").alias("decision"), F.max_by("score", "rev_id").alias("score"))
    return review.merged(stored, review_queue(spark, d), "pendiente")


@query("SELECT categoria AS a, decision AS b, count(*) AS n FROM revision_entidades WHERE coalesce(categoria, '') <> '' AND coalesce(decision, '') <> '' GROUP BY 1, 2")
def label_confusion(spark, d):
    rows = table(spark, d, "revision_entidades", "categoria", "decision").select(F.col("categoria").alias("a"), F.col("decision").alias("b"))
    return rollups.confusion(rows, "a", "b")


_W = S.NAME_WORDS
_FRAGMENT = rf"""CASE WHEN trim(nombre) = '' THEN 'vacia' WHEN lower(trim(nombre)) IN {R._list(_W['connectors'])} THEN 'conector' WHEN lower(trim(nombre)) IN {R._list(_W['verbs'])} THEN 'verbo' WHEN lower(trim(nombre)) IN {R._list(_W['common'])} THEN 'generico'
 WHEN lower(trim(nombre)) IN {R._list(_W['kept'])} THEN NULL WHEN regexp_matches(trim(nombre), '[0-9]') THEN 'cifra' WHEN regexp_matches(trim(nombre), '^[¿¡?!]') THEN 'signo' WHEN regexp_matches(trim(nombre), '^\p{{Ll}}') THEN 'minuscula'
 WHEN regexp_split_to_array(lower(trim(nombre)), '\s+')[1] IN {R._list(_W['openings'])} THEN 'comienzo' WHEN regexp_split_to_array(lower(trim(nombre)), '\s+')[1] IN {R._list(_W['verbs'])} THEN 'verbo' WHEN length(trim(nombre)) <= 2 THEN 'corta' WHEN contains(nombre, chr(10)) THEN 'salto'
 WHEN regexp_matches(lower(trim(nombre)), '(ó|aron|ieron)$') AND NOT contains(lower(trim(nombre)), ' ') THEN 'conjugada' WHEN len(regexp_split_to_array(lower(trim(nombre)), '\s+')) > 5 THEN 'larga'
 WHEN len(regexp_split_to_array(lower(trim(nombre)), '\s+')) >= 3 AND list_has_any(regexp_split_to_array(lower(trim(nombre)), '\s+'), [{', '.join("'" + w + "'" for w in _W['signals'])}]) THEN 'fragmento' END"""


@query(f"SELECT rev_id, nombre, {_FRAGMENT} AS reason FROM revision_entidades WHERE nombre IS NOT NULL")
def name_fragments(spark, d):
    rows = table(spark, d, "revision_entidades", "rev_id", "nombre").where("nombre is not null")
    return rows.select("rev_id", "nombre", entities.fragment(F.col("nombre"), S.NAME_WORDS).alias("reason"))


@query(rf"""WITH n AS (SELECT DISTINCT nombre AS name, list_sort(list_distinct(list_filter(regexp_extract_all({R.FOLD.format('nombre')}, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 2 AND NOT x IN {R._list(S.PARTICLES)}))) AS t, trim({R.FOLD.format('nombre')}) AS f FROM revision_entidades WHERE categoria = 'PERSONA' AND nombre IS NOT NULL),
s AS (SELECT trim({R.FOLD.format('forma')}) AS f, max(nombre) AS seed FROM {_FORMS} WHERE forma IS NOT NULL AND nombre IS NOT NULL GROUP BY 1), r AS (SELECT n.*, seed FROM n LEFT JOIN s USING (f)), g AS (SELECT * FROM r WHERE seed IS NULL AND len(t) > 0),
l AS (SELECT a.name, min_by(b.name, struct_pack(n := -len(b.t), m := b.name)) AS leader FROM g a JOIN g b ON list_has_all(b.t, a.t) GROUP BY a.name) SELECT name, coalesce(seed, leader, name) AS canonical FROM r LEFT JOIN l USING (name)""")
def canonical_people(spark, d):
    names = table(spark, d, "revision_entidades", "nombre", "categoria").where("categoria = 'PERSONA'").select(F.col("nombre").alias("name")).distinct()
    seeds = table(spark, d, "entidades_interes", "nombre", "formas").where("nombre is not null")
    forms = seeds.select(F.explode(F.concat(F.array("nombre"), F.coalesce(F.from_json("formas", "array<string>"), F.array().cast("array<string>")))).alias("form"), F.col("nombre").alias("canonical"))
    return entities.canonical_people(names, forms, S.PARTICLES)


# ---------------------------------------------------------------- annotated documents

_NOTES = f"(SELECT p.doc_id, p.label, p.score, e.dominant AS emotion, f.frame FROM ({SQL['polarity_lexicon']}) p JOIN ({SQL['emotions']}) e USING (doc_id) JOIN ({SQL['frames']}) f USING (doc_id))"


def _annotated(spark, d) -> DataFrame:
    one, two, three = R.polarity_lexicon(spark, d).select("doc_id", "label", "score"), R.emotions(spark, d).select("doc_id", F.col("dominant").alias("emotion")), R.frames(spark, d).select("doc_id", "frame")
    return one.join(two, "doc_id").join(three, "doc_id")


_PEOPLE = f"(SELECT DISTINCT entity AS actor, doc_id FROM ({R._INDEX}) WHERE entity IN (SELECT entity FROM ({R._INDEX}) GROUP BY entity ORDER BY count(*) DESC, entity LIMIT 12))"


@query(f"""WITH r AS (SELECT actor, n.* FROM {_PEOPLE} JOIN {_NOTES} n USING (doc_id)), c AS (SELECT actor, count(*) AS n, count(*) FILTER (WHERE label = 'positivo') AS positivo, count(*) FILTER (WHERE label = 'negativo') AS negativo, count(*) FILTER (WHERE label = 'neutro') AS neutro, round(avg(score), 3) AS score FROM r GROUP BY actor),
e AS (SELECT actor, emotion FROM (SELECT actor, emotion, count(*) AS k FROM r WHERE emotion IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY actor ORDER BY k DESC, emotion) = 1),
f AS (SELECT actor, frame FROM (SELECT actor, frame, count(*) AS k FROM r WHERE frame IS NOT NULL GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY actor ORDER BY k DESC, frame) = 1)
SELECT c.*, emotion, frame, CASE WHEN positivo + negativo > 0 THEN round((positivo + negativo) / CAST(n AS DOUBLE) * (1 - abs(positivo - negativo) / CAST(positivo + negativo AS DOUBLE)), 3) ELSE 0.0 END::DOUBLE AS affective FROM c LEFT JOIN e USING (actor) LEFT JOIN f USING (actor)""")
def candidates_compared(spark, d):
    """The twelve most covered actors side by side."""
    index = R.entity_index(spark, d).select(F.col("entity").alias("actor"), "doc_id")
    most = index.groupBy("actor").agg(F.count("*").alias("k")).orderBy(F.desc("k"), "actor").limit(12).select("actor")
    return rollups.compared(index.join(F.broadcast(most), "actor", "left_semi"), _annotated(spark, d))


def _histogram_sql(group: str, value: str) -> str:
    return f"SELECT {group}, {value}, count(*) AS n, round(100.0::DOUBLE * count(*) / sum(count(*)) OVER (PARTITION BY {group}), 1) AS pct FROM (SELECT source, strftime(fecha, '%Y-%m') AS month, n.* FROM {_NOTES} n JOIN documents USING (doc_id)) WHERE {value} IS NOT NULL AND {group} IS NOT NULL GROUP BY 1, 2"


def _grouped(spark, d, group: str, value: str) -> DataFrame:
    when = R.docs(spark, d, "source", "fecha").select("doc_id", "source", F.date_format("fecha", "yyyy-MM").alias("month"))
    return rollups.histogram(_annotated(spark, d).join(when, "doc_id"), group, value)


@query(_histogram_sql("source", "emotion"))
def outlet_emotions(spark, d):
    return _grouped(spark, d, "source", "emotion")


@query(_histogram_sql("month", "emotion"))
def monthly_emotions(spark, d):
    return _grouped(spark, d, "month", "emotion")


@query(_histogram_sql("month", "frame"))
def monthly_frames(spark, d):
    return _grouped(spark, d, "month", "frame")


_FLAGS = "(SELECT medio, CAST(json_extract_string(social_transformer, '$.odio') AS BOOLEAN) AS odio, CAST(json_extract_string(social_transformer, '$.agresivo') AS BOOLEAN) AS agresivo FROM notas)"


@query(f"SELECT coalesce(medio, '?') AS medio, count(*) AS n, count(*) FILTER (WHERE odio) AS odio, count(*) FILTER (WHERE agresivo) AS agresivo FROM {_FLAGS} WHERE odio IS NOT NULL OR agresivo IS NOT NULL GROUP BY 1")
def toxicity_by_outlet(spark, d):
    flag = lambda f: F.get_json_object("social_transformer", f"$.{f}").cast("boolean").alias(f)
    return rollups.flagged(table(spark, d, "notas", "medio", "social_transformer").select("medio", flag("odio"), flag("agresivo")), "medio", ("odio", "agresivo"))


@query(f"SELECT actor, day, count(*) AS volume, round(avg(score), 3) AS tone FROM (SELECT actor, fecha::DATE AS day, score FROM ({SQL['polarity_towards']}) JOIN documents USING (doc_id) WHERE fecha IS NOT NULL) GROUP BY 1, 2")
def actor_days(spark, d):
    days = R.docs(spark, d, "fecha").where("fecha is not null").select("doc_id", F.to_date("fecha").alias("day"))
    return R.polarity_towards(spark, d).join(days, "doc_id").groupBy("actor", "day").agg(F.count("*").alias("volume"), F.round(F.avg("score"), 3).alias("tone"))


@query("""WITH s AS (SELECT fecha::DATE AS day, count(*) AS w FROM documents WHERE fecha IS NOT NULL GROUP BY 1), c AS (SELECT *, sum(w) OVER (ORDER BY day) AS c, sum(w) OVER () AS t FROM s),
r AS (SELECT a.day AS f, min(b.day) AS l FROM c a JOIN c b ON b.day >= a.day AND b.c >= a.c - a.w + 0.98::DOUBLE * a.t GROUP BY a.day)
SELECT f AS "first", l AS "last", CAST(l - f + 1 AS INTEGER) AS days, (SELECT min(day) FROM c WHERE c >= t / 2.0) AS median FROM r ORDER BY l - f, f LIMIT 1""")
def dense_period(spark, d):
    days = R.docs(spark, d, "fecha").where("fecha is not null").groupBy(F.to_date("fecha").alias("day")).agg(F.count("*").alias("w"))
    return rollups.dense_range(days, "day", "w")


@query("SELECT count(*) AS documents, count(fecha) AS dated, min(fecha) FILTER (WHERE year(fecha) BETWEEN 2000 AND 2100)::DATE AS first_day, max(fecha) FILTER (WHERE year(fecha) BETWEEN 2000 AND 2100)::DATE AS last_day FROM documents")
def corpus_range(spark, d):
    valid = F.when(F.year("fecha").between(2000, 2100), F.to_date("fecha"))
    return R.docs(spark, d, "fecha").agg(F.count("*").alias("documents"), F.count("fecha").alias("dated"), F.min(valid).alias("first_day"), F.max(valid).alias("last_day"))


@query("""WITH o AS (SELECT doc_id, text, unnest(list_filter(range(1, CAST(length(text) AS BIGINT) - 8), lambda i: substr(lower(text), i, 9) = 'sindicato')) AS p FROM documents WHERE contains(lower(text), 'sindicato'))
SELECT doc_id, CAST(p - 1 AS INTEGER) AS "at", substr(text, CAST(greatest(p - 40, 1) AS BIGINT), CAST(least(p - 1, 40) AS BIGINT)) AS before, substr(text, CAST(p + 9 AS BIGINT), 40) AS after FROM o""")
def kwic_positions(spark, d):
    """Every place of a literal, overlapping ones too, with what stands around it."""
    rows = R.docs(spark, d, "text").where(F.lower("text").contains("sindicato"))
    places = T.let(F.lower("text"), lambda low: F.filter(F.sequence(F.lit(1), F.length("text") - 8), lambda i: F.substring(low, i, F.lit(9)) == "sindicato"))
    found = rows.select("doc_id", "text", F.explode(places).alias("at"))
    return found.select("doc_id", (F.col("at") - 1).alias("at"), F.substring("text", F.greatest(F.col("at") - 40, F.lit(1)), F.least(F.col("at") - 1, F.lit(40))).alias("before"), F.substring("text", F.col("at") + 9, F.lit(40)).alias("after"))


# ---------------------------------------------------------------- prominence as SQL

_EDGE = r"[^\p{L}\p{N}_]"


def _actor_sql(actor: str, order: int, forms: tuple[str, ...]) -> str:
    plain = [x.lower().translate(str.maketrans(T.MARKED, T.FOLDED)) for x in forms]
    any_of = "(?:" + "|".join(plain) + ")"
    return (
        f"SELECT doc_id, '{actor}' AS actor, {order} AS ord, size, CAST(CASE WHEN regexp_matches(f, '^{any_of}(?:$|{_EDGE})') THEN 0 ELSE length(regexp_extract(f, '(?s)^(.*?){_EDGE}{any_of}(?:$|{_EDGE})', 1)) + 1 END AS INTEGER) AS first_at, "
        f"CAST(len(list_filter(runs, lambda x: x IN {R._list(tuple(plain))})) AS INTEGER) AS mentions FROM d"
    )


#: Each actor's forms are single words, so its mentions are runs of the folded text.
_RANKED = rf"""WITH d AS (SELECT doc_id, length(text) AS size, {R.FOLD.format("coalesce(text, '')")} AS f, regexp_extract_all({R.FOLD.format("coalesce(text, '')")}, '[\p{{L}}\p{{N}}_]+') AS runs FROM documents), r AS ({' UNION ALL '.join(_actor_sql(a, i, x) for i, (a, x) in enumerate(S.PEOPLE.items()))})
SELECT doc_id, actor, first_at, round(CAST(first_at AS DOUBLE) / greatest(size, 1), 3) AS position, mentions, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY first_at, ord) AS INTEGER) AS rank FROM r WHERE mentions > 0"""
SQL["prominence_rank"] = _RANKED
SQL["prominence_summary"] = f"SELECT actor, count(*) AS docs, CAST(sum(CASE WHEN rank = 1 THEN 1 ELSE 0 END) AS BIGINT) AS first, round(avg(position), 3) AS position FROM ({_RANKED}) GROUP BY actor"


@query(f"SELECT actor, count(*) AS docs, CAST(sum(mentions) AS BIGINT) AS mentions FROM ({_RANKED}) GROUP BY actor")
def actor_documents(spark, d):
    return entities.prominence(R.docs(spark, d, "text"), S.PEOPLE).groupBy("actor").agg(F.count("*").alias("docs"), F.sum("mentions").alias("mentions"))


# ---------------------------------------------------------------- the graph as a whole

_MOST = 40
_TOP = f"t AS (WITH {R._WAYS} SELECT src, dst, weight FROM e WHERE src IN (SELECT src FROM w GROUP BY src ORDER BY sum(weight) DESC, src LIMIT {_MOST}) AND dst IN (SELECT src FROM w GROUP BY src ORDER BY sum(weight) DESC, src LIMIT {_MOST})), tw AS (SELECT src, dst, weight FROM t UNION ALL SELECT dst, src, weight FROM t)"
_DISTANCES = f"{_TOP}, b(src, dst, d) AS (SELECT DISTINCT src, src, 0 FROM tw UNION SELECT b.src, tw.dst, b.d + 1 FROM b JOIN tw ON b.dst = tw.src WHERE b.d < {_MOST // 4}), ds AS (SELECT src, dst, min(d) AS d FROM b GROUP BY 1, 2)"


def _top(spark, d) -> DataFrame:
    return graph.strongest(R._edges(spark, d), _MOST)


@query(f"WITH {_TOP} SELECT src, dst, weight FROM t")
def graph_strongest(spark, d):
    return _top(spark, d)


@query(f"WITH RECURSIVE {_DISTANCES}, r AS (SELECT src AS node, count(*) AS r, sum(d) AS s, max(d) AS e FROM ds GROUP BY src) SELECT node, round(CASE WHEN s > 0 THEN (r - 1)::DOUBLE / s * ((r - 1)::DOUBLE / ((SELECT count(*) FROM r) - 1)) ELSE 0.0 END, 6)::DOUBLE AS closeness, CAST(e AS INTEGER) AS eccentricity FROM r")
def graph_closeness(spark, d):
    return graph.closeness(_top(spark, d))


@query(f"""WITH RECURSIVE {_DISTANCES}, k AS (SELECT src, count(*) AS k FROM tw GROUP BY src), c AS (SELECT src, min(dst) AS root FROM ds GROUP BY src), l AS (SELECT ds.src, d % 2 AS colour FROM ds JOIN c ON ds.src = c.src AND ds.dst = root)
SELECT (SELECT count(*) FROM k) AS nodes, (SELECT count(*) FROM t) AS edges, (SELECT max(k) FROM k) AS most, (SELECT min(k) FROM k) AS least, CAST((SELECT max(d) FROM ds) AS INTEGER) AS diameter, (SELECT count(*) FROM t JOIN l a ON t.src = a.src JOIN l b ON t.dst = b.src WHERE a.colour = b.colour) = 0 AS bipartite""")
def graph_shape(spark, d):
    return graph.shape(_top(spark, d))


@query()
def graph_communities(spark, d):
    return graph.communities(R._edges(spark, d))


@query()
def graph_modularity(spark, d):
    edges = R._edges(spark, d)
    return graph.modularity(edges, graph.communities(edges))


@query()
def graph_betweenness(spark, d):
    return graph.betweenness(R._edges(spark, d), 300)


@query(f"""WITH i AS ({R._INDEX}), r AS (SELECT strftime(fecha, '%Y-%m') AS period, doc_id, entity FROM i JOIN documents USING (doc_id) WHERE fecha IS NOT NULL)
SELECT period, entity AS node, n FROM (SELECT period, entity, count(*) AS n FROM r GROUP BY 1, 2) QUALIFY row_number() OVER (PARTITION BY period ORDER BY n DESC, entity) = 1""")
def top_node_by_month(spark, d):
    months = R.docs(spark, d, "fecha").where("fecha is not null").select("doc_id", F.date_format("fecha", "yyyy-MM").alias("period"))
    counted = R.entity_index(spark, d).join(months, "doc_id").groupBy("period", "entity").agg(F.count("*").alias("n"))
    return counted.groupBy("period").agg(F.min_by(F.struct("entity", "n"), F.struct((-F.col("n")).alias("k"), "entity")).alias("t")).select("period", F.col("t.entity").alias("node"), "t.n")


# ---------------------------------------------------------------- extraction, addresses, search


@query()
def structured_articles(spark, d):
    return html.structured(table(spark, d, "capturas", "captura_id", "html"))


@query("""SELECT resultado_id, coalesce(nullif(url_decode(regexp_extract(url, '[?&]url=([^&#]*)', 1)), ''), url) AS url FROM resultados""")
def unwrapped_urls(spark, d):
    return table(spark, d, "resultados", "resultado_id", "url").select("resultado_id", corpus.unwrapped_url(F.col("url")).alias("url"))


@query("SELECT coalesce(nullif(url, ''), plataforma || ':' || id) AS url, substr(texto, 1, 120) AS headline, texto AS body FROM publicaciones")
def post_hits(spark, d):
    return feeds.hits_from_posts(table(spark, d, "publicaciones", "url", "plataforma", "id", "texto"))


@query("""WITH b AS (SELECT captura_id, unnest(range(len(s))) AS ord, regexp_replace(unnest(s), '^ +| +$', '', 'g') AS block FROM (SELECT captura_id, regexp_split_to_array(texto, '\\n{2,}') AS s FROM capturas WHERE texto IS NOT NULL))
SELECT captura_id, CAST(min(ord) AS INTEGER) AS ord, min_by(block, ord) AS block FROM b WHERE length(block) >= 40 GROUP BY captura_id, lower(block)""")
def text_blocks(spark, d):
    return feeds.text_blocks(table(spark, d, "capturas", "captura_id", "texto").where("texto is not null"), "captura_id", "texto")


@query("""SELECT fuente, count(*) AS hits, count(DISTINCT url) AS urls FROM (SELECT coalesce(nullif(fuente, ''), '?') AS fuente, url FROM resultados UNION ALL SELECT 'social:' || plataforma, url FROM publicaciones) GROUP BY fuente""")
def hits_by_source(spark, d):
    """The union of all sources of hits, counted by source."""
    a = table(spark, d, "resultados", "fuente", "url").select(F.coalesce(F.nullif("fuente", F.lit("")), F.lit("?")).alias("fuente"), "url")
    b = table(spark, d, "publicaciones", "plataforma", "url").select(F.concat(F.lit("social:"), "plataforma").alias("fuente"), "url")
    return a.unionByName(b).groupBy("fuente").agg(F.count("*").alias("hits"), F.countDistinct("url").alias("urls"))


# ---------------------------------------------------------------- confidence, universe, glossary


@query(f"""SELECT rev_id, CASE WHEN decision = 'verificada' THEN 1.0 ELSE round(0.3::DOUBLE * CASE WHEN form IS NULL THEN 0 ELSE 1 END + 0.25::DOUBLE * coalesce(score, 0) + 0.45::DOUBLE * coalesce(score, 0), 3) END::DOUBLE AS confidence
FROM revision_entidades LEFT JOIN (SELECT DISTINCT lower(forma) AS form FROM {_FORMS} WHERE forma IS NOT NULL) ON form = lower(nombre)""")
def review_confidence(spark, d):
    rows = table(spark, d, "revision_entidades", "rev_id", "nombre", "decision", "score")
    known = _declared(spark, d).select(F.lower("form").alias("_f"), F.lit(True).alias("_k")).distinct()
    joined = rows.join(known, F.lower("nombre") == F.col("_f"), "left")
    score = F.coalesce("score", F.lit(0.0))
    return joined.select("rev_id", review.entity_confidence(F.coalesce("_k", F.lit(False)), F.coalesce(F.col("decision") == "verificada", F.lit(False)), score, score).alias("confidence"))


@query("SELECT rev_id, CASE WHEN score >= 0.75 THEN '● CONFIABLE' WHEN score >= 0.45 THEN '◐ REVISAR' ELSE '○ VALIDAR' END AS label FROM revision_entidades WHERE score IS NOT NULL")
def confidence_labels(spark, d):
    rows = table(spark, d, "revision_entidades", "rev_id", "score").where("score is not null")
    return rows.select("rev_id", T.labelled(F.col("score"), 0.75, 0.45, ("● CONFIABLE", "◐ REVISAR", "○ VALIDAR")).alias("label"))


_FOLDED_FORMS = f"(SELECT DISTINCT trim({R.FOLD.format('forma')}) AS f FROM {_FORMS} WHERE forma IS NOT NULL)"


@query(f"SELECT id, categoria, entidad, f IS NOT NULL AS inside FROM ({R._STORED}) LEFT JOIN {_FOLDED_FORMS} ON f = trim({R.FOLD.format('entidad')})")
def study_universe(spark, d):
    """Stored entities with whether they belong to the declared universe."""
    inside = _declared(spark, d).select(T.fold_trim(F.col("form")).alias("_f"), F.lit(True).alias("inside")).distinct()
    rows = R.stored_entities(spark, d).withColumn("_f", T.fold_trim(F.col("entidad"))).join(inside, "_f", "left")
    return rows.select("id", "categoria", "entidad", F.coalesce("inside", F.lit(False)).alias("inside"))


@query(f"SELECT categoria, lower(entidad) AS term, min_by(entidad, struct_pack(i := id, e := entidad)) AS first_form, count(DISTINCT id) AS notes, min(id) AS first_note FROM ({R._STORED}) GROUP BY 1, 2")
def glossary(spark, d):
    """Terms by category without regard to case, with the first form and the notes that hold them."""
    rows = R.stored_entities(spark, d).groupBy("categoria", F.lower("entidad").alias("term"))
    return rows.agg(F.min_by("entidad", F.struct("id", "entidad")).alias("first_form"), F.countDistinct("id").alias("notes"), F.min("id").alias("first_note"))


@query(f"SELECT resultado_id, url FROM ({SQL['search_hits']}) ORDER BY resultado_id LIMIT 50")
def search_capped(spark, d):
    return R.search_hits(spark, d).orderBy("resultado_id").limit(50)


@query(f"SELECT medio, verdict, count(*) AS n FROM ({SQL['extraction_quality']}) JOIN (SELECT id, coalesce(nullif(medio, ''), '?') AS medio FROM notas) USING (id) GROUP BY 1, 2")
def quality_by_outlet(spark, d):
    where = table(spark, d, "notas", "id", "medio").select("id", F.coalesce(F.nullif("medio", F.lit("")), F.lit("?")).alias("medio"))
    return R.extraction_quality(spark, d).select("id", "verdict").join(where, "id").groupBy("medio", "verdict").agg(F.count("*").alias("n"))


@query(f"SELECT reason, count(*) AS n FROM (SELECT unnest(string_split(reasons, '; ')) AS reason FROM ({SQL['extraction_quality']}) WHERE reasons <> '') GROUP BY 1")
def quality_reasons(spark, d):
    rows = R.extraction_quality(spark, d).where("reasons != ''").select(F.explode(F.split("reasons", "; ")).alias("reason"))
    return rows.groupBy("reason").agg(F.count("*").alias("n"))


_NEAR = " UNION ALL ".join(f"SELECT '{a}' AS actor, unnest(list_concat(t[greatest(i - 4, 1):i - 1], t[i + 1:i + 4])) AS word FROM (SELECT t, unnest(generate_series(1, len(t))) AS i FROM (SELECT {R.TOKENS} AS t FROM documents)) WHERE t[i] = '{w}'" for a, w in S.ACTORS.items())


@query(f"SELECT actor, word, CASE WHEN {R._in(S.LEXICON.positive, 'word')} THEN 1 ELSE -1 END AS charge, count(*) AS n FROM ({_NEAR}) WHERE {R._in((*S.LEXICON.positive, *S.LEXICON.negative), 'word')} GROUP BY actor, word")
def actor_charged_words(spark, d):
    return tone.charged_words(R.docs(spark, d, "text"), S.ACTORS, S.LEXICON)


def _tokens_sql(column: str) -> str:
    return rf"list_sort(list_distinct(list_filter(regexp_extract_all({R.FOLD.format(column)}, '[\p{{L}}\p{{N}}_]+'), lambda x: length(x) > 2 AND NOT x IN {R._list(S.PARTICLES)})))"


@query(f"""WITH a AS (SELECT DISTINCT nombre AS name, {_tokens_sql('nombre')} AS t FROM revision_entidades WHERE nombre IS NOT NULL), f AS (SELECT ent_id, forma FROM (SELECT ent_id, nombre AS forma FROM entidades_interes UNION SELECT ent_id, json_extract_string(formas, '$[' || i.i || ']') FROM entidades_interes, generate_series(0, CAST(json_array_length(formas) AS BIGINT) - 1) i(i) WHERE formas IS NOT NULL) WHERE forma IS NOT NULL),
b AS (SELECT ent_id, forma, {_tokens_sql('forma')} AS u FROM f), s AS (SELECT name, ent_id, round(len(list_intersect(t, u)) / CAST(len(t) + len(u) - len(list_intersect(t, u)) AS DOUBLE), 3) AS score FROM a JOIN b ON list_has_any(t, u))
SELECT name, ent_id, score FROM s WHERE score >= 0.5 QUALIFY row_number() OVER (PARTITION BY name ORDER BY score DESC, ent_id) = 1""")
def entity_links(spark, d):
    names = table(spark, d, "revision_entidades", "nombre").select(F.col("nombre").alias("name")).distinct()
    forms = table(spark, d, "entidades_interes", "ent_id", "nombre", "formas")
    forms = forms.select("ent_id", F.explode(F.concat(F.array("nombre"), F.coalesce(F.from_json("formas", "array<string>"), F.array().cast("array<string>")))).alias("form"))
    return entities.linked(names, forms, S.PARTICLES)
