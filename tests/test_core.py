"""Core operators on small fixtures: known results, nulls, empty and very long texts, ties, empty tables, clashing names."""

import datetime as dt
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F

from rotativa.functions import text as T
from rotativa.operators import corpus, entities, graph, lexical, review, rollups, series, similarity, timestamps, tone
from rotativa.operators.tone import Lexicon
from rotativa.sources import feeds, html, sinks
from rotativa.streaming import incremental

DOCS = "doc_id long, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(1, "La casa azul y la casa roja"), (2, None), (3, ""), (4, "   "), (5, "casa casa"), (6, "El éxito no llegó, ¡nadie lo vio!"), (7, "palabra " * 20_000)]
    return spark.createDataFrame(rows, DOCS).selectExpr("*", "'x' term", "1 n")


def _instants(spark, rows):
    table = spark.createDataFrame([(i, v, z, m) for i, (v, z, m) in enumerate(rows)], "k int, value string, z string, m boolean")
    zones = table.select(F.col("z").alias("zone")).where("z is not null")
    done = timestamps.normalise(table.selectExpr("*", "'clash' utc"), "value", F.col("z"), F.col("m"), timestamps.interval_table(zones))
    return [r["utc"] for r in sorted(done.collect(), key=lambda r: r["k"])]


def test_timestamps(spark):
    bogota, madrid, new_york = "America/Bogota", "Europe/Madrid", "America/New_York"
    cases = [
        (("2025-11-24T06:13:57-05:00", None, None), "2025-11-24T11:13:57.000000Z"),
        (("24/01/2026 21:01", bogota, False), "2026-01-25T02:01:00.000000Z"),
        (("3/8/2026 2:30 AM", new_york, True), "2026-03-08T07:30:00.000000Z"),
        (("11/2/2025 1:18 AM", new_york, True), "2025-11-02T05:18:00.000000Z"),
        (("2026-03-29 02:30", madrid, False), "2026-03-29T01:30:00.000000Z"),
        (("26/10/2025 02:30", madrid, False), "2025-10-26T00:30:00.000000Z"),
        (("18 de febrero de 2026, 5:20 a. m.", bogota, None), "2026-02-18T10:20:00.000000Z"),
        (("8 de marzo de 2026, 12:05 p. m.", bogota, None), "2026-03-08T17:05:00.000000Z"),
        (("Sun, 23 Nov 2025 05:31:10 +0100", None, None), "2025-11-23T04:31:10.000000Z"),
        (("28 Jan 2026 07:08:31 COT", bogota, None), "2026-01-28T12:08:31.000000Z"),
        (("20251110T061551Z", None, None), "2025-11-10T06:15:51.000000Z"),
        (("2025-09-21T10:49:04,627-0500", None, None), "2025-09-21T15:49:04.627000Z"),
        (("2026-07-26T06:34:32.497-05", None, None), "2026-07-26T11:34:32.497000Z"),
        (("2026-01-05T00:30:51-05:00[America/Bogota]", None, None), "2026-01-05T05:30:51.000000Z"),
        (("1765758271", None, None), "2025-12-15T00:24:31.000000Z"),
        (("1773099490074", None, None), "2026-03-09T23:38:10.074000Z"),
        (("1763898759.963797", None, None), "2025-11-23T11:52:39.963797Z"),
        (("2026-04-02", bogota, None), "2026-04-02T05:00:00.000000Z"),
        (("2026-05-22T14:12:01.1234567+01:00", None, None), "2026-05-22T13:12:01.123456Z"),
        *[((v, bogota, False), None) for v in (None, "", "ayer", "hace 3 horas", "hoy, 7:15", "31/02/2026 10:00", "0000-00-00 00:00:00", "N/D", "2026-13-01", "25:00", "x" * 100_000)],
    ]
    assert _instants(spark, [c for c, _ in cases]) == [e for _, e in cases]


def test_zone_intervals_against_the_zone_database():
    for zone in ("America/Santiago", "Europe/London", "America/New_York", "America/Bogota"):
        found = timestamps.offset_intervals(zone, 2020, 2030)
        for day in range(0, 3650, 7):
            at = dt.datetime(2020, 1, 2, 5, tzinfo=dt.timezone.utc) + dt.timedelta(days=day)
            second = int(at.timestamp())
            assert [o for s, e, o in found if s <= second < e] == [int(at.astimezone(ZoneInfo(zone)).utcoffset().total_seconds())]


def test_text_functions(spark):
    row = spark.range(1).select(
        T.tokens(F.lit("El éxito: 3 veces_2 y MÁS")).alias("t"), T.fold(F.lit("ÑÁÉ Ü")).alias("f"), T.content_hash(F.lit("  \n ")).alias("h"), T.content_hash(F.lit("A  b")).alias("a"), T.content_hash(F.lit("a b ")).alias("b"),
        T.occurrences(F.lit("a.b a.b axb"), "a.b").alias("o"), T.ngrams(F.array(F.lit("x")), 2).alias("n"), T.host(F.lit("https://www.Uno.example:80/x")).alias("host"), T.query_value(F.lit("https://r.example/?url=https%3A%2F%2Fa.b"), "url").alias("q"),
    ).first()
    assert row["t"] == ["el", "éxito", "y", "más"] and row["f"] == "nae u" and row["h"] == "" and row["a"] == row["b"] and len(row["a"]) == 16
    assert row["o"] == [0, 4] and row["n"] == [] and row["host"] == "uno.example" and row["q"] == "https://a.b"


def test_lexical(spark, docs):
    terms = {r["term"]: (r["tf"], r["df"]) for r in lexical.term_frequencies(docs).collect()}
    assert terms["casa"] == (4, 2) and terms["palabra"] == (20_000, 1)
    assert {(r["doc_id"], r["at"], r["left"], r["match"]) for r in lexical.concordance(docs, "casa", 4).collect()} == {(1, 3, "La", "casa"), (1, 18, "la", "casa"), (5, 0, "", "casa"), (5, 5, "asa", "casa")}
    assert [r["rank"] for r in lexical.document_terms(docs, top=1).where("doc_id = 6").collect()] == [1]
    near = {r["term"]: r["freq"] for r in lexical.neighbour_counts(docs, "casa", 1).collect()}
    assert near == {"azul": 2, "roja": 1}
    empty = docs.where("false")
    for result in (lexical.term_frequencies(empty), lexical.ngram_frequencies(empty), lexical.collocates(empty, "casa"), lexical.lexical_network(empty), lexical.dispersion(empty, ["casa"])):
        assert result.count() == 0


def test_tone(spark, docs):
    words = Lexicon(positive=("éxito", "bueno"), negative=("malo",), negators=("no", "nadie"), emotions={"a": ("casa",), "b": ("casa",)}, frames={"f": ("cas",), "g": ("az",)}, subjective=("azul",), factual=("roja",), groups={"w": ("casa",)})
    rows = {r["doc_id"]: r for r in tone.polarity_of(spark.createDataFrame([(1, "no es bueno"), (2, "bueno y malo"), (3, None), (4, "éxito")], DOCS), words).collect()}
    assert (rows[1]["score"], rows[1]["label"]) == (-1.0, "negativo") and rows[2]["score"] == 0.0 and rows[3]["label"] == "neutro" and rows[4]["intensity"] == 100.0
    felt = {r["doc_id"]: r["dominant"] for r in tone.emotions(docs, words).collect()}
    assert felt[1] == "a" and felt[2] is None
    assert {r["doc_id"]: r["frame"] for r in tone.frames(docs, words).collect()}[1] == "f"


def test_corpus(spark):
    rows = [(1, "u1", "uno dos"), (2, "u1", "otro"), (3, "u2", "UNO  dos"), (4, "u3", ""), (5, "u4", ""), (6, "u5", None), (7, None, "tres")]
    notes = spark.createDataFrame(rows, "id long, url string, cuerpo string").selectExpr("*", "'x' _winner")
    assert sorted(r["id"] for r in corpus.first_captures(notes, "url", "cuerpo", "id").collect()) == [1, 4, 5, 6, 7]
    stored = spark.createDataFrame([("u1", "a"), ("u9", "b")], "url string, v string")
    assert {tuple(r) for r in corpus.merge_columns(stored, spark.createDataFrame([("u1", "z"), ("u2", "y")], "url string, v string"), "url", ("v",)).collect()} == {("u1", "z"), ("u9", "b")}
    assert {tuple(r) for r in corpus.upsert(stored, spark.createDataFrame([("u1", "z")], "url string, v string"), ("url",)).collect()} == {("u1", "z"), ("u9", "b")}
    labels = spark.createDataFrame([("p", "p"), ("p", "n"), ("n", "n"), ("", "n"), (None, "p")], "a string, b string")
    assert corpus.kappa(labels, "a", "b").first()["kappa"] == 0.4
    assert corpus.kappa(labels.where("false"), "a", "b").count() == 0


def test_series(spark):
    rows = spark.createDataFrame([(dt.date(2026, 1, 1), 2.0), (dt.date(2026, 1, 3), None), (dt.date(2026, 1, 3), 4.0), (None, 1.0)], "day date, v double")
    daily = series.moving_average(series.daily(rows, "day", F.col("v")), "day", "volume")
    assert [(r["volume"], r["mean"], r["volume_ma"]) for r in daily.orderBy("day").collect()] == [(1, 2.0, 0.5), (0, None, 1.0), (2, 4.0, 1.0)]
    assert series.daily(rows.where("false"), "day", F.col("v")).count() == 0


def test_entities_and_graph(spark):
    docs = spark.createDataFrame([(1, "Ana Ruiz vio a Luis Mora y Eva Sanz"), (2, "Ana Ruiz y Luis Mora. Eva Sanz"), (3, "Ana Ruiz y Luis Mora"), (4, None)], DOCS)
    index = entities.entity_index(docs)
    edges = graph.cooccurrence(index, "doc_id", "entity", 2)
    assert {tuple(r) for r in edges.collect()} == {("Ana Ruiz", "Luis Mora", 3), ("Ana Ruiz", "Eva Sanz", 2), ("Eva Sanz", "Luis Mora", 2)}
    assert graph.summary(edges).first()["density"] == 1.0
    assert {r["component"] for r in graph.components(edges).collect()} == {"Ana Ruiz"}
    assert {r["coefficient"] for r in graph.clustering(edges).collect()} == {1.0}
    assert abs(sum(r["rank"] for r in graph.pagerank(edges).collect()) - 1) < 1e-9
    assert "Eva Sanz" in sinks.gexf(graph.degrees(edges), edges) and sinks.node_link(graph.degrees(edges), edges).count() == 1
    ranked = {(r["doc_id"], r["actor"]): r["rank"] for r in entities.prominence(docs, {"E": ("Eva",), "A": ("Ana", "Ana Ruiz")}).collect()}
    assert ranked == {(1, "A"): 1, (1, "E"): 2, (2, "A"): 1, (2, "E"): 2, (3, "A"): 1}
    assert graph.components(edges.where("false")).count() == 0


def test_clustering_in_blocks_against_brute_force(spark, monkeypatch):
    import random
    from collections import Counter
    from itertools import combinations

    rng = random.Random(8)
    index = sorted({(k, f"n{rng.choice((rng.randrange(12), rng.randrange(300)))}") for k in range(400) for _ in range(rng.randrange(9))}) + [(900, "n1"), (900, "n1"), (901, None)]
    nobody = [(None, "n1"), (None, "n2"), (None, "alone")]
    frame = spark.createDataFrame(index + nobody, "doc_id long, entity string")
    held = {}
    for k, x in set(index):
        held.setdefault(k, set()).add(x)
    pairs = Counter(p for x in held.values() for p in combinations(sorted(y for y in x if y), 2))
    near = {}
    for (a, b), n in pairs.items():
        if n >= 2:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    expected = {}
    for x, own in near.items():
        t = sum(b in near[a] for a, b in combinations(sorted(own), 2))
        expected[x] = (t, round(2 * t / (len(own) * (len(own) - 1)), 4) if len(own) > 1 else 0.0)
    assert max(t for t, _ in expected.values()) > 5
    for block in (64, 8192):
        monkeypatch.setattr(graph, "BLOCK", block)
        monkeypatch.setattr(graph, "PAIRS", block)
        for made in (graph.cooccurrence_clustering(frame, "doc_id", "entity", 2), graph.clustering(graph.cooccurrence(frame, "doc_id", "entity", 2))):
            assert {r["node"]: (r["triangles"], r["coefficient"]) for r in made.collect()} == expected
    assert graph.cooccurrence_clustering(frame.where("false"), "doc_id", "entity", 2).count() == graph.clustering(graph.cooccurrence(frame.where("false"), "doc_id", "entity")).count() == 0


def test_components_of_a_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1, 1) for i in range(60)] + [(100, 101, 1)], "src int, dst int, weight int")
    found = {r["node"]: r["component"] for r in graph.components(edges).collect()}
    assert set(found.values()) == {0, 100} and found[60] == 0


def test_similar_pairs_against_brute_force(spark):
    import random

    rng = random.Random(1)
    words = [f"w{i}" for i in range(40)]
    base = [[rng.choice(words) for _ in range(30)] for _ in range(12)]
    rows = [(i, " ".join(b)) for i, b in enumerate(base)] + [(100 + i, " ".join(b[:-2] + ["w1", "w2"])) for i, b in enumerate(base)] + [(200, " ".join(base[0])), (300, None)]
    docs = spark.createDataFrame(rows, DOCS)
    vectors: dict = {}
    for r in similarity.tfidf(docs.where("doc_id != 200"), 200_000).collect():
        vectors.setdefault(r["doc_id"], {})[r["term"]] = r["w"]
    expected = {(a, b) for a in vectors for b in vectors if a < b and round(sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()), 4) >= 0.8}
    assert {(r["doc_id_a"], r["doc_id_b"]) for r in similarity.similar_pairs(docs.where("text is not null or doc_id = 300")).collect()} == expected and expected


def test_similar_pairs_write_no_vectors_of_all_documents(spark, monkeypatch):
    import random

    rng = random.Random(11)
    words = [f"p{i}" for i in range(150)]
    base = [rng.choices(words, [1 / (i + 1) for i in range(150)], k=rng.choice((3, 20, 60))) for _ in range(40)]
    rows = list(enumerate(" ".join(b) for b in base))
    # copies with some other words, texts of frequent words only, and what has no terms
    rows += [(100 + i, " ".join(rng.choice(words) if rng.random() < 0.04 * (i % 4) else w for w in b)) for i, b in enumerate(base)]
    rows += [(200, "p0 p1 p0 p2 p1"), (201, "p0 p1 p0 p2 p1 p0"), (202, "p1, P0 p1 p0"), (203, rows[5][1]), (204, "..."), (205, " "), (206, None)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    vectors: dict = {}
    for r in similarity.tfidf(docs.where("trim(coalesce(text, '')) != '' and doc_id != 203").dropDuplicates(["text"]), 200_000).collect():
        vectors.setdefault(r["doc_id"], {})[r["term"]] = r["w"]
    materialised, cut = [], similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df: (x := cut(df), materialised.append(x.count()))[0])
    for name, small in (("WORDS", 200), ("PAIRS", 50), ("CLASSES", 3), ("SPLIT_ROWS", 7)):
        monkeypatch.setattr(similarity, name, small, raising=False)
    least = {}
    for k, t in sorted(rows, reverse=True):
        least[t] = k
    for threshold in (0.8, 0.55):
        materialised.clear()
        expected = {(*sorted((least[dict(rows)[a]], least[dict(rows)[b]])), s) for a in vectors for b in vectors if a < b and (s := round(sum(w * vectors[b].get(t, 0) for t, w in vectors[a].items()), 4)) >= threshold}
        found = {(r["doc_id_a"], r["doc_id_b"]): r["similarity"] for r in similarity.similar_pairs(docs, threshold).collect()}
        assert {x[:2] for x in expected} == found.keys() and all(abs(found[a, b] - s) < 2e-4 for a, b, s in expected) and len(expected) > 10
        # classes of texts, and candidates
        assert sum(materialised) < 1000


def test_attribution_keeps_no_vectors_of_documents(spark, monkeypatch):
    import math
    import random
    from collections import Counter

    rng = random.Random(3)
    words = ["Ñandú", "a", "casa", "árbol", "日本", "perro", "El", "x2", "moño", "lento", "río"]
    rows = [(i, "\n ".join(rng.choices(words, [1 + (j * (i % 5)) % 7 for j in range(len(words))], k=40)), None if i % 6 == 0 else f"m{i % 5}") for i in range(60)] + [(90, None, "m1"), (91, " ", None), (92, "qqq", "m7")]
    materialised, cut = [], similarity.cut
    monkeypatch.setattr(similarity, "cut", lambda df: (x := cut(df), materialised.append(x.count()))[0])
    found = {(r["doc_id"], r["rank"]): (r["author"], r["similarity"]) for r in similarity.attribution(spark.createDataFrame(rows, "doc_id long, text string, source string"), "source", "source is null").collect()}
    # what is written to disk follows the authors, not the documents
    assert sum(materialised) <= 6
    counts = {i: Counter(p[j : j + k] for w in (t or "").lower().split() for p in [f" {w} "] for k in (2, 3, 4) for j in range(len(p) - k + 1)) for i, t, _ in rows}
    df = Counter(g for c in counts.values() for g in c)
    unit = {}
    for i, c in counts.items():
        w = {g: (1 + math.log(n)) * (math.log((1 + len(rows)) / (1 + df[g])) + 1) for g, n in c.items()}
        unit[i] = {g: x / math.sqrt(sum(y * y for y in w.values())) for g, x in w.items()}
    expected = {}
    means = {m: Counter() for _, _, m in rows if m}
    for i, _, m in rows:
        if m:
            means[m].update(unit[i])
    for i, _, m in rows:
        if m is None:
            scores = sorted((-round(sum(x * c[g] for g, x in unit[i].items()) / math.sqrt(sum(y * y for y in c.values())), 4), a) for a, c in means.items() if unit[i].keys() & c.keys())
            expected |= {(i, k): (a, -s) for k, (s, a) in enumerate(scores[:3], 1)}
    assert found.keys() == expected.keys() and all(abs(found[k][1] - expected[k][1]) < 2e-4 for k in found)
    monkeypatch.setattr(similarity, "AUTHORS", 2)
    again = similarity.attribution(spark.createDataFrame(rows, "doc_id long, text string, source string"), "source", "source is null")
    assert {(r["doc_id"], r["rank"]): (r["author"], r["similarity"]) for r in again.collect()} == found


def test_sources(spark, tmp_path):
    xml = "<rss><channel><item><link>http://a</link><title>Uno - Diario</title><pubDate>Tue, 03 Feb 2026 10:00:00 GMT</pubDate></item><item><link>http://b</link><title>Dos</title><pubDate>x</pubDate><source>El Eco</source></item></channel></rss>"
    items = {r["link"]: r for r in feeds.rss_items(spark.createDataFrame([(xml,)], "xml string")).collect()}
    assert items["http://a"]["outlet"] == "Diario" and items["http://a"]["headline"] == "Uno" and str(items["http://a"]["date"]) == "2026-02-03"
    assert items["http://b"]["outlet"] == "El Eco" and items["http://b"]["date"] is None
    (tmp_path / "u.txt").write_text("# no\n\n http://x \n")
    assert [r["url"] for r in feeds.addresses(spark, str(tmp_path / "u.txt")).collect()] == ["http://x"]
    assert feeds.Criteria(terms=["Uno", "uno ", "Dos"]).terms == ["Uno", "Dos"]
    with pytest.raises(ValueError):
        feeds.Criteria(first="2026-02-01", last="2026-01-01")
    page = spark.createDataFrame([(1, "<title>T</title><p class='a'>" + "x" * 40 + "</p><p>corto</p>"), (2, None)], "captura_id long, html string")
    assert [tuple(r) for r in html.articles(page).collect()] == [(1, "T", "x" * 40)]


def test_streaming(spark, tmp_path):
    source, out = str(tmp_path / "in"), str(tmp_path / "out")
    rows = [(1, "u1", "uno"), (2, "u1", "dos"), (3, "u2", "uno"), (4, "u3", "")]
    spark.createDataFrame(rows, "id long, url string, cuerpo string").write.parquet(source)
    incremental.ingest(incremental.event_stream(spark, source), out)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 4]
    spark.createDataFrame([(5, "u3", "tres"), (6, "u6", "UNO"), (7, "u7", "cuatro")], "id long, url string, cuerpo string").write.parquet(str(tmp_path / "in2"))
    incremental.ingest(incremental.event_stream(spark, str(tmp_path / "in2")), out)
    assert sorted(r["id"] for r in spark.read.parquet(out).collect()) == [1, 4, 7]


def test_pagerank_runs_until_it_converges(spark):
    star = spark.createDataFrame([("hub", f"leaf{i:02}", 1) for i in range(50)], "src string, dst string, weight long")
    ranks = {r["node"]: r["rank"] for r in graph.pagerank(star).collect()}
    # hub = 0.15 / 51 + 0.85 x leaves, leaves = 50 x 0.15 / 51 + 0.85 x hub
    exact = (0.15 / 51 + 0.85 * 50 * 0.15 / 51) / (1 - 0.85**2)
    assert abs(ranks["hub"] - exact) < 51e-6 * 6 and abs(sum(ranks.values()) - 1) < 1e-9


def test_canonical_people_by_token_sets_and_seeds(spark):
    names = ["Ana María Ruiz Mora", "Ruiz Mora", "ruiz", "Ana Ruíz", "De la Paz", "J. P.", "Mora", "El Profe", "Luis Paz", None]
    frame = spark.createDataFrame([(n,) for n in names], "name string")
    seeds = spark.createDataFrame([("el profe", "Luis Paz Gil"), (None, "x")], "form string, canonical string")
    found = {r["name"]: r["canonical"] for r in entities.canonical_people(frame, seeds, ("de", "la")).collect()}
    whole = "Ana María Ruiz Mora"
    # "Paz" is held by "Luis Paz"; a name without tokens stays; declared forms win
    assert found == {whole: whole, "Ruiz Mora": whole, "ruiz": whole, "Ana Ruíz": whole, "Mora": whole, "De la Paz": "Luis Paz", "Luis Paz": "Luis Paz", "J. P.": "J. P.", "El Profe": "Luis Paz Gil"}
    assert entities.canonical_people(frame.where("false"), seeds, ()).count() == 0


def test_fragments_are_no_names(spark):
    words = {"connectors": ("además",), "verbs": ("dijo",), "common": ("ley",), "kept": ("m-19",), "openings": ("de",), "signals": ("foto",)}
    cases = {"": "vacia", "Además": "conector", "Dijo": "verbo", "Dijo Ana": "verbo", "Ley": "generico", "M-19": None, "Grupo 7": "cifra", "¿Quién": "signo", "ana": "minuscula", "De Ana": "comienzo", "Xi": "corta", "Ana\nRuiz": "salto", "Reiteró": "conjugada", "A B C D E F": "larga", "Ana Ruiz Foto": "fragmento", "Ana Ruiz": None}
    rows = spark.createDataFrame([(k,) for k in cases], "entity string")
    assert {r["entity"]: r["why"] for r in rows.select("entity", entities.fragment(F.col("entity"), words).alias("why")).collect()} == cases


def test_review_of_entities(spark):
    index = spark.createDataFrame([("Ana", 1), ("Ana", 2), ("Ana", 3), ("Luz", 1), ("Luz", 2), ("Sol", 9), ("Mar", 4)], "entity string, doc_id long")
    seeds = spark.createDataFrame([("SOL",), (None,)], "form string")
    assert {tuple(r) for r in review.queue(index, seeds).collect()} == {("Luz", 2, 0.55, "amarillo"), ("Mar", 1, 0.3, "rojo")}
    decided = spark.createDataFrame([("Ana", "renombrada", "Luz"), ("Mar", "descartada", None), ("Sol", "verificada", "")], "name string, decision string, new_name string")
    after = review.reviewed(index, decided, "descartada", "renombrada")
    assert sorted(tuple(r) for r in after.collect()) == [("Luz", 1), ("Luz", 2), ("Luz", 3), ("Sol", 9)]
    stored = spark.createDataFrame([("Luz", "pendiente", 0.1), ("Mar", "verificada", 0.9)], "name string, decision string, score double")
    assert {tuple(r) for r in review.merged(stored, review.queue(index, seeds), "pendiente").collect()} == {("Luz", "pendiente", 0.55), ("Mar", "verificada", 0.9)}


def test_rollups(spark):
    days = spark.createDataFrame([(dt.date(2026, 1, d), w) for d, w in ((1, 1), (10, 40), (11, 50), (12, 9))], "day date, w long")
    assert tuple(rollups.dense_range(days, "day", "w", 0.9).first()) == (dt.date(2026, 1, 10), dt.date(2026, 1, 11), 2, dt.date(2026, 1, 11))
    named = spark.createDataFrame([("Ana", 1), ("Ana", 2), ("Ana", 2), ("Luz", 3)], "actor string, doc_id long")
    notes = spark.createDataFrame([(1, "positivo", 1.0, "b", None), (2, "negativo", -0.5, "a", "f"), (3, "neutro", 0.0, None, None)], "doc_id long, label string, score double, emotion string, frame string")
    rows = {r["actor"]: r for r in rollups.compared(named, notes).collect()}
    assert (rows["Ana"]["n"], rows["Ana"]["score"], rows["Ana"]["emotion"], rows["Ana"]["frame"], rows["Ana"]["affective"]) == (2, 0.25, "a", "f", 1.0) and rows["Luz"]["affective"] == 0.0
    seeds = spark.createDataFrame([("Ana", "persona", '["Anita"]'), ("Ana", "", None), (None, "x", None)], "nombre string, tipo string, formas string")
    assert {tuple(r) for r in rollups.typed_forms(seeds.where("nombre is not null")).collect()} == {("ana", "persona"), ("anita", "persona")}


def test_whole_graph_measures(spark):
    star = spark.createDataFrame([("hub", x, 1) for x in "abcd"] + [("x", "y", 2), ("y", "z", 2), ("x", "z", 2)], "src string, dst string, weight int")
    near = {r["node"]: (r["closeness"], r["eccentricity"]) for r in graph.closeness(star).collect()}
    assert near["hub"] == (round(4 / 4 * 4 / 7, 6), 1) and near["a"] == (round(4 / 7 * 4 / 7, 6), 2)
    assert tuple(graph.shape(star).first()) == (8, 7, 4, 1, 2, False) and graph.shape(star.where("src = 'hub'")).first()["bipartite"]
    between = {r["node"]: r["betweenness"] for r in graph.betweenness(star).collect()}
    assert between["hub"] == round(12 / 42, 6) and between["a"] == between["x"] == 0.0
    groups = {r["node"]: r["community"] for r in graph.communities(star).collect()}
    assert groups["x"] == groups["y"] == groups["z"] and groups["hub"] == groups["a"] != groups["x"]
    both = graph.modularity(star, graph.communities(star)).first()
    assert both["communities"] == 2 and 0.4 < both["modularity"] < 0.5
    # hub, x, y and z are equally strong
    assert graph.strongest(star, 4).count() == 3 and graph.strongest(star, 1).count() == 0


def test_structured_extraction(spark):
    linked = '<script type="application/ld+json">{"headline": "Un título", "author": {"name": "Ana Ruiz"}, "datePublished": "2026-01-31", "articleSection": "Vida"}</script>'
    body = "<p>" + "palabra " * 45 + "<b>fin</b></p>"
    rows = [(1, linked + "<article>" + body + "</article><p>" + "menú " * 20 + "</p>"), (2, '<title>Otro</title><meta name="author" content="Luz"><p class="x">Una frase con <a href="#">enlace</a> y más de treinta letras</p>'), (3, None), (4, "")]
    found = {r["captura_id"]: r for r in html.structured(spark.createDataFrame(rows, "captura_id long, html string")).collect()}
    assert found[1][1:5] == ("Un título", "Ana Ruiz", "2026-01-31", "Vida") and found[1]["body"].endswith("fin") and found[1]["method"] == "datos"
    assert found[2]["title"] == "Otro" and found[2]["author"] == "Luz" and found[2]["body"] == "Una frase con enlace y más de treinta letras" and 3 not in found and found[4]["body"] == ""


def test_shared_folder_and_unreadable_tables(spark, tmp_path):
    from rotativa.session import bounded_broadcast, shared_folder

    assert shared_folder(spark) == spark.conf.get("spark.checkpoint.dir")
    assert not incremental.exists(spark, str(tmp_path / "none")) and incremental.exists(spark, str(tmp_path))
    wide = spark.createDataFrame([("x" * 1000,)] * 5, "a string")
    hinted = lambda df: "ResolvedHint" in df._jdf.queryExecution().analyzed().toString()
    assert hinted(bounded_broadcast(wide)) and not hinted(bounded_broadcast(wide, max_rows=4)) and not hinted(bounded_broadcast(wide, max_bytes=4000))


def test_profiles_criteria_and_sinks(spark, tmp_path):
    from rotativa.sources import profile

    path = str(tmp_path / "profile.json")
    assert profile.load(path) == profile.DEFAULTS
    profile.save({"temas": 8, "periodo": {"desde": "2026-01-01"}, "medios": {"local": [{"nombre": "El Faro", "dominio": "faro.example"}]}, "entidades": [{"nombre": "Ana Ruiz", "tipo": "persona", "variantes": ["A. Ruiz", "ana ruiz", " "]}]}, path)
    held = profile.load(path)
    assert held["temas"] == 8 and held["periodo"] == {"desde": "2026-01-01", "hasta": ""} and held["ventana"] == 6
    assert [tuple(r) for r in profile.outlets(spark, held).collect()] == [("El Faro", "faro.example", "local")]
    assert {tuple(r) for r in profile.forms(spark, held).collect()} == {("Ana Ruiz", "Ana Ruiz", "persona"), ("A. Ruiz", "Ana Ruiz", "persona")}
    assert profile.restore(path) == profile.DEFAULTS and profile.forms(spark, profile.load(path)).count() == 0
    wanted = feeds.Criteria(terms=["Uno", "uno", "dos"], first="2026-01-01", last="2026-02-01")
    wanted.save(str(tmp_path / "criteria.json"))
    assert feeds.Criteria.load(str(tmp_path / "criteria.json")) == wanted and wanted.terms == ["Uno", "dos"]
    sinks.csv(spark.createDataFrame([(2, ["a", "b"]), (1, None)], "id int, list array<string>"), str(tmp_path / "out"), ("id",), ("manual",))
    rows = spark.read.option("header", True).csv(str(tmp_path / "out")).collect()
    assert {(r["id"], r["list"], r["manual"]) for r in rows} == {("1", None, None), ("2", "a; b", None)}
    edges = spark.createDataFrame([("a", "b", 2), ("b", "c", 1)], "src string, dst string, weight long")
    nodes, back = sinks.graph_of(sinks.node_link(graph.degrees(edges), edges))
    assert {tuple(r) for r in back.collect()} == {("a", "b", 2), ("b", "c", 1)} and nodes.count() == 3
    assert corpus.evolved(edges, "src string, note string").columns == ["src", "dst", "weight", "note"]


def test_confidence_scores(spark):
    rows = spark.createDataFrame([(1, True, False, 0.8, 0.9), (2, False, True, 0.1, 0.1), (3, False, False, 0.4, 0.6)], "i int, k boolean, v boolean, a double, b double")
    found = rows.orderBy("i").select(review.entity_confidence(F.col("k"), F.col("v"), F.col("a"), F.col("b")).alias("e"), review.tone_confidence(F.col("b"), ~F.col("k")).alias("t"), review.recognition_confidence(F.col("a") * 100, F.col("v")).alias("r")).collect()
    assert [(r["e"], round(r["t"], 3), r["r"]) for r in found] == [(0.905, 0.9, 0.8), (1.0, 0.2, 0.25), (0.37, 0.7, 0.4)]


def test_charged_words_and_links(spark):
    words = Lexicon(positive=("bueno",), negative=("malo",), negators=(), emotions={}, frames={}, subjective=(), factual=(), groups={})
    docs = spark.createDataFrame([(1, "Malo uno dos tres cuatro el tribunal bueno y malo"), (2, "tribunal"), (3, None), (4, "bueno tribunal bueno tribunal")], DOCS)
    found = {(r["word"], r["charge"]): r["n"] for r in tone.charged_words(docs, {"T": "tribunal"}, words).collect()}
    assert found == {("bueno", 1): 5, ("malo", -1): 1}
    forms = spark.createDataFrame([(1, "Ana Ruiz Mora"), (2, "Luis Ruiz"), (3, None)], "ent_id long, form string")
    names = spark.createDataFrame([("Ána Mora",), ("Ruiz",), ("Nadie",), (None,)], "name string")
    assert {tuple(r) for r in entities.linked(names, forms, ("de",)).collect()} == {("Ána Mora", 1, 0.667), ("Ruiz", 2, 0.5)}
