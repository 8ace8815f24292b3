"""Boilerplate, residue, repeated lines, truncation, wrong encodings: small cases with known results."""

import random

import pytest

from rotativa.llm import boilerplate, mojibake, repeated_lines, residue, truncation

NOTES = "id long, medio string, titular string, cuerpo string"


def test_longest_common_lines_against_brute_force():
    rng = random.Random(3)

    def brute(a, b):
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        return best[-1][-1]

    for _ in range(200):
        a, b = ([rng.randrange(6) for _ in range(rng.randrange(12))] for _ in "ab")
        left, right = boilerplate.common_lines(a, b)
        assert len(left) == len(right) == brute(a, b)
        assert [a[i] for i in left] == [b[j] for j in right]
        assert left == sorted(left) and right == sorted(right)


def test_keys_of_lines():
    keys = boilerplate.line_keys
    assert keys("Vida · Cultura · Gente")[:3] == (["vida", "cultura", "gente"], 2, 3)
    assert keys("Lea también: Otra nota")[0] == keys("Lea también: Una nota muy distinta de la otra, con muchas más palabras")[0] == ["lea tambin *"]
    assert keys("3. Uno")[0] == keys("12. Dos tres")[0] == ["0 *"]
    assert keys("Una pausa")[0] != keys("El contexto")[0] and keys("  \t ") is None
    # a long line is taken whole
    lead = "El presidente del consejo anunció ayer un plan de obras para los barrios del norte"
    other = "El presidente del consejo desmintió hoy que la empresa haya cerrado sus plantas costeras"
    bands = boilerplate.band_keys(boilerplate.minima(boilerplate.wordings([lead, other, lead.replace("ayer", "hoy")])))
    assert not keys(lead)[0] and (bands[0] == bands[1]).sum() <= 1 and (bands[0] == bands[2]).sum() >= 2
    assert boilerplate.wordings(["Ayer Ana Ruiz leyó «Un título» en 3f2 casas, dijo.", "«Todo»", ""]).to_pylist() == [["ayer", "ley", "en", "casas", "dijo"], ["todo"], [""]]
    whole = boilerplate.band_keys(boilerplate.minima(boilerplate.wordings(["uno dos", "", "dos uno"])))
    assert (whole[0] == whole[2]).all() and len(whole) == 3 and len(boilerplate.band_keys(boilerplate.minima(boilerplate.wordings([])))) == 0
    one, two = boilerplate.page_keys(["Noticias de El Faro hoy", "Noticias de EL OTRO hoy"], ["h", "h"], ["El Faro", "El Otro"])
    assert one.keys[1] == two.keys[1] and one.line == [0, 0]


def _site():
    rng = random.Random(5)
    verbs = ["firmó", "revisó", "frenó", "amplió", "negó", "pidió"]
    rows = []
    one = lambda: f"{rng.choice(['Ayer', 'Hoy', 'Luego'])} la {rng.choice('abcdefgh')}{rng.randrange(999)} {rng.choice(verbs)} el {rng.choice('abcdefgh')}{rng.randrange(999)} del {rng.randrange(999)}o barrio."
    two = lambda: f"Después el {rng.randrange(99)}x {rng.choice(verbs)} la {rng.randrange(99)}y."
    for i in range(60):
        # running text: its sentences come in any order
        body = [" ".join(rng.sample([one(), two()], 2)) for _ in range(3)]
        lines = ["Vida · Cultura · Gente · Mundo", *body, f"Etiquetas: {rng.choice(['Ana', 'Luz'])}, Paz", "Reciba cada mañana el boletín del diario en su correo"]
        rows.append(("notas", i, "diario.example", f"/a/{i:03}", "\n".join(lines)))
    return rows


def test_furniture_is_found_and_paragraphs_stay(spark):
    pages = spark.createDataFrame([*_site(), ("notas", 900, None, None, None), ("notas", 901, "diario.example", "/z", ""), ("notas", 902, "x.example", "/q", "\n \n")], "tabla string, id long, host string, path string, texto string")
    found = {(r["id"], r["linea"]) for r in boilerplate.furniture(pages, ["Diario"]).collect()}
    assert found == {(i, n) for i in range(60) for n in (0, 4, 5)}
    content = {r["id"]: r["texto"] for r in boilerplate.main_content(pages, ["Diario"]).collect()}
    assert len(content) == 63 and content[900] is None and content[901] == "" and len(content[3].split("\n")) == 3
    assert boilerplate.furniture(pages.where("false"), []).count() == 0


def test_lines_are_judged_whole_not_by_their_opening(spark):
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(7))
    rows = []
    for t, h, i, p, text in _site():
        article = f"Unas {rng.randrange(99)} personas de Nardil " + " ".join(word() for _ in range(14)) + "."
        rows.append((t, h, i, p, text + "\n" + article))
    rows[7] = (*rows[7][:4], rows[7][4] + "\nReciba cada mañana el " + " ".join(word() for _ in range(14)) + ".")
    pages = spark.createDataFrame(rows, "tabla string, id long, host string, path string, texto string")
    found = {(r["id"], r["linea"]) for r in boilerplate.furniture(pages, ["Diario"]).collect()}
    # every page has a sentence with that opening, and page 7 one that opens like the prompt
    assert found == {(i, n) for i in range(60) for n in (0, 4, 5)}


def test_pairs_do_not_depend_on_partitions(spark):
    rng = random.Random(4)
    rows = []
    for t, i, _, p, text in _site():
        rows.append((t, i, rng.choice(["a.example", "b.example", None]), rng.choice([p, None]), text + ("\nHazte socio y apoya" if i % 9 == 0 else "")))
    pages = spark.createDataFrame(rows, "tabla string, id long, host string, path string, texto string")
    read = [(r["tabla"], r["host"] or "", r["path"] or "", r["id"], r["texto"]) for r in pages.where("texto is not null").collect()]
    made = boilerplate.page_keys([r[4] for r in read], [r[1] for r in read], [])
    ordered = sorted((r[:4], m.keys, m.long) for r, m in zip(read, made, strict=True))
    seen, matched = {}, {}
    for x, (a, keys_a, long_a) in enumerate(ordered):
        for b, keys_b, long_b in ordered[x + 1 : x + 1 + boilerplate.NEIGHBOURS]:
            if a[:2] == b[:2]:
                shared = boilerplate.shared_keys((*a[:2], keys_a, long_a, set(keys_a), set(long_a)), (*b[:2], keys_b, long_b, set(keys_b), set(long_b)))
                for keys in (keys_a, keys_b) if shared is not None else ():
                    for k in set(keys):
                        seen[a[0], k] = seen.get((a[0], k), 0) + 1
                for k in shared or ():
                    matched[a[0], k] = matched.get((a[0], k), 0) + 2
    for partitions in (1, 4, 23):
        counts = {(r["tabla"], r["s"]): (r["seen"], r["matched"]) for r in boilerplate.evidence(boilerplate.keys_of(pages, []), boilerplate.NEIGHBOURS, partitions).collect()}
        assert counts == {k: (n, matched.get(k, 0)) for k, n in seen.items()}
    rows = [sorted(tuple(r) for r in boilerplate.furniture(pages, [], partitions=n).collect()) for n in (8, 200)]
    assert rows[0] == rows[1] and rows[0]


def test_residue(spark):
    long = "La comisión revisó el acuerdo de la sesión. " * 20_000
    rows = [
        (1, "a", "{{titular}}", "El tribunal revisó la sentencia."),
        (2, "a", "Título sano", "404 Not Found\nnginx/1.20.1"),
        (3, "a", "El portal mostró un error 404", "El portal de Villa Sol mostró un error 404 durante 12 minutos, y nadie supo por qué."),
        (4, "a", None, None),
        (5, "a", "", "   \n\n"),
        (6, "a", "Prueba de fuego para el alcalde", "Un paso que [INSERTAR CIFRA] nadie esperaba.\nOtra línea."),
        (7, "a", "x", "El formulario usa llaves {} y corchetes [], explicó Ana [sic]."),
        (8, "a", "x", "Lorem ipsum culpa aliqua dolor elit enim magna aliqua aute"),
        (9, "a", "x", long),
        (10, "a", "x", long + "\nAcceso denegado. No tiene permiso para ver esta página."),
        (10, "a", "x", "Acceso denegado"),
    ]
    df = spark.createDataFrame(rows, NOTES).selectExpr("*", "'clash' texto", "'clash' campo")
    assert sorted((r["id"], r["campo"]) for r in residue.residue(df).distinct().collect()) == [(1, "titular"), (2, "cuerpo"), (6, "cuerpo"), (8, "cuerpo"), (10, "cuerpo")]
    assert residue.residue(df.where("false")).count() == 0


def _newsroom(n=60):
    rng = random.Random(7)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(7))
    article = lambda: "\n".join(" ".join(["la", *(word() for _ in range(12))]) + "." for _ in range(4))
    return [(i, f"m{i % 7}", f"Un título {word()} {word()}", article() + "\nSíguenos en redes") for i in range(n)], article


def test_notices_on_no_list_are_mined(spark):
    rows, article = _newsroom()
    # wordings unknown to the operator: they stand alone in several records, once beside text
    rows += [(200 + i, "m1", f"Otro título {'abcdefgh'[i]}", f"Servidor saturado, vuelva dentro de unos instantes\nTurno {i}77") for i in range(8)]
    rows += [(300, "m2", "Un caso mixto", article() + "\nServidor saturado, vuelva dentro de unos instantes")]
    # furniture alone on a page is no notice, nor is an article captured six times, nor are leads that begin like notices
    rows += [(400, "m3", "Solo enlaces", "Síguenos en redes")] + [(410 + i, "m4", "El mismo", rows[0][3]) for i in range(6)]
    rows += [(420, "m4", "Obras", "Acceso restringido al centro histórico desde mañana por las obras del puente viejo."), (421, "m4", "Web", "La página no existe para los vecinos del barrio que siguen sin conexión, dijo el alcalde.")]
    df = spark.createDataFrame(rows, NOTES)
    found = sorted({(r["id"], r["campo"]) for r in residue.residue(df).collect()})
    assert found == [*((200 + i, "cuerpo") for i in range(8)), (300, "cuerpo")]


def test_titles_of_a_notice(spark):
    rows, article = _newsroom()
    rows += [(500 + i, "m5", "Nota sin redactar aquí", article()) for i in range(6)] + [(600 + i, "m5", "Editorial", article()) for i in range(6)]
    rows += [(700, "m5", "404 Not Found", article()), (701, "m5", "Título de la nota aquí", None)]
    found = {(r["id"], r["campo"]) for r in residue.residue(spark.createDataFrame(rows, NOTES)).collect()}
    assert {(700, "titular"), (701, "titular")} <= found and not {x for x in found if 600 <= x[0] < 700 or x[0] < 100}


def test_masked_units_and_paths():
    import pyarrow as pa

    masked, rows = residue.units(pa.array(["Ayer Ana Ruiz dijo «Hola. Sí» en 3f2. Otra vez\n404 Not Found", ""]))
    assert masked.to_pylist() == ["ayer 1 dijo 0 en 0", "otra vez", "0 not found", ""] and rows.tolist() == [0, 0, 0, 1]
    path, size = residue.leaves(pa.array(["a b", "a b", "a", ""]))
    assert path[0] == path[1] != path[2] and size.tolist() == [2, 2, 1, 0]


def test_repeated_lines(spark):
    rows = [(i, "m", None, f"Línea propia {chr(97 + i)}\n  SÍGUENOS en {i}\xa0redes ") for i in range(8)] + [(20, None, None, "Síguenos en 3 redes"), (21, "m", None, None), (22, "m", None, ""), (0, "m", None, "síguenos en 99 redes\nsíguenos en 7 redes")]
    df = spark.createDataFrame(rows, NOTES).selectExpr("*", "1 h", "2 linea")
    assert sorted((r["id"], r["linea"]) for r in repeated_lines.occurrences(df).collect()) == sorted([(i, 1) for i in range(8)] + [(0, 0), (0, 1)])
    clean = {(r["id"], r["cuerpo"], r["removed"]) for r in repeated_lines.without_repeated(df).collect()}
    assert (3, "Línea propia d", 1) in clean and (20, "Síguenos en 3 redes", 0) in clean and (21, None, 0) in clean and (22, "", 0) in clean and (0, "", 2) in clean
    assert repeated_lines.occurrences(df.where("false")).count() == 0


@pytest.mark.parametrize("written, read", [("utf-8", "cp1252"), ("utf-8", "mac_roman"), ("utf-8", "cp850"), ("cp1252", "mac_roman"), ("cp1252", "cp850")])
def test_chains_are_undone(written, read):
    word = "canción"
    chain = mojibake.CHAINS.index(((written, read),))
    assert mojibake.unread(word.encode(written).decode(read), chain) == word


def test_garbled_fields_are_found_and_repaired(spark):
    sound = "La sesión de la comisión revisó el acuerdo económico y la señora Núñez pidió más información según el público"
    rows = [(i, "m", "Título común", sound) for i in range(200)]
    rows += [(1000 + i, "n", "Título común", sound.encode().decode("cp1252")) for i in range(8)]
    rows += [(2000, "m", "Tom�s lleg�", "«SÃO JOÃO» (√ de 5)"), (2001, "m", "Qui?n vi? el informe?", "¿Quién lo vio?"), (2002, None, None, None), (2003, "m", "", "plain ascii only?")]
    df = spark.createDataFrame(rows, NOTES)
    found = {(r["id"], r["campo"]) for r in mojibake.garbled(df).collect()}
    assert found == {(1000 + i, "cuerpo") for i in range(8)} | {(2000, "titular"), (2001, "titular")}
    mended = {(r["id"], r["campo"]): r["texto"] for r in mojibake.repaired(df).collect()}
    assert mended[1003, "cuerpo"] == sound and mended[2000, "titular"] == "Tom�s lleg�"
    assert mojibake.garbled(df.where("false")).count() == 0


def _posts(n, rng):
    people, things = ["Ana Ruiz", "Luis Mora", "Eva Sanz", "Juan Gil"], ["el acuerdo", "la sesión", "el informe", "la reforma", "el debate"]
    out = []
    for i in range(n):
        text = " ".join(f"{rng.choice(people)} dijo que {rng.choice(things)} de {rng.choice(['Norte', 'Sur', 'Este'])} sigue en pie {rng.choice(['desde enero', 'hace días', 'por ahora'])}." for _ in range(rng.randrange(1, 5)))
        out.append((i, "x", text + rng.choice(["", " #Norte", " jajaja", " 😂", " https://enlace.example/ab12"])))
    return out


def test_truncation_held_out_accuracy(spark):
    rng = random.Random(2)
    posts = _posts(1500, rng)
    cut = set()
    for i in range(0, 1500, 6):
        s, p, text = posts[i]
        if len(text) > 120:
            posts[i] = (s, p, text[:100] if not text[:100].rstrip().endswith(".") else text[:97])
            cut.add(s)
    posts += [(9001, "x", None), (9002, "x", "   "), (9003, None, "Una frase entera.")]
    table = spark.createDataFrame(posts, "seq long, plataforma string, texto string")
    notes = spark.createDataFrame([(1, "m", None, None)], NOTES)
    found = {r["id"] for r in truncation.truncated(notes, table).collect() if r["tabla"] == "publicaciones"}
    assert len(found & cut) >= 0.95 * len(cut) and len(found - cut) <= 0.05 * len(found)
    rates = {r["fuente"]: r for r in truncation.rates(notes, table).collect()}
    assert rates["x"]["textos"] == 1500 and rates["x"]["cortados"] == len([i for i in found])
    assert truncation.truncated(notes.where("false"), table.where("false")).count() == 0


def test_field_limits_are_those_of_a_source(spark):
    # eight notes of one outlet, under its brand and its domain, have 300 characters; other outlets' lengths drown them when pooled
    rows = [(i, "El Faro" if i % 2 else "faro.example", None, "x" * 300) for i in range(8)]
    rows += [(100 + i, f"m{i % 20}", None, "y" * (280 + i % 41)) for i in range(41 * 20)]
    notes = spark.createDataFrame(rows, NOTES)
    posts = spark.createDataFrame([], "seq long, plataforma string, texto string")
    homes = truncation.outlet_homes(spark.createDataFrame([("El Faro", "faro.example")], "medio string, dominio string"))
    assert truncation.limits(truncation.text_rows(notes, posts), homes) == {("notas", "faro.example"): {300}}


def test_filler_is_found_among_many_mined_notices(spark):
    rng = random.Random(5)
    notice = "El servicio que usted ha solicitado no se encuentra disponible en este momento por tareas de mantenimiento programado en nuestros servidores y volvera a funcionar con normalidad en breve disculpe las molestias ocasionadas"
    words = [f"{a}{b}{c}" for a in "bcdfglmnprst" for b in "aeiou" for c in ("no", "de", "la", "mar", "tir")] + ["la", "de", "que", "el", "en"] * 20
    rows = [(i, f"{notice} {i}", " ".join(rng.choices(words, k=6))) for i in range(3000)]
    rows += [(10_000 + i, ". ".join(" ".join(rng.choices(words, k=12)) for _ in range(4)), " ".join(rng.choices(words, k=6))) for i in range(1500)]
    rows += [(90_000, "Sit tempor labore aliqua nostrud elit enim quis officia labore culpa sint aute sint nisi minim", "Otra cosa"), (90_001, "x", "NO PUBLICAR test 6")]
    found = {tuple(r) for r in residue.residue(spark.createDataFrame(rows, "id long, cuerpo string, titular string").repartition(4)).collect()}
    assert (90_000, "cuerpo") in found and (90_001, "titular") in found
    assert sum(f == "cuerpo" and i < 3000 for i, f in found) == 3000 and not any(10_000 <= i < 20_000 for i, _ in found)
