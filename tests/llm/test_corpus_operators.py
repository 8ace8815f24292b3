"""Encoding, leakage, shared spans, names: against public libraries and brute force."""

import os
import random
import unicodedata

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from rotativa.llm import catalog, encoding, leakage, names, spans
from rotativa.llm.arrays import polynomial

BPE = f"{catalog.TOKENIZERS}/byte_bpe_50k.tiktoken"
needs_files = pytest.mark.skipif(not os.path.exists(BPE), reason="vocabulary files are not here")


def test_polynomial_hash_of_windows():
    codes = np.array([1, 2, 3, 1, 2, 3, 9], np.uint32)
    for size in range(1, 8):
        h = polynomial(codes, size)
        assert len(h) == 8 - size
        for i in range(len(h)):
            for j in range(len(h)):
                assert (h[i] == h[j]) == (codes[i : i + size] == codes[j : j + size]).all()
    assert len(polynomial(codes, 8)) == 0


@needs_files
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from(list("ab's tlre \n\t  é1²日👩‍🏽!.<|_́\x85")), max_size=14), max_size=5))
def test_encoding_equals_the_public_library(texts):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(f"{catalog.TOKENIZERS}/byte_bpe_50k.json")
    library.encode_special_tokens = True
    expected = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert encoding.encode_column(pa.array(texts, pa.string()), BPE).to_pylist() == expected


@needs_files
def test_encoding_of_tables(spark):
    rows = [(1, "Hola mundo"), (2, None), (3, ""), (3, ""), (4, "<|endoftext|>"), (5, "la casa " * 100_000)]
    got = {(r["doc_id"], len(r["ids"])) for r in encoding.encode(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' ids"), BPE).collect()}
    assert {(2, 0), (3, 0)} <= got and len(got) == 5
    assert encoding.encode(spark.createDataFrame([], "doc_id long, text string"), BPE).count() == 0


def _words(text):
    folded = "".join(c for c in unicodedata.normalize("NFD", (text or "").lower()) if unicodedata.category(c)[0] != "M")
    return "".join(c if c.isalnum() else " " for c in folded).split()


def test_leakage_against_brute_force(spark):
    rng = random.Random(4)
    vocabulary = ["casa", "río", "Ángel", "de", "la", "sol", "mar", "paz", "luz", "fin", "ayer", "ñandú"]
    items = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randrange(10, 40)))) for i in range(12)]
    documents = [(100, None), (101, ""), (102, "¡!"), (103, "casa " * 60_000)]
    for d in range(60):
        words = [rng.choice(vocabulary) for _ in range(rng.randrange(5, 60))]
        if d % 3 == 0:
            source = items[rng.randrange(12)][1].split()
            k = rng.randrange(5, len(source) + 1)
            s = rng.randrange(len(source) - k + 1)
            piece = [w.upper() if rng.random() < 0.3 else w for w in source[s : s + k]]
            at = rng.randrange(len(words))
            words[at:at] = piece
        documents.append((d, rng.choice([" ", ", ", "\n"]).join(words)))
    expected = set()
    for d, text in documents:
        w = _words(text)
        grams = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
        for i, item in items:
            x = _words(item)
            if any(tuple(x[j : j + 13]) in grams for j in range(len(x) - 12)):
                expected.add((d, i))
    docs = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "7L item_id")
    its = spark.createDataFrame([*items, (99, None)], "item_id long, text string")
    for block in (20_000, 5):
        found = leakage.leaks(docs, its, item_block=block).collect()
        assert {(r["doc_id"], r["item_id"]) for r in found} == expected
        assert len(found) == len(expected)
    assert leakage.leaks(docs.where("false"), its).count() == 0
    assert leakage.leaks(docs, its.where("false")).count() == 0


def _found_pairs(documents, items, fuzzy=False):
    edits = leakage.FUZZY_EDITS if fuzzy else leakage.EDITS
    index = leakage.ItemIndex([i for i, _ in items], [x for _, x in items], leakage.Q, leakage.WORDS, edits, leakage.BLOCKS)
    return {(r[0], items[r[1]][0]) for r in leakage.find(documents, index, leakage.Q, leakage.WORDS, edits, fuzzy)}


def test_last_item_and_last_document_keep_their_closing_word():
    thirteen = "uno dos tres cuatro cinco seis siete ocho nueve diez once doce trece"
    assert _found_pairs([thirteen, "otra cosa " + thirteen], [(1, "uno dos tres"), (2, thirteen)]) == {(0, 2), (1, 2)}
    assert _found_pairs([thirteen.rsplit(" ", 1)[0], thirteen], [(2, thirteen)]) == {(1, 2)}
    assert _found_pairs([], [(2, thirteen)]) == set() and _found_pairs([thirteen], []) == set()
    codes, bounds = leakage.fold(["Ñu", None, "fin"])
    assert len(bounds) == 4 and [codes[a] == 0 and codes[b - 1] == 32 for a, b in zip(bounds, bounds[1:], strict=False)] == [True] * 3


def test_an_item_of_short_words_does_not_loosen_the_others():
    short, long = "a b c d e f g h i j k l m", "la comisión revisadora presentó ayer su informe definitivo sobre las cuentas municipales del periodo anterior"
    index = leakage.ItemIndex([1, 2], [short, long], leakage.Q, leakage.WORDS, 1, 1)
    assert index.bound[0] == 1 and index.bound[1] > 50
    assert _found_pairs([f"y {short} z", long.upper()], [(1, short), (2, long)]) == {(0, 1), (1, 2)}


def test_leakage_of_exactly_thirteen_words_anywhere():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(1, 9))) for _ in range(200)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    for _ in range(40):
        items = [(i, " ".join(text(rng.randrange(13, 40)))) for i in range(5)]
        documents, expected = [], set()
        for d in range(8):
            item, source = items[rng.randrange(5)]
            words = source.split()
            size = rng.choice([12, 13])
            start = rng.randrange(len(words) - size + 1)
            own = text(rng.randrange(0, 30))
            at = rng.choice([0, len(own), rng.randrange(len(own) + 1)])
            documents.append(" ".join([*own[:at], *words[start : start + size], *own[at:]]))
            w = _words(documents[-1])
            grams = {tuple(w[i : i + 13]) for i in range(len(w) - 12)}
            expected |= {(d, i) for i, x in items if any(tuple(x.split()[j : j + 13]) in grams for j in range(len(x.split()) - 12))}
        assert _found_pairs(documents, items) == expected


def test_fuzzy_passages_of_items_by_banded_alignment(spark):
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 10))) for _ in range(300)]
    text = lambda n: [rng.choice(vocabulary) for _ in range(n)]
    items = [(i, " ".join(text(60))) for i in range(40)]
    documents = []
    for i, item in items:
        edited = [rng.choice(vocabulary) if k % 12 == 11 else w for k, w in enumerate(item.split())]
        documents.append((i, " ".join([*text(30), *edited, *text(30)])))
    documents += [(100 + i, " ".join(text(100))) for i in range(20)] + [(200, None), (201, "")]
    rows = leakage.passages(spark.createDataFrame(documents, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    found = {(r["doc_id"], r["item_id"]) for r in rows}
    assert found <= {(i, i) for i, _ in items} and len(found) >= 0.9 * len(items)
    assert all(r["words_aligned"] > 40 and r["words_shared"] < 13 and r["edits"] > 0 for r in rows)


def test_shared_spans_against_brute_force(spark):
    rng = random.Random(6)
    letters = "abcdefghijklmnopqrstuvwxyz ñé日"
    noise = lambda n: "".join(rng.choice(letters) for _ in range(n))
    shared = [noise(n) for n in (290, 299, 300, 301, 450, 900)]
    documents = [(i, noise(rng.randrange(0, 400)) + "|" + rng.choice(shared) + "#" + noise(rng.randrange(0, 400))) for i in range(40)]
    documents += [(50, documents[0][1]), (51, documents[0][1]), (52, None), (53, ""), (54, "a" * 5000), (55, "b" + "a" * 4000), (56, noise(299))]
    expected = set()
    for i, (a, x) in enumerate(documents):
        for b, y in documents[i + 1 :]:
            if x and y and any(x[k : k + 300] in y for k in range(len(x) - 299)):
                expected.add((a, b))
    df = spark.createDataFrame(documents, "doc_id long, text string").selectExpr("*", "'x' c", "1 h")
    assert {tuple(r) for r in spans.document_pairs(df).collect()} == expected
    share = {r["doc_id"]: r for r in spans.shares(df).collect()}
    assert len(share) == len(documents) and share[50]["share"] == 1.0 and share[52]["shared_chars"] == 0 and share[56]["shared_chars"] == 0
    assert share[55]["shared_chars"] == 4000
    assert spans.document_pairs(df.where("false")).count() == 0
    member = {r["doc_id"]: r for r in spans.membership(df).collect()}
    assert member[50]["class_id"] == member[0]["class_id"] == 0 and member[50]["copies"] == 3
    degree = {d: sum(d in p for p in expected) for d in member}
    assert {d: r["links"] for d, r in member.items()} == degree and 52 not in member


def test_hot_seeds_lose_no_pair(spark, monkeypatch):
    rng = random.Random(16)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ñé日") for _ in range(n))
    notice, long = noise(150), noise(320)
    # a notice that all hold makes no pair; a stretch around it that some hold does
    texts = [noise(rng.randrange(100, 300)) + (notice if i % 3 else noise(90) + notice + noise(10) + long[:150] + notice + long[150:]) + noise(rng.randrange(100, 300)) for i in range(30)]
    rows = list(enumerate(texts))
    expected = {(a, b) for a, x in rows for b, y in rows if a < b and any(x[k : k + 300] in y for k in range(len(x) - 299))}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert expected
    for hot in (64, 2):
        monkeypatch.setattr(spans, "HOT", hot)
        assert {tuple(r) for r in spans.document_pairs(df).collect()} == expected


def test_repeated_hot_seeds_lose_no_pair(spark, monkeypatch):
    rng = random.Random(17)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ñé日") for _ in range(n))
    notice = noise(160)
    around = [noise(75) + notice + noise(75) for _ in range(30)]
    # one text repeats the notice in 30 contexts, each of which another text shares
    rows = [(0, "".join(around)), *((i, noise(40) + x + noise(40)) for i, x in enumerate(around, 1))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for hot in (64, 2):
        monkeypatch.setattr(spans, "HOT", hot)
        assert {tuple(r) for r in spans.document_pairs(df).collect()} == {(0, i) for i in range(1, 31)}


def test_minimizers_are_the_first_smallest_of_each_window():
    rng = random.Random(2)
    for _ in range(60):
        codes = np.array([rng.randrange(2 if rng.random() < 0.5 else 50) for _ in range(rng.randrange(0, 80))], np.uint32)
        h = polynomial(codes, 4)
        expected = {min(range(j, j + 7), key=lambda p: (h[p], p)) for j in range(len(h) - 6)}
        assert set(spans.minimizers(codes, 4, 7)[0].tolist()) == expected


def test_passages_with_an_edit_in_a_hundred_characters(spark):
    rng = random.Random(14)
    noise = lambda n: [rng.choice("abcdefghijklmnopqrstuvwxyz ñé") for _ in range(n)]
    rows, expected = [], set()
    for i in range(60):
        passage = noise(rng.randrange(600, 1500))
        edited = list(passage)
        for at in range(50, len(edited), 100):
            edited[at] = rng.choice(["", "#", "##"])
        rows += [(2 * i, "".join([*noise(200), *passage, *noise(200)])), (2 * i + 1, "".join([*noise(99), *edited, *noise(300)]))]
        expected.add((2 * i, 2 * i + 1))
    found = {(r["doc_id_a"], r["doc_id_b"]): r for r in spans.passages(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(found) <= expected and len(found) >= 0.9 * len(expected)
    assert all(not r["exact"] and r["identity"] > 0.95 for r in found.values())


def test_chain_takes_ordered_matches():
    score, best = spans.chain([(0, 0), (100, 100), (200, 20), (300, 300), (300, 300)], 50)
    assert best == [(0, 0), (100, 100), (300, 300)] and score > 50
    assert spans.chain([(5, 7)], 50) == (50.0, [(5, 7)])
    made = spans.chains([(0, 0), (100, 100), (200, 20), (300, 300)], 50)
    assert [sorted(m) for _, m in made] == [[(0, 0), (100, 100), (300, 300)], [(200, 20)]]


def test_band_count_follows_the_collision_curve():
    b = names.bands()
    assert 1 - (1 - names.SIMILARITY**names.ROWS) ** b >= names.RECALL > 1 - (1 - names.SIMILARITY**names.ROWS) ** (b - 1)


def test_name_variants(spark):
    entities = [(1, "Jesús Tomás Raldemero Salcalén", None), (2, "Universidad de Mujeres Campesinas de Nordinar", '["UMCN"]'), (3, "Raldemero Salcalén, Jesús", "no json"), (4, "Ana Olga Vinfoya Kelixo", "[]"), (5, None, None), (6, "Luis Tomás Mora Paz", None)]
    reviews = [
        (101, "Jesús Raldemero"), (102, "J. Raldemero Salcalen"), (103, "Chucho Raldemero"), (104, "RALDEMERO SALCALEN JESUS"), (105, "senador Jesús Raldemmero"), (106, "Pedro Raldemero Salcalén"),
        (107, "UMCN"), (108, "U. de Mujeres Campesinas de Nordinar"), (109, "Universidad de Mujeres Campesinas de Talbeya"), (110, "Ana Vinofya"), (111, ""), (112, None), (113, "@"), (114, "Jesús Raldemero"), (115, "Universidad"),
    ]
    e = spark.createDataFrame(entities, "ent_id long, nombre string, formas string")
    r = spark.createDataFrame(reviews, "rev_id long, nombre string").selectExpr("*", "1 star", "2 clave")
    people = {(a, b) for a in (1, 3) for b in (101, 102, 103, 104, 105, 114)} | {(1, 3)}
    assert {tuple(x) for x in names.variants(e, r).collect()} == people | {(2, 107), (2, 108), (4, 110)}
    assert names.variants(e.where("false"), r).count() == 0


def test_a_centre_is_never_a_satellite(spark):
    rng = random.Random(13)
    for _ in range(3):
        n = 14
        links = {(rng.randrange(n), rng.randrange(n)) for _ in range(18)} | {(0, 1), (1, 2), (2, 3)}
        entities = spark.createDataFrame([(i, f"n{i}") for i in range(n + 1)], "ent_id long, nombre string")
        linked = spark.createDataFrame([(f"n{a}", b) for a, b in links], "nombre string, ent_id long")
        star = {r["ent_id"]: r["star"] for r in names.stars(entities, linked).collect()}
        near = {i: {j for a, b in links for j in ((b,) if a == i else (a,) if b == i else ()) if j != i} for i in range(n + 1)}
        # greedy stars by falling degree
        expected, left = {}, set(range(n + 1))
        for i in sorted(left, key=lambda i: (-len(near[i]), i)):
            if i in left:
                for j in near[i] & left:
                    expected[j] = i
                expected[i] = i
                left -= near[i] | {i}
        centres = {i for i, c in star.items() if i == c}
        assert len(star) == n + 1 and set(star.values()) == centres and all(i == c or c in near[i] for i, c in star.items())
        assert centres == {i for i, c in expected.items() if i == c}


def test_gap_edits_and_passages():
    assert spans.gap_edits("casa", "cosa") == 1 and spans.gap_edits("", "ab") == 2 and spans.gap_edits("kitten", "sitting") == 3
    a, b = "x" * 5 + "A" * 20 + "bridge" + "C" * 20, "A" * 20 + "bride" + "C" * 20
    assert spans.passage(a, b, [(5, 0), (31, 25)], 20) == (5, 51, 0, 45, round(1 - 1 / 46, 4))


def test_fuzzy_passages(spark):
    rng = random.Random(8)
    noise = lambda n: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz ") for _ in range(n))
    one, two = noise(250), noise(250)
    df = spark.createDataFrame([(2, noise(50) + one + "ab" + two), (1, one + "xyz" + two + noise(40)), (3, one + "xyz" + two + noise(40)), (4, None)], "doc_id long, text string")
    rows = {(r["doc_id_a"], r["doc_id_b"]): r for r in spans.passages(df).collect()}
    fuzzy = rows[1, 2]
    assert not fuzzy["exact"] and 0.98 < fuzzy["identity"] < 1 and fuzzy["end_a"] - fuzzy["start_a"] > 300 and rows[1, 3]["exact"]
