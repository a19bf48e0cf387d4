"""Tokens, evaluation leaks and languages."""

import random

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from sedgeline.llm import common, languages, leakage, tokens

DOCS = "doc_id long, text string, lang string, id long, extra string, words string, label string"


@pytest.fixture(scope="session")
def docs(spark):
    def make(rows):
        return spark.createDataFrame([(i, t, lang, -1, "e", "w", "l") for i, t, lang in rows], DOCS)

    return make


@pytest.fixture(scope="session")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(tokens.vocabulary_path())
    t.encode_special_tokens = True
    return lambda s: t.encode(s, add_special_tokens=False).ids


def test_ids(tables, reference):
    df, rows = tables("documents")
    got = {r.doc_id: r.ids for r in tokens.encode(df).collect()}
    assert got == {r["doc_id"]: reference(r["text"] or "") for r in rows}
    back = {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()}
    assert back == {r["doc_id"]: r["text"] or "" for r in rows}


HARD = ["", None, " ", "<|endoftext|> x", "é👩🏽‍🔬ሀ", "a" * 300_000, "\r\n\t ", "a\u0000b", "́", "�"]


def test_edge_cases(docs, reference):
    df = docs([(i, t, None) for i, t in enumerate(HARD)] + [(0, "twice", None), (None, "no id", None)])
    got = [(r.doc_id, r.ids) for r in tokens.encode(df).collect()]
    assert sorted(got, key=str) == sorted([(i, reference(t or "")) for i, t in enumerate(HARD)] + [(0, reference("twice")), (None, reference("no id"))], key=str)
    assert tokens.encode(df.limit(0)).count() == 0 and 50256 not in got[3][1]
    for r in tokens.spans(df.where("doc_id is not null")).collect():
        text = "twice" if r.ids == reference("twice") else HARD[r.doc_id] or ""
        for i, a, b in zip(r.ids, r.starts, r.ends):
            assert 0 <= a < b <= len(text)
        assert not r.ids or (r.starts[0] == 0 and r.ends[-1] == len(text) and all(y <= x + 1 for x, y in zip(r.ends, r.starts[1:])))


def test_decode_odd_ids(spark):
    df = spark.createDataFrame([(1, [72, -5, 10**6, None]), (2, None), (3, []), (4, [50256])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in tokens.decode(df).collect()} == {1: "i", 2: None, 3: "", 4: "<|endoftext|>"}


@settings(max_examples=4, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.lists(st.text(st.characters(exclude_categories=["Cs"]), max_size=40), min_size=1, max_size=40))
def test_round_trip(docs, texts):
    df = docs([(i, t, None) for i, t in enumerate(texts)])
    assert {r.doc_id: r.text for r in tokens.decode(tokens.encode(df)).collect()} == dict(enumerate(texts))


def runs_brute(docs, items):
    where = {}
    for i, t in items:
        w = common.words(t or "")
        for k in range(len(w) - 11):
            where.setdefault(tuple(w[k : k + 12]), set()).add(i)
    out = set()
    for d, t in docs:
        w = common.words(t or "")
        for k in range(len(w) - 11):
            out |= {(d, i) for i in where.get(tuple(w[k : k + 12]), ())}
    return out


def test_leaks_match_brute_force(tables):
    df, a = tables("documents")
    items, b = tables("eval_items")
    want = runs_brute([(r["doc_id"], r["text"]) for r in a], [(r["item_id"], r["text"]) for r in b])
    got = [tuple(r) for r in leakage.found(df, items).collect()]
    assert want and len(got) == len(set(got)) and set(got) == want


def test_planted_runs(tables, docs, spark):
    """Runs of just twelve words, anywhere in a document, with other punctuation."""
    rng = random.Random(4)
    _, a = tables("documents")
    items, b = tables("eval_items")
    texts = [r["text"] for r in a if r["text"] and len(common.words(r["text"])) > 40]
    rows = []
    for i in range(150):
        w, host = common.words(rng.choice(b)["text"]), rng.choice(texts).split()
        s, at = rng.randrange(len(w) - 11), rng.randrange(len(host))
        rows.append((i, " ".join([*host[:at], "—", *[x.upper() + rng.choice(["", ",", " ;"]) for x in w[s : s + 12]], *host[at:]]), None))
    want = runs_brute([r[:2] for r in rows], [(r["item_id"], r["text"]) for r in b])
    got = {tuple(r) for r in leakage.found(docs(rows), items).collect()}
    assert got <= want and len(got) >= 0.97 * len(want)


ITEM = " ".join("alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron 17".split())


def test_planted_paraphrases(tables, docs):
    """Each sixth word of an item, or of half of it, replaced by another."""
    rng = random.Random(11)
    _, a = tables("documents")
    items, b = tables("eval_items")
    hosts = [r["text"] for r in a if r["text"] and len(common.words(r["text"])) > 60]
    rows, want = [(r["doc_id"], r["text"], None) for r in a if r["doc_id"] < 10_000], {}
    for i in range(10_000, 10_120):
        item = rng.choice(b)
        w = common.words(item["text"])
        if i % 2:
            at = rng.randrange(len(w) - len(w) // 2 + 1)
            w = w[at : at + len(w) // 2]
        w = [rng.choice(common.words(rng.choice(hosts))) if k % 6 == i % 6 else x for k, x in enumerate(w)]
        host = rng.choice(hosts).split()
        at = rng.randrange(len(host))
        rows.append((i, " ".join([*host[:at], *w, *host[at:]]), None))
        want[i] = item["item_id"]
    found = leakage.leaks(docs(rows), items).collect()
    got = {(r.doc_id, r.item_id) for r in found}
    assert sum((i, item) in got for i, item in want.items()) >= 0.85 * len(want)
    assert all(r.common_part >= 0.6 and r.key_part >= 0.5 for r in found if r.kind == "paraphrase")


def test_answers_without_numbers_hang_on_rare_words():
    words = np.arange(40, dtype=np.int32)
    idf = np.ones(leakage.COLUMNS, np.float32)
    idf[30:40] = 5.0
    padded = leakage._padded(np.random.default_rng(0).standard_normal((leakage.COLUMNS, 8)).astype(np.float32))
    make = lambda numbers: leakage.Items(np.array([1]), words, np.array([40]), np.array(numbers, np.int32), idf, padded)
    assert make([]).keys(words) == set(range(30, 40)) and make([3, 4]).keys(words) == {3, 4}
    assert [len(x) for x in make([]).stretches(0, 0)] == [leakage.PARAPHRASE_WORDS]
    assert make([]).paraphrased(0, 0, words) == (1.0, 1.0) and make([]).paraphrased(0, 0, words[::-1].copy()) is None


def test_fertility(docs):
    df = docs([(1, "one two", "en"), (2, None, "en"), (3, "", "fr"), (4, " ", "fr")])
    got = {r.lang: r for r in tokens.fertility(df).collect()}
    assert got["en"].documents == 2 and got["en"].words == 2 and got["en"].fertility >= 1
    assert got["fr"].words == 0 and got["fr"].fertility is None and got["fr"].tokens == 1
    assert tokens.fertility(df.limit(0)).count() == 0


def test_leak_edge_cases(docs, spark):
    other = " ".join(f"other{i} word{i}" for i in range(60))
    odd = "alpha beta gamma delta plus epsilon zeta eta theta then iota kappa lambda mu also nu xi omicron 17"
    rows = [(1, None), (2, ""), (3, "...!"), (4, ITEM), (5, other + " " + ITEM.upper() + " " + other), (6, " ".join(ITEM.split()[:11])), (7, odd), (8, other), (9, ITEM), (9, ITEM)]
    items = spark.createDataFrame([(1, ITEM, "a"), (2, None, "a"), (3, "", "a"), (4, "too short", "a"), (5, ITEM, "b")], "item_id long, text string, suite string")
    df = docs([(i, t, None) for i, t in rows])
    assert {tuple(r) for r in leakage.found(df, items).collect()} == {(d, i) for d in (4, 5, 9) for i in (1, 5)}
    kinds = {(r.doc_id, r.item_id): r.kind for r in leakage.leaks(df, items).collect()}
    assert kinds[7, 1] == "paraphrase" and kinds[4, 1] == "verbatim" and (8, 1) not in kinds
    assert leakage.found(df.limit(0), items).count() == 0 and leakage.found(df, items.limit(0)).count() == 0
    assert {r.item_id: r.documents for r in leakage.leaked_items(df, items).collect()} == {1: 3, 5: 3}


def test_item_blocks(docs, spark, monkeypatch):
    monkeypatch.setattr(leakage, "BLOCK_WORDS", 10)
    items = spark.createDataFrame([(i, " ".join(f"i{i}w{k}" for k in range(14)), "a") for i in range(4)], "item_id long, text string, suite string")
    df = docs([(i, "some words before " + " ".join(f"i{i}w{k}" for k in range(14)), None) for i in range(4)])
    assert {tuple(r) for r in leakage.found(df, items).collect()} == {(i, i) for i in range(4)}


def test_svd_is_close(docs):
    """The space holds nearly all of what the best space of its rank can."""
    rng = np.random.default_rng(1)
    rows = [(i, " ".join(f"t{rng.integers(6)}k{k % 5}" for k in range(24)), None) for i in range(60)]
    table = leakage.worded(docs(rows), "doc_id", "text")
    idf, v, s = leakage.fit(table, table.limit(0), rank=20)
    assert np.allclose(v.T @ v, np.eye(20), atol=1e-4) and np.all(np.diff(s) <= 1e-6)
    assert (s**2).sum() > 0.9  # rows have length 1 and weigh 1 in total


def test_lcs():
    rng = random.Random(0)
    for _ in range(50):
        a, b = ([rng.randrange(4) for _ in range(rng.randrange(0, 12))] for _ in range(2))
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        assert leakage.lcs(a, b) == t[-1][-1]


SENTENCES = {
    "en": ["The farmer walked to the market with his two daughters in the morning.", "This is the reason why the water in the river was so cold."],
    "de": ["Der Bauer ging am Morgen mit seinen zwei Töchtern auf den Markt.", "Das ist der Grund, warum das Wasser im Fluss so kalt war."],
    "fr": ["Le fermier est allé au marché avec ses deux filles ce matin.", "C'est la raison pour laquelle l'eau de la rivière était si froide."],
    "es": ["El granjero fue al mercado con sus dos hijas por la mañana.", "Esta es la razón por la que el agua del río estaba tan fría."],
    "pt": ["O agricultor foi ao mercado com as suas duas filhas de manhã.", "Esta é a razão pela qual a água do rio estava tão fria."],
    "sw": ["Mkulima alikwenda sokoni pamoja na binti zake wawili asubuhi.", "Hii ndiyo sababu maji ya mto yalikuwa baridi sana."],
    "am": ["ገበሬው በማለዳ ከሁለት ሴት ልጆቹ ጋር ወደ ገበያ ሄደ።", "የወንዙ ውሃ በጣም ቀዝቃዛ የነበረበት ምክንያት ይህ ነው።"],
}


@pytest.fixture(scope="session")
def model(spark):
    return languages.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet"))


def test_labels(values):
    names = {"EN": "en", "en_GB": "en", " German": "de", "pt-BR": "pt", "swa": "sw", "Amharic": "am", "mul": None, "und": None, "": None, "??": None, "it": None, None: None}
    assert values(languages.label_language, list(names)) == list(names.values())


def test_sentences():
    assert [s[2] for s in languages.sentences("- It fell 3.5 metres down. \nNo.\n<b>La casa es azul</b> hoy.")] == ["it fell metres down", "la casa es azul hoy"]
    for t in ("", "x = 12 / 5\n42", "#### 5 <<1+2=3>>", "F = m * a", "def f(x):"):
        assert languages.sentences(t) == []
    assert languages.sentences("one two three four five six seven eight nine ten") != []


def test_held_out_accuracy(model, spark):
    """Documents of another table, one language each by label, judged by clear function words."""
    rows = [r for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").withColumn("y", languages.label_language(F.col("lang"))).where("y is not null and text is not null").select("text", "y").collect()]
    right = total = 0
    for r in rows[:4000]:
        part = [s for s in languages.sentences(r.text) if languages.plausible(s[2], r.y) and any(w in languages._FUNCTION[r.y] for w in s[2].split())]
        if part:
            p = model.classify([s[2] for s in part])
            right += int((p.argmax(1) == languages.LANGUAGES.index(r.y)).sum())
            total += len(part)
    assert total > 5000 and right / total > 0.98


def test_other_sentences(model):
    """Sentences unlike those fitted on."""
    flat = [(s, code) for code, two in SENTENCES.items() for s in two]
    p = model.classify([languages.sentences(s)[0][2] for s, _ in flat])
    assert sum(languages.LANGUAGES[k] == code for k, (_, code) in zip(p.argmax(1), flat)) >= 12


def test_found(model, docs):
    en, de, am = (" ".join(SENTENCES[c]) for c in ("en", "de", "am"))
    rows = [
        (1, en, "en"), (2, en, "English"), (3, en, None), (4, en, "de"), (5, en + " " + am, "en"), (6, None, "en"), (7, "", None), (8, "x = 12 / 5", "am"), (9, am, "und"), (10, (en + "\n") * 2000 + de, "en"),
        (11, en, "xx"), (12, en.upper(), "en_US"), (13, en + " aaaaaaaaaaaaaaaa", "en"), (3, en, None),
    ]
    got = sorted(tuple(r) for r in languages.found(docs(rows), model).collect())
    assert got == sorted([(3, "en"), (3, "en"), (4, "en"), (5, "am"), (5, "en"), (9, "am"), (10, "de"), (10, "en"), (11, "en")])
    seg = [(r.segment, r.lang) for r in languages.segments(docs([(5, en + " " + am, "en")]), model).orderBy("segment").collect()]
    assert seg == [(0, "en"), (1, "am")]
    verdicts = {r.doc_id: r.verdict for r in languages.identified(docs(rows), model).collect()}
    assert verdicts[1] == "right" and verdicts[4] == "wrong" and verdicts[9] == "absent" and verdicts[5] == "several" and 8 not in verdicts
    assert languages.found(docs([]), model).count() == 0


def test_no_labels_at_all(docs):
    """Function words alone make a usable model."""
    df = docs([(i, " ".join(two), None) for i, two in enumerate(SENTENCES.values())])
    got = {r.doc_id: r.lang for r in languages.identified(df).collect()}
    assert sum(got[i] == c for i, c in enumerate(SENTENCES)) >= 4
    assert languages.found(df.limit(0)).count() == 0
