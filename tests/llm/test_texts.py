import random
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from vitrine.llm import languages
from vitrine.llm.languages import LANGUAGES, SMOOTHING, Scorer, identified, log_priors, log_table, stretches, to_correct
from vitrine.llm.leakage import contained, leaked, passages
from vitrine.llm.words import folded, mended, sentences, words, written_words


def test_words():
    assert words("<p>N&#227;o, Ação!</p>\n x2") == ["nao", "acao", "x2"]
    assert mended("nÃ£o Ã© água") == "não é água"
    assert words(None) == [] and words("... 👍") == [] and sentences("A b. C d!\nE") == [["a", "b"], ["c", "d"], ["e"]]


ITEM = "In case 4945 two dentists ordered a valuation of the gutter at the back before the settlement. In case 7125 the heiress refused the handover of the report on the cistern of 37 pages. Explain the order of events."


def noisy(text, every):
    w = text.split()
    return " ".join("xxxx" if i % every == every - 1 else x for i, x in enumerate(w))


def test_words_as_written_fold_to_the_same_words():
    rnd = random.Random(11)
    letters = "aAçÇãÃéÉñüßİŒœøÅÅﬁªº²e\u0301n\u0303x\u0336 .,-_'\"!\n<b>&eacute;09٣한글ΩѢ"
    for _ in range(3000):
        t = "".join(rnd.choice(letters) for _ in range(rnd.randrange(40)))
        assert [folded(w) for w in written_words(t)] == words(t), t
        assert [[folded(w) for w in s] for s in stretches(t, fold=False)] == stretches(t), t


def test_contained():
    item = sentences(ITEM)
    assert contained(item, set(), words(ITEM)) == 1.0
    assert contained(item, set(), words("so " + noisy(ITEM, 8) + " end")) > 0.9
    assert contained(item, set(), words(ITEM.split(". ")[1])) > 1 / 3
    assert contained(item, {0}, words(ITEM.split(". ")[0])) == 0.0
    assert contained(item, set(), words("two dentists ordered a valuation of the lamp")) == 0.0
    assert contained([], set(), ["a"]) == 0.0 and passages([], ["a"]) == []


def test_leaked(spark):
    rnd = random.Random(2)
    filler = lambda n: " ".join(f"w{rnd.randrange(5000)}" for _ in range(n))
    docs = [(1, filler(30) + " " + ITEM + " " + filler(2000)), (2, filler(100)), (3, noisy(ITEM.upper(), 9)), (4, None), (5, ""), (6, "two dentists ordered a valuation of the lamp"), (None, ITEM), (7, filler(50_000) + " " + ITEM)]
    common = [(100 + i, "This sentence stands in very many of the documents here. " + filler(8)) for i in range(40)]
    items = [(10, ITEM), (11, None), (12, ""), (13, "This sentence stands in very many of the documents here. A rare one that nobody else has written ever in his life."), (None, ITEM)]
    d = spark.createDataFrame([(*r, "x") for r in [*docs, *common]], "doc_id bigint, text string, item string")
    i = spark.createDataFrame([(*r, "x") for r in items], "item_id bigint, text string, doc string")
    run = lambda d, i: sorted((r["doc"], r["item"]) for r in leaked(d, i, doc=F.col("doc_id"), text=F.col("text"), item=F.col("item_id"), item_text=F.col("text")).collect())
    assert run(d, i) == [(1, 10), (3, 10), (7, 10)]
    assert run(d.limit(0), i) == [] and run(d, i.limit(0)) == []


def test_copies_of_a_document_count_once(spark):
    docs = [(n, ITEM + " and more") for n in range(15)] + [(100 + n, f"nothing {n} of the kind at all") for n in range(30)]
    d = spark.createDataFrame([(*r, "x") for r in docs], "doc_id bigint, text string, item string")
    i = spark.createDataFrame([(10, ITEM, "x")], "item_id bigint, text string, doc string")
    got = leaked(d, i, doc=F.col("doc_id"), text=F.col("text"), item=F.col("item_id"), item_text=F.col("text")).collect()
    assert sorted((r["doc"], r["item"]) for r in got) == [(n, 10) for n in range(15)]


def search(spark, docs, items):
    d = spark.createDataFrame(docs, "doc_id bigint, text string")
    i = spark.createDataFrame(items, "item_id bigint, text string")
    found = leaked(d, i, doc=F.col("doc_id"), text=F.col("text"), item=F.col("item_id"), item_text=F.col("text")).collect()
    return {(r["doc"], r["item"]) for r in found}


def test_short_sentences_and_dense_changes(spark):
    short = "Paga o condomínio. Não aceita pet. Tem duas vagas. Fica perto. Chave na portaria."
    dense = " ".join(f"d{n}" for n in range(36))
    docs = [(1, "antes disso " + short + " e depois"), (2, "x " + noisy(dense, 4) + " y"), (3, "tem duas vagas e mais nada"), (4, noisy(dense, 3))]
    assert search(spark, docs, [(10, short), (11, dense), (12, "duas vagas"), (13, "Tem duas vagas.")]) == {(1, 10), (1, 13), (2, 11), (3, 13)}


def test_prefix_and_bounds_lose_nothing(spark):
    """Equals the comparison of all pairs, over items that share stock phrases and noisy documents."""
    rnd = random.Random(7)
    stock = [[f"s{k}_{n}" for n in range(rnd.randrange(2, 7))] for k in range(12)]

    def sentence():
        w = [f"w{rnd.randrange(60)}" for _ in range(rnd.randrange(1, 22))]
        return w + rnd.choice(stock) if rnd.random() < 0.6 else w

    def changed(w, rate):
        out = []
        for x in w:
            k = rnd.random() / rate if rate else 9
            out += [] if k < 1 / 3 else [x, "added"] if k < 2 / 3 else ["other"] if k < 1 else [x]
        return out

    items = {n: [sentence() for _ in range(rnd.randrange(1, 7))] for n in range(60)}
    docs = {}
    for n in range(500):
        parts = [changed(s, rnd.choice([0, 0.05, 0.15, 0.3])) for k in rnd.choices(list(items), k=rnd.randrange(0, 4)) for s in items[k] if rnd.random() < 0.7]
        parts += [sentence() for _ in range(rnd.randrange(0, 4))]
        rnd.shuffle(parts)
        docs[n] = ". ".join(" ".join(p) for p in parts if p)
    texts = {n: ". ".join(" ".join(s) for s in x) for n, x in items.items()}
    # Nothing here is in more than ten documents as a sentence of its own, but for short ones.
    limit, of = 10, {}
    for n, t in docs.items():
        of.setdefault(tuple(words(t)), n)
    runs = [Counter(run for w in of for run in {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}) for k in (3, 5)]

    def common(s):
        if len(s) >= 5:
            return np.median([runs[1][x] for x in {tuple(s[i : i + 5]) for i in range(len(s) - 4)}]) > limit
        return min([runs[0][tuple(s[i : i + 3])] for i in range(len(s) - 2)], default=0) > limit

    want = set()
    for i, t in texts.items():
        own = sentences(t)
        skip = {n for n, s in enumerate(own) if common(s)}
        want |= {(d, i) for d, x in docs.items() if contained(own, skip, words(x)) >= 1 / 3}
    assert len(want) > 200 and search(spark, list(docs.items()), list(texts.items())) == want


def test_items_in_blocks(spark, monkeypatch):
    from vitrine.llm import leakage

    monkeypatch.setattr(leakage, "BLOCK_CHARS", 100)
    items = [(n, " ".join(f"own{n}x{k}" for k in range(9))) for n in range(12)]
    docs = [(100 + n, "before " + t + " after") for n, t in items] + [(200, "")]
    assert search(spark, docs, [*items, (0, "another text under the same number as the first")]) == {(100 + n, n) for n, _ in items}


PT = ["O ônibus para em frente à praça e passa a cada quinze minutos.", "A vaga de garagem é rotativa e o portão demora para abrir.", "Moro aqui faz muitos anos e nunca faltou água na caixa."]
EN = ["The parking space is tight and the gate takes ages to open.", "I have lived here for years and the water has never run out.", "There is damp behind the wardrobe and nobody came to check it."]
DE = ["Die Nachbarn von oben machen fast jede Nacht viel Lärm.", "Der Aufzug ist alt, trotzdem ist er noch nie stehen geblieben.", "Ich wohne seit vielen Jahren hier und das Wasser ist nie ausgefallen."]


def test_stretches():
    assert stretches("Tem mofo no quarto. (before the flood) Fim 🙂 Vim da Rua das Flores Azuis hoje") == [["tem", "mofo", "no", "quarto"], ["fim"], ["vim", "da", "hoje"]]
    assert stretches(None) == [] and stretches("  👍 12 ") == []
    # A long aside is a stretch of its own, however long.
    long = " ".join(["wort"] * 300)
    assert stretches(f"Tem mofo ({long}) no quarto.") == [["tem", "mofo"], ["wort"] * 300, ["no", "quarto"]]


def test_parts_in_several_languages():
    class Fixed(Scorer):
        def each(self, words):
            return np.array([[-1.0 if c == w else -3.0 for c in "pef"] for w in words])

    parts = lambda text: [(n, "pef"[int(x.argmax())]) for n, x in Fixed(None).parts(list(text))]
    assert parts("p" * 8 + "e" * 9 + "f" * 10) == [(8, "p"), (9, "e"), (10, "f")]
    assert parts("p" * 8 + "e" * 9 + "p" * 10) == [(8, "p"), (9, "e"), (10, "p")]
    assert parts("p" * 8 + "e" * 9) == [(8, "p"), (9, "e")]
    assert parts("p" * 8 + "e" * 3 + "p" * 8) == [(19, "p")] and parts("p" * 30) == [(30, "p")] and parts("pppe") == [(4, "p")]


def test_reading_many_stretches_at_once_equals_one_by_one():
    rnd = random.Random(3)
    words_ = [f"{a}{b}" for a in "aeioukw" for b in ("sa", "the", "une", "ch", "no")]
    scorer = Scorer(log_table(np.random.default_rng(1).gamma(0.2, 20, (languages.BUCKETS, len(LANGUAGES)))))
    some = [[rnd.choice(words_) for _ in range(rnd.choice([1, 3, 9, 10, 25, 80, 150]))] for _ in range(900)]
    got = scorer.read(some)
    assert sum(len(p) > 1 for p in got) > 20
    for s, parts in zip(some, got, strict=True):
        want = scorer.parts(s)
        assert [n for n, _ in parts] == [n for n, _ in want] and all(np.allclose(x, y) for (_, x), (_, y) in zip(parts, want, strict=True))
    assert scorer.read([]) == []


def test_priors_are_a_hierarchy_without_the_document_itself():
    k = len(LANGUAGES)
    row = lambda **n: np.array([[float(n.get(c, 0)) for c in LANGUAGES]])
    own = row(pt=1)
    overall = row(pt=600, es=300, en=100)[0]
    none = np.zeros((1, k))
    base = np.exp(log_priors(own, overall, none, none, none))[0]
    assert abs(base.sum() - 1) < 1e-9 and abs(base[0] - 600 / 1005) < 1e-9
    # The only document of its host and label tells nothing about itself.
    assert np.allclose(np.exp(log_priors(own, overall, own, own, own)), base)
    # An unknown host takes after its suffix, a known one after itself.
    spanish = np.exp(log_priors(none, overall, row(es=200), none, none))[0]
    assert spanish[1] > 0.9 and np.exp(log_priors(none, overall, row(es=200), row(en=500), none))[0][2] > 0.9
    assert abs(spanish[0] - SMOOTHING * (601 / 1006) / (200 + SMOOTHING)) < 1e-9


def test_languages_with_a_small_sample(spark, monkeypatch):
    monkeypatch.setattr(languages, "TRAIN_DOCUMENTS", 60)
    rnd = random.Random(4)
    rows = [(n, " ".join(rnd.choices(sents, k=3)), label, "site", None) for k, (sents, label) in enumerate(((PT, "pt"), (EN, "en"), (DE, "de"))) for n in range(100 * k, 100 * k + 60)]
    df = spark.createDataFrame([*rows, (900, PT[0], "en", None, None), (901, "", None, None, None)], "doc_id bigint, text string, lang string, source string, url string")
    c = F.col
    found = identified(df, doc=c("doc_id"), text=c("text"), label=c("lang"), host=c("source"), address=c("url"))
    assert [(r["doc"], r["language"]) for r in to_correct(found).collect()] == [(900, "pt")]


def test_languages(spark):
    rnd = random.Random(1)
    rows, n = [], 0
    for sents, label, k in ((PT, "pt", 60), (EN, "en-US", 30), (DE, "deutsch", 20)):
        for _ in range(k):
            rows.append((n, " ".join(rnd.choices(sents, k=3)), label, "site", None))
            n += 1
    rows += [(900, PT[0], "en", None, None), (901, EN[1], None, "site", "https://a.example/x"), (902, PT[0] + " " + DE[1], "pt", "site", None), (903, "12 👍", None, "site", None), (904, None, None, None, None), (905, "", "xx", "h", None), (906, (PT[1] + " ") * 3000, "?", "h", None), (None, PT[0], "en", "h", None)]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id bigint, text string, lang string, source string, url string, language string, main int")
    c = F.col
    found = identified(df, doc=c("doc_id"), text=c("text"), label=c("lang"), host=c("source"), address=c("url"))
    got = sorted((r["doc"], r["language"]) for r in to_correct(found).collect())
    assert got == [(900, "pt"), (901, "en"), (902, "de"), (902, "pt"), (906, "pt")]
    assert found.count() == len(rows) - 1
    parts = {r["doc"]: r["stretches"] for r in found.where("doc in (902, 903)").collect()}
    assert [LANGUAGES[s["language"]] for s in parts[902]] == ["pt", "de"] and parts[903] == []
    assert to_correct(identified(df.limit(0), doc=c("doc_id"), text=c("text"), label=c("lang"), host=c("source"), address=c("url"))).count() == 0
