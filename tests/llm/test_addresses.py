import pytest
from pyspark.sql import functions as F

from vitrine.llm import sorted_neighbourhood
from vitrine.llm.address import edits, parse, words_alike
from vitrine.llm.address_groups import building_groups, pairs_within, parsed

FIELDS = "url string, logradouro string, numero string, condominio_nome string, bairro string, cidade string, titulo string, cep string, place string"


@pytest.mark.parametrize(
    ("fields", "want"),
    [
        (("R. Dout. Firmina Sandovarim, N 94 - apto 302", None, None), ("firmina sandovarim", "94", "", "")),
        (("372, r. dezenove de outubro", None, None), ("19 outubro", "372", "", "")),
        (("das Tamareiras Rubras, Tr. n. 590", None, None), ("tamareiras rubras", "590", "", "")),
        (("Rua 7 de Setembro", "s/n", "Verona Marinho - Edificio"), ("7 setembro", "", "verona marinho", "")),
        (("Edf. Enseada House", None, "Conj. Res. Enseada House II"), ("", "", "enseada house", "2")),
        (("Tatu-bola do Brejo", "00352 - Bl. B", None), ("tatubola brejo", "352", "", "")),
        ((None, None, None), ("", "", "", "")),
        (("  ", "", "-"), ("", "", "", "")),
        (("0", "0", "0"), ("", "", "0", "")),
    ],
)
def test_parse(fields, want):
    a = parse(*fields)
    assert (" ".join(a.street), a.number, " ".join(a.building), a.phase) == want


def test_free_line():
    a = parse("Mar Celeste Garden - Rua da Socó Cinzento, 177", free_line=True)
    assert (a.street, a.number, a.building) == (("soco", "cinzento"), "177", ("mar", "celeste", "garden"))
    assert parse("Rua X, 10 - Conj. Aurora", places=("conjunto aurora",)).building == ()
    parse("a, " * 20_000)


def test_similarity():
    assert edits("abcd", "abdc") == 1 and edits("abc", "xyz") == 3 and edits("", "ab") == 2
    assert words_alike(("tamareiras", "rubras"), ("tamarieras", "rubras"), False)
    assert words_alike(("umbelina", "r", "mourisqueto"), ("umbelina", "rosmaninho", "mourisqueto"), False)
    assert not words_alike(("sevilha", "tamara"), ("sevilha", "tamara", "grand"), False)
    assert not words_alike(("19", "outubro"), ("18", "outubro"), True)


def groups(spark, rows):
    df = spark.createDataFrame([(*r, "x") for r in rows], FIELDS)
    c = F.col
    read = parsed(df, id=c("url"), street=c("logradouro"), number=c("numero"), building=c("condominio_nome"), district=c("bairro"), city=c("cidade"), title=c("titulo"), postcode=c("cep"))
    found = building_groups(read)
    return sorted((r["a"], r["b"]) for r in pairs_within(found, "building_group", "id").collect())


def row(url, street=None, number=None, building=None, district="Centro", city="Recife", title=None, zip_=None):
    return (url, street, number, building, district, city, title, zip_)


ROWS = [
    row("a", "Rua Doutor João Alves", "nº 120", None),
    row("b", "R. Joao Alves", "00120 apto 3", "Ed. Solar Azul"),
    row("c", None, None, "Solar Azul - Edif."),
    row("d", "Rua João Alves", "122", None),
    row("e", "Rua Joãoo Alves, 120 - Centro", None, None),
    row("f", None, None, "Solar Azul II"),
    row("g", "Rua João Alves", "s/n", None),
    row("h", None, None, None),
    row("i", "Rua João Alves", "120", None, district="Pina"),
    row("j", "Rua João Alves", "120", None, city="Olinda"),
    row(None, "Rua João Alves", "120", None),
    row("a", "Rua Doutor João Alves", "nº 120", None),
]


def test_building_groups(spark):
    want = sorted({(min(x, y), max(x, y)) for x in "abce" for y in "abce" if x != y})
    assert groups(spark, ROWS) == want


def test_blocks_cut_the_order_without_loss(spark, monkeypatch):
    monkeypatch.setattr(sorted_neighbourhood, "BLOCK", 13)
    want = sorted({(min(x, y), max(x, y)) for x in "abce" for y in "abce" if x != y})
    many = [row(f"z{i}", f"Rua {chr(97 + i % 26)}elo {chr(97 + i // 26)}onte", str(200 + i)) for i in range(120)]
    assert groups(spark, [*ROWS, *many]) == want
    assert groups(spark, []) == []


def test_turned_parts_and_kinds_of_street():
    a = parse("Jacundina Urucurana, Rua 220")
    assert (a.street_type, a.street, a.number) == ("rua", ("jacundina", "urucurana"), "220")
    a = parse("Mar Turmalina Prime - Edificio", free_line=True)
    assert (a.street, a.building) == ((), ("mar", "turmalina", "prime"))
    assert parse("Cristal Carvalho", free_line=True).building == ("cristal", "carvalho")
    assert parse("rua dezenve de outburo 15").street == ("19", "outubro")


def test_kinds_of_street_part(spark):
    rows = [row("a", "Rua Alta", "5"), row("b", "Travessa Alta", "5"), row("c", "R. Alta", "5"), row("d", "Av. Jurmas Novas", "7", "Ed. Sol Azul"), row("e", "Av. Jurremas Novas", "7", "Sol Azul")]
    assert groups(spark, rows) == [("a", "c"), ("d", "e")]


def test_blocks_find_what_the_window_leaves_apart(spark, monkeypatch):
    from vitrine.llm import address_groups

    monkeypatch.setattr(address_groups, "WINDOW", 1)
    monkeypatch.setattr(sorted_neighbourhood, "KEY_BLOCK", 3)
    zips = [row(f"n{i:02}", f"Rua {w} Longa", "12", None, zip_="50001234") for i, w in enumerate(["Abobora", "Abobrra", "Aboobra", "Aobbora", "Qbobora", "Abobora", "Abobroa"])]
    apart = [row(f"m{i}", f"Rua {w} Longa", "12", None, zip_="50001234") for i, w in enumerate(["Banana", "Cereja", "Damasco", "Figo"])]
    found = groups(spark, [*zips, *apart])
    assert {(a, b) for a, b in found if a[0] == b[0] == "n"} == {(f"n{i:02}", f"n{j:02}") for i in range(7) for j in range(i + 1, 7)}
    assert not [p for p in found if "m" in p[0] + p[1]]


def test_units_part_dwellings_only_when_asked(spark):
    rows = [row("a", "Rua Alta", "5 apto 1"), row("b", "R. Alta", "5 apto 1"), row("c", "Rua Alta", "5 apto 2"), row("d", "Rua Alta", "5 - Bl. B"), row("e", "Rua Alta", "5")]
    assert len(groups(spark, rows)) == 10
    df = spark.createDataFrame([(*r, "x") for r in rows], FIELDS)
    c = F.col
    read = parsed(df, id=c("url"), street=c("logradouro"), number=c("numero"), building=c("condominio_nome"), district=c("bairro"), city=c("cidade"), title=c("titulo"), postcode=c("cep"))
    strict = pairs_within(building_groups(read, units=True), "building_group", "id").collect()
    assert [(r["a"], r["b"]) for r in strict] == [("a", "b")]
