import pytest
from pyspark.sql import functions as F

from vitrine.functions import money, places, text, urls


def one(spark, make, value, kind="string"):
    row = spark.createDataFrame([(value,)], f"x {kind}").select(make(F.col("x")).alias("y")).first()
    return row["y"]


@pytest.mark.parametrize(
    ("text_", "want"),
    [("R$ 1.700", 1700.0), ("R$: 3.500,00", 3500.0), ("3 quartos", None), ("3 quartos R$ 4.300", 4300.0), ("R$ 2.000", 2000.0), ("", None), (None, None), ("R$ ..", None)],
)
def test_price(spark, text_, want):
    assert one(spark, money.price, text_) == want


@pytest.mark.parametrize(("text_", "want"), [("1.234,00 m²", 1234.0), ("39.00 m²", 39.0), ("70m²", 70.0), ("70 m2", 70.0), ("1.234 m²", 1234.0), ("m²", None), (None, None)])
def test_area(spark, text_, want):
    assert one(spark, money.area, text_) == want


@pytest.mark.parametrize(("text_", "want"), [("3 quartos", 3), ("Dormitórios\t3", 3), ("bed 3", 3), ("DORMITÓRIO: 2", 2), ("x", None)])
def test_rooms(spark, text_, want):
    assert one(spark, money.rooms, text_) == want


def test_rent_and_costs(spark):
    assert one(spark, money.rent, "R$ 2.400 /aluguel R$ 3.004 /total") == 2400.0
    assert one(spark, money.rent, "Aluguel R$ ,, R$ 5.000") is None
    k = one(spark, money.cost_parts, "R$ 1.700 Preço de Condomínio R$ 100 Valor do IPTU R$ 400")
    assert (k["rent"], k["condo"], k["tax"], k["total"], k["complete"]) == (1700.0, 100.0, 400.0, 2200.0, True)
    k = one(spark, money.cost_parts, "Pacote de locação R$ 2.200")
    assert (k["total"], k["complete"]) == (2200.0, True)
    assert one(spark, money.cost_parts, "nada") is None
    k = one(spark, money.declared_cost, "Aluguel + Condomínio R$ 4.104 Aluguel R$ 3.000 Condomínio R$ 900 IPTU R$ 100")
    assert (k["total"], k["complete"]) == (4104.0, True)
    k = one(spark, money.declared_cost, "Aluguel R$ 1.800/mês · Condomínio R$ - · IPTU R$ -- · Aluguel + Condomínio R$ 1.801/mês")
    assert (k["rent"], k["condo"], k["total"], k["complete"]) == (1800.0, None, 1801.0, False)
    k = one(spark, money.declared_cost, "Aluguel + Condomínio R$ 1.801")
    assert (k["rent"], k["total"], k["complete"]) == (None, 1801.0, False)
    assert one(spark, money.declared_cost, "Condomínio R$ 300") is None and one(spark, money.declared_cost, None) is None


def test_totals_details_and_visits(spark):
    assert one(spark, money.total_price, "R$ 1.700 Preço de Condomínio R$ 100 Valor do IPTU R$ 400") == 2200.0
    assert one(spark, money.total_price, "Pacote de locação R$ 2.200") == 2200.0
    assert one(spark, money.total_price, "Condomínio") is None and one(spark, money.total_price, None) is None
    d = one(spark, money.detail, "Apartamento\nPreços:\n R$: 1.500,00\nBairro: Boa Vista\n3 quartos\n70m²")
    assert tuple(d) == ("Boa Vista", 1500.0, 3, 70.0)
    assert one(spark, money.detail, "Aluguel R$ 900")["price"] == 900.0
    rows = spark.createDataFrame([(True, 1.0, 1.0), (False, 3000.0, 1.0), (None, 0.0, 2000.0), (False, None, None), (False, None, 2600.0)], "k boolean, t double, p double")
    assert [r["v"] for r in rows.select(money.worth_visiting(F.col("k"), F.col("t"), F.col("p"), 2500.0).alias("v")).collect()] == [False, False, True, True, False]


def test_cities_scopes_and_photos(spark):
    assert one(spark, places.city_in_slug, "https://x/aluguel-jaboatao_apto") == "Jaboatão dos Guararapes"
    assert one(spark, places.city_in_slug, "https://x/olinda/recife/1") == "Olinda" and one(spark, places.city_in_slug, "https://x/olindas") is None and one(spark, places.city_in_slug, None) is None
    rows = spark.createDataFrame([(1, " Recife ", "ESPINHEIRO"), (2, "Recife", "Boa Viagem"), (3, "Recife", None), (4, None, "Espinheiro"), (5, "Recife", "")], "i int, c string, b string")
    allowed = spark.createDataFrame([("Recife", "Espinheiro"), ("Recife", None), ("Olinda", "Boa Viagem")], "cidade string, bairro string")
    assert {r["i"]: r["no_recorte"] for r in places.in_scope(rows, allowed, city="c", place="b").collect()} == {1: True, 2: False, 3: False, 4: False, 5: False}
    assert one(spark, urls.photo_list, '["http://a/1.jpg", 3, null, "b"]') == ["http://a/1.jpg"] and one(spark, urls.photo_list, "http://a/2.jpg") == ["http://a/2.jpg"]
    assert one(spark, urls.photo_list, "{bad") == [] and one(spark, urls.photo_list, None) == []


def test_dates_and_cards(spark):
    assert str(one(spark, money.updated_on, "Atualizado em: 15/08/2026 x")) == "2026-08-15"
    assert one(spark, money.updated_on, "Atualizado em 32/13/2026") is None
    k = one(spark, money.card_numbers, "Mensal\n2\n2\n9\n60\n1\nApartamento")
    assert (k["rooms"], k["area"], k["floor"]) == (2, 60.0, 9)


def test_places(spark):
    names = places.gazetteer(spark.createDataFrame([("Boa Vista",), ("Boa Viagem",), ("Pina",), ("Várzea",)], "n string"), F.col("n"))

    def found(make, value):
        return spark.createDataFrame([(value,)], "x string").select(make(F.col("x"), names).alias("y")).first()["y"]

    assert found(places.place_in_slug, "https://x/apto-pina-recife/1") == "Pina"
    assert found(places.place_in_slug, "https://x/torrelandia") is None
    assert found(places.canonical_place, "ApartamentoBoa Viagem") == "Boa Viagem"
    assert found(places.canonical_place, "Pernambuco") is None
    assert found(places.place_at_head, "Boa Vista Apartamento") == "Boa Vista"
    assert found(places.place_at_head, "a 10 minutos de Boa Viagem") is None
    assert found(places.place_at_head, None) is None
    # The name counts where it stands again without a word of nearness before it.
    assert found(places.place_at_head, "a 10 minutos de Boa Viagem centro comercial e praia. Boa Viagem") == "Boa Viagem"


def test_text(spark):
    assert one(spark, text.slug, "  São José! ") == "sao-jose"
    assert one(spark, text.slug, None) == ""
    assert one(spark, text.text_hash, "  A  b ") == one(spark, text.text_hash, "a b")
    assert one(spark, text.text_hash, "  ") is None
    assert one(spark, text.tokens, "R. Ed. São-João") == ["rua", "edificio", "sao", "joao"]
    assert one(spark, text.page_text, "<p>a</p><script>x</script> &amp; b") == "a & b"
    assert one(spark, text.is_challenge, None) is False
    assert one(spark, text.is_challenge, "<title>Just a moment...") is True
    assert one(spark, text.money_label, 1850.0, "double") == "R$ 1.850"


@pytest.mark.parametrize("spelling", ["http://www.A.example/x/1/", "https://a.example/x/1?utm_source=b", "https://A.EXAMPLE:443/x//1#m", "https://a.example/x/1?pos=3&ref=l"])
def test_listing_key(spark, spelling):
    assert one(spark, urls.listing_key, spelling) == "a.example/x/1"


def test_listing_key_keeps_what_names_the_page(spark):
    assert one(spark, urls.listing_key, "https://a.example/aluguel?utm_medium=e&id=7&b=2") == "a.example/aluguel?b=2&id=7"
    assert one(spark, urls.listing_key, None) is None
    assert one(spark, urls.listing_key, " ") is None


def test_page_url(spark):
    make = lambda base, n: one(spark, lambda x: urls.page_url(x, F.lit(n)), base)
    assert (make("https://a/x", 1), make("https://a/x", 2), make("https://a/x?b=1", 2), make("https://a/{n}", 3)) == ("https://a/x", "https://a/x?pagina=2", "https://a/x?b=1&pagina=2", "https://a/3")


def test_cascade_of_places(spark):
    g = places.gazetteer(spark.createDataFrame([("Boa Vista",), ("Casa Caiada",), ("Pina",)], "n string"), F.col("n"))
    rows = spark.createDataFrame([(1, "pina", "https://x/casa-caiada/1", None), (2, None, "https://x/casa-caiada/1", "Boa Vista"), (3, None, "https://x/1", "Rua A\nBoa Vista, Recife"), (4, None, "https://x/1", "Bairro: Pina"), (5, None, None, "perto de Boa Vista"), (6, None, None, None)], "i int, b string, u string, t string")
    got = {r["i"]: r["p"] for r in rows.select("i", places.best_place(F.col("b"), F.col("u"), F.col("t"), g, ["Recife"]).alias("p")).collect()}
    assert got == {1: "Pina", 2: "Casa Caiada", 3: "Boa Vista", 4: "Pina", 5: None, 6: None}
    towns = places.cities_by_slug(spark.createDataFrame([("São José", "Recife"), ("sao jose", "Olinda")], "place string, city string"))
    assert [tuple(r) for r in towns.collect()] == [("sao-jose", "Olinda")]


def test_columns_conform(spark):
    from vitrine.sources.tables import conform

    schema = spark.createDataFrame([], "a bigint, b string, c double").schema
    assert [tuple(r) for r in conform(spark.createDataFrame([(1, "9", True)], "a int, b string, z boolean"), schema).collect()] == [(1, "9", None)]


def test_places_by_join_equal_places_by_trial(spark):
    names = spark.createDataFrame([("Boa Vista",), ("Boa Vista do Sul",), ("Pina",), ("Vista do",), (None,), ("-",)], "n string")
    rows = spark.createDataFrame([("https://x/boa-vista_do/sul/1", 1), ("https://x/pina", 2), ("https://x/pinado", 3), ("https://x/Boa_Vista-pina", 4), (None, 5), ("", 6), ("https://x/vista--do", 7), ("https://x/pina", 8)], "u string, _p int")
    g = places.gazetteer(names, F.col("n"))
    want = {r["_p"]: r["w"] for r in rows.select("_p", places.place_in_slug(F.col("u"), g).alias("w")).collect()}
    assert {r["_p"]: r["place"] for r in places.places_in_slugs(rows, names, url="u", name="n").collect()} == want == {1: "Boa Vista do Sul", 2: "Pina", 3: None, 4: "Boa Vista", 5: None, 6: None, 7: "Vista do", 8: "Pina"}
