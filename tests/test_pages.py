from vitrine.sources import pages


def test_structured_listings(spark):
    good = '<script type="application/ld+json">[{"@type":["Apartment"],"@id":"https://x/a/?q=1","numberOfRooms":2,"numberOfBathroomsTotal":2,"floorSize":{"value":70},"floorLevel":"3","address":{"streetAddress":"Rua A","addressLocality":"Recife"},"image":["https://x/1.jpg",{"url":"https://x/2.jpg"}]}]</script>'
    feet = '<script type="application/ld+json">{"a":{"b":[{"@type":"House","url":"https://x/b","numberOfBedrooms":1,"floorSize":{"value":700,"unitCode":"FTK"}}]}}</script>'
    bare = '<script type="application/ld+json">{"@type":"House","url":"https://x/c"}</script>'
    df = spark.createDataFrame([("p", '<script type="application/ld+json">{oops</script>' + good + feet + bare), ("q", None)], "u string, h string")
    got = {r["key"]: r for r in pages.structured_listings(df, url="u", html="h").collect()}
    assert set(got) == {"https://x/a", "https://x/b"}
    a = got["https://x/a"]
    assert (a["rooms"], a["bathrooms"], a["area"], a["floor"], a["street"], a["city"], len(a["photos"])) == (2, 2, 70.0, 3, "Rua A", "Recife", 2)
    assert got["https://x/b"]["area"] is None


def test_gallery(spark):
    html = '<meta property="og:image" content="https://x/f/1.jpg"><img src="/f/2.jpg"><img srcset="https://x/f/3s.jpg 300w, https://x/f/3l.jpg 900w"><img src="/g/4.jpg"><img src="/f/logo.png">'
    got = pages.gallery(spark.createDataFrame([("https://x/p/1", html), ("https://x/p/2", '<img src="/f/2.jpg">')], "u string, h string"), url="u", html="h").collect()
    assert {r["page"]: r["photos"] for r in got} == {"https://x/p/1": ["https://x/f/1.jpg", "https://x/f/2.jpg", "https://x/f/3l.jpg"], "https://x/p/2": []}


def test_embedded_objects(spark):
    html = r'x \"listingPreview\": {\"a\": 1, \"b\": \"c\"} , \"singleProperty\": 1'
    df = spark.createDataFrame([("p", html), ("q", "nothing")], "u string, h string")
    got = pages.embedded_objects(df, url="u", html="h", name="listingPreview", until="singleProperty").selectExpr("page", "variant_get(object, '$.a', 'int') a").collect()
    assert [(r["page"], r["a"]) for r in got] == [("p", 1)]


def test_preview_rows(spark):
    html = r'"listingPreview": {"url": "/imovel/1", "location": "Boa Viagem, Recife/PE", "price": "4.576", "area": "87", "bedrooms": 3, "image": "a.jpg", "title": "t"}, "singleProperty": 1 "listingPreview": {"location": "x"}, "singleProperty": 1 "listingPreview": {"url": "https://y/2"}, "singleProperty": 1'
    df = spark.createDataFrame([("p", html)], "u string, h string")
    found = pages.embedded_objects(df, url="u", html="h", name="listingPreview", until="singleProperty")
    got = {r["url"]: r for r in pages.preview_rows(found, base="https://x.example/", photos="https://img.example/", city="Olinda").collect()}
    assert set(got) == {"https://x.example/imovel/1", "https://y/2"}
    r = got["https://x.example/imovel/1"]
    assert (r["bairro"], r["cidade"], r["preco"], r["area_m2"], r["quartos"], r["custo_completo"], r["fotos"]) == ("Boa Viagem", "Recife", 4576.0, 87.0, 3, False, ["https://img.example/a.jpg"])
    assert (got["https://y/2"]["cidade"], got["https://y/2"]["bairro"], got["https://y/2"]["fotos"]) == ("Olinda", None, [])


def test_links_from_shared_text(spark):
    html = '<a href="https://wa.example/?text=veja%20https%3A%2F%2Fx.example%2Fimovel%2F7">w</a><a href="//x.example/imovel/8">y</a>'
    got = pages.links(spark.createDataFrame([("https://x.example/l", html)], "u string, h string"), url="u", html="h", containing="/imovel/").collect()
    assert sorted(r["link"] for r in got if not r["link"].startswith("https://wa.")) == ["https://x.example/imovel/7", "https://x.example/imovel/8"]


def test_cards(spark):
    from vitrine.sources.cards import page_cards

    html = '<ul><li><div><a href="/imovel/1">ver</a></div><p>2 quartos</p><p>R$ 1.500</p><img src="/f/1.jpg"></li><li><a href="/imovel/2">só texto</a></li><li><a href="/x">não</a></li></ul>' + "<p>y</p>" * 900
    got = {r["href"]: (r["text"], r["photo"]) for r in page_cards(spark.createDataFrame([("https://x.example/l", html), ("https://y.example", None)], "u string, h string"), url="u", html="h", containing="/imovel/").collect()}
    assert got["https://x.example/imovel/1"] == ("ver\n2 quartos\nR$ 1.500", "https://x.example/f/1.jpg")
    assert got["https://x.example/imovel/2"][0].startswith("ver\n2 quartos") or got["https://x.example/imovel/2"][0] == "só texto"


def test_addresses_marks_and_search(spark, tmp_path):
    from pyspark.sql import functions as F

    from vitrine.functions import places
    from vitrine.sources.sinks import read_marks, search_url

    names = places.gazetteer(spark.createDataFrame([("Casa Caiada",), ("Boa Viagem",)], "n string"), F.col("n"))
    rows = spark.createDataFrame([(1, "Rua das Flores\nCasa Caiada, Olinda\n"), (2, "ApartamentoBoa Viagem - Recife - PE"), (3, "Pernambuco - Recife - PE"), (4, None)], "i int, t string")
    got = {r["i"]: tuple(r["p"]) for r in rows.select("i", places.place_in_text(F.col("t"), names, ["Recife", "Olinda"]).alias("p")).collect()}
    assert got == {1: ("Rua das Flores", "Casa Caiada", "Olinda"), 2: (None, "Boa Viagem", "Recife"), 3: (None, None, None), 4: (None, None, None)}
    assert read_marks(spark, str(tmp_path / "none.json")).count() == 0
    (tmp_path / "l.json").write_text('["u1"]')
    assert [tuple(r) for r in read_marks(spark, str(tmp_path / "l.json")).collect()] == [("u1", "")]
    assert search_url("https://x/?ps={preco_min}&pf={preco_max}", least=0, most=2500) == "https://x/?pf=2500"


def test_rendered_cards(spark):
    from vitrine.sources.cards import rendered_cards

    card = lambda n, more="": f'<section><div><a href="/imovel/{n}"><img src="/f{n}.jpg"></a><div><a href="/imovel/{n}">2 quartos</a><p>R$ {n}00</p></div></div><span>Recife, Torre{more}</span></section>'
    html = "<ul>" + card(1) + card(2, "x" * 700) + '<p><a href="/imovel/3">so o link</a></p>' + "</ul>"
    got = {r["href"][-1]: r["text"] for r in rendered_cards(spark.createDataFrame([("https://x.example/l", html), (None, None)], "u string, h string"), url="u", html="h", containing="/imovel/").collect()}
    # The price of its own card only; the place one level above where that is short; a list is no card.
    assert got["1"].split("\n") == ["2 quartos", "R$ 100", "Recife, Torre"]
    assert got["2"].split("\n") == ["2 quartos", "R$ 200"] and got["3"] == "so o link"
