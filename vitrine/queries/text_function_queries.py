"""Parsing, text, address and page functions, over documents, listings and texts made up from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.functions import money, places, text, urls
from vitrine.sources import pages
from vitrine.sources.tables import table

c = F.col


def _part(spark: SparkSession, folder: str) -> DataFrame:
    return table(spark, folder, "part")


def price_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Prices written in the Brazilian way and read back."""
    amount = F.format_number(c("p_retailprice"), 2)
    br = F.translate(amount, ",.", ".,")
    made = F.when(c("p_size") % 3 == 0, F.concat(F.lit("aluguel R$ "), br)).when(c("p_size") % 3 == 1, F.concat(F.lit("R$: "), F.split_part(br, F.lit(","), F.lit(1)))).otherwise(br)
    return _part(spark, folder).select("p_partkey", money.price(made).alias("price"))


PRICE = "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN round(p_retailprice, 2) WHEN 1 THEN floor(round(p_retailprice, 2)) END AS price FROM part"


def rooms_area_parse(spark: SparkSession, folder: str) -> DataFrame:
    """Rooms and areas in several writings, read back."""
    n = c("p_size").cast("string")
    made = F.when(c("p_partkey") % 3 == 0, F.concat(n, F.lit(" quartos, 1.234,50 m²"))).when(c("p_partkey") % 3 == 1, F.concat(F.lit("DORMITÓRIOS:\t"), n, F.lit(" 39.00 m2"))).otherwise(F.concat(F.lit("bed "), n, F.lit(" 70m²")))
    return _part(spark, folder).select("p_partkey", money.rooms(made).alias("rooms"), money.area(made).alias("area"))


ROOMS_AREA = "SELECT p_partkey, p_size AS rooms, CASE p_partkey % 3 WHEN 0 THEN 1234.5 WHEN 1 THEN 39.0 ELSE 70.0 END::DOUBLE AS area FROM part"


def cost_breakdown(spark: SparkSession, folder: str) -> DataFrame:
    """Rent, condo fee, tax and total of made-up cost texts."""
    rent, condo = (c("p_size") * 100).cast("string"), (c("p_partkey") % 500).cast("string")
    plain = F.concat(F.lit("Aluguel R$ "), rent, F.lit(" Condomínio R$ "), condo, F.lit(" IPTU: R$ 80"))
    package = F.concat(F.lit("Pacote de locação R$ "), rent, F.lit(" Condomínio R$ 50"))
    made = F.when(c("p_partkey") % 3 == 0, package).when(c("p_partkey") % 3 == 1, plain).otherwise(F.concat(F.lit("R$ "), rent, F.lit(" /aluguel")))
    # Exploded from an array of one, so that the parts are worked out once and not once for each of them.
    return _part(spark, folder).select("p_partkey", made.alias("t")).select("p_partkey", F.explode(F.array(money.cost_parts(c("t")))).alias("k")).select("p_partkey", "k.rent", "k.condo", "k.tax", "k.total", "k.complete")


COST = """
SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN CASE WHEN p_size * 100 > 50 THEN p_size * 100 - 50 END ELSE p_size * 100 END::DOUBLE AS rent,
 CASE p_partkey % 3 WHEN 0 THEN 50 WHEN 1 THEN p_partkey % 500 END::DOUBLE AS condo, CASE p_partkey % 3 WHEN 1 THEN 80 END::DOUBLE AS tax,
 CASE p_partkey % 3 WHEN 1 THEN p_size * 100 + p_partkey % 500 + 80 ELSE p_size * 100 END::DOUBLE AS total, p_partkey % 3 <> 2 AS complete FROM part
"""


def slugs(spark: SparkSession, folder: str) -> DataFrame:
    """Slugs and plain forms of the neighbourhoods."""
    return table(spark, folder, "imoveis").select("bairro").distinct().select("bairro", text.slug(c("bairro")).alias("slug"), F.lower(text.strip_accents(c("bairro"))).alias("plain"))


SLUGS = "SELECT DISTINCT bairro, coalesce(trim(regexp_replace(strip_accents(lower(bairro)), '[^a-z0-9]+', '-', 'g'), '-'), '') AS slug, strip_accents(lower(bairro)) AS plain FROM imoveis"


def text_hashes(spark: SparkSession, folder: str) -> DataFrame:
    """Hash of each listing's description."""
    return table(spark, folder, "imoveis").select("url", text.text_hash(c("descricao")).alias("hash")).distinct()


HASHES = "SELECT DISTINCT url, left(sha1(nullif(lower(trim(regexp_replace(descricao, '\\s+', ' ', 'g'))), '')), 16) AS hash FROM imoveis"


def token_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Word overlap of each part's name and type."""
    return _part(spark, folder).select("p_partkey", F.round(text.text_similarity(F.concat_ws(" ", "p_name", "p_type"), F.concat_ws(" ", "p_type", "p_brand")), 6).alias("s"))


TOKENS = """
WITH t AS (SELECT p_partkey, list_distinct(list_filter(string_split(regexp_replace(lower(p_name || ' ' || p_type), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS a,
 list_distinct(list_filter(string_split(regexp_replace(lower(p_type || ' ' || p_brand), '[^a-z0-9]+', ' ', 'g'), ' '), lambda x: x <> '')) AS b FROM part)
SELECT p_partkey, round(len(list_intersect(a, b)) / CAST(len(list_distinct(a || b)) AS DOUBLE), 6) AS s FROM t
"""


def titles(spark: SparkSession, folder: str) -> DataFrame:
    """Titles built from what is known of each listing."""
    t = text.joined_title(F.lit("Apartamento"), c("quartos"), c("area_m2").cast("int").cast("double"), c("vagas"), c("bairro"))
    return table(spark, folder, "imoveis").select("url", t.alias("titulo_gerado")).distinct()


TITLES = """
SELECT DISTINCT url, concat_ws(' · ', 'Apartamento', CASE WHEN quartos <> 0 THEN quartos || CASE WHEN quartos = 1 THEN ' quarto' ELSE ' quartos' END END,
 CASE WHEN CAST(trunc(area_m2) AS INT) <> 0 THEN CAST(trunc(area_m2) AS INT) || ' m²' END, CASE WHEN vagas <> 0 THEN vagas || CASE WHEN vagas = 1 THEN ' vaga' ELSE ' vagas' END END, nullif(bairro, '')) AS titulo_gerado FROM imoveis
"""


def labels(spark: SparkSession, folder: str) -> DataFrame:
    """Money labels and labels for what is missing."""
    return _part(spark, folder).select("p_partkey", text.money_label(F.floor("p_retailprice").cast("double")).alias("money"), text.or_missing(F.when(c("p_size") > 5, c("p_size")), " m²").alias("size"))


LABELS = "SELECT p_partkey, 'R$ ' || replace(format('{:,}', CAST(floor(p_retailprice) AS BIGINT)), ',', '.') AS money, CASE WHEN p_size > 5 THEN p_size || ' m²' ELSE 'Não Localizado' END AS size FROM part"


def listing_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Canonical form, host and folder of every address spelling in the price table."""
    u = c("url")
    return table(spark, folder, "historico_precos").select(u.alias("url")).distinct().select("url", urls.canonical_url(u).alias("canonical"), urls.host_of(u).alias("host"), urls.directory_of(u).alias("folder"))


URLS = """
SELECT DISTINCT url, lower(regexp_replace(regexp_replace(trim(url), '[?#].*$', ''), '/+$', '')) AS canonical, lower(regexp_extract(url, '^[a-zA-Z]+://([^/?#]*)', 1)) AS host,
 regexp_replace(regexp_replace(url, '[?#].*$', ''), '[^/]*$', '') AS folder FROM historico_precos
"""


def places_from_urls(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbourhood in each listing's address, the longest name wins."""
    rows = table(spark, folder, "imoveis")
    names = rows.groupBy("bairro").count().where("count >= 2 and not contains(bairro, '.')")
    return places.places_in_slugs(rows.select("url").distinct(), names, url="url", name="bairro").select("url", text.slug(c("place")).alias("bairro_slug"))


PLACES = """
WITH g AS (SELECT DISTINCT trim(regexp_replace(strip_accents(lower(bairro)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM (SELECT bairro FROM imoveis GROUP BY 1 HAVING count(*) >= 2 AND NOT contains(bairro, '.'))),
u AS (SELECT DISTINCT url FROM imoveis)
SELECT u.url, coalesce((SELECT s FROM g WHERE s <> '' AND contains('/' || regexp_replace(lower(u.url), '[/_-]+', '/', 'g') || '/', '/' || replace(s, '-', '/') || '/') ORDER BY length(s) DESC LIMIT 1), '') AS bairro_slug FROM u
"""


def _pages(spark: SparkSession, folder: str) -> DataFrame:
    """Pages made up from the listings: one link page per listing with a relative and an absolute link."""
    rows = table(spark, folder, "imoveis").select("url", "site").distinct()
    html = F.concat(F.lit('<html><body><a class="x" href="/imovel/'), F.regexp_extract("url", r"(\d{6})", 1), F.lit('">ver</a> <A HREF="https://outro.example/imovel/9">outro</A><a href="/contato">fale</a></body></html>'))
    return rows.select("url", html.alias("html"))


def page_links(spark: SparkSession, folder: str) -> DataFrame:
    """Absolute listing links of each page."""
    return pages.links(_pages(spark, folder), url="url", html="html", containing="/imovel/")


LINKS = """
WITH u AS (SELECT DISTINCT url FROM imoveis)
SELECT url AS page, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) || '/imovel/' || regexp_extract(url, '([0-9]{6})', 1) AS link FROM u UNION SELECT url, 'https://outro.example/imovel/9' FROM u
"""


def structured_pages(spark: SparkSession, folder: str) -> DataFrame:
    """JSON-LD of made-up pages, nested in a graph, with a broken block beside it."""
    p = _part(spark, folder)
    block = F.concat(
        F.lit('<script type="application/ld+json">{broken</script><script type="application/ld+json">{"@graph":[{"x":{"@type":"Apartment","url":"https://x.example/'), c("p_partkey").cast("string"),
        F.lit('/?a=1","numberOfBedrooms":"'), c("p_size").cast("string"), F.lit('","floorSize":{"value":"70,5","unitCode":"'), F.when(c("p_size") % 2 == 0, F.lit("MTK")).otherwise(F.lit("FTK")),
        F.lit('"},"address":{"streetAddress":"Rua A"}}}]}</script>'),
    )
    found = pages.structured_listings(p.select(c("p_partkey").cast("string").alias("page"), block.alias("html")), url="page", html="html")
    return found.select("key", "rooms", "area", "street")


STRUCTURED = "SELECT 'https://x.example/' || p_partkey AS key, p_size AS rooms, CASE WHEN p_size % 2 = 0 THEN 70.5 END::DOUBLE AS area, 'Rua A' AS street FROM part"


def challenges(spark: SparkSession, folder: str) -> DataFrame:
    """Which texts look like an access challenge, with the fetch outcome."""
    body = F.when(c("p_partkey") % 4 == 0, F.concat(F.lit("<title>Just a Moment...</title>"), c("p_name"))).otherwise(c("p_name"))
    status = F.when(c("p_partkey") % 5 == 0, 503).when(c("p_partkey") % 7 == 0, 404).otherwise(200)
    flag = text.is_challenge(body)
    return _part(spark, folder).select("p_partkey", flag.alias("challenge"), F.coalesce(pages.fetch_outcome(status, flag, F.lit(False)), F.lit("ok")).alias("outcome"))


CHALLENGES = """
SELECT p_partkey, p_partkey % 4 = 0 AS challenge, CASE WHEN p_partkey % 4 = 0 THEN 'challenge_anti_bot' WHEN p_partkey % 5 = 0 THEN 'http_5xx' WHEN p_partkey % 7 = 0 THEN 'http_4xx' ELSE 'ok' END AS outcome FROM part
"""


def robots(spark: SparkSession, folder: str) -> DataFrame:
    """Robots rules applied to made-up addresses."""
    body = F.when(c("p_partkey") % 3 == 0, F.lit("User-agent: *\nDisallow: /imovel/")).otherwise(F.lit("User-agent: *\nDisallow:"))
    status = F.when(c("p_partkey") % 5 == 0, 404).otherwise(200)
    rows = _part(spark, folder).select("p_partkey", F.lit("https://x.example/imovel/1").alias("url"), body.alias("robots"), status.alias("status"))
    return pages.allowed(rows, url="url", robots="robots", status="status", agent="vitrine").select("p_partkey", "verdict", "allowed")


ROBOTS = """
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN 'SEM_ROBOTS' WHEN p_partkey % 3 = 0 THEN 'PROIBIDO' ELSE 'PERMITIDO' END AS verdict, NOT (p_partkey % 5 <> 0 AND p_partkey % 3 = 0) AS allowed FROM part
"""


def scrolled_cards(spark: SparkSession, folder: str) -> DataFrame:
    """Longest text and first photo per link over scroll steps: line items stand in for the cards of an order."""
    cards = table(spark, folder, "lineitem").select(c("l_orderkey").alias("href"), F.repeat(F.lit("x"), c("l_quantity").cast("int")).alias("text"), F.when(c("l_linenumber") % 2 == 0, c("l_linenumber").cast("string")).alias("photo"), c("l_linenumber").alias("step"))
    return pages.accumulated_cards(cards, href="href", text="text", photo="photo", step="step").select("href", F.length("text").alias("n"), "photo")


CARDS = """
SELECT l_orderkey AS href, CAST(max(CAST(l_quantity AS INT)) AS INT) AS n, CAST(min(CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber END) AS VARCHAR) AS photo FROM lineitem GROUP BY 1
"""

def listing_texts(spark: SparkSession, folder: str) -> DataFrame:
    """Rooms, areas, bathrooms and prices read from the listings' own titles and descriptions."""
    said = F.concat_ws("\n", "titulo", "descricao")
    rows = table(spark, folder, "imoveis").select("url", said.alias("t")).where("url is not null").distinct()
    return rows.select("url", money.rooms(c("t")).alias("quartos"), money.area(c("t")).alias("area"), money.bathrooms(c("t")).alias("banheiros"), money.price(c("t")).alias("preco"))


def _br_sql(x: str) -> str:
    return f"TRY_CAST(replace(replace(regexp_replace(trim({x}), '[.,]+$', ''), '.', ''), ',', '.') AS DOUBLE)"


_GET = "nullif(regexp_extract({}, '(?i){}', 1), '')"
_ROOMS = "coalesce(" + ", ".join(_GET.format("t", p) for p in (r"(\d+)\s*(?:quarto|dormit[oóOÓ]rio|dorm)", r"(?:quarto|dormit[oóOÓ]rio|dorm)[s]?\s*[\t:]\s*(\d+)", r"\bbed\D{0,6}?(\d+)")) + ")"
_AREA = _GET.format("t", r"([\d.,]+)\s*m(?:²|2\b)")
LISTING_TEXTS = f"""
WITH l AS (SELECT DISTINCT url, concat_ws(chr(10), titulo, descricao) AS t FROM imoveis WHERE url IS NOT NULL),
x AS (SELECT url, t, {_ROOMS} AS q, {_AREA} AS a FROM l)
SELECT url, TRY_CAST(q AS INT) AS quartos, CASE WHEN contains(a, ',') THEN {_br_sql("a")} WHEN regexp_full_match(a, '\\d+\\.\\d{{2}}') THEN TRY_CAST(a AS DOUBLE) ELSE {_br_sql("a")} END AS area,
 TRY_CAST({_GET.format("t", r"(\d+)\s*(?:ban\.|banheiro)")} AS INT) AS banheiros, {_br_sql(_GET.format("t", r"R\$:?\s*([\d.]+,\d{2}|[\d.]+)").replace("{2}", "{2}"))} AS preco FROM x
"""


def offered_amounts(spark: SparkSession, folder: str) -> DataFrame:
    """Every writing of an amount in the conflicts, read as a price."""
    rows = table(spark, folder, "conflito").where("campo <> 'bairro'").select(F.explode(F.map_values("valores")).alias("escrito")).where("escrito is not null").distinct()
    return rows.select("escrito", money.price(c("escrito")).alias("preco"), money.br_or_plain(c("escrito")).alias("numero"))


OFFERED = f"""
WITH v AS (SELECT DISTINCT unnest(map_values(valores)) AS escrito FROM conflito WHERE campo <> 'bairro'), n AS (SELECT *, {_GET.format("escrito", r"([\d.,]+)")} AS r FROM v WHERE escrito IS NOT NULL)
SELECT escrito, {_br_sql(_GET.format("escrito", r"R\$:?\s*([\d.]+,\d{2}|[\d.]+)"))} AS preco, CASE WHEN contains(r, ',') THEN {_br_sql("r")} ELSE TRY_CAST(r AS DOUBLE) END AS numero FROM n
"""


def declared_costs(spark: SparkSession, folder: str) -> DataFrame:
    """Cost texts as portals write them, made of the listings' own rents, fees and taxes, read back."""
    rows = table(spark, folder, "imoveis").where("url is not null").groupBy("url").agg(*[F.max(x).alias(x) for x in ("aluguel", "condominio", "iptu")])
    whole = lambda x: F.when(c(x) >= 1, F.floor(x).cast("bigint"))
    some = lambda label, v: F.when(v.isNotNull(), F.concat(F.lit(f"{label} R$ "), v.cast("string"))).otherwise(F.lit(f"{label} R$ -"))
    rent, condo, tax = whole("aluguel"), whole("condominio"), whole("iptu")
    text = F.concat_ws(" · ", some("Aluguel", rent), some("Condomínio", condo), some("IPTU", tax), F.when(condo.isNotNull(), F.concat(F.lit("Aluguel + Condomínio R$ "), (F.coalesce(rent, F.lit(0)) + condo + 1).cast("string"), F.lit("/mês"))))
    read = rows.select("url", text.alias("t")).select("url", F.explode(F.array(money.declared_cost(c("t")))).alias("k"), money.total_price(c("t")).alias("soma"))
    return read.select("url", "k.rent", "k.condo", "k.tax", "k.total", "k.complete", "soma")


DECLARED_COSTS = """
WITH r AS (SELECT url, CASE WHEN max(aluguel) >= 1 THEN floor(max(aluguel)) END AS a, CASE WHEN max(condominio) >= 1 THEN floor(max(condominio)) END AS k, CASE WHEN max(iptu) >= 1 THEN floor(max(iptu)) END AS i FROM imoveis WHERE url IS NOT NULL GROUP BY 1)
SELECT url, CAST(a AS DOUBLE) AS rent, CAST(CASE WHEN a IS NOT NULL OR k IS NOT NULL THEN k END AS DOUBLE) AS condo, CAST(CASE WHEN a IS NOT NULL OR k IS NOT NULL THEN i END AS DOUBLE) AS tax,
 CAST(CASE WHEN a IS NOT NULL OR k IS NOT NULL THEN greatest(coalesce(a, 0) + coalesce(k, 0) + coalesce(i, 0), coalesce(a, 0) + k + 1) END AS DOUBLE) AS total,
 CASE WHEN a IS NOT NULL OR k IS NOT NULL THEN k IS NOT NULL END AS complete,
 -- Without a rent the first amount of the text is taken for it.
 CAST(coalesce(a, k, i) + coalesce(k, 0) + coalesce(i, 0) AS DOUBLE) AS soma FROM r
"""


def cities_from_urls(spark: SparkSession, folder: str) -> DataFrame:
    """City that each listing's address names, and the kind of portal page as a second list of slugs."""
    rows = table(spark, folder, "imoveis").select("url").where("url is not null").distinct()
    return rows.select("url", places.city_in_slug(c("url"), {"passo-do-xareu": "Passo do Xaréu", "praia-da-umburana": "Praia da Umburana", "riacho-da-piacaba": "Riacho da Piaçaba"}).alias("cidade"))


CITIES = """
WITH u AS (SELECT DISTINCT url, '/' || regexp_replace(lower(url), '[/_-]', '/', 'g') || '/' AS s FROM imoveis WHERE url IS NOT NULL)
SELECT url, CASE WHEN contains(s, '/passo/do/xareu/') THEN 'Passo do Xaréu' WHEN contains(s, '/praia/da/umburana/') THEN 'Praia da Umburana' WHEN contains(s, '/riacho/da/piacaba/') THEN 'Riacho da Piaçaba' END AS cidade FROM u
"""


def places_in_titles(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbourhood at the head of each title and description, mentions of what is near left out."""
    rows = table(spark, folder, "imoveis")
    names = places.gazetteer(rows.groupBy("bairro").count().where("count >= 2 and not contains(bairro, '.')"), c("bairro"))
    said = rows.select(F.explode(F.array("titulo", F.concat_ws(" ", F.lit("A 10 minutos de"), "titulo"), "descricao")).alias("texto")).where("texto is not null").distinct()
    return said.select("texto", text.slug(places.place_at_head(c("texto"), names)).alias("bairro_slug"))


_NEAR = r"\b(perto|proxim[oa]s?|vizinh|minutos?|min|km|metros|acesso|caminho|rumo|sentido|entre)\b"
TITLE_PLACES = f"""
WITH g AS (SELECT DISTINCT trim(regexp_replace(strip_accents(lower(bairro)), '[^a-z0-9]+', '-', 'g'), '-') AS s FROM (SELECT bairro FROM imoveis GROUP BY 1 HAVING count(*) >= 2 AND NOT contains(bairro, '.'))),
t AS (SELECT DISTINCT texto, ' ' || regexp_replace(strip_accents(lower(substr(texto, 1, 90))), '[^a-z0-9]+', '  ', 'g') || ' ' AS h FROM (SELECT unnest([titulo, 'A 10 minutos de ' || titulo, descricao]) AS texto FROM imoveis) WHERE texto IS NOT NULL),
m AS (SELECT texto, s, ' ' || replace(s, '-', '  ') || ' ' AS f, string_split(h, ' ' || replace(s, '-', '  ') || ' ') AS p FROM t JOIN g ON length(s) >= 5 AND contains(h, ' ' || replace(s, '-', '  ') || ' ')),
k AS (SELECT texto, s FROM m WHERE len(list_filter(range(1, len(p)), lambda i: NOT regexp_matches(right(regexp_replace(list_reduce(p[1:i], lambda x, y: x || f || y), ' +', ' ', 'g'), 26), '{_NEAR}'))) > 0),
b AS (SELECT texto, s, row_number() OVER (PARTITION BY texto ORDER BY length(s) DESC, s) AS rn FROM k)
SELECT t.texto, coalesce(b.s, '') AS bairro_slug FROM t LEFT JOIN b ON b.texto = t.texto AND rn = 1
"""


def display_scope(spark: SparkSession, folder: str) -> DataFrame:
    """Dwellings within the neighbourhoods shown, per city, with those outside and those that can't be told."""
    allowed = table(spark, folder, "imovel").groupBy("cidade", "bairro").count().where("count >= 5 and not contains(lower(bairro), 'jardim')")
    rows = places.in_scope(table(spark, folder, "imovel").select("id", "cidade", "bairro").distinct(), allowed, city="cidade", place="bairro")
    unknown = F.coalesce(c("bairro"), F.lit("")) == ""
    return rows.groupBy(F.coalesce(F.trim("cidade"), F.lit("")).alias("cidade")).agg(F.count_if("no_recorte").alias("exibidos"), F.count_if(~c("no_recorte") & ~unknown).alias("fora"), F.count_if(unknown).alias("sem_bairro"))


DISPLAY_SCOPE = """
WITH s AS (SELECT DISTINCT id, cidade, bairro, coalesce(trim(regexp_replace(strip_accents(lower(bairro)), '[^a-z0-9]+', '-', 'g'), '-'), '') AS k FROM imovel),
a AS (SELECT DISTINCT trim(cidade) AS cidade, trim(regexp_replace(strip_accents(lower(bairro)), '[^a-z0-9]+', '-', 'g'), '-') AS k FROM (SELECT cidade, bairro FROM imovel GROUP BY 1, 2 HAVING count(*) >= 5 AND NOT contains(lower(bairro), 'jardim'))),
j AS (SELECT s.*, a.k IS NOT NULL AND s.k <> '' AS d FROM s LEFT JOIN a ON a.cidade = trim(s.cidade) AND a.k = s.k)
SELECT coalesce(trim(cidade), '') AS cidade, count(*) FILTER (WHERE d) AS exibidos, count(*) FILTER (WHERE NOT d AND coalesce(bairro, '') <> '') AS fora, count(*) FILTER (WHERE coalesce(bairro, '') = '') AS sem_bairro FROM j GROUP BY 1
"""

QUERIES = {
    "listing_texts": (listing_texts, LISTING_TEXTS),
    "offered_amounts": (offered_amounts, OFFERED),
    "declared_costs": (declared_costs, DECLARED_COSTS),
    "cities_from_urls": (cities_from_urls, CITIES),
    "places_in_titles": (places_in_titles, TITLE_PLACES),
    "display_scope": (display_scope, DISPLAY_SCOPE),
    "price_parse": (price_parse, PRICE),
    "rooms_area_parse": (rooms_area_parse, ROOMS_AREA),
    "cost_breakdown": (cost_breakdown, COST),
    "slugs": (slugs, SLUGS),
    "text_hashes": (text_hashes, HASHES),
    "token_overlap": (token_overlap, TOKENS),
    "titles": (titles, TITLES),
    "labels": (labels, LABELS),
    "listing_urls": (listing_urls, URLS),
    "places_from_urls": (places_from_urls, PLACES),
    "page_links": (page_links, LINKS),
    "structured_pages": (structured_pages, STRUCTURED),
    "challenges": (challenges, CHALLENGES),
    "robots": (robots, ROBOTS),
    "scrolled_cards": (scrolled_cards, CARDS),
}
