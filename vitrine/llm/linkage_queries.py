"""Query of problem 3."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.address_groups import building_groups, parsed
from vitrine.llm.address_queries import ADDRESS, listing_addresses
from vitrine.llm.linkage import linked, records
from vitrine.session import materialize, settled
from vitrine.sources.tables import table

#: Relative difference from which the area said in the description counts instead of the field.
SAID_APART = 0.2


def _said_area(area, text):
    """The area in square metres, from the description where the field is empty or far off."""
    said = F.regexp_extract(text, r"(\d+(?:[.,]\d+)?)\s*m[²2]", 1)
    said = F.replace(F.nullif(said, F.lit("")), F.lit(","), F.lit(".")).try_cast("double")
    given = F.when(area > 0, area)
    return F.coalesce(F.when(given.isNull() | (F.abs(said / given - 1) > SAID_APART), said), given)


def _unslipped(listings: DataFrame) -> DataFrame:
    """``listings`` with decimal points of ``area`` set right: by as many places as price per square metre, or without a price square metres per room, are off the table's medians."""
    rate, spread = F.col("price") / F.col("area"), F.col("area") / F.greatest(F.coalesce("rooms", F.lit(1)), F.lit(1))
    usual = listings.where("area > 0").agg(F.percentile_approx(F.when(F.col("price") > 1, rate), 0.5).alias("rate"), F.percentile_approx(spread, 0.5).alias("spread")).first()
    off = F.when(F.col("price") > 1, F.log10(F.lit(usual["rate"]) / rate)).otherwise(F.log10(spread / F.lit(usual["spread"])))
    return listings.withColumn("area", F.col("area") / F.pow(F.lit(10.0), F.greatest(F.round(F.coalesce(off, F.lit(0.0))), F.lit(0.0))))


def _number(name: str):
    return F.nanvl(F.col(name).cast("double"), F.lit(None).cast("double"))


def _numbers():
    """A number for each row of a table that is written at once."""
    return F.monotonically_increasing_id() * 2


def _located(fichas: DataFrame, listings: DataFrame) -> DataFrame:
    """``(id, city, street, zip, building)`` of both tables."""
    c = F.col
    none = F.lit(None).cast("string")
    f_parsed = parsed(fichas, id=c("id"), street=c("endereco"), number=none, building=none, district=c("bairro"), city=c("cidade"), title=none, postcode=none, free_line=True)
    addresses = materialize(f_parsed.unionByName(listing_addresses(listings, "id")), "addresses")
    groups = settled(lambda: building_groups(addresses).groupBy("id").agg(F.min("building_group").alias("building")), "groups")
    where = addresses.groupBy("id").agg(*[F.max(x).alias(x) for x in ("city", "street", "zip")])
    return where.join(groups, "id", "left")


def _records(imoveis: DataFrame, fichas: DataFrame, urls: DataFrame) -> DataFrame:
    """The records of both tables, by their numbers."""
    c = F.col
    area = _said_area(_number("area_m2"), c("descricao")).alias("area_m2")
    rows = imoveis.select("url", *ADDRESS, "latitude", "longitude", "quartos", "preco", "aluguel", "andar", "condominio", "iptu", area)
    listings = materialize(rows.join(urls, "url").drop("url"), "listings")
    located = settled(lambda: _located(fichas, listings), "located")
    lat, lon = _number("latitude").alias("lat"), _number("longitude").alias("lon")
    left = fichas.select("id", lat, lon, c("quartos").alias("rooms"), F.when(c("area_privativa") > 0, c("area_privativa")).alias("area"), _number("valor_pedido").alias("price"), F.lit(None).cast("int").alias("floor"), F.lit(None).cast("double").alias("fee"), F.lit(None).cast("double").alias("tax"))
    price = F.coalesce(F.when(_number("preco") > 1, _number("preco")), _number("aluguel"))
    right = listings.select("id", lat, lon, c("quartos").alias("rooms"), c("area_m2").alias("area"), price.alias("price"), c("andar").alias("floor"), _number("condominio").alias("fee"), _number("iptu").alias("tax"))
    right = _unslipped(right.dropDuplicates(["id"]))
    return records(left.join(located, "id"), right.join(located, "id"))


def p3_links(spark: SparkSession, folder: str) -> DataFrame:
    """``(url, ficha_id, confianca)``: listings and broker records of the same dwelling.

    Keys as long as an address would be most of what is shuffled; numbers, even
    ones for fichas and odd ones for listings, stand for them up to the result.
    """
    fichas = table(spark, folder, "ficha_corretor").where("ficha_id is not null").dropDuplicates(["ficha_id"])
    fichas = materialize(fichas.select(_numbers().alias("id"), "ficha_id", "endereco", "bairro", "cidade", "latitude", "longitude", "quartos", "area_privativa", "valor_pedido"), "fichas")
    imoveis = table(spark, folder, "imoveis").where("url is not null")
    urls = materialize(imoveis.select("url").distinct().select((_numbers() + 1).alias("id"), "url"), "urls")
    matches = settled(lambda: linked(settled(lambda: _records(imoveis, fichas, urls), "records")), "matches")
    named = matches.join(urls.withColumnRenamed("id", "r"), "r").join(fichas.select(F.col("id").alias("l"), "ficha_id"), "l")
    return named.select("url", F.col("ficha_id").cast("bigint").alias("ficha_id"), F.col("confidence").alias("confianca"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    """Listings and broker records of the same dwelling."""
    return p3_links(spark, folder).select("url", "ficha_id")


QUERIES = {"p3_found": (p3_found, None), "p3_links": (p3_links, None)}
