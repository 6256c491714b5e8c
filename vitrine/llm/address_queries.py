"""Query of problem 7."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vitrine.llm.address_groups import building_groups, pairs_within, parsed
from vitrine.session import materialize, settled
from vitrine.sources.tables import table


ADDRESS = ["logradouro", "numero", "condominio_nome", "bairro", "cidade", "titulo", "cep"]


def listing_addresses(listings: DataFrame, id: str) -> DataFrame:
    """The parsed addresses of all listings."""
    c = F.col
    rows = listings.select(id, *ADDRESS).distinct()
    return parsed(rows, id=c(id), street=c("logradouro"), number=c("numero"), building=c("condominio_nome"), district=c("bairro"), city=c("cidade"), title=c("titulo"), postcode=c("cep"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of listings in the same building."""
    # Written, because the neighbourhoods are counted over the readings before they are used.
    addresses = materialize(listing_addresses(table(spark, folder, "imoveis"), "url"), "addresses")
    groups = settled(lambda: building_groups(addresses), "buildings")
    return pairs_within(groups, "building_group", "id").select(F.col("a").alias("url_a"), F.col("b").alias("url_b")).distinct()


QUERIES = {"p7_found": (p7_found, None)}
