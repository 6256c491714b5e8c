"""Neighbourhood names in slugs and texts. ``names``: what :func:`gazetteer` gives."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.text import slug, strip_accents
from vitrine.session import bounded_lookup

# Slugs of the cities covered, the beginning of one with several spellings.
CITIES = {
    "jaboatao-dos-guararapes": "Jaboatão dos Guararapes", "jaboatao": "Jaboatão dos Guararapes", "olinda": "Olinda", "recife": "Recife", "paulista": "Paulista", "camaragibe": "Camaragibe",
}
JABOATAO = ("jaboat", "Jaboatão dos Guararapes")
#: Characters at the head of a text in which a neighbourhood may stand.
HEAD = 90
#: Characters before a name in which a word of nearness voids it.
BEFORE = 26
#: Letters of the shortest name that is looked for in running text.
SHORTEST = 5
# Words that say that a place is near, not here.
NEARNESS = r"\b(perto|proxim[oa]s?|vizinh|minutos?|min|km|metros|acesso|caminho|rumo|sentido|entre)\b"


def gazetteer(names: DataFrame, name: Column, most: int = 10_000) -> Column:
    """The distinct names as a constant array of struct(slug, name), longest slug first.

    A gazetteer lists the neighbourhoods of the towns covered; more than
    ``most`` names are refused (at most one more is read).
    """
    pairs = names.select(slug(name).alias("slug"), name.alias("name")).where("slug <> ''").groupBy("slug").agg(F.min("name").alias("name"))
    found = pairs.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a gazetteer holds at most {most} names")
    ordered = sorted(([r["slug"], r["name"]] for r in found), key=lambda r: (-len(r[0]), r[0]))
    text = json.dumps([{"slug": s, "name": n} for s, n in ordered])
    return F.from_json(F.lit(text), "array<struct<slug:string,name:string>>")


def _longest(names: Column, keep) -> Column:
    return F.get(F.filter(names, keep), F.lit(0))["name"]


def place_in_slug(url: Column, names: Column) -> Column:
    """The longest name that stands between separators in an address."""
    framed = F.concat(F.lit("/"), F.regexp_replace(F.lower(strip_accents(url)), "[/_-]+", "/"), F.lit("/"))
    return _longest(names, lambda n: F.contains(framed, F.concat(F.lit("/"), F.replace(n["slug"], F.lit("-"), F.lit("/")), F.lit("/"))))


def places_in_slugs(rows: DataFrame, names: DataFrame, *, url: str, name: str) -> DataFrame:
    """``rows`` with ``place``: the longest of ``names`` between separators in an address, as :func:`place_in_slug` finds it, for any number of names.

    Runs of the address's parts, up to the longest name's, are looked up by an
    equi join instead of every name being tried on every row; a list of few
    names is broadcast. ``rows`` are taken by their distinct addresses.
    """
    known = names.select(slug(F.col(name)).alias("_slug"), F.col(name).alias("_name")).where("_slug <> ''").groupBy("_slug").agg(F.min("_name").alias("_name"))
    most = known.agg(F.max(F.size(F.split("_slug", "-")))).first()[0] or 1
    parts = F.filter(F.split(F.lower(strip_accents(F.col(url))), "[/_-]+"), lambda x: x != "")
    asked = rows.select(F.col(url).alias("_url"), parts.alias("_p")).where("_url is not null").distinct()
    starts = F.sequence(F.lit(1), F.size("_p"))
    runs = F.flatten(F.transform(starts, lambda i: F.transform(F.sequence(F.lit(1), F.least(F.lit(most), F.size("_p") - i + 1)), lambda n: F.array_join(F.slice("_p", i, n), "-"))))
    met = asked.where(F.size("_p") > 0).select("_url", F.explode(F.array_distinct(runs)).alias("_slug")).join(bounded_lookup(known), "_slug")
    best = met.groupBy("_url").agg(F.min_by("_name", F.struct((-F.length("_slug")).alias("n"), "_slug")).alias("place"))
    return rows.join(best, F.col(url) == F.col("_url"), "left").drop("_url")


def canonical_place(text: Column, names: Column) -> Column:
    """The longest name that the text is or ends with (names of at least ``SHORTEST`` letters)."""
    bare = F.replace(slug(text), F.lit("-"), F.lit(""))
    own = lambda n: F.replace(n["slug"], F.lit("-"), F.lit(""))
    return _longest(names, lambda n: (bare == own(n)) | ((F.length(own(n)) >= SHORTEST) & F.endswith(bare, own(n))))


def place_at_head(text: Column, names: Column) -> Column:
    """The longest name in the first ``HEAD`` characters that stands there once without a word of nearness before it."""
    head = F.concat(F.lit(" "), F.regexp_replace(F.lower(strip_accents(F.substring(text, 1, HEAD))), "[^a-z0-9]+", "  "), F.lit(" "))
    framed = lambda n: F.concat(F.lit(" "), F.replace(n["slug"], F.lit("-"), F.lit("  ")), F.lit(" "))

    def here(n: Column) -> Column:
        # What stands between the occurrences; each is judged by what comes before it.
        parts = F.split(head, framed(n))
        before = lambda i: F.right(F.regexp_replace(F.call_function("array_join", F.slice(parts, 1, i), framed(n)), " +", " "), F.lit(BEFORE))
        return F.exists(F.filter(F.sequence(F.lit(1), F.size(parts)), lambda i: i < F.size(parts)), lambda i: ~before(i).rlike(NEARNESS))

    return _longest(names, lambda n: (F.length(n["slug"]) >= SHORTEST) & F.contains(head, framed(n)) & here(n))


def place_in_text(text: Column, names: Column, cities: list[str]) -> Column:
    """``struct(street, place, city)`` of a listing text: a street line, and ``Place, City`` or ``Place - City`` with a known place."""
    town = "(" + "|".join(cities) + ")"
    name = r"([\p{L}][\p{L} .']{2,34})"
    street = F.nullif(F.regexp_extract(text, r"(?imuU)^((?:R\.|Rua|Av\.|Avenida|Trav\.|Travessa|Estrada|Rod\.|Pra[çc]a|Alameda)[^\n,]{3,70})$", 1), F.lit(""))
    line, dash = rf"(?iumU)^{name},\s*{town}\s*$", rf"(?iuU){name}\s*-\s*{town}\b"
    first = lambda g: F.coalesce(F.nullif(F.regexp_extract(text, line, g), F.lit("")), F.nullif(F.regexp_extract(text, dash, g), F.lit("")))
    place = canonical_place(first(1), names)
    city = F.when(F.lower(first(2)).startswith(JABOATAO[0]), F.lit(JABOATAO[1])).otherwise(first(2))
    return F.struct(street.alias("street"), place.alias("place"), F.when(place.isNotNull(), city).alias("city"))


def city_in_slug(url: Column, cities: dict[str, str] | None = None) -> Column:
    """The city that an address names between separators; of several, the first of ``cities`` (slug -> name)."""
    framed = F.concat(F.lit("/"), F.regexp_replace(F.lower(url), "[/_-]", "/"), F.lit("/"))
    return F.coalesce(*[F.when(F.contains(framed, F.lit("/" + s.replace("-", "/") + "/")), F.lit(n)) for s, n in (cities or CITIES).items()])


def in_scope(rows: DataFrame, allowed: DataFrame, *, city: str, place: str) -> DataFrame:
    """``rows`` with ``no_recorte``: whether their city (spelled as listed) and neighbourhood (in any spelling) are in ``allowed``, by an equi join.

    ``allowed``: ``cidade, bairro``. An unknown neighbourhood is in no scope.
    """
    listed = allowed.select(F.trim("cidade").alias("_city"), slug(F.col("bairro")).alias("_slug")).where("_slug <> ''").distinct().withColumn("_in", F.lit(True))
    keyed = rows.withColumns({"_city": F.trim(F.col(city)), "_slug": slug(F.col(place))})
    return keyed.join(listed, ["_city", "_slug"], "left").withColumn("no_recorte", F.coalesce("_in", F.lit(False))).drop("_city", "_slug", "_in")


def best_place(structured: Column, url: Column, text: Column, names: Column, cities: list[str]) -> Column:
    """The first that is known: the structured field, the address's slug, the text's address line, ``Bairro: X``, the head of the text."""
    labelled = canonical_place(F.nullif(F.regexp_extract(text, r"(?iuU)bairro[:\s]+(\p{L}[\p{L} ]{1,29})", 1), F.lit("")), names)
    return F.coalesce(canonical_place(structured, names), place_in_slug(url, names), place_in_text(text, names, cities)["place"], labelled, place_at_head(text, names))


def cities_by_slug(cities: DataFrame) -> DataFrame:
    """``(slug, city)`` of ``cities`` (``place, city``), for an equi join with ``slug(place)``; of several cities the first by name."""
    return cities.groupBy(slug(F.col("place")).alias("slug")).agg(F.min("city").alias("city"))
