"""Reading listings out of fetched pages: links, cards, embedded payloads, JSON-LD, photos, robots rules."""

from __future__ import annotations

import html as html_lib
import json
import re
from collections.abc import Iterator
from urllib.parse import urljoin
from urllib.robotparser import RobotFileParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.functions.money import br_number
from vitrine.functions.urls import canonical_url

# Kinds of structured objects that describe a dwelling.
DWELLINGS = ["Apartment", "House", "SingleFamilyResidence", "Residence", "Accommodation", "Product", "RealEstateListing"]
# Words in the addresses of pictures that are page decoration.
DECORATION = "logo|icone|icon|sprite|avatar|placeholder|whatsapp|facebook|instagram|banner|selo|marca|bandeira|flag|pixel|blank|spacer|loader|watermark"
PHOTOS = 12
# Where pages keep structured data and pictures.
LD_BLOCK = r"<script[^>]*type=[\"']application/ld\+json[\"'][^>]*>(.*?)</script>"
OG_IMAGE = r"<meta[^>]+(?:property|name)=[\"']og:image[\"'][^>]+content=[\"']([^\"']+)"
JSON_IMAGE = r"\"image\"\s*:\s*(\[[^\]]{0,6000}\]|\"[^\"]{5,600}\")"
SHOWN_IMAGE = r"<(?:img|source)[^>]+(?:data-src|data-lazy|data-original|srcset|src)=[\"']([^\"']+)"
IMAGE_FILE = r"\.(jpe?g|png|webp|avif)(\?|$)"


def links(pages: DataFrame, *, url: str, html: str, containing: str) -> DataFrame:
    """``(page, link)``: distinct absolute links of each page whose address contains a text."""
    hrefs = F.expr(rf"regexp_extract_all({html}, '(?i)<a[^>]+href=[\"'']([^\"''#]+)', 1)")
    found = pages.select(F.col(url).alias("page"), F.explode(hrefs).alias("href"))
    root, folder = F.regexp_extract("page", r"^([a-z]+://[^/?#]+)", 1), F.regexp_replace(F.regexp_replace("page", "[?#].*$", ""), "[^/]*$", "")
    scheme = F.regexp_extract("page", "^([a-z]+:)", 1)
    full = F.when(F.col("href").rlike("^[a-z][a-z0-9+.-]*:"), F.col("href")).when(F.col("href").startswith("//"), F.concat(scheme, "href")).when(F.col("href").startswith("/"), F.concat(root, "href")).otherwise(F.concat(folder, "href"))
    shared = F.url_decode(F.nullif(F.regexp_extract("href", r"[?&]text=([^&]*)", 1), F.lit("")))
    quoted = F.nullif(F.regexp_extract(shared, r"(https?://\S+)", 1), F.lit(""))
    return found.select("page", F.explode(F.array_compact(F.array(full, quoted))).alias("link")).where(F.contains("link", F.lit(containing))).distinct()


def accumulated_cards(cards: DataFrame, *, href: str, text: str, photo: str, step: str) -> DataFrame:
    """One card per link over scroll steps: its longest text (ties: the earliest), its first photo."""
    longest = F.max_by(text, F.struct(F.length(text), (-F.col(step)).alias("s")))
    return cards.where(F.col(href).isNotNull()).groupBy(href).agg(longest.alias(text), F.min_by(photo, F.when(F.col(photo).isNotNull(), F.col(step))).alias(photo))


def embedded_objects(pages: DataFrame, *, url: str, html: str, name: str, until: str) -> DataFrame:
    """``(page, object)``: JSON objects behind ``"name":`` in a page's scripts, quotes unescaped; unreadable ones are left out."""
    pattern = rf"(?s)\\\\?\"{name}\\\\?\"\\s*:\\s*(\\{{.*?\\}})\\s*,\\s*\\\\?\"{until}"
    raw = F.explode(F.expr(f"regexp_extract_all({html}, '{pattern}', 1)")).alias("raw")
    clean = F.replace(F.replace("raw", F.lit('\\"'), F.lit('"')), F.lit("\\\\"), F.lit("\\"))
    return pages.select(F.col(url).alias("page"), raw).select("page", F.try_parse_json(clean).alias("object")).where("object is not null")


def _number(value) -> float | None:
    if isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    m = re.search(r"[\d.,]+", str(value or ""))
    if not m:
        return None
    text = m[0].strip(".,")
    try:
        return float(text.replace(".", "").replace(",", ".") if "," in text else text)
    except ValueError:
        return None


def _walk(node) -> Iterator[dict]:
    stack = [node]
    while stack:
        x = stack.pop()
        if isinstance(x, dict):
            kinds = x.get("@type")
            if set(kinds if isinstance(kinds, list) else [kinds]) & set(DWELLINGS) and (x.get("url") or x.get("@id")):
                yield x
            stack += reversed(list(x.values()))
        elif isinstance(x, list):
            stack += reversed(x)


def _described(x: dict) -> tuple | None:
    address, size = x.get("address") or {}, x.get("floorSize") or {}
    address = address if isinstance(address, dict) else {}
    area = None
    if isinstance(size, dict):
        if (size.get("unitCode") or "MTK").upper() in ("MTK", "M2"):
            area = _number(size.get("value"))
    else:
        area = _number(size)
    images = x.get("image") or []
    images = [i.get("url") if isinstance(i, dict) else i for i in (images if isinstance(images, list) else [images])]
    rooms, street = _number(x.get("numberOfBedrooms") or x.get("numberOfRooms")), address.get("streetAddress")
    if rooms is None and area is None and not street:
        return None
    whole = lambda v: int(v) if v is not None else None
    return str(x.get("url") or x.get("@id")), whole(rooms), whole(_number(x.get("numberOfBathroomsTotal"))), area, whole(_number(x.get("floorLevel"))), street, address.get("addressLocality"), [str(i) for i in images if i][:PHOTOS]


_LD = "array<struct<url:string,rooms:int,bathrooms:int,area:double,floor:int,street:string,city:string,photos:array<string>>>"


def structured_listings(pages: DataFrame, *, url: str, html: str) -> DataFrame:
    """``(page, key, rooms, bathrooms, area, floor, street, city, photos)`` from the JSON-LD of each page, at any depth.

    ``key`` is the canonical address; the last object of a key wins. A block
    that can't be read doesn't lose the others.
    """

    def read(series: pd.Series) -> pd.Series:
        out = []
        for page in series:
            rows = []
            for block in re.findall(LD_BLOCK, page or "", re.S | re.I):
                try:
                    rows += [r for x in _walk(json.loads(html_lib.unescape(block))) if (r := _described(x))]
                except ValueError:
                    continue
            out.append(rows)
        return pd.Series(out)

    found = pages.select(F.col(url).alias("page"), F.pandas_udf(read, _LD)(F.col(html)).alias("xs")).select("page", F.posexplode("xs").alias("n", "x"))
    keyed = found.select("page", canonical_url(F.col("x.url")).alias("key"), "n", "x")
    last = keyed.groupBy("page", "key").agg(F.max_by("x", "n").alias("x"))
    return last.select("page", "key", *[f"x.{c}" for c in ("rooms", "bathrooms", "area", "floor", "street", "city", "photos")])


def _picture(address: str, base: str) -> str | None:
    last = address.split(",")[-1].strip().split(" ")[0] if " " in address.strip() else address.strip()
    full = urljoin(base, last)
    if not full.startswith("http") or re.search(DECORATION, full, re.I) or not re.search(IMAGE_FILE, full, re.I):
        return None
    return full


def gallery(pages: DataFrame, *, url: str, html: str, limit: int = PHOTOS) -> DataFrame:
    """``(page, photos)``: the announced pictures of a page, then the images in the same folders; [] without announced ones."""

    def read(urls: pd.Series, texts: pd.Series) -> pd.Series:
        out = []
        for base, page in zip(urls, texts, strict=True):
            page, base = page or "", base or ""
            named = re.findall(OG_IMAGE, page, re.I)
            for block in re.findall(JSON_IMAGE, page):
                named += re.findall(r"\"(https?:[^\"]+)\"", block)
            anchors = [p for a in named if (p := _picture(html_lib.unescape(a), base))]
            folders = {a.rsplit("/", 1)[0] for a in anchors}
            shown = re.findall(SHOWN_IMAGE, page, re.I)
            more = [p for s in shown if folders and (p := _picture(html_lib.unescape(s), base)) and p.rsplit("/", 1)[0] in folders]
            out.append(list(dict.fromkeys([*anchors, *more]))[:limit])
        return pd.Series(out)

    return pages.select(F.col(url).alias("page"), F.pandas_udf(read, "array<string>")(F.col(url), F.col(html)).alias("photos"))


def allowed(fetches: DataFrame, *, url: str, robots: str, status: str, agent: str) -> DataFrame:
    """``fetches`` with ``verdict`` PERMITIDO, PROIBIDO, SEM_ROBOTS or INDISPONIVEL and ``allowed`` (false for PROIBIDO only)."""

    def read(urls: pd.Series, bodies: pd.Series, codes: pd.Series) -> pd.Series:
        out = []
        for u, body, code in zip(urls, bodies, codes, strict=True):
            if pd.isna(code):
                out.append("INDISPONIVEL")
            elif int(code) != 200 or "<html" in (body or "")[:500].lower():
                out.append("SEM_ROBOTS")
            else:
                rules = RobotFileParser()
                rules.parse((body or "").splitlines())
                out.append("PERMITIDO" if rules.can_fetch(agent, u or "") else "PROIBIDO")
        return pd.Series(out)

    return fetches.withColumn("verdict", F.pandas_udf(read, "string")(F.col(url), F.col(robots), F.col(status))).withColumn("allowed", F.col("verdict") != "PROIBIDO")


def fetch_outcome(status: Column, body_is_challenge: Column, timed_out: Column) -> Column:
    """Why a fetch failed, as one word; null if it succeeded."""
    return (
        F.when(timed_out, "timeout")
        .when(status.isNull(), "conexao")
        .when(body_is_challenge | status.isin(403, 429), "challenge_anti_bot")
        .when(status.between(400, 499), "http_4xx")
        .when(status >= 500, "http_5xx")
    )


def preview_rows(objects: DataFrame, *, base: str, photos: str, city: str | None = None) -> DataFrame:
    """Listing rows of the previews that :func:`embedded_objects` finds; previews without an address are left out.

    ``base``: what relative addresses go on; ``photos``: prefix of image paths;
    ``city``: the one to take where the place names none. A preview tells the
    rent only, so the cost is incomplete.
    """
    get = lambda name, kind="string": F.try_variant_get("object", f"$.{name}", kind)
    place, rest = F.split_part(get("location"), F.lit(","), F.lit(1)), F.split_part(get("location"), F.lit(","), F.lit(2))
    two = F.contains(get("location"), F.lit(","))
    town = F.when(two, F.nullif(F.trim(F.split_part(rest, F.lit("/"), F.lit(1))), F.lit("")))
    link, rent = get("url"), br_number(get("price"))
    absolute = F.when(link.rlike("^[a-zA-Z]+://"), link).otherwise(F.concat(F.lit(base.rstrip("/") + "/"), F.regexp_replace(link, "^/+", "")))
    return objects.where(link != "").select(
        "page", absolute.alias("url"), get("title").alias("titulo_origem"), F.when(two, F.trim(place)).alias("bairro"), F.coalesce(town, F.lit(city)).alias("cidade"), get("street").alias("logradouro"),
        get("bedrooms", "int").alias("quartos"), get("bathrooms", "int").alias("banheiros"), get("garages", "int").alias("vagas"), br_number(get("area")).alias("area_m2"),
        rent.alias("aluguel"), rent.alias("preco"), rent.alias("custo_mensal_total"), F.lit(False).alias("custo_completo"),
        F.when(get("image") != "", F.array(F.concat(F.lit(photos), get("image")))).otherwise(F.array().cast("array<string>")).alias("fotos"),
    )
