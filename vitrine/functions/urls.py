"""URL functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Query parameters that say where a click came from, never which page is meant.
TRACKING_PARAMETERS = ["utm_[a-z0-9_]*", "ref", "pos", "gclid", "fbclid", "origem"]


def listing_key(url: Column) -> Column:
    """One key for all spellings of a page's address.

    Scheme, ``www.``, port, letter case of the host, fragment, trailing slashes
    and tracking parameters don't count; the remaining parameters do, in
    alphabetical order. Null and blank addresses give null.
    """
    bare = F.regexp_replace(F.regexp_replace(F.trim(url), "#.*$", ""), "^[A-Za-z][A-Za-z0-9+.-]*:", "")
    bare = F.regexp_replace(bare, "^//", "")
    before = F.regexp_extract(bare, r"^([^?]*)", 1)
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(before, r"^([^/]*)", 1)), "^www\\.", ""), ":[0-9]*$", "")
    path = F.regexp_replace(F.regexp_replace(F.regexp_extract(before, r"^[^/]*(.*)$", 1), "/{2,}", "/"), "/+$", "")
    query = F.regexp_extract(bare, r"\?(.*)$", 1)
    own = F.array_sort(F.filter(F.split(query, "&"), lambda p: (p != "") & ~F.lower(p).rlike("^(" + "|".join(TRACKING_PARAMETERS) + ")(=|$)")))
    asked = F.when(query == "", F.lit("")).otherwise(F.array_join(own, "&"))
    key = F.concat(host, path, F.when(asked == "", F.lit("")).otherwise(F.concat(F.lit("?"), asked)))
    return F.when(F.trim(url) == "", F.lit(None).cast("string")).otherwise(key)


def host_of(url: Column) -> Column:
    """Lower-case authority (host and port) of an absolute address; null otherwise."""
    return F.lower(F.nullif(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://([^/?#]*)", 1), F.lit("")))


def origin_of(url: Column) -> Column:
    """``scheme://authority`` of an absolute address; null otherwise."""
    return F.nullif(F.regexp_extract(url, r"(?i)^([a-z][a-z0-9+.-]*://[^/?#]*)", 1), F.lit(""))


def directory_of(url: Column) -> Column:
    """The address up to and with its last path separator, without query; null if not absolute."""
    bare = F.regexp_replace(url, "[?#].*$", "")
    return F.when(host_of(url).isNotNull(), F.regexp_replace(bare, r"[^/]*$", ""))


def canonical_url(url: Column) -> Column:
    """Address without query, fragment and trailing slashes, in lower case; null gives ''."""
    return F.coalesce(F.lower(F.regexp_replace(F.regexp_replace(F.trim(url), "[?#].*$", ""), "/+$", "")), F.lit(""))


def page_url(base: Column, page: Column, parameter: str = "pagina") -> Column:
    """Address of a result page: fills ``{n}`` if the base has it, else appends ``parameter``; page 1 is the base."""
    joined = F.concat(base, F.when(base.contains("?"), F.lit("&")).otherwise(F.lit("?")), F.lit(f"{parameter}="), page.cast("string"))
    return F.when(base.contains("{n}"), F.replace(base, F.lit("{n}"), page.cast("string"))).when(page <= 1, base).otherwise(joined)


def photo_list(raw: Column) -> Column:
    """The photo addresses in a JSON list or a single address; anything else gives an empty list."""
    several = F.from_json(raw, "array<string>")
    one = F.when(raw.startswith("http"), F.array(raw))
    return F.filter(F.coalesce(several, one, F.array().cast("array<string>")), lambda u: F.coalesce(u.startswith("http"), F.lit(False)))
