"""Text functions: folding, slugs, hashes, tokens, labels, page text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and their plain forms.
ACCENTED = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿÁÀÂÃÄÅÉÈÊËÍÌÎÏÓÒÔÕÖÚÙÛÜÇÑÝ"
PLAIN = "aaaaaaeeeeiiiiooooouuuucnyyAAAAAAEEEEIIIIOOOOOUUUUCNY"
# Address abbreviations and what they stand for.
ABBREVIATIONS = {
    "r": "rua", "av": "avenida", "trav": "travessa", "tv": "travessa", "pc": "praca", "pca": "praca", "al": "alameda", "rod": "rodovia", "estr": "estrada",
    "ed": "edificio", "edf": "edificio", "res": "residencial", "cond": "condominio", "apto": "apartamento", "ap": "apartamento",
}
# Page texts that stand for an access challenge.
CHALLENGE_MARKS = [
    "cf-browser-verification", "cf_chl_opt", "just a moment", "checking your browser", "datadome", "captcha-delivery", "geo.captcha-delivery.com",
    "verificando seu navegador", "access denied", "unusual traffic",
]
#: Characters of a page in which a challenge shows itself.
CHALLENGE_SAMPLE = 20_000


def strip_accents(text: Column) -> Column:
    """Letters without their accents; combining marks are dropped."""
    return F.regexp_replace(F.translate(text, ACCENTED, PLAIN), r"\p{M}", "")


def slug(text: Column) -> Column:
    """Comparable form of a name: plain lower-case letters and digits joined by hyphens; null gives ''."""
    return F.coalesce(F.trim(F.regexp_replace(F.lower(strip_accents(text)), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(""))


def squeezed(text: Column) -> Column:
    """White space collapsed to single spaces, trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def text_hash(text: Column) -> Column:
    """First 16 hex digits of the SHA-1 of the text in lower case with collapsed white space; null if that is empty."""
    bare = F.nullif(F.lower(squeezed(text)), F.lit(""))
    return F.substring(F.sha1(bare), 1, 16)


def _words(text: Column) -> Column:
    bare = F.regexp_replace(F.lower(strip_accents(F.coalesce(text, F.lit("")))), r"[^a-z0-9\s]", " ")
    words = F.filter(F.split(bare, r"\s+"), lambda w: w != "")
    lookup = F.create_map(*[F.lit(x) for pair in ABBREVIATIONS.items() for x in pair])
    return F.transform(words, lambda w: F.coalesce(F.element_at(lookup, w), w))


def plain_words(text: Column) -> Column:
    """The words in plain form with single spaces, abbreviations written out; null gives ''."""
    return F.array_join(_words(text), " ")


def tokens(text: Column) -> Column:
    """Distinct words in plain form, abbreviations written out; null or empty text gives []."""
    return F.array_distinct(_words(text))


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all elements of two arrays of distinct values; null if either is null or empty."""
    shared = F.size(F.array_intersect(a, b))
    return F.when((F.size(a) > 0) & (F.size(b) > 0), shared / (F.size(a) + F.size(b) - shared))


def text_similarity(a: Column, b: Column) -> Column:
    """:func:`jaccard` of the words of two texts."""
    return jaccard(tokens(a), tokens(b))


def joined_title(kind: Column, rooms: Column, area: Column, parking: Column, place: Column) -> Column:
    """Title from the parts that are known (zero counts as unknown)."""
    known = lambda n: F.when(n != 0, n)
    plural = lambda n, one, many: F.concat_ws(" ", known(n).cast("int").cast("string"), F.when(known(n).isNotNull(), F.when(n == 1, F.lit(one)).otherwise(F.lit(many))))
    some = lambda c: F.nullif(c, F.lit(""))
    size = F.concat(F.round(known(area)).cast("int").cast("string"), F.lit(" m²"))
    return F.concat_ws(" · ", kind, some(plural(rooms, "quarto", "quartos")), size, some(plural(parking, "vaga", "vagas")), some(place))


def money_label(amount: Column) -> Column:
    """``R$ 1.850``; null stays null."""
    return F.concat(F.lit("R$ "), F.replace(F.format_number(amount, 0), F.lit(","), F.lit(".")))


def or_missing(value: Column, suffix: str = "", label: str = "Não Localizado") -> Column:
    """The value as text with ``suffix``, or ``label`` for null and ''; 0 is a value."""
    text = value.cast("string")
    return F.when(text.isNull() | (text == ""), F.lit(label)).otherwise(F.concat(text, F.lit(suffix)))


def is_challenge(html: Column) -> Column:
    """Whether a page is an access challenge instead of content; null gives false."""
    marks = "|".join(m.replace(".", r"\.") for m in CHALLENGE_MARKS)
    return F.coalesce(F.lower(F.substring(html, 1, CHALLENGE_SAMPLE)).rlike(marks), F.lit(False))


def page_text(html: Column) -> Column:
    """Visible text of a page: scripts, styles, comments and tags replaced by single spaces."""
    bare = F.regexp_replace(html, r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->", " ")
    bare = F.regexp_replace(bare, r"(?s)<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        bare = F.replace(bare, F.lit(entity), F.lit(char))
    return squeezed(bare)


def digits(text: Column) -> Column:
    """The digits of a text; null if there are none."""
    return F.nullif(F.regexp_replace(text, r"\D", ""), F.lit(""))


# Kinds of property in a title that are not dwellings (one is spelled in Spanish there).
NOT_DWELLINGS = r"(?iuU)\bsala\s+comercial\b|\bgalp[aã]o\b|\bterreno\b|\bconsult[oó]rio\b|\bestablecimento\s+comercial\b|\bponto\s+comercial\b"


def is_dwelling(title: Column) -> Column:
    """Whether a title names no commercial kind of property; unknown titles pass."""
    return ~F.coalesce(title.rlike(NOT_DWELLINGS), F.lit(False))


def is_recent(updated: Column, run_date: Column, days: int = 30) -> Column:
    """Whether an update date is at most ``days`` before the run; unknown dates pass."""
    return F.coalesce(F.datediff(run_date, updated) <= days, F.lit(True))
