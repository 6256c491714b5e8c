"""Amounts, areas and counts out of Brazilian listing text. No match gives null."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Java needs (?iuU) for Unicode letter case and white space.
_FLAGS = "(?iuU)"
# How listings write prices, rooms, areas, costs and dates.
PRICE = r"R\$:?\s*([\d.]+,\d{2}|[\d.]+)"
ROOMS = [r"(\d+)\s*(?:quarto|dormit[oó]rio|dorm)", r"(?:quarto|dormit[oó]rio|dorm)[s]?\s*[\t:]\s*(\d+)", r"\bbed\D{0,6}?(\d+)"]
BATHROOMS = r"(\d+)\s*(?:ban\.|banheiro)"
AREA = r"([\d.,]+)\s*m(?:²|2\b)"
RENT_MARKED = r"R\$\s*([\d.,]+)\s*/\s*aluguel"
RENT_LABELLED = r"Aluguel\s*R?\$:?\s*([\d.,]+)"
CONDO = r"(?:condom[íi]nio|cond\.)\s*:?\s*R\$\s*([\d.,]+)"
TAX = r"IPTU\s*:?\s*R\$\s*([\d.,]+)"
PACKAGE = r"pacote\s+de\s+loca[çc][aã]o\s*R\$\s*([\d.,]+)"
DECLARED = r"Aluguel\s*\+\s*Condom[íi]nio\s*R\$\s*([\d.,]+)"
DECLARED_RENT = r"Aluguel\s*R\$\s*([\d.,]+)"
DECLARED_CONDO = r"Condom[íi]nio\s*R\$\s*([\d.,]+)"
DECLARED_TAX = r"IPTU\s*R\$\s*([\d.,]+)"
ADDED_CONDO = r"(?:condom[íi]nio|cond\.)\s*R\$\s*([\d.,]+)"
DETAIL_PRICE = r"(Pre[çc]os?:\s*\**R\$:?\s*[\d.,]+)"
DETAIL_PLACE = r"Bairro:\**\s*([^\n]+)"
UPDATED = r"Atualizado\s+em:?\s*(\d{2}/\d{2}/\d{4})"
CARD_FIVE = r"Mensal\s*\n+(\d+)\s*\n+(\d+)\s*\n+(\d+)\s*\n+([\d.,]+)\s*\n+(\d+)\s*\n+Apartamento"
CARD_THREE = r"([\d.,]+)\s*m²\s*\n+(\d+)\s*\n+(\d+)\s*\n+(\d+)\b"


def _found(text: Column, pattern: str, group: int = 1) -> Column:
    """The group of the first match, null without one."""
    return F.nullif(F.regexp_extract(text, _FLAGS + pattern, group), F.lit(""))


def br_number(text: Column) -> Column:
    """Number with points for thousands and a comma for decimals; ends of sentences don't count."""
    bare = F.regexp_replace(F.trim(text), r"[.,]+$", "")
    return F.replace(F.replace(bare, F.lit("."), F.lit("")), F.lit(","), F.lit(".")).try_cast("double")


def price(text: Column) -> Column:
    """First amount behind ``R$``."""
    return br_number(_found(text, PRICE))


def rooms(text: Column) -> Column:
    """Number of rooms before its word, behind its label, or behind ``bed``."""
    return F.coalesce(*[_found(text, p) for p in ROOMS]).try_cast("int")


def bathrooms(text: Column) -> Column:
    """Number of bathrooms."""
    return _found(text, BATHROOMS).try_cast("int")


def area(text: Column) -> Column:
    """First number of square metres; a single point before two final digits is decimal, any other point separates thousands."""
    raw = _found(text, AREA)
    decimal = raw.rlike(r"^\d+\.\d{2}$")
    return F.when(raw.contains(","), br_number(raw)).when(decimal, raw.try_cast("double")).otherwise(br_number(raw))


def rent(text: Column) -> Column:
    """The rent: the amount marked ``/aluguel``, else the one labelled ``Aluguel``, else the first price.

    The first label that occurs decides, even if its amount can't be read.
    """
    marked, labelled = _found(text, RENT_MARKED), _found(text, RENT_LABELLED)
    return F.when(marked.isNotNull(), br_number(marked)).when(labelled.isNotNull(), br_number(labelled)).otherwise(price(text))


def cost_parts(text: Column) -> Column:
    """``struct(rent, condo, tax, total, complete)``; all null without a rent.

    A package price is the total, the rent what it leaves (null if nothing).
    Otherwise the total adds up what is known, complete if the condo fee is.
    """
    condo = br_number(_found(text, CONDO))
    tax = br_number(_found(text, TAX))
    package = br_number(_found(text, PACKAGE))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    left = package - zero(condo) - zero(tax)
    base = rent(text)
    by_package = F.struct(F.when(left > 0, left).alias("rent"), condo.alias("condo"), tax.alias("tax"), package.alias("total"), F.lit(True).alias("complete"))
    summed = F.struct(base.alias("rent"), condo.alias("condo"), tax.alias("tax"), (base + zero(condo) + zero(tax)).alias("total"), condo.isNotNull().alias("complete"))
    return F.when(package > 0, by_package).when(base.isNotNull(), summed)


def declared_cost(text: Column) -> Column:
    """``struct(rent, condo, tax, total, complete)`` for texts that also declare rent and condo fee as one amount.

    The first declared sum is read and taken out before the parts; it is the
    total if greater than what the parts add up to. Null if neither a rent nor
    a declared sum is there.
    """
    whole = _found(text, f"({DECLARED})")
    declared = br_number(_found(text, DECLARED))
    at = F.coalesce(F.position(whole, text), F.lit(0))
    rest = F.when(at > 0, F.concat(F.substr(text, F.lit(1), at - 1), F.substr(text, at + F.length(whole)))).otherwise(text)
    base, condo, tax = (br_number(_found(rest, p)) for p in (DECLARED_RENT, DECLARED_CONDO, DECLARED_TAX))
    total = F.coalesce(base, F.lit(0.0)) + F.coalesce(condo, F.lit(0.0)) + F.coalesce(tax, F.lit(0.0))
    parts = F.struct(base.alias("rent"), condo.alias("condo"), tax.alias("tax"), F.greatest(total, declared).alias("total"), condo.isNotNull().alias("complete"))
    return F.when(base.isNotNull() | declared.isNotNull(), parts)


def total_price(text: Column) -> Column:
    """What a dwelling costs a month: the package price, else rent, condo fee and tax as far as given; null without a rent."""
    package, base = br_number(_found(text, PACKAGE)), rent(text)
    added = [F.coalesce(br_number(_found(text, p)), F.lit(0.0)) for p in (ADDED_CONDO, DECLARED_TAX)]
    return F.when(package != 0, package).when(base != 0, base + added[0] + added[1])


def detail(text: Column) -> Column:
    """``struct(place, price, rooms, area)`` of a detail page's text with its line breaks: the price behind ``Preço:``, else the rent."""
    marked = _found(text, DETAIL_PRICE)
    return F.struct(F.trim(_found(text, DETAIL_PLACE)).alias("place"), F.when(marked.isNotNull(), price(marked)).otherwise(rent(text)).alias("price"), rooms(text).alias("rooms"), area(text).alias("area"))


def worth_visiting(complete: Column, total: Column, asked: Column, most: float) -> Column:
    """Whether a detail page can change what is known: the cost is incomplete and what is known isn't above ``most`` already."""
    known = F.coalesce(F.when(total != 0, total), asked)
    return ~F.coalesce(complete, F.lit(False)) & F.coalesce(known <= most, F.lit(True))


def updated_on(text: Column) -> Column:
    """The date in ``Atualizado em dd/mm/yyyy``; null if absent or no date."""
    return F.try_to_date(_found(text, UPDATED), "dd/MM/yyyy")


def json_area(value: Column, unit: Column) -> Column:
    """Area of a structured floor size: square metres only (no unit, MTK, M2)."""
    return F.when(unit.isNull() | F.upper(unit).isin("M2", "MTK"), br_or_plain(value))


def br_or_plain(text: Column) -> Column:
    """A number written either way: Brazilian if it has a comma, else plain."""
    raw = _found(text, r"([\d.,]+)")
    return F.when(raw.contains(","), br_number(raw)).otherwise(raw.try_cast("double"))


def card_numbers(text: Column) -> Column:
    """``struct(rooms, bathrooms, floor, area, parking)`` of a card that only lists bare numbers."""
    five, three = CARD_FIVE, CARD_THREE
    n = lambda p, g: F.nullif(F.regexp_extract(text, p, g), F.lit(""))
    whole = lambda p, g, name: n(p, g).try_cast("int").alias(name)
    first = F.struct(whole(five, 1, "rooms"), whole(five, 2, "bathrooms"), whole(five, 3, "floor"), br_number(n(five, 4)).alias("area"), whole(five, 5, "parking"))
    second = F.struct(whole(three, 2, "rooms"), whole(three, 3, "bathrooms"), F.lit(None).cast("int").alias("floor"), br_number(n(three, 1)).alias("area"), whole(three, 4, "parking"))
    return F.when(n(five, 1).isNotNull(), first).when(n(three, 1).isNotNull(), second)
