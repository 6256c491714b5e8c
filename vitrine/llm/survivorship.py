"""Best representative of each duplicate group, field by field."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Writings that say that nothing was given.
PLACEHOLDERS = ["", "-", "--", "n/d", "nd", "n/a", "na", "null", "none", "nan", "nao informado", "nao informada", "sob consulta", "consulte", "a consultar", "?"]
# Accented letters and their plain forms.
ACCENTED, PLAIN = "áàâãäåéèêëíìîïóòôõöúùûüçñýÿ", "aaaaaaeeeeiiiiooooouuuucnyy"


def plain_text(text: Column) -> Column:
    """Lower case, without accents, single-spaced, trimmed; combining accents are dropped too."""
    bare = F.regexp_replace(F.translate(F.lower(text), ACCENTED, PLAIN), r"\p{M}", "")
    return F.trim(F.regexp_replace(bare, r"[\s ]+", " "))


def usable_text(text: Column) -> Column:
    """:func:`plain_text`, null for placeholders and for bare zeros."""
    bare = plain_text(text)
    return F.when(bare.isin(PLACEHOLDERS) | bare.rlike(r"^[0.,]+$"), F.lit(None).cast("string")).otherwise(bare)


def usable_amount(text: Column) -> Column:
    """The amount in a Brazilian or plain writing, to the cent; null for placeholders, zero and non-numbers.

    A comma is the decimal mark if there is one; without it a point before
    exactly three digits separates thousands, any other point is decimal.
    """
    digits = F.nullif(F.regexp_extract(text, r"(-?\d[\d.,]*)", 1), F.lit(""))
    digits = F.regexp_replace(digits, "[.,]+$", "")
    plain = (
        F.when(digits.contains(","), F.replace(F.replace(digits, F.lit("."), F.lit("")), F.lit(","), F.lit(".")))
        .when(digits.rlike(r"^-?\d{1,3}(\.\d{3})+$"), F.replace(digits, F.lit("."), F.lit("")))
        .otherwise(digits)
    )
    amount = F.round(plain.try_cast("double"), 2)
    return F.when(amount != 0, amount)


def two_decimals(amount: Column) -> Column:
    """The amount with two decimals and a point; null stays null."""
    return F.when(amount.isNotNull(), F.format_string("%.2f", amount))


def usable_value(field: Column, text: Column, text_fields: list[str]) -> Column:
    """The value as it is compared: text in plain form, an amount with two decimals and a point."""
    return F.when(field.isin(text_fields), usable_text(text)).otherwise(two_decimals(usable_amount(text)))


def latest_offers(offers: DataFrame, *, group: str, field: str, values: str, chosen: str, at: str) -> DataFrame:
    """The row with the greatest ``at`` of each (group, field): a map-side combined maximum.

    Map entries are compared in order of their keys. Null groups or fields are
    dropped; ties in ``at`` take the greatest entries, so the result is fixed.
    """
    entries = F.array_sort(F.transform(F.map_entries(values), lambda e: F.struct(e["key"].alias("source"), e["value"].alias("value"))))
    newest = F.max(F.struct(F.col(at).alias("at"), F.coalesce(entries, F.array()).alias("entries"), F.col(chosen).alias("chosen")))
    rows = offers.where(F.col(group).isNotNull() & F.col(field).isNotNull())
    return rows.groupBy(F.col(group).alias("group_id"), F.col(field).alias("field")).agg(newest.alias("o")).select("group_id", "field", "o.at", "o.entries", "o.chosen")


def surviving_values(latest: DataFrame, trust: DataFrame, text_fields: list[str]) -> DataFrame:
    """``(group_id, field, value)``: the value that should survive, null where no source gives any.

    ``trust``: ``source, trust``, sources in any letter case and spacing. Each
    source votes once per value. Per (group, field) one aggregation takes the
    greatest struct of (non-null, votes, greatest trust among the voters,
    value); the last only settles full ties.
    """
    said = latest.select("group_id", "field", F.explode_outer("entries").alias("e"))
    said = said.select("group_id", "field", plain_text(F.col("e.source")).alias("source"), usable_value(F.col("field"), F.col("e.value"), text_fields).alias("value"))
    ranked = said.join(trust, "source", "left")
    votes = ranked.groupBy("group_id", "field", "value").agg(F.count_distinct("source").alias("votes"), F.max(F.coalesce("trust", F.lit(0.0))).alias("trust"))
    best = F.max(F.struct(F.col("value").isNotNull().alias("given"), "votes", "trust", "value"))
    return votes.groupBy("group_id", "field").agg(best.alias("best")).select("group_id", "field", F.col("best.value").alias("value"))
