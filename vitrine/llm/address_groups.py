"""Which records stand for the same building, whatever way the address is written."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.llm.address import edits, parse, place, plain, words_alike
from vitrine.llm.components import connected_components
from vitrine.llm.sorted_neighbourhood import blocked, neighbours
from vitrine.session import discard, materialize, materialize_at, settled

#: Neighbours compared in each pass's order.
WINDOW = 12
#: Share of its town's rows that must give a neighbourhood before a title's ending is read as that neighbourhood.
PLACE_SHARE = 0.0005
FORM = ["city", "place", "kind", "street", "number", "building", "phase", "zip"]
#: Parts of an address within a building.
UNITS = ["tower", "flat"]


def parsed(rows: DataFrame, *, id: Column, street: Column, number: Column, building: Column, district: Column, city: Column, title: Column, postcode: Column, free_line: bool = False) -> DataFrame:
    """``(id, city, district, ending, kind, street, number, building, phase, zip, tower, flat)``, one row per input row; '' is unknown.

    ``ending``: the last words of the title; ``kind``: rua, avenida and so on. A postal code that ends in zeros
    stands for the whole town and is unknown.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict = {}
        for b in batches:
            out = []
            for st, no, bu, di, ci, ti, zp in zip(*[c.to_pylist() for c in b.columns[1:]], strict=True):
                dp, tp = place(di), place(ti)
                key = (st, no, bu, dp, tp)
                a = memo.get(key)
                if a is None:
                    if len(memo) > 50_000:
                        memo.clear()
                    a = memo[key] = parse(st, no, bu, free_line=free_line, places=(dp, tp))
                digits = "".join(c for c in zp or "" if c.isdigit())
                code = "" if len(digits) != 8 or digits.endswith("000") and digits[:5] + "000" == digits else digits
                out.append((plain(ci), dp, " ".join(tp.split()[-5:]), a.street_type, " ".join(a.street), a.number, " ".join(a.building), a.phase, code, a.block, a.unit))
            columns = list(zip(*out, strict=True)) if out else [()] * 11
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(c, pa.string()) for c in columns]], names=["id", "city", "district", "ending", "kind", "street", "number", "building", "phase", "zip", "tower", "flat"])

    text = lambda c: c.cast("string")
    rows = rows.select(id.alias("id"), text(street).alias("a"), text(number).alias("b"), text(building).alias("c"), text(district).alias("d"), text(city).alias("e"), text(title).alias("f"), text(postcode).alias("g"))
    id_type = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {id_type}, city string, district string, ending string, kind string, street string, number string, building string, phase string, zip string, tower string, flat string")


def with_place(rows: DataFrame) -> DataFrame:
    """``rows`` of :func:`parsed` with ``place``: the neighbourhood that ends the title if a neighbourhood of the town does, else the district.

    Distinct endings are few; each is looked up by its last one to five words
    among the neighbourhoods that at least ``PLACE_SHARE`` of the town's rows give.
    """
    given = rows.where("district <> ''").groupBy("city", F.col("district").alias("tail")).count()
    towns = given.groupBy("city").agg(F.sum("count").alias("all"))
    known = given.join(towns, "city").where(F.col("count") >= PLACE_SHARE * F.col("all")).select("city", "tail")
    tails = F.explode(F.transform(F.sequence(F.lit(1), F.lit(5)), lambda n: F.array_join(F.slice(F.split("ending", " "), F.greatest(-n, -F.size(F.split("ending", " "))), n), " "))).alias("tail")
    endings = rows.where("ending <> ''").select("city", "ending").distinct().select("city", "ending", tails).distinct()
    longest = endings.join(known, ["city", "tail"]).groupBy("city", "ending").agg(F.max_by("tail", F.length("tail")).alias("found"))
    return rows.join(longest, ["city", "ending"], "left").withColumn("place", F.coalesce("found", "district")).drop("found", "ending", "district")


def _alike(group: pa.Table, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether the forms at ``i`` and ``j`` name the same building; numbers, phases and kinds of street must agree exactly, so must towers and flats if the forms have them."""
    code = {c: group.column(c).combine_chunks().dictionary_encode() for c in FORM}
    at = {c: code[c].indices.to_numpy() for c in FORM}
    blank = {c: np.array([v == "" for v in code[c].dictionary.to_pylist()], dtype=bool)[at[c]] for c in FORM}
    same = lambda c: at[c][i] == at[c][j]
    either = lambda c: blank[c][i] | blank[c][j]
    zips = ~either("zip")
    area = np.where(zips, same("zip"), same("place") | either("place"))
    open_ = same("city") & area & (same("kind") | either("kind")) & (same("number") | either("number"))
    # Something in common is needed: number and street, number and postal code, or the building.
    numbers = ~either("number") & same("number")
    open_ &= (numbers & (~either("street") | zips)) | ~either("building")
    for c in UNITS:
        if c in group.column_names:
            units = group.column(c).combine_chunks().dictionary_encode().indices.to_numpy()
            open_ &= units[i] == units[j]
    values = {c: code[c].dictionary.to_pylist() for c in ("street", "building", "phase")}
    out = np.zeros(len(i), dtype=bool)
    memo: dict = {}

    def words(kind: str, x: int, y: int) -> bool:
        k = (kind, x, y)
        if k not in memo:
            memo[k] = words_alike(tuple(values[kind][x].split()), tuple(values[kind][y].split()), drop=kind == "street")
        return memo[k]

    for n in np.flatnonzero(open_):
        a, b = i[n], j[n]
        streets = not (blank["street"][a] or blank["street"][b])
        buildings = not (blank["building"][a] or blank["building"][b])
        # Where the building's name is the very same, the street may be mistyped on both sides.
        sure = buildings and at["building"][a] == at["building"][b] and edits(values["street"][at["street"][a]], values["street"][at["street"][b]], 3) <= 3
        if streets and not sure and not words("street", at["street"][a], at["street"][b]):
            continue
        if buildings and not (at["phase"][a] == at["phase"][b] and words("building", at["building"][a], at["building"][b])):
            continue
        out[n] = buildings or (numbers[n] and (streets or zips[n]))
    return out


def _passes() -> Column:
    backwards = lambda c: F.array_join(F.transform(F.reverse(F.split(c, " ")), F.reverse), " ")
    located = (F.col("street") != "") & (F.col("number") != "")
    named = F.col("building") != ""
    key = lambda n, when, *parts: F.when(when, F.struct(F.lit(n).alias("pass"), F.concat_ws("|", "city", *parts).alias("key")))
    return F.array_compact(
        F.array(
            key(1, located, "number", "street", "place"),
            key(2, located, "number", backwards("street"), "place"),
            key(3, named, "building", "phase", "place"),
            key(4, named, backwards("building"), "phase", "place"),
            key(5, (F.col("zip") != "") & (F.col("number") != ""), "zip", "number", "building"),
            key(6, (F.col("street") != "") & named, "street", "building"),
        )
    )


def _keys() -> Column:
    """Keys that few forms share: number and postal code, and two words of a building's name (the word, of a name of one)."""
    names = F.array_sort(F.array_distinct(F.split("building", " ")))
    two = F.flatten(F.transform(names, lambda x: F.transform(F.filter(names, lambda y: y > x), lambda y: F.concat_ws("|", "city", "phase", x, y))))
    words = F.when(F.col("building") == "", F.array().cast("array<string>")).when(F.size(names) == 1, F.array(F.concat_ws("|", "city", "phase", "building"))).otherwise(two)
    place = F.when((F.col("zip") != "") & (F.col("number") != ""), F.array(F.concat_ws("|", "city", "zip", "number"))).otherwise(F.array().cast("array<string>"))
    return F.concat(words, place)


def building_groups(rows: DataFrame, units: bool = False) -> DataFrame:
    """``(id, building_group)`` for the rows of :func:`parsed` that name a house number or a building.

    Equal readings collapse into one form first, so a building with very many
    rows is a handful of forms. Six passes sort the forms by differing orders
    of their parts (number and street, both also spelled backwards so that an
    error in the first letters doesn't part two forms, building, postal code)
    and compare neighbours; beside them all forms that share a number and
    postal code or two words of a building's name are compared, however many
    lie between them. Forms linked directly or through others share a group.
    Rows that name neither are left out; so are rows with a null id. An id with
    several readings is in each one's group.

    ``units``: rows of differing tower or flat, named or not, are kept apart:
    groups of dwellings instead of buildings.
    """
    form = [*FORM, *UNITS] if units else FORM
    placed = with_place(rows.where("id is not null and (number <> '' or building <> '')"))
    keyed, path = materialize_at(placed.groupBy("id", *form).count().drop("count"), "readings")
    forms = materialize(keyed.groupBy(*form).count().select(F.monotonically_increasing_id().alias("form"), *form), "forms")
    # From here on a reading is the number of its form.
    members = materialize(keyed.join(forms, form).select("id", "form"), "members")
    discard(rows.sparkSession, path)
    sorted_by = forms.select("form", *form, F.explode(_passes()).alias("p")).select("p.pass", "p.key", "form", *form)
    # Half of the passes at a time, so that half of the spread forms are on disk at once.
    near = [settled(lambda p=p: neighbours(sorted_by.where(F.col("pass").isin(*p)), keys=["pass", "key"], id="form", fields=form, window=WINDOW, compare=_alike), "near") for p in ((1, 2, 3), (4, 5, 6))]
    beside = settled(lambda: blocked(forms.withColumn("_key", F.explode(_keys())), key="_key", id="form", fields=form, compare=_alike), "beside")
    labels = settled(lambda: connected_components(near[0].unionByName(near[1]).unionByName(beside), forms.select(F.col("form").alias("v"))), "building-labels")
    return members.join(labels, F.col("form") == F.col("v")).select("id", F.col("label").alias("building_group")).distinct()


def pairs_within(members: DataFrame, group: str, id: str) -> DataFrame:
    """``(a, b)``, a < b: the pairs of ids within each group; a large group is split by the engine's skew join."""
    one = members.select(F.col(group).alias("g"), F.col(id).alias("a"))
    two = members.select(F.col(group).alias("g"), F.col(id).alias("b"))
    return one.join(two, "g").where("a < b").select("a", "b")
