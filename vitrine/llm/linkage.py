"""Matching entities across two sources that share no key: collective graph linkage."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from vitrine.operators.arrow_groups import map_groups
from vitrine.operators.nearby import distance_m, usable
from vitrine.session import materialize, settled

#: What a record must have; ``fee`` and ``tax`` are the shares of the price that go with a dwelling.
COLUMNS = ["id", "building", "city", "street", "zip", "lat", "lon", "rooms", "area", "price", "floor", "fee", "tax"]
#: Relative difference up to which two areas may be the same dwelling's.
AREA = 0.03
#: Relative difference of prices within which two records without area are the same dwelling's, and width of a price hub.
PRICE = 0.04
#: Relative difference of prices up to which a record without area may be the same dwelling's as another of its building and rooms.
UNSIZED_PRICE = 0.15
#: Confidence of such a pair where all sized records so near in price are of one area, and where only those nearest in price are taken.
ALONE, NEAREST = 0.9, 0.8
#: Metres within which two noisy coordinates may be the same building's, and the distance over which the evidence falls to a third.
REACH, NEARBY = 80.0, 18.0
#: Relative differences of prices and areas over which the evidence for a building falls to a third.
PRICE_NOISE, AREA_NOISE = 0.1, 0.006
#: Factors by which an equal and a differing fee, tax or floor count for and against a building.
EQUAL, DIFFERING = 50.0, 0.02
#: Evidence for a building of which no other record tells.
NONE_OF_THESE = 0.01
#: Share of the evidence that must speak for one building.
PLACED = 0.5
#: Share of an endpoint's best edge weight below which an edge is pruned.
PRUNE = 0.5
#: Confidence of a record's building named in its address, and factor of that of one inferred from its coordinates; of a pair that shares only a coordinate; of an area taken from listings of the same fee, tax or floor.
NAMED, INFERRED, UNPLACED, IMPUTED = 1.0, 0.95, 0.6, 0.95
#: Weight of the neighbours in a link's similarity; below 1, so that rescoring contracts to one solution whatever the start.
NEIGHBOURS = 0.3
#: What it says that two right records share a fee, a tax, a floor, a price.
HUBS = {"e": 1.0, "t": 1.0, "f": 0.9, "p": 0.6}
#: Greatest change of a similarity in a round after which rescoring is stable.
STABLE = 1e-6
#: Right records for each group of left records that are settled together.
RECORDS_AT_ONCE = 2_000
#: Least similarity of a match, and least share of the best of a record without area.
ACCEPT, OF_BEST = 0.3, 0.85


def _band(x: Column, width: float) -> Column:
    return F.floor(F.log(x) / math.log1p(width)).cast("int")


def _bands(x: Column, width: float) -> Column:
    return F.sequence(_band(x, width) - 1, _band(x, width) + 1)


def _agree(a: str, b: str) -> Column:
    return F.coalesce(F.col(a) == F.col(b), F.lit(True))


def _near(a: Column, b: Column, part: float) -> Column:
    return F.abs(a / b - 1) <= part


def with_buildings(records: DataFrame) -> DataFrame:
    """``records`` with ``building`` and ``placed``, how sure it is (1 if named in the address, null if unknown).

    A record whose address names no building is held against the buildings
    within ``REACH`` metres, by their named records on a compatible street that
    have the same rooms and nearly the same area and price. The evidence for a
    building is that of its best such record: it falls with the distance from
    the building and differences in price and area, is divided among the
    buildings given with that very coordinate, and grows by an equal fee, tax
    or floor. A building with more than ``PLACED`` of the
    evidence of all, and of ``NONE_OF_THESE``, is taken, its share being the
    confidence; no record is left out. Coordinates of at most three decimals are vague and say nothing here.
    """
    fine = usable(F.col("lat"), F.col("lon")) & ((F.round("lat", 3) != F.col("lat")) | (F.round("lon", 3) != F.col("lon")))
    named, open_ = records.where("building is not null"), records.where("building is null")
    cell = lambda c: F.floor(c * 1000).cast("int")
    # Where each building stands, by cell: its coordinates averaged, those it shares with others counting less.
    near = named.where(fine).select("building", "lat", "lon").distinct()
    own = near.join(near.groupBy("lat", "lon").agg(F.count("*").alias("sharing")), ["lat", "lon"]).groupBy("building", cell(F.col("lat")).alias("y"), cell(F.col("lon")).alias("x"))
    mean = lambda c: (F.sum(F.col(c) / F.col("sharing")) / F.sum(1 / F.col("sharing"))).alias(c)
    spots = own.agg(mean("lat"), mean("lon"), F.min("sharing").alias("sharing"))
    # Its dwellings as profiles: equal records are one row.
    profile = named.where(F.col("area") > 0).groupBy("building", "city", "street", "zip", "rooms", F.round("area", 1).alias("area"), "fee", "tax", "floor").agg(F.avg("price").alias("price"))
    profile = profile.join(spots, "building")
    profile = profile.select(*[F.col(c).alias("p_" + c) for c in profile.columns if c not in ("y", "x")], "y", "x", _band(F.col("area"), AREA).alias("band"))
    # The cells that a circle of REACH around the record touches; a degree of latitude has more than 110 km.
    touched = lambda c, d: F.explode(F.sequence(cell(F.col(c) - d), cell(F.col(c) + d)))
    high = F.lit(REACH / 110_000)
    wide = F.least(high / F.greatest(F.cos(F.radians("lat")), F.lit(1e-6)), F.lit(0.001))
    asked = open_.where(fine & (F.col("area") > 0)).withColumn("band", F.explode(_bands(F.col("area"), AREA)))
    asked = asked.withColumn("y", touched("lat", high)).withColumn("x", touched("lon", wide))
    away = distance_m(F.col("lat"), F.col("lon"), F.col("p_lat"), F.col("p_lon"))
    met = asked.join(profile, ["y", "x", "band"]).where(
        (F.col("city") == F.col("p_city"))
        & ((F.col("street") == "") | (F.col("p_street") == "") | (F.col("street") == F.col("p_street")))
        & ((F.col("zip") == "") | (F.col("p_zip") == "") | (F.col("zip") == F.col("p_zip")))
        & _agree("rooms", "p_rooms")
        & _near(F.col("area"), F.col("p_area"), AREA)
        & F.coalesce(F.col("p_price") / F.col("price"), F.lit(1.0)).between(0.75, 1.33)
        & (away <= REACH)
    )
    said = F.exp(-away / NEARBY - F.coalesce(F.abs(F.log(F.col("p_price") / F.col("price"))), F.lit(PRICE_NOISE)) / PRICE_NOISE - F.abs(F.col("area") / F.col("p_area") - 1) / AREA_NOISE) / F.col("p_sharing")
    for c in ("fee", "tax", "floor"):
        said = said * F.when(F.col(c) == F.col("p_" + c), EQUAL).when(F.col(c) != F.col("p_" + c), DIFFERING).otherwise(1.0)
    evidence = met.groupBy("id", "side", F.col("p_building").alias("found")).agg(F.max(said).alias("w"))
    best = evidence.groupBy("id", "side").agg(F.max(F.struct("w", "found")).alias("top"), F.sum("w").alias("all"))
    best = best.select("id", "side", "top.found", (F.col("top.w") / (F.col("all") + NONE_OF_THESE)).alias("share")).where(F.col("share") > PLACED)
    placed = open_.drop("building").join(best, ["id", "side"], "left").withColumns({"building": F.col("found"), "placed": INFERRED * F.col("share")})
    return named.withColumn("placed", F.lit(NAMED)).unionByName(placed.select(*records.columns, "placed"))


def with_areas(records: DataFrame) -> DataFrame:
    """``records`` with ``surveyed``, how sure the area is, and areas filled in from records of the building that share a fee, a tax, or floor and rooms.

    These go with one dwelling; where the records that share one of them have
    areas more than ``AREA`` apart, it says nothing.
    """
    sized = F.col("area") > 0
    key = _hubs(("e", "t", "f"))
    known = records.where(sized & F.col("building").isNotNull()).select(F.explode(key).alias("hub"), "area").groupBy("hub").agg(F.min("area").alias("least"), F.max("area").alias("most")).where(F.col("most") <= F.col("least") * (1 + AREA))
    asked = records.where(~F.coalesce(sized, F.lit(False)) & F.col("building").isNotNull()).select("id", "side", F.explode(key).alias("hub"))
    found = asked.join(known, "hub").groupBy("id", "side").agg(F.min("least").alias("least"), F.max("most").alias("most")).where(F.col("most") <= F.col("least") * (1 + AREA))
    both = records.join(found, ["id", "side"], "left")
    area = F.when(sized, F.col("area")).otherwise((F.col("least") + F.col("most")) / 2)
    return both.withColumns({"surveyed": F.when(sized, 1.0).when(area.isNotNull(), IMPUTED), "area": area}).select(*records.columns, "surveyed")


def _hubs(kinds: tuple[str, ...] = tuple(HUBS)) -> Column:
    """Keys of what a record shares with others of its dwelling, within its building."""
    number = lambda c: F.when(F.col(c) > 0, F.round(c, 2).cast("string"))
    keys = {
        "e": [F.concat_ws(",", F.lit("e"), "building", number("fee"))],
        "t": [F.concat_ws(",", F.lit("t"), "building", number("tax"))],
        "f": [F.concat_ws(",", F.lit("f"), "building", F.col("rooms").cast("int").cast("string"), F.col("floor").cast("int").cast("string"))],
        "p": [F.concat_ws(",", F.lit("p"), "building", F.col("rooms").cast("int").cast("string"), (_band(F.col("price"), PRICE) + d).cast("string")) for d in (0, 1)],
    }
    known = {"e": F.col("fee") > 0, "t": F.col("tax") > 0, "f": F.col("floor").isNotNull() & F.col("rooms").isNotNull(), "p": (F.col("price") > 0) & F.col("rooms").isNotNull()}
    return F.array_compact(F.array(*[F.when(known[k], x) for k in kinds for x in keys[k]]))


def candidates(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(l, r, weight)``: pairs that share an attribute, weighted by how rare it is, pruned.

    Attributes are a building and an exact coordinate, each with a band of
    area, so that a block holds little more than one dwelling. An attribute
    weighs ln(records / records that have it), an edge the sum of what its ends
    share. An edge stays if it reaches ``PRUNE`` of the best edge at either of
    its ends (weighted node pruning).
    """
    spot = F.when(usable(F.col("lat"), F.col("lon")), F.concat_ws(",", F.lit("x"), F.col("lat").cast("string"), F.col("lon").cast("string")))
    building = F.concat_ws(",", F.lit("b"), F.col("building").cast("string"))
    attributes = F.explode(F.array_compact(F.array(building, spot))).alias("attribute")
    sized = F.col("area") > 0  # The others are paired by :func:`unsized_pairs`.
    l_side = left.where(sized).select(F.col("id").alias("l"), "area", attributes).select("l", "attribute", F.explode(_bands(F.col("area"), AREA)).alias("band"))
    r_side = right.where(sized).select(F.col("id").alias("r"), attributes, _band(F.col("area"), AREA).alias("band"))
    n = left.select("id").unionByName(right.select("id")).count()
    rarity = r_side.groupBy("attribute", "band").count().select("attribute", "band", F.log(F.lit(float(n + 1)) / F.col("count")).alias("w"))
    edges = l_side.join(rarity, ["attribute", "band"]).join(r_side, ["attribute", "band"]).groupBy("l", "r").agg(F.sum("w").alias("weight"))
    edges = materialize(edges, "edges")
    best_l = edges.groupBy("l").agg(F.max("weight").alias("best_l"))
    best_r = edges.groupBy("r").agg(F.max("weight").alias("best_r"))
    return edges.join(best_l, "l").join(best_r, "r").where((F.col("weight") >= PRUNE * F.col("best_l")) | (F.col("weight") >= PRUNE * F.col("best_r"))).select("l", "r", "weight")


def own_similarity(edges: DataFrame, left: DataFrame, right: DataFrame) -> DataFrame:
    """``(l, r, s)``: similarity of the ends themselves; pairs that contradict each other are left out.

    Buildings and rooms must agree and areas lie within ``AREA``; the price
    only adds, because sources quote older, rounded or total prices. Where both
    buildings are unknown the shared coordinate stands for them; what it says
    is divided among the right record's partners there.
    """
    cols = ["id", "building", "rooms", "area", "price", "placed", "surveyed"]
    a = left.select(*[F.col(c).alias("l_" + c) for c in cols])
    b = right.select(*[F.col(c).alias("r_" + c) for c in cols])
    both = edges.join(a, F.col("l") == F.col("l_id")).join(b, F.col("r") == F.col("r_id"))
    placed = F.col("l_building") == F.col("r_building")
    neither = F.col("l_building").isNull() & F.col("r_building").isNull()
    both = both.where((placed | neither) & _agree("l_rooms", "r_rooms") & _near(F.col("l_area"), F.col("r_area"), AREA))
    off = F.abs(F.col("l_area") / F.col("r_area") - 1) / AREA
    apart = F.abs(F.log(F.col("l_price") / F.col("r_price")))
    price = F.when(apart.isNull(), 0.5).otherwise(F.greatest(F.lit(0.0), 1 - apart / 0.5))
    rooms = F.when(F.col("l_rooms") == F.col("r_rooms"), 1.0).otherwise(0.5)
    sure = F.coalesce(F.col("l_placed") * F.col("r_placed"), F.lit(UNPLACED)) * F.col("l_surveyed") * F.col("r_surveyed")
    rated = both.select("l", "r", neither.alias("neither"), (sure * (0.5 + 0.2 * (1 - off) + 0.15 * price + 0.15 * rooms)).alias("s"))
    rated = materialize(rated, "rated")  # else it would be worked out for either use
    alone = rated.where("neither").groupBy("r").agg(F.count("*").alias("partners"))
    return rated.join(alone, "r", "left").select("l", "r", (F.col("s") / F.when(F.col("neither"), F.col("partners")).otherwise(1)).alias("s"), F.lit(True).alias("settled"))


def unsized_pairs(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(l, r, s)``: pairs with a record without area on either side, by building, rooms and price.

    The sized records of both sides in its building, with the same rooms and a
    price within ``UNSIZED_PRICE``, show which dwellings it may be: if they
    differ in area by more than ``AREA``, it is paired only with those of the
    area nearest in price, with the lower confidence. Two records without area
    must lie within ``PRICE``. The area adds half of what it could.
    """
    cols = ["id", "building", "rooms", "area", "price", "placed"]
    both = left.select(*cols, F.lit("l").alias("side")).unionByName(right.select(*cols, F.lit("r").alias("side")))
    both = both.where("building is not null and price > 0").withColumn("area", F.when(F.col("area") > 0, F.col("area")))
    x = both.where("area is null").select("building", *[F.col(c).alias("x_" + c) for c in ("id", "side", "rooms", "price", "placed")], F.explode(_bands(F.col("price"), UNSIZED_PRICE)).alias("band"))
    y = both.withColumn("band", _band(F.col("price"), UNSIZED_PRICE))
    off = F.abs(F.log(F.col("x_price") / F.col("price")))
    met = x.join(y, ["building", "band"]).where(~((F.col("x_side") == F.col("side")) & (F.col("x_id") == F.col("id"))) & _agree("x_rooms", "rooms")).withColumn("off", off).where(F.col("off") <= math.log1p(UNSIZED_PRICE))
    met = materialize(met, "unsized")
    sized = met.where("area is not null").groupBy("x_side", "x_id").agg(F.min_by("area", F.struct("off", "area")).alias("nearest"), (F.max("area") / F.min("area") <= 1 + AREA).alias("alone"))
    same = F.when(F.col("area").isNull(), F.col("off") <= math.log1p(PRICE)).otherwise(_near(F.col("area"), F.col("nearest"), AREA))
    pairs = met.where("x_side <> side").join(sized, ["x_side", "x_id"], "left").where(same)
    price = F.greatest(F.lit(0.0), 1 - F.col("off") / 0.5)
    rooms = F.when(F.col("x_rooms") == F.col("rooms"), 1.0).otherwise(0.5)
    s = F.col("x_placed") * F.col("placed") * (0.6 + 0.15 * price + 0.15 * rooms) * F.when(F.col("alone"), ALONE).otherwise(NEAREST)
    on_left = F.col("x_side") == "l"
    return pairs.groupBy(F.when(on_left, F.col("x_id")).otherwise(F.col("id")).alias("l"), F.when(on_left, F.col("id")).otherwise(F.col("x_id")).alias("r")).agg(F.max(s).alias("s"), F.bool_or(on_left).alias("settled"))


def _settle(group: pa.Table) -> Iterator[pa.RecordBatch]:
    """The similarities of some left records' links, by repeated rescoring; one row per link and hub."""
    l, r, hub = (group.column(c).combine_chunks().dictionary_encode() for c in ("l", "r", "hub"))
    left = l.indices.to_numpy().astype(np.int64)
    _, first, of = np.unique(left * len(r.dictionary) + r.indices.to_numpy(), return_index=True, return_inverse=True)
    own = group.column("own").to_numpy()[first]
    shared = np.flatnonzero(hub.indices.is_valid().to_numpy(zero_copy_only=False))
    at = of[shared]
    # A hub counts for each left record on its own.
    code = np.unique(left[shared] * max(1, len(hub.dictionary)) + hub.indices.take(pa.array(shared)).to_numpy(), return_inverse=True)[1]
    n, w = group.column("n").take(pa.array(shared)).to_numpy(), group.column("w").take(pa.array(shared)).to_numpy()
    supported = np.zeros(len(own), dtype=bool)
    supported[at] = True
    s = own.copy()
    while True:
        support = np.zeros(len(own))
        if len(at):
            total = np.bincount(code, s[at])
            np.maximum.at(support, at, w * np.maximum(total[code] - s[at], 0) / (n - 1))
        new = np.where(supported, (1 - NEIGHBOURS) * own + NEIGHBOURS * support, own)
        change = float(np.abs(new - s).max())
        s = new
        if change <= STABLE:
            break
    take = pa.array(first)
    yield pa.RecordBatch.from_arrays([group.column("l").combine_chunks().take(take), group.column("r").combine_chunks().take(take), pa.array(s), group.column("settled").combine_chunks().take(take)], names=["l", "r", "s", "settled"])


def rescored(links: DataFrame, right: DataFrame) -> DataFrame:
    """``(l, r, s, settled)``: every link's similarity, refined by its neighbours' until stable.

    Neighbours of a right record are those of its building that share its fee,
    tax, floor or price. A link's support from one of these hubs is the mean
    similarity of the left record with the hub's other members, those it has no
    link with counting 0; the best hub counts. In each round a link with
    neighbours is (1 - ``NEIGHBOURS``) of its own similarity and ``NEIGHBOURS``
    of its support, so differences shrink by that factor a round and the
    solution doesn't depend on the order. Only links of the same left record
    support each other, so each one's links are settled on their own, in one
    pass; hubs stand in for pairs of right records, none of which is expanded.
    """
    members = right.where("building is not null").select(F.col("id").alias("r"), F.explode(_hubs()).alias("hub"))
    sizes = members.groupBy("hub").agg(F.count("*").alias("n")).where("n > 1")
    weight = F.lit(0.0)
    for kind, w in HUBS.items():
        weight = F.when(F.substring("hub", 1, 1) == kind, w).otherwise(weight)
    members = members.join(sizes, "hub").select("r", F.xxhash64("hub").alias("hub"), "n", weight.alias("w"))
    links = links.groupBy("l", "r").agg(F.max("s").alias("own"), F.bool_or("settled").alias("settled"))
    # Left records share a task's rounds, so that few of them are worth a start.
    bucket = F.pmod(F.xxhash64("l"), F.lit(right.count() // RECORDS_AT_ONCE + 1)).alias("bucket")
    rows = links.join(members, "r", "left").select(bucket, "l", "r", "own", "settled", "hub", "n", "w")
    types = dict(links.dtypes)
    return map_groups(rows, ["bucket"], [], _settle, f"l {types['l']}, r {types['r']}, s double, settled boolean")


def accepted(links: DataFrame) -> DataFrame:
    """``(l, r, s)``: the links that hold; of a right record without area, only those near its best."""
    best = links.groupBy("r").agg(F.max("s").alias("best"))
    return links.join(best, "r").where((F.col("s") >= ACCEPT) & (F.col("settled") | (F.col("s") >= OF_BEST * F.col("best")))).select("l", "r", "s")


def link(left: DataFrame, right: DataFrame) -> DataFrame:
    """``(l, r, confidence)``: the pairs of records of the two sources that are the same thing.

    Both sides: ``id, building`` (the address group, null if the address names
    none), ``city, street, zip`` ('' if unknown), ``lat, lon, rooms, area,
    price, floor, fee, tax``; other columns are ignored. Nulls anywhere only
    weaken a pair; a record with neither area nor price, and one whose building
    is unknown and whose coordinate no other record has, has no match. Ids are
    unique per side.
    """
    return linked(materialize(records(left, right), "records"))


def records(left: DataFrame, right: DataFrame) -> DataFrame:
    """The records of both sides, each with its ``side``."""
    return left.select(*COLUMNS, F.lit("l").alias("side")).unionByName(right.select(*COLUMNS, F.lit("r").alias("side")))


def linked(records: DataFrame) -> DataFrame:
    """:func:`link` over a written table of :func:`records`."""

    def placed() -> DataFrame:
        # What only tells buildings apart isn't needed further on.
        return with_areas(settled(lambda: with_buildings(records).drop("city", "street", "zip"), "with-buildings"))

    def scores() -> DataFrame:
        both = settled(placed, "placed")
        l, r = both.where("side = 'l'").drop("side"), both.where("side = 'r'").drop("side")
        pairs = settled(lambda: candidates(l, r).select("l", "r"), "candidates")
        sized = settled(lambda: own_similarity(pairs, l, r), "similar")
        unsized = settled(lambda: unsized_pairs(l, r), "unsized-similar")
        links = sized.unionByName(unsized)
        # Left records are settled each on its own, so half of them may be on disk at once.
        one, two = (settled(lambda p=p: rescored(links.where(F.pmod(F.hash("l"), F.lit(2)) == p), r), "rescored") for p in (0, 1))
        return accepted(one.unionByName(two)).select("l", "r", F.round("s", 4).alias("confidence"))

    return settled(scores, "linked")
