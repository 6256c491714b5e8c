"""Filling fixed-capacity containers: first-fit decreasing with a tournament tree."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vitrine.operators.arrow_groups import map_groups

#: Pieces aimed at per group; a group's unused space is at most about half a container more than one big group's.
GROUP_PIECES = 50_000
#: Sizes of containers at most.
KINDS = 1_000


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The container number of each size (given in falling order, none above capacity).

    The tree's leaves are the containers' free space, each inner node the
    greater of its two children; the first container that fits is found by
    going left wherever the left child has room.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    tree = [capacity] * (2 * leaves)
    out = np.empty(n, dtype=np.int64)
    for i, size in enumerate(sizes.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < size:
                node += 1
        out[i] = node - leaves
        tree[node] -= size
        node //= 2
        while node:
            best = max(tree[2 * node], tree[2 * node + 1])
            if tree[node] == best:
                break
            tree[node] = best
            node //= 2
    return out


def _pack(group: pa.Table) -> Iterator[pa.RecordBatch]:
    capacity = group.column("capacity")[0].as_py()
    bins = first_fit_decreasing(group.column("size").to_numpy(), capacity)
    for batch in group.append_column("bin", pa.array(bins)).select(["container", "cell", "bin", "id", "piece", "start", "size"]).combine_chunks().to_batches():
        yield batch


def pack(items: DataFrame, containers: DataFrame, *, group_pieces: int = GROUP_PIECES, seed: int = 17) -> DataFrame:
    """``(container, cell, bin, id, piece, start, size)``: where each piece of each item lies.

    ``items``: ``id, size``; ``containers``: ``container, capacity``, the sizes
    to pack for, each on its own. Every item is packed whole; one larger than
    the capacity is cut into full containers and a rest. A container is named
    by (container, cell, bin). Cells are random groups of items of about
    ``group_pieces`` pieces each, packed independently; ids and piece numbers
    decide the cell, so equal inputs give equal packings. Items of null or
    negative size count as 0; ids may repeat (each row is an item); containers
    without a positive capacity and null ids are left out. The containers are a
    list of at most ``KINDS`` sizes, each of which all items are packed for;
    more are refused.
    """
    sizes = items.where("id is not null").select("id", F.greatest(F.coalesce("size", F.lit(0)), F.lit(0)).alias("size"))
    kinds = containers.where("container is not null and capacity > 0").select("container", F.col("capacity").cast("bigint").alias("capacity")).distinct().limit(KINDS + 1).collect()
    if len(kinds) > KINDS:
        raise ValueError(f"at most {KINDS} sizes of containers")
    spark = items.sparkSession
    if not kinds:
        return spark.createDataFrame([], "container int, cell bigint, bin bigint, id bigint, piece int, start bigint, size bigint")
    totals = sizes.agg(F.count("*").alias("n"), *[F.sum(F.ceil(F.col("size") / k.capacity)).alias(f"k{i}") for i, k in enumerate(kinds)]).first()
    cells = [max(1, -(-int(totals[f"k{i}"] or 0) // group_pieces), -(-totals["n"] // group_pieces)) for i, _ in enumerate(kinds)]
    kind = F.explode(F.array(*[F.struct(F.lit(k.container).cast("int").alias("container"), F.lit(k.capacity).cast("bigint").alias("capacity"), F.lit(c).cast("bigint").alias("cells")) for k, c in zip(kinds, cells, strict=True)])).alias("k")
    pieces = sizes.select("id", "size", kind).select("k.*", "id", F.col("size").alias("whole"), F.explode(F.expr("sequence(0, cast(greatest(ceil(size / k.capacity), 1) - 1 as int))")).alias("piece"))
    placed = pieces.select(
        "container",
        "capacity",
        F.pmod(F.xxhash64("id", "piece", F.lit(seed)), F.col("cells")).alias("cell"),
        "id",
        "piece",
        (F.col("piece") * F.col("capacity")).alias("start"),
        F.least(F.col("capacity"), F.col("whole") - F.col("piece") * F.col("capacity")).alias("size"),
    ).withColumn("falling", -F.col("size"))
    return map_groups(placed, ["container", "cell"], ["falling", "id", "piece"], _pack, "container int, cell bigint, bin bigint, id bigint, piece int, start bigint, size bigint")
