"""Positions and ids without gathering a group, a value or the whole table in one task.

Rows are dealt to ranges of the sort key and sorted there, which gives each its place in its range;
the table of range sizes, one row each, gives every range its offset (a prefix sum).
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, MapType, StructType, VariantType

from ..session import cut_lineage

#: Bits of monotonically_increasing_id below the number of the partition.
_PLACE_BITS = 33


def numbered(rows: DataFrame, order: list[Column], name: str, first: Column | None = None) -> DataFrame:
    """Add ``name``: consecutive numbers from ``first`` (1) on, in the given order.

    Rows with equal sort keys follow by a hash of their plain columns, so that a frequent key is
    split between ranges as well; the numbering is written once, as its places hold for one run.
    """
    nested = (ArrayType, MapType, StructType, VariantType)
    plain = [F.col(f"`{f.name}`") for f in rows.schema if not isinstance(f.dataType, nested)]
    keys = [*order, F.xxhash64(*plain)]
    names = [f"_key{i}" for i in range(len(keys))]
    keyed = rows.select("*", *(k.alias(n) for n, k in zip(names, keys)))
    placed = keyed.repartitionByRange(*names).sortWithinPartitions(*names).drop(*names)
    placed = cut_lineage(placed.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    part = F.shiftright("_at", _PLACE_BITS)
    sizes = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_size"))
    # one row per range
    earlier = W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    offsets = sizes.select("_part", F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_offset"))
    place = F.col("_at").bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    return (
        placed.withColumn("_part", part)
        .join(offsets, "_part")
        .withColumn(name, (F.lit(1) if first is None else first) + F.col("_offset") + place)
        .drop("_at", "_part", "_offset")
    )


def numbered_within(rows: DataFrame, group: list[str], order: list[Column], name: str) -> DataFrame:
    """Add ``name``: 1, 2, 3 ... inside each group in the given order; NULL is a group of its own.

    Groups lie one after the other in the numbering of all rows, so a row's place in its group is
    its number less the least number of the group.
    """
    every = numbered(rows, [*(F.col(g) for g in group), *order], "_number")
    firsts = every.groupBy(*(F.col(g).alias(f"_{g}") for g in group)).agg(F.min("_number").alias("_least"))
    same = reduce(Column.__and__, (F.col(g).eqNullSafe(F.col(f"_{g}")) for g in group))
    return every.join(firsts, same).withColumn(name, F.col("_number") - F.col("_least") + 1).drop("_number", "_least", *(f"_{g}" for g in group))


def consecutive_ids(
    rows: DataFrame, order: str, first_id: Column, name: str, ties: tuple[str, ...] = ()
) -> DataFrame:
    """Add consecutive ids from ``first_id`` on, in the order of a column and then of ``ties``."""
    return numbered(rows, [F.col(order), *(F.col(t) for t in ties)], name, first_id)
