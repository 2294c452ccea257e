"""Running sums within groups of any size, in two passes, without a group in one task.

Rows are dealt to ranges of their order and written; a window sums within each range, and
the totals of the ranges give a group that goes on in the next range what it starts with.
Only the first group of a range can have begun before, so that what is broadcast is a row
a range at most.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import stage


def running(
    rows: DataFrame, group: str, order: list[Column], ranges: list[Column], sums: dict[str, Column], xors: dict[str, Column] | None = None, name: str = "ranges"
) -> DataFrame:
    """rows with `position` (from 0) in their group by `order`, and for each entry of sums and xors what the rows before it come to.

    `ranges` are short columns that the order goes by first: rows that agree on the group
    and on all of them go to one task. A null group is a group. The names _part and
    those of the results must not be among the columns of rows.
    """
    xors = xors or {}
    staged = stage(rows.repartitionByRange(F.col(group), *ranges).withColumn("_part", F.spark_partition_id()), name)
    made: dict[str, tuple[Callable[[Column], Column], Column, Column]] = {"position": (F.sum, F.lit(1).cast("long"), F.lit(0).cast("long"))}
    made |= {k: (F.sum, v.cast("long"), F.lit(0).cast("long")) for k, v in sums.items()}
    made |= {k: (F.bit_xor, v, F.lit(0).cast("long")) for k, v in xors.items()}

    totals = staged.groupBy("_part", group).agg(*[f(v).alias(k) for k, (f, v, _) in made.items()])
    earlier = W.partitionBy(group).orderBy("_part").rowsBetween(W.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_part").alias("_carried_part"), F.col(group).alias("_carried_group"), *[f(k).over(earlier).alias(f"_carried_{k}") for k, (f, _, _) in made.items()]
    ).filter("_carried_position > 0")
    before = W.partitionBy("_part", group).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    within = staged.select("*", *[F.coalesce(f(v).over(before), none).alias(k) for k, (f, v, none) in made.items()])
    joined = within.join(F.broadcast(carried), (F.col("_part") == F.col("_carried_part")) & F.col(group).eqNullSafe(F.col("_carried_group")), "left")
    both = {
        k: F.col(k).bitwiseXOR(F.coalesce(f"_carried_{k}", none)) if k in xors else F.col(k) + F.coalesce(f"_carried_{k}", none) for k, (_, _, none) in made.items()
    }
    return joined.select(*rows.columns, *[v.alias(k) for k, v in both.items()])
