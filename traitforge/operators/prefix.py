"""Running sums and numbering over groups of any size.

A window with one very large group would sort it in one task. Here rows are dealt out by ranges of
(group, order), summed inside each range, and the ranges' totals, a row for each range and group,
are summed up on their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..plans.storage import materialize


def prefix_sums(rows: DataFrame, group: list[str], order: list[Column], sums: dict[str, Column], inclusive: bool = True) -> DataFrame:
    """``rows`` with the running sums ``sums`` (name to summed expression) of each group in
    ``order``, which must tell all rows of a group apart; without the row's own value unless
    ``inclusive``. Null groups are groups."""
    dealt = materialize(rows.repartitionByRange(*[F.col(g) for g in group], *order).withColumn("_p", F.spark_partition_id()), "ranges")
    here = Window.partitionBy("_p", *group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    ranges = dealt.groupBy("_p", *group).agg(*[F.sum(c).alias(f"_t_{name}") for name, c in sums.items()])
    past = Window.partitionBy(*group).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    before = ranges.select(F.col("_p").alias("_q"), *[F.col(g).alias(f"_g_{g}") for g in group], *[F.sum(f"_t_{name}").over(past).alias(f"_b_{name}") for name in sums])
    local = dealt.withColumns({f"_l_{name}": F.sum(c).over(here) for name, c in sums.items()})
    same = F.col("_p") == F.col("_q")
    for g in group:
        same = same & F.col(g).eqNullSafe(F.col(f"_g_{g}"))
    joined = local.join(before, same)
    zero = F.lit(0)
    return joined.select(*rows.columns, *[(F.coalesce(F.col(f"_l_{name}"), zero) + F.coalesce(F.col(f"_b_{name}"), zero)).alias(name) for name in sums])


def numbered(rows: DataFrame, order: list[Column], name: str = "n") -> DataFrame:
    """``rows`` with their place in ``order``, from 0; ``order`` must tell all rows apart."""
    return prefix_sums(rows, [], order, {name: F.lit(1)}, inclusive=False)
