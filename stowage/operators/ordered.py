"""Running sums and dense ids over a global order, without a window over the whole table.

Rows are dealt out by ranges of the order and stored; each range is summed, the sums of the ranges before it are its
offset, and only within a range does a window run. The table of offsets has a row for each range.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stowage.scratch import cut


def sums_before(rows: DataFrame, order: Sequence[Column | str], sums: dict[str, Column], ranges: int | None = None) -> DataFrame:
    """Rows with, for each name, the sum of its column over all rows before in the order; 0 for the first.

    The order must be total for a defined result; null counts as nothing. Long sums stay long, decimals stay decimal.
    Rows equal in the order meet in one range, so an order with one very common value is no use here.
    """
    n = ranges or int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cut(rows.withColumns({f"_s{i}": c for i, c in enumerate(sums.values())}).repartitionByRange(n, *order).withColumn("_range", F.spark_partition_id()))
    whole = dealt.groupBy("_range").agg(*[F.sum(f"_s{i}").alias(f"_t{i}") for i in range(len(sums))])
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    offsets = whole.select("_range", *[F.coalesce(F.sum(f"_t{i}").over(earlier), F.lit(0)).alias(f"_b{i}") for i in range(len(sums))])
    within = Window.partitionBy("_range").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    found = dealt.join(F.broadcast(offsets), "_range")  # a row for each range
    return found.select(*rows.columns, *[(F.col(f"_b{i}") + F.coalesce(F.sum(f"_s{i}").over(within), F.lit(0))).alias(name) for i, name in enumerate(sums)])


def append_numbered(table: DataFrame, rows: DataFrame, order: Sequence[Column | str], id_col: str = "id") -> DataFrame:
    """The table and the rows, which get the ids after its largest, dense and in the order given; from 1 if it is empty.

    The order decides which row gets which id, so a total one gives the same ids in every run; rows that tie in it get
    neighbouring ids in any order. A column ``id_col`` that the rows have already is replaced.
    """
    last = table.agg(F.max(id_col)).first()[0] or 0
    fresh = sums_before(rows.drop(id_col), order, {id_col: F.lit(1).cast("long")})
    return table.unionByName(fresh.withColumn(id_col, (F.col(id_col) + last + 1).cast(table.schema[id_col].dataType)), allowMissingColumns=True)
