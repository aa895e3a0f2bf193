"""Numbers along an order without one task that sees all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from urbanweave.functions.tables import checkpoint


def numbered(df: DataFrame, order: list[str], name: str = "number", partitions: int | None = None) -> DataFrame:
    """All columns of `df` and the place of each row, from 1, in the order of `order` (nulls first).

    Rows are dealt to ranges whose bounds Spark samples from the rows themselves, over all columns
    of `order`, so ids that begin alike, and equal ids that later columns tell apart, spread
    over tasks. The sizes of the ranges, one number each, give every range its first place. Rows
    that agree in all of `order` are numbered in an order of their own that stays fixed once
    written; an empty table gives no rows.
    """
    dealt = df.repartitionByRange(partitions, *order) if partitions else df.repartitionByRange(*order)
    dealt = dealt.sortWithinPartitions(*order).withColumns({"range_no": F.spark_partition_id(), "range_at": F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)})
    dealt = checkpoint(dealt)
    sizes = dealt.groupBy("range_no").agg(F.count("*").alias("range_size"))
    before = F.coalesce(F.sum("range_size").over(Window.orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # one row a range
    starts = sizes.select("range_no", before.alias("range_start"))
    return dealt.join(F.broadcast(starts), "range_no").select(*df.columns, (F.col("range_start") + F.col("range_at") + 1).alias(name))


def stable_ids(ids: DataFrame, column: str = "id", name: str = "number") -> DataFrame:
    """A positive number for every distinct id, by the order of the ids; null is none."""
    return numbered(ids.select(column).where(F.col(column).isNotNull()).distinct(), [column], name)
