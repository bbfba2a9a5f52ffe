"""Numbers of rows in a given order, without a window that one task would have to hold."""

from __future__ import annotations

from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.session import settled

LOCAL_BITS = 33  # of monotonically_increasing_id: what it keeps for the row within its partition


def numbered(rows: DataFrame, order: list[str | Column], name: str = "position", first: int = 0, name_of_store: str = "numbered") -> DataFrame:
    """``rows`` with their place in ``order``, gapless from ``first``.

    Rows are sorted by range, so partitions follow each other; each numbers its own rows and what the partitions before it hold
    is added, one number a partition. Ties are numbered in any order; nulls are placed as ``order`` says. The result is a stored table.
    """
    placed = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at__", F.monotonically_increasing_id())
    placed = settled(placed, name_of_store)
    part = F.shiftrightunsigned("at__", LOCAL_BITS).cast("int")
    counts = sorted(placed.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n")).collect())  # a row a partition
    before = accumulate((r.n for r in counts), initial=first)
    offsets = rows.sparkSession.createDataFrame([(r.part, b) for r, b in zip(counts, before, strict=False)], "part__ int, before__ long")
    local = F.col("at__").bitwiseAND(F.lit((1 << LOCAL_BITS) - 1))
    out = placed.join(F.broadcast(offsets), part == F.col("part__"))
    return out.withColumn(name, F.col("before__") + local).drop("at__", "part__", "before__")
