"""The match view of the driver's tables: a match is a line item with its order.

First side: the customer, second side: the supplier, champion: the part, role: the line number,
patch: the priority, end: the ship date, start: the order date, a win of the first side: return flag R.
Order and line number identify a match; of repeated ones the first by part, supplier, date and price stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.functions import scalars as S
from draftlake.session import settled

SQL = """
m AS (
  SELECT l_orderkey * 10 + l_linenumber AS game_id, o_custkey AS blue, l_suppkey AS red, l_partkey AS champion,
         l_linenumber AS role, o_orderpriority AS patch, o_orderdate AS started_at, l_shipdate AS ended_at,
         date_trunc('day', o_orderdate)::TIMESTAMP - INTERVAL 1 DAY AS cutoff,
         CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS win
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey
  QUALIFY row_number() OVER (PARTITION BY l_orderkey, l_linenumber
                             ORDER BY l_partkey, l_suppkey, l_shipdate, l_extendedprice, l_quantity, l_discount, l_tax) = 1)
"""


def matches(t) -> DataFrame:
    """The match view as a stored table: most queries use it twice, as history and as targets."""
    order = Window.partitionBy("l_orderkey", "l_linenumber").orderBy(
        "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity", "l_discount", "l_tax"
    )
    lines = t("lineitem").join(t("orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    return settled(lines.withColumn("n", F.row_number().over(order)).where("n = 1").select(
        (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("game_id"),
        F.col("o_custkey").alias("blue"),
        F.col("l_suppkey").alias("red"),
        F.col("l_partkey").alias("champion"),
        F.col("l_linenumber").alias("role"),
        F.col("o_orderpriority").alias("patch"),
        F.col("o_orderdate").alias("started_at"),
        F.col("l_shipdate").alias("ended_at"),
        S.cutoff(F.col("o_orderdate")).alias("cutoff"),
        F.when(F.col("l_returnflag") == "R", 1).otherwise(0).alias("win"),
    ), "matches")
