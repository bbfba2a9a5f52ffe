"""Digests of ordered tables as hash trees: equal tables have one digest, and the first difference is found by descent.

Rows are numbered in the order of their key (``ordering``), so blocks of ROWS rows do not depend on how Spark had them
partitioned. A leaf is the SHA-256 of its rows' digests in order, a node that of up to FAN children; the root stands for
the table. Each level is one grouped aggregate of bounded groups.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlake.operators.ordering import numbered
from draftlake.session import settled

ROWS, FAN = 1024, 64


def _text(field: T.StructField) -> Column:
    c = F.col(f"`{field.name}`")
    if isinstance(field.dataType, T.DoubleType | T.FloatType):
        return (c + F.lit(0.0)).cast("string")  # -0.0 + 0.0 is 0.0; NaN has a text of its own
    if isinstance(field.dataType, T.TimestampType):
        return F.unix_micros(c).cast("string")
    if isinstance(field.dataType, T.StructType | T.ArrayType | T.MapType):
        return F.to_json(F.struct(c.alias("v")), {"ignoreNullFields": "false"})
    if isinstance(field.dataType, T.BinaryType):
        return F.hex(c)
    return c.cast("string")


def row_digest(rows: DataFrame, columns: list[str] | None = None) -> Column:
    """SHA-256 of a row's columns by name: the text of each with its length before it, so that no two rows run together; null is not the empty text."""
    fields = {f.name: f for f in rows.schema.fields}
    parts = []
    for c in sorted(columns or rows.columns):
        text = _text(fields[c])
        parts.append(F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("~")))
    return F.sha2(F.concat(F.lit(f"{len(parts)};"), *parts).cast("binary"), 256)


def tree(rows: DataFrame, keys: list[str], columns: list[str] | None = None) -> DataFrame:
    """(level, block, n, low, high, digest) of all nodes: level 0 has the leaves, the highest level one root.

    ``low`` and ``high`` are the JSON texts of the first and the last key of a leaf. Rows of equal keys are ordered by their digests.
    A table without rows has one leaf, the digest of nothing.
    """
    order = [F.col(f"`{k}`").asc_nulls_first() for k in keys]
    own = rows.select(*(F.col(f"`{k}`") for k in keys), row_digest(rows, columns).alias("digest__"))
    placed = numbered(own, [*order, F.col("digest__")], "n__", name_of_store="tree-rows")
    key = F.to_json(F.struct(*(F.col(f"`{k}`") for k in keys)), {"ignoreNullFields": "false"})
    joined = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("n__", "digest__"))), lambda x: x["digest__"]))
    leaves = placed.groupBy(F.floor(F.col("n__") / ROWS).alias("block")).agg(
        F.count(F.lit(1)).alias("n"), F.min_by(key, "n__").alias("low"), F.max_by(key, "n__").alias("high"), F.sha2(joined.cast("binary"), 256).alias("digest")
    )
    leaves = settled(leaves.select(F.lit(0).alias("level"), "block", "n", "low", "high", "digest"), "tree-leaves")
    count = leaves.count()
    if not count:
        nothing = rows.sparkSession.range(1).select(F.sha2(F.lit("").cast("binary"), 256))
        return nothing.selectExpr("0 AS level", "0L AS block", "0L AS n", "cast(null AS string) AS low", "cast(null AS string) AS high", f"`{nothing.columns[0]}` AS digest")
    levels = [leaves]
    while count > 1:
        children = F.concat_ws("", F.transform(F.sort_array(F.collect_list(F.struct("block", "digest"))), lambda x: x["digest"]))
        up = levels[-1].groupBy(F.floor(F.col("block") / FAN).alias("up")).agg(F.sum("n").alias("n"), F.min_by("low", "block").alias("low"), F.max_by("high", "block").alias("high"), F.sha2(children.cast("binary"), 256).alias("digest"))
        levels.append(settled(up.select(F.lit(len(levels)).alias("level"), F.col("up").alias("block"), "n", "low", "high", "digest"), "tree-level"))
        count = -(-count // FAN)
    return reduce(DataFrame.unionByName, levels)


def root(nodes: DataFrame) -> tuple[str, int]:
    """(digest, rows) of a tree."""
    top = nodes.orderBy(F.desc("level")).select("digest", "n").first()
    return top.digest, top.n


def first_difference(left: DataFrame, right: DataFrame) -> dict | None:
    """The first leaf in which two trees differ (block, and low and high of either side), None if they are equal.

    From the root down, only the children of the first node that differs are looked at: FAN rows a level.
    """
    tops = [t.agg(F.max("level")).first()[0] for t in (left, right)]
    if tops[0] != tops[1]:  # then the shorter one ends within the other's first nodes: look at all of the level that both have below their roots
        level, blocks = min(tops), None
    else:
        level, blocks = tops[0], [0]
    while True:
        a, b = (t.where(F.col("level") == level).select("block", "digest", "low", "high") for t in (left, right))
        if blocks is not None:
            a, b = (t.where(F.col("block").between(blocks[0], blocks[-1])) for t in (a, b))
        both = a.join(b.withColumnsRenamed({"digest": "digest2", "low": "low2", "high": "high2"}), "block", "full").where(~F.col("digest").eqNullSafe(F.col("digest2")))
        found = both.orderBy("block").first()
        if found is None:
            return None
        if level == 0:
            return {"block": found.block, "left": (found.low, found.high), "right": (found.low2, found.high2)}
        level, blocks = level - 1, [found.block * FAN, found.block * FAN + FAN - 1]
