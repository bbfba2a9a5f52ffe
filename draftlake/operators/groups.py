"""Grouped states: collapse of repeated values, first-seen lists, duplicates, distributions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SINGLE, CONFLICT, MIXED, MISSING = "SINGLE", "CONFLICT", "MIXED", "MISSING"


def collapse_state(value: Column) -> Column:
    """An aggregate: CONFLICT (several values), MISSING (none), MIXED (one, and nulls), SINGLE."""
    n = F.count(value)
    return F.when(F.min(value) != F.max(value), CONFLICT).when(n == 0, MISSING).when(n < F.count(F.lit(1)), MIXED).otherwise(SINGLE)


def collapse_value(value: Column) -> Column:
    """An aggregate: the value of a SINGLE group, else null."""
    return F.when((F.min(value) == F.max(value)) & (F.count(value) == F.count(F.lit(1))), F.min(value))


def only_value(values: Column) -> Column:
    """The element of a set of one, else null."""
    return F.when(F.size(values) == 1, F.element_at(values, 1))


def distribution(rows: DataFrame, key: str, size: str = "n_rows", groups: str = "n_groups") -> DataFrame:
    """How many keys have how many rows."""
    return rows.groupBy(key).agg(F.count(F.lit(1)).alias(size)).groupBy(size).agg(F.count(F.lit(1)).alias(groups))


def repeated(rows: DataFrame, *keys: str, count: str = "n") -> DataFrame:
    """Keys with more than one row; a grouped count, so a hot key is pre-aggregated."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias(count)).where(F.col(count) > 1)


def keep_last(rows: DataFrame, keys: list[str], *order: str) -> DataFrame:
    """The last row of each key by ``order``, as a grouped maximum of structs."""
    rest = [c for c in rows.columns if c not in keys]
    last = rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("row__"))
    return last.select(*keys, "row__.*")


def first_seen(rows: DataFrame, keys: list[str], value: str, order: str) -> DataFrame:
    """Per key: null for no value, the value if there is one, else a JSON list in order of first appearance."""
    seen = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("at__"))
    lists = seen.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("at__", value))), lambda x: x[value]).alias("list__"))
    text = F.when(F.size("list__") == 1, F.element_at("list__", 1).cast("string")).otherwise(F.to_json("list__"))
    return rows.select(*keys).distinct().join(lists, keys, "left").select(*keys, text.alias("value"))


def in_rule_order(*frames: DataFrame) -> DataFrame:
    """Issue frames as one, with the place of each in ``rule_ord``."""
    return reduce(DataFrame.unionByName, [f.withColumn("rule_ord", F.lit(i)) for i, f in enumerate(frames)])


