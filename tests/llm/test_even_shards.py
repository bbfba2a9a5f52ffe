"""Shards beside a hot group are near equal, and none is empty while there are groups."""

from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F


@pytest.mark.parametrize("at", [0.0, 0.2, 0.7, 1.0])
def test_shards_beside_a_hot_group(spark, at):
    from draftlake.llm import sharding

    small, n = 6000, 24
    sizes = [90 + i % 21 for i in range(small)]
    sizes.insert(int(at * small), sum(sizes) // 2)  # a third of all
    ends, end = [], 0
    for size in sizes:
        ends.append(end := end + size)
    cuts = sharding.minimax_cuts(spark.createDataFrame([(e,) for e in ends], "end long"), end, n)[1]
    got = sorted(b - a for a, b in zip([0, *cuts], cuts))
    fair = (end - max(sizes)) / (n - 1)
    assert cuts[-1] == end and set(cuts) <= set(ends) and got[-1] <= max(sizes)
    assert all(0.9 * fair < x < 1.1 * fair for x in got[1:-1]) and got[0] > 0


@pytest.mark.parametrize("sizes", [[3, 3, 3, 3, 100], [100, 1, 1, 1], [1, 50, 1, 50, 1], [5] * 9, [1, 1, 1, 1, 1, 1, 7]])
def test_no_shard_is_empty_while_groups_remain(spark, sizes):
    from draftlake.llm import sharding

    ends = [(sum(sizes[: i + 1]),) for i in range(len(sizes))]
    cuts = sharding.minimax_cuts(spark.createDataFrame(ends, "end long"), sum(sizes), 4)[1]
    assert len(set(cuts)) == 4 and min(cuts) > 0 and cuts[-1] == sum(sizes)


def test_hot_text(spark):
    from draftlake.llm.sharding import assign_shards

    docs = spark.range(4000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot " * 20).otherwise(F.concat(F.lit("text " * 15), F.col("id"))).alias("text"))
    sizes, rows = Counter(), defaultdict(list)
    for r in assign_shards(docs, 24).collect():
        sizes[r.shard] += r["size"]
        rows[r.shard].append(r.slot)
    assert len(sizes) == 24 and all(sorted(x) == list(range(len(x))) for x in rows.values())
    *others, _ = sorted(sizes.values())
    assert others[0] > 0.5 * others[-1] and others[-1] < 0.04 * sum(sizes.values())
