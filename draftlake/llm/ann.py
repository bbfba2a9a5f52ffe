"""Approximate nearest neighbours by collision counting.

Each block of vectors keeps one sorted array for each of ``PROJECTIONS`` random directions. A query
opens a window around its own projection in every array and counts, for each vector, in how many
windows it lies. The windows grow by virtual rehashing (the radius is multiplied by ``GROWTH``) until
enough vectors exceed the collision threshold; these are verified with their true distance. A block
is left when k verified vectors lie within the radius that the windows stand for, or enough vectors
were verified.

Every vector is indexed and every query visits every block, in a task for each pair of blocks.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import stored
from draftlake.llm.topk import matrix, usual_length, valid

BLOCK, QUERIES = 16384, 1024
PROJECTIONS = 96
THRESHOLD = 0.75  # of the projections
WIDTH = 1.2  # half a window, in radii: a vector at the radius is inside with probability 0.77
FIRST = 0.55  # the first radius, in root mean square distances from the mean
GROWTH = 1.25
SHARE, LEAST = 0.1, 100  # vectors of a block that are verified at most, beyond k
SEED = 1729


def directions(dim: int, count: int = PROJECTIONS, seed: int = SEED) -> np.ndarray:
    return np.random.default_rng(seed).standard_normal((dim, count))


def distances(xs: np.ndarray, q: np.ndarray) -> np.ndarray:
    return np.sqrt(((xs - q) ** 2).sum(1))


def search_block(xs: np.ndarray, ids: np.ndarray, qs: np.ndarray, q_ids: np.ndarray, radius: float, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query place, ids, distances) of up to k near vectors of a block for each query."""
    rays = directions(xs.shape[1])
    places = xs @ rays
    order = np.argsort(places, axis=0, kind="stable")
    lines = np.take_along_axis(places, order, axis=0)
    order, lines = np.ascontiguousarray(order.T), np.ascontiguousarray(lines.T)
    need, most = int(np.ceil(THRESHOLD * PROJECTIONS)), k + max(LEAST, int(SHARE * len(xs)))
    for q in range(len(qs)):
        at, r = qs[q] @ rays, radius
        counts, fresh = np.zeros(len(xs), np.int16), np.ones(len(xs), bool)
        fresh[ids == q_ids[q]] = False
        low = high = np.array([np.searchsorted(line, x) for line, x in zip(lines, at, strict=True)])
        found, near = [np.zeros(0, np.int64)], [np.zeros(0)]
        while True:
            new_low = np.array([np.searchsorted(line, x - WIDTH * r, "left") for line, x in zip(lines, at, strict=True)])
            new_high = np.array([np.searchsorted(line, x + WIDTH * r, "right") for line, x in zip(lines, at, strict=True)])
            new_low, new_high = np.minimum(new_low, low), np.maximum(new_high, high)
            # a projection holds each vector once, so that each of these is one more collision
            for own, a, b, c, d in zip(order, new_low, low, high, new_high, strict=True):
                counts[own[a:b]] += 1
                counts[own[c:d]] += 1
            low, high = new_low, new_high
            some = np.flatnonzero((counts >= need) & fresh)
            if len(some):
                fresh[some] = False
                found.append(some)
                near.append(distances(xs[some], qs[q]))
            got, far = np.concatenate(found), np.concatenate(near)
            whole = (low == 0).all() and (high == len(xs)).all()
            if whole or len(got) >= most or (len(far) >= k and np.partition(far, k - 1)[k - 1] <= r):
                break
            r *= GROWTH
        if len(got):
            top = np.lexsort((ids[got], far))[:k]
            yield q, ids[got[top]], far[top]


def _search(radius: float, k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            xs, qs = (matrix(t.column("v").combine_chunks()).astype(float) for t in (left, right))
            ids, q_ids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
            for q, found, far in search_block(xs, ids, qs, q_ids, radius, k):
                out[0] += [q_ids[q]] * len(found)
                out[1] += found.tolist()
                out[2] += far.tolist()
        return pa.table({"query_id": pa.array(out[0], pa.int64()), "vec_id": pa.array(out[1], pa.int64()), "score": pa.array(out[2], pa.float64())})

    return run


def nearest(table: DataFrame, k: int = 10, every: int = 100, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Up to k near rows of each query by Euclidean distance: query_id, rank, vec_id, score (the distance).

    Queries are the rows whose id is divisible by ``every``; all other rows are candidates. Nearest
    first, ties to the smaller id; fewer candidates give fewer rows. Vectors that are null, empty,
    zero, of another length than most, or hold null or non-finite components take no part, nor
    do rows with a null id. Rows of a repeated id are each a candidate of the queries with other ids; as
    queries they share one ranking. Other columns are left out, so none can clash.
    """
    rows = table.where(F.col(id_col).isNotNull() & valid(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.transform(F.col(vector_col), lambda x: x.cast("double")).alias("v"))
    rows = stored(rows.where(F.exists("v", lambda x: x != 0)), "vectors")
    dim, n = usual_length(rows), rows.count()
    if dim is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    rows = rows.where(F.size("v") == dim)
    blocks, parts = max(1, -(-n // BLOCK)), max(1, -(-n // (every * QUERIES)))
    rows = rows.withColumn("block", F.pmod(F.xxhash64(F.lit(SEED), "vec_id"), F.lit(blocks)).cast("int"))
    # the root mean square distance from the mean, from each component's variance
    spread = rows.select(F.posexplode("v").alias("i", "x")).groupBy("i").agg(F.var_pop("x").alias("s"))
    radius = FIRST * float(spread.agg(F.sqrt(F.sum("s"))).first()[0] or 1.0) or 1e-3
    queries = rows.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), "v", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part")
    )
    sent = stored(queries, "queries").withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    cells = rows.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    both = cells.groupBy("part", "block").cogroup(sent.groupBy("part", "block"))
    found = both.applyInArrow(_search(radius, k), "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy("score", "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
