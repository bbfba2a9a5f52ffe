"""Exact top-k inner products over norm-sorted vectors.

Vectors are sorted by descending length and cut into blocks. Every query is answered on the first
(longest) block, which gives a score that its k-th best can't fall below; by Cauchy-Schwarz a query
then needs only the blocks whose longest vector times its own length reaches that score, and is sent
to no others. Inside a block vectors and queries are rotated by the singular vectors of the whole
table (of its 64 x 64 second moments, a grouped sum), which puts most of the product in the first
coordinates: the partial product plus the product of the residual lengths bounds the score from
above, and only pairs whose bound reaches the query's k-th best so far are multiplied out, in integers.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import stored

SCALE = 256
BLOCK = 8192  # vectors in a block
QUERIES = 1024  # queries in a block
RANGES = 256  # of lengths, at most
HEAD = 16  # rotated coordinates in the partial product
TILE = 512


def valid(vector) -> F.Column:
    """Not null, and only finite components."""
    return vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def integers(vector) -> F.Column:
    return F.transform(vector, lambda x: F.floor(x.cast("double") * SCALE))


def matrix(column: pa.Array) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    values = column.flatten().to_numpy(zero_copy_only=False)
    return values.reshape(len(column), -1) if len(column) else values.reshape(0, 0)


def second_moments(vectors: DataFrame, dim: int) -> np.ndarray:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((dim, dim))
        for batch in batches:
            x = matrix(batch.column(0)).astype(float)
            if len(x):
                total += x.T @ x
        i, j = np.triu_indices(dim)
        yield pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), pa.array(total[i, j])], names=["i", "j", "s"])

    out = np.zeros((dim, dim))
    for r in vectors.select("v").mapInArrow(run, "i long, j long, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).collect():
        out[r.i, r.j] = out[r.j, r.i] = r.s
    return out


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties to the smaller id."""
    return np.lexsort((ids, -scores))[:k]


def search_block(xs: np.ndarray, ids: np.ndarray, qs: np.ndarray, q_ids: np.ndarray, floors: np.ndarray, rotation: np.ndarray, k: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query place, ids, scores) of each query's k best in a block; floors: scores that the k-th best overall reaches."""
    lengths = np.sqrt((xs.astype(float) ** 2).sum(1))
    order = np.lexsort((ids, -lengths))
    xs, ids = xs[order], ids[order]
    rx, rq = xs @ rotation, qs @ rotation
    head = min(HEAD, rotation.shape[1])
    rest_x, rest_q = (np.sqrt((r[:, head:] ** 2).sum(1)) for r in (rx, rq))
    slack = 1e-9 * (np.sqrt((rq**2).sum(1))[:, None] + 1) * (lengths.max(initial=0) + 1)
    kept = [(np.zeros(0, np.int64), np.zeros(0, np.int64)) for _ in q_ids]
    floors = floors.astype(float).copy()
    for at in range(0, len(xs), TILE):
        tile = slice(at, at + TILE)
        bound = rq[:, :head] @ rx[tile, :head].T + rest_q[:, None] * rest_x[tile] + slack
        rows, cols = np.nonzero(bound >= floors[:, None])
        ends = np.searchsorted(rows, np.arange(len(q_ids) + 1))
        for q in np.flatnonzero(np.diff(ends)):
            own = at + cols[ends[q] : ends[q + 1]]
            own = own[ids[own] != q_ids[q]]
            found_ids = np.concatenate([kept[q][0], ids[own]])
            scores = np.concatenate([kept[q][1], xs[own] @ qs[q]])
            top = best(scores, found_ids, k)
            kept[q] = found_ids[top], scores[top]
            if len(top) == k:
                floors[q] = max(floors[q], scores[top[-1]])
    for q, (found_ids, scores) in enumerate(kept):
        if len(found_ids):
            yield q, found_ids, scores


def _search(rotation: np.ndarray, k: int):
    def run(key: tuple, left: pa.Table, right: pa.Table) -> pa.Table:
        out: list[list] = [[], [], []]
        if left.num_rows and right.num_rows:
            xs, qs = (matrix(t.column("v").combine_chunks()).astype(np.int64) for t in (left, right))
            ids, q_ids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
            for q, found, scores in search_block(xs, ids, qs, q_ids, right.column("floor").to_numpy(), rotation, k):
                out[0] += [q_ids[q]] * len(found)
                out[1] += found.tolist()
                out[2] += scores.tolist()
        return pa.table({n: pa.array(c, pa.int64()) for n, c in zip(("query_id", "vec_id", "score"), out, strict=True)})

    return run


def blocked(vectors: DataFrame, order: F.Column, rows: int) -> tuple[DataFrame, list[int], list[int]]:
    """``vectors`` with ``range`` and ``block`` of about ``rows`` rows; the first block and the number of blocks of each range.

    Ranges are ascending by ``order``, from its quantiles; a range of several blocks is dealt out by id. As
    there are at most ``RANGES`` ranges, what the plan holds of them does not grow with the table.
    """
    n = vectors.count()
    count = max(1, min(RANGES, -(-n // rows)))
    marks = vectors.agg(F.percentile_approx(order, [i / count for i in range(1, count)], 10 * count)).first()[0] if count > 1 else []
    marks = sorted(set(marks))
    before = F.size(F.filter(F.array(*map(F.lit, marks)), lambda m: m < order)) if marks else F.lit(0)
    ranged = vectors.withColumn("range", before)
    sizes = {r.range: r.n for r in ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).collect()}
    first, parts = [], []
    for i in range(len(marks) + 1):
        first.append(sum(parts))
        parts.append(max(1, -(-sizes.get(i, 0) // rows)))
    at = lambda xs: F.element_at(F.array(*map(F.lit, xs)), F.col("range") + 1)
    return ranged.withColumn("block", (at(first) + F.pmod(F.xxhash64("vec_id"), at(parts))).cast("int")), first, parts


def usual_length(vectors: DataFrame) -> int | None:
    """The most common number of components (the greatest of ties); None without vectors."""
    sizes = vectors.groupBy(F.size("v").alias("dim")).agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), F.desc("dim")).first()
    return sizes and sizes.dim


def top_k(table: DataFrame, k: int = 5, every: int = 50, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The k highest integer inner products of each query with all other rows: query_id, rank, vec_id, score.

    Queries are the rows whose id is divisible by ``every``. Components x count as floor(256 x), which
    must stay below 2**27 in size. Ties go to the smaller id; fewer candidates give fewer rows. Vectors
    that are null, empty, of another length than most, or hold null or non-finite components take no part, nor do
    rows with a null id. Rows of a repeated id are each a candidate of the queries with other ids; as
    queries they share one ranking. Other columns are left out, so none can clash.
    """
    rows = table.where(F.col(id_col).isNotNull() & valid(F.col(vector_col)))
    rows = rows.select(F.col(id_col).cast("long").alias("vec_id"), integers(F.col(vector_col)).alias("v"))
    rows = rows.withColumn("norm2", F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)).where(F.size("v") > 0)
    rows = stored(rows, "integer-vectors")
    dim = usual_length(rows)
    if dim is None:
        return table.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    rows = rows.where(F.size("v") == dim)
    rotation = np.linalg.eigh(second_moments(rows, dim))[1][:, ::-1].copy()
    rows, first_block, blocks = blocked(rows, -F.col("norm2"), BLOCK)
    rows = stored(rows, "norm-blocks")
    longest = {r.range: r.m for r in rows.groupBy("range").agg(F.max("norm2").alias("m")).collect()}
    marks = [longest.get(i, 0.0) for i in range(len(blocks))]
    parts = max(1, -(-rows.count() // (every * QUERIES)))
    queries = rows.where(F.col("vec_id") % every == 0).select(
        F.col("vec_id").alias("query_id"), "v", "norm2", F.pmod(F.xxhash64("vec_id"), F.lit(parts)).cast("int").alias("part")
    )
    queries = stored(queries, "queries")

    def search(cells: DataFrame, sent: DataFrame) -> DataFrame:
        """Queries (part, block, query_id, v, floor) against blocks of vectors (part, block, vec_id, v), a task for each pair."""
        cells = cells.select(F.col("part").alias("cell_part"), F.col("block").alias("cell_block"), "vec_id", "v")
        both = cells.groupBy("cell_part", "cell_block").cogroup(sent.groupBy("part", "block"))
        return both.applyInArrow(_search(rotation, k), "query_id long, vec_id long, score long")

    lowest = F.lit(-float(2**62))
    longest_block = rows.where("block = 0").select(F.explode(F.sequence(F.lit(0), F.lit(parts - 1))).alias("part"), "block", "vec_id", "v")
    asked = queries.select("part", F.lit(0).alias("block"), "query_id", "v", lowest.alias("floor"))
    first = stored(search(longest_block, asked), "first-block")
    floors = first.groupBy("query_id").agg(F.when(F.count(F.lit(1)) == k, F.min("score").cast("double")).otherwise(lowest).alias("floor"))
    open_ = queries.join(floors, "query_id", "left").withColumn("floor", F.coalesce("floor", lowest))
    found = first
    if sum(blocks) > 1:
        reach = F.array(*(F.struct(F.lit(m).alias("m"), F.lit(a).alias("a"), F.lit(a + n - 1).alias("z")) for m, a, n in zip(marks, first_block, blocks, strict=True)))
        sent = open_.select("*", F.explode(F.filter(reach, lambda r: F.sqrt(r.m * F.col("norm2")) * (1 + 1e-9) >= F.col("floor"))).alias("r"))
        sent = sent.select("part", F.explode(F.sequence("r.a", "r.z")).alias("block"), "query_id", "v", "floor").where("block > 0")
        pairs = sent.select("part", "block").distinct()
        found = first.union(search(rows.join(pairs, "block").select("part", "block", "vec_id", "v"), sent))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
