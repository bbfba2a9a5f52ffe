"""Sharding: minimax contiguous partition of ordered atomic groups, DataFrame functions only.

Groups (rows of equal text) are ordered by the MD5 of their text and never split. The smallest
capacity for which a greedy sweep needs at most ``n_shards`` shards is found by binary search,
and the groups are cut within it. A group larger than the capacity has a shard of its own, so that
a hot group does not raise the capacity of the others; the greatest shard is the least possible.

Any cuts within that capacity will do, and a sweep that fills each shard leaves the last one short;
so each cut is made at its even share of what is left where the greedy check shows that the rest still
fits, and greedily elsewhere. Shards that are left over then halve the largest ones of several groups.

The sweep needs two questions only: *the largest group end not beyond x* and *the next after x*. Group ends (running sums of
bytes) are summarised in cells of equal width, a bounded number of rows; where a cell leaves an
answer open, only such cells are summarised again, more finely, until the capacity and all cuts are
exact. The driver therefore sees a bounded summary, never the groups.
"""

from __future__ import annotations

from bisect import bisect_right

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import stored

CELLS = 8192  # of the first summary
FINER = 256  # each further summary divides an open cell by this
SALTS = 256  # parts of a group, so that a hot group is counted and numbered by many tasks


class _Ends:
    """What is known of the group ends: cells (least end, greatest end), by position."""

    def __init__(self, cells: list[tuple[int, int, int, int]]):
        self.cells = sorted(cells)  # least, greatest, width of the cell, its number at that width
        self.least = [c[0] for c in self.cells]

    def last(self, x: int) -> tuple[int, int, int | None]:
        """Bounds of the largest end <= x (0: none), and the cell that leaves it open."""
        i = bisect_right(self.least, x) - 1
        if i < 0:
            return 0, 0, None
        least, greatest = self.cells[i][:2]
        return (greatest, greatest, None) if greatest <= x else (least, x, i)

    def next(self, x: int) -> tuple[int, int, int | None]:
        """Bounds of the least end > x (the last end, if there is none), and the cell that leaves it open."""
        i = bisect_right(self.least, x) - 1
        if i >= 0 and x < self.cells[i][1]:
            return x + 1, self.cells[i][1], i
        return (self.least[i + 1],) * 2 + (None,) if i + 1 < len(self.cells) else (self.cells[-1][1],) * 2 + (None,)

    def filled(self, at: int, capacity: int, side: int) -> int:
        """The end of a shard that starts at ``at``: as full as the capacity allows, or one larger group."""
        return max(self.last(at + capacity)[side], self.next(at)[side])

    def refined(self, gone: set[int], cells: list[tuple[int, int, int, int]]) -> _Ends:
        return _Ends([c for i, c in enumerate(self.cells) if i not in gone] + cells)


def _sweep(ends: _Ends, capacity: int, n: int, side: int) -> list[int]:
    """Ends of at most n shards; side 0 takes the lower bound of each open answer, 1 the upper."""
    out, at = [], 0
    for _ in range(n):
        at = ends.filled(at, capacity, side)
        out.append(at)
    return out


def _least_capacity(ends: _Ends, total: int, n: int, side: int, low: int, high: int) -> int:
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if _sweep(ends, mid, n, side)[-1] >= total else (mid + 1, high)
    return low


def _open_cells(ends: _Ends, low: int, high: int, n: int) -> set[int]:
    """Cells that a sweep of any capacity from low to high may ask about and that leave its answer open."""
    found: set[int] = set()
    near = far = 0
    for _ in range(n):
        for x, y in ((near, far), (near + low, far + high)):
            a, b = bisect_right(ends.least, x) - 1, bisect_right(ends.least, y) - 1
            found.update(i for i in range(max(a, 0), b + 1) if ends.cells[i][0] != ends.cells[i][1])
        near, far = ends.filled(near, low, 0), ends.filled(far, high, 1)
    return found


def _even_cuts(ends: _Ends, capacity: int, total: int, n: int) -> tuple[list[int], set[int]]:
    """Ends of n shards within the capacity, each cut at its even share of what is left if the rest still fits, else greedily.

    Also the cells that must be known more finely before these ends are exact.
    """
    asked: set[int] = set()

    def exact(answer: tuple[int, int, int | None]) -> int:
        if answer[2] is not None:
            asked.add(answer[2])
        return answer[0]

    def filled(at: int, size: int) -> int:
        return max(exact(ends.last(at + size)), exact(ends.next(at)))

    out, at = [], 0
    for i in range(1, n + 1):
        if at >= total:
            break
        end = rest = filled(at, min((total - at) // (n - i + 1), capacity))
        for _ in range(n - i):
            rest = filled(rest, capacity)
        at = end if rest >= total else filled(at, capacity)
        out.append(at)
    whole: set[int] = set()  # ends of shards of one group
    while len(out) < n and len(whole) < len(out):
        start, end = max(((a, b) for a, b in zip([0, *out], out) if b not in whole), key=lambda x: x[1] - x[0])
        half = filled(start, (end - start) // 2)
        if half < end:
            out = sorted([*out, half])
        elif (first := exact(ends.next(start))) < end:
            out = sorted([*out, first])
        else:
            whole.add(end)
    return out + [total] * (n - len(out)), asked


def minimax_cuts(ends: DataFrame, total: int, n_shards: int) -> tuple[int, list[int]]:
    """The least capacity (of shards of several groups) and the shards' ends, for a table of group ends (column ``end``)."""

    def summary(df: DataFrame, width: int) -> list[tuple[int, int, int, int]]:
        rows = df.groupBy(F.expr(f"(end - 1) div {width}").alias("cell")).agg(F.min("end").alias("a"), F.max("end").alias("b")).collect()
        return [(r.a, r.b, width, r.cell) for r in rows]

    known = _Ends(summary(ends, max(1, -(-total // CELLS))))
    while True:
        low = _least_capacity(known, total, n_shards, 1, 1, total)
        high = _least_capacity(known, total, n_shards, 0, low, total)
        todo = _open_cells(known, low, high, n_shards)
        if low == high:
            cuts, todo = _even_cuts(known, low, total, n_shards)
            if not todo:
                return low, cuts
        fresh: list[tuple[int, int, int, int]] = []
        for width in {known.cells[i][2] for i in todo}:
            cells = [known.cells[i][3] for i in todo if known.cells[i][2] == width]
            fresh += summary(ends.where(F.expr(f"(end - 1) div {width}").isin(cells)), max(1, width // FINER))
        known = known.refined(todo, fresh)


def assign_shards(docs: DataFrame, n_shards: int = 24, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every row of ``docs`` with its shard and its slot there; law ``bytes``.

    Size is the UTF-8 bytes of the text plus 8. Rows of equal text (null counts as empty) share a
    shard, so a group larger than the fair share makes its shard larger; else sizes are equal to
    within a group. Shards that nothing is left for stay empty. Rows with null or repeated ids are
    rows like any other (nulls first in their group). An empty table gives an empty result.
    Columns: id, size, text_crc32, law, shard, slot, grown_shard (null: only law ``key`` has it).
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    rows = docs.select(
        F.col(id_col).alias("doc_id"),
        (F.octet_length(text).cast("long") + 8).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.md5(text.cast("binary")).alias("g"),
        F.pmod(F.xxhash64(F.col(id_col)), F.lit(SALTS)).cast("int").alias("salt"),
    )
    rows = stored(rows, "shard-rows")
    parts = rows.groupBy("g", "salt").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"))
    parts = parts.withColumn("block", F.substring("g", 1, 3))
    order = Window.partitionBy("block").orderBy("g", "salt")
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.select(
        "*",
        F.sum("bytes").over(upto).alias("end_in"),
        F.sum("n").over(upto).alias("rows_in"),
        (~F.lead("g").over(order).eqNullSafe(F.col("g"))).alias("is_end"),
    )
    parts = stored(parts, "shard-parts")
    # at most 4096 blocks, by the first three digits of the MD5
    blocks = parts.groupBy("block").agg(F.max("end_in").alias("b"), F.max("rows_in").alias("r"))
    before = Window.orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select(
        "block",
        F.coalesce(F.sum("b").over(before), F.lit(0)).alias("b0"),
        F.coalesce(F.sum("r").over(before), F.lit(0)).alias("r0"),
    )
    parts = parts.join(F.broadcast(blocks), "block").select(
        "g", "salt", "n", "is_end", (F.col("end_in") + F.col("b0")).alias("end"), (F.col("rows_in") + F.col("r0")).alias("rows")
    )
    ends = parts.where("is_end").select("end", "rows")
    total = rows.agg(F.sum("size")).first()[0]
    cuts = minimax_cuts(ends, total, n_shards)[1][:-1] if total else []
    starts = {r.end: r.rows for r in ends.where(F.col("end").isin(cuts)).collect()} if cuts else {}
    shard = sum((F.when(F.col("end") > c, 1).otherwise(0) for c in cuts), F.lit(0)).cast("int")
    first = F.element_at(F.array(F.lit(0).cast("long"), *(F.lit(starts[c]).cast("long") for c in cuts)), F.col("shard") + 1)
    parts = parts.withColumn("shard", shard).select("g", "salt", "shard", (F.col("rows") - F.col("n") - first).alias("first_slot"))
    number = F.row_number().over(Window.partitionBy("g", "salt").orderBy("doc_id"))
    return rows.join(parts, ["g", "salt"]).select(
        F.col("doc_id").alias(id_col),
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        (F.col("first_slot") + number - 1).cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )
