"""Line dedup with levelled sorted runs of line hashes.

The index is a list of levels, each a list of runs. A run is a table (h1, h2, owner) sorted by hash:
the lines that its batch saw first, and the document that keeps each. A new batch is merge-anti-joined
with every run and what is left becomes a run of level 0; when a level has ``fanout`` runs they are
compacted into one of the next level. Runs have no hash in common, so compaction is a merge.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlake.llm.common import free_name, map_arrow, stored

SPACE = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEED = 42  # of Spark's xxhash64


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE)), UPPER, LOWER)


class LineIndex:
    """Levelled runs of line hashes; ``add`` batches in the order in which documents have precedence."""

    def __init__(self, fanout: int = 3):
        self.fanout = fanout
        self.levels: list[list[DataFrame]] = []

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def add(self, lines: DataFrame) -> DataFrame:
        """Add (doc_id, h1, h2): each new hash is owned by the smallest doc_id of its batch."""
        fresh = lines.groupBy("h1", "h2").agg(F.min("doc_id").alias("owner"))
        for run in self.runs():
            fresh = fresh.join(run.hint("merge"), ["h1", "h2"], "left_anti")
        run = stored(fresh.sortWithinPartitions("h1", "h2"), "run-0")
        self._put(run, 0)
        return run

    def _put(self, run: DataFrame, level: int) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            merged = self.levels[level].pop()
            while self.levels[level]:
                merged = merged.union(self.levels[level].pop())
            merged = merged.repartition("h1", "h2").sortWithinPartitions("h1", "h2")
            self._put(stored(merged, f"run-{level + 1}"), level + 1)

    def owners(self) -> DataFrame:
        first, *rest = self.runs()
        for run in rest:
            first = first.union(run)
        return first


def _with_owners(lines: DataFrame, owners: DataFrame, part: int = 1000) -> DataFrame:
    """Lines with their owners. Lines that over a ``part``-th of all rows hold (fewer than ``part`` of them) are joined by broadcast."""
    keys = ["h1", "h2"]
    most = lines.count() // part
    common = lines.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > most).select(*keys)
    common = F.broadcast(stored(owners.join(F.broadcast(common), keys), "common-lines"))
    rare = lines.join(common.select(*keys), keys, "left_anti").join(owners, keys)
    return lines.join(common, keys).unionByName(rare)


def _drops(lines: DataFrame, batches: int, fanout: int) -> DataFrame:
    """(doc_id, gone): hashes of the lines that each document loses."""
    numeric = isinstance(lines.schema["doc_id"].dataType, T.NumericType)
    marks = [i / batches for i in range(1, batches)] if numeric else []
    cuts = (lines.agg(F.percentile_approx("doc_id", marks, 10000)).first()[0] or []) if marks else []
    index = LineIndex(fanout)
    for low, high in zip([None, *cuts], [*cuts, None], strict=True):
        part = lines if low is None else lines.where(F.col("doc_id") > low)
        index.add(part if high is None else part.where(F.col("doc_id") <= high))
    drops = _with_owners(lines, index.owners()).where("owner < doc_id")
    return drops.groupBy("doc_id").agg(F.collect_list("h1").alias("gone"))


def _rewrite(names: list[str], text_col: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_lines, n_dropped, kept = [], [], []
            at = batch.schema.get_field_index(text_col)
            for text, dropped in zip(batch.column(at), batch.column(len(names) - 2), strict=True):
                lines = left = (text.as_py() or "").encode().split(b"\n")
                gone = {h % (1 << 64) for h in dropped.as_py() or ()}
                if gone:
                    left = [x for x in lines if xxhash.xxh64_intdigest(x.strip().lower(), SEED) not in gone]
                n_lines.append(len(lines))
                n_dropped.append(len(lines) - len(left))
                kept.append(b"\n".join(left).decode())
            columns = [*batch.columns[: len(names) - 2], pa.array(n_lines, pa.int64()), pa.array(n_dropped, pa.int64())]
            columns[at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def rewritten(docs: DataFrame, batches: int = 4, min_chars: int = 10, fanout: int = 3, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with the kept text in ``text_col``, and two more columns: lines, and dropped lines; the names of these.

    A line counts by its key (stripped of ASCII white space, A-Z lower-cased) if that has at least
    ``min_chars`` code points; a document loses it if one of smaller id has it, and repeats within the
    first document stay. Null and empty texts are one empty line. Rows of one id are one document, so
    repeated rows keep the same lines. Rows with a null id keep all lines and own none. Helper columns
    get names that ``docs`` does not have; names may hold dots. ``batches`` splits numeric ids into ranges of about
    equal lines, in ascending order; ids of other types are one batch.
    """
    key = line_key(F.col("line"))
    lines = docs.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.explode(F.split(text_col, "\n", -1)).alias("line"))
    lines = lines.where(F.char_length(key) >= min_chars).select("doc_id", F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(1), key).alias("h2")).distinct()
    owner, gone, n_lines, n_dropped = (free_name(docs, c) for c in ("lines_of", "lines_gone", "lines_before", "lines_dropped"))
    drops = _drops(stored(lines, "lines"), batches, fanout).withColumnsRenamed({"doc_id": owner, "gone": gone})
    both = docs.join(drops, F.col(id_col) == F.col(owner), "left").drop(owner)
    kind = T.StructType([*docs.schema.fields, T.StructField(n_lines, T.LongType()), T.StructField(n_dropped, T.LongType())])
    return map_arrow(both, _rewrite(kind.names, text_col), kind), n_lines, n_dropped


def with_kept_lines(docs: DataFrame, **options) -> DataFrame:
    """``docs`` with their own columns and the kept text; options and rules as for ``rewritten``."""
    out, n_lines, n_dropped = rewritten(docs, **options)
    return out.drop(n_lines, n_dropped)


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """id, n_lines (before), n_dropped, kept (text) of each row; options and rules as for ``rewritten``."""
    out, n_lines, n_dropped = rewritten(docs.select(id_col, text_col), id_col=id_col, text_col=text_col, **options)
    return out.select(id_col, F.col(n_lines).alias("n_lines"), F.col(n_dropped).alias("n_dropped"), F.col(text_col).alias("kept"))
