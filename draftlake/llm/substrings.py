"""Substring dedup: relative Lempel-Ziv parsing of documents against indexed reference blocks.

A window is ``WINDOW`` consecutive words of a document; it is a copy if a document of smaller id has it.

* **Phrases.** The least hash among the stretches of ``GRAM`` words within a window is its anchor. All windows that
  follow each other under one anchor are a phrase, so a document is a chain of overlapping phrases, cut
  alike wherever the same words stand.
* **Reference blocks.** The reference is all documents. Phrases are dealt by anchor, so a block indexes all
  phrases of its anchors, each with the first document that has it. Words that share no anchor share no window:
  a document meets every block in which it can have a factor of WINDOW words, and no other. (To parse
  each document against each stretch of the corpus would be all pairs.)
* **Factors.** A phrase that an earlier document has continues the document's factor if that one came from the
  same document; else it begins a new one. Factors have WINDOW words at least.
* **Borders.** A passage ends within a phrase. So where an anchor has several phrases, the windows of each
  phrase are looked up one by one, by its first document: what that one has not, no later one
  with the phrase lacks knowledge of, as its whole phrase is a copy already.

Which words are dropped is therefore exact (up to 128-bit hashes: anchor and phrase, or anchor and window).
Texts move twice, compressed; phrases move once, as three numbers each.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from draftlake.llm.common import free_name, join_held, map_arrow, stored, utf8

WINDOW, GRAM = 13, 5
FACTOR = 0x9E3779B97F4A7C15  # odd, so that its powers have inverses
HOT, SALT = 1000, 64  # an anchor of over a HOT-th of a sample of the rows is dealt in SALT parts
SAMPLE = 0.01
_powers: list[np.ndarray] = []


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of FACTOR and of its inverse, modulo 2^64."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 1 << 15)
        ones = np.ones(1, np.uint64)
        _powers[:] = [np.cumprod(np.concatenate([ones, np.full(size, x, np.uint64)])) for x in (FACTOR, pow(FACTOR, -1, 1 << 64))]
    return _powers[0], _powers[1]


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class Parsed:
    """Words of a text, its windows (anchor, hash) and phrases (first window, one past the last, hash)."""

    def __init__(self, text: bytes):
        self.words = text.split()  # of bytes: ASCII white space only
        n = len(self.words)
        self.windows = max(0, n - WINDOW + 1)
        if not self.windows:
            self.begins = self.ends = self.anchors = self.phrases = np.empty(0, np.int64)
            return
        power, inverse = powers(n)
        one = np.fromiter(map(xxhash.xxh3_64_intdigest, self.words), np.uint64, n)
        self.sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(one * power[:n])])
        self.inverse = inverse
        grams = self.hashes(np.arange(n - GRAM + 1), GRAM)
        at = np.arange(self.windows) + np.lib.stride_tricks.sliding_window_view(grams, WINDOW - GRAM + 1).argmin(axis=1)
        self.begins = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
        self.ends = np.append(self.begins[1:], self.windows)
        self.anchors = grams[at[self.begins]].view(np.int64)
        self.phrases = self.hashes(self.begins, self.ends - self.begins + WINDOW - 1).view(np.int64)

    def hashes(self, start: np.ndarray, size) -> np.ndarray:
        """Hashes of the stretches of ``size`` words at ``start``."""
        return _mixed((self.sums[start + size] - self.sums[start]) * self.inverse[start])

    def of_windows(self, phrases: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """First word, anchor and hash of each window of some phrases."""
        if not len(phrases):
            return (np.empty(0, np.int64),) * 3
        count = self.ends[phrases] - self.begins[phrases]
        start = np.repeat(self.begins[phrases] - np.cumsum(count) + count, count) + np.arange(count.sum())
        return start, np.repeat(self.anchors[phrases], count), self.hashes(start, WINDOW).view(np.int64)


def _packed(at: int, level: int = 3) -> Callable:
    """Texts (column ``at``) compressed: they are dealt by document twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        pack = zstandard.ZstdCompressor(level=level).compress
        for batch in batches:
            columns = list(batch.columns)
            columns[at] = pa.array([pack(x.as_py()) for x in columns[at]], pa.binary())
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return run


def _unpack() -> Callable[[bytes], bytes]:
    import zstandard

    return zstandard.ZstdDecompressor().decompress


def _phrase_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, a, h): each phrase of a text once."""
    for batch in batches:
        docs, anchors, hashes = [], [], []
        for i, text in enumerate(batch.column(1)):
            own = Parsed(text.as_py())
            if own.windows:
                found, first = np.unique(own.phrases, return_index=True)
                docs.append(np.full(len(found), i))
                anchors.append(own.anchors[first])
                hashes.append(found)
        if docs:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(anchors)), pa.array(np.concatenate(hashes))], names=["doc", "a", "h"])


def _border_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(doc, a, h): each window of the listed phrases of a (compressed) text once."""
    unpack = _unpack()
    for batch in batches:
        docs, anchors, hashes = [], [], []
        for i, (text, listed) in enumerate(zip(batch.column(1), batch.column(2), strict=True)):
            own = Parsed(unpack(text.as_py()))
            wanted = np.flatnonzero(np.isin(own.phrases, listed.values.to_numpy()))
            _, a, h = own.of_windows(wanted)
            h, first = np.unique(h, return_index=True)
            docs.append(np.full(len(h), i))
            anchors.append(a[first])
            hashes.append(h)
        if docs:
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.concatenate(docs))), pa.array(np.concatenate(anchors)), pa.array(np.concatenate(hashes))], names=["doc", "a", "h"])


def greedy(starts: np.ndarray, ends: np.ndarray, sources: list) -> list[dict]:
    """Factors (start, length, source) of copied stretches in order of their starts: a stretch that touches the factor before and has its source continues it."""
    out: list[dict] = []
    for start, end, source in zip(starts.tolist(), ends.tolist(), sources, strict=True):
        last = out[-1] if out else None
        if last and last["source"] == source and start <= last["start"] + last["length"]:
            last["length"] = max(last["length"], end - last["start"])
        else:
            out.append({"start": start, "length": end - start, "source": source})
    return out


def _rewritten(names: list[str], text_at: int, kind: pa.DataType):
    """Rows whose last two columns are lists (h, first) of copied phrases and windows: those give way to words, factors; the text is unpacked and cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = _unpack()
        for batch in batches:
            n_words, factors, kept = [], [], []
            for text, phrases, windows in zip(batch.column(text_at), batch.column(batch.num_columns - 2), batch.column(batch.num_columns - 1), strict=True):
                raw = unpack(text.as_py())
                if not (phrases.is_valid and len(phrases)) and not (windows.is_valid and len(windows)):
                    words = raw.split()
                    n_words.append(len(words))
                    factors.append([])
                    kept.append(b" ".join(words).decode())
                    continue
                own = Parsed(raw)
                known = {x["h"]: x["first"] for x in phrases.as_py() or ()}
                copied = np.flatnonzero(np.isin(own.phrases, np.fromiter(known, np.int64, len(known))))
                starts, ends = own.begins[copied], own.ends[copied] + WINDOW - 1
                sources = [known[h] for h in own.phrases[copied].tolist()]
                single = {x["h"]: x["first"] for x in windows.as_py() or ()}
                if single:
                    rest = np.ones(len(own.phrases), bool)
                    rest[copied] = False
                    at, _, h = own.of_windows(np.flatnonzero(rest))
                    hit = np.isin(h, np.fromiter(single, np.int64, len(single)))
                    starts, ends = np.concatenate([starts, at[hit]]), np.concatenate([ends, at[hit] + WINDOW])
                    sources += [single[x] for x in h[hit].tolist()]
                    order = np.argsort(starts, kind="stable")
                    starts, ends, sources = starts[order], ends[order], [sources[i] for i in order]
                change = np.zeros(len(own.words) + 1, np.int64)
                np.add.at(change, starts, 1)
                np.add.at(change, ends, -1)
                left = np.flatnonzero(np.cumsum(change[:-1]) == 0)
                n_words.append(len(own.words))
                factors.append(greedy(starts, ends, sources))
                kept.append(b" ".join([own.words[i] for i in left]).decode())
            columns = [*batch.columns[:-2], pa.array(n_words, pa.int64()), pa.array(factors, kind)]
            columns[text_at] = pa.array(kept, pa.string())
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def _frequent(rows: DataFrame) -> list[int]:
    """Anchors of over a HOT-th of a sample's rows: fewer than HOT. It decides how rows are dealt, not what comes out."""
    total = F.sum("n").over(Window.partitionBy())
    counts = rows.groupBy("a").agg(F.count(F.lit(1)).alias("n")).where("n > 8")
    return [r.a for r in counts.orderBy(F.desc("n"), "a").limit(HOT).withColumn("total", total).where(F.col("n") * HOT > F.col("total")).collect()]


def phrase_index(docs: DataFrame, frequent: list[int]) -> DataFrame:
    """(doc, a, h, first, border) of each phrase that an earlier document has (first < doc), or whose windows are to be looked up by ``doc`` (border).

    Each block of anchors is sorted once. A frequent anchor is dealt in SALT parts by document, whose sums are put together afterwards.
    """
    salt = F.when(F.col("a").isin(frequent), F.pmod(F.xxhash64("doc"), F.lit(SALT)).cast("int") + 1).otherwise(F.lit(0)) if frequent else F.lit(0)
    rows = docs.mapInArrow(_phrase_rows, f"doc {docs.schema['doc'].dataType.simpleString()}, a long, h long").where("doc IS NOT NULL").withColumn("salt", salt)
    phrase, anchor = Window.partitionBy("a", "salt", "h"), Window.partitionBy("a", "salt")
    rows = rows.repartition("a", "salt").withColumn("first", F.min("doc").over(phrase))
    rows = rows.withColumn("several", F.min("h").over(anchor) != F.max("h").over(anchor))
    found = stored(rows.where("first < doc OR several OR salt > 0"), "phrases")
    plain = found.where("salt = 0").select("doc", "a", "h", "first", "several")
    if frequent:
        hot = found.where("salt > 0")
        names = hot.groupBy("a", "h").agg(F.min("first").alias("first"), F.count(F.lit(1)).alias("held"))
        many = names.groupBy("a").agg((F.count(F.lit(1)) > 1).alias("several"))
        names = stored(names.join(F.broadcast(many), "a").select(F.struct("a", "h").alias("key"), "first", "several", "held"), "hot-phrases")
        plain = plain.union(join_held(hot.select(F.struct("a", "h").alias("key"), "doc"), names, "key").select("doc", "key.a", "key.h", "first", "several"))
    return plain.select("doc", "a", "h", "first", (F.col("several") & (F.col("first") == F.col("doc"))).alias("border"))


def border_copies(texts: DataFrame, index: DataFrame) -> DataFrame:
    """(doc, h, first) of the windows at borders of factors that an earlier document has."""
    listed = index.where("border").groupBy("doc").agg(F.collect_list("h").alias("listed"))
    rows = texts.join(listed, "doc").select("doc", "text", "listed")
    rows = stored(rows.mapInArrow(_border_rows, f"doc {texts.schema['doc'].dataType.simpleString()}, a long, h long").select("doc", F.struct("a", "h").alias("key")), "border-windows")
    names = rows.groupBy("key").agg(F.min("doc").alias("first"), F.max("doc").alias("last"), F.count(F.lit(1)).alias("held")).where("first < last").drop("last")
    return join_held(rows, stored(names, "border-names"), "key").where("first < doc").select("doc", "key.h", "first")


def rewritten(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, str, str]:
    """``docs`` with the words that are no copies in ``text_col`` (joined by one space), and two more columns: the number of words before, and the factors that went; the names of these.

    Words are what ASCII white space separates, unchanged. A word goes if a window of WINDOW words covers it whose words also
    stand in a document of smaller id, in the texts as given. Factors (start, length, source) are in word numbers;
    ``source`` is the smallest id that has all of the phrases. Null, empty and blank texts have no words and become empty. Rows
    of one id are one document: none is a copy of another. Rows with a null id keep their words, and no other's go for them. Other columns stay
    as they are, helper columns get names that ``docs`` does not have; an empty table gives an empty table.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    plain = docs.select(F.col(id_col).alias("doc"), utf8(F.col(text_col)).alias("text"))
    frequent = _frequent(plain.sample(SAMPLE, seed=1).mapInArrow(_phrase_rows, f"doc {kind}, a long, h long"))
    index = stored(phrase_index(plain, frequent), "copied-phrases")
    borders = stored(border_copies(plain.mapInArrow(_packed(1), f"doc {kind}, text binary"), index), "copied-windows")
    copies = index.where("first < doc").select("doc", F.struct("h", "first").alias("phrase"), F.lit(None).cast(f"struct<h:bigint,first:{kind}>").alias("window"))
    copies = copies.union(borders.select("doc", F.lit(None).cast(f"struct<h:bigint,first:{kind}>"), F.struct("h", "first")))
    own, phrases, windows, n_words, factors = (free_name(docs, c) for c in ("copies_of", "copied_phrases", "copied_windows", "words_before", "copied_factors"))
    lists = copies.groupBy(F.col("doc").alias(own)).agg(F.collect_list("phrase").alias(phrases), F.collect_list("window").alias(windows))
    at = docs.columns.index(text_col)
    fields = [T.StructField(f.name, T.StringType() if f.name == text_col else f.dataType) for f in docs.schema.fields]
    raw = docs.withColumn(text_col, utf8(F.col(text_col)))
    packed = map_arrow(raw, _packed(at), T.StructType([T.StructField(f.name, T.BinaryType() if f.name == text_col else f.dataType) for f in fields]))
    both = packed.join(lists, F.col(f"`{id_col}`") == F.col(own), "left").drop(own)
    id_type = docs.schema[id_col].dataType
    factor = T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType()), T.StructField("source", id_type)])
    out = T.StructType([*fields, T.StructField(n_words, T.LongType()), T.StructField(factors, T.ArrayType(factor))])
    return map_arrow(both, _rewritten(out.names, at, _arrow_factors(id_type)), out), n_words, factors


def _arrow_factors(id_type) -> pa.DataType:
    from pyspark.sql.pandas.types import to_arrow_type

    return pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("source", to_arrow_type(id_type))]))


def dedup_substrings(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, n_words (before), n_removed, factors, kept (text) of each row; rules as for ``rewritten``."""
    out, n_words, factors = rewritten(docs.select(id_col, text_col), id_col, text_col)
    kept = F.when(F.col(text_col) == "", 0).otherwise(F.size(F.split(text_col, " ", -1)))
    return out.select(id_col, F.col(n_words).alias("n_words"), (F.col(n_words) - kept).alias("n_removed"), F.col(factors).alias("factors"), F.col(text_col).alias("kept"))
