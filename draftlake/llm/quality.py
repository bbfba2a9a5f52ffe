"""Quality classifier by importance resampling of hashed n-gram models.

Two bag-of-n-grams models over ``2**BITS`` buckets are counted in one pass: of the target (labelled
good texts) and of all raw texts. A document's log weight is the sum of log p_target - log p_raw over
its n-grams, and Gumbel top-k on the log weights draws k documents without replacement in proportion
to the weights. N-grams are of words (1, 2) and of word shapes (1 to 3: case, repeat of the word
before, digits, signs).

k is not given but learnt: a cut on the log weight per n-gram is set on the labelled sample, above
its rejected and below its good texts. It acts as a prior odds of the raw model: the weight that is drawn by is the sum
of log p_target - log p_raw - cut, and k is the number of documents whose weight is positive. With hundreds
of n-grams a text the weights differ by far more than the noise, so that the draw keeps nearly
exactly these.

Two passes over the texts: one counts the models, one weighs; what it found is stored, and the cut, k and
the k-th key are taken from there.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import free_name, stored, utf8
from draftlake.llm.text_features import ngrams, slices, tokens

BITS = 16
FIT_ROWS = 20_000  # labelled rows, at most, that target model and cut are fitted on
SEED = 1729


def features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of every n-gram."""
    t = tokens(texts)
    pairs = [ngrams(t.doc, t.hash, n, n) for n in (1, 2)] + [ngrams(t.doc, t.shape, n, 10 + n) for n in (1, 2, 3)]
    return np.concatenate([d for d, _ in pairs]), (np.concatenate([h for _, h in pairs]) >> np.uint64(64 - BITS)).astype(np.int64)


def labelled_sample(labels: DataFrame, label: str, rows: int) -> DataFrame:
    """At most ``rows`` labelled ids, picked by hash: small enough to broadcast by that bound."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1)).groupBy("doc_id").agg(F.max(label).alias("label"))
    return one.orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    raw, target = np.zeros(1 << BITS, np.int64), np.zeros(1 << BITS, np.int64)
    for batch in batches:
        texts, labels = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in slices([len(x) for x in texts]):
            doc, bucket = features(texts[a:b])
            raw += np.bincount(bucket, minlength=1 << BITS)
            target += np.bincount(bucket[labels[a:b][doc] == 1], minlength=1 << BITS)
    some = np.flatnonzero(raw)
    yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(raw[some]), pa.array(target[some])], names=["bucket", "raw", "target"])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> np.ndarray:
    """Log ratio of each bucket."""
    sample = labelled_sample(labels, "quality", rows)
    marked = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text")).join(F.broadcast(sample), "doc_id", "left")
    marked = marked.select("text", F.coalesce("label", F.lit(-1)).cast("int").alias("label"))
    counts = marked.mapInArrow(_counts, "bucket long, raw long, target long").groupBy("bucket").agg(F.sum("raw").alias("raw"), F.sum("target").alias("target"))
    raw, target = np.ones(1 << BITS), np.ones(1 << BITS)
    for r in counts.collect():  # 2**BITS rows at most
        raw[r.bucket] += r.raw
        target[r.bucket] += r.target
    return np.log(target / target.sum()) - np.log(raw / raw.sum()) if target.sum() > len(target) else np.zeros(1 << BITS)


def cut_of(scored: DataFrame, labels: DataFrame, rows: int, id_col: str, names: Names) -> float:
    """The cut on the log weight per n-gram that parts the labelled sample; minus infinity without good texts."""
    sample = labelled_sample(labels, "quality", rows)
    mean = names.total / F.greatest(names.n, F.lit(1))
    seen = scored.select(F.col(id_col).alias("doc_id"), mean.alias("mean")).join(F.broadcast(sample), "doc_id").groupBy("label")
    seen = seen.agg(*(F.percentile("mean", p).alias(n) for n, p in (("low", 0.002), ("high", 0.995))))
    found = {r.label: r for r in seen.collect()}
    if 1 not in found:
        return float("-inf")
    low = found[1].low
    return low if 0 not in found else (min(low, found[0].high) + low) / 2 if found[0].high < low else low


class Names:
    """Helper columns that clash with none of a table's: sum of the log ratios, and number of n-grams."""

    def __init__(self, docs: DataFrame):
        self.scores = free_name(docs, "scores")
        self.total, self.n = F.col(f"{self.scores}.total"), F.col(f"{self.scores}.n")


def weighed(text: Column, ratio: np.ndarray) -> Column:
    """(total, n): the sum of the log ratios of a text's n-grams, and their number; only the texts go to Python."""

    @F.pandas_udf("total double, n long")
    def weigh(texts: pd.Series) -> pd.DataFrame:
        raw = [x or b"" for x in texts]
        total, n = np.zeros(len(raw)), np.zeros(len(raw), np.int64)
        for a, b in slices([len(x) for x in raw]):
            doc, bucket = features(raw[a:b])
            total[a:b] = np.bincount(doc, weights=ratio[bucket], minlength=b - a)
            n[a:b] = np.bincount(doc, minlength=b - a)
        return pd.DataFrame({"total": total, "n": n})

    return weigh(utf8(text))


def gumbel(id_col: str, seed: int = SEED) -> Column:
    """Gumbel noise that the id fixes."""
    u = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.col(id_col)), 11) + 0.5) / float(1 << 53)
    return -F.log(-F.log(u))


def kth_largest(keys: DataFrame, column: str, k: int, rows: int = 4096) -> float:
    """The k-th largest value: histograms narrow it down until few values are left."""
    low, high = keys.agg(F.min(column), F.max(column)).first()
    left = keys
    while low < high and left.count() > rows:
        width = (high - low) / rows
        bins = left.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(rows - 1)).alias("bin"))
        counts = bins.agg(F.count(F.lit(1)).alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()
        for r in sorted(counts, key=lambda r: -r.bin):
            if k <= r.n:
                low, high = r.a, r.b
                break
            k -= r.n
        left = left.where(F.col(column).between(low, high))
    return low if low == high else sorted((r[0] for r in left.select(column).collect()), reverse=True)[k - 1]


def _drawn(docs: DataFrame, labels: DataFrame, rows: int, id_col: str, text_col: str) -> tuple[DataFrame, Names, Column, Column]:
    """The stored rows with their scores; their weight, and whether they are drawn."""
    names = Names(docs)
    ratio = fit(docs, labels, rows, id_col, text_col)
    scored = stored(docs.withColumn(names.scores, weighed(F.col(text_col), ratio)), "quality-scores")
    cut = cut_of(scored, labels, rows, id_col, names)
    if cut == float("-inf"):
        return scored, names, names.total, F.lit(True)
    weight = names.total - cut * names.n
    k = scored.where(weight >= 0).count()
    key = weight + gumbel(id_col)
    least = kth_largest(scored.select(key.alias("key")), "key", k) if k else float("inf")
    return scored, names, weight, key >= least


def resample(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``log_weight``, ``gumbel_key`` and ``accepted`` (drawn or not).

    Null and empty texts have log weight 0. Rows with null ids share one noise value; repeated rows
    are drawn together, as are ties with the k-th key. Without labelled good texts all is accepted.
    Columns of these three names are replaced; others may have any name.
    """
    keep = docs.drop("log_weight", "gumbel_key", "accepted")
    scored, names, weight, accepted = _drawn(keep, labels, rows, id_col, text_col)
    out = [F.col(f"`{c}`") for c in keep.columns]
    return scored.select(*out, weight.alias("log_weight"), (weight + gumbel(id_col)).alias("gumbel_key"), accepted.alias("accepted"))


def select(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The drawn rows of ``docs`` with their own columns, whatever these are called."""
    scored, names, _, accepted = _drawn(docs, labels, rows, id_col, text_col)
    return scored.where(accepted).drop(names.scores)
