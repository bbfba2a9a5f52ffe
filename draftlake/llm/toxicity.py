"""Toxicity severity by cumulative-link ordinal regression.

P(grade > j) = sigmoid(w.x - theta_j) for ordered thresholds theta_1 < theta_2 < ..., which share the
weights w; the expected severity is the sum of these probabilities. x holds log(1 + count) of the
words and word stems most associated with the label, by their 64-bit hashes.

Labels only tell toxic from not, so the grades of toxic texts are learnt as well: grade 0 is not toxic, and toxic texts
get grades 1 to ``GRADES`` by how many of their words are strongly associated with the label, cut at
quantiles.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import stored, utf8
from draftlake.llm.quality import labelled_sample
from draftlake.llm.text_features import LETTER, slices, tokens

FIT_ROWS = 20_000  # labelled rows, at most, that the model is fitted on
WORDS = 512  # words and stems in the model
STEMS = (4, 5)  # bytes
GRADES = 3
SEVERE = 0.5  # expected severity from which a text counts as toxic, where the labelled rows set no other


def _words(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each word and of the first bytes of longer words (stems), by text."""
    t = tokens(texts, STEMS)
    words = t.kind == LETTER
    docs, hashes = [t.doc[words]], [t.hash[words]]
    for head in t.heads:
        long = words & (head != 0)
        docs.append(t.doc[long])
        hashes.append(head[long])
    return np.concatenate(docs), np.concatenate(hashes).view(np.int64)


def _presence(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, labels = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
        for a, b in slices([len(x) for x in texts], 1 << 20):
            doc, word = _words(texts[a:b])
            order = np.lexsort((word, doc))
            doc, word = doc[order], word[order]
            fresh = np.ones(len(doc), bool)
            fresh[1:] = (doc[1:] != doc[:-1]) | (word[1:] != word[:-1])
            label, word = labels[a:b][doc[fresh]], word[fresh]
            order = np.argsort(word, kind="stable")
            word, label = word[order], label[order]
            starts = np.flatnonzero(np.append(True, word[1:] != word[:-1])) if len(word) else np.zeros(0, int)
            n = np.diff(np.append(starts, len(word)))
            toxic = np.add.reduceat(label, starts) if len(word) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(word[starts]), pa.array(n.astype(np.int64)), pa.array(toxic.astype(np.int64))], names=["word", "n", "toxic"])


def vectors(texts: list[bytes], words: np.ndarray) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """(from, to, text, place of the word, count) by slice, for a sorted list of word hashes."""
    for a, b in slices([len(x) for x in texts]):
        doc, word = _words(texts[a:b])
        at = np.minimum(np.searchsorted(words, word), max(len(words) - 1, 0))
        hit = words[at] == word if len(words) else np.zeros(len(word), bool)
        pair, n = np.unique(doc[hit] * max(len(words), 1) + at[hit], return_counts=True)
        yield a, b, pair // max(len(words), 1), pair % max(len(words), 1), n


class Ordinal:
    """A fitted model: sorted word hashes, their weights, ordered thresholds; the severity from which a text is toxic."""

    def __init__(self, words: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, severe: float = SEVERE):
        self.words, self.weights, self.thresholds, self.severe = words, weights, thresholds, severe

    def severity(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros(len(texts))
        for a, b, doc, at, n in vectors(texts, self.words):
            out[a:b] = np.bincount(doc, weights=self.weights[at] * np.log1p(n), minlength=b - a)
        return sigmoid(out[:, None] - self.thresholds).sum(1)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_ordinal(x: np.ndarray, grade: np.ndarray, grades: int, ridge: float = 1e-4, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds by Adam on the mean log loss. Thresholds are a first one and positive gaps."""
    n, d = x.shape
    free = np.zeros(d + grades)  # weights, first threshold, log gaps
    free[d] = 2.0
    m, v = np.zeros_like(free), np.zeros_like(free)
    for step in range(1, steps + 1):
        w, gaps = free[:d], np.exp(free[d + 1 :])
        theta = free[d] + np.concatenate([[0], np.cumsum(gaps)])
        above = np.concatenate([np.ones((n, 1)), sigmoid((x @ w)[:, None] - theta), np.zeros((n, 1))], axis=1)
        p = np.maximum(above[np.arange(n), grade] - above[np.arange(n), grade + 1], 1e-12)
        slope = above * (1 - above)
        up, down = slope[np.arange(n), grade] / p, slope[np.arange(n), grade + 1] / p
        push = -(up - down) / n  # d loss / d score
        d_theta = np.array([((grade == j + 1) * up).sum() - ((grade == j) * down).sum() for j in range(grades)]) / n
        d_gaps = np.array([d_theta[j:].sum() for j in range(1, grades)]) * gaps
        g = np.concatenate([x.T @ push + ridge * w, [d_theta.sum()], d_gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        free = free - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return free[:d], free[d] + np.concatenate([[0], np.cumsum(np.exp(free[d + 1 :]))])


def fit(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, words: int = WORDS, grades: int = GRADES, id_col: str = "doc_id", text_col: str = "text") -> Ordinal:
    """The model, from at most ``rows`` labelled rows (equal texts once)."""
    sample = labelled_sample(labels, "toxic", rows)
    texts = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text")).join(F.broadcast(sample), "doc_id")
    texts = stored(texts.groupBy("text").agg(F.max("label").cast("int").alias("label")), "toxicity-sample")
    n, toxic = texts.agg(F.count(F.lit(1)), F.sum("label")).first()
    toxic = toxic or 0
    if not 0 < toxic < n:
        return Ordinal(np.zeros(0, np.int64), np.zeros(0), np.full(grades, 20.0))
    found = texts.mapInArrow(_presence, "word long, n long, toxic long").groupBy("word").agg(F.sum("n").alias("n"), F.sum("toxic").alias("toxic"))
    expected = F.col("n") * F.lit(toxic / n)
    gain = (F.col("toxic") - expected) * F.abs(F.col("toxic") - expected) / expected
    # a word that few texts have says nothing: at least 4 texts, and as many as 2 % of the toxic ones
    best = found.where((F.col("n") < n) & (F.col("n") >= max(4, 0.02 * toxic))).withColumn("gain", gain).orderBy(F.abs("gain").desc(), "word").limit(words).collect()
    # strongly associated: nine of ten texts with the word are toxic, and they are at least 1 % of the toxic texts
    strong = {r.word for r in best if r.toxic >= 0.9 * r.n and r.toxic >= 0.01 * toxic}
    known = np.array(sorted(r.word for r in best), np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own, label = batch.column(0).to_pylist(), batch.column(1).to_numpy(zero_copy_only=False)
            for a, b, doc, at, count in vectors(own, known):
                ends = np.searchsorted(doc, np.arange(b - a + 1))
                ats, counts = [at[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)], [count[i:j] for i, j in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(label[a:b], pa.int32()), pa.array(ats, pa.list_(pa.int64())), pa.array(counts, pa.list_(pa.int64()))], names=["label", "at", "count"])

    data = texts.mapInArrow(run, "label int, at array<long>, count array<long>").collect()  # ``rows`` sparse vectors at most
    x, y, hits = np.zeros((len(data), len(known))), np.zeros(len(data), int), np.zeros(len(data))
    is_strong = np.array([w in strong for w in known.tolist()])
    for i, r in enumerate(data):
        at, count = np.array(r["at"], int), np.array(r["count"], float)
        x[i, at] = np.log1p(count)
        y[i], hits[i] = r["label"], count[is_strong[at]].sum() if len(at) else 0
    marks = np.quantile(hits[y == 1], [g / grades for g in range(1, grades)])
    grade = np.where(y == 1, 1 + (hits[:, None] > marks).sum(1), 0)
    weights, thresholds = fit_ordinal(x, grade, grades)
    # midway between the clean and the toxic rows where they are apart
    fitted = sigmoid((x @ weights)[:, None] - thresholds).sum(1)
    clean, bad = np.quantile(fitted[y == 0], 0.999), np.quantile(fitted[y == 1], 0.005)
    return Ordinal(known, weights, thresholds, float(clean + bad) / 2 if clean < bad else SEVERE)


SEVERITY = "expected_severity"


def severities(text: Column, model: Ordinal) -> Column:
    """Expected severity of a text column (null and empty texts: that of no words); only the texts go to Python."""

    @F.pandas_udf("double")
    def severity(texts: pd.Series) -> pd.Series:
        return pd.Series(model.severity([x or b"" for x in texts]))

    return severity(utf8(text))


def grade_toxicity(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs`` with ``expected_severity`` (0 to GRADES) and ``is_toxic``; columns of these names are replaced.

    Null and empty texts have the severity of a text without any word of the model. Ids matter only
    for the labels: rows with null or repeated ids are graded like any other. Without labels of both
    kinds nothing is toxic.
    """
    keep = docs.drop(SEVERITY, "is_toxic")
    model = fit(docs, labels, rows, id_col=id_col, text_col=text_col)
    return keep.withColumn(SEVERITY, severities(F.col(text_col), model)).withColumn("is_toxic", F.col(SEVERITY) >= model.severe)


def drop_toxic(docs: DataFrame, labels: DataFrame, rows: int = FIT_ROWS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that are not toxic, with their own columns, whatever these are called."""
    model = fit(docs, labels, rows, id_col=id_col, text_col=text_col)
    return docs.where(severities(F.col(text_col), model) < model.severe)
