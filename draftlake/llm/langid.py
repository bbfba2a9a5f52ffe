"""Language ID of web pages by Bayesian evidence fusion.

For each page and language the log posterior is the sum of

* the text: hashed character trigram models, counted over all labelled documents, on the text outside
  of tags; per trigram, times at most ``EVIDENCE`` trigrams, since trigrams are far from independent;
* the markup language that the page declares: P(declared | language);
* the address: P(path tag | language), for a two-letter path segment;
* the host prior: the language shares of the host, smoothed with those of its domain, these with
  those of its suffix, and these with the shares of all pages, ``SMOOTH`` pages' worth each.

The tables behind the last three are grouped aggregations of the pages by their most likely language
by text alone.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import stored, utf8
from draftlake.llm.text_features import mix, slices

BITS = 15
EVIDENCE = 60.0
SMOOTH = 20.0
# comments, scripts, styles and tags; one that is never closed runs to the end, so that no part of a page is read twice
MARKUP = re.compile(r"<!--.*?(?:-->|\Z)|<(script|style)\b.*?(?:</\1\s*+>|\Z)|<[a-z/!?][^>]*+(?:>|\Z)", re.DOTALL | re.IGNORECASE | re.ASCII)

_LOWER = np.arange(256, dtype=np.uint64)
_LOWER[65:91] += 32
_LOWER[[9, 10, 11, 12, 13]] = 32


def text_of(page: str) -> bytes:
    """The text of an HTML page outside of its markup, with character references decoded, in one pass over the page."""
    text = MARKUP.sub(" ", page)
    return (html.unescape(text) if "&" in text else text).encode("utf-8", "replace")


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(text, bucket) of the byte trigrams within texts, A-Z lower-cased."""
    data = _LOWER[np.frombuffer(b"".join(texts), np.uint8)]
    doc = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    if len(data) < 3:
        return doc[:0], doc[:0]
    value = mix((data[:-2] << np.uint64(16) | data[1:-1] << np.uint64(8) | data[2:]) * np.uint64(0x9E3779B97F4A7C15))
    inside = (doc[:-2] == doc[2:]) & ~((data[:-2] == 32) & (data[1:-1] == 32))
    return doc[:-2][inside], (value[inside] >> np.uint64(64 - BITS)).astype(np.int64)


def text_models(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> tuple[list[str], np.ndarray]:
    """All languages, and the log probabilities of their trigrams, from all labelled documents: 128 KB a language."""
    names = sorted(r.lang for r in docs.where(F.col(lang_col).isNotNull()).select(F.col(lang_col).alias("lang")).distinct().collect())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, place = np.zeros((len(names), 1 << BITS), np.int64), {n: i for i, n in enumerate(names)}
        for batch in batches:
            texts, langs = batch.column(0).to_pylist(), [place.get(x, -1) for x in batch.column(1).to_pylist()]
            for a, b in slices([len(x) for x in texts], 1 << 20):
                doc, bucket = trigrams(texts[a:b])
                lang = np.array(langs[a:b], np.int64)[doc]
                total += np.bincount((lang * (1 << BITS) + bucket)[lang >= 0], minlength=total.size).reshape(total.shape)
        lang, bucket = np.nonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(lang), pa.array(bucket), pa.array(total[lang, bucket])], names=["lang", "bucket", "n"])

    counts = np.full((max(1, len(names)), 1 << BITS), 0.5)
    rows = docs.select(utf8(F.col(text_col)), F.col(lang_col)).mapInArrow(run, "lang long, bucket long, n long")
    for r in rows.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():  # languages x 2**BITS at most
        counts[r.lang, r.bucket] += r.n
    return names, np.log(counts / counts.sum(1, keepdims=True)).astype(np.float32)


def text_scores(pages: DataFrame, models: np.ndarray) -> DataFrame:
    """(.., html) rows with ``ll``: the log likelihood of the page's text by language, and without the page."""
    others = [c for c in pages.columns if c != "html"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            whole, out = batch.column(batch.schema.get_field_index("html")).to_pylist(), []
            for a, b in slices([len(x) for x in whole], 1 << 20):
                doc, bucket = trigrams([text_of(x) for x in whole[a:b]])
                n = np.bincount(doc, minlength=b - a)
                sums = np.stack([np.bincount(doc, weights=m[bucket], minlength=b - a) for m in models], axis=1)
                out += (sums * np.minimum(1.0, EVIDENCE / np.maximum(n, 1))[:, None]).tolist()
            columns = [batch.column(batch.schema.get_field_index(c)) for c in others]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(out, pa.list_(pa.float64()))], names=[*others, "ll"])

    kinds = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in others)
    return pages.mapInArrow(run, f"{kinds}, ll array<double>")


def argmax(scores: Column) -> Column:
    """Place of the greatest, the first of ties (from 0)."""
    return F.array_position(scores, F.array_max(scores)).cast("int") - 1


def _shares(rows: DataFrame, key: str, n: int) -> DataFrame:
    """(key, counts): how many rows of each key have each language by text."""
    return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.array(*(F.count_if(F.col("by_text") == i).cast("double") for i in range(n))).alias(f"{key}_n"))


def _smoothed(counts: Column, prior: Column) -> Column:
    """Shares of counts with ``SMOOTH`` rows of a prior; the prior where there are no counts."""
    total = F.aggregate(counts, F.lit(0.0), lambda a, x: a + x)
    return F.coalesce(F.zip_with(counts, prior, lambda c, p: (c + F.lit(SMOOTH) * p) / (total + F.lit(SMOOTH))), prior)


def identify(pages: DataFrame, docs: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """Each row of ``pages`` with its language: id, host, declared, by_text, language, confidence (posterior).

    Null or empty pages have no text evidence, null addresses no host (the prior of all pages). Rows
    with null or repeated ids, and repeated rows, are pages like any other. Markup that is never closed
    runs to the end of its page; the work is linear in a page's length. Ties go to the first language by
    name. Without labelled documents the language is null. Other columns are left out, so none can clash.
    """
    names, models = text_models(docs)
    n = len(names)
    host = F.lower(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/@?#]*@)?([^/:?#]+)", 1))
    path = F.split(F.regexp_extract(url_col, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^?#]*)", 1), "/")
    head = F.regexp_extract(html_col, r"(?is)<html\b([^>]*+)", 1)  # of the first such tag
    rows = pages.select(
        F.col(id_col).alias("page_id"),
        F.when(host != "", host).alias("host"),
        F.nullif(F.lower(F.regexp_extract(head, r"(?i)\blang\s*+=\s*+[\"']?([a-z]{2,3})", 1)), F.lit("")).alias("declared"),
        F.lower(F.get(F.filter(path, lambda x: x.rlike("^[A-Za-z]{2}$")), F.lit(0))).alias("tag"),
        F.coalesce(F.col(html_col), F.lit("")).alias("html"),
    )
    if not n:
        return rows.select(F.col("page_id").alias(id_col), "host", "declared", *(F.lit(None).cast(k).alias(c) for c, k in (("by_text", "string"), ("language", "string"), ("confidence", "double"))))
    rows = text_scores(rows, models).withColumn("by_text", argmax(F.col("ll")))
    labels = F.split("host", r"\.")
    rows = rows.withColumn("domain", F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(F.col("host")))
    rows = stored(rows.withColumn("suffix", F.element_at(labels, -1)), "page-evidence")

    # a row for each language: all pages, by language
    whole = {r.by_text: r.n for r in rows.groupBy("by_text").agg(F.count(F.lit(1)).alias("n")).collect()}
    base = F.array(*(F.lit((whole.get(i, 0) + 1.0) / (sum(whole.values()) + n)) for i in range(n)))
    size = F.array(*(F.lit(float(whole.get(i, 0))) for i in range(n)))

    def likelihood(key: str) -> DataFrame:
        """log P(key | language), with half a page added to each cell; the values of a key are few, else Spark joins by shuffle."""
        return _shares(rows, key, n).select(key, F.zip_with(f"{key}_n", size, lambda c, s: F.log((c + 0.5) / (s + 2.0))).alias(f"{key}_l"))

    suffixes = _shares(rows, "suffix", n).select("suffix", _smoothed(F.col("suffix_n"), base).alias("suffix_p"))
    domains = rows.where("domain IS NOT NULL").select("domain", "suffix", "by_text")
    domains = domains.groupBy("domain", "suffix").agg(F.array(*(F.count_if(F.col("by_text") == i).cast("double") for i in range(n))).alias("n_"))
    domains = domains.join(suffixes, "suffix").select("domain", _smoothed(F.col("n_"), F.col("suffix_p")).alias("domain_p"))
    hosts = rows.where("host IS NOT NULL").groupBy("host", "domain").agg(F.array(*(F.count_if(F.col("by_text") == i).cast("double") for i in range(n))).alias("n_"))
    hosts = stored(hosts.join(domains, "domain").select("host", _smoothed(F.col("n_"), F.col("domain_p")).alias("host_p")), "host-priors")

    fused = rows.join(hosts, "host", "left")
    for key in ("declared", "tag"):
        fused = fused.join(stored(likelihood(key), f"{key}-likelihood"), key, "left")
    prior = F.transform(F.coalesce("host_p", base), lambda p: F.log(p))
    terms = [F.col("ll"), prior, *(F.coalesce(f"{k}_l", F.array_repeat(F.lit(0.0), n)) for k in ("declared", "tag"))]
    score = reduce(lambda a, b: F.zip_with(a, b, lambda x, y: x + y), terms)
    fused = fused.withColumn("score", score)
    top = F.array_max("score")
    name = lambda place: F.element_at(F.array(*map(F.lit, names)), place + 1)
    return fused.select(
        F.col("page_id").alias(id_col), "host", "declared", name(F.col("by_text")).alias("by_text"), name(argmax(F.col("score"))).alias("language"),
        (1 / F.aggregate("score", F.lit(0.0), lambda a, x: a + F.exp(x - top))).alias("confidence"),
    )
