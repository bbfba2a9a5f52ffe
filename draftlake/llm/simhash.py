"""SimHash near-duplicates by Golay-code fuzzy hashing.

A fingerprint has 64 bits, in three segments. Two fingerprints with at most two differing bits agree
in at least one segment (pigeonhole), and the next segment then holds at most two of the errors.
That next segment, padded to 23 bits, is decoded with the perfect binary Golay code: the segment and
each of its one-bit neighbours decode to one nearby codeword each, and two segments at most two bits
apart have a common neighbour (or are neighbours), hence a common codeword index. The keys of a
fingerprint are (segment number, the segment, a codeword index of the next): join on them, verify.

Fingerprints are made distinct first. A key with more than ``BUCKET`` fingerprints is not paired up:
its fingerprints are keyed by themselves and their 64 one-bit neighbours instead, where all that
share a key are linked with each other, so that a star replaces the pairs. No link is lost.

``near_duplicates`` is the operator at a radius of two bits; ``near_copies.first_of_each`` is the same
operator at a wide radius, five words and a similarity of 0.8, which takes more segments and soft decoding.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import join_held, stored, utf8
from draftlake.llm.components import components
from draftlake.llm.golay import golay_index

SEED = 42
SEGMENTS = ((0, 22), (22, 21), (43, 21))  # first bit, bits
BUCKET = 16
BITS = 2  # what the three segments and the radius of the code are made for


def fingerprint(text: bytes, words: int = 3) -> int:
    """The unsigned fingerprint of a UTF-8 text: bit set in over half the hashes of its shingles."""
    tokens = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not tokens:
        return 0
    if len(tokens) < words:
        shingles = [b" ".join(tokens)]
    else:
        shingles = list(map(b" ".join, zip(*(tokens[i:] for i in range(words)), strict=False)))
    digest, counts = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for at in range(0, len(shingles), 1 << 15):
        hashes = np.array([digest(s, SEED) for s in shingles[at : at + (1 << 15)]], dtype="<u8")
        bits = np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        counts += bits.sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(counts * 2 > len(shingles), bitorder="little").tobytes(), "little")


def _fingerprints(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = np.fromiter((fingerprint(x.as_py()) for x in batch.column(1)), np.uint64, len(batch)).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(prints)], names=["doc_id", "fp"])


def golay_keys(prints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of unsigned fingerprints and, for each, the place of its fingerprint."""
    table, keys, owners = golay_index(), [], []
    part = [(prints >> np.uint64(a)).astype(np.int64) & ((1 << n) - 1) for a, n in SEGMENTS]
    for i in range(3):
        j = (i + 1) % 3
        flips = np.concatenate([[0], 1 << np.arange(SEGMENTS[j][1])])
        near = np.sort(table[part[j][:, None] ^ flips], axis=1).astype(np.int64)
        fresh = np.ones(near.shape, bool)
        fresh[:, 1:] = near[:, 1:] != near[:, :-1]
        who, which = np.nonzero(fresh)
        keys.append(i << 34 | part[i][who] << 12 | near[who, which])
        owners.append(who)
    return np.concatenate(keys), np.concatenate(owners)


def _golay_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        prints = batch.column(0).to_numpy(zero_copy_only=False)
        for at in range(0, len(prints), 4096):
            own = prints[at : at + 4096]
            keys, owners = golay_keys(own.view(np.uint64))
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(own[owners])], names=["key", "fp"])


def links(prints: DataFrame) -> DataFrame:
    """Edges (u, v) between distinct fingerprints (column fp): their components are those of all links of at most two bits."""
    keys = stored(prints.mapInArrow(_golay_rows, "key long, fp long"), "golay-keys")
    sizes = keys.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    shared = stored(keys.join(sizes, "key"), "golay-shared")
    few = shared.where(F.col("n") <= BUCKET).select("key", "fp")
    pairs = few.select("key", F.col("fp").alias("u")).join(few.select("key", F.col("fp").alias("v")), "key")
    pairs = pairs.where("u < v").where(F.bit_count(F.col("u").bitwiseXOR(F.col("v"))) <= BITS).select("u", "v")
    many = shared.where(F.col("n") > BUCKET).select("fp").distinct()
    flips = F.array(F.lit(0).cast("long"), *(F.lit(1 << b if b < 63 else -(1 << 63)).cast("long") for b in range(64)))
    middles = many.select("fp", F.explode(F.transform(flips, lambda x: x.bitwiseXOR(F.col("fp")))).alias("middle"))
    heads = middles.groupBy("middle").agg(F.min("fp").alias("v"), F.count(F.lit(1)).alias("n")).where("n > 1").select("middle", "v")
    stars = middles.join(heads, "middle").where("fp <> v").select(F.col("fp").alias("u"), "v")
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row of ``docs`` with its fingerprint and component: id, fingerprint (hex), component_id.

    Fingerprints at most two bits apart are linked; component_id is the smallest id reachable.
    Null or empty texts have fingerprint zero and are linked like any other. Rows with a null id
    get the smallest non-null id of their component (null if there is none). Repeated rows stay.
    Other columns are left out, so none can clash.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), utf8(F.col(text_col)).alias("text"))
    rows = stored(rows.mapInArrow(_fingerprints, f"doc_id {docs.schema[id_col].dataType.simpleString()}, fp long"), "fingerprints")
    owners = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("held")), "distinct-fingerprints")
    found = stored(components(links(owners.select("fp"))), "components")
    heads = owners.join(found, owners.fp == found.node).groupBy("root").agg(F.min("first").alias("head"))
    named = found.join(heads, "root").select(F.col("node").alias("fp"), "head")
    named = stored(owners.join(named, "fp", "left").select("fp", F.coalesce("head", "first").alias("component_id"), "held"), "named-fingerprints")
    return join_held(rows, named, "fp").select(
        F.col("doc_id").alias(id_col), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id"
    )
