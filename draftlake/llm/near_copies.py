"""Near copies: SimHash near-dedup (see ``simhash``) at five words and a Jaccard similarity of 0.8 or more.

Texts of a similarity of 0.8 differ in about 15 of 100 bits of a SimHash fingerprint, more than keys made
for two bits can bear. So here a fingerprint has ``PARTS`` segments of 23 signed sums (the bits before their
signs are taken), and each segment is decoded softly with the Golay code: to the codeword that
agrees most with the sums, not with the signs alone. The pigeonhole: of the segments of two such texts
at least two have their codeword in common, but for few pairs (measured, see README). The keys of a text
are therefore the pairs of segments, with the codeword of each, and ``EXTRA`` further sign bits, other ones for each
pair, so that unlike texts share few keys.

All texts of a key of at most ``BUCKET`` texts are paired up. The texts of a larger key are compared with two
heads of it instead (the text nearest to the bitwise majority of all its fingerprints, and the least), so
that any key costs at most two rows a text, whatever the size of a group. Every candidate is verified by the
exact similarity of the two sets of shingles in a join, in two rounds.

The first round takes eight keys a text, of each text the pairs of its small keys and the heads of its largest one: it finds
the large groups. The second takes all keys, where a group of over ``BIG`` texts counts as one: a task sends on one
text of it a key, and what meets that text is compared with the heads of the whole group as well. Texts of one group
are not compared again.

What the heads leave over is compared in full: every two texts of a key that are not in one group after two rounds, and
every text with all texts of a large group that it met. So the heads only save comparisons within groups, and lose none.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import cache
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import free_name, join_held, stored, utf8
from draftlake.llm.components import components
from draftlake.llm.golay import BITS, codewords

WORDS, SEED = 5, 42
PART, WHOLE = 4, 5  # the least similarity, as a fraction
SKETCH, SPREAD = 1024, 4  # places of a sketch, places that a shingle has there
PARTS, EXTRA = 20, 2
FAR = 24  # of 64 bits; at the least similarity 10 differ on average, with a deviation of 3
BUCKET, SALT = 4, 4096
BIG = 64
PART_ROWS = 1_000_000
PAIRS = np.array(list(combinations(range(PARTS), 2)))
FIRST = np.array([i for i, (a, b) in enumerate(PAIRS) if a % 2 == 0 and b == a + 1 and a < 16])  # eight pairs without a segment in common


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Ascending distinct hashes of a UTF-8 text's shingles; a shorter text is one shingle."""
    tokens = text.lower().split()  # of bytes: A-Z and ASCII white space only
    if not tokens:
        return np.empty(0, np.int64)
    hashes = np.array([xxhash.xxh64_intdigest(t, SEED) for t in tokens], np.uint64)
    words = min(words, len(tokens))
    mixed = np.full(len(tokens) - words + 1, words, np.uint64)
    for i in range(words):
        mixed = (mixed + hashes[i : len(tokens) - words + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(31)
    return np.unique(mixed.view(np.int64))


@cache
def _planes() -> tuple[np.ndarray, np.ndarray]:
    """Random hyperplanes over a sketch, with small integers as weights (64 of them for single bits), and half of the Golay code as +1 and -1.

    The code holds the complement of each of its words: the sign of an agreement tells which of both it is.
    """
    planes = np.rint(8 * np.random.default_rng(SEED).standard_normal((SKETCH, PARTS * BITS + 64)))
    half = codewords()[:2048]
    return planes.astype(np.float32), ((half >> np.arange(BITS)[:, None] & 1) * 2 - 1).astype(np.float32)


def sums(sets: list[np.ndarray]) -> np.ndarray:
    """Signed sums of each set's shingles: one row a set. Their signs are the bits of its SimHash fingerprint."""
    hashes = np.concatenate(sets).view(np.uint64) if sets else np.empty(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets]) * SKETCH
    sketch = np.zeros(len(sets) * SKETCH)
    for i in range(SPREAD):
        part = (hashes >> np.uint64(16 * i)).astype(np.int64)
        sketch += np.bincount(owner + (part & SKETCH - 1), 1 - (part >> 14 & 2), len(sketch))
    return sketch.astype(np.float32).reshape(len(sets), SKETCH) @ _planes()[0]


def soft_codes(found: np.ndarray) -> np.ndarray:
    """Index of the codeword nearest to each segment of signed sums: (sets, PARTS)."""
    out = np.empty((len(found), PARTS), np.int16)
    for at in range(0, len(found), 64):
        block = np.ascontiguousarray(found[at : at + 64, : PARTS * BITS]).reshape(-1, BITS)
        agree = block @ _planes()[1]
        best = np.abs(agree).argmax(axis=1)
        out[at : at + 64] = (best << 1 | (agree[np.arange(len(block)), best] < 0)).reshape(-1, PARTS)
    return out


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            sets = [shingles(x.as_py()) for x in part.column(1)]
            node = pa.array([xxhash.xxh64_intdigest(s.tobytes(), SEED) for s in sets], pa.uint64()).view(pa.int64())
            sizes = pa.array([len(s) for s in sets], pa.int32())
            found = sums(sets)
            bits = np.packbits(found[:, -64:] > 0, axis=1, bitorder="little").view(np.int64).ravel()
            codes = pa.ListArray.from_arrays(np.arange(0, (len(sets) + 1) * PARTS, PARTS, dtype=np.int32), soft_codes(found).ravel())
            yield pa.RecordBatch.from_arrays([part.column(0), node, sizes, pa.array(bits), codes], names=["row", "node", "n", "bits", "codes"])


def _key_rows(which: np.ndarray):
    """(key, unit, node) of the pairs of segments ``which``: a key is the pair's number, both codewords, and the sign bits that are its own. Of the texts of one unit in a batch the least stands for all."""
    pairs = PAIRS[which]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes = batch.column(3).flatten().to_numpy().astype(np.int64).reshape(-1, PARTS)
            bits = batch.column(2).to_numpy()[:, None]
            keys = which << 24 | codes[:, pairs[:, 0]] << 12 | codes[:, pairs[:, 1]]
            for e in range(EXTRA):
                keys = keys << 1 | bits >> (which * EXTRA + e) % 64 & 1
            keys = keys.ravel()
            nodes, units = (np.repeat(batch.column(k).to_numpy(), len(which)) for k in (0, 1))
            _, place, count = np.unique(units, return_inverse=True, return_counts=True)
            several = count[place] > len(which)
            if several.any():
                many = np.flatnonzero(several)
                many = many[np.lexsort((nodes[many], units[many], keys[many]))]
                fresh = np.ones(len(many), bool)
                fresh[1:] = (keys[many][1:] != keys[many][:-1]) | (units[many][1:] != units[many][:-1])
                keep = np.concatenate([np.flatnonzero(~several), many[fresh]])
                keys, units, nodes = keys[keep], units[keep], nodes[keep]
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(units), pa.array(nodes)], names=["key", "unit", "node"])

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        sets = pa.array([shingles(x.as_py()) for x in batch.column(1)], pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([batch.column(0), sets], names=["node", "hashes"])


PAIR = ("node", "n", "bits", "root", "node2", "n2", "bits2", "root2")


def _apart(a: str, b: str) -> F.Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b)))


def _salted(many: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of keys (columns key, node, n, bits, root, texts) with a salt, and the salts of each key with the majority of all its bits."""
    ones = [F.sum(F.shiftright("bits", b).bitwiseAND(F.lit(1).cast("long"))).alias(f"b{b}") for b in range(64)]
    counted = many.groupBy("key").agg(F.count(F.lit(1)).alias("members"), F.max("texts").alias("texts"), *ones)
    bits = [F.when(F.col(f"b{b}") * 2 > F.col("members"), F.lit(1 << b if b < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long")) for b in range(64)]
    while len(bits) > 1:
        bits = [x.bitwiseOR(y) for x, y in zip(bits[::2], bits[1::2], strict=True)]
    whole = counted.select("key", (F.col("texts") / SALT).cast("int").alias("parts"), bits[0].alias("whole"))
    rows = many.withColumn("salt", F.pmod(F.xxhash64("node"), (F.col("texts") / SALT).cast("int") + 1).cast("int"))
    return rows, whole.withColumn("salt", F.explode(F.sequence(F.lit(0), "parts")))


def _heads(rows: DataFrame, salted: DataFrame) -> DataFrame:
    """(key, head, n2, bits2, root2): two heads of each key, that nearest to the majority of all bits, and the least."""
    own = ("node", "n", "bits", "root")
    near = rows.join(salted, ["key", "salt"]).groupBy("key").agg(F.min(F.struct(_apart("bits", "whole"), *own)).alias("a"), F.min(F.struct(*own)).alias("b"))
    heads = near.select("key", F.explode(F.array_distinct(F.array(F.struct(*(f"a.{c}" for c in own)), F.col("b")))).alias("h"))
    return heads.select("key", F.col("h.node").alias("node2"), *(F.col(f"h.{c}").alias(f"{c}2") for c in own[1:]))


def majority_heads(many: DataFrame) -> DataFrame:
    """The texts of each key (columns key, node, n, bits, root, texts) with two heads of it, if they are of different roots."""
    rows, salted = _salted(many)
    heads = _heads(rows, salted).join(salted.select("key", "salt"), "key").withColumnRenamed("key", "key2").withColumnRenamed("salt", "salt2")
    stars = rows.join(heads, (F.col("key") == F.col("key2")) & (F.col("salt") == F.col("salt2")) & (F.col("root") != F.col("root2")))
    return stars.select(*PAIR)


def _plausible(near: DataFrame) -> DataFrame:
    return near.where((F.least("n", "n2") * WHOLE >= F.greatest("n", "n2") * PART) & (_apart("bits", "bits2") <= FAR))


def _ordered(near: DataFrame) -> DataFrame:
    """Distinct pairs u < v with their sizes."""
    flipped = F.col("node") > F.col("node2")
    return near.select(
        F.least("node", "node2").alias("u"), F.greatest("node", "node2").alias("v"),
        F.when(flipped, F.col("n2")).otherwise(F.col("n")).alias("nu"), F.when(flipped, F.col("n")).otherwise(F.col("n2")).alias("nv"),
    ).distinct()


def _paired(few: DataFrame) -> DataFrame:
    """The pairs of different roots of small keys."""
    other = few.select(F.col("key").alias("key2"), *(F.col(c).alias(f"{c}2") for c in ("node", "n", "bits", "root")))
    return few.join(other, (F.col("key") == F.col("key2")) & (F.col("node") < F.col("node2")) & (F.col("root") != F.col("root2"))).select(*PAIR)


def first_candidates(nodes: DataFrame) -> DataFrame:
    """Pairs u < v of the small keys among the first eight, and of each text with the heads of its largest key, that may be similar enough.

    ``nodes``: distinct sets (node, n, bits, codes).
    """
    keys = nodes.select("node", F.col("node").alias("unit"), "bits", "codes").mapInArrow(_key_rows(FIRST), "key long, unit long, node long")
    keys = stored(keys.drop("unit"), "copy-keys")
    sizes = stored(keys.groupBy("key").agg(F.count(F.lit(1)).alias("texts")).where("texts > 1"), "copy-sizes")
    shared = stored(keys.join(sizes, "key").join(nodes.select("node", "n", "bits"), "node").withColumn("root", F.col("node")), "copy-shared")
    pairs = _paired(shared.where(F.col("texts") <= BUCKET))
    top = shared.where(F.col("texts") > BUCKET).groupBy("node").agg(F.max(F.struct("texts", "key", "n", "bits", "root")).alias("t")).select("node", "t.*")
    return _ordered(_plausible(pairs.union(majority_heads(top))))


def more_candidates(nodes: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Pairs u < v of different groups that may be similar enough: of small keys, with the heads of larger ones, and with those of the large groups met.

    Also the texts with their groups, and the shared keys of all (for ``rest_candidates``).
    """
    rooted = nodes.select("node", "n", "bits", "codes").join(groups, "node", "left").withColumn("root", F.coalesce("root", "node"))
    held = groups.groupBy("root").agg(F.count(F.lit(1)).alias("held")).where(F.col("held") > BIG)
    rooted = rooted.join(held, "root", "left").withColumn("unit", F.when(F.col("held").isNull(), F.col("node")).otherwise(F.col("root")))
    rooted = stored(rooted.select("node", "unit", "root", "held", "n", "bits", "codes"), "copy-rooted")
    # dealt by key once, in parts that a task sorts in little memory
    usual = int(nodes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    keys = rooted.select("node", "unit", "bits", "codes").mapInArrow(_key_rows(np.arange(len(PAIRS))), "key long, unit long, node long")
    keys = keys.repartition(max(usual, rooted.count() * len(PAIRS) // PART_ROWS + 1), "key").groupBy("key", "unit").agg(F.min("node").alias("node"))
    keys = stored(keys.withColumn("texts", F.count(F.lit(1)).over(Window.partitionBy("key"))).where("texts > 1").drop("unit"), "copy-keys")
    shared = stored(keys.join(rooted.select("node", "n", "bits", "root", "held"), "node"), "copy-shared")
    own = Window.partitionBy("key")
    many = shared.where(F.col("texts") > BUCKET).withColumn("mixed", F.min("root").over(own) != F.max("root").over(own)).where("mixed").drop("mixed")
    near = stored(_paired(shared.where(F.col("texts") <= BUCKET)).union(majority_heads(many)), "copy-met")

    large = rooted.where("held IS NOT NULL").select(F.col("root").alias("key"), "node", "n", "bits", "root", F.col("held").alias("texts"))
    heads = stored(_heads(*_salted(large)).drop("key"), "copy-heads")
    both = near.union(near.select(*PAIR[len(PAIR) // 2 :], *PAIR[: len(PAIR) // 2]))
    met = both.select("node", "n", "bits", "root", "root2").distinct().join(heads, "root2").select(*PAIR)
    return _ordered(_plausible(near.union(met))), rooted, shared


def rest_candidates(rooted: DataFrame, shared: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs u < v that may be similar enough and that ``groups`` still holds apart: all of each key of over ``BUCKET`` texts, and all texts of the large groups met.

    A task compares at most SALT texts at a time with those dealt to it. Of each key the texts of its commonest group are on one side only: they are not compared with each other.
    """
    now = groups.select("node", F.col("root").alias("now"))
    placed = lambda df: stored(df.join(now, "node", "left").withColumn("root", F.coalesce("now", "node")).drop("now"), "copy-placed")
    keyed = placed(shared.withColumn("unit", F.when(F.col("held").isNull(), F.col("node")).otherwise(F.col("root"))))
    sizes = keyed.groupBy("key", "root").agg(F.count(F.lit(1)).alias("own"))
    mixed = sizes.groupBy("key").agg(F.max(F.struct("own", "root")).alias("most"), F.sum("own").alias("all"), F.count(F.lit(1)).alias("roots")).where("roots > 1")
    parts = lambda c: (F.floor((c - 1) / SALT) + 1).cast("int")
    mixed = stored(mixed.select("key", F.col("most.root").alias("main"), parts(F.col("all") - F.col("most.own")).alias("rows"), parts(F.col("all")).alias("columns")), "copy-mixed")
    own = ("node", "n", "bits", "root", "unit", "held")
    both = stored(keyed.join(mixed, "key"), "copy-keyed")
    dealt = lambda c: F.pmod(F.xxhash64("node"), F.col(c)).cast("int")
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    few = both.where("root <> main").select("key", "main", "texts", *own, dealt("rows").alias("a"), every("columns").alias("b"))
    all_ = both.select(F.col("key").alias("key2"), *(F.col(c).alias(f"{c}2") for c in own), dealt("columns").alias("b2"), every("rows").alias("a2"))
    near = (F.least("n", "n2") * WHOLE >= F.greatest("n", "n2") * PART) & (_apart("bits", "bits2") <= FAR) & (F.col("texts") > BUCKET)
    large = F.col("held").isNotNull() | F.col("held2").isNotNull()
    once = (F.col("root2") == F.col("main")) | (F.col("node") < F.col("node2"))
    same = (F.col("key") == F.col("key2")) & (F.col("a") == F.col("a2")) & (F.col("b") == F.col("b2"))
    met = stored(few.join(all_, same & once & (F.col("root") != F.col("root2")) & (near | large)).select(*own, *(f"{c}2" for c in own)), "copy-met")

    # each text that met a large group, or the texts of a smaller one, with all texts of the group
    texts = placed(rooted.select(*own))
    sides = [F.struct(F.coalesce(f"held{i}", F.lit(1).cast("long")).alias("texts"), F.col(f"unit{i}").alias("unit")) for i in ("", "2")]
    units = met.where(large).select(F.least(*sides).alias("x"), F.greatest(*sides).alias("y")).distinct()
    units = units.select(F.col("x.unit").alias("unit"), F.col("y.unit").alias("group"), F.explode(F.sequence(F.lit(0), parts(F.col("y.texts")) - 1)).alias("b"))
    left = texts.select("node", "n", "bits", "root", "unit").join(units, "unit").drop("unit")
    members = texts.where("held IS NOT NULL").select(*(F.col(c).alias(f"{c}2") for c in ("node", "n", "bits", "root", "unit")), F.pmod(F.xxhash64("node"), parts(F.col("held"))).cast("int").alias("b2"))
    inside = left.join(members, (F.col("group") == F.col("unit2")) & (F.col("b") == F.col("b2")) & (F.col("root") != F.col("root2")))
    return _ordered(_plausible(met.where(~large).select(*PAIR).union(inside.select(*PAIR))))


def similar(found: DataFrame, sets: DataFrame) -> DataFrame:
    """The candidates (u, v) that are similar enough, by their sets (columns node, hashes)."""
    both = found.join(sets.select(F.col("node").alias("u"), F.col("hashes").alias("a")), "u").join(sets.select(F.col("node").alias("v"), F.col("hashes").alias("b")), "v")
    both = both.select("u", "v", "nu", "nv", F.size(F.array_intersect("a", "b")).alias("common"))
    return both.where(F.col("common") * WHOLE >= (F.col("nu") + F.col("nv") - F.col("common")) * PART).select("u", "v")


def _ends(found: DataFrame) -> DataFrame:
    return found.select(F.col("u").alias("node")).union(found.select("v")).distinct()


def groups_of(nodes: DataFrame, sets_of: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(node, root) of the groups that the similar ones of the candidates make, in two rounds and one over what they leave."""
    first = stored(first_candidates(nodes), "copy-first")
    sure = stored(similar(first, sets_of(_ends(first))), "copy-links")
    groups = stored(components(sure), "copy-groups")
    found, rooted, shared = more_candidates(nodes, groups)
    left = stored(found.join(first, ["u", "v"], "left_anti"), "copy-left")
    more = stored(similar(left, sets_of(_ends(left))), "copy-links")
    groups = stored(components(sure.union(more)), "copy-groups")
    rest = rest_candidates(rooted, shared, groups).join(first.select("u", "v").union(left.select("u", "v")), ["u", "v"], "left_anti")
    rest = stored(rest, "copy-rest")
    last = stored(similar(rest, sets_of(_ends(rest))), "copy-links")
    return groups if last.isEmpty() else stored(components(sure.union(more).union(last)), "copy-groups")


def first_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row of ``docs`` of each group of near copies: that of the smallest id.

    Rows have a key of their own here, so that those with a null or a repeated id are rows like any
    other: a null id comes after all others of its group, and of rows with equal ids any one stays.
    Texts without words (null, empty or white space) are copies of each other. All other columns stay as they are.
    """
    own = free_name(docs, "row")
    rows = stored(docs.withColumn(own, F.monotonically_increasing_id()), "copy-rows")
    signed = rows.select(F.col(own).alias("row"), utf8(F.col(text_col)).alias("text"))
    signed = stored(signed.mapInArrow(_signed, "row long, node long, n int, bits long, codes array<short>"), "copy-sets")
    texts = signed.groupBy("node").agg(F.min(F.struct("row", "n", "bits", "codes")).alias("t"), F.count(F.lit(1)).alias("held"))
    texts = stored(texts.select("node", "t.*", "held"), "copy-texts")

    def sets_of(nodes: DataFrame) -> DataFrame:
        wanted = texts.join(nodes, "node").select("node", F.col("row").alias(own))
        sets = rows.select(own, utf8(F.col(text_col)).alias("text")).join(wanted, own).select("node", "text")
        return stored(sets.mapInArrow(_sets, "node long, hashes array<long>"), "copy-hashes")

    groups = groups_of(texts, sets_of)
    names = texts.join(groups, "node", "left").select("node", F.coalesce("root", "node").alias("root"), "held")
    named = join_held(signed.select("row", "node"), stored(names, "copy-names"), "node")
    named = rows.select(F.col(own).alias("row"), F.col(id_col).alias("id")).join(named, "row")
    heads = named.groupBy("root").agg(F.min(F.struct(F.col("id").isNull().alias("none"), "id", "row")).alias("head"))
    return rows.join(heads.select(F.col("head.row").alias(own)), own, "left_semi").drop(own)
