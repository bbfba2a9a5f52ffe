"""Prefix trie of conversations: mergeable partial tries, hash-keyed tree merges, bottom-up rollup.

A node is a sequence of turns that some conversation starts with. Its key is a polynomial hash of the
turns' digests modulo a Mersenne prime, ``key(d) = key(d - 1) * BASE + digest(d)``: 127 bits, and keys of stretches can be put together.
So a conversation of any length is walked by many tasks: turns are sorted by range, each partition hashes its
part, and what lies before a partition's first conversation is one number a partition. Texts are never shuffled.

* **Partial tries.** A partition has a contiguous range of conversations; it counts, for each node, the members, the
  smallest of them, and lists those that end there, in ascending order. The table goes out whenever it has
  ``NODES`` nodes, so its memory is bounded.
* **Merges.** Partial tables are summed by key, ``FAN`` neighbouring partitions at a time. End lists of
  partial tries are ascending and their ranges don't overlap, so a node's list is their concatenation; it is hashed as it streams by.
* **Rollup.** Nodes of one member have one leaf below them and save nothing. The others sum what is below them by
  doubling: after step k each node has the sum over the nodes less than 2^k below it and knows its
  ancestor 2^k above it. The number of steps is the logarithm of the depth, whatever the shape of the trie.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import join_held, stored

PRIME = (1 << 127) - 1
BASE = int.from_bytes(hashlib.sha256(b"prefix trie of conversations").digest()[:15], "big")
ROOT = bytes(16)
NODES, FAN = 100_000, 64
HEAD = 5  # turns that a rebuilt conversation can take from another: one less than MIXED
MIXED, GROUP = 6, 100


def _bytes(x: int) -> bytes:
    return x.to_bytes(16, "big")


def turns_of(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, t, cp, row): the digest of role and text, and the code points of the text. Null role or text is empty; a null conv_id is no conversation."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    digest = F.substring(F.unhex(F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)), 1, 16)
    rows = conversations.where(F.col("conv_id").isNotNull())
    return rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", digest.alias("t"), F.char_length(text).cast("long").alias("cp"), F.monotonically_increasing_id().alias("row"))


def _walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Number and hash the turns of each conversation, as far as this partition has them."""
    from pyspark import TaskContext

    part, conv, i, p = TaskContext.get().partitionId(), None, 0, 0
    for batch in batches:
        number, prefix = [], []
        for c, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if c != conv:
                conv, i, p = c, 0, 0
            i += 1
            p = (p * BASE + int.from_bytes(t, "big")) % PRIME
            number.append(i)
            prefix.append(_bytes(p))
        parts = pa.array([part] * len(batch), pa.int32())
        yield pa.RecordBatch.from_arrays([parts, batch.column(0), pa.array(number, pa.int64()), pa.array(prefix, pa.binary()), batch.column(1), batch.column(2)], names=["part", "conv_id", "i", "p", "t", "cp"])


def _whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Add what lies before the partition: ``before`` turns with hash ``prefix`` (null: none)."""
    for batch in batches:
        columns = list(batch.columns[:6])
        if batch.column(6).null_count < len(batch):
            number, hashed = [], []
            for i, p, n, q in zip(*(batch.column(k).to_pylist() for k in (2, 3, 6, 7)), strict=True):
                if n:
                    p = _bytes((int.from_bytes(q, "big") * pow(BASE, i, PRIME) + int.from_bytes(p, "big")) % PRIME)
                number.append(i + (n or 0))
                hashed.append(p)
            columns[2:4] = [pa.array(number, pa.int64()), pa.array(hashed, pa.binary())]
        yield pa.RecordBatch.from_arrays(columns, names=["part", "conv_id", "i", "p", "t", "cp"])


def walked(turns: DataFrame) -> DataFrame:
    """(part, conv_id, i, p, t, cp) of each turn: its place in its conversation from 1, and the hash of all turns up to it.

    Turns are ordered by ``turn`` (null first), ties by the digest of role and text. A conversation may lie in any number of partitions.
    """
    order = ["conv_id", F.col("turn").asc_nulls_first(), "t", "row"]
    parts = turns.repartitionByRange(*order).sortWithinPartitions(*order).select("conv_id", "t", "cp")
    rows = stored(parts.mapInArrow(_walk, "part int, conv_id long, i long, p binary, t binary, cp long"), "trie-turns")
    edges = rows.groupBy("part").agg(F.min("conv_id").alias("a"), F.max("conv_id").alias("b")).collect()  # one row a partition
    seen: dict[int, int] = {}
    for r in edges:
        for c in {r.a, r.b}:
            seen[c] = seen.get(c, 0) + 1
    split = [(c,) for c, n in seen.items() if n > 1]
    if not split:
        return rows
    spark = turns.sparkSession
    sums = rows.join(F.broadcast(spark.createDataFrame(split, "conv_id long")), "conv_id").groupBy("conv_id", "part")
    before, n, p, conv = [], 0, 0, None
    for r in sorted(sums.agg(F.max("i").alias("i"), F.max_by("p", "i").alias("p")).collect(), key=lambda r: (r.conv_id, r.part)):  # two rows a partition at most
        if r.conv_id != conv:
            conv, n, p = r.conv_id, 0, 0
        if n:
            before.append((r.part, conv, n, _bytes(p)))
        n, p = n + r.i, (p * pow(BASE, r.i, PRIME) + int.from_bytes(r.p, "big")) % PRIME
    offsets = spark.createDataFrame(before, "part int, conv_id long, before long, prefix binary")
    return rows.join(F.broadcast(offsets), ["part", "conv_id"], "left").select(*rows.columns, "before", "prefix").mapInArrow(_whole, rows.schema)


def mixed_heads(conv: Column) -> tuple[Column, Column]:
    """The conversation whose first turns a rebuilt conversation takes, and how many."""
    return conv - conv % GROUP, (F.crc32(conv.cast("string").cast("binary")) % MIXED).cast("int")


def segments(rows: DataFrame, rebuilt: bool) -> DataFrame:
    """(part, conv_id, info) for each partition that a conversation lies in.

    ``info``: whether it is the first of them, the conversation's length, h, the hash of its own first h turns, and the (hash, code points) of the turns that come in their place.
    """
    head = F.when(F.col("i") <= HEAD, F.struct("i", "p", "cp"))
    own = stored(rows.groupBy("part", "conv_id").agg(F.min("i").alias("low"), F.max("i").alias("high"), F.collect_list(head).alias("heads")), "trie-segments")
    convs = own.groupBy("conv_id").agg(F.max("high").alias("len"), F.sort_array(F.flatten(F.collect_list("heads"))).alias("heads"))
    base, h = mixed_heads(F.col("conv_id"))
    if rebuilt:
        bases = convs.where(F.col("conv_id") % GROUP == 0).select(F.col("conv_id").alias("base"), F.col("heads").alias("of_base"))
        convs = convs.withColumn("h", h).withColumn("base", base).join(bases, "base", "left")
        took = F.coalesce(F.slice("of_base", 1, F.col("h")), F.array().cast("array<struct<i:bigint,p:binary,cp:bigint>>"))
        skipped = F.when(F.col("h") > 0, F.try_element_at("heads", F.least(F.col("h"), F.size("heads"))).getField("p"))
    else:
        convs, took, skipped = convs.withColumn("h", F.lit(0)), F.array().cast("array<struct<i:bigint,p:binary,cp:bigint>>"), F.lit(None).cast("binary")
    told = convs.select("conv_id", F.col("len"), "h", skipped.alias("skipped"), took.alias("took"))
    return own.join(told, "conv_id").select("part", "conv_id", F.struct((F.col("low") == 1).alias("first"), "len", "h", "skipped", "took").alias("info"))


INFO = "struct<first:boolean,len:bigint,h:int,skipped:binary,took:array<struct<i:bigint,p:binary,cp:bigint>>>"
NAMES = ["part", "key", "parent", "depth", "cp", "conv_id", "n", "low", "ends"]
KIND = "part int, key binary, parent binary, depth long, cp long, conv_id long, n long, low long, ends string"


def _partial_tries(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part, conversation and place (0: what segments() says of it) as tables of nodes."""
    inverse = pow(BASE, -1, PRIME)
    nodes: dict[bytes, list] = {}
    part = info = None

    def member(key: bytes, parent: bytes | None, depth: int, cp: int, conv: int, end: bool) -> None:
        node = nodes.get(key)
        if node is None:
            node = nodes[key] = [parent, depth, cp, conv, 0, []]
        node[4] += 1
        if end:
            node[5].append(conv)

    def table() -> pa.RecordBatch:
        rows = [(part, k, *v[:5], v[5][0] if v[5] else None, ",".join(map(str, v[5])) if v[5] else None) for k, v in nodes.items()]
        nodes.clear()
        kinds = [pa.int32(), pa.binary(), pa.binary(), *[pa.int64()] * 5, pa.string()]
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=NAMES)

    for batch in batches:
        for its_part, conv, i, p, t, cp, told in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if nodes and (its_part != part or len(nodes) >= NODES and i == 0):
                yield table()
            part = its_part
            if i == 0:
                info, took = told, told["took"]
                h, b = info["h"], len(took)
                last = took[-1]["p"] if took else ROOT
                # own turns after the first h continue other turns than they did
                shift = (int.from_bytes(last, "big") - int.from_bytes(info["skipped"] or ROOT, "big")) % PRIME
                stays = info["len"] > h
                if info["first"]:
                    member(ROOT, None, 0, 0, conv, not took and not stays)
                    for k, turn in enumerate(took, 1):
                        member(turn["p"], took[k - 2]["p"] if k > 1 else ROOT, k, turn["cp"], conv, k == b and not stays)
                power = None
                continue
            # i > h: the first of them in this part needs a power, the next ones follow it
            power = power * BASE % PRIME if power is not None else pow(BASE, i - h, PRIME)
            own = int.from_bytes(p, "big")
            key = (own + shift * power) % PRIME
            parent = (key - int.from_bytes(t, "big")) * inverse % PRIME
            member(_bytes(key), _bytes(parent), b + i - h, cp, conv, i == info["len"])
            if len(nodes) >= NODES:
                yield table()
    if nodes:
        yield table()


def merged(partial: DataFrame, parts: int) -> DataFrame:
    """Sums of the partial tables by key: a tree of merges, FAN neighbours at a time."""
    same = [F.max(c).alias(c) for c in ("parent", "depth", "cp")]
    nodes = partial.select("part", "key", "parent", "depth", "cp", "conv_id", "n")
    while parts > 1:
        parts = -(-parts // FAN)
        keys = ["key", "part"] if parts > 1 else ["key"]
        nodes = nodes.withColumn("part", F.floor(F.col("part") / FAN).cast("int")).groupBy(*keys).agg(*same, F.min("conv_id").alias("conv_id"), F.sum("n").alias("n"))
    return nodes.select("key", "parent", "depth", "cp", "conv_id", "n")


def _end_digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 of the concatenated lists of each key; rows sorted by key and first member."""
    key, digest = None, None
    for batch in batches:
        keys, out = [], []
        for k, ends in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            if k != key:
                if digest is not None:
                    keys.append(key)
                    out.append(digest.hexdigest())
                key, digest = k, hashlib.sha256(ends.encode())
            else:
                digest.update(b"," + ends.encode())
        yield pa.RecordBatch.from_arrays([pa.array(keys, pa.binary()), pa.array(out, pa.string())], names=["key", "ends_sha256"])
    if digest is not None:
        yield pa.RecordBatch.from_arrays([pa.array([key], pa.binary()), pa.array([digest.hexdigest()], pa.string())], names=["key", "ends_sha256"])


def rolled_up(shared: DataFrame) -> DataFrame:
    """(key, x, y): sums of x and y over each node's subtree, of (key, up, depth, x, y), ``up`` the parent; by doubling."""
    deepest = shared.agg(F.max("depth")).first()[0] or 0
    nodes, reach = shared, 1
    while reach <= deepest:
        below = nodes.where(F.col("depth") >= reach).groupBy(F.col("up").alias("key")).agg(F.sum("x").alias("more_x"), F.sum("y").alias("more_y"))
        far = nodes.select(F.col("key").alias("up"), F.col("up").alias("next"))
        near = nodes.where(F.col("depth") <= 2 * reach).withColumn("next", F.when(F.col("depth") == 2 * reach, F.lit(ROOT)))
        nodes = near.unionByName(nodes.where(F.col("depth") > 2 * reach).join(far, "up")).join(below, "key", "left")
        nodes = nodes.select("key", F.col("next").alias("up"), "depth", *((F.col(c) + F.coalesce(F.col(f"more_{c}"), F.lit(0))).alias(c) for c in ("x", "y")))
        nodes, reach = stored(nodes, "trie-rollup"), 2 * reach
    return nodes.select("key", "x", "y")


def prefix_trie(conversations: DataFrame, rebuilt: bool = False) -> DataFrame:
    """One row per node of the trie of all conversations (columns conv_id, turn, role, text).

    conv_id: the smallest member; depth; parent_conv_id (null at the root); n_convs: members; n_children; n_leaves: childless nodes
    in the subtree, itself included; saved_tokens: over the subtree, code points of the last text times members less one; ends_sha256: of the
    ascending decimal ids, joined by commas, of the members that end there. ``rebuilt``: a conversation's first turns come from that of the next lower multiple of GROUP, see ``mixed_heads``.

    Null turns come first; turns with equal numbers are ordered by the digest of role and text; repeated rows are turns like any other. Null roles and texts are
    empty. Rows with a null conv_id are left out. Negative ids count up to their next multiple of GROUP towards zero. Other columns are left out; an empty table has no node.
    """
    turns = stored(turns_of(conversations), "trie-digests")
    rows = walked(turns)
    marks = stored(segments(rows, rebuilt), "trie-marks")
    parts = (marks.agg(F.max("part")).first()[0] or 0) + 1
    h = mixed_heads(F.col("conv_id"))[1] if rebuilt else F.lit(0)
    own = rows.where(F.col("i") > h).select("part", "conv_id", "i", "p", "t", "cp", F.lit(None).cast(INFO).alias("info"))
    nothing = F.lit(None).cast("binary")
    both = own.union(marks.select("part", "conv_id", F.lit(0).cast("long"), nothing, nothing, F.lit(0).cast("long"), "info"))
    sorted_rows = both.repartition("part").sortWithinPartitions("part", "conv_id", "i")
    partial = stored(sorted_rows.mapInArrow(_partial_tries, KIND), "trie-partial")

    nodes = stored(merged(partial, max(parts, 2)), "trie-nodes")
    ends = partial.where("ends IS NOT NULL").select("key", "low", "ends").repartition("key").sortWithinPartitions("key", "low").select("key", "ends")
    digests = ends.mapInArrow(_end_digests, "key binary, ends_sha256 string")
    alone = F.sum(F.when(F.col("n") == 1, 1).otherwise(0)).alias("alone")
    children = nodes.where("depth > 0").groupBy(F.col("parent").alias("key")).agg(F.count(F.lit(1)).alias("n_children"), alone)
    nodes = stored(nodes.join(children, "key", "left").join(digests, "key", "left").na.fill(0, ["n_children", "alone"]), "trie-joined")

    leaf = F.when(F.col("n_children") == 0, 1).otherwise(F.col("alone")).cast("long")
    shared = nodes.where("n > 1").select("key", F.col("parent").alias("up"), "depth", ((F.col("n") - 1) * F.col("cp")).alias("x"), leaf.alias("y"))
    total = rolled_up(stored(shared, "trie-shared"))
    parents = nodes.where("n_children > 0").select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"), F.col("n_children").alias("held"))
    lower = join_held(nodes.where("depth > 0"), parents, "parent")
    out = lower.unionByName(nodes.where("depth = 0").withColumn("parent_conv_id", F.lit(None).cast("long"))).join(total, "key", "left")
    return out.select(
        "conv_id", "depth", "parent_conv_id", F.col("n").alias("n_convs"), "n_children", F.coalesce("y", F.lit(1)).cast("long").alias("n_leaves"),
        F.coalesce("x", F.lit(0)).cast("long").alias("saved_tokens"), F.coalesce("ends_sha256", F.lit(hashlib.sha256().hexdigest())).alias("ends_sha256"),
    )
