"""Mixture-controlled packing: deficit round-robin over source queues, in closed form.

Each source is a queue of tokens (its documents one after another). Every window of ``length`` tokens
gives each queue its quantum, target share x window, and what a queue could not take in whole tokens
stays its deficit for the next window. As quanta are constant while the same queues are active, the
tokens that queue s has sent after x tokens of output are

    floor(x * (p_1 + .. + p_s)) - floor(x * (p_1 + .. + p_{s-1})),

so that a window is always full, a deficit is always below one token, and any task can tell where any
document's tokens go without a sequential pass: deficits are carried across windows and partitions by
arithmetic. When a queue runs dry the rest go on in the same proportions (a new phase).

A source whose quantum is under ``MIN_QUANTUM`` tokens a window would be cut into very short pieces. Such
sources share one queue, and take turns in it by the same rule with a window ``MIN_QUANTUM`` times as long,
where those that are still too small share one queue again, and so on (``levels``). So every source goes
out in its proportions, the smaller in the longer turns, in pieces of about ``MIN_QUANTUM`` tokens or more, and the driver
knows at most ``MIN_QUANTUM`` sources a level, with a level for each factor ``MIN_QUANTUM`` of the number of windows.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import defaultdict
from collections.abc import Iterator
from fractions import Fraction
from functools import cache

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from draftlake.llm.common import stored

LENGTH, END, MIN_QUANTUM = 4096, 2, 64
MEMO, MEMO_CHARS = 600_000, 32  # words that a Python worker remembers, and their greatest length


@cache
def _tokenizer(path: str):
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


#: The tokenizer's own split of lower-cased text, for ASCII.
_PARTS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^\sa-z0-9]+")


@cache
def _splits_ascii(path: str) -> bool:
    """Does this tokenizer lower-case, split and merge ASCII words as ``_PARTS`` and its bare model do?"""
    tokenizer, probe = _tokenizer(path), "It's 20x Don't...WE'LL (ab)c-d"
    parts = [t.id for w in probe.split() for p in _PARTS.findall(w.lower()) for t in tokenizer.model.tokenize(p)]
    return parts == tokenizer.encode(probe, add_special_tokens=False).ids


@cache
def _drops_space(path: str) -> bool:
    """Does this tokenizer encode a text as the words between its white space, one by one?"""
    tokenizer, probes = _tokenizer(path), ("Hello big  world\n\nagain", " a\tb \r\n c", "It's  20x\n  (Don't)", "Ünï\u00a0cöde \u3000日本 x", "\x0b.\x0c, a ")
    whole = lambda text: tokenizer.encode(text, add_special_tokens=False).ids
    return all(whole(p) == [i for w in p.split() for i in whole(w)] for p in probes)


class Words(dict):
    """Ids of words, each found when it is first asked for; long words are not remembered."""

    def __init__(self, path: str):
        self.tokenizer, self.ascii_parts, self.parts = _tokenizer(path), _splits_ascii(path), {}

    def __missing__(self, word: str) -> bytes:
        short = len(word) <= MEMO_CHARS
        if short and self.ascii_parts and word.isascii() and word.isprintable() and "<|" not in word:
            ids = b"".join([self.parts.get(p) or self.part(p) for p in _PARTS.findall(word.lower())])
        else:
            ids = np.array(self.tokenizer.encode_batch_fast([word], add_special_tokens=False)[0].ids, "<u4").tobytes()
        if short:
            self[word] = ids
        return ids

    def part(self, part: str) -> bytes:
        ids = self.parts[part] = b"".join([t.id.to_bytes(4, "little") for t in self.tokenizer.model.tokenize(part)])
        return ids


@cache
def _words(path: str) -> Words:
    return Words(path)


def encode(texts: list[str], path: str) -> list[bytes]:
    """Ids of each text, little-endian 32 bits, without special tokens.

    If the tokenizer drops white space and no token spans it, ids are those of the words between
    white space, of which a worker remembers the frequent short ones. Control characters 1C-1F are
    white space to Python but not to the tokenizer; such texts are encoded whole. With any other
    tokenizer all texts are.
    """
    if not _drops_space(path):
        return [np.array(x.ids, "<u4").tobytes() for x in _tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)]
    words = _words(path)
    if len(words) > MEMO:
        words.clear()
        words.parts.clear()
    return [b"".join(map(words.__getitem__, [t] if any(c in t for c in "\x1c\x1d\x1e\x1f") else t.split())) for t in texts]


def _slices(batch: pa.RecordBatch, chars: int = 4_000_000) -> Iterator[tuple[int, int]]:
    """Bounds of slices of a batch whose texts have about so many bytes."""
    start = size = 0
    for i, n in enumerate(batch.column("bytes").to_pylist()):
        size += n
        if size >= chars:
            yield start, i + 1
            start, size = i + 1, 0
    if start < len(batch):
        yield start, len(batch)


def tokenised(docs: DataFrame, tokenizer: str, end: int, id_col: str, text_col: str, source_col: str) -> DataFrame:
    """(part, source, doc_id, before, n, ids): before counts the tokens of its source earlier in its part."""
    wide = _tokenizer(tokenizer).get_vocab_size() > 1 << 16
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, sent = TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for a, b in _slices(batch):
                piece = batch.slice(a, b - a)
                tail = np.array([end], "<u4").tobytes()
                ids = [x + tail for x in encode(piece.column("text").to_pylist(), tokenizer)]
                sources, before = piece.column("source").to_pylist(), []
                for s, x in zip(sources, ids, strict=True):
                    before.append(sent[s])
                    sent[s] += len(x) // 4
                counts = [len(x) // 4 for x in ids]
                if not wide:
                    ids = [np.frombuffer(x, "<u4").astype("<u2").tobytes() for x in ids]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([part] * len(ids), pa.int32()), piece.column("source"), piece.column("doc_id"), pa.array(before, pa.int64()), pa.array(counts, pa.int64()), pa.array(ids, pa.binary())],
                    names=["part", "source", "doc_id", "before", "n", "ids"],
                )

    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.coalesce(F.col(source_col).cast("string"), F.lit("")).alias("source"), F.coalesce(F.col(text_col), F.lit("")).alias("text")
    ).withColumn("bytes", F.octet_length("text"))
    return rows.mapInArrow(run, f"part int, source string, doc_id {kind}, before long, n long, ids binary")


class Phase:
    """A stretch of output with the same active queues: what each sends in all, and from where."""

    def __init__(self, base: int, starts: dict[int, int], sends: dict[int, int]):
        self.base, self.starts, self.sends = base, starts, sends
        self.total, self.upto, run = sum(sends.values()), {}, 0
        for q in sorted(sends):
            self.upto[q] = (run, run := run + sends[q])

    def below(self, q: int, x: int) -> int:
        """Tokens that the queues before q have sent after x tokens of the phase."""
        return x * self.upto[q][0] // self.total

    def sent(self, q: int, x: int) -> int:
        a, b = self.upto[q]
        return x * b // self.total - x * a // self.total


def phases(totals: dict[int, int], shares: dict[int, Fraction]) -> list[Phase]:
    """Round-robin in the given shares until all queues are dry."""
    left, sent, base, out = {q: n for q, n in totals.items() if n}, dict.fromkeys(totals, 0), 0, []
    while left:
        rounds = min(left[q] / shares[q] for q in left)
        send = {q: min(left[q], max(1, int(shares[q] * rounds))) for q in left}
        out.append(Phase(base, {q: sent[q] for q in send}, send))
        base += sum(send.values())
        for q, n in send.items():
            sent[q] += n
            left[q] -= n
        left = {q: n for q, n in left.items() if n}
    return out


class Level:
    """Queues that fill windows of ``length`` tokens; those of the sources too small for it share the queue ``rest``."""

    def __init__(self, length: int, names: list[str], totals: dict[int, int], shares: dict[int, Fraction], rest: int | None):
        self.length, self.names, self.rest = length, names, rest
        self.plan = phases(totals, shares)
        self.phases = {q: [p for p in self.plan if q in p.sends] for q in totals}
        self.starts = {q: [p.starts[q] for p in own] for q, own in self.phases.items()}

    def cuts(self, q: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
        """Where n tokens of queue q from ``start`` go: (tokens before, tokens, window, offset), in order."""
        done, length = 0, self.length
        while done < n:
            phase = self.phases[q][bisect_right(self.starts[q], start + done) - 1]
            at = start + done - phase.starts[q]
            window = (phase.base + at * phase.total // phase.sends[q]) // length
            clip = lambda w: min(max(w * length - phase.base, 0), phase.total)  # noqa: B023, E731
            while phase.sent(q, clip(window)) > at:
                window -= 1
            while phase.sent(q, clip(window + 1)) <= at:
                window += 1
            end = min(n - done, phase.sends[q] - at)
            while end:
                x0, x1 = clip(window), clip(window + 1)
                first, last = phase.sent(q, x0), phase.sent(q, x1)
                if last > at:
                    take = min(end, last - at)
                    offset = phase.base + x0 - window * length + phase.below(q, x1) - phase.below(q, x0) + at - first
                    yield done, take, window, offset
                    done, at, end = done + take, at + take, end - take
                window += 1


def place(levels: list[Level], level: int, q: int, start: int, n: int) -> Iterator[tuple[int, int, int, int]]:
    """Where n tokens of a queue of some level go in the sequences: (tokens before, tokens, sequence, offset)."""
    for done, take, window, offset in levels[level].cuts(q, start, n):
        if not level:
            yield done, take, window, offset
        else:
            above = levels[level - 1]
            for before, part, *where in place(levels, level - 1, above.rest, window * levels[level].length + offset, take):
                yield done + before, part, *where


def levels_of(sources: DataFrame, total: int, length: int, targets: dict[str, float] | None) -> list[Level]:
    """The levels of all sources (columns source, n): at most ``MIN_QUANTUM`` rows of each come to the driver, or the targets."""
    out: list[Level] = []
    while total:
        if targets and not out:
            own = F.col("source").isin(*targets)
        else:
            own = F.col("n").cast("decimal(38,0)") * length >= F.lit(total * MIN_QUANTUM).cast("decimal(38,0)")
        heavy = sources.where(own).orderBy("source").collect()
        totals = {q: r.n for q, r in enumerate(heavy)}
        rest = total - sum(totals.values())
        if not (targets and not out) and 0 < rest * length < total and heavy:  # under a token a window: with the last queue
            heavy, last = heavy[:-1], len(heavy) - 1
            totals[last] += rest
            rest = totals[last]
        elif rest:
            totals[len(heavy)] = rest
        shares = {q: Fraction(n, total) for q, n in totals.items()}
        if targets and not out:
            whole = sum(targets[r.source] for r in heavy)
            for q, r in enumerate(heavy):
                shares[q] = Fraction(targets[r.source] / whole).limit_denominator(10**6)
        names = [r.source for r in heavy]
        out.append(Level(length, names, totals, shares, len(names) if rest else None))
        if not rest or length >= total:
            break
        sources, total, length = sources.where(~F.col("source").isin(*names)) if names else sources, rest, length * MIN_QUANTUM
    return out


def pack(
    docs: DataFrame, tokenizer: str | None = None, length: int = LENGTH, end: int = END, targets: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"
) -> DataFrame:
    """Pieces of all ``docs`` in sequences of ``length`` tokens, each in the target proportions of sources.

    ``targets`` maps sources to positive weights; the sources without one share a queue. The default is
    each source's share of all tokens, with which all queues run dry together. Sources with under
    MIN_QUANTUM tokens a window take longer turns in the queue that they share. Only the last sequence of all can be short. Null texts are empty (one
    token, ``end``); a null source is the source "". Rows with null or repeated ids are documents like
    any other. An empty table gives no pieces.
    Columns: id, start, length, ids (binary, little-endian 32 bits), doc_tokens, sequence_id, offset, source_queue.
    """
    tokenizer = tokenizer or public_tokenizers.path("word_bpe_49k.json")
    kind = docs.schema[id_col].dataType.simpleString()
    wide = _tokenizer(tokenizer).get_vocab_size() > 1 << 16
    tokens = stored(tokenised(docs, tokenizer, end, id_col, text_col, source_col), "tokens")
    parts = stored(tokens.groupBy("part", "source").agg(F.sum("n").alias("n")), "part-totals")
    total = parts.agg(F.sum("n")).first()[0] or 0
    if targets and min(targets.values()) * length < sum(targets.values()):
        raise ValueError("a target share is under one token a window")
    levels = levels_of(stored(parts.groupBy("source").agg(F.sum("n").alias("n")), "source-totals"), total, length, targets)

    last = levels[-1] if levels else None
    level, queue = F.lit(len(levels) - 1), F.lit(last.rest if last else None)
    for i, own in enumerate(levels):
        if own.names:
            here = F.col("source").isin(*own.names)
            level, queue = F.when(here, i).otherwise(level), F.when(here, F.array_position(F.array(*map(F.lit, own.names)), F.col("source")) - 1).otherwise(queue)
    parts = parts.withColumn("level", level.cast("int")).withColumn("queue", queue.cast("int")).withColumn("block", F.expr("part div 512"))
    inside = Window.partitionBy("source", "block").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    blocks = parts.groupBy("level", "queue", "source", "block").agg(F.sum("n").alias("n"))
    ahead = Window.partitionBy("level", "queue").orderBy("source", "block").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.select("source", "block", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("ahead"))
    zero = F.coalesce(F.sum("n").over(inside), F.lit(0))
    bases = parts.withColumn("inside", zero).join(blocks, ["source", "block"]).select("part", "source", "level", "queue", (F.col("inside") + F.col("ahead")).alias("base"))
    # stored, so that Spark knows its size: it is broadcast only below spark.sql.autoBroadcastJoinThreshold
    bases = stored(bases, "queue-bases")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(8)]
            for doc, k, q, first, n, ids in zip(*(batch.column(i).to_pylist() for i in range(6)), strict=True):
                raw, shown = ids if wide else np.frombuffer(ids, "<u2").astype("<u4").tobytes(), levels[0].rest if k else q
                for done, take, window, offset in place(levels, k, q, first, n):
                    for column, x in zip(out, (doc, done, take, raw[4 * done : 4 * (done + take)], n, window, offset, shown), strict=True):
                        column.append(x)
            kinds = [batch.schema.field(0).type, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int32()]
            names = ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "source_queue"]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=names)

    placed = tokens.join(bases, ["part", "source"]).select("doc_id", "level", "queue", (F.col("base") + F.col("before")).alias("first"), "n", "ids")
    pieces = placed.mapInArrow(run, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long, source_queue int")
    return pieces.withColumnRenamed("doc_id", id_col) if id_col != "doc_id" else pieces


def digest_pieces(pieces: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Pieces with the CRC-32 of their ids in place of the ids."""
    return pieces.select(id_col, "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "source_queue")
