"""Periodic runs of words: Kolpakov and Kucherov's algorithm, one document at a time.

A run is a stretch of consecutive words with smallest period q (words q apart are identical), of at
least ``max(LEAST, TIMES * q)`` words, that no neighbouring word extends. All runs of a sequence are
found in time linear in its length:

* the suffix automaton gives the Lempel-Ziv factorisation (each factor is the longest stretch that
  also starts earlier, or one new word) and an earlier occurrence of each factor;
* a run that ends in factor u and begins before it reaches back at most ``2 * |u'| + |u|`` words, u'
  the factor before u; Main's algorithm finds these leftmost runs from two Z-functions around the border;
* all other runs lie strictly within a factor and are copied from its earlier occurrence.

A run of that length has each of its words in a stretch of ``SEED`` words that occurs twice, as a
period and a half of SEED words at least repeats. So only the stretches of a document that repeated
windows of SEED words cover go through the algorithm, kept apart by marks that occur once; texts without
a repeated window (most) have no run. Nothing is shuffled: a document is one row and stays in its task.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from draftlake.llm.common import utf8

LEAST, TIMES = 24, 3
SEED = 16  # LEAST - period for the largest period that LEAST words hold TIMES of

Run = tuple[int, int, int]  # start, length, period


def occurrences(s: list[int]) -> tuple[list[dict[int, int]], list[int]]:
    """The suffix automaton of ``s``: transitions of each state, and the place where its words first end."""
    nexts: list[dict[int, int]] = [{}]
    link, size, ends = [-1], [0], [-1]
    last = 0
    for at, c in enumerate(s):
        new = len(nexts)
        nexts.append({})
        size.append(size[last] + 1)
        ends.append(at)
        link.append(0)
        p, last = last, new
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = new
            p = link[p]
        if p < 0:
            continue
        q = nexts[p][c]
        if size[p] + 1 == size[q]:
            link[new] = q
            continue
        twin = len(nexts)
        nexts.append(nexts[q].copy())
        size.append(size[p] + 1)
        ends.append(ends[q])
        link.append(link[q])
        link[q] = link[new] = twin
        while p >= 0 and nexts[p].get(c) == q:
            nexts[p][c] = twin
            p = link[p]
    return nexts, ends


def factors(s: list[int]) -> list[tuple[int, int, int]]:
    """Lempel-Ziv factors (start, end, start of an earlier occurrence; -1 for a new word). Occurrences may overlap."""
    nexts, ends = occurrences(s)
    out, at = [], 0
    while at < len(s):
        state, end, earlier = 0, at, -1
        while end < len(s):
            state = nexts[state][s[end]]
            if ends[state] >= end:  # occurs here first
                break
            earlier = ends[state]
            end += 1
        if end == at:
            out.append((at, at + 1, -1))
        else:
            out.append((at, end, earlier - (end - at) + 1))
        at = out[-1][1]
    return out


def z_function(s: list[int]) -> list[int]:
    """For each place, the length of the longest common prefix of ``s`` and what begins there."""
    n = len(s)
    z = [0] * n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def across(s: list[int], low: int, border: int, high: int) -> list[tuple[int, int, int]]:
    """Main's algorithm: repeats (start, end, a period) within ``[low, high)`` that touch ``border``, each of at least TIMES periods and LEAST words."""
    before, after = s[low:border], s[border:high]
    both = before + after
    m, n = len(before), len(after)
    right = z_function([*after, None, *both])[n + 1 :] + [0]  # common with ``after``, by place in both
    left = z_function([*before[::-1], None, *both[::-1]])[m + 1 :] + [0]  # common endings with ``before``, backwards
    out = []
    for p in range(1, n + 1):  # a period to the right of the border
        back, on = left[n - p], right[m + p]
        if back + on + p >= max(TIMES * p, LEAST):
            out.append((border - back, border + p + on, p))
    for p in range(1, m + 1):  # a period to its left
        back, on = left[n + p], right[m - p]
        if back + on + p >= max(TIMES * p, LEAST):
            out.append((border - p - back, border + on, p))
    return out


def least_period(s: list[int], start: int, end: int, period: int) -> int:
    """The smallest period of a stretch of at least two periods: it divides any such period."""
    rest, f = period, 2
    while rest > 1:
        if f * f > rest:
            f = rest
        if rest % f:
            f += 1
            continue
        rest //= f
        if s[start : end - period // f] == s[start + period // f : end]:
            period //= f
    return period


def find_runs(s: list[int]) -> list[Run]:
    """All runs (start, length, period) of a sequence, by start, then period."""
    found: dict[tuple[int, int], int] = {}
    ordered: list[tuple[int, int]] = []

    def add(start: int, end: int, period: int) -> None:
        if (start, end) not in found:
            found[start, end] = period
            insort(ordered, (start, end))

    previous = 0  # length of the factor before
    for begin, end, source in [*factors(s), (len(s), len(s), -1)]:
        size = end - begin
        if previous + size >= LEAST // 2:  # else 2 * (previous + size) words can't hold a run
            for start, stop, period in across(s, max(0, begin - 2 * previous - size), begin, end):
                if stop == end < len(s) and s[end] == s[end - period]:
                    continue  # goes on: a later factor has its end
                if start and s[start - 1] == s[start - 1 + period]:
                    continue  # begins earlier: its end is that of a longer one, or in another factor
                if (start, stop) not in found:
                    period = least_period(s, start, stop, period)
                    if stop - start >= max(LEAST, TIMES * period):
                        add(start, stop, period)
        if size >= LEAST:
            shift, at = begin - source, bisect_left(ordered, (source + 1, 0))
            while at < len(ordered) and ordered[at][0] < end - shift:
                start, stop = ordered[at]
                if stop < end - shift:
                    add(start + shift, stop + shift, found[start, stop])
                at += 1
        previous = size
    return sorted((start, end - start, period) for (start, end), period in found.items())


def _hashes(words: list[bytes]) -> np.ndarray:
    """A hash of each window of SEED words."""
    one = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words))
    out = np.zeros(len(words) - SEED + 1, np.uint64)
    for i in range(SEED):
        out = (out + one[i : len(out) + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    return out


def repeated_stretches(words: list[bytes]) -> list[tuple[int, int]]:
    """Stretches (start, end) of a document that repeated windows of SEED words cover."""
    if len(words) < LEAST:
        return []
    hashes = _hashes(words)
    order = np.argsort(hashes, kind="stable")
    same = hashes[order[1:]] == hashes[order[:-1]]
    if not same.any():
        return []
    again = np.zeros(len(hashes) + 1, bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    change = np.zeros(len(words) + 1, np.int64)
    change[np.flatnonzero(again)] += 1
    change[np.flatnonzero(again) + SEED] -= 1
    covered = np.concatenate([[0], np.cumsum(change[:-1]) > 0, [0]])
    edges = np.flatnonzero(np.diff(covered))
    return list(zip(edges[::2].tolist(), edges[1::2].tolist(), strict=True))


def runs_of(words: list[bytes]) -> list[Run]:
    """All runs of a document's words, by start, then period."""
    stretches = repeated_stretches(words)
    if not stretches:
        return []
    numbers: dict[bytes, int] = {}
    s, places = [], []
    for k, (start, end) in enumerate(stretches):
        s += [numbers.setdefault(w, len(numbers)) for w in words[start:end]]
        s.append(-1 - k)
        places.append(np.arange(start, end + 1))
    place = np.concatenate(places)
    return [(int(place[start]), length, period) for start, length, period in find_runs(s)]


def collapse(words: list[bytes], found: list[Run]) -> list[bytes]:
    """The words without those that any run holds after its first period."""
    if not found:
        return words
    change = np.zeros(len(words) + 1, np.int64)
    for start, length, period in found:
        change[start + period] += 1
        change[start + length] -= 1
    keep = np.cumsum(change[:-1]) == 0
    return [words[i] for i in np.flatnonzero(keep)]


def _with_runs(change):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, texts = [], []
            for key, text in zip(batch.column(0), batch.column(1), strict=True):
                words = text.as_py().split()  # of bytes: ASCII white space only
                if change is not None:
                    words = change(key.as_py(), words)
                runs = runs_of(words)
                found.append([{"start": a, "length": n, "period": p} for a, n, p in runs])
                texts.append(b" ".join(collapse(words, runs)).decode())
            kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind), pa.array(texts, pa.string())], names=["id", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", change=None) -> DataFrame:
    """Each row's id, its ``runs`` (start, length, period; by start, then period) and ``collapsed`` text.

    Words are what ASCII white space separates; the collapsed text has, joined by one space, the words
    that no run holds after its first period. ``change(id, words)`` may give other words to look at.
    Null, empty and blank texts have no words: no runs and an empty text. Null and repeated ids are rows like
    any other; other columns are left out, so none can clash. An empty table gives an empty table.
    """
    rows = docs.select(F.col(id_col).alias("id"), utf8(F.col(text_col)).alias("text"))
    kind = f"id {docs.schema[id_col].dataType.simpleString()}, runs array<struct<start:long,length:long,period:long>>, collapsed string"
    return rows.mapInArrow(_with_runs(change), kind).withColumnRenamed("id", id_col)


def with_planted_tail(doc_id: int, words: list[bytes]) -> list[bytes]:
    """Of one document in ten, all words from some place on repeat what is there; the place and the period follow from the id's CRC32."""
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    start = g % n
    period = 1 + (n - start) // (3 + g % 8)
    tail = words[start : start + period]
    return words[:start] + (tail * ((n - start) // period + 1))[: n - start]


def digest_runs(found: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Per row: the number of runs, that of the greatest length by period (ties: smallest start, then period), and two hashes."""
    best = F.aggregate(
        "runs",
        F.lit(None).cast("struct<start:long,length:long,period:long>"),
        # length/period > best's, by whole numbers; runs come by start, then period, so a tie keeps the first
        lambda a, r: F.when(a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"]), r).otherwise(a),
    )
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")))
    text = F.concat(F.concat_ws("\n", lines), F.when(F.size("runs") > 0, F.lit("\n")).otherwise(F.lit("")))
    return found.select(
        id_col, F.size("runs").cast("long").alias("n_runs"), best.alias("best"), text.alias("text"), "collapsed"
    ).select(
        id_col, "n_runs", F.col("best.start").alias("start"), F.col("best.length").alias("length"), F.col("best.period").alias("period"),
        F.expr("(1000 * best.length) div best.period").alias("exponent_milli"),
        F.sha2(F.col("text").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
