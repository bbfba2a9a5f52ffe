"""Prefix trie, substring dedup and periodic runs against brute force, and on nulls, blanks, long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import zlib

import pytest
from pyspark.sql import functions as F


@pytest.fixture(scope="module", autouse=True)
def shipped(spark):
    from draftlake.llm.common import ship

    ship(spark)


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


# --- prefix trie


def expected_trie(rows, rebuilt):
    convs = {}
    for c, turn, role, text in rows:
        if c is not None:
            convs.setdefault(c, []).append((turn is not None, turn or 0, role or "", text or ""))

    def digest(r):
        return hashlib.sha256(f"{len(r[2].encode())}:{r[2]}{r[3]}".encode()).digest()[:16]

    convs = {c: [r[2:] for r in sorted(v, key=lambda r: (r[0], r[1], digest(r)))] for c, v in convs.items()}
    whole = {}
    for c, own in convs.items():
        h = zlib.crc32(str(c).encode()) % 6 if rebuilt else 0
        whole[c] = convs.get(c - c % 100, [])[:h] + own[h:]
    nodes, children, below = {}, {}, {}
    for c, turns in whole.items():
        for d in range(len(turns) + 1):
            nodes.setdefault(tuple(turns[:d]), []).append(c)
    for k in nodes:
        if k:
            children.setdefault(k[:-1], []).append(k)
    out = []
    for k in sorted(nodes, key=len, reverse=True):
        kids = children.get(k, [])
        saved = (len(nodes[k]) - 1) * (len(k[-1][1]) if k else 0)
        below[k] = sum(below[x][0] for x in kids) or 1, saved + sum(below[x][1] for x in kids)
        ends = sorted(c for c in nodes[k] if len(whole[c]) == len(k))
        out.append((min(nodes[k]), len(k), min(nodes[k[:-1]]) if k else None, len(nodes[k]), len(kids), *below[k], sha(",".join(map(str, ends)))))
    return sorted(out, key=str)


def talks():
    rng, rows = random.Random(3), []
    for c in [*range(40), 100, 101, 102, 150, 205, 206, 207]:
        words = rng.choice([list("abcdefgh"), ["a", "b", "x", "y", "é日"], ["z"] * 9])
        for t in range(300 if c in (7, 8) else rng.randrange(0, 9)):
            text = (words * 100)[t] if rng.random() < 0.95 else rng.choice([None, "", "q"])
            rows.append((c, t if t else rng.choice([None, 0]), rng.choice(["user", "user", None]), text))
    rows += [(c, t, "user", "ab"[t % 2]) for c, n in ((107, 260), (108, 250)) for t in range(n)]
    rows += [(30, 2, "user", "tie"), (30, 2, "bot", "tie"), (30, 2, "bot", "tie"), (None, 0, "user", "none")]
    return rows


SCHEMA = "conv_id long, turn long, role string, text string"


@pytest.mark.parametrize("rebuilt", [True, False])
def test_trie(spark, rebuilt):
    from draftlake.llm.prefix_trie import prefix_trie

    rows = talks()
    df = spark.createDataFrame(rows, SCHEMA).withColumns({"key": F.lit("k"), "depth": F.lit("d"), "n": F.lit(1)}).repartition(3)
    got = prefix_trie(df, rebuilt)
    assert got.columns == ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == expected_trie(rows, rebuilt)


def test_trie_over_many_partitions(spark, monkeypatch):
    """Conversations that several partitions share, and merges in more than one round."""
    from draftlake.llm import prefix_trie

    monkeypatch.setattr(prefix_trie, "FAN", 2)
    shuffles = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "7")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(talks(), SCHEMA)
        parts = prefix_trie.walked(prefix_trie.turns_of(df)).groupBy("conv_id").agg(F.count_distinct("part").alias("n"), F.max("i").alias("i"), F.count(F.lit(1)).alias("rows"))
        assert parts.where("n > 1").count() and not parts.where("i <> rows").count()
        got = sorted(map(tuple, prefix_trie.prefix_trie(df, True).collect()), key=str)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", shuffles)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    assert got == expected_trie(talks(), True)


def test_partial_tries_go_out_when_full():
    import pyarrow as pa

    from draftlake.llm import prefix_trie as P

    def batch(rows):
        kinds = [pa.int32(), pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.int64()]
        columns = [pa.array(c, k) for c, k in zip(list(zip(*rows, strict=True))[:6], kinds, strict=True)]
        return pa.RecordBatch.from_arrays([*columns, pa.array([r[6] for r in rows])], names=["part", "conv_id", "i", "p", "t", "cp", "info"])

    rows = []
    for c in range(20):
        t, q = P._bytes(5), P._bytes(5 if c % 2 else 6)
        rows.append((0, c, 0, None, None, 0, {"first": True, "len": 2, "h": 0, "skipped": None, "took": []}))
        rows += [(0, c, 1, t, t, 1, None), (0, c, 2, P._bytes((5 * P.BASE + int.from_bytes(q, "big")) % P.PRIME), q, 1, None)]
    for limit in (3, 1000):
        P.NODES, before = limit, P.NODES
        try:
            out = [r for b in P._partial_tries(iter([batch(rows)])) for r in b.to_pylist()]
        finally:
            P.NODES = before
        sums, ends = {}, {}
        for r in out:
            sums[r["key"]] = sums.get(r["key"], 0) + r["n"]
            if r["ends"]:
                ends.setdefault(r["key"], []).append(r["ends"])
        assert sorted(sums.values()) == [10, 10, 20, 20]
        assert sorted(",".join(v) for v in ends.values()) == sorted(",".join(str(c) for c in range(20) if c % 2 == k) for k in (0, 1))
        assert (len(out) == 4) == (limit == 1000)


def test_trie_of_nothing_and_of_one(spark):
    from draftlake.llm.prefix_trie import prefix_trie

    df = spark.createDataFrame(talks(), SCHEMA)
    assert prefix_trie(df.limit(0)).count() == 0
    alone = spark.createDataFrame([(105, 0, "user", "x")], SCHEMA)
    assert sorted(map(tuple, prefix_trie(alone, True).collect()), key=str) == expected_trie([(105, 0, "user", "x")], True)


# --- substring dedup


def expected_substrings(texts, window=13):
    words = {i: (t or "").encode().split() for i, t in texts.items()}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][k : k + window]), i)
    out = {}
    for i, own in words.items():
        left = [True] * len(own)
        for k in range(len(own) - window + 1):
            if first[tuple(own[k : k + window])] < i:
                left[k : k + window] = [False] * window
        out[i] = len(own), len(own) - sum(left), b" ".join(w for w, x in zip(own, left, strict=True) if x).decode()
    return out


def copied_texts():
    rng = random.Random(7)
    vocabulary = [f"w{i}" for i in range(300)] + ["The", "the", "über", "日本", "\x1cx"]

    def prose(n):
        return [rng.choice(vocabulary) for _ in range(n)]

    passages = [prose(n) for n in (12, 13, 14, 20, 60, 200)]
    texts = {}
    for i in range(60):
        own = prose(rng.randrange(0, 80))
        for _ in range(rng.randrange(0, 4)):
            part = list(rng.choice(passages))
            if rng.random() < 0.4:
                part[rng.randrange(len(part))] = "edited"
            a = rng.randrange(len(part))
            own += part if rng.random() < 0.5 else part[a : a + 40]
            own += prose(rng.randrange(0, 9))
        texts[i * 3 % 61] = rng.choice([" ", "\n", "\t \r\n"]).join(own)
    low = [rng.choice("ab") for _ in range(3000)]
    texts |= {70: None, 71: "", 72: " \n\t", 73: " ".join(["a"] * 500), 74: " ".join(["a"] * 40), 75: " ".join(low), 76: " ".join(low[::-1]), 77: "w" * 5000, 78: " ".join(passages[5])}
    return texts


def substring_frame(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    return df.withColumns({"a": F.lit("k"), "h": F.lit(1), "first": F.lit(2), "doc": F.lit("d"), "a.b": F.lit(3), "n_words": F.lit("n")}).repartition(3)


def test_substrings(spark):
    from draftlake.llm.substrings import dedup_substrings, rewritten

    texts = copied_texts()
    expected = expected_substrings(texts)
    docs = substring_frame(spark, texts)
    got = {r.doc_id: r for r in dedup_substrings(docs).collect()}
    assert {i: (r.n_words, r.n_removed, r.kept) for i, r in got.items()} == expected
    assert sum(n for _, n, _ in expected.values()) > 1000 and any(0 < n < 30 for _, n, _ in expected.values())
    for i, r in got.items():
        gone = {w for f in r.factors for w in range(f.start, f.start + f.length)}
        words = (texts[i] or "").encode().split()
        assert b" ".join(w for k, w in enumerate(words) if k not in gone).decode() == r.kept
        assert all(f.length >= 13 and f.source < i for f in r.factors)
    out, _, _ = rewritten(docs)
    assert {(r.doc_id, r.text, r["a"], r["a.b"], r["n_words"]) for r in out.collect()} == {(i, t, "k", 3, "n") for i, (_, _, t) in expected.items()}


def test_substrings_with_frequent_anchors(spark):
    """Anchors that are dealt in parts give the same index."""
    from draftlake.llm import substrings as S

    docs = substring_frame(spark, copied_texts()).select(F.col("doc_id").alias("doc"), F.coalesce("text", F.lit("")).cast("binary").alias("text"))
    rows = docs.mapInArrow(S._phrase_rows, "doc long, a long, h long")
    frequent = [r.a for r in rows.groupBy("a").count().where("count > 1").orderBy("a").collect()]
    assert len(frequent) > 20
    wanted = lambda df: {tuple(r) for r in df.where("first < doc OR border").collect()}
    plain = wanted(S.phrase_index(docs, []))
    assert plain == wanted(S.phrase_index(docs, frequent[::2])) == wanted(S.phrase_index(docs, frequent))


def test_substrings_of_null_repeated_and_text_ids(spark):
    from draftlake.llm.substrings import dedup_substrings

    text = " ".join(f"w{i}" for i in range(30))
    rows = [(None, text), (None, text), ("b", text), ("b", text + " x"), ("c", "y " + text), ("c", None)]
    got = sorted((r.doc_id or "", r.kept) for r in dedup_substrings(spark.createDataFrame(rows, "doc_id string, text string")).collect())
    assert got == sorted([("", text), ("", text), ("b", text), ("b", text + " x"), ("c", "y"), ("c", "")])
    assert dedup_substrings(spark.createDataFrame([], "doc_id long, text string")).count() == 0


# --- periodic runs


def expected_runs(s):
    out = []
    for q in range(1, len(s) // 3 + 1):
        i = 0
        while i + q < len(s):
            if s[i] != s[i + q]:
                i += 1
                continue
            j = i
            while j + q < len(s) and s[j] == s[j + q]:
                j += 1
            n = j + q - i
            if n >= max(24, 3 * q) and not any(q % d == 0 and s[i : i + n - d] == s[i + d : i + n] for d in range(1, q)):
                out.append((i, n, q))
            i = j
    return sorted(out)


def periodic(rng):
    out, k = [], rng.choice([1, 2, 2, 3, 50])
    for _ in range(rng.randrange(1, 9)):
        way = rng.random()
        if way < 0.4:
            out += [rng.randrange(k) for _ in range(rng.randrange(1, 30))]
        elif way < 0.8:
            unit = [rng.randrange(k) for _ in range(rng.randrange(1, 14))]
            out += (unit * 12)[: rng.randrange(1, 12 * len(unit))]
        elif out:
            a = rng.randrange(len(out))
            out += out[a : a + rng.randrange(1, 120)]
    return out


def test_runs_of_sequences():
    from draftlake.llm.runs import find_runs, runs_of

    rng, found = random.Random(11), 0
    for _ in range(1500):
        s = periodic(rng)
        expected = expected_runs(s)
        found += len(expected)
        assert find_runs(s) == expected
        assert runs_of([b"%d" % x for x in s]) == expected
    assert found > 1500


def test_factors_are_the_longest_that_begin_earlier():
    from draftlake.llm.runs import factors

    rng = random.Random(12)
    for _ in range(300):
        s, at = periodic(rng)[:120], 0
        for start, end, source in factors(s):
            assert start == at and end > at
            at = end
            longest = max((next((n for n in range(len(s) - start) if s[j + n] != s[start + n]), len(s) - start) for j in range(start)), default=0)
            assert end - start == max(1, longest)
            assert source == -1 if longest == 0 else 0 <= source < start and all(s[source + n] == s[start + n] for n in range(longest))
        assert at == len(s)


def test_runs_query(spark):
    from draftlake.llm.runs import digest_runs, periodic_runs, with_planted_tail

    rng = random.Random(13)
    texts = {i: " \n".join(f"v{x}" for x in periodic(rng)) for i in range(60)}
    texts |= {i: " ".join(f"w{rng.randrange(400)}" for _ in range(rng.randrange(1, 300))) for i in range(60, 200)}
    texts |= {200: None, 201: "", 202: " \t\n", 203: "a " * 30000, 204: "w" * 4000, 205: " ".join(["x y z"] * 9)}
    df = spark.createDataFrame([*texts.items(), (None, texts[205]), (205, texts[205])], "doc_id long, text string").withColumns({"runs": F.lit(1), "id": F.lit("i")}).repartition(3)
    got = digest_runs(periodic_runs(df, change=with_planted_tail)).collect()
    assert len(got) == len(texts) + 2
    planted = 0
    for r in got:
        words = (texts[205 if r.doc_id is None else r.doc_id] or "").encode().split()
        h = zlib.crc32(str(r.doc_id).encode())
        if r.doc_id is not None and h % 10 == 0 and words:
            n, g = len(words), h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = words[:a] + [words[a + (i - a) % p] for i in range(a, n)]
            planted += 1
        runs = expected_runs(words) if len(words) < 20000 else [(0, len(words), 1)]
        drop = {i for start, n, q in runs for i in range(start + q, start + n)}
        best = min(runs, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None, None, None))
        milli = 1000 * best[1] // best[2] if runs else None
        assert (r.n_runs, r.start, r.length, r.period, r.exponent_milli) == (len(runs), *best, milli)
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert r.collapsed_sha256 == sha(b" ".join(w for i, w in enumerate(words) if i not in drop))
    assert planted >= 10
    assert periodic_runs(df.limit(0)).count() == 0
    plain = {r.doc_id: r for r in periodic_runs(df.where("doc_id < 60")).collect()}
    assert all([tuple(x) for x in r.runs] == expected_runs((texts[i] or "").split()) for i, r in plain.items())
