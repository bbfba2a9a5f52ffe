"""Near copies by exact similarity: recall against brute force, hot groups, null and repeated ids."""

import random

import pytest

WORDS = [f"w{i}" for i in range(4000)]


def sets_of(text):
    words = (text or "").lower().split()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else frozenset()


def heads_of(texts):
    """Smallest id of each group, by comparing all pairs."""
    ids, sets = sorted(texts), {i: sets_of(t) for i, t in texts.items()}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {find(i) for i in ids}


def family(rng, base, n, changes):
    for _ in range(n):
        words = list(base)
        for _ in range(changes):
            words[rng.randrange(len(words))] = rng.choice(WORDS)
        yield " ".join(words)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)


@pytest.mark.parametrize("hot", [False, True])
def test_near_copies_equal_brute_force(spark, hot):
    """Families with one to four changed words; hot: a family of 100 around a text that all are near to, not near each other."""
    from corpus_pipeline import near_dedup_stage

    rng, texts = random.Random(5), []
    for size in (8, 30, 60, 100, 300):
        for changes in (1, 2, 4):
            base = rng.choices(WORDS, k=size)
            texts += [" ".join(base), *family(rng, base, 4, changes)]
    if hot:
        base = rng.choices(WORDS, k=60)
        texts += [*family(rng, base, 100, 1), " ".join(base)]
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    got = near_dedup_stage(spark, frame(spark, [(i, t, "s") for i, t in texts.items()]), None)
    assert got.columns == ["doc_id", "text", "source"]
    rows = {r.doc_id: r.text for r in got.collect()}
    assert set(rows) == heads_of(texts) and all(rows[i] == texts[i] for i in rows)


def test_null_and_repeated_ids(spark):
    from corpus_pipeline import near_dedup_stage

    a, b, c, d = (" ".join(random.Random(i).choices(WORDS, k=50)) for i in range(4))
    rows = [(None, a, "s"), (None, b, "s"), (7, b, "s"), (3, c, "s"), (3, c, "s"), (3, d, "s"), (None, None, "s"), (9, "", "s")]
    got = near_dedup_stage(spark, frame(spark, rows), None).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == sorted([(True, 0, a), (False, 7, b), (False, 3, c), (False, 3, d), (False, 9, "")])
    assert near_dedup_stage(spark, frame(spark, rows).limit(0), None).count() == 0


def test_names_with_dots_and_text_ids(spark):
    from corpus_pipeline import line_dedup_stage, near_dedup_stage

    line = "a line that two documents have"
    rows = [("b", f"{line}\nmore of b", "s"), ("a", f"{line}\nother", "s"), ("c", "more of b", "s")]
    docs = spark.createDataFrame(rows, "doc_id string, text string, source string").selectExpr("*", "char_length(text) AS n_chars", "1 AS `a.b`", "'x' AS `a`")
    lined = line_dedup_stage(spark, docs, None)
    assert lined.columns == docs.columns
    assert {(r.doc_id, r.text, r["a.b"]) for r in lined.collect()} == {("a", f"{line}\nother", 1), ("b", "more of b", 1), ("c", "more of b", 1)}  # nine code points: no key
    single = near_dedup_stage(spark, lined, None)
    assert single.columns == docs.columns and {r.doc_id for r in single.collect()} == {"a", "b"}


def test_groups_of_more_texts_than_a_unit(spark, monkeypatch):
    """Large groups count as one in the second round; texts near one of their texts only are still found."""
    from draftlake.llm import near_copies

    monkeypatch.setattr(near_copies, "BIG", 6)
    rng, texts = random.Random(8), []
    for size in (40, 60, 100):
        base = rng.choices(WORDS, k=size)
        texts += [" ".join(base), *family(rng, base, 30, 1)]
        for i in range(3):  # chains away from the family
            words = texts[-1 - i].split()
            for _ in range(3):
                words[rng.randrange(len(words))] = rng.choice(WORDS)
                texts.append(" ".join(words))
    rng.shuffle(texts)
    texts = dict(enumerate(texts))
    got = {r.doc_id for r in near_copies.first_of_each(frame(spark, [(i, t, "s") for i, t in texts.items()])).collect()}
    expected = heads_of(texts)
    assert expected <= got and len(got - expected) <= 1


def test_no_partner_is_lost_to_heads(spark, monkeypatch):
    """Twelve texts with all keys in common: those near to neither head of a key, and one near to a single text of a large group, are found too."""
    from draftlake.llm import near_copies

    monkeypatch.setattr(near_copies, "BIG", 2)
    monkeypatch.setattr(near_copies, "SALT", 3)
    starts = {0: 0, 1: 5, 2: 10, 11: 20, 3: 1000, 4: 1010, 5: 2000, 6: 2010} | {i: i * 1000 for i in range(7, 11)}
    sets = spark.createDataFrame([(i, list(range(at, at + 100))) for i, at in starts.items()], "node long, hashes array<long>")
    nodes = spark.createDataFrame([(i, 100, 0, [0] * near_copies.PARTS) for i in starts], "node long, n int, bits long, codes array<short>")
    groups = near_copies.groups_of(nodes, lambda wanted: sets.join(wanted, "node"))
    assert {(r.node, r.root) for r in groups.collect()} == {(0, 0), (1, 0), (2, 0), (11, 0), (3, 3), (4, 3), (5, 5), (6, 5)}
