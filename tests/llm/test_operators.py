"""Each training-data operator against brute force, and on nulls, blanks, long texts, ties, repeats, empty tables and clashing columns."""

import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

WORDS = "alpha beta gamma delta the of and to on as über señor élan zeta 日本 don't x1".split()
FOLD = {c: c + 32 for c in range(65, 91)}


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n)).capitalize() + "."


def rows():
    """(doc_id, text, source): copies, near copies, shared lines, blanks, a null and a long text."""
    rng = random.Random(5)
    shared = "This very line is in several documents"
    out = [(i, "\n".join(prose(rng, rng.randrange(3, 40)) for _ in range(rng.randrange(1, 5))), f"s{i % 3 if i % 2 else 0}") for i in range(40)]
    out += [(50 + i, out[3][1], "s0") for i in range(6)]
    out += [(60 + i, out[4][1] + f"\n {shared.upper() if i else shared} \nshort\n{shared}", "s1") for i in range(4)]
    out += [(70, "", "s1"), (71, None, None), (72, " \t\n\n", "s2"), (73, prose(rng, 20000), "s2"), (74, "w" * 3000, "s2"), (75, "one two", "s0"), (76, "\x1c a\x00b  c <s>", "s0")]
    return out


@pytest.fixture(scope="module")
def docs(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("docs") / "docs")
    df = spark.createDataFrame(rows(), "doc_id long, text string, source string")
    df.select("doc_id", "text", F.lit("en").alias("lang"), "source", F.length("text").cast("long").alias("n_chars"), F.lit(1).alias("shard"), F.lit("k").alias("kept"), F.lit(0).alias("gone"), F.lit("f").alias("fp")).repartition(3).write.parquet(path)
    from draftlake.llm.common import ship

    ship(spark)
    return spark.read.parquet(path)


TEXTS = {i: t for i, t, _ in rows()}


def test_sharding_is_minimax(docs):
    from draftlake.llm.sharding import assign_shards

    got = assign_shards(docs, 7).collect()
    assert sorted(r.doc_id for r in got) == sorted(TEXTS)
    group, sizes, slots = defaultdict(set), defaultdict(int), defaultdict(list)
    for r in got:
        raw = (TEXTS[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law, r.grown_shard) == (len(raw) + 8, zlib.crc32(raw), "bytes", None)
        group[raw].add(r.shard)
        sizes[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
    assert all(len(s) == 1 for s in group.values()) and all(sorted(s) == list(range(len(s))) for s in slots.values())
    totals = defaultdict(int)
    for t in TEXTS.values():
        totals[hashlib.md5((t or "").encode()).hexdigest()] += len((t or "").encode()) + 8
    ordered = [totals[g] for g in sorted(totals)]

    def shards(capacity):
        n, left = 1, capacity
        for s in ordered:
            n, left = (n, left - s) if s <= left else (n + 1, capacity - s)
        return n

    low, high = max(ordered), sum(ordered)
    while low < high:
        mid = (low + high) // 2
        low, high = (low, mid) if shards(mid) <= 7 else (mid + 1, high)
    assert max(sizes.values()) == low


def test_sharding_of_repeats_and_nothing(docs):
    from draftlake.llm.sharding import assign_shards

    twice = docs.union(docs).unionByName(docs.limit(1).withColumn("doc_id", F.lit(None).cast("long")))
    slots = defaultdict(list)
    for r in assign_shards(twice, 3).collect():
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and sum(map(len, slots.values())) == 2 * len(TEXTS) + 1
    assert assign_shards(docs.limit(0), 3).count() == 0


def check_packing(pieces, texts, length):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    ids = {i: [*tokenizer.encode(t or "", add_special_tokens=False).ids, 2] for i, t in texts.items()}
    by_doc, by_window = defaultdict(list), defaultdict(list)
    for p in pieces:
        by_doc[p.doc_id].append(p)
        by_window[p.sequence_id].append(p)
    assert set(by_doc) == set(ids)
    for i, ps in by_doc.items():
        at = 0
        for p in sorted(ps, key=lambda p: p.start):
            assert p.start == at and p.doc_tokens == len(ids[i]) and bytes(p.ids) == np.array(ids[i][at : at + p.length], "<u4").tobytes()
            at += p.length
        assert at == len(ids[i])
    for ps in by_window.values():
        at = 0
        for p in sorted(ps, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= length
    total = sum(map(len, ids.values()))
    assert sorted(by_window) == list(range(-(-total // length)))
    return by_window


def test_packing_mixes_by_share(docs):
    from draftlake.llm.packing import pack

    windows = check_packing(pack(docs, length=512).collect(), TEXTS, 512)
    counts = [defaultdict(int) for _ in windows]
    for w, ps in windows.items():
        for p in ps:
            counts[w][p.source_queue] += p.length
    for q in {q for c in counts for q in c}:
        seen = [c[q] for c in counts[:-1]]
        assert max(seen) - min(seen) <= 2


def test_packing_with_targets_and_nothing(docs):
    from draftlake.llm.packing import pack

    windows = check_packing(pack(docs, length=512, targets={"s0": 3.0, "s1": 1.0}).collect(), TEXTS, 512)
    first = defaultdict(int)
    for p in windows[0]:
        first[p.source_queue] += p.length
    assert first[0] == pytest.approx(3 * first[1], rel=0.02)
    assert pack(docs.limit(0)).count() == 0


def expected_lines(texts):
    key = lambda line: line.strip(" \t\n\x0b\x0c\r").translate(FOLD)
    owner = {}
    for i in sorted(texts):
        for line in (texts[i] or "").split("\n"):
            owner.setdefault(key(line), i)
    out = {}
    for i, t in texts.items():
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 10 or owner[key(x)] == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("batches", [1, 5])
def test_line_dedup(docs, batches):
    from draftlake.llm.line_dedup import dedup_lines

    got = {r.doc_id: (r.n_lines, r.n_dropped, r.kept) for r in dedup_lines(docs, batches=batches, fanout=2).collect()}
    assert got == expected_lines(TEXTS)


def test_line_dedup_keeps_columns_and_null_ids(docs):
    from draftlake.llm.line_dedup import with_kept_lines

    lone = docs.where("doc_id = 60").withColumn("doc_id", F.lit(None).cast("long"))
    out = with_kept_lines(docs.unionByName(lone))
    assert out.columns == docs.columns
    assert out.where("doc_id IS NULL").first().text == TEXTS[60]
    assert with_kept_lines(docs.limit(0)).count() == 0


def test_sentencepiece_equals_the_library_and_round_trips(docs):
    import sentencepiece

    from draftlake.llm.wfst import decode_ids, encode_texts, transducer

    path = public_tokenizers.path("piece_bpe_32k.model")
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    for r in decode_ids(encode_texts(docs)).collect():
        text = TEXTS[r.doc_id] or ""
        assert np.frombuffer(bytes(r.ids), "<u4").tolist() == library.encode(text) and r.text == text
    rng, machine = random.Random(2), transducer(path)
    for _ in range(2000):
        text = "".join(rng.choice("abceht .,'▁\n\t01éßñ日😀(s)") for _ in range(rng.randrange(30)))
        assert np.frombuffer(machine.encode(text), "<u4").tolist() == library.encode(text)
        assert machine.decode(machine.encode(text)) == library.decode(library.encode(text))
    assert encode_texts(docs.limit(0)).count() == 0


@pytest.fixture(scope="module")
def vectors(spark, docs):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(700, 16)) * rng.uniform(0.2, 2, size=(700, 1))
    base[100:160] = base[5]
    data = [(i, v.astype(np.float32).tolist()) for i, v in enumerate(base)]
    odd = [(900, None), (950, [1.0, None] * 8), (1000, [float("nan")] * 16), (1050, [float("inf")] * 16), (1100, []), (None, data[0][1]), (1200, [0.0] * 16)]
    return spark.createDataFrame(data + odd, "vec_id long, embedding array<float>"), {i: np.array(v) for i, v in [*data, (1200, np.zeros(16))]}


def test_topk_is_exact(vectors, monkeypatch):
    from draftlake.llm import topk

    monkeypatch.setattr(topk, "BLOCK", 120)
    monkeypatch.setattr(topk, "QUERIES", 5)
    table, known = vectors
    ints = {i: np.floor(256 * v.astype(float)).astype(np.int64) for i, v in known.items()}
    got = defaultdict(list)
    for r in sorted(topk.top_k(table, 5, 50).collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, r.score))
    for q in (i for i in ints if i % 50 == 0):
        best = sorted((-int(ints[q] @ v), i) for i, v in ints.items() if i != q)[:5]
        assert got.pop(q) == [(i, -s) for s, i in best]
    assert not got and topk.top_k(table.limit(0)).count() == 0


def test_ann_recall(vectors, monkeypatch):
    from draftlake.llm import ann

    monkeypatch.setattr(ann, "BLOCK", 250)
    table, known = vectors
    known = {i: v.astype(float) for i, v in known.items() if v.any()}
    got = defaultdict(list)
    for r in sorted(ann.nearest(table, 10, 100).collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.vec_id, r.score))
    recalls = []
    for q in (i for i in known if i % 100 == 0):
        true = sorted((float(np.sqrt(((v - known[q]) ** 2).sum())), i) for i, v in known.items() if i != q)[:10]
        assert got[q] == sorted(got[q], key=lambda x: (x[1], x[0])) and len(got[q]) == 10
        assert all(s == pytest.approx(float(np.sqrt(((known[i] - known[q]) ** 2).sum())), abs=1e-12) for i, s in got[q])
        recalls.append(len({i for _, i in true} & {i for i, _ in got[q]}) / 10)
    assert set(got) == {i for i in known if i % 100 == 0} and np.mean(recalls) >= 0.9
    assert ann.nearest(table.limit(0)).count() == 0


def fingerprint(text):
    words = [w for w in re.split("[\x20\x09-\x0d]+", (text or "").translate(FOLD)) if w]
    shingles = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if hashes and 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components_of(prints):
    ids, parent = sorted(prints), {i: i for i in prints}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 2 and find(a) != find(b):
                parent[max(find(a), find(b))] = min(find(a), find(b))
    return {i: find(i) for i in ids}


def test_near_duplicates(docs):
    from draftlake.llm.simhash import near_duplicates

    prints = {i: fingerprint(t) for i, t in TEXTS.items()}
    got = {r.doc_id: (int(r.fingerprint, 16), r.component_id) for r in near_duplicates(docs).collect()}
    expected = components_of(prints)
    assert got == {i: (prints[i], expected[i]) for i in TEXTS}
    assert near_duplicates(docs.limit(0)).count() == 0


@pytest.mark.parametrize("bucket", [2, 16])
def test_links_lose_nothing(spark, docs, bucket, monkeypatch):
    """Chains and dense families of fingerprints, with small and with large buckets."""
    from draftlake.llm import simhash
    from draftlake.llm.components import components

    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng, prints = random.Random(8), {0, (1 << 64) - 1}
    for _ in range(25):
        x = rng.getrandbits(64)
        for _ in range(rng.randrange(1, 20)):
            prints.add(x)
            x ^= 1 << rng.randrange(64) | 1 << rng.randrange(64)
    own = {p - (1 << 64) if p >> 63 else p: p for p in prints}
    found = components(simhash.links(spark.createDataFrame([(s,) for s in own], "fp long"))).collect()
    root = {own[r.node]: own[r.root] for r in found}
    groups = defaultdict(set)
    for p in prints:
        groups[root.get(p, p)].add(p)
    expected = defaultdict(set)
    for p, head in components_of({p: p for p in prints}).items():
        expected[head].add(p)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, expected.values()))


def test_golay_code():
    from draftlake.llm.simhash import golay_index

    table = golay_index()
    assert np.bincount(table, minlength=4096).tolist() == [2048] * 4096


@pytest.fixture(scope="module")
def labelled(spark, docs):
    """Good and junk texts, clean and toxic, most of them labelled."""
    rng, data, labels = random.Random(9), [], []
    for i in range(600):
        junk, toxic = i % 6 == 0, i % 7 == 0
        words = [rng.choice(WORDS) + rng.choice(["a", "en", "is", ""]) for _ in range(60)]
        if toxic:
            words[7:7] = ["moron", "scumbag"]
        text = " | ".join(w.upper() + "!!" for w in words) if junk else " ".join(words)
        data.append((i, text, "en"))
        if i % 4:
            labels.append((i, int(not junk), int(toxic)))
    return spark.createDataFrame(data, "doc_id long, text string, lang string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")


def test_quality_on_held_out_rows(labelled):
    from draftlake.llm import quality

    docs, labels = labelled
    got = {r.doc_id: r.accepted for r in quality.resample(docs.withColumn("accepted", F.lit("x")), labels).collect()}
    held = [i for i in got if i % 4 == 0]
    assert sum(got[i] == bool(i % 6) for i in held) >= 0.97 * len(held) and len(got) == 600
    kept = quality.select(docs, labels)
    assert kept.columns == docs.columns and {r.doc_id for r in kept.collect()} == {i for i, a in got.items() if a}


def test_quality_edges(docs, labelled):
    from draftlake.llm import quality

    _, labels = labelled
    assert quality.resample(docs, labels).count() == len(TEXTS)
    assert quality.resample(docs.limit(0), labels).count() == 0
    assert quality.select(docs, labels.limit(0)).count() == len(TEXTS)


def test_kth_largest(spark):
    from draftlake.llm.quality import kth_largest

    rng = random.Random(1)
    values = [rng.choice([rng.random(), 0.5]) for _ in range(3000)]
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 700, 1500, 3000):
        assert kth_largest(keys, "key", k, rows=50) == sorted(values, reverse=True)[k - 1]


def test_toxicity_on_held_out_rows(labelled):
    from draftlake.llm import toxicity

    docs, labels = labelled
    graded = {r.doc_id: (r.is_toxic, r.expected_severity) for r in toxicity.grade_toxicity(docs, labels).collect()}
    held = [i for i in graded if i % 4 == 0]
    assert all(graded[i][0] == (i % 7 == 0) for i in held) and all(0 <= s <= toxicity.GRADES for _, s in graded.values())
    kept = toxicity.drop_toxic(docs, labels)
    assert kept.columns == docs.columns and kept.count() == sum(not t for t, _ in graded.values())


def test_toxicity_edges(docs, labelled):
    from draftlake.llm import toxicity

    _, labels = labelled
    assert toxicity.grade_toxicity(docs, labels.limit(0)).where("is_toxic").count() == 0
    assert toxicity.grade_toxicity(docs.limit(0), labels).count() == 0
    assert toxicity.grade_toxicity(docs, labels.withColumn("doc_id", F.col("doc_id") % 70)).count() == len(TEXTS)


def test_ordinal_thresholds_are_ordered():
    from draftlake.llm.toxicity import fit_ordinal, sigmoid

    rng = np.random.default_rng(0)
    x = rng.normal(size=(800, 3))
    grade = np.digitize(2 * x[:, 0] - x[:, 1] + rng.logistic(size=800), [-1, 1, 3])
    w, theta = fit_ordinal(x, grade, 3)
    assert (np.diff(theta) > 0).all() and w[0] > 1 and w[1] < -0.5 and abs(w[2]) < 0.3
    expected = sigmoid((x @ w)[:, None] - theta).sum(1)
    assert np.corrcoef(expected, grade)[0, 1] > 0.7


def test_language(spark, docs):
    from draftlake.llm import langid

    rng = random.Random(3)
    own = {"de": "der und nicht ein schön über".split(), "en": "the and with this that thing".split()}
    corpus = spark.createDataFrame([(i, " ".join(rng.choice(own[k]) for _ in range(50)), k) for i in range(40) for k in [("de", "en")[i % 2]]], "doc_id long, text string, lang string")
    page = lambda k, declared: f"<html{declared}><script>the and with</script><p>{' '.join(rng.choice(own[k]) for _ in range(20))}</p></html>"
    data = [(i, f"https://a.example.de/{k}/{i}", page(k, f' lang="{k}"')) for i in range(40) for k in [("de", "en")[i % 2]]]
    data += [(100, None, None), (101, "nonsense", ""), (102, "https://a.example.de/de/1", '<html lang="de"></html>'), (103, "https://x.de/", page("en", "")), (103, "https://x.de/", page("en", ""))]
    pages = spark.createDataFrame(data, "page_id long, url string, html string")
    got = {r.page_id: r for r in langid.identify(pages, corpus).collect()}
    assert all(got[i].language == ("de", "en")[i % 2] for i in range(40))
    assert got[102].language == "de" and got[103].language == "en" and got[100].host is None and 0 < got[101].confidence <= 1
    assert langid.identify(pages.limit(0), corpus).count() == 0
    assert langid.identify(pages, corpus.limit(0)).where("language IS NULL").count() == len(data)


def test_tokens_hash_like_one_at_a_time():
    from draftlake.llm import text_features as X

    texts = ["Moron moron, ab12 Ünï!!", "", "a " * 5, " x"]
    whole = X.tokens([t.encode() for t in texts], (4,))
    alone = [X.tokens([t.encode()], (4,)) for t in texts]
    assert whole.hash.tolist() == [h for t in alone for h in t.hash.tolist()] and whole.heads[0].tolist() == [h for t in alone for h in t.heads[0].tolist()]
    assert whole.doc.tolist() == [i for i, t in enumerate(alone) for _ in t.hash]
    assert whole.hash[0] == whole.hash[1] and whole.shape[1] & 4
