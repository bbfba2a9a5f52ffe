"""Classifiers, the transducer and packing against plain versions of the same arithmetic; null ids, repeats and clashing names."""

import itertools
import math
import random
import time
from collections import Counter, defaultdict
from fractions import Fraction

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

WORDS = [f"{a}{b}" for a in ("ba", "ke", "li", "mo", "nu", "per", "so", "ta") for b in ("d", "lin", "n", "r", "st", "x")]


@pytest.fixture(scope="module")
def corpus(spark):
    """Good and bad, clean and toxic texts; one text and one id are null, one row is there twice."""
    rng, rows, labels = random.Random(11), [], []
    for i in range(240):
        words = [rng.choice(WORDS) for _ in range(rng.choice([3, 40, 90]))]
        junk, toxic = i % 5 == 0, i % 6 == 0
        words = [w.upper() + "!!" for w in words] if junk else words
        if toxic:
            words[1:1] = ["moron", "scumbag"]
        rows.append((i, " ".join(words), "x"))
        if i % 3:
            labels.append((i, int(not junk), int(toxic)))
    rows += [(240, None, "x"), (None, rows[7][1], "x"), rows[9], rows[9]]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3)
    return docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), rows, labels


def noise(spark, ids):
    """Gumbel noise of each id, from the hash that the operator documents."""
    rows = spark.createDataFrame([(i,) for i in ids], "i long").select("i", F.xxhash64(F.lit(1729), "i").alias("h")).collect()
    return {r.i: -math.log(-math.log((((r.h % (1 << 64)) >> 11) + 0.5) / (1 << 53))) for r in rows}


def test_quality_equals_plain_arithmetic(spark, corpus):
    from draftlake.llm import quality

    docs, labels, rows, known = corpus
    label = {i: q for i, q, _ in known}
    grams = [Counter(quality.features([(t or "").encode()])[1].tolist()) for _, t, _ in rows]
    raw, target = np.ones(1 << quality.BITS), np.ones(1 << quality.BITS)
    for (i, _, _), g in zip(rows, grams, strict=True):
        for b, n in g.items():
            raw[b] += n
            target[b] += n * (label.get(i) == 1)
    ratio = np.log(target / target.sum()) - np.log(raw / raw.sum())
    total = [sum(n * ratio[b] for b, n in g.items()) for g in grams]
    mean = [t / max(1, sum(g.values())) for t, g in zip(total, grams, strict=True)]
    of = lambda q: [m for (i, _, _), m in zip(rows, mean, strict=True) if label.get(i) == q]
    low, high = np.quantile(of(1), 0.002), np.quantile(of(0), 0.995)
    cut = (min(low, high) + low) / 2 if high < low else low
    weight = [t - cut * sum(g.values()) for t, g in zip(total, grams, strict=True)]
    extra = noise(spark, {i for i, *_ in rows})
    keys = [w + extra[i] for w, (i, _, _) in zip(weight, rows, strict=True)]
    least = sorted(keys, reverse=True)[sum(w >= 0 for w in weight) - 1]
    got = sorted((r.doc_id is None, r.doc_id or 0, r.text or "", round(r.log_weight, 6), round(r.gumbel_key, 6), r.accepted) for r in quality.resample(docs, labels).collect())
    want = sorted((i is None, i or 0, t or "", round(w, 6), round(k, 6), k >= least - 1e-9) for (i, t, _), w, k in zip(rows, weight, keys, strict=True))
    assert [g[:3] + g[5:] for g in got] == [w[:3] + w[5:] for w in want]
    assert all(abs(g[3] - w[3]) < 1e-5 and abs(g[4] - w[4]) < 1e-5 for g, w in zip(got, want, strict=True))


def test_severity_equals_plain_arithmetic(corpus):
    from draftlake.llm import toxicity

    docs, labels, rows, _ = corpus
    model = toxicity.fit(docs, labels)
    place = {w: i for i, w in enumerate(model.words.tolist())}
    got = toxicity.grade_toxicity(docs, labels).collect()
    assert len(got) == len(rows)
    for r in got:
        counts = Counter(toxicity._words([(r.text or "").encode()])[1].tolist())
        score = sum(model.weights[place[w]] * math.log1p(n) for w, n in counts.items() if w in place)
        severity = sum(1 / (1 + math.exp(-max(-40, min(40, score - t)))) for t in model.thresholds)
        assert r.expected_severity == pytest.approx(severity, abs=1e-9) and r.is_toxic == (severity >= model.severe)


def test_clashing_names(corpus):
    from draftlake.llm import line_dedup, near_copies, quality, toxicity

    docs, labels, rows, _ = corpus
    names = ["id__", "gone__", "n_lines__", "lines_of", "LINES_GONE", "lines_before", "lines_dropped", "log_weight__", "scores", "expected_severity__", "row", "label", "node"]
    wide = docs.select("*", *(F.lit(i).alias(n) for i, n in enumerate(names)))
    same = lambda a, b: a.columns == wide.columns and sorted(map(str, a.select("doc_id", "text").collect())) == sorted(map(str, b.select("doc_id", "text").collect()))
    assert same(quality.select(wide, labels), quality.select(docs, labels))
    assert same(toxicity.drop_toxic(wide, labels), toxicity.drop_toxic(docs, labels))
    assert same(line_dedup.with_kept_lines(wide), line_dedup.with_kept_lines(docs))
    assert same(near_copies.first_of_each(wide), near_copies.first_of_each(docs))


def test_markup_is_left_in_one_pass():
    from draftlake.llm.langid import text_of

    assert text_of("<p>caf&eacute; <SCRIPT>the</Script >x < y <!-- a --> z<style>b</style>") == " café  x < y   z ".encode()
    assert text_of("a<script>b") == b"a " and text_of("a<!-- b") == b"a " and text_of("a<b c") == b"a " and text_of("") == b""
    for unit in ("<script ", "<script>", "<!--", "<a ", "</script  ", "<", "&amp", "<script></script "):
        began = time.perf_counter()
        text_of(unit * ((1 << 20) // len(unit)))
        assert time.perf_counter() - began < 1


def test_language_posterior_equals_plain_arithmetic(spark):
    from draftlake.llm import langid

    rng = random.Random(3)
    own = {"de": "der und nicht ein schön über".split(), "en": "the and with this that thing".split(), "fr": "le la une avec être où".split()}
    langs = sorted(own)
    docs = [(i, " ".join(rng.choice(own[langs[i % 3]]) for _ in range(30)), langs[i % 3]) for i in range(30)]
    pages = []
    for i in range(60):
        lang = langs[i % 3]
        said = rng.choice([f' lang="{lang}"', "", ' lang="en-US"'])
        body = " ".join(rng.choice(own[lang]) for _ in range(rng.choice([0, 2, 40])))
        url = rng.choice([f"https://{rng.choice('ab')}.site{i % 4}.{rng.choice(['de', 'fr', 'com'])}/{lang}/p{i}", f"http://h{i % 5}/x", "no address", None])
        pages.append((i, url, f"<html{said}><script>le the der</script><p>{body}</p>"))
    pages += [(None, None, None), pages[5]]
    got = langid.identify(spark.createDataFrame(pages, "page_id long, url string, html string"), spark.createDataFrame(docs, "doc_id long, text string, lang string")).collect()

    def grams(text):
        low = bytes(b + 32 if 65 <= b < 91 else 32 if b in (9, 10, 11, 12, 13) else b for b in text)
        return [low[i : i + 3] for i in range(len(low) - 2) if low[i : i + 2] != b"  "]

    bucket = lambda g: int(langid.trigrams([g])[1][0])
    counts = {k: Counter() for k in langs}
    for _, t, k in docs:
        counts[k].update(map(bucket, grams(t.encode())))
    log = {k: lambda b, c=c, n=sum(c.values()) + 0.5 * (1 << langid.BITS): math.log((c[b] + 0.5) / n) for k, c in counts.items()}
    first = lambda scores: max(range(3), key=lambda j: (scores[j], -j))
    rows = []
    for i, url, page in pages:
        found = list(map(bucket, grams(langid.text_of(page or "")))) if page else []
        scale = min(1.0, langid.EVIDENCE / max(1, len(found)))
        ll = [sum(log[k](b) for b in found) * scale for k in langs]
        host = url.split("//")[1].split("/")[0] if url and "//" in url else None
        tag = next((x for x in url.split("/")[3:] if len(x) == 2 and x.isalpha()), None) if host else None
        declared = page.split('lang="')[1][:2] if page and 'lang="' in page else None
        domain = ".".join(host.split(".")[-2:]) if host else None
        rows.append((i, url, host, domain, host and host.split(".")[-1], declared, tag, ll, first(ll)))
    whole = Counter(r[8] for r in rows)
    base = [(whole[j] + 1) / (len(rows) + 3) for j in range(3)]

    def shares(place, value, prior):
        own_rows = [r for r in rows if r[place] == value]
        return [(sum(r[8] == j for r in own_rows) + langid.SMOOTH * prior[j]) / (len(own_rows) + langid.SMOOTH) for j in range(3)]

    def likelihood(place, value):
        return [math.log((sum(r[place] == value and r[8] == j for r in rows) + 0.5) / (whole[j] + 2)) if value else 0.0 for j in range(3)]

    want = []
    for i, _, host, domain, suffix, declared, tag, ll, by_text in rows:
        prior = shares(2, host, shares(3, domain, shares(4, suffix, base))) if host else base
        score = [ll[j] + math.log(prior[j]) + likelihood(5, declared)[j] + likelihood(6, tag)[j] for j in range(3)]
        want.append((i is None, i or 0, langs[by_text], langs[first(score)], 1 / sum(math.exp(s - max(score)) for s in score)))
    have = sorted((r.page_id is None, r.page_id or 0, r.by_text, r.language, r.confidence) for r in got)
    assert [h[:4] for h in have] == [w[:4] for w in sorted(want)]
    assert all(h[4] == pytest.approx(w[4], rel=1e-3) for h, w in zip(have, sorted(want), strict=True))


def test_all_languages_have_a_model(spark):
    from draftlake.llm.langid import text_models

    docs = spark.createDataFrame([(f"w{i} " * 5, f"l{i:03}") for i in range(150)], "text string, lang string")
    names, models = text_models(docs)
    assert len(names) == 150 and models.shape[0] == 150


def test_shortest_path_sums_and_minimises():
    """Weights of unigram pieces: the least sum over all segmentations, with the fallback for other characters."""
    from draftlake.llm.wfst import FALLBACK, Transducer

    rng = random.Random(6)
    pieces = {p: (i, round(rng.uniform(1, 9), 3)) for i, p in enumerate(["a", "b", "c", "ab", "bc", "abc", "ca", "cab", "bb", "abca"])}
    machine = Transducer(pieces, merges=False)
    for _ in range(200):
        word = "".join(rng.choice("abcz") for _ in range(rng.randrange(1, 9)))
        best = math.inf
        for cuts in itertools.product([0, 1], repeat=len(word) - 1):
            parts, start = [], 0
            for i, c in enumerate([*cuts, 1], 1):
                if c:
                    parts.append(word[start:i])
                    start = i
            costs = [pieces[p][1] if p in pieces else FALLBACK if len(p) == 1 else math.inf for p in parts]
            best = min(best, sum(costs))
        path, weight = machine.path(word)
        assert "".join(path) == word and weight == pytest.approx(best)
        assert sum(pieces[p][1] if p in pieces else FALLBACK for p in path) == pytest.approx(best)


def test_transitions_of_merges_and_bad_ids(spark):
    from draftlake.llm.wfst import INFINITE, decode_ids, encode_texts, transducer

    machine = transducer(public_tokenizers.path("piece_bpe_32k.model"))
    path, weight = machine.path("▁international")
    assert all(machine.transition(a, b) == 0 for a, b in itertools.pairwise(["", *path])) and weight == sum(machine.piece[p][1] for p in path)
    assert machine.transition("▁", "t") == INFINITE  # these merge
    ids = machine.encode("hello")
    assert machine.decode(ids + b"\xff\xff\xff\x7f" + b"\x01\x02") == "hello ⁇ "
    rows = [(None, "one two"), (1, None), (2, "one two"), (2, "one two"), (3, "x" * 200_000 + " y")]
    got = decode_ids(encode_texts(spark.createDataFrame(rows, "doc_id long, text string"))).collect()
    assert sorted((r.doc_id is None, r.doc_id or 0, r.text) for r in got) == sorted((i is None, i or 0, t or "") for i, t in rows)
    assert decode_ids(spark.createDataFrame([(1, None)], "doc_id long, ids binary")).first().text == ""


def sequential(totals, length):
    """Tokens of each queue in each window, by a deficit round-robin that goes from window to window."""
    total, deficit, left, out = sum(totals), [Fraction(0)] * len(totals), list(totals), []
    while any(left):
        window = [0] * len(totals)
        for s, n in enumerate(totals):
            deficit[s] += Fraction(n * length, total)
            window[s] = min(left[s], int(deficit[s]))
            deficit[s] -= window[s]
            left[s] -= window[s]
        out.append(window)
        if len(out) > total // length + 2:
            break
    return out


def test_packing_keeps_deficits_under_a_token(spark):
    """As much as a sequential round-robin has sent after each window, to a token; small sources take longer turns."""
    from draftlake.llm.packing import pack

    rng, rows = random.Random(4), []
    sizes = {"hot": 3000, "b": 1500, "c": 1100, **{f"small{i}": 60 + i for i in range(30)}}
    for source, words in sizes.items():
        while words > 0:
            n = min(words, rng.randrange(1, 60))
            rows.append((len(rows), " ".join(rng.choice("abcdefgh") for _ in range(n)), source))
            words -= n
    rng.shuffle(rows)
    length = 512
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(3), length=length).collect()
    source_of, totals = {i: s for i, _, s in rows}, Counter()
    sent = defaultdict(Counter)
    for p in got:
        totals[source_of[p.doc_id]] += p.length
        sent[p.sequence_id][source_of[p.doc_id]] += p.length
    big = ["b", "c", "hot"]
    queues = [totals[s] for s in big] + [sum(n for s, n in totals.items() if s.startswith("small"))]
    mine, other, have = [0] * 4, [0] * 4, sequential(queues, length)
    for w in range(len(sent) - 1):
        assert sum(sent[w].values()) == length
        for q, s in enumerate([*big, None]):
            mine[q] += sum(n for k, n in sent[w].items() if k == s or (s is None and k.startswith("small")))
            other[q] += have[w][q]
            assert abs(mine[q] - other[q]) <= 1
    # in their shared queue small sources alternate: halfway each has sent about a half
    half = Counter()
    for w in range(len(sent) // 2):
        half.update(sent[w])
    share = [half[s] / totals[s] for s in totals if s.startswith("small")]
    assert 0.2 < sum(share) / len(share) < 0.8
    assert len(got) < len(rows) + sum(totals.values()) / 16


def test_small_sources_take_turns(spark):
    """300 equal sources: a shared queue within a shared queue, every source spread over the sequences."""
    from draftlake.llm.packing import pack

    rows = [(i, " ".join("abcdefgh"[(i + j) % 8] for j in range(149)), f"s{i % 300:03}") for i in range(1200)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(2), length=1024).collect()
    windows, seen = max(p.sequence_id for p in got) + 1, defaultdict(set)
    for p in got:
        seen[f"s{p.doc_id % 300:03}"].add(p.sequence_id * 4 // windows)
    assert sum(p.length for p in got) == 1200 * 150 and sum(len(q) >= 3 for q in seen.values()) > 0.9 * len(seen)


def test_packing_with_another_tokenizer_and_null_ids(spark):
    from tokenizers import Tokenizer

    from draftlake.llm.packing import pack

    path = public_tokenizers.path("byte_bpe_50k.json")
    texts = ["Hello big world\n\nagain", "  two  blanks ", "", None, "日本 x", "same", "same"]
    rows = [(i if i < 4 else None if i == 4 else 6, t, None) for i, t in enumerate(texts)]
    got = pack(spark.createDataFrame(rows, "doc_id long, text string, source string"), tokenizer=path, length=16).collect()
    library = Tokenizer.from_file(path)
    for i in (0, 1, 2, 3, None):
        parts = sorted((p.start, bytes(p.ids)) for p in got if p.doc_id == i)
        text = next(t for j, t, _ in rows if j == i) or ""
        assert np.frombuffer(b"".join(x for _, x in parts), "<u4").tolist() == [*library.encode(text, add_special_tokens=False).ids, 2]
    assert sum(p.length for p in got if p.doc_id == 6) == 2 * (len(library.encode("same").ids) + 1)


def test_repeated_rows_and_ids(spark):
    from draftlake.llm.line_dedup import dedup_lines
    from draftlake.llm.simhash import near_duplicates

    text = "a line of some length\nanother line of some length"
    rows = [(1, text), (1, text), (2, text), (None, text), (None, text), (3, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted((r.doc_id is None, r.doc_id or 0, r.kept) for r in dedup_lines(docs).collect())
    assert kept == sorted([(False, 1, text), (False, 1, text), (False, 2, ""), (True, 0, text), (True, 0, text), (False, 3, "short")])
    found = sorted((r.doc_id is None, r.doc_id or 0, r.component_id) for r in near_duplicates(docs).collect())
    assert found == sorted([(False, 1, 1), (False, 1, 1), (False, 2, 1), (True, 0, 1), (True, 0, 1), (False, 3, 3)])


def test_repeated_vectors_and_ties(spark):
    from draftlake.llm.ann import nearest
    from draftlake.llm.topk import top_k

    data = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (1, [3.0, 0.0]), (2, [2.0, 0.0]), (3, [2.0, 0.0]), (4, [2.0, 0.0]), (5, [1.0, 0.0, 9.0])]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    best = sorted((r.rank, r.vec_id, r.score) for r in top_k(table, 3, 10).collect())
    assert best == [(1, 1, 256 * 768), (2, 1, 256 * 512), (3, 2, 256 * 512)]
    near = sorted((r.rank, r.vec_id, r.score) for r in nearest(table, 3, 10).collect())
    assert near == [(1, 1, 1.0), (2, 2, 1.0), (3, 3, 1.0)]


def test_wide_golay_keys_find_similar_texts():
    """Recall of the candidate keys on random sets of a similarity just above 0.8, without the join."""
    from draftlake.llm import near_copies as N

    rng = np.random.default_rng(12)
    pairs = []
    for _ in range(400):
        n = int(rng.integers(30, 400))
        base = rng.integers(-(1 << 63), 1 << 63, n + n // 4, dtype=np.int64)
        pairs.append((np.unique(base[: n]), np.unique(base[n // 10 : n + n // 10])))
    codes = [N.soft_codes(N.sums([p[i] for p in pairs])) for i in range(2)]
    assert ((codes[0] == codes[1]).sum(1) >= 2).mean() >= 0.98
    assert N.soft_codes(N.sums([np.empty(0, np.int64)])).shape == (1, N.PARTS)
