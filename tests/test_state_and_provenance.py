"""Activity over a stream against the whole log, imports that are run again, and provenance."""

import json
import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from draftlake.operators import evaluate as E
from draftlake.operators import provenance as P
from draftlake.streaming import activity as A
from draftlake.streaming import imports as I

START = datetime(2025, 1, 1)


def events(rng, n):
    """Evaluations of a few subjects with what takes them back, in no order of time."""
    out, known = [], {}
    for i in range(n):
        subject = f"s{rng.randrange(4)}"
        kind = rng.choice(["PRE", "PRE", "POST", "POST", "POST", "INVALIDATE", "CONTEXT"])
        at = START + timedelta(minutes=rng.randrange(500))
        pre, all_ = known.setdefault(subject, ([], []))
        eid = parent = None
        if kind in ("PRE", "POST"):
            eid = f"e{i:03}"
            parent = rng.choice(pre) if kind == "POST" and pre else None
            (pre if kind == "PRE" else all_).append(eid)
        elif kind == "INVALIDATE":
            if not pre + all_:
                continue
            eid = rng.choice(pre + all_)
        elif rng.random() < 0.7:
            continue
        out.append({"kind": kind, "subject_id": subject, "model_id": "m", "evaluation_id": eid, "parent_id": parent, "created_at": at.isoformat(sep=" ")})
    return out


def expected_active(spark, log):
    df = spark.createDataFrame([tuple(r.values()) for r in log], "kind string, subject_id string, model_id string, evaluation_id string, parent_id string, created_at string").withColumn("created_at", F.col("created_at").cast("timestamp"))
    saved = df.where("kind IN ('PRE', 'POST')").withColumnRenamed("kind", "phase")
    since = df.where("kind = 'CONTEXT'").groupBy("subject_id", "model_id").agg(F.max("created_at").alias("since"))
    stale = saved.join(since, ["subject_id", "model_id"]).where("created_at < since").select("evaluation_id")
    rows = E.with_activity(saved, df.where("kind = 'INVALIDATE'").select("evaluation_id").union(stale)).where("is_active")
    return {(r.subject_id, r.phase, r.evaluation_id) for r in rows.collect()}


def test_activity_of_a_stream_is_that_of_the_log_also_after_restarts(spark, tmp_path):
    rng = random.Random(6)
    log = events(rng, 120)
    folder, done = tmp_path / "events", []
    folder.mkdir()
    for k in range(3):
        part = log[k * 40 : (k + 1) * 40]
        done += part
        (folder / f"{k}.json").write_text("\n".join(map(json.dumps, part)))
        stream = spark.readStream.schema(A.EVENT).json(f"file://{folder}")
        A.start(spark, stream, f"file://{tmp_path}/changes", f"file://{tmp_path}/checkpoint").awaitTermination()  # a new query each time
        got = {(r.subject_id, r.phase, r.evaluation_id) for r in A.active(spark.read.parquet(f"file://{tmp_path}/changes")).collect()}
        assert got == expected_active(spark, done)
    assert got


ROW = "idempotency_key string, content_sha256 string, created_at timestamp, p double"


def batch(spark, *keys, p=0.5, content="c"):
    return spark.createDataFrame([(k, f"{content}-{k}", START, p) for k in keys], ROW)


def test_imports_run_again_write_nothing_twice(spark, tmp_path, monkeypatch):
    ledger = I.Ledger(spark, f"file://{tmp_path}/ledger", ROW)
    keys = lambda: sorted(r.idempotency_key for r in ledger.rows().collect())
    assert ledger.import_batch(batch(spark, "a", "b"), 0) == I.IMPORTED and keys() == ["a", "b"]
    assert ledger.import_batch(batch(spark, "a", "b", p=0.5 + 1e-14), 0) == I.VERIFIED and keys() == ["a", "b"]
    with pytest.raises(I.ImportError_, match=I.MISMATCH):
        ledger.import_batch(batch(spark, "a", "b", p=0.6), 0)
    with pytest.raises(I.ImportError_, match=I.MISMATCH):
        ledger.import_batch(batch(spark, "a", "z"), 0)
    with pytest.raises(I.ImportError_, match=E.STORAGE_CONFLICT):
        ledger.import_batch(batch(spark, "b", "c", content="other"), 1)
    assert keys() == ["a", "b"]

    def killed(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:  # after the write, before the ledger
        m.setattr(I.Log, "add", killed)
        with pytest.raises(KeyboardInterrupt):
            ledger.import_batch(batch(spark, "b", "c"), 1)
    assert keys() == ["a", "b"]
    assert ledger.import_batch(batch(spark, "b", "c"), 1) == I.IMPORTED and keys() == ["a", "b", "c"]
    assert len(list((tmp_path / "ledger/batches").iterdir())) == 3

    real = I.Log.add
    with monkeypatch.context() as m:  # another import gets the number first

        def late(log, number, entry):
            m.setattr(I.Log, "add", real)
            I.Ledger(spark, f"file://{tmp_path}/ledger", ROW).import_batch(batch(spark, "d"), 0, "other")
            return real(log, number, entry)

        m.setattr(I.Log, "add", late)
        assert ledger.import_batch(batch(spark, "d", "e"), 2) == I.IMPORTED
    assert keys() == ["a", "b", "c", "d", "e"]


def test_a_stream_is_imported_batch_by_batch(spark, tmp_path):
    source = tmp_path / "in"
    for k in range(2):
        batch(spark, f"k{k}", "same").coalesce(1).write.mode("append").parquet(f"file://{source}")
    ledger = I.Ledger(spark, f"file://{tmp_path}/ledger", ROW)
    stream = spark.readStream.schema(ROW).option("maxFilesPerTrigger", 1).parquet(f"file://{source}")
    for checkpoint in ("one", "one", "two"):  # the same again, and from the start with its checkpoint lost
        I.start(ledger, stream, f"file://{tmp_path}/{checkpoint}").awaitTermination()
        assert sorted(r.idempotency_key for r in ledger.rows().collect()) == ["k0", "k1", "same"]
    assert ledger.log.latest() == 2


def graph():
    nodes = {("prediction", f"p{i}"): f"dp{i}" for i in range(4)} | {("model", "m"): "dm", ("model", "m2"): "dm2", ("dataset", "d"): "dd", ("split", "s"): "ds", ("evidence", "e"): "de", ("evidence", "e2"): "de2", ("file", "f"): "df"}
    links = [("prediction", f"p{i}", r, r, t) for i in range(4) for r, t in (("model", "m" if i < 2 else "m2"), ("dataset", "d"), ("split", "s"))]
    links += [("model", m, r, r, t) for m in ("m", "m2") for r, t in (("dataset", "d"), ("split", "s"))]
    links += [("split", "s", "dataset", "dataset", "d"), ("dataset", "d", "evidence", "evidence", "e"), ("evidence", "e", "file", "file", "f"), ("evidence", "e2", "file", "file", "f")]
    return nodes, [(*x, nodes[x[3], x[4]]) for x in links]


def faults(spark, nodes, links):
    a = spark.createDataFrame([(*k, d) for k, d in nodes.items()], "kind string, id string, digest string")
    b = spark.createDataFrame(links, "kind string, id string, role string, to_kind string, to_id string, to_digest string")
    return {tuple(r) for r in P.unsound(a, b).collect()}


def test_each_altered_link_is_named(spark):
    nodes, links = graph()
    assert faults(spark, nodes, links) == set()
    everyone = [f"p{i}" for i in range(4)]
    assert faults(spark, nodes | {("file", "f"): "new"}, links) == {(p, "evidence", "e", "file", P.ALTERED) for p in everyone}
    assert faults(spark, {k: d for k, d in nodes.items() if k != ("model", "m2")}, links) == {(p, "prediction", p, "model", P.MISSING) for p in ("p2", "p3")}
    assert faults(spark, nodes, [x for x in links if x[:3] != ("model", "m", "split")]) == {(p, "model", "m", "split", P.ROLE_MISSING) for p in ("p0", "p1")}
    twice = [*links, ("model", "m2", "split", "split", "s", "other")]
    assert faults(spark, nodes, twice) == {(p, "model", "m2", "split", c) for p in ("p2", "p3") for c in (P.AMBIGUOUS, P.ALTERED)}
    loop = [*links, ("file", "f", "made_from", "dataset", "d", "dd")]
    assert {x[4] for x in faults(spark, nodes, loop)} == {P.CYCLE} and len(faults(spark, nodes, loop)) == 4 * 3


def test_a_seal_breaks_with_anything_it_stands_for(spark):
    rows = [(f"g{i}", "A", "B", "15.01", START, 0.5 + i / 100, 0.25, [f"W{i}"]) for i in range(6)]
    scored = spark.createDataFrame(rows, "game_id string, blue_team_id string, red_team_id string, patch string, history_cutoff_at timestamp, p double, form double, warnings array<string>")
    made = E.create(scored, "m", "PRE").join(scored.select("game_id", "form", "warnings"), "game_id")
    pre = E.sealed(made, ["form"])
    assert E.incompatible(pre, ["form"]).count() == 0
    when = lambda c, i, v: F.when(F.col("game_id") == f"g{i}", v).otherwise(F.col(c))
    torn = pre.withColumns({"p": when("p", 0, F.lit(0.9)), "form": when("form", 1, F.lit(None)), "warnings": when("warnings", 2, F.array(F.lit("x"))), "patch": when("patch", 3, F.lit("15.02")), "phase": when("phase", 4, F.lit("POST"))})
    ids = {r.evaluation_id: r.game_id for r in pre.collect()}
    assert {ids[r.evaluation_id] for r in E.incompatible(torn, ["form"]).collect()} == {"g0", "g1", "g2", "g3", "g4"}
