"""Preparation of runs: blockers, exclusions by stage, dry-run ids that training must meet."""

from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F
from test_dataset import SCHEMA, match

from draftlake.operators import dataset as D
from draftlake.operators import preparation as P

START = datetime(2025, 7, 1)


@pytest.fixture(scope="module")
def matches(spark):
    rows = [match(f"t{i:02}", "A", "B", "B" if i % 3 == 0 else "A", START + timedelta(days=i, hours=14), None) for i in range(30)]
    return spark.createDataFrame(rows, SCHEMA).drop("history_cutoff_at").withColumn("started_at", F.col("ended_at") - F.expr("INTERVAL 1 HOUR"))


def evidence(matches, **over):
    rows = matches.select(
        "game_id", (F.date_trunc("DAY", "started_at")).alias("history_cutoff_at"), F.lit("ref").alias("evidence_ref"), F.lit("p1").alias("policy_version"), F.lit("VERIFIED_EXTERNALLY").alias("verification"),
        P.context_digest(matches).alias("pre_context_sha256"), F.lit("ref").alias("pre_context_evidence_ref"), F.lit("VERIFIED_EXTERNALLY").alias("pre_context_verification"),
    )
    for c, (i, v) in over.items():
        rows = rows.withColumn(c, F.when(F.col("game_id") == i, v).otherwise(F.col(c)))
    return {"snapshot_sha256": P.snapshot_digest(matches), "ended_at_verification": "VERIFIED_EXTERNALLY"}, rows


def test_blockers_come_before_any_dataset(spark, matches):
    document, records = evidence(matches)
    stray = records.limit(1).withColumn("game_id", F.lit("zz"))
    plan = P.prepare(matches, document | {"snapshot_sha256": "other", "ended_at_verification": None}, records.union(stray), ["p1"])
    assert plan.status == P.BLOCKED and plan.pairs is None
    assert {tuple(r) for r in plan.blockers.collect()} == {(P.UNKNOWN_GAME, "zz"), (P.SNAPSHOT_MISMATCH, None), (P.END_UNVERIFIED, None)}
    assert P.prepare(matches, document, records, ["p2"]).status == P.NO_TARGETS
    with pytest.raises(ValueError, match=P.POLICY_SET):
        P.prepare(matches, document, records, [" p1"])


def test_dry_run_ids_must_be_met_before_anything_is_fitted(spark, matches, tmp_path):
    late = F.lit(START + timedelta(days=90))
    document, records = evidence(matches, pre_context_sha256=("t01", F.lit("x")), pre_context_verification=("t02", F.lit("UNVERIFIED")), pre_context_evidence_ref=("t03", F.lit(None)), history_cutoff_at=("t04", late), verification=("t05", F.lit("UNVERIFIED")))
    plan = P.prepare(matches, document, records, ["p1"])
    found = {r.game_id: (r.stage, r.reason) for r in plan.exclusions.collect()}
    assert {i: found[i] for i in ("t01", "t02", "t03", "t04", "t05")} == {
        "t01": ("INPUT", P.CONTEXT_MISMATCH), "t02": ("INPUT", P.CONTEXT_UNVERIFIED), "t03": ("INPUT", P.CONTEXT_MISSING), "t04": ("INPUT", P.NOT_BEFORE_START), "t05": ("INPUT", "E_CUTOFF_UNVERIFIED"),
    }
    assert plan.status == P.READY and plan.report["paired_samples"] == 25
    again = P.prepare(matches.orderBy(F.desc("game_id")), document, records.repartition(3), ["p1"])
    assert (again.dataset_id, again.split_id) == (plan.dataset_id, plan.split_id)
    changed = matches.withColumn("winner_team_id", F.when(F.col("game_id") == "t20", "B").otherwise(F.col("winner_team_id")))
    other = P.prepare(changed, document | {"snapshot_sha256": P.snapshot_digest(changed)}, records, ["p1"])
    assert other.status == P.READY and other.dataset_id != plan.dataset_id

    calls = []

    def fit(*a, **k):
        calls.append(1)
        return P.R.fit_candidates(*a, **k, phases=("PRE",))

    root = f"file://{tmp_path}/bundle"
    run = lambda **k: P.execute(plan, root, fit=fit, families=("baseline",), **k)
    dry = run()
    assert dry["status"] == P.DRY_RUN_READY and run(train=True, expected=("a", "b"))["reason"] == P.ID_MISMATCH and not calls and not (tmp_path / "bundle").exists()
    done = run(train=True, expected=(dry["dataset_id"], dry["split_id"]))
    assert done["status"] == P.TRAINED and done["selected_family"] == "baseline" and set(done["test_metrics"]) == {"PRE"} and calls == [1]
    with pytest.raises(FileExistsError):
        run(train=True, expected=(dry["dataset_id"], dry["split_id"]))


def test_retrospective_evidence(spark, matches):
    proofs = matches.where("game_id <> 't07'").select("game_id", "started_at")
    with pytest.raises(ValueError, match=P.APPROVAL_MISSING):
        P.retrospective_evidence(matches, proofs, " x")
    document, records = P.retrospective_evidence(matches, proofs, "approval-1")
    row = records.where("game_id = 't00'").first()
    assert row.history_cutoff_at == START - timedelta(days=1) and records.count() == 29
    plan = P.prepare(matches, document, records, [D.RETROSPECTIVE], protocol=D.RETROSPECTIVE)
    assert {r.game_id: r.reason for r in plan.exclusions.where("stage = 'INPUT'").collect()} == {"t07": "E_CUTOFF_MISSING"} and plan.blockers.count() == 0
    assert P.prepare(matches, document, records, [D.RETROSPECTIVE]).status in (P.NO_TARGETS, P.BLOCKED)
