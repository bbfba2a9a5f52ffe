"""Preparation of a model run: what blocks it, which targets fall out at which stage, and ids of its dataset and split that training must meet again.

Ids are roots of hash trees over the rows (``merkle``), so a dry run and a training run agree only if every pair and every place in the split does. Nothing is
fitted or saved before they do.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from draftlake.operators import dataset as D
from draftlake.operators import merkle
from draftlake.operators import runs as R
from draftlake.operators.split import temporal_split
from draftlake.session import settled

# Reasons, and states of a run.
UNKNOWN_GAME, SNAPSHOT_MISMATCH, END_UNVERIFIED, POLICY_SET = "E_CUTOFF_UNKNOWN_GAME_ID", "E_EVIDENCE_SNAPSHOT_MISMATCH", "E_END_PROVENANCE_UNVERIFIED", "E_CUTOFF_POLICY_SET_INVALID"
CONTEXT_MISSING, CONTEXT_UNVERIFIED, CONTEXT_MISMATCH, NOT_BEFORE_START = "E_PRE_CONTEXT_MISSING", "E_PRE_CONTEXT_UNVERIFIED", "E_PRE_CONTEXT_MISMATCH", "E_CUTOFF_NOT_BEFORE_START"
APPROVAL_MISSING, ID_MISMATCH = "E_PROTOCOL_APPROVAL_REFERENCE_MISSING", "E_DRY_RUN_ID_MISMATCH"
NO_TARGETS, BLOCKED, READY, DRY_RUN_READY, TRAINED, NO_SPLIT = "NO_ELIGIBLE_TARGETS", "BLOCKED", "READY", "DRY_RUN_READY", "TRAINED", "SPLIT_FAILED"
CONTEXT = ("game_id", "blue_team_id", "red_team_id", "blue_roster", "red_roster", "patch")


def context_digest(matches: DataFrame) -> Column:
    """SHA-256 of what is known of a match before its draft: teams, rosters in the order of roles, patch."""
    rosters = [F.to_json(F.struct(F.sort_array(c).alias("r"))) for c in ("blue_roster", "red_roster")]
    parts = [*(F.col(c) for c in CONTEXT[:3]), *rosters, F.col("patch")]
    return F.sha2(F.concat_ws("\x1f", *(F.coalesce(p, F.lit("<NULL>")) for p in parts)), 256)


def snapshot_digest(matches: DataFrame) -> str:
    """The root over all matches of a snapshot, by id."""
    return merkle.root(merkle.tree(matches, ["game_id"]))[0]


def retrospective_evidence(matches: DataFrame, proofs: DataFrame, approval_ref: str) -> tuple[dict, DataFrame]:
    """(document, records) of the protocol that assumes a cutoff at midnight UTC of the day before each proven start.

    ``proofs`` are those of ``evidence.resolve_proofs``; a match without one has no record.
    """
    if not approval_ref or approval_ref != approval_ref.strip():
        raise ValueError(APPROVAL_MISSING)
    digest = snapshot_digest(matches)
    rows = matches.join(proofs.select("game_id", F.col("started_at").alias("proven_start")), "game_id")
    cutoff = F.date_trunc("DAY", "proven_start") - F.expr("INTERVAL 1 DAY")
    records = rows.select(
        "game_id", cutoff.alias("history_cutoff_at"), F.concat(F.lit(f"protocol:{D.RETROSPECTIVE}:"), "game_id").alias("evidence_ref"), F.lit(D.RETROSPECTIVE).alias("policy_version"),
        F.lit("PROTOCOL_ASSUMED").alias("verification"), context_digest(matches).alias("pre_context_sha256"), F.concat(F.lit(f"snapshot:{digest}:"), "game_id").alias("pre_context_evidence_ref"),
        F.lit("RECONSTRUCTED_POSTGAME").alias("pre_context_verification"),
    )
    return {"evaluation_protocol": D.RETROSPECTIVE, "snapshot_sha256": digest, "approval_ref": approval_ref, "ended_at_verification": "PROVEN"}, records


@dataclass
class Plan:
    """A prepared run: its status, (reason, game_id) of blockers, (stage, game_id, reason) of exclusions, pairs and split (None before they are made), and the ids."""

    status: str
    blockers: DataFrame
    exclusions: DataFrame
    pairs: DataFrame | None = None
    split: DataFrame | None = None
    dataset_id: str | None = None
    split_id: str | None = None
    report: dict = field(default_factory=dict)


def context_reason(protocol: str) -> Column:
    """Why a record does not vouch for the context of its match, null if it does."""
    needed = "RECONSTRUCTED_POSTGAME" if protocol == D.RETROSPECTIVE else "VERIFIED_EXTERNALLY"
    told = ("pre_context_sha256", "pre_context_evidence_ref", "pre_context_verification")
    missing = reduce(lambda a, b: a | b, (F.col(c).isNull() for c in told))
    return D.first_reason(
        (missing, CONTEXT_MISSING), (F.col("pre_context_verification") != needed, CONTEXT_UNVERIFIED), (F.col("pre_context_sha256") != F.col("context__"), CONTEXT_MISMATCH),
        (F.col("started_at").isNotNull() & (F.col("history_cutoff_at") >= F.col("started_at")), NOT_BEFORE_START),
    )


def prepare(matches: DataFrame, document: dict, records: DataFrame, approved: list[str], champions: list[str] | None = None, protocol: str = D.STRICT, **windows: int) -> Plan:
    """Prepare a run over the matches of a snapshot (``snapshot.matches``, with ``started_at``).

    Blockers: records of unknown matches, a document of another snapshot, ends that nobody vouches for. Targets fall out at INPUT (cutoff, context), DATASET (``paired_dataset``) or
    SPLIT (their label is known too late). With blockers, or without targets, no dataset is made.
    """
    if not approved or any(not v or v != v.strip() for v in approved):
        raise ValueError(POLICY_SET)
    spark = matches.sparkSession
    matches, records = settled(matches, "run-matches"), settled(records, "run-records")
    text = lambda n, v: F.lit(v).cast("string").alias(n)
    blockers = [records.join(matches, "game_id", "left_anti").select(text("reason", UNKNOWN_GAME), "game_id").distinct()]
    digest = snapshot_digest(matches)
    singles = [(SNAPSHOT_MISMATCH, None)] * (document.get("snapshot_sha256") != digest)
    singles += [(END_UNVERIFIED, None)] * (protocol == D.STRICT and document.get("ended_at_verification") != "VERIFIED_EXTERNALLY")
    blockers = settled(reduce(DataFrame.union, [*blockers, spark.createDataFrame(singles, "reason string, game_id string")]), "run-blockers")

    cutoffs = D.resolve_cutoffs(matches, records, approved, protocol)
    vouched = ("pre_context_sha256", "pre_context_evidence_ref", "pre_context_verification")
    told = records.groupBy("game_id").agg(*(F.max(c).alias(c) for c in vouched))
    own = matches.select("game_id", "started_at", context_digest(matches).alias("context__"))
    judged = cutoffs.join(own, "game_id").join(told, "game_id", "left").withColumn("reason", F.coalesce("reason", context_reason(protocol)))
    judged = settled(judged.select("game_id", "history_cutoff_at", "reason"), "run-input")
    excluded = [judged.where("reason IS NOT NULL").select(text("stage", "INPUT"), "game_id", "reason")]
    eligible = judged.where("reason IS NULL").select("game_id")
    n = {"source_games": matches.count(), "eligible": eligible.count(), "blockers": blockers.count()}
    report = n | {"snapshot_sha256": digest, "protocol": protocol, "approved_policy_versions": sorted(approved)}
    every = lambda: settled(reduce(DataFrame.union, excluded), "run-exclusions")
    if not n["eligible"] or n["blockers"]:
        return Plan(NO_TARGETS if not n["eligible"] else BLOCKED, blockers, every(), report=report)

    targets = matches.join(eligible, "game_id", "left_semi")
    pairs, left_out = D.paired_dataset(targets, records.join(eligible, "game_id", "left_semi"), matches, approved, champions, protocol, **windows)
    pairs = settled(pairs, "run-pairs")
    excluded.append(left_out.select(text("stage", "DATASET"), "game_id", "reason"))
    split = temporal_split(pairs.select("game_id", "y_blue_win", "history_cutoff_at", "target_ended_at"), "history_cutoff_at", "target_ended_at")
    split = settled(split.select("game_id", "y_blue_win", "partition", "purged"), "run-split")
    excluded.append(split.where("purged").select(text("stage", "SPLIT"), "game_id", text("reason", "E_LABEL_AFTER_BOUNDARY")))
    problems = [(r.problem, r.n) for r in R.split_issues(split, pairs.select("game_id")).collect()]  # five kinds at most
    report |= {"paired_samples": pairs.count(), "split_problems": problems}
    if problems:
        return Plan(NO_SPLIT, blockers, every(), pairs, split, report=report)
    ids = [merkle.root(merkle.tree(df, ["game_id"]))[0] for df in (pairs, split)]
    return Plan(READY, blockers, every(), pairs, split, f"dataset:{ids[0]}", f"split:{ids[1]}", report)


def execute(plan: Plan, root: str, train: bool = False, expected: tuple[str, str] | None = None, fit: Callable = R.fit_candidates, families: tuple[str, ...] = R.FAMILIES) -> dict:
    """The report of a run. A dry run tells the ids of dataset and split; training needs them as ``expected`` and fits, tests and publishes a bundle only if they are the plan's."""
    report = plan.report | {"status": plan.status, "dataset_id": plan.dataset_id, "split_id": plan.split_id, "mode": "TRAIN" if train else "DRY_RUN"}
    if plan.status != READY:
        return report
    if not train:
        return report | {"status": DRY_RUN_READY}
    if expected != (plan.dataset_id, plan.split_id):
        return report | {"status": BLOCKED, "reason": ID_MISMATCH}
    spark = plan.pairs.sparkSession
    if R.bundle_exists(spark, root):
        raise FileExistsError(f"E_MODEL_ARTIFACT_EXISTS: {root}")
    part = lambda name: plan.pairs.join(plan.split.where((F.col("partition") == name) & ~F.col("purged")).select("game_id"), "game_id")
    fitted, selected = fit(part("train"), part("validation"), families=families)
    tested = {phase: R.evaluate(model, R.model_frame(part("test"), phase)).first().asDict() for (family, phase), model in fitted.items() if family == selected}
    R.publish_bundle(spark, root, fitted, selected, plan.dataset_id)
    return report | {"status": TRAINED, "selected_family": selected, "test_metrics": tested}
