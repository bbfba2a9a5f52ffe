"""The audit's, dataset's and evaluations' corner cases of the second verdict, and history of hot keys."""

import random
from datetime import datetime, timedelta

from conftest import match_rows
from pyspark.sql import functions as F
from test_dataset import DAY, SCHEMA, match, records, targets

from draftlake.operators import dataset as D
from draftlake.operators import evaluate as E
from draftlake.operators import history as H
from draftlake.operators import quality as Q

START = datetime(2025, 1, 1)


def test_history_of_a_hot_key_by_stretches(spark):
    rng = random.Random(4)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), START + timedelta(hours=rng.randrange(120)) if rng.random() < 0.95 else None, f"g{i}", i) for i in range(400)]
    history = spark.createDataFrame(rows, "team string, ended_at timestamp, game_id string, v int")
    asked = spark.createDataFrame([(t, START + timedelta(hours=h), h) for t in ("hot", "a", "b", None) for h in range(-3, 125, 4)] + [("hot", START, 0)], "team string, cutoff timestamp, h int")
    for n in (1, 3, 40):
        states = {"ids": F.collect_list("game_id"), "n": F.count(F.lit(1)), "two": (min(2, n), F.sum("v"))}
        plain = H.last_n_before(history, asked, ["team"], n, states)
        cut = H.last_n_before(history, asked, ["team"], n, states, bucket_rows=15)
        assert plain.columns == cut.columns == [*asked.columns, "ids", "n", "two"]
        key = lambda r: (r.team or "", r.h)
        assert sorted(map(tuple, plain.collect()), key=str) == sorted(map(tuple, cut.collect()), key=str)
        own = [(e, g) for t, e, g, _ in rows if t == "hot" and e]
        for r in sorted(cut.where("team = 'hot'").collect(), key=key):
            seen = sorted((x for x in own if x[0] < r.cutoff), key=lambda x: (x[0], [-ord(c) for c in x[1]]))
            latest = sorted(sorted((x for x in own if x[0] < r.cutoff), key=lambda x: x[1]), key=lambda x: x[0], reverse=True)[:n]
            assert (r.ids or []) == [g for _, g in latest[::-1]] and (r.n or 0) == min(n, len(seen))


def test_a_hot_key_is_worked_on_in_stretches(spark):
    rows = spark.range(2000).select(F.lit("hot").alias("team"), F.timestamp_seconds("id").alias("ended_at"), F.concat(F.lit("g"), "id").alias("game_id"))
    own, _ = H.by_stretches(rows, rows.withColumnRenamed("ended_at", "cutoff"), ["team"], 5, "ended_at", "game_id", "cutoff", 100)
    sizes = [r.n for r in own.groupBy("stretch__").agg(F.count(F.lit(1)).alias("n")).collect()]
    assert len(sizes) == 20 and max(sizes) <= 100 + 5 + 20


def test_a_null_end_does_not_hide_a_contradiction(spark):
    history = spark.createDataFrame([match("h1", "A", "B", "A", DAY), match("h4", "A", "B", "A", None)], SCHEMA)
    wrong = spark.createDataFrame([match("h1", "A", "B", "B", DAY), match("h4", "A", "B", "B", DAY + timedelta(days=90))], SCHEMA)
    asked = targets(spark, 3).union(wrong).drop("history_cutoff_at")
    for past in (history, history.where("ended_at IS NOT NULL")):
        found = {r.game_id: r.reason for r in D.paired_dataset(asked, records(spark, ["t00", "t01", "t02"]), past, ["p1"])[1].collect()}
        assert {found[f"t0{i}"] for i in range(3)} == {"E_SOURCE_CONFLICT"}


def test_a_feed_without_an_end_column_has_one_more_issue(feed):
    rows = [{k: v for k, v in r.items() if k != "ended_at"} for r in match_rows()]
    issues, skipped = Q.audit(feed(rows))
    assert [(r.gameid, r.issue_code, r.issue_group, r.severity) for r in issues.collect()] == [(None, "MISSING_EXPLICIT_GAME_END_TIME", "TIME", "WARNING")] and not skipped


def test_two_contents_under_one_key_in_a_batch_are_a_conflict(spark):
    kind = "evaluation_id int, idempotency_key string, content_sha256 string, created_at timestamp"
    at = lambda h: START + timedelta(hours=h)
    new = spark.createDataFrame([(1, "k1", "a", at(2)), (2, "k1", "b", at(1)), (3, "k2", "c", at(1)), (4, "k2", "c", at(2)), (5, "k3", "d", at(1))], kind)
    stored = spark.createDataFrame([(9, "k3", "x", at(0))], kind)
    rows, conflicts = E.save(new, stored)
    assert sorted(r.evaluation_id for r in rows.collect()) == [2, 3]
    assert sorted((r.idempotency_key, r.code) for r in conflicts.collect()) == [("k1", E.STORAGE_CONFLICT), ("k3", E.STORAGE_CONFLICT)]


def test_the_audit_in_few_passes_is_the_union_of_its_rules(spark, feed):
    rng = random.Random(9)
    rows = []
    for g in range(40):
        own = [dict(r) for r in match_rows(f"G{g}")]
        for _ in range(rng.randrange(4)):
            r = rng.choice(own)
            c = rng.choice(["gameid", "participantid", "side", "position", "teamid", "champion", "result", "date", "year", "datacompleteness", "pick2"])
            r[c] = rng.choice([None, "", "  ", "x", "Blue", "top", "1", "0", "2024", "partial"])
        if rng.random() < 0.3:
            own.append(dict(rng.choice(own)))
        if rng.random() < 0.3:
            own.pop(rng.randrange(len(own)))
        rows += own
    for drop in ([], ["side"], ["position"], ["result", "datacompleteness"], ["gameid"]):
        frame = feed([{k: v for k, v in r.items() if k not in drop} for r in rows])
        got, skipped = Q.audit(frame)
        parts = [rule(frame) for n, (rule, _) in Q.RULES.items() if n not in skipped] + [Q.schema_issues(frame).drop("detail")]
        expected = sorted((tuple(r) for p in parts for r in p.collect()), key=str)
        assert sorted((tuple(r) for r in got.drop("rule_ord").collect()), key=str) == expected
        assert len(expected) > 20 or drop == ["gameid"]
