"""Steps whose cost once grew faster than their input: the results stay, the dear form of the plan is gone."""

import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from draftlake.operators import history as H


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_stretches_are_found_by_binary_search_and_tails_not_exploded_twice(spark):
    rows = spark.range(3000).select(F.lit("hot").alias("team"), F.timestamp_seconds(F.col("id") % 700).alias("ended_at"), F.concat(F.lit("g"), "id").alias("game_id"))
    asked = spark.range(-5, 800, 7).select(F.lit("hot").alias("team"), F.timestamp_seconds("id").alias("cutoff"), F.col("id").alias("h"))
    own, placed = H.by_stretches(rows, asked, ["team"], 3, "ended_at", "game_id", "cutoff", 10)
    assert "filter(" not in plan_of(placed) and "filter(" not in plan_of(own)
    assert plan_of(own).lower().count("row_number") <= 2  # of the tails only (name and definition), not of what is carried on
    seen = {r.h: r.ids for r in H.last_n_before(rows, asked, ["team"], 3, {"ids": F.collect_list("game_id")}, bucket_rows=10).collect()}
    games = [(i % 700, f"g{i}") for i in range(3000)]
    for h, ids in seen.items():
        before = sorted(sorted((g for g in games if g[0] < h), key=lambda g: g[1]), key=lambda g: -g[0])[:3]
        assert (ids or []) == [g for _, g in reversed(before)]


def test_exclusions_make_no_features(spark, monkeypatch):
    from test_dataset import DAY, SCHEMA, match, records, targets

    from draftlake.operators import dataset as D

    history = spark.createDataFrame([match("h1", "A", "B", "A", DAY)], SCHEMA)
    asked = targets(spark, 3).drop("history_cutoff_at")
    monkeypatch.setattr(D, "pre_features", None)  # would fail if called
    judged = D.judged_targets(asked, records(spark, ["t00", "t01"]), history, ["p1"])
    assert [(r.game_id, r.reason) for r in D.exclusions(judged).collect()] == [("t02", "E_CUTOFF_MISSING")]


def test_states_of_a_group_need_no_distinct_counts(spark):
    from draftlake.operators import groups as G

    rows = spark.createDataFrame([(k, v) for k, vs in (("one", "aa"), ("two", "ab"), ("some", ["a", None]), ("none", [None])) for v in vs], "k string, v string")
    out = rows.groupBy("k").agg(G.collapse_state(F.col("v")).alias("state"), G.collapse_value(F.col("v")).alias("value"), G.collapse_state(F.upper("v")).alias("other"))
    assert {r.k: (r.state, r.value, r.other) for r in out.collect()} == {"one": ("SINGLE", "a", "SINGLE"), "two": ("CONFLICT", None, "CONFLICT"), "some": ("MIXED", None, "MIXED"), "none": ("MISSING", None, "MISSING")}
    assert "Expand" not in plan_of(out)  # several distinct counts multiply the rows


def test_lineup_codes_do_not_multiply_rows(spark):
    from draftlake.operators import conform as T

    sides = [(s, p) for s in ("Blue", "Red") for p in ("top", "jng", "mid", "bot", "sup")]
    rows = [("ok", s, p, str(i), f"p{i}", "c") for i, (s, p) in enumerate(sides)]
    rows += [("twice", s, "top" if (s, p) == ("Red", "mid") else p, str(max(i, 1)), f"p{min(i, 8)}", "c") for i, (s, p) in enumerate(sides)]
    rows += [("bad", "Blue", "xyz", None, None, None), ("bad", "Grey", "top", "1", "p1", "c")]
    out = T.lineup_codes(spark.createDataFrame(rows, "gameid string, side string, position string, participantid string, player_id string, champion_id string"))
    whole = ["DUPLICATE_GAME_PARTICIPANT_ID", "GAME_REQUIRES_TEN_UNIQUE_PLAYERS", "TEAM_ROLE_SET_INCOMPLETE"]
    rest = ["CHAMPION_UNMAPPED", "GAME_REQUIRES_TEN_RESOLVED_PLAYERS", "INVALID_ROLE", "INVALID_SIDE", "MISSING_PARTICIPANT_ID", "PLAYER_ID_UNRESOLVED"]
    assert {r.gameid: r.codes for r in out.collect()} == {"ok": [], "twice": whole, "bad": sorted(whole + rest)}
    assert "Expand" not in plan_of(out)


def test_rules_of_a_feed_read_their_columns_only(spark, tmp_path):
    import duckdb

    from draftlake.plans import feed

    duckdb.sql("COPY (SELECT i AS o_orderkey, i AS o_custkey, TIMESTAMP '1995-01-01' AS o_orderdate FROM range(60) t(i)) TO '%s/orders.parquet'" % tmp_path)
    rows = feed.feed(lambda name: spark.read.parquet(f"{tmp_path}/{name}.parquet"))
    assert [f for f in rows.inputFiles() if not f.endswith("orders.parquet")] == []  # not written whole before it is read


def test_an_import_reads_its_batch_once_beside_what_is_stored(spark, tmp_path, monkeypatch):
    from draftlake.operators import evaluate as E
    from draftlake.streaming import imports as I

    ledger = I.Ledger(spark, f"file://{tmp_path}/ledger", "idempotency_key string, content_sha256 string, created_at timestamp, p double")
    rows = spark.range(6).selectExpr("concat('k', id) idempotency_key", "concat('c', id) content_sha256", "timestamp '2025-01-01' created_at", "id / 10.0D p")
    monkeypatch.setattr(E, "save", None)  # two plans over one batch; would fail if called
    assert ledger.import_batch(rows.limit(3), 0) == I.IMPORTED and ledger.import_batch(rows, 1) == I.IMPORTED
    assert ledger.import_batch(rows, 1) == I.VERIFIED  # three of its keys are in the folder of the first
    assert sorted(r.idempotency_key for r in ledger.rows().collect()) == [f"k{i}" for i in range(6)]


def test_tasks_grow_with_the_rows_that_they_sort(spark, monkeypatch):
    from draftlake import session as S

    monkeypatch.setattr(S, "PART_ROWS", 100)
    assert S.dealt(spark.range(1000), "id").rdd.getNumPartitions() == 11


def test_warnings_need_no_running_history(spark, monkeypatch):
    from draftlake.plans import features

    monkeypatch.setattr(H, "last_n_before", None)  # a sort of history and of targets each; would fail if called
    assert features.warnings(lambda name: spark.read.parquet(f"/root/testdata/sf0.001/{name}.parquet")).columns == ["game_id", "position", "code"]
    rows = spark.createDataFrame([("a", 3), ("a", 1), ("a", 1), ("a", None), ("b", 5), (None, 1), (None, 2)], "k string, at int")
    assert {(r.k, r.nth_end) for r in H.nth_end(rows, ["k"], 2, ts="at").collect()} == {("a", 1), (None, 2)}


def test_activity_asks_its_state_as_seldom_as_may_be():
    from types import SimpleNamespace as N
    from unittest.mock import Mock

    from draftlake.streaming import activity as A

    state, gone = Mock(), Mock()
    state.get.return_value = ("e1", 5, None, None, None, None, "e1", None, 1)
    work = A.Activity()
    work.init(N(getValueState=lambda *_: state, getMapState=lambda *_: gone))
    events = [N(kind="POST", evaluation_id="e2", parent_id="e1", at=7)]
    gone.containsKey.return_value = False
    assert [tuple(r) for r in work.handleInputRows(("s", "m"), iter(events), None)] == [("s", "m", 1, "POST", "e2", True)]
    assert not state.exists.called and gone.containsKey.call_count == 1  # e1 is shown already


def test_history_and_targets_are_dealt_out_once_and_narrow(spark):
    from test_dataset import DAY, SCHEMA, match, targets

    from draftlake.operators import dataset as D

    history = spark.createDataFrame([match("h1", "A", "B", "A", DAY)], SCHEMA)
    asked = targets(spark, 3)
    plan = D.pre_features(asked, history).select("game_id", *D.PRE_COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(team#") == plan.count("Exchange hashpartitioning(a#") == 1  # states of the history were dealt out again with the targets
    plan = D.post_features(asked, history).select("game_id", *D.POST_COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning(player_id#") == 1


def test_lists_of_a_key_and_of_a_part_of_it_by_stretches(spark):
    rng = random.Random(7)
    at = lambda h: datetime(2025, 1, 1) + timedelta(hours=h)
    rows = [(rng.choice(["hot", "hot", "hot", "a", None]), rng.choice(["B", "R", "R", "R", "R", "R"]), at(rng.randrange(90)) if rng.random() < 0.95 else None, f"g{i}") for i in range(400)]
    history = spark.createDataFrame(rows, "team string, side string, ended_at timestamp, game_id string")
    asked = [(t, s, at(h), f"t{h}") for t in ("hot", "a", "b", None) for s in "BR" for h in range(-3, 95, 4)]
    targets = spark.createDataFrame([*asked, asked[-1]], "team string, side string, cutoff timestamp, game_id string")
    lists = [(4, F.col("game_id"), (), lambda x: [x.alias("of_team"), F.size(x).alias("n")]), (7, F.struct("game_id", "side"), ("side",), lambda x: [x["game_id"].alias("of_side")])]
    for bucket in (10**6, 15):
        out = H.lists_before(history, targets, ["team"], lists, bucket_rows=bucket)
        assert out.columns == ["team", "side", "game_id", "of_team", "n", "of_side"] and out.count() == len(asked) + 1
        got = {(r.team, r.side, r.game_id): (r.of_team, r.n, r.of_side) for r in out.collect()}
        for t, s, cutoff, i in asked:
            own = sorted(sorted((r for r in rows if r[0] == t and r[2] and r[2] < cutoff), key=lambda r: r[3], reverse=True), key=lambda r: r[2])
            of_team, of_side = [r[3] for r in own][-4:], [r[3] for r in own if r[1] == s][-7:]
            assert got[t, s, i] == (of_team, len(of_team), of_side)


def test_a_dataset_does_not_mind_the_order_of_lineups(spark):
    from test_dataset import DAY, SCHEMA, match, records, targets

    from draftlake.operators import dataset as D

    rng = random.Random(3)
    mixed = lambda m: tuple(rng.sample(x, len(x)) if isinstance(x, list) else x for x in m)
    past = [match(f"h{i}", "AB"[i % 2], "BA"[i % 2], "A", DAY + timedelta(hours=i), shift=i % 3) for i in range(7)]
    own = [tuple(r) for r in targets(spark, 5).collect()]
    told = records(spark, [r[0] for r in own])
    early = match("t01", "A", "B", "A", datetime(2025, 7, 1, 2))  # another end than the target's, before its cutoff: a contradiction for those after it
    for history, left in ((past, 0), ([*past, *own], 0), ([*past, early], 4)):
        found = []
        for change in (lambda m: m, mixed):
            asked = spark.createDataFrame([change(m) for m in own], SCHEMA).drop("history_cutoff_at")
            pairs, out = D.paired_dataset(asked, told, spark.createDataFrame([change(m) for m in history], SCHEMA), ["p1"])
            found.append(sorted(map(tuple, pairs.select("game_id", "y_blue_win", "history_cutoff_at", *D.PRE_COLUMNS, *D.POST_COLUMNS).collect())))
            assert out.count() == {0: 0, 4: 3}[left] and D.table_issues(pairs).count() == 0
            assert {"blue_roster", "slots", "blue_recent_form_game_ids", "target_ended_at"} <= set(pairs.columns)
        assert found[0] == found[1] and len(found[0]) == 5 - {0: 0, 4: 3}[left]
    twice = pairs.union(pairs.limit(1))
    assert [r.problem for r in D.table_issues(twice).collect()] == ["repeated id"] * 2
