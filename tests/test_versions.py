"""Positions, hash trees, and versions behind a log of commits."""

import random
from threading import Thread

import pytest
from pyspark.sql import functions as F

from draftlake.operators import merkle as M
from draftlake.operators.ordering import numbered
from draftlake.operators.reconcile import actions
from draftlake.schemas import TARGET_KEYS
from draftlake.sources import versions as V


def test_positions_are_those_of_the_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice([None, *range(50)]), rng.random()) for _ in range(3000)]
    df = spark.createDataFrame(rows, "a int, b double").repartition(7)
    out = numbered(df, [F.col("a").asc_nulls_last(), F.desc("b")], first=5)
    got = [(r.a, r.b) for r in sorted(out.collect(), key=lambda r: r.position)]
    assert sorted(r.position for r in out.collect()) == list(range(5, 3005))
    assert got == sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, -r[1]))
    assert numbered(df.limit(0), ["a"]).count() == 0
    assert out.agg(F.max("position")).first()[0] == 3004 and "at__" not in out.columns


def test_positions_over_ten_million_rows(spark):
    out = numbered(spark.range(10_000_000).select(F.expr("(id * 7919) % 10000019").alias("v")), ["v"])
    bad = out.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("position").alias("d"), F.min("position").alias("a"), F.max("position").alias("b"), F.expr("covar_pop(position, v) > 0").alias("up")).first()
    assert tuple(bad) == (10_000_000, 10_000_000, 0, 9_999_999, True)


SMALL = "id long, name string, x double, tags array<string>"


def small(n=5000):
    return [(i, None if i % 7 == 0 else f"n{i % 5}", i / 3, [str(i), None]) for i in range(n)]


@pytest.fixture
def blocks(monkeypatch):
    monkeypatch.setattr(M, "ROWS", 16)
    monkeypatch.setattr(M, "FAN", 4)


def test_a_tree_depends_on_rows_only_and_finds_the_first_difference(spark, blocks):
    make = lambda rows, parts: M.tree(spark.createDataFrame(rows, SMALL).repartition(parts), ["id"])
    rows = small()
    a = make(rows, 3)
    assert M.root(a) == M.root(make(rows[::-1], 11)) and M.root(a)[1] == 5000
    assert M.first_difference(a, make(rows[::-1], 1)) is None
    for i, change in ((4321, (4321, "n", 4321 / 3, ["4321", None])), (70, (70, "", 70 / 3, ["70", None])), (4999, (4999, "n4", float("nan"), ["4999", None]))):
        other = make([*rows[:i], change, *rows[i + 1 :]], 5)
        assert M.root(a)[0] != M.root(other)[0]
        found = M.first_difference(a, other)
        assert found["block"] == i // 16 and found["left"][0] == f'{{"id":{i // 16 * 16}}}'
    shorter = make(rows[:-1], 2)
    assert M.first_difference(a, shorter)["block"] == 4999 // 16
    assert M.first_difference(a, make(rows[:100], 2))["block"] == 100 // 16
    assert M.root(make([], 1))[1] == 0


def test_zero_has_no_sign_and_null_is_neither_nan_nor_empty(spark, blocks):
    root = lambda v, n="a": M.root(M.tree(spark.createDataFrame([(1, n, v, None)], SMALL), ["id"]))[0]
    assert root(0.0) == root(-0.0)
    assert len({root(0.0), root(None), root(float("nan")), root(0.0, ""), root(0.0, None), root(0.0, "~")}) == 6
    two = lambda rows: M.root(M.tree(spark.createDataFrame(rows, "a string, b string"), ["a"]))[0]
    assert two([("x1", "2")]) != two([("x", "12")]) and two([("x", "1"), ("x", "1")]) != two([("x", "1")])


def test_a_version_is_read_as_it_was(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    a = spark.createDataFrame([(3, "c"), (1, "a"), (2, None)], "id long, name string")
    b = spark.createDataFrame([("x", 1.5)], "k string, v double")
    assert V.Log(spark, root).latest() == 0
    assert V.commit(spark, root, 0, {"a": (a, ["id"]), "b": (b, ["k"])}) == 1
    assert V.commit(spark, root, 1, {"a": (a.where("id < 3"), ["id"]), "b": (b, ["k"])}, note={"why": "less"}) == 2
    old, new = (V.read_version(spark, root, v, {"a": ["name", "id"]}, deep=True)["a"] for v in (1, 2))
    assert [tuple(r) for r in old.collect()] == [("a", 1), (None, 2), ("c", 3)] and new.count() == 2 and old.columns == ["name", "id"]
    assert list(V.changed_since(spark, root, 1, 2)) == ["a"]
    with pytest.raises(V.VersionError, match=V.BASE_MOVED):
        V.commit(spark, root, 1, {"a": (a, ["id"])})
    with pytest.raises(V.VersionError, match=V.NO_VERSION):
        V.read_version(spark, root, 7)
    assert V.Log(spark, root).latest() == 2 and not [p for p in (tmp_path / "store/_commits").iterdir() if p.name.startswith(".") and not p.name.endswith(".crc")]


def test_altered_and_missing_files_are_found(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    rows = spark.range(100).select("id", F.lit("same").alias("name")).coalesce(1)
    V.commit(spark, root, 0, {"a": (rows, ["id"])})
    entry = V.Log(spark, root).entry(1)
    folder = tmp_path / "store" / entry["folder"] / "a"
    file = folder / entry["tables"]["a"]["files"][0][0]
    (folder / "part-stray.parquet").write_bytes(b"not one of ours")
    assert V.read_version(spark, root, 1, deep=True)["a"].count() == 100
    other = tmp_path / "other"
    rows.select("id", F.lit("emas").alias("name")).write.parquet(f"file://{other}")
    good, same_size = file.read_bytes(), next(other.glob("part-*")).read_bytes()
    for crc in folder.glob(".*.crc"):
        crc.unlink()
    file.write_bytes(good[:-1])
    with pytest.raises(V.VersionError, match=V.FILE_CHANGED):
        V.read_version(spark, root, 1)
    if len(same_size) == len(good):
        file.write_bytes(same_size)
        V.read_version(spark, root, 1)
        with pytest.raises(V.VersionError, match=V.DIGEST):
            V.read_version(spark, root, 1, deep=True)
    file.unlink()
    with pytest.raises(V.VersionError, match=V.FILE_MISSING):
        V.read_version(spark, root, 1)


def target_tables(spark, names):
    """Nine target tables, all empty but for the teams."""
    tables = {t: spark.createDataFrame([], ", ".join(f"{k} string" for k in (*keys, "name"))) for t, keys in TARGET_KEYS.items()}
    return tables | {"team": spark.createDataFrame([(f"id-{n}", n) for n in names], "team_id string, name string")}


def planner(candidates):
    return lambda snapshot: {t: actions(candidates[t], snapshot[t], list(k)) for t, k in TARGET_KEYS.items()}


def test_of_two_writers_one_wins_and_the_other_plans_again(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    empty = target_tables(spark, [])
    results, seen = {}, []

    def writer(name):
        candidates = target_tables(spark, [name])

        def plan(snapshot):
            seen.append(name)
            return planner(candidates)(snapshot)

        results[name] = V.apply(spark, root, plan, empty)

    threads = [Thread(target=writer, args=(n,)) for n in ("a", "b")]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(v for v, _ in results.values()) == [1, 2] and {s for _, s in results.values()} <= {"INITIAL", "MIXED"}
    assert {r.team_id for r in V.read_version(spark, root)["team"].collect()} == {"id-a", "id-b"}
    assert V.Log(spark, root).entry(2)["base"] == 1
    again = V.apply(spark, root, planner(target_tables(spark, ["a", "b"])), empty)
    assert again == (2, "ALREADY_APPLIED") and V.Log(spark, root).latest() == 2


def test_a_name_in_the_log_is_given_once(spark, tmp_path):
    log, made = V.Log(spark, f"file://{tmp_path}/log"), []
    threads = [Thread(target=lambda i=i: made.append((log.add(1, {"by": i}), i))) for i in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    winners = [i for ok, i in made if ok]
    assert len(made) == 8 and len(winners) == 1 and log.entry(1) == {"by": winners[0]}


def test_what_is_not_approved_or_not_applied_is_not_committed(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    empty = target_tables(spark, [])
    with pytest.raises(V.VersionError, match=V.NOT_APPROVED):
        V.apply(spark, root, planner(target_tables(spark, ["a"])), empty, approved=())
    calls = []

    def never_done(snapshot):
        calls.append(1)
        return planner(target_tables(spark, [f"a{len(calls)}"]))(snapshot)

    with pytest.raises(V.VersionError, match=V.NOT_APPLIED):
        V.apply(spark, root, never_done, empty)
    assert V.Log(spark, root).latest() == 0


def test_entity_references(spark, tmp_path):
    root = f"file://{tmp_path}/store"
    columns = lambda kind: f"{kind}_id string, oracle_{kind}_id string, canonical_name string, display_name string, logo_file string"
    tables = {k: (spark.createDataFrame([(f"{k}2", "o2", "B", "b", None), (f"{k}1", None, "A", "a", "x")], columns(k)), [f"{k}_id"]) for k in ("team", "player")}
    V.commit(spark, root, 0, tables)
    champions = spark.createDataFrame([("2", "Y"), ("1", "X")], "champion_id string, canonical_name string")
    found = V.entity_references(spark, root, 1, champions)
    assert [tuple(r) for r in found["team"].collect()] == [("team1", None, "A", "a"), ("team2", "o2", "B", "b")]
    assert [r.champion_id for r in found["champion"].collect()] == ["1", "2"]
    with pytest.raises(V.VersionError, match="E_CHAMPIONS_EMPTY"):
        V.entity_references(spark, root, 1, champions.limit(0))
