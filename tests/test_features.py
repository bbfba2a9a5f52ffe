import random
from datetime import datetime, timedelta

from pyspark.sql import functions as F

from draftlake.operators import history as H
from draftlake.operators import split as P
from draftlake.operators.metrics import calibration, metrics, select_family


def test_last_n_before_equals_a_scan(spark):
    random.seed(3)
    t0 = datetime(2025, 1, 1)
    past = [(random.choice("ABCD"), i, t0 + timedelta(hours=random.randrange(40)), random.randrange(2)) for i in range(300)]
    past.append(("A", 1000, None, 1))
    asked = [(random.choice("ABCDE"), i, t0 + timedelta(hours=random.randrange(-1, 42))) for i in range(80)]
    history = spark.createDataFrame(past, "team string, game_id long, ended_at timestamp, win int")
    targets = spark.createDataFrame(asked, "team string, id long, cutoff timestamp")
    states = {"n": F.count(F.lit(1)), "wins": F.sum("win"), "ids": F.collect_list("game_id")}
    got = {r.id: (r.n, r.wins, r.ids) for r in H.last_n_before(history, targets, ["team"], 10, states).collect()}
    for team, i, cutoff in asked:
        seen = sorted(((-(e - t0).total_seconds(), g, w) for k, g, e, w in past if k == team and e is not None and e < cutoff))[:10]
        n, wins, ids = got[i]
        assert (n or 0, wins or 0, ids[::-1] if ids else []) == (len(seen), sum(w for *_, w in seen), [g for _, g, _ in seen])


def test_fixture_of_three_matches(spark):
    t = lambda d: datetime(2025, 6, d, 12)
    rows = [("A", 1, t(21), 1), ("B", 1, t(21), 0), ("B", 2, t(22), 1), ("A", 2, t(22), 0), ("C", 3, t(23), 0), ("D", 3, t(23), 1)]
    history = spark.createDataFrame(rows, "team string, game_id long, ended_at timestamp, win int")
    targets = spark.createDataFrame([("A", datetime(2025, 7, 1)), ("Z", datetime(2025, 7, 1))], "team string, cutoff timestamp")
    out = H.last_n_before(history, targets, ["team"], 10, {"n": F.count(F.lit(1)), "wins": F.sum("win")})
    got = {r.team: (r.n, r.wins, r.value) for r in out.withColumn("value", H.rate(F.col("wins"), F.col("n"))).collect()}
    assert got == {"A": (2, 1, 0.5), "Z": (None, None, None)}


def test_reasons_and_continuity(spark):
    df = spark.sql("SELECT * FROM VALUES ('g', 't', TIMESTAMP '2025-01-01', TIMESTAMP '2025-01-01'), ('g', 'g', NULL, TIMESTAMP '2025-01-01'), ('h', 'g', NULL, TIMESTAMP '2025-01-01'), ('h', 'g', TIMESTAMP '2024-12-31', TIMESTAMP '2025-01-01') AS x(game, target, ended, cutoff)")
    got = [r.r for r in df.select(H.exclusion_reason(*map(F.col, ("game", "ended", "target", "cutoff"))).alias("r")).collect()]
    assert got == ["END_NOT_BEFORE_CUTOFF", "TARGET_GAME", "MISSING_ENDED_AT", None]
    row = spark.sql("SELECT array(1,2,3,4,5) AS a, array(1,2,9,4,8) AS b, cast(NULL AS array<int>) AS c").select(H.continuity(F.col("a"), F.col("b")).alias("x"), H.continuity(F.col("a"), F.col("c")).alias("y")).first()
    assert tuple(row) == (0.6, None)


def test_split_boundaries_and_purge(spark):
    t0 = datetime(2025, 1, 1)
    rows = [(i, t0 + timedelta(days=i // 2), t0 + timedelta(days=i // 2, hours=30), i % 2) for i in range(20)]
    samples = spark.createDataFrame(rows, "game_id int, cutoff timestamp, ended_at timestamp, win int")
    got = {r.game_id: (r.partition, r.purged) for r in P.temporal_split(samples).collect()}
    assert [got[i][0] for i in (0, 13, 14, 15, 16, 19)] == ["train", "train", "validation", "validation", "test", "test"]
    assert [i for i, (_, p) in got.items() if p] == [12, 13, 14, 15] or sorted(i for i, (_, p) in got.items() if p) == [12, 13, 14, 15]
    two = samples.where("game_id < 4")
    assert P.temporal_split(two).count() == 0


def test_metrics(spark):
    rows = [(1, 0.9), (0, 0.9), (1, 0.5), (0, 0.1), (1, 0.1)]
    scored = spark.createDataFrame(rows, "y int, p double")
    m = metrics(scored, "y", "p").first()
    pairs = [(a, b) for ya, a in rows for yb, b in rows if ya == 1 and yb == 0]
    assert m.n == 5 and abs(m.roc_auc - sum((a > b) + 0.5 * (a == b) for a, b in pairs) / len(pairs)) < 1e-9
    assert metrics(scored.where("y = 1"), "y", "p").first().roc_auc is None
    assert [r.n for r in calibration(scored, "y", "p").orderBy("bin").collect()] == [0, 2, 0, 0, 0, 1, 0, 0, 0, 2]


def test_family_selection():
    rows = lambda b, l, f: [{"family": n, "brier": x, "log_loss": x} for n, x in (("baseline", b), ("logistic", l), ("forest", f))]  # noqa: E731, E741
    assert select_family(rows(0.25, 0.22, 0.2195)) == "logistic"
    assert select_family(rows(0.25, 0.22, 0.21)) == "forest"
    assert select_family(rows(0.2, 0.22, 0.21)) == "baseline"
