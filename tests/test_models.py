from datetime import datetime

import numpy as np
from pyspark.sql import functions as F

from draftlake.functions import scalars as S
from draftlake.operators import evaluate as E
from draftlake.operators import models as M
from draftlake.operators import reference_data as D
from draftlake.operators.metrics import metrics
from draftlake.sources import readers, writers
from draftlake.streaming.ingest import start


def test_families(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=600)
    rows = [(i, float(v) if i % 9 else None, None, bool(v > 1), "ab"[i % 2], int(rng.random() < 1 / (1 + np.exp(-2 * v)))) for i, v in enumerate(x)]
    data = spark.createDataFrame(rows, "game_id int, x double, never double, flag boolean, role string, y_blue_win int")
    train, test = data.where("game_id < 400"), data.where("game_id >= 400").withColumn("role", F.lit("unseen"))
    brier = {}
    for family in M.FAMILIES:
        scored = M.fit(family, train, ["x", "never"], ["flag"], ["role"]).score(test)
        brier[family] = metrics(scored, "y_blue_win", "p").first().brier
    assert brier["logistic"] < brier["baseline"] - 0.03 and brier["forest"] < brier["baseline"]
    assert M.fit_scaler(train, ["never"]).stats["never"] == (0.0, 0.0, 0.0)


def test_compare(spark):
    pre = spark.createDataFrame([("g", 0.4)], "game_id string, p double")
    row = M.compare(pre, pre.withColumn("p", F.lit(0.55))).first()
    assert round(row.delta_points, 9) == 15.0
    assert round(E.explain(pre, pre).first().red_points, 9) == 0.0


def test_save_and_activity(spark):
    kind = "evaluation_id int, subject_id string, model_id string, phase string, parent_id int, idempotency_key string, content_sha256 string, created_at timestamp"
    t = lambda h: datetime(2025, 1, 1, h)
    stored = spark.createDataFrame([(1, "s", "m", "PRE", None, "k1", "c1", t(1)), (2, "s", "m", "POST", 1, "k2", "c2", t(2))], kind)
    new = spark.createDataFrame([(3, "s", "m", "PRE", None, "k1", "c1", t(3)), (4, "s", "m", "PRE", None, "k2", "other", t(3)), (5, "s", "m", "PRE", None, "k5", "c5", t(4))], kind)
    rows, conflicts = E.save(new, stored)
    assert [r.evaluation_id for r in rows.collect()] == [5] and [r.code for r in conflicts.collect()] == ["E_STORAGE_CONFLICT"]
    active = lambda df: sorted(r.evaluation_id for r in df.where("is_active").collect())
    assert active(E.with_activity(stored)) == [1, 2]
    assert active(E.with_activity(stored.unionByName(rows))) == [5]
    assert active(E.with_activity(stored, spark.createDataFrame([(2,)], "evaluation_id int"))) == [1]


def test_scalars(spark):
    df = spark.createDataFrame([(" Ａ  b ", "STRASSE ß", "x_game_2", "https://h.example/?bo=3&match=7&match=7", "1.0")], "a string, b string, g string, u string, n string")
    row = df.select(
        S.clean_label("a").alias("a"), S.canonical_key("b").alias("b"), S.series_key(F.col("g")).alias("k"), S.series_number(F.col("g")).alias("no"), S.url_parameter(F.col("u"), "match").alias("m"),
        S.whole_number(F.col("n")).alias("w"), S.is_missing(F.lit("  ")).alias("blank"), S.source_id_state(F.lit(" x")).alias("state"), S.is_stable_id(F.lit("a.b:c\n")).alias("stable"),
        S.search_words(F.lit("Đội Tuyển số 1")).alias("words"), S.image_extension(F.lit(b"\x89PNG\r\n\x1a\n")).alias("ext"), S.slug(F.lit("Đội  Tuyển!")).alias("slug"), S.codes(F.lit("b, a,,b")).alias("codes"),
    ).first()
    assert tuple(row) == ("A b", "strasse ss", "x", 2, "7", 1, True, "INVALID", False, ["doi", "tuyen", "so", "1"], "png", "doi-tuyen", '["a","b"]')


def test_readers_and_times(spark, tmp_path):
    feed = tmp_path / "feed.csv"
    from draftlake.schemas import CORE_COLUMNS

    feed.write_text("﻿" + ",".join([*CORE_COLUMNS, "more"]) + "\n" + ",".join(["g", *[""] * 19, "x"]) + "\n")
    core = readers.read_core(spark, str(feed))
    assert core.columns == list(CORE_COLUMNS) and core.first().gameid == "g"
    (tmp_path / "times.json").write_text('[{"game_id":"a","status":"OK","start_timestamp_ms":1000,"end_timestamp_ms":2000,"started_at":"1970-01-01T00:00:01Z","ended_at":"1970-01-01T00:00:02Z"},{"game_id":"b","status":"LOST"},{"game_id":"c","status":"OK","start_timestamp_ms":1000,"end_timestamp_ms":1000}]')
    times = readers.load_times(readers.read_times(spark, str(tmp_path / "times.json")))
    assert {r.game_id: r.reason for r in times.collect()} == {"a": None, "b": "E_TIME_SOURCE_NOT_SUCCESS", "c": "E_TIME_ORDER_INVALID"}
    games = spark.createDataFrame([("a", None, None), ("b", None, None)], "game_id string, started_at timestamp, ended_at timestamp")
    filled, bad = writers.backfill_times(games, times)
    assert filled.where("ended_at IS NOT NULL").count() == 1 and bad.count() == 0
    assert "| game_id |" in writers.markdown(times.select("game_id"))


def test_reference_data(spark):
    media = spark.createDataFrame([("Ann",), ("bob",), ("eve",), ("zoe",)], "name string")
    people = spark.createDataFrame([("1", "ann", None), ("2", "Bob", "p"), ("3", "BOB", None), ("4", "eve", None), ("5", "Eve", None)], "id string, name string, photo string")
    got = {r.media_name: (r.id, r.reason) for r in D.link_media(media, people, sole_photo=True).collect()}
    assert got == {"Ann": ("1", "UNIQUE_NAME"), "bob": ("2", "SOLE_PHOTO"), "eve": ("4", "EXACT_CASE"), "zoe": (None, "NO_MATCH")}
    plan = D.refresh_plan(people.select("id", "photo").where("id < 3"), people.select("id", F.lit("q").alias("photo")).where("id > 1"), "id", "photo")
    assert {r.id: r.action for r in plan.collect()} == {"1": "KEEP", "2": "CHANGE", "3": "ADD", "4": "ADD", "5": "ADD"}
    aliases = spark.createDataFrame([("a", "b"), ("b", "c")], "name string, target string")
    assert {r.name: r.target for r in D.closed_aliases(aliases).collect()} == {"a": "c", "b": "c"}
    shown = D.evidence(spark.createDataFrame([("Faker",)], "PlayerPage string"), spark.createDataFrame([("Coach", "Coach"), ("Keria", "Support")], "PlayerPage string, Role string"))
    assert {r.page_key for r in shown.collect()} == {"faker", "keria"}
    catalog = spark.createDataFrame([("Faker", "Faker", "No"), ("Host", "Host", "Yes")], "SourcePageName string, PlayerHandle string, IsPersonality string")
    images = spark.createDataFrame([("Faker", "old 2019.png", "Yes", None, None, None, None), ("Faker", "new 2024.png", "Yes", None, None, None, None)], "PlayerPage string, FileName string, IsProfileImage string, EffectiveSortDate string, SortDate string, TournamentDateStartFuzzy string, TournamentDate string")
    assert [tuple(r) for r in D.select_players(catalog, shown, images).collect()] == [("faker", "Faker", "new 2024.png", 1)]


def test_stream(spark, tmp_path):
    rows = spark.createDataFrame([("a", "2025-01-01 00:00:00"), ("a", "2025-01-01 00:00:00"), ("b", None), ("c", "2025-01-02 00:00:00")], "game_id string, ended_at string")
    rows.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in"))
    start(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    assert sorted(r.game_id for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["a", "c"]
