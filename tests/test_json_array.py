"""JSON arrays read by ranges of bytes, and the archives of match times that are made of them."""

import hashlib
import json
import random

import pytest

from draftlake.sources import evidence as V
from draftlake.sources import json_array as J


def ranges_of(path, text, size):
    path.write_bytes(text)
    name = f"file://{path}"
    ranges = [(name, low, min(low + size, len(text)), len(text)) for low in range(0, max(len(text), 1), size)]
    return J._states(ranges, {(r[0], r[1]): J.summarise(*r[:3]) for r in ranges})


def read(path, text, size):
    return [r for part in ranges_of(path, text, size) for r in J.records(part)]


def strange(rng):
    signs = ['"', "\\", "a", "é", "日", "[", "]", "{", "}", ",", " ", "\n", "\\\\", '"},{']
    word = lambda: "".join(rng.choice(signs) for _ in range(rng.randrange(12)))
    return {word() + str(i): rng.choice([word(), 1, -2.5, None, True, [word(), [1, {"x": word()}]], {"k": word()}]) for i in range(rng.randrange(4))}


def test_ranges_of_any_size_give_each_record_once(tmp_path, monkeypatch):
    rng = random.Random(1)
    for _ in range(300):
        monkeypatch.setattr(J, "BLOCK", rng.choice([3, 7, 64, 1 << 20]))
        rows = [strange(rng) for _ in range(rng.randrange(8))]
        text = rng.choice([b"", b" \n"]) + json.dumps(rows, ensure_ascii=rng.random() < 0.5, indent=rng.choice([None, 1])).encode() + rng.choice([b"", b"\n "])
        assert read(tmp_path / "a.json", text, rng.randrange(1, 40)) == rows


@pytest.mark.parametrize(
    "text, code",
    [
        (b'[{"a":1,"a":2}]', J.DUPLICATE_KEY), (b'[{"x":0},{"a":NaN}]', J.NON_FINITE), (b'[{"a":-Infinity}]', J.NON_FINITE), (b'[{"a":1}', J.INVALID), (b'[{"a":1},]', J.INVALID),
        (b'[{"a":1}] x', J.INVALID), (b'[{"a":1}][]', J.INVALID), (b'{"a":1}', J.SCHEMA), (b"[1]", J.SCHEMA), (b"", J.SCHEMA), (b'[{"a":1} {"b":1}]', J.INVALID),
        (b'[{"a":"\xff"}]', J.INVALID), (b'[{"a":1},{"b":[}]', J.INVALID), (b'[{"a":"x}]', J.INVALID), (b'[{"a":1}]   "', J.INVALID),
    ],
)
def test_broken_files_fail_by_code_wherever_ranges_cut_them(tmp_path, monkeypatch, text, code):
    for block in (3, 1 << 20):
        monkeypatch.setattr(J, "BLOCK", block)
        for size in range(1, len(text) + 2):
            with pytest.raises(J.EvidenceError, match=f"^{code}"):
                read(tmp_path / "a.json", text, size)


def test_a_record_that_never_ends_fails_in_bounded_memory(tmp_path, monkeypatch):
    monkeypatch.setattr(J, "RECORD", 1000)
    monkeypatch.setattr(J, "BLOCK", 100)
    with pytest.raises(J.EvidenceError, match=J.INVALID):
        read(tmp_path / "a.json", b'[{"a": "' + b"x" * 5000, 10**6)


def test_one_large_array_is_read_by_many_tasks(spark, tmp_path):
    rng = random.Random(2)
    rows = [{"game_id": f"g{i}", "n": i, "text": "".join(rng.choice('ab"\\é,{}[]') for _ in range(rng.randrange(300))), "deep": {"z": [i], "a": None}} for i in range(20_000)]
    text = json.dumps(rows, ensure_ascii=False).encode()
    (tmp_path / "big.json").write_bytes(text)
    (tmp_path / "small.json").write_text('[{"n": 5, "game_id": "s"}]')
    found = J.read_array(spark, f"file://{tmp_path}", "game_id string, n long, text string, deep string, source_file string, source_order long", 200_000)
    assert found.rdd.getNumPartitions() == 2 + len(text) // 200_000
    got = [r for r in sorted(found.collect(), key=lambda r: (r.source_file, r.source_order))]
    assert [(r.game_id, r.n, r.text) for r in got] == [(r["game_id"], r["n"], r["text"]) for r in rows] + [("s", 5, None)]
    assert all(json.loads(r.deep) == {"z": [r.n], "a": None} and r.deep.startswith('{"a":null') for r in got[:-1])
    digests = {r.source_file.rpartition("/")[2]: (r.n_bytes, r.source_sha256) for r in J.file_digests(spark, f"file://{tmp_path}").collect()}
    assert digests == {n: (len(t), hashlib.sha256(t).hexdigest()) for n, t in (("big.json", text), ("small.json", b'[{"n": 5, "game_id": "s"}]'))}
    (tmp_path / "big.json").write_bytes(text[:-2] + b', "n": 1}]')
    with pytest.raises(Exception, match=J.DUPLICATE_KEY):
        found.count()


def iso(ms):
    from datetime import UTC, datetime, timedelta

    return (datetime(1970, 1, 1, tzinfo=UTC) + timedelta(milliseconds=ms)).isoformat().replace("+00:00", "Z")


def time_row(i, **over):
    start = 1_700_000_000_000 + i * 1000
    return {"game_id": f"LOL_{i}", "status": "SUCCESS", "start_timestamp_ms": start, "end_timestamp_ms": start + 1000, "started_at": iso(start), "ended_at": iso(start + 1000)} | over


def export_row(i, payload=None, **over):
    row = time_row(i)
    own = {"platformId": "LOL", "gameId": i, "gameStartTimestamp": row["start_timestamp_ms"], "gameEndTimestamp": row["end_timestamp_ms"]} | (payload or {})
    return row | {"fetched_at_utc": iso(row["end_timestamp_ms"] + 5), "raw_payload": own} | over


@pytest.fixture
def archive(tmp_path):
    """A summary and two exports of 40 matches, of which some are at fault."""
    summary = [time_row(i) for i in range(1, 41)]
    exports = [export_row(i) for i in range(1, 41)]
    expected = {}

    def fault(i, *codes, of=exports, **over):
        of[i - 1] = over.pop("row", None) or of[i - 1] | over
        expected[f"LOL_{i}"] = list(codes)

    fault(1, V.NOT_SUCCESS, status="FAILED")
    fault(2, V.MILLISECONDS, start_timestamp_ms="1700000002000")
    fault(3, V.TIMESTAMP, started_at="2023-11-14 22:13:23")
    fault(4, V.TIME_CONFLICT, started_at=iso(5))
    fault(5, V.PAYLOAD_MISSING, raw_payload=[1])
    fault(6, V.IDENTITY, row=export_row(6, {"gameId": 7}))
    fault(7, V.IDENTITY, matchId="LOL_8")
    fault(8, V.TIME_CONFLICT, row=export_row(8, {"gameEndTimestamp": 9}))
    fault(9, V.RETRIEVAL, fetched_at_utc=iso(9))
    fault(10, V.REVISION, revision_id=-1, revision_timestamp_utc=iso(9))
    fault(11, V.SUMMARY_MISSING, V.NOT_SUCCESS, of=summary, status=None)
    expected["LOL_11"] = sorted(expected["LOL_11"])
    summary[11] |= {"revision_id": 4, "revision_timestamp_utc": iso(9)}
    fault(12, V.REVISION_CONFLICT, revision_id=5, revision_timestamp_utc=iso(9))
    fault(13, V.DUPLICATE_GAME)
    exports.append(export_row(13))
    summary.append(time_row(50))
    expected["LOL_50"] = [V.RAW_MISSING]
    exports.append(export_row(51))
    expected["LOL_51"] = [V.SUMMARY_MISSING]
    summary.append(time_row(14, status="FAILED"))
    expected["LOL_14"] = [V.DUPLICATE_GAME]
    fault(15, V.MILLISECONDS, row=export_row(15, {"gameStartTimestamp": None}))
    names = ["summary.json", "part_1.json", "part_2.json"]
    for name, rows in zip(names, (summary, exports[:20], exports[20:]), strict=True):
        (tmp_path / name).write_text(json.dumps(rows))
    return [f"file://{tmp_path}/{n}" for n in names], exports, expected


def test_time_archive(spark, archive):
    (summary, *parts), exports, expected = archive
    candidates, exclusions, sources = V.load_time_archive(spark, summary, parts, range_bytes=700)
    assert {r.game_id: r.diagnostics for r in exclusions.collect()} == expected
    assert {r.game_id: r.reason for r in exclusions.collect()} == {i: V.DUPLICATE_GAME if V.DUPLICATE_GAME in c else c[0] for i, c in expected.items()}
    got = {r.game_id: r for r in candidates.collect()}
    payloads = {r["game_id"]: r["raw_payload"] for r in exports}
    assert set(got) == {f"LOL_{i}" for i in range(1, 41)} - set(expected)
    assert all(r.raw_payload_sha256 == V.canonical_digest(payloads[i]) and r.revision_status == "MISSING" for i, r in got.items())
    assert sources.count() == 3 and {r.source_file for r in candidates.collect()} == set(parts)

    games = [(f"LOL_{i}", time_row(i)["started_at"], time_row(i)["ended_at"]) for i in (20, 21, 1, 60)] + [("LOL_22", iso(0), iso(5)), ("LOL_23", None, iso(5))]
    table = spark.createDataFrame(games, "game_id string, started_at string, ended_at string")
    proofs, left = V.resolve_proofs(table, candidates, exclusions)
    assert {r.game_id for r in proofs.collect()} == {"LOL_20", "LOL_21"}
    assert {r.game_id: r.reason for r in left.collect()} == {"LOL_1": V.NOT_SUCCESS, "LOL_60": V.ARCHIVE_MISSING, "LOL_22": V.SNAPSHOT_CONFLICT, "LOL_23": V.SNAPSHOT_MISSING}
    with pytest.raises(Exception, match=V.SNAPSHOT_DUPLICATE):
        V.resolve_proofs(table.union(table), candidates, exclusions)[0].collect()


def test_a_changed_or_missing_source_fails(spark, archive, monkeypatch):
    (summary, *parts), _, _ = archive
    with pytest.raises(V.EvidenceError, match=V.UNREADABLE):
        V.load_time_archive(spark, summary, [*parts, parts[0].replace("part_1", "part_3")])
    calls, real = [], V.file_digests

    def changing(session, files):
        calls.append(1)
        if len(calls) == 2:
            path = parts[1].removeprefix("file://")
            with open(path, "a") as f:
                f.write(" ")
        return real(session, files)

    monkeypatch.setattr(V, "file_digests", changing)
    with pytest.raises(V.EvidenceError, match=V.CHANGED):
        V.load_time_archive(spark, summary, parts)
