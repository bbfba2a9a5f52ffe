"""Strict documents, digests, archives."""

import json

import pytest

from draftlake.session import settled
from draftlake.sources import evidence as V


def test_strict_json_and_digests():
    assert V.strict_json('{"a": [1, {"b": null}]}') == {"a": [1, {"b": None}]}
    for text, code in (('{"a": 1, "a": 2}', V.DUPLICATE_KEY), ('{"a": NaN}', V.NON_FINITE), ("[1,", V.INVALID)):
        with pytest.raises(V.EvidenceError, match=code):
            V.strict_json(text)
    assert V.canonical_digest({"b": -0.0, "a": float("nan")}) == V.canonical_digest({"a": None, "b": 0.0}) != V.canonical_digest({"a": None, "b": 1.0})


def test_documents_and_archives(spark, tmp_path):
    (tmp_path / "d.json").write_text(json.dumps({"schema_version": 1, "exclusions": {"teams": ["x.png", "a.png"]}}))
    path = f"file://{tmp_path}/d.json"
    found, digest = V.read_document(spark, path, {"schema_version": 1}, ["exclusions"])
    assert found["schema_version"] == 1 and len(digest) == 64
    with pytest.raises(V.EvidenceError, match=V.SCHEMA):
        V.read_document(spark, path, {"schema_version": 2})
    assert [r.name for r in V.media_exclusions(spark, path, "teams").collect()] == ["a.png", "x.png"]
    archive = tmp_path / "archive"
    archive.mkdir()
    for i in range(2):
        (archive / f"{i}.json").write_text(json.dumps([{"game_id": f"g{i}", "status": "OK", "start_timestamp_ms": 1, "end_timestamp_ms": 2}]))
    rows = settled(V.read_archive(spark, f"file://{archive}"))
    assert sorted((r.game_id, r.start_timestamp_ms, r.revision_id) for r in rows.collect()) == [("g0", 1, None), ("g1", 1, None)]
    assert V.unchanged(rows, rows).count() == 0
    (archive / "1.json").write_text('[{"game_id": "g1"}]')
    assert [r.code for r in V.unchanged(rows, V.read_archive(spark, f"file://{archive}")).collect()] == [V.CHANGED]
