import pytest
from conftest import match_rows

from draftlake.operators import quality as Q


def codes(frame):
    return sorted(r.issue_code for r in frame.collect())


def test_a_valid_match_has_no_issue(feed):
    issues, skipped = Q.audit(feed(match_rows()))
    assert issues.count() == 0 and not skipped


def changed(change, rows=None):
    rows = [dict(r) for r in rows or match_rows()]
    change(rows)
    return rows


@pytest.mark.parametrize(
    ("change", "expected"),
    [
        (lambda r: r[0].update(gameid=" "), {"MISSING_GAME_ID", "INVALID_GAME_ROW_COUNT", "INVALID_PLAYER_ROW_COUNT", "INCOMPLETE_TEAM_ROLES"}),
        (lambda r: r[0].update(participantid=""), {"MISSING_PARTICIPANT_ID"}),
        (lambda r: r.append(dict(r[0])), {"DUPLICATE_GAME_PARTICIPANT", "INVALID_GAME_ROW_COUNT", "INVALID_PLAYER_ROW_COUNT", "DUPLICATE_TEAM_ROLE"}),
        (lambda r: r.pop(), {"INVALID_GAME_ROW_COUNT", "INVALID_TEAM_ROW_COUNT", "INVALID_TEAM_SIDE_STRUCTURE", "INVALID_RESULT_STRUCTURE"}),
        (lambda r: r[2].update(position="xyz"), {"INVALID_POSITION", "INCOMPLETE_TEAM_ROLES"}),
        (lambda r: r[2].update(playerid=" "), {"MISSING_PLAYER_ID"}),
        (lambda r: r[2].update(champion=""), {"MISSING_PLAYER_CHAMPION"}),
        (lambda r: r[5].update(pick3=""), {"MISSING_TEAM_PICK"}),
        (lambda r: r[11].update(ban5=None), {"MISSING_TEAM_BAN"}),
        (lambda r: r[11].update(side="Blue"), {"INVALID_TEAM_SIDE_STRUCTURE"}),
        (lambda r: r[3].update(result="2"), {"INVALID_RESULT_VALUE"}),
        (lambda r: r[3].update(result=""), {"MISSING_RESULT"}),
        (lambda r: r[3].update(result="0"), {"PLAYER_TEAM_RESULT_MISMATCH"}),
        (lambda r: r[5].update(result="0"), {"INVALID_RESULT_STRUCTURE", "PLAYER_TEAM_RESULT_MISMATCH"}),
        (lambda r: r[3].update(date="someday"), {"INVALID_DATE"}),
        (lambda r: r[3].update(year="2025.5"), {"INVALID_YEAR"}),
        (lambda r: r[3].update(year="2024"), {"YEAR_DATE_MISMATCH", "INCONSISTENT_GAME_YEAR"}),
        (lambda r: r[3].update(datacompleteness="other"), {"UNKNOWN_DATA_COMPLETENESS", "INVALID_GAME_DATA_COMPLETENESS"}),
        (lambda r: r[3].update(datacompleteness="partial"), {"INVALID_GAME_DATA_COMPLETENESS"}),
    ],
)
def test_each_mutation_has_its_codes(feed, change, expected):
    assert set(codes(Q.audit(feed(changed(change)))[0])) == expected


def test_rules_without_their_columns_are_skipped(feed):
    rows = [{k: v for k, v in r.items() if k != "date"} for r in match_rows()]
    issues, skipped = Q.audit(feed(rows))
    assert skipped == {"time": ["date"]} and codes(issues) == ["MISSING_REQUIRED_COLUMN"]


def test_an_empty_feed_has_no_issue(feed, spark):
    empty = feed(match_rows()).limit(0)
    assert Q.audit(empty)[0].count() == 0


def test_benchmark(spark):
    seen = spark.createDataFrame([("rows", 12), ("matches", 2)], "metric string, value int")
    want = spark.createDataFrame([("rows", 12), ("matches", 1), ("years", 1)], "metric string, value int")
    assert {r.metric: r.status for r in Q.benchmark(seen, want).collect()} == {"rows": "MATCH", "matches": "MISMATCH", "years": "NOT_AVAILABLE"}
