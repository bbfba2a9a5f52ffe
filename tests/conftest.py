import os
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[1]
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = f"{ROOT}:{os.environ.get('PYTHONPATH', '')}"


@pytest.fixture(scope="session")
def spark(tmp_path_factory):
    from draftlake.session import session

    shared = tmp_path_factory.mktemp("shared")
    out = session(
        "local[4]",
        **{
            "spark.sql.shuffle.partitions": "2", "spark.ui.enabled": "false", "spark.driver.memory": "4g", "spark.checkpoint.dir": f"file://{shared}",
            "spark.sql.warehouse.dir": f"file://{shared}/warehouse", "spark.ui.showConsoleProgress": "false",
        },
    )
    out.sparkContext.setLogLevel("ERROR")
    yield out
    out.stop()


POSITIONS = ("top", "jng", "mid", "bot", "sup")


def match_rows(game="G1", blue="TB", red="TR", won="Blue", number=1, **over):
    """The twelve rows of one valid match."""
    rows = []
    meta = {
        "gameid": game, "datacompleteness": "complete", "url": "", "league": "LCK", "year": "2025", "split": "Spring", "playoffs": "0",
        "date": "2025-03-01 10:00:00", "game": str(number), "patch": "15.01", "gamelength": "1800", "ended_at": "2025-03-01 10:30:00",
    }
    meta |= {f"{k}{i}": f"C{i}" for k in ("pick", "ban") for i in range(1, 6)} | over
    for side, team, first in (("Blue", blue, 1), ("Red", red, 6)):
        result = "1" if side == won else "0"
        for i, position in enumerate(POSITIONS):
            n = first + i
            rows.append(meta | {"participantid": str(n), "side": side, "position": position, "playername": f"P {team}{i}", "playerid": f"{team}-p{i}", "teamname": f"Team {team}", "teamid": team, "champion": f"Champ{n}", "result": result})
        rows.append(meta | {"participantid": "100" if side == "Blue" else "200", "side": side, "position": "team", "playername": "", "playerid": "", "teamname": f"Team {team}", "teamid": team, "champion": "", "result": result})
    return rows


@pytest.fixture
def feed(spark):
    def make(rows):
        columns = list(dict.fromkeys(c for r in rows for c in r))
        return spark.createDataFrame([tuple(r.get(c) for c in columns) for r in rows], ", ".join(f"{c} string" for c in columns))

    return make
