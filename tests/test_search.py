"""The unified entry and the command line."""

from datetime import datetime, timezone

import pytest

from convsift.__main__ import main
from convsift.plans.search import search, search_report
from convsift.sources.history import write_history
import history_data as data


@pytest.fixture(scope="module")
def hist(spark):
    return data.history(spark)


@pytest.fixture(scope="module")
def stored(hist, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("stored"))
    write_history(hist, out, partitions=2)
    return out


def test_needs_query_or_path(hist, stored):
    with pytest.raises(ValueError, match="Either 'query' or 'filePath' must be provided"):
        search(hist, query="", file_path="")
    assert main(["--history", stored]) == 2


@pytest.mark.parametrize("wrong", [{"mode": "semantic"}, {"date_scope": "both"}, {"limit": -1}])
def test_wrong_arguments(hist, wrong):
    with pytest.raises(ValueError):
        search(hist, query="valve", **wrong)


def test_path_wins_over_query(hist):
    r = search(hist, query="anything", file_path="conf/pump.toml", mode="fuzzy")
    assert "first_touch" in r.columns and [x.session_id for x in r.collect()] == ["s-setup"]


def test_dates_to_come_find_nothing(hist):
    now = datetime(2031, 1, 1, tzinfo=timezone.utc)
    assert search(hist, query="the", date="today", now=now).count() == 0
    assert search_report(hist, query="the", date="2030-12", now=now) == "No matches found in conversation history."


def test_modes(hist):
    assert search(hist, query="irigation", mode="fuzzy", fuzzy_threshold=0.3).first().session_id == "s-trees"
    assert search(hist, query="s.il", regex=True).first().session_id == "s-valve"


def test_limit_zero(hist):
    assert search(hist, file_path="valve.py", limit=0).count() == 0
    assert search(hist, query="valve", mode="fuzzy", limit=0).count() == 0
    assert search(hist, query="valve", limit=0).count() == search(hist, query="valve", limit=50).count() > 0
    assert search_report(hist, file_path="valve.py", limit=0) == "No file trace matches found in conversation history."


def test_command_line(stored, capsys, tmp_path):
    assert main(["--history", stored, "--file-path", "valve.py", "--project-id", data.HOUSE, "--limit", "2"]) == 0
    out = capsys.readouterr().out
    assert out.startswith("Found 2 file trace matches") and "- Session ID: s-drip" in out and "- Status: Later touch" in out
    assert main(["--history", stored, "--query", "pump", "--limit", "3"]) == 0
    assert "- Match Type:" in capsys.readouterr().out
    data.write_tree(str(tmp_path), data.SESSIONS, data.MESSAGES, data.PARTS)
    assert main(["--history", str(tmp_path), "--layout", "json_tree", "--query", "irigation", "--mode", "fuzzy",
                 "--fuzzy-threshold", "0.3", "--limit", "3"]) == 0
    assert "- Session ID: s-trees" in capsys.readouterr().out
