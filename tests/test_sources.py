import os

import pytest
from pyspark.sql import Observation

from convsift.functions.patterns import build_matcher
from convsift.operators.keyword import search_keyword
from convsift.operators.report import trace_entries, write_report
from convsift.operators.trace import trace_file
from convsift.plans.search import search, search_report
from convsift.sources.history import load_history, write_history
from convsift.sources.tables import normalise_tables
from convsift.sources.tree import read_json_tree
import history_data as data
from history_data import compact


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def decoded(spark, parts, message='{"role":"assistant"}'):
    """Parts of one message, from (id, payload) pairs."""
    return normalise_tables(*data.frames(spark, (
        [("one", "p", "x", "/d", "t", "2", 1, 2)], [("m", "one", 5, 5, message), ("torn", "one", 6, 6, "{role")],
        [(i, "m", "one", 6 + k, 6 + k, body) for k, (i, body) in enumerate(parts)])))


@pytest.fixture(scope="module")
def tree(tmp_path_factory):
    root = str(tmp_path_factory.mktemp("tree"))
    data.write_tree(root, data.SESSIONS, data.MESSAGES, data.PARTS)
    os.makedirs(os.path.join(root, "session", "attic"))
    with open(os.path.join(root, "session", "attic", "half.json"), "w") as f:
        f.write('{"id": "half", "title"')
    return root


def test_tree_equals_tables(spark, tree):
    t, j = data.history(spark), read_json_tree(spark, tree)
    for kind in ("sessions", "messages", "parts"):
        assert rows(getattr(t, kind)) == rows(getattr(j, kind))
    m = build_matcher("valve", spark=spark)
    assert rows(search_keyword(t, m)) == rows(search_keyword(j, m))
    assert rows(trace_file(t, "lib/valve.py")) == rows(trace_file(j, "lib/valve.py"))


def test_tree_of_one_project_and_of_none(spark, tree, tmp_path):
    one = read_json_tree(spark, tree, project_id=data.ORCHARD)
    assert [r.session_id for r in one.sessions.collect()] == ["s-trees"]
    assert {r.session_id for r in one.parts.collect()} == {"s-trees"}
    nothing = read_json_tree(spark, str(tmp_path))
    assert nothing.sessions.count() == nothing.parts.count() == 0


@pytest.mark.parametrize("name", ["rose bed+1", "a[1]", "{x,y}", "what?", "star*"])
def test_odd_folder_names(spark, tmp_path, name):
    for project in (name, "a1", "x", "stars", "whatx"):
        data.write_tree(str(tmp_path), [(f"in {project}", project, "z", "/z", "zeta", "2", 1, 2)], [], [])
    assert {r.project_id for r in read_json_tree(spark, str(tmp_path)).sessions.collect()} == {name, "a1", "x", "stars", "whatx"}
    assert [r.project_id for r in read_json_tree(spark, str(tmp_path), project_id=name).sessions.collect()] == [name]


def test_unreadable_files_and_rows_are_counted(spark, tree):
    obs = {"sessions": Observation("s"), "parts": Observation("p")}
    h = read_json_tree(spark, tree, observations=obs)
    assert h.sessions.count() == len(data.SESSIONS) and h.parts.count() == len(data.PARTS) - 1
    assert obs["sessions"].get["corrupt_sessions"] == 1 and obs["parts"].get["corrupt_parts"] == 1
    seen = Observation("rows")
    assert normalise_tables(*data.frames(spark), part_observation=seen).parts.count() == len(data.PARTS) - 1
    assert seen.get["corrupt_parts"] == 1
    with pytest.raises(Exception, match="Malformed JSON"):
        normalise_tables(*data.frames(spark), on_corrupt="fail").parts.collect()


def test_payloads(spark):
    parts = [("gone", '{"type":"step-finish","text":"hidden"}'), ("file", '{"type":"file"}'),
             ("text", '{"type":"tool","tool":"bash","state":{"input":"du -h","output":"x"}}'),
             ("zero", '{"type":"tool","tool":"bash","state":{"input":0}}'),
             ("order", '{"type":"tool","tool":"bash","state":{"input":{"b":1,"a":[1,2]}}}'),
             ("bare", '{"type":"tool","tool":"bash"}')]
    h = decoded(spark, parts)
    assert [(r.message_id, r.role, r.agent) for r in h.messages.collect()] == [("m", "assistant", "")]
    assert {r.part_id: (r.type, r.input_json, r.has_state) for r in h.parts.collect()} == {
        "file": ("file", None, False), "text": ("tool", '"du -h"', True), "zero": ("tool", "{}", True),
        "order": ("tool", '{"b":1,"a":[1,2]}', True), "bare": ("tool", None, False)}


def test_fields_of_unexpected_shape(spark):
    parts = [("state", '{"type":"text","text":"kept words","state":"done"}'), ("files", '{"type":"text","text":"kept too","files":"x"}'),
             ("tool", '{"type":"tool","tool":"write","state":{"input":{"filePath":"lib/a.py"}},"files":{}}'),
             ("word", '{"type":"tool","tool":"bash","state":"done"}'), ("patch", '{"type":"patch","files":"lib/b.py"}'),
             ("number", '{"type":"text","text":7}')]
    h = decoded(spark, parts)
    got = {r.part_id: (r.text, r.input_json, r.files) for r in h.parts.collect()}
    assert got == {"state": ("kept words", None, None), "files": ("kept too", None, None), "tool": (None, '{"filePath":"lib/a.py"}', None),
                   "word": (None, "{}", None), "patch": (None, None, None), "number": ("7", None, None)}
    assert trace_file(h, "lib/a.py").count() == 1


def test_times_in_tree_files(spark, tmp_path):
    times = ["1.5", "1.7e12", '"12"', "null"]
    for k, t in enumerate(times):
        data._put(str(tmp_path), "session", "p", f"s{k}", f'{{"id":"s{k}","title":"t","time":{{"created":{t},"updated":{t}}}}}')
        data._put(str(tmp_path), "message", f"s{k}", f"m{k}", f'{{"id":"m{k}","role":"assistant","time":{{"created":{t}}}}}')
        data._put(str(tmp_path), "part", f"m{k}", f"q{k}", compact({"id": f"q{k}", "type": "tool", "tool": "bash", "state": {"time": {"start": 40 + k}}}))
    h = read_json_tree(spark, str(tmp_path))
    assert sorted((r.session_id, r.created_ms) for r in h.sessions.collect()) == [("s0", 1), ("s1", 1_700_000_000_000), ("s2", 12), ("s3", None)]
    assert sorted((r.part_id, r.created_ms) for r in h.parts.collect()) == [(f"q{k}", 40 + k) for k in range(4)]


def test_parquet_round_trip(spark, tree, tmp_path):
    write_history(read_json_tree(spark, tree), str(tmp_path / "h"), partitions=2)
    h = load_history(spark, str(tmp_path / "h"))
    assert rows(h.parts) == rows(data.history(spark).parts)
    assert [x.session_id for x in search(h, file_path="valve.py", project_id=data.HOUSE).collect()] == ["s-drip", "s-night", "s-valve"]
    assert search(h, query="dripping", mode="fuzzy", fuzzy_threshold=0.2, limit=5).count() > 0
    assert search_report(h, query="no such words", limit=5) == "No matches found in conversation history."


def test_stored_backslashes_opt_in(spark):
    h = decoded(spark, [("a", '{"type":"patch","files":["lib\\\\win.py"]}')])
    assert trace_file(h, "lib/win.py").count() == 0
    assert [r.file_path for r in trace_file(h, "lib/win.py", normalize_stored=True).collect()] == ["lib/win.py"]


def test_report_files(spark, tmp_path):
    out = str(tmp_path / "report")
    write_report(trace_entries(trace_file(data.history(spark), "valve.py", project_id=data.HOUSE)), out)
    text = "".join(open(os.path.join(out, f)).read() for f in sorted(os.listdir(out)) if f.startswith("part-"))
    assert text.count("## ") == 3 and "- Status: First seen" in text
