import json
import os

import pytest

import history_data as data
from convsift.operators.trace import trace_file
from convsift.sources import store as st
from convsift.sources.tree import read_json_tree

TABLES = ("sessions", "messages", "parts")


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(spark, path, root):
    """Every relation and derived table of the store is that of the tree read at once."""
    from convsift.operators.items import build_items
    from convsift.operators.trace import build_prompts, build_touches
    h, whole = st.load_store(spark, path), read_json_tree(spark, root)
    for t in TABLES:
        assert rows(getattr(h, t)) == rows(getattr(whole, t)), t
    assert rows(h.items) == rows(build_items(whole))
    assert rows(h.touches) == rows(build_touches(whole.parts))
    assert rows(h.prompts) == rows(build_prompts(whole.parts))
    assert rows(trace_file(h, "valve.py")) == rows(trace_file(whole, "valve.py"))


@pytest.fixture(autouse=True)
def few_slots(request, monkeypatch):
    """Fewer folders, so that the tests' small tables are written fast."""
    if "touched" not in request.node.name:
        monkeypatch.setattr(st, "SLOTS", 3)


def put(root, kind, folder, name, value):
    path = os.path.join(root, kind, folder)
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, f"{name}.json"), "w") as f:
        f.write(value if isinstance(value, str) else json.dumps(value))


@pytest.fixture
def tree(tmp_path):
    root = str(tmp_path / "tree")
    data.write_tree(root, data.SESSIONS, data.MESSAGES, data.PARTS)
    return root


@pytest.fixture
def fetched(monkeypatch):
    """Names of the files that an ingest reads."""
    names = []
    read = st.read_files
    monkeypatch.setattr(st, "read_files", lambda spark, paths: names.extend(os.path.basename(p) for p in paths) or read(spark, paths))
    return names


def test_first_ingest_and_an_unchanged_source(spark, tree, tmp_path, fetched):
    path = str(tmp_path / "store")
    first = st.ingest_tree(spark, tree, path)
    assert len(fetched) == len(data.SESSIONS) + len(data.MESSAGES) + len(data.PARTS)
    same(spark, path, tree)
    fetched.clear()
    assert st.ingest_tree(spark, tree, path) == first and fetched == []


def test_changes_of_every_kind(spark, tree, tmp_path, fetched):
    path = str(tmp_path / "store")
    st.ingest_tree(spark, tree, path)
    fetched.clear()
    # A changed title, a late part, a new session, a message whose session is missing yet.
    put(tree, "session", data.HOUSE, "s-night", {"id": "s-night", "title": "Renamed, and longer", "directory": "/srv/new", "time": {"created": 1, "updated": 99}})
    put(tree, "part", "s-audit-m1", "late", {"id": "late", "type": "patch", "files": ["lib/valve.py"], "time": {"created": 7}})
    put(tree, "session", "attic", "s-new", {"id": " s-new ", "title": "New", "time": {"created": 1, "updated": 2}})
    put(tree, "message", "s-new", "m-new", {"id": "m-new", "role": "user", "time": {"created": 3}})
    put(tree, "message", "s-later", "m-later", {"id": "m-later", "role": "assistant", "time": {"created": 4}})
    put(tree, "part", "m-later", "p-later", {"id": "p-later", "type": "tool", "tool": "write", "state": {"input": {"filePath": "valve.py"}}})
    put(tree, "part", "m-unknown", "p-unknown", {"id": "p-unknown", "type": "text", "text": "an early part"})
    st.ingest_tree(spark, tree, path)
    assert sorted(fetched) == ["late.json", "m-later.json", "m-new.json", "p-later.json", "p-unknown.json", "s-new.json", "s-night.json"]
    same(spark, path, tree)
    # What waited gets its owner; other files go.
    put(tree, "session", data.ORCHARD, "s-later", {"id": "s-later", "title": "Later", "time": {"created": 1, "updated": 2}})
    put(tree, "message", "s-new", "m-unknown", {"id": "m-unknown", "role": "user", "time": {"created": 2}})
    os.remove(os.path.join(tree, "message", "s-drip", "s-drip-m1.json"))
    os.remove(os.path.join(tree, "session", data.HOUSE, "s-valve.json"))
    os.remove(os.path.join(tree, "part", "s-trees-m1", "s-trees-m1-p0.json"))
    st.ingest_tree(spark, tree, path)
    same(spark, path, tree)
    # Back again, and the same ids in another project and under another message.
    put(tree, "session", data.ORCHARD, "s-valve", {"id": "s-valve", "title": "Moved", "time": {"created": 1, "updated": 2}})
    put(tree, "session", "attic", "s-night", {"id": "s-night", "title": "Twice", "time": {"created": 1, "updated": 2}})
    put(tree, "message", "s-drip", "s-trees-m1", {"id": "s-trees-m1", "role": "assistant", "time": {"created": 2}})
    st.ingest_tree(spark, tree, path)
    same(spark, path, tree)
    os.remove(os.path.join(tree, "message", "s-trees", "s-trees-m1.json"))
    st.ingest_tree(spark, tree, path)
    same(spark, path, tree)


def test_only_touched_slots_are_written(spark, tree, tmp_path):
    path = str(tmp_path / "store")
    first = st.ingest_tree(spark, tree, path)
    put(tree, "part", "s-audit-m1", "late", {"id": "late", "type": "text", "text": "more"})
    second = st.ingest_tree(spark, tree, path)
    changed = {s for s, b in second.slots["parts"].items() if first.slots["parts"].get(s) != b}
    assert len(changed - {st.PENDING}) == 1 < len(second.slots["parts"])


@pytest.mark.parametrize("table", ["parts", "prompts"])
def test_a_stop_leaves_the_old_version(spark, tree, tmp_path, monkeypatch, table):
    path = str(tmp_path / "store")
    st.ingest_tree(spark, tree, path)
    before = {t: rows(getattr(st.load_store(spark, path), t)) for t in ("sessions", "parts", "touches")}
    put(tree, "session", data.HOUSE, "s-night", {"id": "s-night", "title": "Renamed and longer", "time": {"created": 1, "updated": 99}})
    write = st._write

    def stopping(df, store, name, *rest):
        if name == table:
            raise RuntimeError("stopped")
        return write(df, store, name, *rest)

    monkeypatch.setattr(st, "_write", stopping)
    with pytest.raises(RuntimeError):
        st.ingest_tree(spark, tree, path)
    assert {t: rows(getattr(st.load_store(spark, path), t)) for t in before} == before
    monkeypatch.undo()
    st.ingest_tree(spark, tree, path)
    same(spark, path, tree)


def test_rejects_and_mended_files(spark, tree, tmp_path):
    path = str(tmp_path / "store")
    put(tree, "part", "s-audit-m1", "empty", " ")
    put(tree, "part", "s-audit-m1", "nameless", {"type": "text", "text": "x"})
    put(tree, "part", "s-audit-m1", "step", {"id": "step", "type": "step-start"})
    put(tree, "message", "s-audit", "half", '{"id": "half", "ro')
    version = st.ingest_tree(spark, tree, path)
    found = {(os.path.basename(r.src), r.level, r.reason) for r in st.rejects(spark, path).collect()}
    assert found == {("empty.json", "part", "empty"), ("nameless.json", "part", "no id"), ("step.json", "part", "other type"),
                     ("half.json", "message", "malformed"), ("s-torn-m0-p0.json", "part", "malformed")}
    # Good and rejected files are all there are.
    stored = sum(st._read(spark, path, version, t, st._SCHEMAS[t]).select("src").distinct().count() for t in TABLES)
    assert stored + len(found) == st.manifest(spark, path, version).count()
    put(tree, "message", "s-audit", "half", {"id": "half", "role": "user", "time": {"created": 1}})
    st.ingest_tree(spark, tree, path)
    assert "half.json" not in {os.path.basename(r.src) for r in st.rejects(spark, path).collect()}
    assert len(st.rejects(spark, path, version).collect()) == len(found)
    same(spark, path, tree)


def test_many_changed_files_are_read_by_level(spark, tree, tmp_path, monkeypatch):
    monkeypatch.setattr(st, "MAX_NAMED", 3)
    path = str(tmp_path / "store")
    st.ingest_tree(spark, tree, path)
    same(spark, path, tree)


def test_an_empty_source(spark, tmp_path):
    path, root = str(tmp_path / "store"), str(tmp_path / "nothing")
    st.ingest_tree(spark, root, path)
    h = st.load_store(spark, path)
    assert [getattr(h, t).count() for t in (*TABLES, "items", "touches", "prompts")] == [0] * 6
    data.write_tree(root, data.SESSIONS, data.MESSAGES, data.PARTS)
    st.ingest_tree(spark, root, path)
    same(spark, path, root)


def test_no_store(spark, tmp_path):
    with pytest.raises(ValueError, match="no history"):
        st.load_store(spark, str(tmp_path / "none"))


def test_scoped_tree_reads_only_its_folders(spark, tree):
    whole, scoped = read_json_tree(spark, tree), read_json_tree(spark, tree, data.ORCHARD)
    for t in TABLES:
        assert rows(getattr(scoped, t)) == rows(getattr(whole, t).where(f"project_id = '{data.ORCHARD}'"))
    read = {os.path.basename(os.path.dirname(f)) for t in TABLES for f in getattr(scoped, t).inputFiles()}
    assert read == {data.ORCHARD, "s-trees", "s-trees-m0", "s-trees-m1"}


def test_a_first_ingest_compares_with_nothing(spark, tmp_path, monkeypatch):
    """No manifest is joined, no changed files are looked for, and no stored rows read."""
    read = st._read
    monkeypatch.setattr(st, "manifest", None)
    monkeypatch.setattr(st, "_read", lambda *a, **k: read(*a, **k) if a[2] is not None else 1 / 0)
    files = {level: spark.createDataFrame(rows, "src string, folder string, data string, modified long") for level, rows in {
        "session": [("a", "p", '{"id":"s","title":"T","time":{"created":1,"updated":2}}', 1)],
        "message": [("b", "s", '{"id":"m","role":"user","time":{"created":1}}', 1)],
        "part": [("c", "m", '{"id":"x","type":"text","text":"hello"}', 1)]}.items()}
    path = str(tmp_path / "store")
    st.ingest_frames(spark, path, files, slots=2)
    assert [r.text for r in st.load_store(spark, path).parts.collect()] == ["hello"]
