"""Own fixture: a greenhouse project and an orchard, as raw table rows.

Sessions are written as turns; ids and times follow from their place.
"""

from __future__ import annotations

import json
import os

SESSION_COLS = ["id", "project_id", "slug", "directory", "title", "version", "time_created", "time_updated"]
MESSAGE_COLS = ["id", "session_id", "time_created", "time_updated", "data"]
PART_COLS = ["id", "message_id", "session_id", "time_created", "time_updated", "data"]

HOUSE, ORCHARD = "greenhouse", "orchard"
DAY0 = 1746086400000          # 2025-05-01 08:00 UTC
DAY, MINUTE = 86_400_000, 60_000
BROKEN = '{"type":"patch","files":[lib/valve.py'


def compact(value) -> str:
    return json.dumps(value, separators=(",", ":"), ensure_ascii=False)


def say(words):
    return compact({"type": "text", "text": words})


def call(tool, argument, output, title):
    return compact({"type": "tool", "tool": tool, "state": {"input": argument, "output": output, "title": title}})


def change(*files):
    return compact({"type": "patch", "files": list(files)})


#: (id, project, title, day, [(role, minute, [parts])])
STORY = [
    ("s-valve", HOUSE, "Open the valve on dry soil", 0, [
        ("user", 0, [say("Please water the beds whenever the soil probe reads dry.")]),
        ("assistant", 4, [call("write", {"filePath": "lib/valve.py"}, "saved lib/valve.py", "New valve driver"), change("lib/valve.py")])]),
    ("s-night", HOUSE, "Pause at night", 3, [
        ("user", 0, [say("No watering between ten and six, the pump is loud.")]),
        ("assistant", 2, [call("edit", {"filePath": "lib/valve.py"}, "two hunks", "Quiet hours"), change("lib/valve.py", "lib/quiet.py")])]),
    ("s-audit", HOUSE, "Who moves the water", 4, [
        ("user", 0, [say("List every caller of the valve.")]),
        ("assistant", 1, [call("grep", {"pattern": "valve"}, "lib/found.py and lib/valve.py", "Look for callers"),
                          say("The callers live in lib/told.py and lib/valve.py, nowhere else.")])]),
    ("s-setup", HOUSE, "Pump settings", 5, [
        ("assistant", 0, [call("write", {"filePath": "conf/pump.toml"}, "saved", "Pump settings"), change("conf/pump.toml")])]),
    ("s-drip", HOUSE, "Dripping after a reboot", 6, [
        ("user", 0, [say("It keeps dripping.")]),
        ("user", 3, [say("Only after a reboot, though.")]),
        ("assistant", 7, [call("edit", {"filePath": "lib/valve.py"}, "one hunk", "Close at start"), change("lib/valve.py")])]),
    ("s-trees", ORCHARD, "Irrigation for the trees", 8, [
        ("user", 0, [say("Reuse the greenhouse code for the young trees; thermocouple readings come hourly.")]),
        ("assistant", 5, [call("write", {"filePath": "lib/valve.py"}, "saved lib/valve.py", "Copy the driver"), change("lib/valve.py")])]),
    ("s-torn", HOUSE, "Torn record", 9, [("assistant", 0, [BROKEN])]),
]


def raw(story=STORY):
    """Rows of the session, message and part tables."""
    sessions, messages, parts = [], [], []
    for sid, project, title, day, turns in story:
        start = DAY0 + day * DAY
        for k, (role, minute, bodies) in enumerate(turns):
            at, mid = start + minute * MINUTE, f"{sid}-m{k}"
            messages.append((mid, sid, at, at, compact({"role": role, "agent": "gardener" if role == "assistant" else role})))
            parts += [(f"{mid}-p{j}", mid, sid, at + 1 + j, at + 1 + j, body) for j, body in enumerate(bodies)]
        sessions.append((sid, project, sid, f"/srv/{project}", title, "2", start, start + turns[-1][1] * MINUTE))
    return sessions, messages, parts


SESSIONS, MESSAGES, PARTS = raw()


def frames(spark, tables=None):
    tables = tables or (SESSIONS, MESSAGES, PARTS)
    return [spark.createDataFrame(t, c) for t, c in zip(tables, (SESSION_COLS, MESSAGE_COLS, PART_COLS))]


def history(spark, tables=None):
    from convsift.sources.tables import normalise_tables
    return normalise_tables(*frames(spark, tables))


def at(sid, turn):
    """Time of a message."""
    return next(m[2] for m in MESSAGES if m[0] == f"{sid}-m{turn}")


def _put(root, kind, folder, name, text):
    path = os.path.join(root, kind, folder)
    os.makedirs(path, exist_ok=True)
    with open(os.path.join(path, f"{name}.json"), "w", encoding="utf-8") as f:
        f.write(text)


def write_tree(root, sessions, messages, parts):
    """The same rows in the one-object-per-file layout; unparsable payloads are written as they are."""
    for sid, project, _, directory, title, _, created, updated in sessions:
        _put(root, "session", project, sid, json.dumps({"id": sid, "projectID": project, "title": title, "directory": directory,
                                                        "time": {"created": created, "updated": updated}}))
    for mid, sid, created, _, data in messages:
        _put(root, "message", sid, mid, json.dumps({**json.loads(data), "id": mid, "sessionID": sid, "time": {"created": created}}))
    for pid, mid, sid, created, _, data in parts:
        whole = data if data == BROKEN else json.dumps({**json.loads(data), "id": pid, "messageID": mid, "sessionID": sid, "time": {"created": created}})
        _put(root, "part", mid, pid, whole)
