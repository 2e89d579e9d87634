"""Spark operators against brute force over the same small random histories.

Keyword: every match of every row is listed with its walk key (SURVEY §2: O1,
O2, O4), sorted, the first N taken and shown newest first.  Times collide and
span days, so ties, limits and the as-of lookup across buckets are exercised.
"""

import json
import random
import re

import pytest

from convsift.functions.patterns import build_matcher
from convsift.operators.keyword import search_keyword
from convsift.operators.trace import trace_file
from convsift.sources.tables import normalise_tables
import history_data as fx

WORDS = ["alpha", "beta", "Gamma", "delta", "storage", "Store", "auth", "login", "the", "pool"]
PATHS = ["src/a.ts", "src/b.ts", "lib/a.ts", "a.ts", "src/deep/b.ts"]
DAY = 86_400_000


def random_history(seed):
    rnd = random.Random(seed)
    sessions, messages, parts = [], [], []
    base = 1_700_000_000_000
    for si in range(rnd.randint(3, 6)):
        sid = f"ses_{seed}_{si}"
        proj = rnd.choice(["p1", "p2"])
        t0 = base + rnd.randint(0, 6) * DAY + rnd.randint(0, 5) * 1000
        msgs = []
        for mi in range(rnd.randint(1, 6)):
            mid = f"msg_{seed}_{si}_{mi}"
            ts = t0 + rnd.choice([0, 1, 2]) * DAY + rnd.randint(0, 3) * 1000   # ties happen
            role = rnd.choice(["user", "assistant"])
            msgs.append(ts)
            messages.append((mid, sid, ts, ts, json.dumps({"role": role, "agent": "x"})))
            for pi in range(rnd.randint(1, 3)):
                pid = f"prt_{seed}_{si}_{mi}_{pi}"
                pt = ts + rnd.randint(0, 2)
                kind = rnd.choice(["text", "text", "tool", "patch"])
                if kind == "text":
                    data = {"type": "text", "text": " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 8)))}
                elif kind == "tool":
                    data = {"type": "tool", "tool": rnd.choice(["write", "edit", "bash", "storage_tool"]),
                            "state": {"input": {"filePath": rnd.choice(PATHS)},
                                      "output": " ".join(rnd.choice(WORDS) for _ in range(3)),
                                      "title": rnd.choice(["", "Edit file", "Store it"])}}
                else:
                    data = {"type": "patch", "files": rnd.sample(PATHS, rnd.randint(1, 3))}
                parts.append((pid, mid, sid, pt, pt, json.dumps(data, separators=(",", ":"))))
        updated = max(msgs)
        title = " ".join(rnd.choice(WORDS) for _ in range(rnd.randint(1, 4)))
        sessions.append((sid, proj, "slug", f"/dir/{proj}", title, "v1", t0, updated))
    return sessions, messages, parts


# ------------------------------------------------------------ walk oracles

def part_matches(d, hit):
    """(slot, order, type, excerpt, context) of every match of one part."""
    def around(text):
        word = hit(text).group()
        i = text.index(word)
        return word, text[max(0, i - 100):i + len(word) + 100]

    found = []
    if d["type"] == "text" and hit(d["text"]):
        found.append((1, 0, "message", *around(d["text"])))
    if d["type"] == "tool":
        label = d["state"]["title"] or d["tool"]
        texts = [json.dumps(d["state"]["input"], separators=(",", ":")), d["state"]["output"]]
        if hit(d["tool"]):
            found.append((2, 0, "tool", d["tool"], label))
        found += [(3, 0, "filepath", hit(t).group(), label) for t in texts if hit(t)][:1]
    if d["type"] == "patch":
        found += [(4, i, "filepath", f, "Modified file: " + f) for i, f in enumerate(d["files"]) if hit(f)]
    return found


def brute_keyword(sessions, messages, parts, query, limit, role=None, project=None):
    hit = re.compile(re.escape(query), re.IGNORECASE).search
    session = {s[0]: s for s in sessions if project in (None, s[1])}
    message = {m[0]: m for m in messages if m[1] in session and role in (None, json.loads(m[4])["role"])}
    found = [((-s[7], s[0], 0), s[7], s, "title", s[4], s[4], None, None) for s in session.values() if hit(s[4])]
    for p in parts:
        if p[1] in message:
            m = message[p[1]]
            s = session[m[1]]
            found += [((-s[7], s[0], 1, m[2], m[0], p[3], p[0], slot, i), m[2], s, kind, ex, cx, m[0], p[0])
                      for slot, i, kind, ex, cx in part_matches(json.loads(p[5]), hit)]
    first = sorted(found, key=lambda f: f[0])[:limit]
    return [(s[0], s[4], t, kind, ex, cx, mid, pid, s[3]) for _, t, s, kind, ex, cx, mid, pid in sorted(first, key=lambda f: -f[1])]


def walk_trace(sessions, messages, parts, query, limit=50, project=None):
    q = query.replace("\\", "/")
    exact = "/" in q
    match = (lambda p: p == q) if exact else (lambda p: p == q or p.endswith("/" + q))
    sess = {s[0]: s for s in sessions if project is None or s[1] == project}
    msgs = {m[0]: m for m in messages if m[1] in sess}
    cands = []
    for p in parts:
        m = msgs.get(p[1])
        if m is None or json.loads(m[4])["role"] != "assistant":
            continue
        d = json.loads(p[5])
        if d["type"] == "tool" and d.get("tool") in ("write", "edit"):
            fp = d["state"]["input"].get("filePath")
            if fp and match(fp):
                cands.append((m[2], 0, m[1], m[0], fp, d["tool"], p[3], p[0]))
        elif d["type"] == "patch":
            hit = next((f for f in d["files"] if match(f)), None)
            if hit:
                cands.append((m[2], 1, m[1], m[0], hit, None, p[3], p[0]))
    best = {}
    for c in sorted(cands, key=lambda c: (c[1], c[6], c[7])):
        best.setdefault((c[2], c[3], c[4]), c)
    rows = sorted(best.values(), key=lambda c: (-c[0], c[1], c[2], c[3], c[4]))
    first = min(best.values(), key=lambda c: (c[0], c[1], c[2], c[3], c[4]), default=None)
    out = []
    for c in rows[:limit]:
        prompts = [(m[2], m[0], -p[3], p[0], json.loads(p[5]).get("text"))
                   for p in parts for m in [msgs.get(p[1])]
                   if m is not None and m[1] == c[2] and m[2] < c[0]
                   and json.loads(m[4])["role"] == "user" and json.loads(p[5])["type"] == "text"]
        prompt = max(prompts)[4] if prompts else None
        out.append((c[2], sess[c[2]][4], c[0], c is first, prompt, c[5], c[4]))
    return out


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_keyword_matches_brute_force(spark, seed):
    s, m, p = random_history(seed)
    h = normalise_tables(spark.createDataFrame(s, fx.SESSION_COLS), spark.createDataFrame(m, fx.MESSAGE_COLS),
                         spark.createDataFrame(p, fx.PART_COLS))
    for query, limit, role, project in [("stor", 7, None, None), ("the", 3, "user", None),
                                        ("a.ts", 50, None, "p1"), ("GAMMA", 12, "assistant", None)]:
        got = [tuple(r) for r in search_keyword(h, build_matcher(query, spark=spark), limit=limit,
                                                role=role, project_id=project).collect()]
        want = brute_keyword(s, m, p, query, limit, role, project)
        assert got == want, (seed, query)


@pytest.mark.parametrize("seed", [4, 5, 6])
def test_trace_matches_walk(spark, seed):
    s, m, p = random_history(seed)
    h = normalise_tables(spark.createDataFrame(s, fx.SESSION_COLS), spark.createDataFrame(m, fx.MESSAGE_COLS),
                         spark.createDataFrame(p, fx.PART_COLS))
    for query, limit, project in [("a.ts", 50, None), ("src/b.ts", 3, None), ("b.ts", 50, "p2")]:
        got = [tuple(r) for r in trace_file(h, query, limit=limit, project_id=project).collect()]
        want = walk_trace(s, m, p, query, limit, project)
        assert got == want, (seed, query)
