import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from convsift.llm import periodic


def all_runs(w, least=12):
    """Every diagonal of every lag, word by word."""
    out = {}
    for lag in range(1, len(w) // 2 + 1):
        i = lag
        while i < len(w):
            start = i
            while i < len(w) and w[i] == w[i - lag]:
                i += 1
            if i - start >= lag and i - start + lag >= least:
                out.setdefault((start - lag, i), lag)
            i += 1
    return sorted(((s, e - s, q) for (s, e), q in out.items()), key=lambda r: (r[0], r[2]))


def sequences(seed):
    rng = random.Random(seed)
    for _ in range(150):
        yield [rng.randrange(rng.choice([1, 2, 3])) for _ in range(rng.randrange(200))]
    for _ in range(150):
        w = []
        for _ in range(rng.randrange(1, 8)):
            u = [rng.randrange(rng.choice([2, 3, 50])) for _ in range(rng.randrange(1, 70))]
            w += u * rng.randrange(1, 5) + u[:rng.randrange(len(u) + 1)]
        yield w
    a, b, thue = [0], [0, 1], [0]
    while len(b) < 600:
        a, b = b, b + a
        thue += [1 - x for x in thue] if len(thue) < 600 else []
        yield b
        yield thue
        yield [*b, 5, *b]
    for n in (1, 11, 12, 13, 100, 300):
        yield [0] * n
        yield [0] * n + [1] + [0] * n + [2, 0] * n


def test_runs_against_all_diagonals():
    for w in sequences(4):
        assert periodic.find_runs(np.array(w, np.int64)) == all_runs(w)


def test_other_hashes_and_least_lengths():
    for w in list(sequences(5))[::7]:
        assert periodic.find_runs(np.array(w, np.int64), seed=3) == all_runs(w)
        assert periodic.find_runs(np.array(w, np.int64), least=40) == all_runs(w, 40)


def test_agreeing_hashes_are_noticed(monkeypatch):
    """With hashes of three bits for the first seed, the runs are still right."""
    mix = periodic.mix64
    calls = []

    def weak(x):
        calls.append(1)
        return mix(x) & np.uint64(7) if len(calls) < 6 else mix(x)

    w = np.array([random.Random(1).randrange(40) for _ in range(400)] + list(range(60)) * 3)
    want = all_runs(w.tolist())
    monkeypatch.setattr(periodic, "mix64", weak)
    assert periodic.find_runs(w) == want


def test_time_does_not_grow_with_the_square():
    assert periodic.find_runs(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]
    w = np.tile(np.arange(5_000), 20)
    assert periodic.find_runs(w) == [(0, 100_000, 5_000)]


def words_of(doc_id, text):
    w = re.findall("[^\x20\x09-\x0d]+", text or "")
    if doc_id is not None:
        h = zlib.crc32(str(doc_id).encode())
        g, n = h // 10, len(w)
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    return w


def expected(doc_id, text):
    w = words_of(doc_id, text)
    runs = all_runs(w)
    best = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None,) * 3
    gone = {i for s, n, q in runs for i in range(s + q, s + n)}
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in runs)
    kept = " ".join(x for i, x in enumerate(w) if i not in gone)
    return (doc_id, len(runs), *best, 1000 * best[1] // best[2] if runs else None,
            hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept.encode()).hexdigest())


def run(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return Counter(tuple(r) for r in periodic.query(spark, str(tmp_path)).collect())


def test_whole_table(spark, make_docs, clashing, tmp_path):
    rng = random.Random(6)
    vocab = ["".join(rng.choices("abcé字.", k=rng.randint(1, 3))) for _ in range(60)]
    rows = [(i, rng.choice([" ", "  ", "\n"]).join(rng.choices(vocab[:rng.choice([2, 5, 60])], k=rng.randrange(250)))) for i in range(250)]
    rows += [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "a " * 4000), (905, "one two three " * 700 + "four"), (None, "a b " * 30),
             (None, None), (7, rows[7][1]), (7, "x y z " * 9), (906, "w" * 200_000), (-12, "p q r " * 40), (907, "    " * 20)]
    want = Counter(expected(*r) for r in rows)
    assert run(spark, tmp_path, clashing(make_docs(rows))) == want
    assert sum(n for r, n in want.items() if r[1]) > 30


def test_empty_table(spark, make_docs, tmp_path):
    assert not run(spark, tmp_path, make_docs([]))


def test_operator_returns_runs_and_texts(spark, make_docs):
    text = "see " + "na batman " * 8 + "end"
    row = periodic.detect_runs(make_docs([(1, text)])).first()
    assert [tuple(r) for r in row.runs] == [(1, 16, 2)]
    assert row.collapsed == "see na batman end"
    assert periodic.detect_runs(make_docs([(1, text)]), least=17).first().runs == []
