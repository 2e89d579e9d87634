import random
import re

import numpy as np
import pytest

from convsift.llm import minhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def shingles(text):
    w = WORD.findall((text or "").translate({c: c + 32 for c in range(65, 91)}))
    if len(w) < 5:
        return {tuple(w)} if w else set()
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)}


def brute(rows):
    """Sorted (doc_id, n, component, kept) by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            a, b = sets[i], sets[j]
            same = a and b and 100 * len(a & b) >= 85 * len(a | b)
            if same or (rows[i][0] == rows[j][0] and rows[i][0] is not None and a and b):
                parent[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        least.setdefault(find(i), []).append(d)
    out = []
    for i, (d, _) in enumerate(rows):
        ids = [x for x in least[find(i)] if x is not None]
        c = min(ids) if ids else None
        out.append((d, len(sets[i]), c, d == c))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in df.collect()), key=str)


def corpus(seed, groups=6, copies=8):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefgh", k=rng.randint(1, 6))) for _ in range(300)]
    rows, n = [], 0
    for _ in range(groups):
        base = rng.choices(vocab, k=rng.randint(30, 150))
        for c in range(copies):
            words = list(base)
            for _ in range(rng.randint(0, max(1, len(words) // 40 * (1 + c % 3)))):
                words[rng.randrange(len(words))] = rng.choice(vocab)
            rows.append((n, " ".join(words)))
            n += 1
    rng.shuffle(rows)
    return rows


EDGES = [(900, None), (901, ""), (902, " \t\n"), (903, "One two"), (904, "one  TWO"), (905, "one two three"),
         (906, "a b c d e"), (907, "A\tB\nC d e"), (908, "x " * 3000), (908, "x " * 3000), (909, "é Ü ß ñ Ç"), (910, "é ü ß ñ Ç")]


def test_against_all_pairs(spark, make_docs, clashing):
    rows = corpus(1) + EDGES
    assert got(minhash.near_duplicates(clashing(make_docs(rows)))) == brute(rows)


def test_large_groups_lose_nothing(spark, make_docs, monkeypatch):
    # Bounds so small that prefix units and crowds' blocks do the work.
    monkeypatch.setattr(minhash, "GROUP_MEMBERS", 5)
    monkeypatch.setattr(minhash, "BLOCK", 4)
    rows = corpus(2, groups=4, copies=25)
    assert got(minhash.near_duplicates(make_docs(rows))) == brute(rows)


def test_null_ids_and_empty_table(spark, make_docs):
    rows = [(None, "a b c d e f"), (7, "a b c d e f"), (None, "p q r s t u v")]
    out = got(minhash.near_duplicates(make_docs(rows)))
    assert out == sorted([(None, 2, 7, False), (7, 2, 7, True), (None, 3, None, True)], key=str)
    assert got(minhash.near_duplicates(make_docs([]))) == []


def test_one_id_with_two_texts(spark, make_docs):
    rows = [(5, "a b c d e f g"), (5, "m n o p q r s"), (9, "m n o p q r s"), (3, "a b c d e f g")]
    out = {(r[0], r[2]) for r in got(minhash.near_duplicates(make_docs(rows)))}
    assert out == {(5, 3), (9, 3), (3, 3)}


@pytest.mark.parametrize("shape", ["path", "star", "rings"])
def test_components(spark, shape):
    edges = {"path": [(i, i + 1) for i in range(40)], "star": [(0, i) for i in range(1, 50)],
             "rings": [(10 * g + i, 10 * g + (i + 1) % 5) for g in range(6) for i in range(5)]}[shape]
    out = minhash.components(spark.createDataFrame(edges, "a bigint, b bigint")).collect()
    want = {x: (0 if shape != "rings" else x // 10 * 10) for e in edges for x in e}
    assert {r.node: r.component for r in out} == want and len(out) == len(want)


def test_signature_estimates_resemblance():
    rng = random.Random(3)
    vocab = [f"w{i}" for i in range(2000)]
    base = rng.choices(vocab, k=800)
    other = base[:600] + rng.choices(vocab, k=200)
    texts = [" ".join(base).encode(), " ".join(other).encode()]
    keys, first = minhash.shingle_sets(texts)
    sig = minhash.signatures(keys, first, 1024)
    a, b = (shingles(t.decode()) for t in texts)
    assert list(np.diff(first)) == [len(a), len(b)]
    assert abs((sig[0] == sig[1]).mean() - len(a & b) / len(a | b)) < 0.06


@pytest.mark.parametrize("bounded", [False, True])
def test_other_thresholds(spark, make_docs, monkeypatch, bounded):
    if bounded:
        monkeypatch.setattr(minhash, "GROUP_MEMBERS", 5)
        monkeypatch.setattr(minhash, "BLOCK", 4)
    # Resemblance of 60 words against the same with their last k changed: (56 - k) / (56 + k).
    rows = []
    for g in range(12):
        words = [f"g{g}w{i}" for i in range(60)]
        k = 4 + g % 4  # 0.867, 0.836, 0.806, 0.778
        rows += [(2 * g, " ".join(words)), (2 * g + 1, " ".join(words[:60 - k] + [f"g{g}n{i}" for i in range(k)]))]
    rows += [(1000 + r[0], r[1] + " end of text") for r in rows]
    for percent in (85, 80):
        expect = set()
        for i, (a, t) in enumerate(rows):
            for b, u in rows[:i]:
                s, o = shingles(t), shingles(u)
                if 100 * len(s & o) >= percent * len(s | o):
                    expect.add((a, b))
        root = {}
        for _ in rows:
            for a, b in expect:
                root[a] = root[b] = min(root.get(a, a), root.get(b, b))
        out = {r.doc_id: r.component_id for r in minhash.near_duplicates(make_docs(rows), percent).collect()}
        assert out == {a: root.get(a, a) for a, _ in rows}


def test_bands_miss_nothing_at_the_threshold():
    assert [minhash.band_rows(p) for p in (85, 80)] == [6, 5]
    for p in range(50, 100):
        r = minhash.band_rows(p)
        assert (1 - (p / 100) ** r) ** (minhash.COORDINATES // r) < 1e-8
