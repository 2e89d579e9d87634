import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from convsift.llm import lexical

TERM = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
ITEMS = "item_id bigint, text string"


def cut(text):
    return TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k=10):
    bags = [(d, Counter(cut(t))) for d, t in docs]
    n_docs = sum(1 for _, b in bags if b)
    total = sum(sum(b.values()) for _, b in bags)
    df = Counter(t for _, b in bags for t in b)
    out = []
    for item, text in set(items):
        found = []
        for d, bag in bags:
            score = 0
            for t in cut(text):
                if bag[t]:
                    w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                    m = 100 - 75 + (75 * sum(bag.values()) * n_docs) // total
                    score += w * ((1000000000 * bag[t]) // (1000 * bag[t] + 8 * m))
            if score > 0:
                found.append((-score, d is None, d))
        found.sort(key=lambda f: (f[0], f[1], f[2] or 0))
        out += [(item, r, f[2], -f[0]) for r, f in enumerate(found[:k], 1)]
    return Counter(out)


def run(spark, docs, items):
    got = lexical.rank_documents(docs, spark.createDataFrame(items, ITEMS))
    return Counter((r.item_id, r["rank"], r.doc_id, r.score) for r in got.collect())


def corpus(seed, n=400):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdeÉéß字0_-", k=rng.randint(1, 3))) for _ in range(120)]
    docs = [(i, " ".join(rng.choices(vocab, weights=range(120, 0, -1), k=int(rng.expovariate(1 / 40)))).replace("a", "A"))
            for i in range(n)]
    docs += [(n, None), (n + 1, ""), (n + 2, "...\x00 \t"), (None, docs[3][1]), (None, docs[5][1]), (7, docs[7][1]), (7, "other é")]
    docs += [(n + 10 + i, docs[11][1]) for i in range(40)]
    items = [(i, " ".join(rng.choices(vocab, k=rng.randint(1, 30)))) for i in range(25)]
    items += [(100, None), (101, ""), (102, "unheardof"), (103, docs[11][1]), (5, docs[9][1]), items[2], items[2], (None, docs[20][1])]
    return docs, items


def test_against_brute_force(spark, make_docs, clashing):
    docs, items = corpus(1)
    assert run(spark, clashing(make_docs(docs)), items) == brute(docs, items)


def test_small_tiles_and_batches_change_nothing(spark, make_docs, monkeypatch):
    docs, items = corpus(2)
    want = brute(docs, items)
    for name, value in (("TILE_ITEMS", 4), ("TILE_TERMS", 8), ("TILE_DOCS", 16), ("BATCH_ITEMS", 9), ("SALTS", 3)):
        monkeypatch.setattr(lexical, name, value)
    assert run(spark, make_docs(docs).repartition(3), items) == want


def test_queries_of_any_weight_stay_exact():
    rng = np.random.default_rng(3)
    items = [{t: int(w) for t, w in enumerate(rng.integers(1, 1 << 40, 60))}, {0: 1 << 41}, {}, {59: 5}]
    tiles = lexical.Tiles(items, np.arange(60))
    impact = rng.integers(1, lexical.MAX_IMPACT + 1, 300)
    term, doc = rng.permutation(60 * 10)[:300] % 60, None
    pairs = sorted(set(zip(term.tolist(), (np.arange(300) % 10).tolist())))
    term, doc = np.array(pairs).T
    impact = impact[:len(pairs)]
    want = np.zeros((4, 10), dtype=object)
    for t, d, v in zip(term.tolist(), doc.tolist(), impact.tolist()):
        for i, item in enumerate(items):
            want[i, d] += item.get(t, 0) * v
    assert max(len(tiles.weights(0, 0)), 1) > 1
    assert (tiles.scores(0, doc, term, impact, 10).astype(object) == want).all()


def test_ties_keep_the_smallest_ids():
    best = lexical.Best(1, 3)
    best.add(0, np.array([[5, 5, 5, 5, 0]]), np.array([9, 8, 7, 6, 1]), np.zeros(5, np.int64))
    best.add(0, np.array([[5, 7, 5]]), np.array([2, 50, 3]), np.array([0, 0, 1]))
    assert best.rows.tolist() == [[0, -7, 0, 50], [0, -5, 0, 2], [0, -5, 0, 6]]


@pytest.mark.parametrize("docs, items", [([], [(1, "a")]), ([(1, "a")], []), ([(1, None)], [(1, "a")]), ([(1, "b")], [(1, "a")])])
def test_empty(spark, make_docs, docs, items):
    frame = lexical.rank_documents(make_docs(docs), spark.createDataFrame(items, ITEMS))
    assert frame.collect() == [] and frame.columns[-3:] == ["rank", "doc_id", "score"] or frame.collect() == []


def test_very_long_text(spark, make_docs):
    docs = [(1, "word " * 300_000 + "rare"), (2, "rare word"), (3, "x" * 500_000)]
    items = [(1, "rare"), (2, "word word"), (3, "x" * 500_000)]
    assert run(spark, make_docs(docs), items) == brute(docs, items)
