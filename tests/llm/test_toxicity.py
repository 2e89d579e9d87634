import random
import zlib

import numpy as np
import pytest

from convsift.llm import toxicity as tx

BAD = ["idiot", "stupid", "moron", "scumbag"]


def corpus(seed=1, n=700):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghiklmnoprstu", k=rng.randint(2, 9))) for _ in range(500)]
    rows = []
    for i in range(n):
        toxic = int(rng.random() < 0.25)
        lines = [" ".join(rng.choices(vocab, k=rng.randint(4, 15))) + "." for _ in range(rng.randint(1, 8))]
        if toxic:
            words = lines[0].split()
            words.insert(rng.randint(0, len(words) - 1), rng.choice(BAD))
            lines[rng.randrange(len(lines))] = " ".join(words)
        rows.append((i, "\n".join(lines), toxic))
    return rows


def fit(spark, rows):
    df = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    return tx.fit(df.select("doc_id", "text"), df.select("doc_id", "toxic"))


@pytest.fixture(scope="module")
def model(spark):
    return fit(spark, corpus())


def test_held_out(model):
    rows = corpus(7, 300)
    s = model.scores([t.encode() for _, t, _ in rows])
    y = np.array([v for _, _, v in rows])
    assert ((s >= tx.THRESHOLD) == y).mean() > 0.95


def test_gaps_and_inserted_characters(model):
    texts = ["ha tu i.d.i.o.t ke", "ha tu id-i-ot ke", "ha tu st*u*pid ke", "ha tu i d i o t ke", "ha tu IDIOT! ke", "ha tu moxron ke"]
    assert (model.scores([t.encode() for t in texts]) >= tx.THRESHOLD).all()
    assert (model.scores([b"ha tu ke", b"", b" \n ", b"a b c d e f g"]) < tx.THRESHOLD).all()


def test_several_inserted_characters(model):
    words = ["i--d--i--o--t", "m__o__r__o__n", "s..t..u..p..i..d", "s*-*t*-*u*-*p*-*i*-*d", "sxtxuxpid", "sxxtxxuxxpxxixxd", "iiidddiiiooottt", "mmoorroonn"]
    s = model.scores([f"ha tu {w} ke".encode() for w in words])
    assert (s >= tx.THRESHOLD).all(), dict(zip(words, s))
    plain = ["ha--tu", "ke.lu.ba", "banana", "mississippi", "hallooo", "1-2-3", "a.b", "----"]
    assert (model.scores([f"ha tu {w} ke".encode() for w in plain]) < tx.THRESHOLD).all()


def test_long_word_and_long_text(model):
    s = model.scores([("x" * 200_000).encode(), ("ku la " * 50_000 + "idiot " + "ku la " * 50_000).encode(), ("z" * 90 + "idiot" + "z" * 90).encode()])
    assert s[0] < tx.THRESHOLD <= s[1] and np.isfinite(s).all()


def test_kernel_matches_definition():
    words = ["idiot", "i.d.i.o.t", "stu", "aab", "é1èxê", "", "ab"]
    marks = ["idiot", "studio", "éèêx"]

    def features(w):
        out = {}
        for i in range(len(w)):
            for j in range(i + 1, min(i + tx.SPAN, len(w))):
                for k in range(j + 1, min(i + tx.SPAN, len(w))):
                    if all(c.isalpha() for c in (w[i], w[j], w[k])):
                        key = w[i] + w[j] + w[k]
                        out[key] = out.get(key, 0) + tx.DECAY ** (k - i + 1)
        return out

    def dot(a, b):
        return sum(v * b.get(k, 0) for k, v in a.items())

    got = tx.Kernel(marks).likeness(words)
    for i, w in enumerate(words):
        for j, m in enumerate(marks):
            a, b = features(w), features(m)
            n = (dot(a, a) * dot(b, b)) ** 0.5
            want = dot(a, b) / n if n else 0.0
            assert abs(got[i, j] - (want if want >= tx.FLOOR else 0)) < 1e-5


def test_query(spark, make_docs, tmp_path, clashing):
    rows = corpus(3, 500)
    extra = [(9000, None), (9001, ""), (None, "idiot idiot"), (9002, "x"), (9002, "x")]
    clashing(make_docs([(d, t) for d, t, _ in rows] + extra)).write.parquet(str(tmp_path / "documents.parquet"))
    labels = [(d, None, v) for d, _, v in rows] + [(None, None, 1), (9001, None, None), (5, None, 0), (5, None, 1)]
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    out = tx.query(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) + len(extra)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
        assert r.doc_id is None or r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2)
    truth = {d: v for d, _, v in rows if d != 5}
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.93


def test_nothing_to_learn(spark, make_docs):
    for rows in ([], [(1, "a b c", 1)], [(1, "a b c", 0), (2, "d", 0)]):
        m = fit(spark, rows)
        assert (m.scores([b"a b c", b""]) == 0).all()
    assert tx.toxicity(make_docs([]), tx.Model()).collect() == []
