import hashlib
import random

from pyspark.sql import functions as F

from convsift.llm import fingerprints as fp


def run(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return fp.query(spark, str(tmp_path)).collect()


def shingles(text):
    w = [x for x in text.lower().replace("\t", " ").replace("\n", " ").split(" ") if x]
    return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def jaccard(a, b):
    a, b = shingles(a), shingles(b)
    return len(a & b) / len(a | b) if a | b else 1.0


def test_against_brute_force(spark, make_docs, clashing, tmp_path):
    rng = random.Random(5)
    vocab = [f"wö{i}" for i in range(40)]
    rows = [(3 * i - 20, " ".join(rng.choices(vocab, k=rng.choice([0, 1, 3, 5, 20, 90])))) for i in range(60)]
    rows += [(500, None), (501, "é" * 7), (502, "a b\tc\nd e f"), (503, "A B C D E F"), (504, "word " * 20_000)]
    out = {r.doc_id: r for r in run(spark, tmp_path, clashing(make_docs(rows)))}
    texts = [(d, t or "") for d, t in sorted(rows)]
    for (d, t), (_, nxt) in zip(texts, texts[1:] + texts[:1]):
        m = len(t) // 4
        edited = t[:len(t) - m] + nxt[:m]
        r = out[d]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        # Sets of at most K shingles are compared exactly.
        assert abs(r.near_edited - jaccard(t, edited)) < 1e-9 and abs(r.near_next - jaccard(t, nxt)) < 1e-9
    assert out[502].fingerprint == out[503].fingerprint != out[504].fingerprint and out[500].fingerprint == ""


def test_large_sets_are_estimated(spark):
    words = [f"w{i}" for i in range(6000)]
    rows = [(" ".join(words), " ".join(words[:4000] + [f"v{i}" for i in range(2000)]))]
    df = spark.createDataFrame(rows, "a string, b string")
    df = fp.with_sketch(fp.with_sketch(df, "a", "x", 512), "b", "y", 512)
    r = df.select(fp.resemblance(F.col("x"), F.col("y"), 512).alias("j"), fp.containment(F.col("x"), F.col("y"), 512).alias("c"),
                  fp.distinct_shingles(F.col("x"), 512).alias("n")).first()
    assert abs(r.j - jaccard(*rows[0])) < 0.07 and abs(r.c - 0.666) < 0.1 and abs(r.n - 5996) < 900


def test_sketches_merge(spark):
    words = [f"w{i}" for i in range(3000)]
    parts = [("k", " ".join(words[i:i + 504])) for i in range(0, 2500, 500)]
    whole = spark.createDataFrame([("k", " ".join(words[:2504]))], "k string, t string")
    want = fp.with_sketch(whole, "t", "s").first().s
    got = fp.merge_sketches(fp.with_sketch(spark.createDataFrame(parts, "k string, t string"), "t", "s"), ["k"], "s").collect()
    assert len(got) == 1 and got[0].s == want
    two = fp.with_sketch(spark.createDataFrame(parts[:2], "k string, t string"), "t", "s")
    back = two.select(fp.from_text(fp.to_text(F.col("s"))).alias("b"), "s").collect()
    assert all(r.b == r.s for r in back)


def test_null_and_repeated_ids(spark, make_docs, tmp_path):
    rows = [(None, "q r s t u v w x"), (1, "a b c d e f g h"), (1, "b b c d e f g h"), (4, "x y z x y z u v")]
    out = run(spark, tmp_path, make_docs(rows))
    want = {"q r s t u v w x": "a b c d e f g h", "a b c d e f g h": "x y z x y z u v", "b b c d e f g h": "x y z x y z u v",
            "x y z x y z u v": "a b c d e f g h"}
    edited = sorted(hashlib.sha256((t[:12] + n[:3]).encode()).hexdigest() for t, n in want.items())
    assert sorted(r.edited_sha256 for r in out) == edited


def test_one_document_and_none(spark, make_docs, tmp_path):
    out = run(spark, tmp_path, make_docs([(3, "abcdefgh")]))
    assert out[0].edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and out[0].near_next == 1.0
    assert run(spark, tmp_path / "none", make_docs([])) == []
