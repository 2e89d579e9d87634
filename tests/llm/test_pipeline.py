import random
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from convsift.llm import packing

pytest.importorskip("public_tokenizers")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
PARTS = {"aa": "the of and to ing er th on re tion an or".split(), "bb": "der die ung sch ein ich ver zu keit ß ü".split()}


@pytest.fixture(scope="module")
def corpus(make_docs):
    rng = random.Random(1)

    def line(lang, n):
        return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(2, 4))) for _ in range(n))

    passage = "\n".join(line("aa", 14) for _ in range(6))
    rows = []
    for i in range(240):
        lang = "ab"[i % 2] * 2
        rows.append([i, "\n".join(line(lang, 16) for _ in range(rng.randint(2, 9))), lang, f"s{i % 4}"])
    for i in range(0, 40, 2):
        rows[i][1] += "\n" + passage
    whole = " ".join(line("aa", 120).split())
    words = whole.split()
    rows += [[300 + i, " ".join(words[:50 + i] + ["new"] + words[51 + i:]), "aa", "s0"] for i in range(3)]
    rows += [[400, rows[7][1], "bb", "s1"], [401, None, "aa", "s1"], [402, "", None, None], [403, "1234 !!", "aa", "s2"], [404, line("aa", 30), "aa", None]]
    return [tuple(r) for r in rows]


def test_stages_keep_the_columns(spark, make_docs, clashing, corpus, tmp_path):
    assert [n for n, _ in cp.STAGES] == ["language_id", "line_dedup", "near_dedup", "mixing", "packing"]
    docs = clashing(make_docs(corpus))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    kept = []
    for name, stage in cp.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == COLUMNS, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        kept.append([tuple(r) for r in docs.collect()])
    lang, lines, near, mixed = kept
    ids = {r[0] for r in corpus}
    # Language: only what has no letters goes.
    assert {r[0] for r in lang} == ids - {401, 402, 403}
    # Lines: the copy is empty and goes; the passage stays in its first document.
    assert {r[0] for r in lines} == {r[0] for r in lang} - {400}
    text = {r[0]: r[1] for r in corpus}
    passage = text[0].split("\n")[-6:]
    assert next(r for r in lines if r[0] == 0)[1] == text[0]
    left = sum(x in r[1] for r in lines if r[0] in range(2, 40, 2) for x in passage)
    assert left < 0.3 * 6 * 19
    assert all(r[4] == len(r[1]) for r in lines)
    # Near-duplicates: one of the three edits stays.
    assert {r[0] for r in lines} - {r[0] for r in near} == {301, 302}
    # The mix repeats and leaves out whole documents.
    count = defaultdict(int)
    for r in mixed:
        count[r[0]] += 1
    assert set(count) <= {r[0] for r in near} and max(count.values()) <= 3


def test_run_is_the_stages_in_turn(spark, make_docs, corpus, tmp_path):
    make_docs(corpus).write.parquet(str(tmp_path / "documents.parquet"))
    rows = cp.run(spark, str(tmp_path)).collect()
    docs = make_docs(corpus)
    for _, stage in cp.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
    import public_tokenizers
    encode = packing.Encoder(str(public_tokenizers.path(packing.TOKENIZER))).ids
    want = sorted((r.doc_id, k, len(p), zlib.crc32(p.tobytes())) for r in docs.collect()
                  for ids in encode([r.text.encode()]) for k, p in enumerate([ids[lo:lo + 4096] for lo in range(0, len(ids), 4096)]))
    assert sorted((r.doc_id, r.piece, r.length, r.ids_crc32) for r in rows) == want


def test_empty_table(spark, make_docs, tmp_path):
    make_docs([]).write.parquet(str(tmp_path / "documents.parquet"))
    assert cp.run(spark, str(tmp_path)).collect() == []


def test_near_duplicates_from_four_fifths(spark, make_docs, tmp_path):
    words = [f"w{i}" for i in range(60)]
    close, far = (words[:60 - k] + [f"n{k}{i}" for i in range(k)] for k in (6, 7))  # 50/62 = 0.806, 49/63 = 0.778
    for other, kept in ((close, [1]), (far, [1, 2])):
        docs = make_docs([(1, " ".join(words)), (2, " ".join(other))])
        docs.write.mode("overwrite").parquet(str(tmp_path / "documents.parquet"))
        assert sorted(r.doc_id for r in cp.drop_near_duplicates(spark, docs, str(tmp_path)).collect()) == kept


def test_rows_without_an_id_and_repeated_rows(spark, make_docs, tmp_path):
    text = {k: " ".join(f"{k}{i}" for i in range(60)) for k in "abcdef"}
    rows = [(1, text["a"]), (None, text["a"]), (None, text["a"] + " end"),  # copies of a document with an id
            *[(None, text["b"])] * 4, (None, text["b"] + " end"),  # none has an id
            (None, text["c"]),
            *[(7, text["d"])] * 3,  # one row, thrice
            (8, text["e"]), (8, text["f"]), (9, text["f"])]  # two texts under one id
    make_docs(rows).write.parquet(str(tmp_path / "documents.parquet"))
    out = cp.drop_near_duplicates(spark, make_docs(rows), str(tmp_path)).collect()
    got = sorted((str(r.doc_id), r.text.split()[0][0], r.n_chars == len(r.text)) for r in out)
    assert got == [("1", "a", True), ("7", "d", True), ("8", "e", True), ("8", "f", True), ("None", "b", True), ("None", "c", True)]
