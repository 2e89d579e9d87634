import random
import zlib

import numpy as np
import pytest

from convsift.llm import language_id as li

PARTS = {"aa": "the of and to ing er th on re tion an or".split(), "bb": "der die ung sch ein ich ver zu keit ß ü".split(),
         "cc": "el los ción ñ as que mente os ra do ga".split()}


def text(rng, lang, n):
    return " ".join("".join(rng.choices(PARTS[lang], k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    out = []
    for i in range(450):
        lang = sorted(PARTS)[i % 3]
        out.append((i, text(rng, lang, rng.choice([3, 10, 60, 300])), lang))
    return out


def test_held_out_accuracy(spark, make_docs, rows, tmp_path, clashing):
    extra = [(1000, None, "aa"), (1001, "", None), (1002, "12 34 !!", "bb"), (1003, "und " * 30_000, None), (None, "the of and", "bb")]
    clashing(make_docs(rows + extra)).write.parquet(str(tmp_path / "documents.parquet"))
    out = li.query(spark, str(tmp_path)).collect()
    assert len(out) == len(rows) + len(extra)
    by = {r.doc_id: r for r in out}
    truth = {d: lang for d, _, lang in rows}
    for d in truth:
        assert by[d].held_out == (zlib.crc32(str(d).encode()) % 5 == 0) and 0 <= by[d].score <= 1
    tested = [d for d in truth if by[d].held_out]
    assert np.mean([by[d].lang_pred == truth[d] for d in tested]) > 0.97
    assert np.mean([by[d].rejected for d in tested]) < 0.02
    for d in (1000, 1001, 1002):
        assert (by[d].lang_pred, by[d].score, by[d].rejected) == ("und", 0.0, True)
    assert by[1003].lang_pred in PARTS


def test_foreign_script_is_rejected(spark, make_docs, rows):
    model = li.fit(make_docs(rows))
    lang, score, rejected, _ = model.predict(["これは日本語の文章です。" * 20, "Ελληνικά γράμματα εδώ " * 20, rows[5][1]])
    assert list(rejected) == [True, True, False] and lang[2] == rows[5][2]


def test_prediction_ignores_labels_and_is_stable(spark, make_docs, rows):
    model, again = li.fit(make_docs(rows)), li.fit(make_docs(rows[::-1]))
    a = [r.lang_pred for r in li.identify(make_docs([(d, t) for d, t, _ in rows]), model).orderBy("doc_id").collect()]
    b = [r.lang_pred for r in li.identify(make_docs([(d, t, "zz", "s") for d, t, _ in rows]), again).orderBy("doc_id").collect()]
    assert a == b


def test_nothing_to_learn(spark, make_docs):
    for rows in ([], [(1, "abc def", None)], [(None, "abc", "aa")]):
        out = li.identify(make_docs(rows), li.fit(make_docs(rows))).collect()
        assert len(out) == len(rows) and all((r.lang_pred, r.rejected) == ("und", True) for r in out)


def test_one_language_and_repeated_rows(spark, make_docs):
    rows = [(1, "aba cada", "aa")] * 40
    out = li.identify(make_docs(rows), li.fit(make_docs(rows))).collect()
    assert len(out) == 40 and {r.lang_pred for r in out} == {"aa"}
