import os
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from convsift.llm import quality_rules as q

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    w = WORD.findall(text)
    grams = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {i + j for i in range(len(w) - 7) if grams[tuple(w[i:i + 8])] > 1 for j in range(8)}
    lines = Counter(x for x in text.split("\n") if WORD.search(x))
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    chars, symbols, again = sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), sum(n - 1 for n in lines.values())
    stutters = sum(a == b for a, b in zip(w, w[1:]))
    rules = [10 * symbols > len(w), 100 * again > 40 * sum(lines.values()), not 3 * len(w) <= chars <= 12 * len(w), 100 * stutters > 20 * len(w)]
    return (len(w), chars, symbols, again, len(covered), sum(lines.values()), stutters, failed, sum(rules))


GOOD = " ".join(f"word{i}" for i in range(40))
ODD_LINES = "the same line\n" * 7 + GOOD
JUNK = " ".join(f"&w{i}" for i in range(25))
ROWS = [(12, ODD_LINES), (13, JUNK), (14, "go go go stop " * 9), (15, "abcdefghijklmnopq " * 30), (16, "a\nb " * 25), (1, None), (2, ""), (3, " \t\n"), (4, GOOD), (5, "a b c d e f g h " * 4), (6, "x\ny\nx\n\n \n \nx"), (7, "é# ü* 日本 |<>$%&"),
        (8, "a " * 100_000), (9, GOOD + "\n" + GOOD), (10, GOOD + " 1 2 3 4 5 6 7 8 z 1 2 3 4 5 6 7 8"), (11, " a b")]


def counts(r):
    return (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.n_lines, r.n_stutters, r.base_failed, r.n_failed)


def test_counts(spark, make_docs, clashing):
    out = q.quality_rules(clashing(make_docs(ROWS))).collect()
    assert {r.doc_id: counts(r) for r in out} == {d: brute(t) for d, t in ROWS}


def test_host_verdicts(spark, make_docs):
    rows = [(i, "short", None, "bad") for i in range(200)] + [(i, GOOD, None, "bad") for i in range(200, 205)]
    rows += [(1000 + i, GOOD if i % 10 else "short", None, f"h{i % 20}") for i in range(400)]
    rows += [(5000, GOOD, None, None), (5001, "short", None, None), (5002, GOOD, None, "new"), (5003, "short", None, "one")]
    out = {r.doc_id: r for r in q.quality_rules(make_docs(rows)).collect()}
    assert not any(out[i].kept for i in range(205))
    assert all(out[1000 + i].kept == bool(i % 10) for i in range(400))
    assert out[5000].kept and not out[5001].kept and out[5002].kept
    # One failure alone does not condemn a host: its rate shrinks to the corpus'.
    assert out[5003].shrunk_rate < out[0].shrunk_rate


def test_repeated_rows_null_ids_and_empty_table(spark, make_docs):
    out = q.quality_rules(make_docs([(None, GOOD, None, "a")] * 3)).collect()
    assert len(out) == 3 and all(r.kept and r.doc_id is None for r in out)
    assert q.quality_rules(make_docs([])).collect() == []


def test_hot_host(spark, make_docs):
    rows = [(i, "short" if i % 2 else GOOD, None, "hot" if i % 3 else f"h{i}") for i in range(900)]
    out = q.quality_rules(make_docs(rows)).collect()
    assert len(out) == 900 and {r.doc_id for r in out if r.base_failed} == {i for i in range(900) if i % 2}


def test_other_host_expression(spark, make_docs):
    docs = make_docs([(i, "short", "en", "a") for i in range(90)] + [(i, GOOD, "de", "a") for i in range(100, 190)])
    out = q.quality_rules(docs, host=F.col("lang"), max_rate=0.5).collect()
    assert all(r.kept == (r.doc_id >= 100) for r in out)


def test_hosts_decide_what_a_failed_rule_means(spark, make_docs):
    """One document with symbols stays where hardly any other fails, goes on an ordinary host;
    a host of junk loses its clean documents too, a mixed one keeps them."""
    rows = [(i, GOOD if i else JUNK, None, "clean") for i in range(400)]
    rows += [(1000 + i, GOOD if i % 6 else JUNK, None, "mixed") for i in range(400)]
    rows += [(2000 + i, JUNK if i % 25 else GOOD, None, "junk") for i in range(400)]
    rows += [(3000, JUNK, None, None), (3001, GOOD, None, None)]
    out = {r.doc_id: r.kept for r in q.quality_rules(make_docs(rows)).collect()}
    assert all(out[i] for i in range(400))
    assert all(out[1000 + i] == bool(i % 6) for i in range(400))
    assert not any(out[2000 + i] for i in range(400))
    assert not out[3000] and out[3001]


def test_two_failed_rules_are_not_forgiven(spark, make_docs):
    rows = [(i, GOOD if i else "go& " * 8 + JUNK, None, "clean") for i in range(300)]
    assert [r.doc_id for r in q.quality_rules(make_docs(rows)).collect() if not r.kept] == [0]


def test_the_prior_never_drowns_a_host(spark, make_docs):
    """Hosts that differ by no more than chance are not all given the mean."""
    rows = [(100 * h + i, JUNK if i < 10 + h % 3 else GOOD, None, f"h{h}") for h in range(20) for i in range(100)]
    rates = {r.host: r.shrunk_rate for r in q.quality_rules(make_docs(rows)).collect()}
    assert rates["h2"] - rates["h0"] > 0.005


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.01"), reason="no tables")
def test_verdict_changes_rows_of_the_given_table(spark):
    out = q.query(spark, "/root/testdata/sf0.01")
    n = out.where("NOT base_failed AND NOT kept").count()
    assert 20 < n < 200
