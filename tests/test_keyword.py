import pytest
from pyspark.sql import functions as F

from convsift.functions.dates import filter_by_date, parse_date_filter
from convsift.functions.patterns import build_matcher, translate_js_regex
from convsift.operators import keyword as kwd
from convsift.operators.keyword import search_keyword
from history_data import HOUSE, ORCHARD, history


@pytest.fixture(scope="module")
def hist(spark):
    return history(spark)


def find(spark, hist, query, regex=False, case_sensitive=False, **opts):
    m = build_matcher(query, regex=regex, case_sensitive=case_sensitive, spark=spark)
    return [r.asDict() for r in search_keyword(hist, m, **opts).collect()]


def kinds(found):
    return sorted((r["match_type"], r["excerpt"], r["context"]) for r in found)


def test_titles(spark, hist):
    assert [r["session_title"] for r in find(spark, hist, "irrigation") if r["match_type"] == "title"] == ["Irrigation for the trees"]
    assert find(spark, hist, "irrigation", project_id=HOUSE) == []


def test_case(spark, hist):
    assert find(spark, hist, "VALVE") and len(find(spark, hist, "VALVE")) == len(find(spark, hist, "valve"))
    assert find(spark, hist, "VALVE", case_sensitive=True) == []


def test_message_excerpt_and_context(spark, hist):
    (r,) = [x for x in find(spark, hist, "thermoCOUPLE") if x["match_type"] == "message"]
    assert r["excerpt"] == "thermocouple" and r["project_directory"] == "/srv/orchard"
    assert r["context"].startswith("Reuse the greenhouse code") and r["context"].endswith("come hourly.")


def test_tools_and_patches(spark, hist):
    found = kinds(find(spark, hist, "quiet", project_id=HOUSE))
    assert found == [("filepath", "lib/quiet.py", "Modified file: lib/quiet.py")]
    found = kinds(find(spark, hist, "toml"))
    assert ("filepath", "toml", "Pump settings") in found and ("filepath", "conf/pump.toml", "Modified file: conf/pump.toml") in found
    assert ("tool", "grep", "Look for callers") in kinds(find(spark, hist, "grep"))


def test_first_matches_of_the_walk(spark, hist):
    # The walk starts at the session updated last.
    assert {r["session_id"] for r in find(spark, hist, "valve", limit=2)} == {"s-trees"}
    times = [r["timestamp"] for r in find(spark, hist, "e")]
    assert times == sorted(times, reverse=True)


def test_role(spark, hist):
    found = find(spark, hist, "valve", role="user")
    assert {r["match_type"] for r in found} == {"title", "message"}
    assert {r["message_id"] for r in found} == {None, "s-audit-m0"}


def test_limits(spark, hist):
    assert len(find(spark, hist, "e", limit=0)) == len(find(spark, hist, "e")) == min(50, len(find(spark, hist, "e", limit=500)))
    with pytest.raises(ValueError):
        find(spark, hist, "e", limit=-2)


def test_date_after_or_before_the_limit(spark, hist):
    m, day = build_matcher("the", spark=spark), parse_date_filter("2025-05-05")
    assert filter_by_date(search_keyword(hist, m, limit=1), day).count() == 0
    assert search_keyword(hist, m, limit=1, corpus_range=day).count() == 1


def test_long_texts_do_not_travel(spark, hist, monkeypatch):
    for query, regex in (("the", False), ("soil.*dry", True), ("lib", False), ("^Re[a-z]+", True)):
        whole = find(spark, hist, query, regex=regex)
        monkeypatch.setattr(kwd, "CARRIED_CHARS", 5)
        assert find(spark, hist, query, regex=regex) == whole and whole
        monkeypatch.undo()


def test_invalid_regex_raises_before_any_job(spark):
    with pytest.raises(ValueError):
        build_matcher("a(b", regex=True, spark=spark)


@pytest.mark.parametrize("pattern,hits,misses", [
    ("abc$", ["abc"], ["abc\n"]), ("interface {", ["interface { x"], ["interface"]), (r"foo\(\) {", ["foo() {"], ["foo()"]),
    ("x{2}y", ["xxy"], ["xy", "x{2}y"]), ("x{,2}", ["x{,2}"], ["xx"]), ("[[]", ["a[b"], ["ab"]), ("a[^]b", ["a\nb", "axb"], ["ab"]),
    ("[a&&b]c", ["&c", "ac", "bc"], ["xc"]), (r"a\sb", ["a b", "a b", "a﻿b", "a b"], ["ab"]),
    (r"a\Sb", ["axb"], ["a b"]), (r"[\s,]b", [" b", ",b"], ["xb"]), (r"\Qx", ["Qx"], ["x"]), (r"a\zb", ["azb"], ["a"]),
    (r"\h", ["h"], [" "]), (r"a\vb", ["a\x0bb"], ["a\nb"]), ("a.b", ["a\u0085b"], ["a\nb", "a b"]), ("[]", [], ["", "a"]),
    (r"A\x42", ["AB"], ["u0041"]), (r"[\]]", ["]"], ["a"]), ("[a-c^]d", ["^d", "bd"], ["d"]), (r"\d+\.\w", ["12.a"], ["12a"])])
def test_javascript_dialect(spark, pattern, hits, misses):
    m = build_matcher(pattern, regex=True, spark=spark)
    df = spark.createDataFrame([(t,) for t in hits + misses], "t string")
    assert {r.t for r in df.where(m.test(F.col("t"))).collect()} == set(hits), translate_js_regex(pattern)
