import random
import re

import pytest

from convsift.functions.grams import gram_codes, required_grams
from convsift.functions.patterns import build_matcher
from convsift.operators.keyword import search_keyword
from convsift.operators.report import TRACE_HEADER, batch_entries, format_traces, write_batch_report
from convsift.operators.trace import ALL, trace_file, trace_files
from convsift.plans.search import search_store
from convsift.sources import store as st
import history_data as data


def code(gram):
    return sum(ord(c) << (14 - 7 * i) for i, c in enumerate(gram.lower()))


def grams(*words):
    return sorted({code(w[i:i + 3]) for w in words for i in range(len(w) - 2)})


@pytest.mark.parametrize("pattern, runs", [
    ("valve", ["valve"]), ("wh[a-z]+never", ["never"]), ("foo.*barn", ["foo", "barn"]), ("abcd?ef", ["abc"]), ("abc+def", ["abc", "def"]),
    ("abc*", []), ("abc|xyz", []), ("(abc|xyz)tail", ["tail"]), ("(head)?tail", ["tail"]), ("head(?=tail)", ["head"]),
    (r"a\.b/cde", ["a.b/cde"]), (r"\d+abcde\w", ["abcde"]), (r"\x41bcde", []), (r"abc{2}defg", ["defg"]), ("[]abcd", ["abcd"]),
    ("[^]abcd", ["abcd"]), ("[|]abcd", ["abcd"]), ("^abc$", ["abc"]), ("ab", []), ("", []), ("abc{x}", ["abc{x}"]), (r"[\]|]abc", ["abc"]),
    (r"\(abc\)", ["(abc)"]), ("abc**", []), ("a(b|c)*defg", ["defg"])])
def test_trigrams_of_patterns(pattern, runs):
    assert required_grams(pattern, True) == grams(*runs)


def test_a_pattern_without_certain_trigrams_is_never_narrowed():
    assert required_grams("t.on", True) == [] and required_grams("é", False) == []


def test_every_matching_text_holds_the_trigrams():
    rng = random.Random(2)
    words = ["valve", "Dry", "soil", "x.y", "a1b2", "Fluß", "ſoil", "İnk"]
    for _ in range(300):
        pattern = "".join(rng.choice([re.escape(rng.choice(words)), ".*", "[a-z]+", "(dry|soil)?", "so{1,2}il", "a?", r"\s*"]) for _ in range(rng.randint(1, 4)))
        text = " ".join(rng.choice(words) for _ in range(8))
        if re.search(pattern, text):
            have = set(gram_codes([text.encode()]).tolist())
            assert set(required_grams(pattern, True)) <= have, (pattern, text)


def test_many_trigrams_are_thinned():
    assert 0 < len(required_grams("a long literal with a good many trigrams in it")) <= 10


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    root, path = str(tmp_path_factory.mktemp("tree")), str(tmp_path_factory.mktemp("store"))
    sessions, messages, parts = [list(t) for t in data.raw()]
    for i in range(60):  # sessions that a rare word is not in
        sid = f"s-more{i}"
        sessions.append((sid, data.HOUSE, sid, "/srv", f"Session {i}", "2", i, i))
        messages.append((f"{sid}-m", sid, i, i, data.compact({"role": "user"})))
        parts.append((f"{sid}-p", f"{sid}-m", sid, i, i, data.say(f"ordinary words number {i}" + (" ſoılbank KİTE" if i == 7 else ""))))
    data.write_tree(root, sessions, messages, parts)
    st.ingest_tree(spark, root, path)
    return path


@pytest.mark.parametrize("query, regex", [("valve", False), ("VALVE", False), ("soil", False), ("ordinary", False), ("therm[a-z]+ple", True),
                                          ("lib/(valve|quiet)", True), ("e", False), ("kite", False), ("soilbank", False), ("nowhere to be found", False),
                                          ("wa.er", True), ('{"pattern"', False), ("hunk", False), ("Quiet hours", False)])
def test_same_rows_with_and_without_the_postings(spark, stored, query, regex):
    whole = search_keyword(st.load_store(spark, stored), build_matcher(query, regex=regex), limit=500)
    assert search_store(spark, stored, query=query, regex=regex, limit=500).collect() == whole.collect()


def test_a_rare_word_reads_few_slots(spark, stored):
    version = st.latest_version(spark, stored)
    slots = st.matching_slots(spark, stored, version, "thermocouple")
    assert 1 <= len(slots) <= 0.1 * len(version.slots["parts"])
    h = st.load_matching(spark, stored, "thermocouple")
    assert {f.split("slot=")[1].split("/")[0] for f in h.parts.inputFiles()} == {str(s) for s in slots}
    assert st.matching_slots(spark, stored, version, "t.e", True) is None


def test_batch_reports_are_the_single_ones_together(spark, tmp_path):
    h = data.history(spark)
    paths = ["lib/valve.py", "valve.py", "lib/quiet.py", "lib/none.py"]
    traces = trace_files(h, spark.createDataFrame([(p,) for p in paths], "query string"))
    path = str(tmp_path / "reports")
    write_batch_report(traces, path)
    text = spark.read.option("wholetext", True).text(path).selectExpr("query", "value", "_metadata.file_name AS name")
    for p in paths[:3]:
        got = "\n".join(r.value for r in text.where(f"query = '{p}'").orderBy("name").collect())
        assert got.rstrip("\n") == format_traces(trace_file(h, p, limit=ALL)).rstrip("\n")
    assert text.where("query = 'lib/none.py'").count() == 0
    heads = {(r["query"], r.header) for r in batch_entries(traces).collect()}
    assert heads == {(p, TRACE_HEADER.format(n=traces.where(f"query = '{p}'").count())) for p in paths[:3]}


def test_marked_grams_stay_inside_their_texts():
    import numpy as np
    import pyarrow as pa
    from convsift.functions.grams import mark_grams
    texts = ["ABcd", "", None, "e", "fg", "h\u00e9llo w", "xyz", "\n12"]
    want = {g for t in texts if t for g in ("".join(c) for c in zip(t.lower(), t.lower()[1:], t.lower()[2:])) if all(" " <= c <= "~" for c in g)}
    codes = {(ord(g[0]) << 14) | (ord(g[1]) << 7) | ord(g[2]) for g in want}
    for a, expected in ((pa.array(texts), codes), (pa.array(["q", "rst", *texts]).slice(2), codes), (pa.array([], pa.string()), set())):
        seen = np.zeros(1 << 21, bool)
        mark_grams(a, seen)
        assert set(np.flatnonzero(seen).tolist()) == expected
