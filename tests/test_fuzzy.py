import random
import time

import pytest

from convsift.functions.editdist import allowed_errors, best_alignment
from convsift.operators import fuzzy as fz
from convsift.operators.items import build_items
from history_data import HOUSE, compact, history, raw

ITEM = ("session_id string, k_phase int, message_id string, part_id string, k_slot int, k_ord int, k_updated_ms long, "
        "k_msg_ms long, k_part_ms long, timestamp long, match_type string, content string, role string, "
        "session_title string, project_directory string")


@pytest.fixture(scope="module")
def hist(spark):
    return history(spark)


def run(hist, query, **kw):
    return [r.asDict() for r in fz.search_fuzzy(hist, query, **kw).collect()]


def item(text, part="p"):
    return ("s", 1, "m", part, 0, 0, 1, 1, 1, 1, "message", text, "user", "t", "/d")


def one(spark, text):
    return spark.createDataFrame([item(text)], ITEM)


def test_typos(hist):
    assert any(r["session_id"] == "s-trees" for r in run(hist, "irigation", threshold=0.3))
    assert any("thermocouple" in r["context"] for r in run(hist, "termocuple", threshold=0.3))
    assert run(hist, "irigation", threshold=0.3, project_id=HOUSE, limit=5) == []


def test_limits_and_thresholds(hist):
    assert len(run(hist, "valve", limit=2)) == 2 and run(hist, "valve", limit=0) == []
    for q in ("zzyzx", "valve", "rebot"):
        assert len(run(hist, q, threshold=0.1)) <= len(run(hist, q, threshold=0.7))
    times = [r["timestamp"] for r in run(hist, "valve")]
    assert len(times) > 3 and times == sorted(times, reverse=True)


def test_excerpt_and_context(hist):
    (r,) = [x for x in run(hist, "thermocouple", threshold=0.0)]
    text = "Reuse the greenhouse code for the young trees; thermocouple readings come hourly."
    i = text.index("thermocouple")
    assert (r["excerpt"], r["context"]) == (text[i - 20:i + 80], text[max(0, i - 100):i + 200])


def test_roles(spark):
    s, m, p = raw()
    m = [(*r[:4], compact({"agent": "x"})) if r[0] == "s-drip-m0" else r for r in m]
    hist = history(spark, (s, m, p))
    assert not any(r["message_id"] == "s-drip-m0" for r in run(hist, "keeps dripping", role="user", threshold=0.1))
    assert any(r["message_id"] == "s-drip-m0" for r in run(hist, "keeps dripping", threshold=0.1))
    found = run(hist, "valve", threshold=0.1, role="user")
    assert {r["match_type"] for r in found} == {"title", "message"}


def test_items_of_all_kinds(hist):
    kinds = {r.match_type for r in build_items(hist).select("match_type").distinct().collect()}
    assert kinds == {"title", "message", "tool", "filepath"}


@pytest.mark.parametrize("fill", ["abcdefgh ", "İx ", "ßÜΣ "])
def test_windows_equal_one_pass(spark, fill):
    rng = random.Random(7)
    body = "".join(rng.choice(fill) for _ in range(5000))
    for at in (0, 1020, 1024, 3000, 4990):
        text = body[:at] + "convsxift" + body[at:]
        (r,) = fz.fuzzy_scores(one(spark, text), "convsift", 0.25).collect()
        assert (r.dist, r.start) == (1, at)


def test_lower_casing_that_lengthens(spark, hist):
    text = "İ" * 1500 + " zebracrossing end"
    df = one(spark, text)
    (r,) = fz.search_fuzzy(hist, "zebracrossing", threshold=0.1, items=df).collect()
    i = text.index("zebra")
    assert r.excerpt == text[i - 20:i + 80] and r.context == text[i - 100:i + 200]


def test_long_queries(spark):
    rng = random.Random(5)
    query = "".join(rng.choice("abcde ") for _ in range(90))
    text = "x" * 2000 + query[:40] + "#" + query[40:] + "y" * 300
    (r,) = fz.fuzzy_scores(one(spark, text), query, 0.1).collect()
    assert (r.dist, r.start) == (1, 2000)


def test_time_grows_with_the_text(spark):
    def seconds(n):
        df = one(spark, "lorem ipsum " * (n // 12)).cache()
        try:
            df.count()
            t = time.time()
            fz.fuzzy_scores(df, "zebracrossing", 0.1).collect()
            return time.time() - t
        finally:
            df.unpersist(blocking=True)

    seconds(100_000)
    assert seconds(2_000_000) < 8 * max(seconds(500_000), 0.5)


def test_aggregate_holds_no_texts(spark, hist):
    plan = fz.search_fuzzy(hist, "valve")._jdf.queryExecution().executedPlan().toString()
    (line,) = [x for x in plan.splitlines() if "HashAggregate" in x and "partial_min" in x][:1]
    assert "content" not in line and "SortAggregate" not in plan


def test_prefilter_never_loses_a_hit():
    rng = random.Random(3)
    texts = ["".join(rng.choice("abcde ") for _ in range(rng.randint(5, 60))) for _ in range(300)]
    for q in ("abcde", "eddcba", "aaab"):
        for t in (0.2, 0.4, 0.6):
            k = min(allowed_errors(len(q), t), len(q) - 2)
            if k < 0:
                continue
            pieces = fz.query_pieces(q, k)
            d, _ = best_alignment(texts, q, k)
            assert all(not pieces or any(p in text for p in pieces) for text, x in zip(texts, d) if x >= 0)
