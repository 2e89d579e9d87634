"""Whole long documents: windowed fuzzy scoring equals scoring each whole
text at once (the SQL brute force is too slow on these texts, so this is
the check for ``fuzzy_documents``)."""

import os

import pytest

import __spark_entry__ as E
from convsift.functions.editdist import allowed_errors, best_alignment
from convsift.operators.fuzzy import MIN_MATCH_CHARS, fuzzy_scores
from convsift.operators.items import build_items
from convsift.sources.driver_tables import driver_history

SF = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.exists(SF), reason="benchmark tables not present")


@pytest.mark.parametrize("query,threshold", [("reaument", 0.25), ("grenzen", 0.3), ("thatantion", 0.2)])
def test_windowed_scores_equal_whole_text(spark, query, threshold):
    items = build_items(driver_history(spark, SF, ("doc",))).where("match_type = 'message'")
    k = min(allowed_errors(len(query), threshold), len(query) - MIN_MATCH_CHARS)
    got = {r.part_id: (r.dist, r.start) for r in fuzzy_scores(items, query, threshold).collect()}
    rows = items.select("part_id", "content").collect()
    assert max(len(r.content) for r in rows) > 4096           # several windows per text
    d, s = best_alignment([r.content.lower() for r in rows], query.lower(), k)
    want = {r.part_id: (int(dd), int(ss)) for r, dd, ss in zip(rows, d, s) if dd >= 0}
    assert got == want


def test_registered_query_runs(spark):
    df = E.queries()["fuzzy_documents"](spark, SF)
    rows = df.collect()
    assert df.columns == ["session_id", "session_title", "timestamp", "match_type", "excerpt", "context",
                          "message_id", "part_id", "project_directory"]
    assert len(rows) <= 20


def test_long_texts_spread_over_files(spark, tmp_path):
    from pyspark.sql import functions as F
    from convsift.sources.history import load_history, write_history
    write_history(driver_history(spark, SF, ("conv", "doc")), str(tmp_path / "h"), partitions=4)
    parts = load_history(spark, str(tmp_path / "h")).parts
    per_file = (parts.where(F.col("part_id").startswith("prt_d"))
                .groupBy(F.input_file_name().alias("f")).agg(F.sum(F.length("text")).alias("chars"))
                .collect())
    chars = sorted(r.chars for r in per_file)
    assert len(chars) == 4 and chars[-1] < 0.5 * sum(chars)     # no file holds most of the text
