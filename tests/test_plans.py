"""Physical-plan shape checks: the properties the operators rely on at scale."""

import contextlib
import io
import tempfile

import pytest
from pyspark.sql import functions as F

from convsift.functions.patterns import build_matcher
from convsift.operators.fuzzy import search_fuzzy
from convsift.operators.keyword import search_keyword
from convsift.operators.trace import trace_file, trace_files
from convsift.sources.history import load_history, write_history
from history_data import HOUSE, history


def plan(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain("formatted")
    return buf.getvalue()


@pytest.fixture(scope="module")
def pq(spark):
    out = tempfile.mkdtemp(prefix="convsift-plans-")
    write_history(history(spark), out, partitions=2)
    return load_history(spark, out)


def test_keyword_is_one_parts_scan_and_top_n(spark, pq):
    df = search_keyword(pq, build_matcher("valve", spark=spark), limit=10, project_id=HOUSE)
    p = plan(df)
    assert "TakeOrderedAndProject" in p
    head = p.split("\n\n")[0]
    assert head.count("Scan parquet") == 2          # sessions (titles) + parts, each read once
    assert "Exchange" not in head                   # no shuffle: top-N and a single-partition sort
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
    formatted = p
    assert "PushedFilters: [IsNotNull(project_id), EqualTo(project_id,greenhouse)" in formatted


def test_fuzzy_uses_arrow_udf_and_top_n(spark, pq):
    p = plan(search_fuzzy(pq, "valve", threshold=0.3, limit=5))
    assert "ArrowEvalPython" in p and "TakeOrderedAndProject" in p
    assert "BatchEvalPython" not in p          # no row-at-a-time Python


def test_trace_has_no_pairwise_join(spark, pq):
    for df in (trace_file(pq, "lib/valve.py"),
               trace_files(pq, spark.createDataFrame([("valve.py",), ("conf/pump.toml",)], "query string"))):
        p = plan(df)
        assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p


def test_stored_history_traces_from_its_touches(spark, pq):
    assert pq.items is not None and pq.touches is not None
    p = plan(trace_file(pq, "lib/valve.py"))
    assert "EqualTo(last_component,valve.py)" in p            # pushed to the scan
    assert "get_json_object" not in p.lower()
    fresh = history(spark)
    for path in ("lib/valve.py", "valve.py", "lib/quiet.py", "conf/pump.toml", "none"):
        assert trace_file(pq, path).collect() == trace_file(fresh, path).collect()
    queries = spark.createDataFrame([("valve.py",), ("lib/quiet.py",)], "query string")
    key = lambda r: str(r)
    assert sorted(trace_files(pq, queries).collect(), key=key) == sorted(trace_files(fresh, queries).collect(), key=key)


def test_a_trace_passes_the_history_once_for_its_touches(spark):
    """Touches of a history without stored ones are written down, not found again by every use."""
    h = history(spark)
    queries = spark.createDataFrame([("valve.py",), ("conf/pump.toml",)], "query string")
    for df in (trace_file(h, "lib/valve.py"), trace_file(h, "lib/valve.py", limit="all"), trace_files(h, queries)):
        assert "get_json_object" not in plan(df).lower()


def test_clustered_rows_are_written_where_they_are(spark, tmp_path):
    from convsift.sources.history import _write
    df = spark.range(0, 300, 1, 3).selectExpr("'p' AS project_id", "id")
    _write(df, str(tmp_path / "t"), ["project_id", "id"], None, ["id"], "error", clustered=True)
    files = spark.read.parquet(str(tmp_path / "t")).groupBy(F.input_file_name()).count().collect()
    assert sorted(r["count"] for r in files) == [100, 100, 100]


def test_stored_history_searches_its_items(spark, pq):
    from convsift.operators.fuzzy import search_fuzzy as run
    assert "items" in plan(run(pq, "valve", limit=3)).replace("\n", " ")
    assert run(pq, "valve", limit=9).collect() == run(history(spark), "valve", limit=9).collect()


def test_project_scope_opens_few_files(spark, tmp_path):
    from pyspark.sql import functions as F
    from convsift.model import History
    h = history(spark)
    wide = h.parts.crossJoin(spark.range(40).withColumnRenamed("id", "n")).withColumn(
        "project_id", F.concat(F.lit("p"), F.col("n").cast("string"))).drop("n")
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
             "spark.sql.adaptive.coalescePartitions.minPartitionSize": "1k"}
    old = {k: spark.conf.get(k) for k in small}
    try:
        for k, v in small.items():
            spark.conf.set(k, v)
        write_history(History(h.sessions, h.messages, wide), str(tmp_path / "h"))
    finally:
        for k, v in old.items():
            spark.conf.set(k, v)
    parts = load_history(spark, str(tmp_path / "h")).parts
    everything = parts.select(F.input_file_name()).distinct().count()
    one = parts.where("project_id = 'p7'").select(F.input_file_name()).distinct().count()
    assert everything > 3 and one <= 2
