import pytest

from convsift.operators.trace import ALL, trace_file, trace_files, trace_page
from convsift.sources.history import load_history, write_history
from history_data import HOUSE, ORCHARD, at, frames, history
from convsift.sources.tables import normalise_tables


@pytest.fixture(scope="module")
def hist(spark):
    return history(spark)


def rows(df):
    return [r.asDict() for r in df.collect()]


def test_touches_newest_first_with_prompt_and_first_flag(hist):
    r = rows(trace_file(hist, "lib/valve.py", project_id=HOUSE))
    assert [(x["session_id"], x["timestamp"], x["tool_name"], x["first_touch"]) for x in r] == [
        ("s-drip", at("s-drip", 2), "edit", False), ("s-night", at("s-night", 1), "edit", False),
        ("s-valve", at("s-valve", 1), "write", True)]
    assert [x["user_prompt"] for x in r] == [
        "Only after a reboot, though.", "No watering between ten and six, the pump is loud.",
        "Please water the beds whenever the soil probe reads dry."]
    assert r[0]["session_title"] == "Dripping after a reboot"


def test_patch_alone_is_a_touch(hist):
    (r,) = rows(trace_file(hist, "lib/quiet.py"))
    assert (r["session_id"], r["tool_name"], r["first_touch"]) == ("s-night", None, True)


def test_touch_without_a_prompt(hist):
    (r,) = rows(trace_file(hist, "conf/pump.toml", project_id=HOUSE))
    assert r["user_prompt"] is None


@pytest.mark.parametrize("path", ["lib/found.py", "lib/told.py", "lib/none.py", "alve.py", "ib/valve.py"])
def test_mentions_and_partial_names_are_no_touch(hist, path):
    assert rows(trace_file(hist, path)) == []


@pytest.mark.parametrize("path", ["valve.py", "lib\\valve.py"])
def test_name_alone_and_backslashes(hist, path):
    assert rows(trace_file(hist, path, project_id=HOUSE)) == rows(trace_file(hist, "lib/valve.py", project_id=HOUSE))


def test_projects(hist):
    assert [x["session_id"] for x in rows(trace_file(hist, "valve.py", project_id=ORCHARD))] == ["s-trees"]
    r = rows(trace_file(hist, "valve.py"))
    assert [(x["session_id"], x["first_touch"]) for x in r] == [
        ("s-trees", False), ("s-drip", False), ("s-night", False), ("s-valve", True)]


def test_limit_comes_last(hist):
    r = rows(trace_file(hist, "valve.py", limit=2, project_id=HOUSE))
    assert [x["session_id"] for x in r] == ["s-drip", "s-night"] and not any(x["first_touch"] for x in r)


def test_batch_equals_single(spark, hist):
    paths = ["lib/valve.py", "valve.py", "lib\\valve.py", "lib/quiet.py", "conf/pump.toml", "lib/none.py"]
    batch = rows(trace_files(hist, spark.createDataFrame([(p,) for p in paths], "query string"), project_id=HOUSE))
    for p in paths:
        got = sorted(({k: v for k, v in x.items() if k != "query"} for x in batch if x["query"] == p), key=lambda x: -x["timestamp"])
        assert got == rows(trace_file(hist, p, project_id=HOUSE)), p


def test_nothing_stays_cached_and_new_rows_are_seen(spark, tmp_path):
    s, m, p = frames(spark)
    for name, df in (("s", s), ("m", m), ("p", p)):
        df.write.parquet(str(tmp_path / name))

    def found():
        read = [spark.read.parquet(str(tmp_path / n)) for n in "smp"]
        return len(rows(trace_file(normalise_tables(*read), "valve.py")))

    def cached():
        return spark.sparkContext._jsc.sc().getPersistentRDDs().size()

    held = cached()
    before = found()
    assert cached() == held
    p.where("message_id = 's-audit-m1'").limit(1).selectExpr(
        "'late' AS id", "message_id", "session_id", "time_created", "time_updated",
        "'{\"type\":\"patch\",\"files\":[\"lib/valve.py\"]}' AS data").write.mode("append").parquet(str(tmp_path / "p"))
    assert found() == before + 1


def test_all_touches_without_a_top_n(hist):
    whole = trace_file(hist, "valve.py", limit=ALL)
    assert rows(whole) == rows(trace_file(hist, "valve.py", limit=10_000))
    assert "TakeOrdered" not in whole._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("size", [1, 2, 3, 100])
def test_pages_together_are_the_trace(hist, size):
    got, after = [], None
    while True:
        page = rows(trace_page(hist, "valve.py", after, size))
        got += page
        if len(page) < size:
            break
        after = page[-1]["cursor"]
    assert [{k: v for k, v in r.items() if k != "cursor"} for r in got] == rows(trace_file(hist, "valve.py", limit=ALL))


def test_a_page_after_rows_without_a_time(spark):
    s, m, p = frames(spark)
    h = normalise_tables(s, m.selectExpr("id", "session_id", "CASE WHEN id LIKE '%m1' THEN time_created END AS time_created",
                                         "time_updated", "data"), p)
    whole = rows(trace_file(h, "valve.py", limit=ALL))
    assert any(r["timestamp"] is None for r in whole) and any(r["timestamp"] for r in whole)
    got, after = [], None
    for _ in whole:
        (r,) = rows(trace_page(h, "valve.py", after, 1))
        after = r.pop("cursor")
        got.append(r)
    assert got == whole
    assert rows(trace_page(h, "valve.py", after, 1)) == []


def test_stored_prompts_give_the_same_rows(spark, hist, tmp_path):
    write_history(hist, str(tmp_path))
    stored = load_history(spark, str(tmp_path))
    assert stored.prompts is not None
    paths = ["lib/valve.py", "valve.py", "lib/quiet.py", "conf/pump.toml", "lib/none.py"]
    for p in paths:
        for limit in (2, 50, ALL):
            assert rows(trace_file(stored, p, limit=limit)) == rows(trace_file(hist, p, limit=limit)), (p, limit)
    queries = spark.createDataFrame([(p,) for p in paths], "query string")
    key = lambda r: (r["query"], -r["timestamp"], r["session_id"])
    assert sorted(rows(trace_files(stored, queries)), key=key) == sorted(rows(trace_files(hist, queries)), key=key)


def test_building_a_trace_runs_no_job(spark, hist, tmp_path):
    write_history(hist, str(tmp_path))
    stored = load_history(spark, str(tmp_path))
    queries = spark.createDataFrame([("valve.py",)], "query string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("build", "")
    try:
        for h in (hist, stored):
            trace_file(h, "valve.py")
            trace_file(h, "valve.py", limit=ALL)
            trace_files(h, queries, limit_per_query=3)
        assert list(tracker.getJobIdsForGroup("build")) == []
    finally:
        spark.sparkContext._jsc.clearJobGroup()


def test_pages_share_the_touches(spark):
    from convsift.operators.trace import flagged_touches, in_page_order, trace_page
    from convsift.session import written
    h = history(spark)
    touches, after, seen = flagged_touches(h, "valve.py"), None, []
    while True:
        page = trace_page(h, "valve.py", after, 2, touches=touches)
        rows = page.collect()
        assert rows == trace_page(h, "valve.py", after, 2).collect() == in_page_order(written(page, "page")).collect()
        if not rows:
            break
        seen += rows
        after = rows[-1].cursor
    assert [r[:-1] for r in seen] == [tuple(r) for r in trace_file(h, "valve.py", limit="all").collect()] and len(seen) > 2
