import random

import pytest
from pyspark.sql import functions as F

from convsift.llm import mixing


def fill(sizes, weights, cap=3):
    """Targets by repeated sharing of the excess."""
    left, out, free = float(sum(sizes)), [0.0] * len(sizes), set(range(len(sizes)))
    while free:
        w = sum(weights[i] for i in free)
        over = [i for i in free if left * weights[i] / w > cap * sizes[i]]
        if not over:
            for i in free:
                out[i] = left * weights[i] / w
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
            free.discard(i)
            w = sum(weights[j] for j in free)
            break
    return out


@pytest.mark.parametrize("seed", range(5))
def test_targets(seed):
    rng = random.Random(seed)
    sizes = [rng.choice([0, 1, 10, 1000, 50_000]) + rng.randrange(9) for _ in range(9)]
    weights = [1.0 + i % 3 for i in range(9)]
    got = mixing.fill_targets(sizes, weights)
    assert got == pytest.approx(fill(sizes, weights)) and sum(got) == pytest.approx(sum(sizes))


def table(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return mixing.query(spark, str(tmp_path)).collect()


def test_query(spark, make_docs, clashing, tmp_path):
    rng = random.Random(1)
    rows = [(i, "w " * rng.randint(0, 40), None, rng.choice(["a", "b", "c", "d", None])) for i in range(800)]
    rows += [(9000, None, None, "a"), (9001, "", None, "b"), (9002, "x " * 3, None, "tiny"), (None, "q r", None, "a"), (9700, "s t", None, "b"), (9700, "s t", None, "b")]
    rows += [(9500, "\tä\n b\x0bc d ", None, "c")]
    out = table(spark, tmp_path, clashing(make_docs(rows)))
    again = mixing.query(spark, str(tmp_path)).collect()
    assert sorted(map(str, out)) == sorted(map(str, again)) and len(out) == len(rows)
    source = {}
    for d, t, _, s in rows:
        words = len((t or "").replace("\t", " ").replace("\n", " ").replace("\x0b", " ").split(" ")) - (t or " ").replace("\t", " ").replace(
            "\n", " ").replace("\x0b", " ").split(" ").count("") if t else 0
        source.setdefault(s, []).append(words)
    names = sorted(source, key=lambda s: (s is None, s or ""))
    want = dict(zip(names, mixing.fill_targets([sum(source[s]) for s in names], [1.0 + i % 3 for i in range(len(names))])))
    by = {}
    where = {(d, mixing.SEED): s for d, _, _, s in rows}
    for r in out:
        assert 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
        s = where[r.doc_id, mixing.SEED] if r.doc_id is not None else "a"
        assert r.source_size == sum(source[s]) and r.target == pytest.approx(want[s])
        by[s] = by.get(s, 0) + r.taken
    for s in names:
        assert abs(by[s] - want[s]) <= 3


def test_one_source_and_empty_table(spark, make_docs, tmp_path):
    out = table(spark, tmp_path, make_docs([(1, "a b", None, "s"), (2, "", None, "s")]))
    assert {(r.doc_id, r.taken, r.target) for r in out} == {(1, 2, 2.0), (2, 0, 2.0)}
    assert table(spark, tmp_path / "none", make_docs([])) == []


def test_overlapping_sources(spark):
    rows = [(i, 10, m) for i, m in enumerate([["a"], ["a", "b"], ["b", "c"], ["c"]] * 100)]
    docs = spark.createDataFrame(rows, "doc_id bigint, words bigint, sources array<string>")
    out = mixing.mix_sources(docs, F.col("words"), F.col("sources"), weights={"a": 1, "b": 4, "c": 1}).collect()
    taken = {}
    for r in out:
        assert len(r.copy_sources) == r.copies <= 3 and set(r.copy_sources) <= set(r.sources)
        for s in r.copy_sources:
            taken[s] = taken.get(s, 0) + 10
    assert sum(taken.values()) == pytest.approx(4000, abs=60)
    assert taken["b"] == pytest.approx(4000 * 4 / 6, abs=60) and taken["a"] == pytest.approx(4000 / 6, abs=60)


def test_flow_prefers_spread_repetitions():
    # Two patterns can serve source 0; the flow repeats neither before both are used.
    flows = mixing.route([10, 10, 5], [[0], [0, 1], [1]], [18, 5])
    assert sum(f.get(0, 0) for f in flows) == 18 and sum(f.get(1, 0) for f in flows) == 5
    assert max(flows[0].values()) <= 10 and sum(flows[1].values()) <= 10


def test_too_many_patterns(spark, monkeypatch):
    monkeypatch.setattr(mixing, "MAX_PATTERNS", 3)
    docs = spark.createDataFrame([(i, 1, [f"s{i}"]) for i in range(4)], "doc_id bigint, words bigint, sources array<string>")
    with pytest.raises(ValueError):
        mixing.mix_sources(docs, F.col("words"), F.col("sources"))
