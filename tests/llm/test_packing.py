import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from convsift.llm import packing

P = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(str(P.path(packing.TOKENIZER)))
    t.encode_special_tokens = True
    return t


def run(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return packing.query(spark, str(tmp_path)).collect()


def check(out, rows, tokenizer, slack):
    want = Counter()
    for d, t in rows:
        ids = tokenizer.encode(t or "", add_special_tokens=False).ids + [packing.END_ID]
        for k, lo in enumerate(range(0, len(ids), 4096)):
            piece = ids[lo:lo + 4096]
            want[d, k, lo, len(piece), zlib.crc32(np.array(piece, "<u4").tobytes())] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in out) == want
    sequences = defaultdict(list)
    for r in out:
        sequences[r.sequence_id].append((r.offset, r.length))
    for places in sequences.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(k[3] * n for k, n in want.items())
    assert len(sequences) <= -(-total // 4096) * (1 + slack) + 1


ODD = ["", None, "I'm don't ﬁ ａ b ć ́x 'S <|endoftext|> a\x1cb ΑΣ ΑΣ. İ", "e ́", "中文 字1234 x\u0085y\x00z᠎ w​ v", "﻿a '\n's it's'll",
       "x" * 30_000, "word " * 9_000, "ŉ ſ µ ª º ¼ ² ­ q", "<|startoftext|>", "A1B2 c_d-e.f"]


def test_whole_table(spark, make_docs, clashing, tokenizer, tmp_path):
    rng = random.Random(1)
    vocab = ["".join(rng.choices("abcdefghéñ,.", k=rng.randint(1, 9))) for _ in range(800)]
    rows = [(i, " ".join(rng.choices(vocab, k=int(rng.expovariate(1 / 250)) + 1))) for i in range(300)]
    rows += list(enumerate(ODD, 1000)) + [(None, "a b"), (5, "again"), (5, "again")]
    check(run(spark, tmp_path, clashing(make_docs(rows))), rows, tokenizer, 0.03)


def test_many_equal_lengths(spark, make_docs, tokenizer, tmp_path, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_ROWS", 20)
    rows = [(i, "same text here") for i in range(500)] + [(i, "y " * 700) for i in range(500, 560)]
    check(run(spark, tmp_path, make_docs(rows)), rows, tokenizer, 0.3)


def test_empty_table(spark, make_docs, tmp_path):
    assert run(spark, tmp_path, make_docs([])) == []


@pytest.mark.parametrize("seed", range(6))
def test_plan(seed):
    rng = random.Random(seed)
    mean = rng.choice([20, 300, 900, 2500])
    counts = Counter(min(4096, int(rng.expovariate(1 / mean)) + 1) for _ in range(rng.choice([1, 50, 5000])))
    counts = {k: v * rng.choice([1, 1000]) for k, v in counts.items()}
    plan = packing.plan_packing(counts)
    used = Counter()
    events = []
    for length, rank, n, sequence, offset in plan.tolist():
        assert rank == used[length]
        used[length] += n
        events.append((sequence, sequence + n, offset, length))
    assert used == Counter(counts)
    # Every sequence that starts or ends a run is filled without gaps.
    for s in {e[0] for e in events} | {e[1] - 1 for e in events}:
        at = 0
        for _, _, offset, length in sorted((e for e in events if e[0] <= s < e[1]), key=lambda e: e[2]):
            assert offset == at
            at += length
        assert 0 < at <= 4096
    total = sum(k * v for k, v in counts.items())
    if mean < 1000 and sum(counts.values()) > 1000:
        assert max(e[1] for e in events) <= total / 4096 * 1.01 + 1


def test_nnls():
    rng = np.random.default_rng(1)
    a = rng.random((12, 6))
    x = np.array([0, 1, 0, 2, 0.5, 0])
    assert np.allclose(packing.nnls(a, a @ x, 5000), x, atol=1e-2)
