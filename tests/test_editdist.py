"""Bit-parallel approximate matching against a brute-force definition."""

import random
import time

import pytest
from hypothesis import given, settings, strategies as st

from convsift.functions.editdist import allowed_errors, best_alignment


def lev(a, b):
    prev = list(range(len(b) + 1))
    for i, ca in enumerate(a, 1):
        cur = [i]
        for j, cb in enumerate(b, 1):
            cur.append(min(prev[j] + 1, cur[j - 1] + 1, prev[j - 1] + (ca != cb)))
        prev = cur
    return prev[-1]


def brute(text, q, k):
    best, start = None, None
    for s in range(len(text)):
        for e in range(s + 1, len(text) + 1):
            d = lev(q, text[s:e])
            if best is None or d < best or (d == best and s < start):
                best, start = d, s
    if best is None or best > k:
        return -1, -1
    return best, start


alphabet = st.sampled_from(list("abcé d"))


@settings(max_examples=300, deadline=None)
@given(q=st.text(alphabet, min_size=1, max_size=7),
       texts=st.lists(st.text(alphabet, max_size=16), min_size=1, max_size=6),
       k=st.integers(0, 7))
def test_matches_brute_force(q, texts, k):
    k = min(k, len(q))
    d, s = best_alignment(texts, q, k)
    for t, dd, ss in zip(texts, d, s):
        assert (int(dd), int(ss)) == brute(t, q, k)


def sellers(text, q):
    """(distance, leftmost start) of the best substring, column by column over the reversed text."""
    text, q = text[::-1], q[::-1]
    column = list(range(len(q) + 1))
    best, last = len(q), -1
    for j, ch in enumerate(text):
        new = [0]
        for i, c in enumerate(q, 1):
            new.append(min(column[i] + 1, new[i - 1] + 1, column[i - 1] + (c != ch)))
        column = new
        if column[-1] <= best:
            best, last = column[-1], j
    return best, len(text) - 1 - last


@pytest.mark.parametrize("m", [63, 64, 65, 90, 127, 128, 129, 200])
def test_queries_of_several_words(m):
    rng = random.Random(m)
    q = "".join(rng.choices("abcdeé ", k=m))
    texts = ["", None, q, "x" * 300]
    for _ in range(120):
        broken = list(q)
        for _ in range(rng.randrange(m // 3)):
            broken[rng.randrange(len(broken))] = rng.choice(["", "z", "ab", "é"])
        body = "".join(broken)[rng.randrange(5):]
        texts.append("".join(rng.choices("abcdeé ", k=rng.randrange(150))) + body + "".join(rng.choices("abcd ", k=rng.randrange(150))))
    for k in (0, 3, m // 4):
        d, s = best_alignment(texts, q, k)
        for t, dd, ss in zip(texts, d, s):
            want = sellers(t, q) if t else (m, -1)
            assert (int(dd), int(ss)) == (want if want[0] <= k and t else (-1, -1)), t


def test_a_second_word_costs_no_more_than_thrice():
    rng = random.Random(1)
    texts = ["".join(rng.choices("abcdefgh ", k=1100)) for _ in range(600)]

    def seconds(m):
        q = "".join(rng.choices("abcdefgh", k=m))
        best_alignment(texts, q, m // 4)
        t = time.process_time()
        best_alignment(texts, q, m // 4)
        return time.process_time() - t

    assert min(seconds(90) for _ in range(3)) < 3 * max(seconds(60) for _ in range(3))


@given(m=st.integers(1, 80), t=st.floats(0, 1))
def test_allowed_errors_is_greatest_within_threshold(m, t):
    k = allowed_errors(m, t)
    assert k / m <= t and (k == m or (k + 1) / m > t)
