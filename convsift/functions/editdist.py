"""Approximate substring matching: best alignment of a query anywhere in a text.

``dist`` is the smallest Levenshtein distance between the query and any
substring of the text (Sellers, 1980); ``start`` is where the leftmost
substring with that distance begins.  Both come from one bit-parallel pass
(Myers, 1999) over the *reversed* text with the reversed query: in that
direction the column score is the best distance of substrings *starting*
at the mirrored position, so the last column reaching the minimum gives the
leftmost start.

The numpy form advances a whole batch of texts one character per step with
``uint64`` bit vectors.  Queries above 64 characters take ceil(m / 64) vectors a
text: the lowest runs first, and the step at its last row (up, level or down)
goes into the next one.  Texts are expected to be short windows (the Spark side
cuts long texts into overlapping windows), and rows are grouped by length so
padding stays small.
"""

from __future__ import annotations

import numpy as np

_PAD = np.uint32(0xFFFFFFFF)   # never a code point
GROUP_ROWS = 4096


def allowed_errors(m: int, threshold: float) -> int:
    """Greatest e with e/m <= threshold (compared exactly, not by floor)."""
    e = 0
    while e + 1 <= m and (e + 1) / m <= threshold:
        e += 1
    return e


def _codes(s: str) -> np.ndarray:
    return np.frombuffer(s.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _peq(query_rev: str) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct query characters and their position bit masks."""
    chars: dict[int, int] = {}
    for i, ch in enumerate(query_rev):
        chars[ord(ch)] = chars.get(ord(ch), 0) | (1 << i)
    keys = np.array(sorted(chars), dtype=np.uint32)
    masks = np.array([chars[int(k)] for k in keys], dtype=np.uint64)
    return keys, masks


def _scan_group(texts_rev: list[str], keys: np.ndarray, masks: np.ndarray, m: int):
    """Run the bit-parallel scan over one group of reversed texts.

    Rows are ordered longest first, so at step j the rows still running are a
    prefix; character masks are laid out step-major so each step reads one
    contiguous row; all updates are in place on preallocated buffers.
    """
    n = len(texts_rev)
    lens = np.fromiter((len(t) for t in texts_rev), dtype=np.int64, count=n)
    order = np.argsort(-lens, kind="stable")
    lens_sorted = lens[order]
    width = int(lens_sorted[0]) if n else 0
    codes = np.full((max(width, 1), n), _PAD, dtype=np.uint32)
    for col, i in enumerate(order):
        t = texts_rev[i]
        if t:
            codes[:len(t), col] = _codes(t)
    idx = np.searchsorted(keys, codes)
    np.minimum(idx, len(keys) - 1, out=idx)
    eq_all = np.where(keys[idx] == codes, masks[idx], np.uint64(0))
    del codes, idx
    # live[j] = number of rows longer than j (a prefix, rows being longest first)
    live = n - np.searchsorted(lens_sorted[::-1], np.arange(width), side="right")

    full = np.uint64((1 << m) - 1) if m < 64 else np.uint64(0xFFFFFFFFFFFFFFFF)
    shift = np.uint64(m - 1)
    one = np.uint64(1)
    pv = np.full(n, full, dtype=np.uint64)
    mv = np.zeros(n, dtype=np.uint64)
    xv, xh, ph, mh, t = (np.empty(n, dtype=np.uint64) for _ in range(5))
    score = np.full(n, m, dtype=np.int64)
    best = np.full(n, m, dtype=np.int64)
    last = np.full(n, -1, dtype=np.int64)
    delta = np.empty(n, dtype=np.int64)
    hit = np.empty(n, dtype=bool)
    for j in range(width):
        c = int(live[j])
        eq = eq_all[j, :c]
        Pv, Mv, Xv, Xh, Ph, Mh, T = pv[:c], mv[:c], xv[:c], xh[:c], ph[:c], mh[:c], t[:c]
        np.bitwise_or(eq, Mv, out=Xv)
        np.bitwise_and(eq, Pv, out=T)
        np.add(T, Pv, out=T)
        np.bitwise_xor(T, Pv, out=T)
        np.bitwise_or(T, eq, out=Xh)
        np.bitwise_or(Xh, Pv, out=T)
        np.invert(T, out=T)
        np.bitwise_or(Mv, T, out=Ph)
        np.bitwise_and(Pv, Xh, out=Mh)
        # score += top bit of Ph - top bit of Mh
        D = delta[:c]
        np.right_shift(Ph, shift, out=T)
        np.bitwise_and(T, one, out=T)
        np.copyto(D, T, casting="unsafe")
        np.right_shift(Mh, shift, out=T)
        np.bitwise_and(T, one, out=T)
        np.subtract(D, T, out=D, casting="unsafe")
        np.add(score[:c], D, out=score[:c])
        np.left_shift(Ph, one, out=Ph)
        np.left_shift(Mh, one, out=Mh)
        np.bitwise_or(Xv, Ph, out=T)
        np.invert(T, out=T)
        np.bitwise_or(Mh, T, out=T)
        np.bitwise_and(T, full, out=Pv)
        np.bitwise_and(Ph, Xv, out=Mv)
        B = best[:c]
        np.minimum(B, score[:c], out=B)
        np.equal(score[:c], B, out=hit[:c])
        np.copyto(last[:c], j, where=hit[:c])
    inv = np.empty_like(order)
    inv[order] = np.arange(n)
    return lens, best[inv], last[inv]


def _scan_blocks(texts_rev: list[str], query_rev: str):
    """The scan with several words a text (queries longer than 64 characters)."""
    m, n = len(query_rev), len(texts_rev)
    words = [query_rev[i:i + 64] for i in range(0, m, 64)]
    lens = np.fromiter((len(t) for t in texts_rev), dtype=np.int64, count=n)
    order = np.argsort(-lens, kind="stable")
    lens_sorted = lens[order]
    width = int(lens_sorted[0]) if n else 0
    codes = np.full((max(width, 1), n), _PAD, dtype=np.uint32)
    for col, i in enumerate(order):
        if texts_rev[i]:
            codes[:len(texts_rev[i]), col] = _codes(texts_rev[i])
    # Distinct query characters by number (0: none of them); masks of each in every word.
    keys = np.array(sorted({ord(ch) for ch in query_rev}), dtype=np.uint32)
    idx = np.minimum(np.searchsorted(keys, codes), len(keys) - 1)
    number = np.where(keys[idx] == codes, idx + 1, 0).astype(np.int32)
    del codes, idx
    masks = np.zeros((len(words), len(keys) + 1), dtype=np.uint64)
    for w, part in enumerate(words):
        for i, ch in enumerate(part):
            masks[w, np.searchsorted(keys, ord(ch)) + 1] |= np.uint64(1 << i)
    live = n - np.searchsorted(lens_sorted[::-1], np.arange(width), side="right")

    tops = [np.uint64(len(part) - 1) for part in words]
    one = np.uint64(1)
    pv = np.full((len(words), n), 0xFFFFFFFFFFFFFFFF, dtype=np.uint64)
    mv = np.zeros((len(words), n), dtype=np.uint64)
    score = np.full(n, m, dtype=np.int64)
    best = np.full(n, m, dtype=np.int64)
    last = np.full(n, -1, dtype=np.int64)
    for j in range(width):
        c = int(live[j])
        up = down = None  # the step into the word above; none enters the lowest
        at = number[j, :c]
        for w, top in enumerate(tops):
            eq, Pv, Mv = masks[w][at], pv[w, :c], mv[w, :c]
            Xv = eq | Mv
            if down is not None:
                eq = eq | down
            Xh = (((eq & Pv) + Pv) ^ Pv) | eq
            Ph = Mv | ~(Xh | Pv)
            Mh = Pv & Xh
            out_up, out_down = (Ph >> top) & one, (Mh >> top) & one
            Ph <<= one
            Mh <<= one
            if up is not None:
                Ph |= up
                Mh |= down
            pv[w, :c] = Mh | ~(Xv | Ph)
            mv[w, :c] = Ph & Xv
            up, down = out_up, out_down
        score[:c] += up.astype(np.int64) - down.astype(np.int64)
        np.minimum(best[:c], score[:c], out=best[:c])
        np.copyto(last[:c], j, where=score[:c] == best[:c])
    inv = np.empty_like(order)
    inv[order] = np.arange(n)
    return lens, best[inv], last[inv]


def best_alignment(texts: list[str | None], query: str, max_dist: int):
    """Per text: (dist, start) of the best alignment, or (-1, -1) when the
    best distance exceeds ``max_dist``.  ``start`` is a 0-based character
    index into the text."""
    n = len(texts)
    dist = np.full(n, -1, dtype=np.int64)
    start = np.full(n, -1, dtype=np.int64)
    m = len(query)
    if m == 0 or n == 0:
        return dist, start
    q_rev = query[::-1]
    order = sorted((i for i in range(n) if texts[i]), key=lambda i: len(texts[i]))
    if m <= 64:
        keys, masks = _peq(q_rev)
    for g in range(0, len(order), GROUP_ROWS):
        ids = order[g:g + GROUP_ROWS]
        texts_rev = [texts[i][::-1] for i in ids]
        lens, best, last = _scan_group(texts_rev, keys, masks, m) if m <= 64 else _scan_blocks(texts_rev, q_rev)
        ok = (best <= max_dist) & (last >= 0)
        sel = np.asarray(ids, dtype=np.int64)[ok]
        dist[sel] = best[ok]
        start[sel] = lens[ok] - 1 - last[ok]
    return dist, start
