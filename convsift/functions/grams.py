"""Trigrams that every match of a search pattern must contain.

Trigrams are runs of three printable ASCII characters, letters in lower case.  The
characters that case folding takes for ASCII letters count as these, so a text that
matches in any case holds the pattern's trigrams, and a text without one of them cannot
match; whether it does match is still tested on the text.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Characters outside ASCII that fold to letters, and these.
_FOLDED, _LETTERS = "ſKİı", "skii"
_QUANTIFIED = re.compile(r"[*?+]|\{[0-9]+(?:,[0-9]*)?\}")
#: Trigrams of one lookup.
MAX_GRAMS = 10


def plain(text: Column) -> Column:
    """A text with the characters that fold to ASCII letters replaced by them."""
    return F.translate(text, _FOLDED, _LETTERS)


#: A byte as trigrams count it: printable ASCII in lower case, anything else 0.
_COUNTED = np.zeros(256, np.uint8)
_COUNTED[32:127] = np.arange(32, 127)
_COUNTED[65:91] += 32


def mark_grams(texts, seen: np.ndarray) -> None:
    """Mark the trigrams of an Arrow array of strings (32-bit offsets) in ``seen``, by their
    code: seven bits a character."""
    _, at, data = texts.buffers()
    ends = np.frombuffer(at, np.int32)[texts.offset:texts.offset + len(texts) + 1] if len(texts) else np.zeros(1, np.int32)
    low = _COUNTED[np.frombuffer(data or b"", np.uint8)[ends[0]:ends[-1]]]
    if len(low) < 3:
        return
    ok = low > 0
    inside = ok[:-2] & ok[1:-1] & ok[2:]
    # None reaches from one text into the next.
    edges = (ends[1:-1] - ends[0])[:, None] - np.array([1, 2])
    inside[edges[(edges >= 0) & (edges < len(inside))]] = False
    wide = low.astype(np.int32)
    seen[((wide[:-2] << 14) | (wide[1:-1] << 7) | wide[2:])[inside]] = True


def gram_codes(texts: list[bytes]) -> np.ndarray:
    """Distinct trigrams of UTF-8 texts, seven bits a character, ascending."""
    import pyarrow as pa

    seen = np.zeros(1 << 21, bool)
    mark_grams(pa.array(texts, pa.binary()), seen)
    return np.flatnonzero(seen).astype(np.int32)


def _literals(pattern: str) -> Iterator[str]:
    """Runs of characters that every match of a JavaScript regex contains, one after the other."""
    run, i, depth = "", 0, 0
    while i < len(pattern):
        ch, here, literal = pattern[i], i, ""
        if ch == "\\" and i + 1 < len(pattern):
            i += 2
            if not pattern[here + 1].isalnum():
                literal = pattern[here + 1]
            else:  # the hexadecimal digits and names of an escape are no literals
                i += len(re.match(r"[0-9a-fA-F]*|<[^>]*>", pattern[i:])[0]) if pattern[here + 1] in "uxk" else 0
                i += len(re.match(r"[0-9]*", pattern[i:])[0]) if pattern[here + 1].isdigit() else 0
                i += pattern[here + 1] in "c"
                if pattern.startswith("{", i) or pattern[here + 1] in "pP":
                    i += len(re.match(r"(?:\{[^}]*\})?", pattern[i:])[0])
        elif ch == "[":
            i += 2 if pattern.startswith("[]", i) else 3 if pattern.startswith("[^]", i) else 1
            if not pattern[here:i].endswith("]"):
                while i < len(pattern) and pattern[i] != "]":
                    i += 2 if pattern[i] == "\\" else 1
                i += 1
        elif ch in "()":
            depth += 1 if ch == "(" else -1
            i += 1
            # What is in a group may be optional or one of several; so may the group.
            if run:
                yield run
            run = ""
            continue
        else:
            i += 1
            literal = "" if ch in "^$.|*+?" else ch
        found = _QUANTIFIED.match(pattern, i)
        if literal and not depth and not found:
            run += literal
            continue
        if literal and not depth and found[0] == "+":
            run += literal
        if run:
            yield run
        run = ""
        if found:
            i = found.end()
            if pattern.startswith("?", i):
                i += 1
    if run:
        yield run


def _has_choice(pattern: str) -> bool:
    """Whether an alternative stands outside all groups and classes."""
    i, depth, inside = 0, 0, False
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\":
            i += 1
        elif inside:
            inside = ch != "]"
        elif ch == "[":
            inside = not pattern.startswith(("[]", "[^]"), i)
            i += 0 if inside else len("[]") - 1 if pattern.startswith("[]", i) else len("[^]") - 1
        elif ch == "(":
            depth += 1
        elif ch == ")":
            depth -= 1
        elif ch == "|" and depth == 0:
            return True
        i += 1
    return False


def required_grams(query: str, regex: bool = False) -> list[int]:
    """Up to ``MAX_GRAMS`` trigrams that every match contains, spread over the pattern; empty
    where none is certain, so that everything is to be searched."""
    if regex and _has_choice(query):
        return []
    runs = list(_literals(query)) if regex else [query]
    found = sorted({int(c) for run in runs for c in gram_codes([run.encode("utf-8", "surrogatepass")])})
    step = -(-len(found) // MAX_GRAMS) or 1
    return found[::step]
