"""Search patterns: literal or regular-expression match predicates as Columns.

The query is turned into one Java regular expression on the driver, checked
once there, and then evaluated by Spark's built-in ``rlike`` /
``regexp_extract`` inside whole-stage code generation.  A case-sensitive
literal needs no regex at all and uses ``contains`` / ``instr``.
"""

from __future__ import annotations

import re
import string
from dataclasses import dataclass

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F


def quote_literal(text: str) -> str:
    """Java regex that matches ``text`` literally (``\\Q…\\E`` quoting)."""
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


# JavaScript's white space and line terminators, as class members.
_JS_SPACE = "\\t\\n\\x0B\\f\\r \\xA0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
_JS_LINE_END = "\\n\\r\\u2028\\u2029"
#: Escaped letters with a meaning of their own in JavaScript; others stand for themselves.
_JS_ESCAPES = set("bBcdDfknrtuwWx")
_QUANTIFIER = re.compile(r"\{[0-9]+(?:,[0-9]*)?\}")


def _escape(pattern: str, i: int, in_class: bool) -> tuple[str, int]:
    """Java form of the escape at ``pattern[i]`` and the index after it."""
    ch = pattern[i + 1]
    if ch == "s":
        return (_JS_SPACE if in_class else f"[{_JS_SPACE}]"), i + 2
    if ch == "S":
        return f"[^{_JS_SPACE}]", i + 2
    if ch == "v":
        return "\\x0B", i + 2
    if ch == "b" and in_class:
        return "\\x08", i + 2
    if ch == "0" and not pattern[i + 2:i + 3].isdigit():
        return "\\x00", i + 2
    if ch in "ux":
        n = 4 if ch == "u" else 2
        digits = pattern[i + 2:i + 2 + n]
        if len(digits) == n and all(c in string.hexdigits for c in digits):
            return pattern[i:i + 2 + n], i + 2 + n
        return ch, i + 2
    if ch == "k" and not pattern.startswith("<", i + 2):
        return ch, i + 2
    if ch.isalpha() and ch not in _JS_ESCAPES:
        return ch, i + 2
    return pattern[i:i + 2], i + 2


def _class(pattern: str, i: int) -> tuple[str, int]:
    """Java form of the character class at ``pattern[i]`` and the index after it."""
    if pattern.startswith("[^]", i):
        return "[\\s\\S]", i + 3
    if pattern.startswith("[]", i):
        return "(?!)", i + 2
    out = ["["]
    i += 1
    if pattern.startswith("^", i):
        out.append("^")
        i += 1
    while i < len(pattern) and pattern[i] != "]":
        if pattern[i] == "\\" and i + 1 < len(pattern):
            part, i = _escape(pattern, i, True)
        else:
            # Nested classes, intersections and a later ^ are Java's only.
            part = "\\" + pattern[i] if pattern[i] in "[&^" else pattern[i]
            i += 1
        out.append(part)
    return "".join(out) + pattern[i:i + 1], i + 1


def translate_js_regex(pattern: str) -> str:
    """Rewrite the parts of a JavaScript regex whose Java meaning differs.

    Without flags, ``$`` matches only at the very end of the input, ``.`` stops
    at JavaScript's four line terminators, ``\\s`` is its wider white-space class,
    a ``{`` that begins no quantifier and a ``[`` inside a class are literal,
    ``[]`` matches nothing and ``[^]`` anything, and an escaped letter without a
    meaning stands for itself.
    """
    out: list[str] = []
    i = 0
    while i < len(pattern):
        ch = pattern[i]
        if ch == "\\" and i + 1 < len(pattern):
            part, i = _escape(pattern, i, False)
        elif ch == "[":
            part, i = _class(pattern, i)
        elif ch == "{" and not _QUANTIFIER.match(pattern, i):
            part, i = "\\{", i + 1
        else:
            part, i = {"$": "\\z", ".": f"[^{_JS_LINE_END}]"}.get(ch, ch), i + 1
        out.append(part)
    return "".join(out)


def validate_regex(spark: SparkSession | None, pattern: str) -> None:
    """Raise ``ValueError`` before any job starts if Java cannot compile it."""
    if spark is None:
        return
    try:
        jvm = spark.sparkContext._jvm
    except Exception:  # Spark Connect: no JVM handle, compile in a tiny job
        jvm = None
    try:
        if jvm is not None:
            jvm.java.util.regex.Pattern.compile(pattern)
        else:
            spark.range(1).select(F.lit("").rlike(pattern)).collect()
    except Exception as exc:  # noqa: BLE001 - report any compile error uniformly
        raise ValueError(f"Invalid regular expression: {pattern!r}") from exc


@dataclass(frozen=True)
class Matcher:
    """A compiled search predicate.

    ``test(c)`` is true when column ``c`` contains a match, ``first(c)`` is the
    text of the first (leftmost) match.  Null input never matches.
    """

    query: str
    java_pattern: str | None  # None: case-sensitive literal, handled without regex

    def test(self, c: Column) -> Column:
        if self.java_pattern is None:
            return c.contains(F.lit(self.query))
        return c.rlike(self.java_pattern)

    def first(self, c: Column) -> Column:
        if self.java_pattern is None:
            return F.lit(self.query)
        return F.regexp_extract(c, self.java_pattern, 0)


def build_matcher(query: str, regex: bool = False, case_sensitive: bool = False,
                  spark: SparkSession | None = None) -> Matcher:
    """Matcher for a keyword query.

    Literal queries match the text as typed; ``case_sensitive=False`` folds
    case with Unicode rules (``(?iu)``; plain ``(?i)`` is ASCII-only in Java).
    """
    if query is None:
        raise ValueError("query must be a string")
    if not regex and case_sensitive:
        return Matcher(query, None)
    body = translate_js_regex(query) if regex else quote_literal(query)
    pattern = body if case_sensitive else "(?iu)" + body
    if regex:
        validate_regex(spark, pattern)
    return Matcher(query, pattern)
