"""Quality rules with host-level verdicts.

Every text gets rule counts.  A document fails the base rules, or one of four more:
symbols among its words, repeated lines, words of unusual length, and words repeated in
a row.  Failing documents are summed per host, the host's rate is shrunk towards the
corpus with a beta prior fitted to all hosts (empirical Bayes, method of moments; the
prior weighs at most as much as a host of mean size, so it never drowns the hosts), and
the host's rate decides what the document's own failures mean: hosts above ``max_rate``
lose all their documents, hosts up to ``TRUSTED_RATE`` keep documents that fail one rule
more, the others only those that fail none.

Defined results: a null or empty text has no words and fails the base rule; a
null host is nobody's host, so its documents are judged alone; repeated rows
are counted and returned as often as they occur; an empty table gives an empty
result; other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convsift.llm.common import (Words, documents, materialise, ship_package, skew_lookup,
                                 text_groups, tidy, windows)

WINDOW = 8
MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
#: A host is condemned when its shrunk failure rate is above this, and trusted up to the other.
MAX_HOST_RATE = 0.8
TRUSTED_RATE = 0.02
#: Rules beside the base ones: more than a symbol for so many words; more repeated lines, words
#: equal to the one before, in a hundred; mean characters of a word below or above.
SYMBOL_WORDS = 10
MAX_DUP_LINES_PERCENT = 40
MAX_STUTTER_PERCENT = 20
MIN_MEAN_WORD, MAX_MEAN_WORD = 3, 12

_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_stutters"]
_SYMBOL = np.zeros(256, np.int64)
_SYMBOL[list(b"#*$%&|<>")] = 1


def _lines(text: bytes) -> tuple[int, int]:
    """Lines with a word that are equal to an earlier one, and all lines with a word."""
    seen, n = set(), 0
    for line in text.split(b"\n"):
        if line.strip(b" \t\n\x0b\x0c\r"):
            n += 1
            seen.add(line)
    return n - len(seen), n


def _stutters(w: Words, h: np.ndarray) -> np.ndarray:
    """Per text, the words that are equal to the one before."""
    same = (h[1:] == h[:-1]) & (w.owner[1:] == w.owner[:-1])
    return np.bincount(w.owner[1:][same], minlength=w.n_docs).astype(np.int64)


def _repeated_words(w: Words, h: np.ndarray) -> np.ndarray:
    """Per text, the words that lie in a window of eight which the text has twice."""
    n = len(h) - WINDOW + 1
    out = np.zeros(w.n_docs, np.int64)
    if n <= 0:
        return out
    inside = np.flatnonzero(w.owner[:n] == w.owner[WINDOW - 1:])
    key = windows(h, WINDOW)[inside]
    owner = w.owner[inside]
    order = np.lexsort((key, owner))
    same = (key[order][1:] == key[order][:-1]) & (owner[order][1:] == owner[order][:-1])
    twice = np.zeros(len(inside), bool)
    twice[order[1:]] |= same
    twice[order[:-1]] |= same
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, inside[twice], 1)
    np.add.at(cover, inside[twice] + WINDOW, -1)
    return np.bincount(w.owner[np.cumsum(cover[:-1]) > 0], minlength=w.n_docs).astype(np.int64)


def rule_counts(texts: list[bytes]) -> np.ndarray:
    """Rows of ``_COUNTS``."""
    out = np.zeros((len(texts), len(_COUNTS)), np.int64)
    w = Words(texts, lower=False)
    h = w.hashes()
    out[:, 0] = np.diff(w.first)
    begins = w.solid & ((w.bytes & 0xC0) != 0x80)
    for column, flags in ((1, begins.astype(np.int64)), (2, _SYMBOL[w.bytes])):
        out[:, column] = np.add.reduceat(flags, w.doc_start[:-1])
    out[:, [3, 5]] = [_lines(t) for t in texts]
    out[:, 4] = _repeated_words(w, h)
    out[:, 6] = _stutters(w, h)
    return out


def document_rules(docs: DataFrame, host: Column) -> DataFrame:
    """doc_id, host, the counts, base_failed and n_failed (of the other rules) of every row of ``docs``."""
    import pyarrow as pa

    ship_package(docs.sparkSession)

    def count(batches):
        for b in batches:
            for lo, hi, texts in text_groups(b.column("text")):
                got = rule_counts(texts)
                own = (b.column(c).slice(lo, hi - lo) for c in ("doc_id", "host"))
                yield pa.RecordBatch.from_arrays([*own, *(pa.array(got[:, k]) for k in range(len(_COUNTS)))],
                                                 names=["doc_id", "host", *_COUNTS])

    rows = docs.select("doc_id", host.cast("string").alias("host"), "text")
    schema = "doc_id bigint, host string, " + ", ".join(f"{c} bigint" for c in _COUNTS)
    out = rows.select(F.col("doc_id").cast("bigint").alias("doc_id"), "host", "text").mapInArrow(tidy(count), schema)
    failed = ((F.col("n_words") < MIN_WORDS)
              | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words")))
    c = {name: F.col(name) for name in _COUNTS}
    rules = [SYMBOL_WORDS * c["n_symbols"] > c["n_words"],
             100 * c["n_dup_lines"] > MAX_DUP_LINES_PERCENT * c["n_lines"],
             (c["word_chars"] < MIN_MEAN_WORD * c["n_words"]) | (c["word_chars"] > MAX_MEAN_WORD * c["n_words"]),
             100 * c["n_stutters"] > MAX_STUTTER_PERCENT * c["n_words"]]
    n_failed = sum((r.cast("long") for r in rules[1:]), rules[0].cast("long"))
    return out.withColumn("base_failed", failed).withColumn("n_failed", n_failed)


def host_rates(rules: DataFrame) -> DataFrame:
    """host, docs, failures and the failure rate shrunk by the fitted beta prior."""
    failed = F.col("base_failed") | (F.col("n_failed") > 0)
    hosts = rules.where("host IS NOT NULL").groupBy("host").agg(
        F.count(F.lit(1)).alias("docs"), F.sum(failed.cast("long")).alias("failures"))
    hosts = materialise(hosts, "hosts")
    # One row: sums over hosts give the mean and the spread of the rates beyond chance.
    s = hosts.agg(F.sum("docs").alias("n"), F.sum("failures").alias("f"), F.count(F.lit(1)).alias("k"),
                  F.sum(F.col("failures") * F.col("failures") / F.col("docs")).alias("q")).first()
    strength, mean = 1.0, 0.0
    if s["n"]:
        mean = s["f"] / s["n"]
        chance = mean * (1 - mean)
        between = s["q"] / s["n"] - mean * mean - chance * s["k"] / s["n"]
        most = max(1.0, s["n"] / s["k"])
        strength = min(most, max(1.0, chance / between - 1)) if between > 1e-12 else most
    return hosts.withColumn("shrunk_rate", (F.col("failures") + F.lit(mean * strength))
                            / (F.col("docs") + F.lit(strength)))


def quality_rules(docs: DataFrame, host: Column | None = None, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """Counts, base_failed, n_failed, the host's shrunk rate and kept for every document."""
    rules = materialise(document_rules(docs, F.col("source") if host is None else host), "rules")
    out = skew_lookup(rules, host_rates(rules), "host", ["shrunk_rate"], "docs")
    # Without a host a document is judged by its own failures.
    condemned = F.coalesce(F.col("shrunk_rate") > max_rate, F.lit(False))
    forgiven = F.coalesce(F.col("shrunk_rate") <= TRUSTED_RATE, F.lit(False)).cast("long")
    return out.withColumn("kept", ~F.col("base_failed") & ~condemned & (F.col("n_failed") <= forgiven))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(documents(spark, sf_dir)).select("doc_id", *_COUNTS, "base_failed", "n_failed", "kept")


ORACLE_SQL = r"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
lines AS (
  SELECT rid, line, count(*) AS c
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS line FROM base)
  WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY ALL),
dup AS (SELECT rid, sum(c - 1)::BIGINT AS n, sum(c)::BIGINT AS n_lines FROM lines GROUP BY rid),
win AS (
  SELECT rid, i, array_to_string(w[i:i + 7], ' ') AS g
  FROM (SELECT rid, w, unnest(range(1, len(w) - 6)) AS i FROM base WHERE len(w) >= 8)),
twice AS (SELECT rid, i FROM win QUALIFY count(*) OVER (PARTITION BY rid, g) > 1),
rep AS (
  SELECT rid, count(DISTINCT i + j) AS n FROM twice, (SELECT unnest(range(0, 8)) AS j) GROUP BY rid),
counts AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars,
         (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
         coalesce(dup.n, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words,
         coalesce(n_lines, 0)::BIGINT AS n_lines,
         len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1]))::BIGINT AS n_stutters
  FROM base LEFT JOIN dup USING (rid) LEFT JOIN rep USING (rid)),
rules AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
         (10 * n_symbols > n_words)::BIGINT + (100 * n_dup_lines > 40 * n_lines)::BIGINT
         + (word_chars < 3 * n_words OR word_chars > 12 * n_words)::BIGINT
         + (100 * n_stutters > 20 * n_words)::BIGINT AS n_failed FROM counts),
hosts AS (
  SELECT source, count(*) AS docs, sum((base_failed OR n_failed > 0)::BIGINT) AS failures
  FROM rules WHERE source IS NOT NULL GROUP BY source),
fit AS (
  SELECT sum(failures) / sum(docs) AS m, count(*) / sum(docs) AS kn,
         sum(failures * failures / docs) / sum(docs) AS q FROM hosts),
prior AS (
  SELECT m, CASE WHEN q - m * m - m * (1 - m) * kn > 1e-12
                 THEN least(greatest(1.0, 1 / kn), greatest(1.0, m * (1 - m) / (q - m * m - m * (1 - m) * kn) - 1))
                 ELSE greatest(1.0, 1 / kn) END AS s FROM fit),
rates AS (SELECT source, (failures + m * s) / (docs + s) AS shrunk FROM hosts, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_stutters, base_failed, n_failed,
       NOT base_failed AND NOT coalesce(shrunk > 0.8, false) AND n_failed <= coalesce(shrunk <= 0.02, false)::BIGINT AS kept
FROM rules LEFT JOIN rates USING (source)
"""
