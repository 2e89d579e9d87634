"""Personal data by weak supervision, in built-in column functions.

Patterns propose candidates; five labelers (format, gazetteer, cue words before,
words that speak against, borders) vote 1, -1 or 0 on each.  The votes are
counted by kind and pattern; expectation-maximisation over these counts (a
two-class Dawid-Skene model per kind) estimates how reliable each labeler is,
and its soft labels train the final classifier, a naive Bayes over votes and
span features.  Counts and weights are bounded by the number of kinds, votes and
feature values, so they pass through the driver; candidates do not.

Base spans (email, ip, card, phone by their patterns) always stay; a match that
fails its check (octets, Luhn, number of digits) teaches but is never a span.
Others stay when the classifier accepts them and they touch no base span and no
earlier one.

Defined results: a null text is empty and has no spans; spans are counted in code
points; equal rows give equal rows; an empty table gives an empty result; without
candidates nothing is learned; other columns pass through, unless a name is one
of the results'.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from convsift.llm.common import documents, materialise

#: Order of kinds in the output.
KINDS = ["email", "ip", "card", "phone", "secret", "ssn", "name"]
# Patterns take the same matches as the plain forms, in linear time: runs are
# entered at their start only (or where the last match ended) and never given back.
_LOCAL = "[A-Za-z0-9._%+-]"
BASE = {
    "email": rf"(?:\G|(?<!{_LOCAL})){_LOCAL}++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9]++(?:[\x20-][0-9]++)*+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
MORE = {
    "email": r"(?i)(?<![\p{L}0-9._%+-])[a-z0-9._%+-]{1,64}+(?: ?[(\[{]at[)\]}] ?[a-z0-9-]{1,63}"
             r"(?:(?: ?[(\[{]dot[)\]}] ?| dot |\.)[a-z0-9-]{1,63}){1,4}| at [a-z0-9-]{1,63}(?: dot [a-z0-9-]{1,63}){1,4})",
    "phone": r"(?<![0-9+.-])(?:\([0-9]{3}\) ?|[0-9]{3}[.\x20-])[0-9]{3}[.\x20-][0-9]{4}(?![0-9])",
    "secret": r"(?<![A-Za-z0-9])(?:(?:AKIA|ASIA)[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,64})(?![A-Za-z0-9])",
    "ssn": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "name": r"(?<![\p{L}])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Señor|Señora|Monsieur|Madame)\.? \p{Lu}\p{Ll}{1,30}(?: \p{Lu}\p{Ll}{1,30})?",
}
#: A cheap test that a text can have a match at all.
_MAYBE = {("email", True): "@", ("phone", True): r"\+[0-9]", ("ip", True): r"[0-9]\.[0-9]",
          ("card", True): r"[0-9](?:[\x20-]?[0-9]){12}",
          ("email", False): r"(?i)[(\[{]at[)\]}]| at [a-z0-9-]{1,63} dot ", ("phone", False): r"[0-9]{3}[.\x20-][0-9]{4}",
          ("secret", False): r"AKIA|ASIA|gh[pousr]_|sk-", ("ssn", False): r"[0-9]{3}-[0-9]{2}-",
          ("name", False): r"Mr|Ms|Dr|Prof|Herr|Frau|Señor|Monsieur|Madame"}
_CUES = {"email": "e-?mail|contact|write|kontakt|correo|courriel", "ip": r"\bip\b|host|server|address|from|adresse",
         "card": "card|visa|credit|karte|carte|tarjeta|pay", "phone": "phone|call|tel|mobile|fax|ruf",
         "secret": "key|secret|token|access|credential", "ssn": r"ssn|social|security", "name": "name|dear|by|from|von|de"}
_AGAINST = {"email": "example|noreply", "ip": r"version|release|\bv\.?$|section", "card": r"isbn|order|serial|\bid\b",
            "phone": r"isbn|order|part|model", "secret": "example|dummy|placeholder", "ssn": "isbn|part|model",
            "name": "street|avenue|strasse"}
_GAZETTEER = {
    "email": r"(?i)(?:\.|dot[)\]}]? ?)(?:com|org|net|edu|gov|io|de|fr|es|uk|eu|info|co)$",
    "ip": r"^(?!0|255|2[4-5][0-9])",
    "card": r"^(?:4|5[1-5]|2[2-7]|3[47]|6(?:011|5))",
    "phone": r"^\+(?:1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58])|^\(?[2-9][0-9]{2}",
    "secret": r"^(?:AKIA|ASIA|gh|sk)", "ssn": r"^(?!000|666|9)[0-9]{3}-(?!00)[0-9]{2}-(?!0000)",
    "name": r"(?:Smith|Jones|Brown|Miller|Davis|Garcia|Martin|Schmidt|Weber|Meyer|Dupont|Bernard|Lopez|Perez)$",
}
_OCTET = "0*(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_BLOCK = 512
LABELERS = 5


# ------------------------------------------------------------------ candidates

def _with_matches(df: DataFrame, text: str, pattern: str, maybe: str, out: str) -> DataFrame:
    """``df`` with an array of (gap before, body, character after) of all matches.

    The parts between matches are a column of their own: inside the function over
    the matches, the text would be split again for every match.
    """
    t = F.col(text)
    none = F.array().cast("array<string>")
    df = df.withColumn("_body", F.when(t.rlike(maybe), F.regexp_extract_all(t, F.lit(pattern), F.lit(0))).otherwise(none))
    df = df.withColumn("_part", F.when(F.size("_body") > 0, F.split(t, pattern, -1)).otherwise(none))
    z = F.transform("_body", lambda b, i: F.struct(F.get("_part", i).alias("gap"), b.alias("body"),
                                                   F.substring(F.get("_part", i + 1), 1, 1).alias("after")))
    return df.withColumn(out, z).drop("_body", "_part")


def _placed(z: Column) -> Column:
    """Matches with their starts: a running sum, kept per block so that growing
    the array stays cheap where one text has very many matches."""
    kind = "struct<start: int, body: string, before: string, after: string>"
    none, nothing = F.array().cast(f"array<{kind}>"), F.array().cast(f"array<array<{kind}>>")

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        one = F.struct(start.alias("start"), x["body"].alias("body"),
                       F.lower(F.substring(x["gap"], -40, 40)).alias("before"), x["after"].alias("after"))
        return F.struct((start + F.length(x["body"])).alias("at"), F.concat(acc["out"], F.array(one)).alias("out"))

    def block(acc, b):
        got = F.aggregate(F.slice(z, b * _BLOCK + 1, F.lit(_BLOCK)), F.struct(acc["at"].alias("at"), none.alias("out")), step)
        return F.struct(got["at"].alias("at"), F.concat(acc["out"], F.array(got["out"])).alias("out"))

    blocks = F.sequence(F.lit(0), F.floor((F.size(z) - 1) / _BLOCK).cast("int"))
    start = F.struct(F.lit(0).alias("at"), nothing.alias("out"))
    return F.when(F.size(z) > 0, F.aggregate(blocks, start, block, lambda acc: F.flatten(acc["out"]))).otherwise(none)


def _luhn(digits: Column) -> Column:
    def one(i):
        d = F.substring(digits, -i, F.lit(1)).cast("int")
        return F.when(i % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(1), F.length(digits)), one), F.lit(0), lambda a, x: a + x) % 10 == 0


def _valid(kind: str, body: Column) -> Column:
    digits = F.regexp_replace(body, "[^0-9]", "")
    if kind == "ip":
        return body.rlike(rf"^{_OCTET}(?:\.{_OCTET}){{3}}$")
    if kind == "card":
        return F.when(F.length(digits).between(14, 19), _luhn(digits)).otherwise(False)
    if kind == "phone":
        return F.length(digits).between(10, 15)
    return F.lit(True)


def _candidates(kind: str, base: bool, z: Column) -> Column:
    """Candidates with their votes and features, from placed matches."""
    def one(x):
        body, before, after = x["body"], x["before"], x["after"]
        valid = _valid(kind, body)
        last = F.substring(before, -1, 1)
        glued = last.rlike(r"[\p{L}0-9_]$") | after.rlike(r"^[\p{L}0-9_]")
        votes = F.array(F.when(valid, 1).otherwise(-1),
                        F.when(body.rlike(_GAZETTEER[kind]), 1).otherwise(-1),
                        F.when(before.rlike(_CUES[kind]), 1).otherwise(0),
                        F.when(before.rlike(_AGAINST[kind]), -1).otherwise(0),
                        F.when(glued, -1).otherwise(1))
        n = F.length(body)
        digits = F.length(F.regexp_replace(body, "[^0-9]", ""))
        features = F.array(F.concat(F.lit("length"), F.least(F.floor(n / 4), F.lit(12)).cast("string")),
                           F.concat(F.lit("digits"), F.floor(4 * digits / F.greatest(n, F.lit(1))).cast("string")),
                           F.concat(F.lit("last"), F.when(last == "", "-").when(last.rlike(r"\s"), "s")
                                    .when(last.rlike(r"[\p{L}0-9]"), "w").otherwise("p")),
                           F.concat(F.lit("after"), F.when(after == "", "-").when(after.rlike(r"\s"), "s")
                                    .when(after.rlike(r"[\p{L}0-9]"), "w").otherwise("p")))
        return F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"),
                        (x["start"] + n).alias("end"), (valid & F.lit(base)).alias("base"),
                        votes.alias("votes"), features.alias("features"))

    found = F.transform(z, one)
    if kind == "card":  # plain numbers are no candidates
        found = F.transform(F.filter(z, lambda x: F.length(F.regexp_replace(x["body"], "[^0-9]", "")).between(13, 19)), one)
    return found


def find_candidates(docs: DataFrame) -> DataFrame:
    """``docs`` with ``candidates``: all kinds in one array, by start and kind."""
    out = docs.withColumn("_t", F.coalesce("text", F.lit("")))
    columns = []
    for base, patterns in ((True, BASE), (False, MORE)):
        for kind, pattern in patterns.items():
            m, c = f"_m{kind}{base}", f"_c{kind}{base}"
            out = _with_matches(out, "_t", pattern, _MAYBE[kind, base], m)
            out = out.withColumn(c, _candidates(kind, base, _placed(F.col(m)))).drop(m)
            columns.append(c)
    return out.withColumn("candidates", F.array_sort(F.concat(*columns))).drop("_t", *columns)


# ------------------------------------------------------------------ learning

def fit_votes(counts: dict[tuple, int], steps: int = 60) -> dict[tuple, float]:
    """Probability that a vote pattern is personal data, by EM over the patterns of one kind."""
    patterns = sorted(counts)
    votes = np.array(patterns) + 1  # 0: against, 1: silent, 2: for
    n = np.array([counts[p] for p in patterns], float)
    post = 1 / (1 + np.exp(-(votes - 1).sum(axis=1).astype(float)))
    for _ in range(steps):
        prior = min(max((n @ post + 1) / (n.sum() + 2), 1e-3), 1 - 1e-3)
        score = np.full(len(patterns), np.log(prior / (1 - prior)))
        for j in range(votes.shape[1]):
            hit = votes[:, j, None] == np.arange(3)
            # One more vote in favour of an honest labeler keeps the classes from trading places.
            yes = (n * post) @ hit + np.array([0.5, 1.0, 2.0])
            no = (n * (1 - post)) @ hit + np.array([2.0, 1.0, 0.5])
            score += np.log((yes / yes.sum()) / (no / no.sum()))[votes[:, j]]
        new = 1 / (1 + np.exp(-np.clip(score, -30, 30)))
        if np.abs(new - post).max() < 1e-9:
            break
        post = new
    return dict(zip(patterns, post.tolist()))


def fit(candidates: DataFrame) -> dict[str, float]:
    """Weights (log odds) of the final classifier by ``kind|feature``, from all candidates."""
    c = candidates.select(F.explode("candidates").alias("c")).select("c.kind", "c.votes", "c.features")
    told = F.transform("votes", lambda v, i: F.concat(F.lit("vote"), i.cast("string"), F.lit("="), v.cast("string")))
    rows = c.select("kind", "votes", F.explode(F.concat(F.array(F.lit("all")), told, "features")).alias("f"))
    # At most kinds x vote patterns x feature values rows.
    got = rows.groupBy("kind", "votes", "f").agg(F.count(F.lit(1)).alias("n")).collect()
    weights: dict[str, float] = {}
    for kind in sorted({r["kind"] for r in got}):
        own = [r for r in got if r["kind"] == kind]
        counts = {tuple(r["votes"]): r["n"] for r in own if r["f"] == "all"}
        post = fit_votes(counts)
        yes: dict[str, float] = {}
        no: dict[str, float] = {}
        for r in sorted(own, key=lambda r: (r["f"], r["votes"])):
            p = post[tuple(r["votes"])]
            yes[r["f"]] = yes.get(r["f"], 0.0) + r["n"] * p
            no[r["f"]] = no.get(r["f"], 0.0) + r["n"] * (1 - p)
        for f in yes:
            if f == "all":
                weights[f"{kind}|all"] = float(np.log((yes[f] + 1) / (no[f] + 1)))
            else:
                weights[f"{kind}|{f}"] = float(np.log((yes[f] + 0.5) / (yes["all"] + 1)) - np.log((no[f] + 0.5) / (no["all"] + 1)))
    return weights


def label(found: DataFrame, weights: dict[str, float]) -> DataFrame:
    """``found`` plus base and all spans (arrays of start, kind, end), by start and kind."""
    # A map of bounded size, as two literal arrays.
    names = sorted(weights) or [""]
    table = F.map_from_arrays(F.array(*(F.lit(k) for k in names)), F.array(*(F.lit(weights.get(k, 0.0)) for k in names)))

    def score(c):
        told = F.transform(c["votes"], lambda v, i: F.concat(F.lit("vote"), i.cast("string"), F.lit("="), v.cast("string")))
        keys = F.concat(F.array(F.lit("all")), told, c["features"])
        return F.aggregate(keys, F.lit(0.0), lambda a, f: a + F.coalesce(
            F.element_at(table, F.concat(c["kind"].cast("string"), F.lit("|"), f)), F.lit(0.0)))

    base = F.filter("candidates", lambda c: c["base"])
    more = F.filter("candidates", lambda c: ~c["base"] & (F.get(c["votes"], F.lit(0)) == 1) & (score(c) > 0) & ~F.exists(
        "_base", lambda b: (b["start"] < c["end"]) & (c["start"] < b["end"])))

    def first(acc, c):
        free = c["start"] >= acc["end"]
        return F.struct(F.when(free, c["end"]).otherwise(acc["end"]).alias("end"),
                        F.when(free, F.concat(acc["out"], F.array(_span(c)))).otherwise(acc["out"]).alias("out"))

    def _span(c):
        return F.struct(c["start"].alias("start"), c["kind"].alias("kind"), c["end"].alias("end"))

    none = F.array().cast("array<struct<start: int, kind: int, end: int>>")
    found = found.withColumn("_base", base).withColumn("_more", more)
    added = F.aggregate("_more", F.struct(F.lit(0).alias("end"), none.alias("out")), first, lambda a: a["out"])
    found = found.withColumn("base", F.transform("_base", _span))
    return found.withColumn("spans", F.array_sort(F.concat("base", added))).drop("_base", "_more", "candidates")


def to_text(spans: Column) -> Column:
    names = F.array(*(F.lit(k) for k in KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat(
        F.get(names, s["kind"]), F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string"))), ",")


def find_personal_data(docs: DataFrame) -> DataFrame:
    """``docs`` without text, with base and all spans."""
    own = [c for c in docs.columns if c not in ("base", "spans", "candidates")]
    found = find_candidates(docs.select(*own)).drop("text")
    found = materialise(found, "pii")
    return label(found, fit(found))


def redact(text: Column, spans: Column) -> Column:
    """``text`` with every span replaced by its kind in brackets."""
    names = F.array(*(F.lit(k.upper()) for k in KINDS))

    def step(acc, s):
        free = s["start"] >= acc["at"]
        piece = F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]),
                         F.lit("["), F.get(names, s["kind"]), F.lit("]"))
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), F.when(free, piece).otherwise(acc["out"]).alias("out"))

    return F.aggregate(spans, F.struct(F.lit(0).alias("at"), F.lit("").alias("out")), step,
                       lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = find_personal_data(documents(spark, sf_dir).select("doc_id", "text"))

    def count(kind):
        k = KINDS.index(kind)
        return F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long").alias(f"n_{kind}")

    return out.select("doc_id", *(count(k) for k in KINDS[:4]), F.sha2(to_text(F.col("base")), 256).alias("base_sha256"),
                      to_text(F.col("spans")).alias("spans"))


ORACLE_SQL = None
