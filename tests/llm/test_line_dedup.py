import random
from collections import Counter

from xxhash import xxh3_64_intdigest

from convsift.llm import line_dedup
from convsift.llm.line_dedup import cuts, dedup_lines


def runs(rows, suffices):
    """Per row the lines (numbers) of its runs of lines that an earlier place has too, by comparing
    all pairs of lines; runs are as long as they get, without empty lines at their ends."""
    order = sorted(range(len(rows)), key=lambda k: (rows[k][0] is None, rows[k][0] or 0))
    out, earlier = [set() for _ in rows], []
    for k in order:
        mine = (rows[k][1] or "").split("\n")
        earlier.append(mine)
        for other in earlier:
            for i in range(len(mine)):
                for j in range(len(other) if other is not mine else i):
                    if i and j and mine[i - 1] == other[j - 1]:
                        continue
                    n = 0
                    while i + n < len(mine) and j + n < len(other) and mine[i + n] == other[j + n]:
                        n += 1
                    lines = list(range(i, i + n))
                    while lines and not mine[lines[0]].split():
                        lines.pop(0)
                    while lines and not mine[lines[-1]].split():
                        lines.pop()
                    words = [len(mine[x].split()) for x in lines]
                    if lines and suffices(words):
                        out[k] |= set(lines)
    return out


def comparable(words):
    return max(words) >= line_dedup.LONG_LINE or sum(n > 0 for n in words) > 1 and sum(words) >= line_dedup.MIN_WORDS


def removed(rows, out):
    """Per row the numbers of the lines that went, which must be a subsequence's rest."""
    found = []
    for (_, t), left in zip(rows, out):
        lines, kept, gone = (t or "").split("\n"), (left or "").split("\n"), set()
        if t is not None and left == "" and t != "":
            kept = []
        k = 0
        for i, x in enumerate(lines):
            if k < len(kept) and kept[k] == x:
                k += 1
            else:
                gone.add(i)
        assert k == len(kept)
        found.append(gone)
    return found


def got(df):
    return sorted(((r.doc_id, r.text) for r in df.collect()), key=str)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]

    def line(k):
        return " ".join(rng.choices(vocab, k=k))

    passages = ["\n".join(line(rng.randint(6, 15)) for _ in range(8)) for _ in range(4)] + [line(60)]
    rows = []
    for i in range(n):
        parts = [line(rng.randint(1, 12)) for _ in range(rng.randint(1, 9))]
        if i % 2:
            parts.insert(rng.randint(0, len(parts)), rng.choice(passages))
        rows.append((i, "\n".join(parts)))
    return rows, passages


def texts_of(df, rows):
    out = {}
    for r in df.collect():
        out.setdefault((r.doc_id, ), []).append(r.text)
    return [out[(d,)][0] for d, _ in rows]


def test_against_all_pairs_of_lines(spark, make_docs, clashing):
    rows, _ = corpus()
    rows += [(100, None), (101, ""), (102, "\n\n"), (103, "short"), (104, rows[1][1]), (105, "x y z\r\n" * 300)]
    out = dedup_lines(clashing(make_docs(rows)))
    assert set(clashing(make_docs(rows)).columns) <= set(out.columns)
    gone = removed(rows, texts_of(out, rows))
    may, must = runs(rows, comparable), runs(rows, lambda words: sum(words) >= 50 and comparable(words))
    # Nothing goes that no earlier place has; hardly anything of a long passage stays.
    assert all(g <= m for g, m in zip(gone, may))
    # A text of equal lines loses most of them, but not all that repeat.
    assert len(gone.pop()) > 150 and len(must.pop()) == 299
    assert sum(len(g & m) for g, m in zip(gone, must)) >= 0.95 * sum(map(len, must)) > 100


def test_every_text_keeps_the_first_place_of_a_line(spark, make_docs):
    rows, _ = corpus(7, 80)
    out = texts_of(dedup_lines(make_docs(rows)), rows)
    before = {x for _, t in rows for x in t.split("\n")}
    assert {x for t in out for x in t.split("\n")} >= before - {""}


def test_repeated_rows_and_counts(spark, make_docs):
    rows, passages = corpus(8, 20)
    text = "own first line\n" + passages[0] + "\nown last line\n" + passages[1]
    found = dedup_lines(make_docs(rows + [(900, text)] * 3)).where("doc_id = 900").collect()
    assert [(r.text, r.removed_chunks) for r in found] == [("own first line\nown last line", 2)] * 3


def test_passages_go_and_other_lines_stay(spark, make_docs):
    rows, passages = corpus(2, 200)
    out = dict(got(dedup_lines(make_docs(rows))))
    long_line = passages[-1]
    assert sum(long_line in t for t in out.values()) == 1
    for p in passages[:-1]:
        lines = p.split("\n")
        had = [d for d, t in rows if p in t][1:]
        left = sum(x in out[d].split("\n") for d in had for x in lines)
        assert left < 0.25 * len(lines) * len(had)
    for d, t in rows:
        own = [x for x in t.split("\n") if not any(x in p for p in passages)]
        if d % 2 == 0:
            assert out[d] == t
        assert sum(x in out[d].split("\n") for x in own) >= len(own) - 3


def test_cuts_survive_shifts():
    rng = random.Random(4)
    lines = [" ".join(f"w{rng.random()}" for _ in range(rng.randint(1, 12))).encode() for _ in range(200)]

    def places(lines, level):
        return cuts([xxh3_64_intdigest(x) for x in lines], [len(x.split()) for x in lines], level)

    for level in range(len(line_dedup.LEVELS)):
        a, b = places(lines, level), [e - 3 for e in places([b"x", b"y y", b"z", *lines], level)]
        assert len(set(a) & set(b)) > 0.9 * len(a)


def test_chunks_come_from_cuts(monkeypatch):
    """Without cuts inside a text only whole texts and long lines are chunks."""
    rng = random.Random(5)
    text = "\n".join(" ".join(f"w{rng.random()}" for _ in range(8)) for _ in range(40)).encode()
    assert len(list(line_dedup.chunks(text))) > 20
    monkeypatch.setattr(line_dedup, "MAX_CUT", 0)
    monkeypatch.setattr(line_dedup, "MAX_LINES", 1000)
    assert [(a, b) for a, b, _ in line_dedup.chunks(text)] == [(0, 40)]


def test_without_cuts_passages_stay(spark, make_docs, monkeypatch):
    rows, _ = corpus(6, 40)
    must = runs(rows, lambda words: sum(words) >= 50 and comparable(words))

    def missed():
        gone = removed(rows, texts_of(dedup_lines(make_docs(rows)), rows))
        return sum(len(m - g) for g, m in zip(gone, must))

    few = missed()
    real = line_dedup._compared
    monkeypatch.setattr(line_dedup, "_compared", lambda docs: real(docs).where("pos = 0"))
    assert few < 0.05 * sum(map(len, must)) and missed() > 0.5 * sum(map(len, must))


def test_unlike_bytes_under_one_hash(spark, make_docs, monkeypatch):
    from pyspark.sql import functions as F

    rows, _ = corpus(3, 40)
    real = line_dedup._compared
    monkeypatch.setattr(line_dedup, "_compared", lambda docs: real(docs).withColumn("chash", F.pmod("chash", F.lit(2))))
    gone = removed(rows, texts_of(dedup_lines(make_docs(rows)), rows))
    may = runs(rows, comparable)
    assert all(g <= m for g, m in zip(gone, may)) and sum(map(len, gone)) > 50


def test_null_id_is_last_and_empty_table(spark, make_docs):
    text = "\n".join(" ".join(f"a{i}{j}" for j in range(9)) for i in range(9))
    out = got(dedup_lines(make_docs([(None, text), (5, text)])))
    assert out[0] == (5, text) and out[1][1] == ""
    assert got(dedup_lines(make_docs([]))) == []


def test_recall_on_passages_of_any_line_length(spark, make_docs):
    # Stated recall: 0.9 of the lines of repeated passages of 52 words, for every length of their lines.
    rng = random.Random(9)
    for own in (3, 30):
        def line(k):
            return " ".join(f"w{rng.randrange(10 ** 6)}" for _ in range(k))

        rows, widths = [], []
        for width in [*range(1, 20), 30, 60]:
            for _ in range(12):
                passage = [line(width) for _ in range(-(-52 // width))]
                if width % 3 == 0 and len(passage) > 2:
                    passage.insert(2, "")
                for _ in range(3):
                    before, after = ([line(rng.randint(1, own)) for _ in range(rng.randint(1, 5))] for _ in range(2))
                    widths.append((width, len(before), len(before) + len(passage)))
                    rows.append((len(rows), "\n".join(before + passage + after)))
        gone = removed(rows, texts_of(dedup_lines(make_docs(rows)), rows))
        found, all_lines = Counter(), Counter()
        for k, (g, (width, a, b)) in enumerate(zip(gone, widths)):
            if k % 3 == 0:
                assert not g
            else:
                assert g <= set(range(a, b)), rows[k]
                found[width] += len(g)
                all_lines[width] += b - a
        assert {w: found[w] / n for w, n in all_lines.items() if found[w] < 0.9 * n} == {}
