import os
import random
import zlib
from collections import Counter

import numpy as np
import pytest

from convsift.llm import token_store

P = pytest.importorskip("public_tokenizers")
FILE = str(P.path(token_store.TOKENIZER))


@pytest.fixture(scope="module")
def encode():
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(FILE)
    t.encode_special_tokens = True
    return lambda text: t.encode(text or "", add_special_tokens=False).ids + [token_store.END_ID]


ODD = ["a.\nb, c.d. (e). f,. ,g \n.h i.\n\nj k.\x1c l", "\n", "\n\n", "a\n", "\na", "x\r\ny", "1. 2, ²³. ½, x² ٣.", "", " ", "  ", "a", " a", "a ", "a  b", "a \n b", "a\n b", "a  b", "a  b", "x \x1c y", "it's 'll we 've", "a\tb  \n\n c ",
       "<|endoftext|> b", "é ́x ﬁ 中文 字 1234 5", "🙂 👩‍👩‍👧 a", "Ġ Ġa", "word " * 3000, "x" * 30_000, "a" + " " * 5000 + "b", "  　 q"]


def texts(seed, n):
    rng = random.Random(seed)
    vocab = ["".join(rng.choices("abcdefghéñ,.'1 \n", k=rng.randint(1, 8))) for _ in range(700)]
    return [" ".join(rng.choices(vocab, k=int(rng.expovariate(1 / 60)))) for _ in range(n)]


def test_ids_are_the_tokenizers(encode):
    encoder = token_store.Encoder(FILE)
    many = ODD + texts(1, 300)
    for _ in range(2):
        got = encoder.encode([t.encode() for t in many])
        assert [np.frombuffer(x, encoder.dtype).tolist() + [2] for x in got] == [encode(t) for t in many]


def test_a_small_cache_changes_nothing(encode, monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_RUNS", 20)
    monkeypatch.setattr(token_store, "CACHE_WORDS", 5)
    encoder = token_store.Encoder(FILE)
    for t in texts(2, 40):
        assert [np.frombuffer(x, encoder.dtype).tolist() + [2] for x in encoder.encode([t.encode(), t.encode(), b"a b"])] == [encode(t), encode(t), encode("a b")]


def handed(encoder):
    """What the encoder hands to the tokenizer from now on, cut at blanks."""
    out, ids = [], encoder._ids
    encoder._ids = lambda texts: [out.extend(t.split()) for t in texts] and ids(texts)
    return out


def test_a_run_with_other_signs_at_its_end_is_not_encoded_again(encode):
    encoder = token_store.Encoder(FILE)
    words = handed(encoder)
    many = ["a haus", "a haus! haus### haus$$$ haus.", "a année; année!? année"]
    got = encoder.encode([t.encode() for t in many])
    assert [np.frombuffer(x, encoder.dtype).tolist() + [2] for x in got] == [encode(t) for t in many]
    assert Counter(words)["haus"] == Counter(words)["année"] == 1 and not any(w.startswith(("haus", "année")) for w in set(words) - {"haus", "année"})


def test_runs_used_often_stay_known(encode, monkeypatch):
    monkeypatch.setattr(token_store, "CACHE_RUNS", 300)
    monkeypatch.setattr(token_store, "CACHE_WORDS", 150)
    encoder = token_store.Encoder(FILE)
    words = handed(encoder)
    often = [f"often{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40)]
    for i in range(30):
        text = " ".join(["x", *often, *(f"rare{i}x{j}" for j in range(60))])
        assert np.frombuffer(encoder.encode([text.encode()])[0], encoder.dtype).tolist() + [2] == encode(text)
        assert encoder.runs <= 300 + 101
    assert {n for w, n in Counter(words).items() if w.startswith("often")} == {1}


def test_signs_and_long_runs(encode):
    long = ["x" * n + end for n in (7, 8, 9, 63, 64, 65, 72, 200) for end in ("", "a", "!", "é", "b!!")]
    signs = ["é!", "×!", "x×!", "÷.", "ɏ.", "ɐ!", "中!", "²!", "it's!", "'s!", "'ll'", "!'s", "a…!", "a_", "_a_", "a\u00a0!", "a\x1c!", "a\x00!", "b\x00", "c", "!", "!!", "a!" * 9]
    many = [" ".join(x) for x in (long, signs)] + ["\n".join(x) for x in (long, signs)] + long + signs + [" " + x for x in signs]
    encoder = token_store.Encoder(FILE)
    for _ in range(2):
        got = encoder.encode([t.encode() for t in many])
        assert [np.frombuffer(x, encoder.dtype).tolist() + [2] for x in got] == [encode(t) for t in many]


def expected(rows, encode):
    """Rows in ascending order of ids, nulls last; of one id by the checksum of its ids."""
    out, at = [], 0
    keyed = [(d is None, d or 0, zlib.crc32(np.array(encode(t), "<u2").tobytes()), d, encode(t)) for d, t in rows]
    for _, _, _, d, ids in sorted(keyed, key=lambda k: k[:3]):
        out.append((d, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return Counter(out)


def run(spark, tmp_path, df):
    df.write.parquet(str(tmp_path / "documents.parquet"))
    return Counter(tuple(r) for r in token_store.query(spark, str(tmp_path)).collect())


def rows_of(seed, n=200):
    rows = list(enumerate(texts(seed, n))) + list(enumerate(ODD, -10))
    rows += [(None, "a b"), (None, None), (None, "z"), (500, None)] + [(77, t) for t in texts(seed + 1, 50)] + [(300, "same words")] * 60
    random.Random(seed).shuffle(rows)
    return rows


def test_whole_table(spark, make_docs, clashing, encode, tmp_path):
    rows = rows_of(3)
    assert run(spark, tmp_path, clashing(make_docs(rows))) == expected(rows, encode)


def test_many_small_shards(spark, make_docs, encode, tmp_path, monkeypatch):
    monkeypatch.setattr(token_store, "SHARD_BYTES", 2_000)
    monkeypatch.setattr(token_store, "BLOCK_BYTES", 300)
    rows = rows_of(4)
    assert run(spark, tmp_path, make_docs(rows).repartition(5)) == expected(rows, encode)
    path = str(tmp_path / "store")
    token_store.write_tokens(make_docs(rows), path, FILE)
    ids = {r.doc_id: (r.n_tokens, r.ids) for r in token_store.read_tokens(spark, path).where("doc_id BETWEEN 100 AND 130").collect()}
    assert ids == {d: (len(encode(t)), encode(t)) for d, t in rows if d is not None and 100 <= d <= 130}
    shards = [f for f in os.listdir(f"{path}/shards") if f.startswith("part-")]
    assert len(shards) > 10
    once = Counter(d for d, _ in rows)
    for d, t in rows[::9]:
        if d is not None and once[d] == 1:
            assert token_store.read_document(spark, path, d) == encode(t)
    for missing in (-99, 400, 10_000):
        assert token_store.read_document(spark, path, missing) is None
    assert token_store.read_document(spark, path, 300) == encode("same words")


@pytest.mark.parametrize("rows", [[], [(1, None)], [(None, None), (3, "")], [(1, "few words"), (2, "few words")]])
def test_tiny_tables(spark, make_docs, encode, tmp_path, rows):
    assert run(spark, tmp_path, make_docs(rows)) == expected(rows, encode)


def test_damage_and_other_dictionaries_are_noticed(spark, make_docs, tmp_path):
    path = str(tmp_path / "store")
    token_store.write_tokens(make_docs([(1, "some words of a text"), (2, "other words")]), path, FILE)
    name = next(f for f in os.listdir(f"{path}/shards") if f.startswith("part-"))
    with open(f"{path}/shards/{name}", "rb") as file:
        data = file.read()
    dictionary = token_store.read_dictionary(spark, path)
    assert [(r[1], r[2], len(r[3])) for r in token_store.shard_documents(data, dictionary)][0][:2] == (1, 0)
    with pytest.raises(ValueError, match="dictionary"):
        list(token_store.shard_documents(data, dictionary + b"x"))
    at = token_store.read_trailer(data[-token_store.FIXED:])[0]
    for place, words in ((0, "not a shard"), (at + 3, "index"), (len(data) - token_store.FIXED, "trailer")):
        broken = data[:place] + bytes([data[place] ^ 1]) + data[place + 1:]
        with pytest.raises(ValueError, match=words):
            list(token_store.shard_documents(broken, dictionary))


def test_the_shared_dictionary_helps_short_documents(spark, make_docs, tmp_path):
    rng = random.Random(5)
    phrases = [" ".join("".join(rng.choices("abcdefgh", k=5)) for _ in range(8)) for _ in range(40)]
    rows = [(i, " ".join(rng.choices(phrases, k=3))) for i in range(600)]
    docs = make_docs(rows)
    dictionary = token_store.train_dictionary(docs, FILE, 2)
    size = {len(d): sum(len(r.frame) for r in token_store.compress(docs, FILE, 2, d).collect()) for d in (b"", dictionary)}
    assert len(dictionary) > 500 and size[len(dictionary)] < 0.7 * size[0]
