"""Encoding and decoding held against the library that the contract names."""

import hashlib
import random

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
sentencepiece = pytest.importorskip("sentencepiece")

from panelforge.llm import pieces, queries  # noqa: E402
from panelforge.llm.common import table  # noqa: E402

MODEL = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"
ODD = ["", " ", "   x", "a", "\n\n a\t\r\n", "hello▁world ▁", "日本語\x00x", "<s></s><0x0A><unk>", "a" * 5000, "   " * 777, "é😀👨‍👩‍👧 x", "﻿x", "The  quick   brown    fox", "12345 67", "x y z"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


@pytest.fixture(scope="module")
def coder():
    return pieces.Encoder(pieces.Vocabulary.load(MODEL))


@pytest.fixture(scope="module")
def decoder():
    return pieces.Decoder(pieces.Vocabulary.load(MODEL))


def ints(packed):
    return np.frombuffer(packed, "<u4").tolist()


def test_odd_and_random_texts(library, coder, decoder):
    r = random.Random(1)
    parts = ["a", "b", "e", "t", "h", " ", "  ", "in", "the", "ing", "1", "2", "\n", "é", "日", "_", "-", "▁", "."]
    texts = ODD + ["".join(r.choice(parts) for _ in range(r.randrange(40))) for _ in range(3000)]
    texts += ["".join(r.choice("abcdefghijklmnop") for _ in range(2000)) for _ in range(20)]
    texts += ["".join(chr(r.choice([r.randrange(32, 127), r.randrange(0x370, 0x5FF), r.randrange(0x4E00, 0x9FFF), r.randrange(0x1F300, 0x1F6FF)])) for _ in range(200)) for _ in range(50)]
    for text in texts:
        packed = coder.encode(text)
        assert ints(packed) == library.encode(text, add_bos=True, add_eos=True)
        assert decoder.decode(packed) == library.decode(ints(packed))


def merged(v, text):
    """Merging pair by pair: the best score first, of equal ones the leftmost."""
    score = {p: s for p, s, k in zip(v.pieces, v.scores, v.kinds) if k == pieces.NORMAL}
    parts = list(text)
    while len(parts) > 1:
        best = max(((score[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in score), default=None)
        if best is None:
            break
        parts[-best[1] : 2 - best[1]] = ["".join(parts[-best[1] : 2 - best[1]])]
    return parts


def split(coder, text):
    return [coder.text(s) for s in coder.split(text)]


def test_backtracking_equals_merging(coder):
    r = random.Random(2)
    for _ in range(2000):
        text = "".join(r.choice(["▁", "s", "t", "e", "a", "r", "\n", "in", "on", "ing"]) for _ in range(r.randrange(1, 25)))
        assert split(coder, text) == merged(coder.v, text)


def test_backs_out_of_a_longest_match_that_fails():
    """Merges b+c first, so the longest match "ab" never stands before "c"."""
    v = pieces.Vocabulary(("<unk>", "<s>", "</s>", "bc", "ab", "a", "b", "c"), (0.0, 0.0, 0.0, -1.0, -2.0, -3.0, -4.0, -5.0), (2, 3, 3, 1, 1, 1, 1, 1), 0, 1, 2, False, " ? ", "test")
    c = pieces.Encoder(v)
    assert split(c, "abc") == ["a", "bc"] == merged(v, "abc") and split(c, "ababc") == ["ab", "a", "bc"] and split(c, "ab") == ["ab"]
    assert ints(c.encode("abzc")) == [1, 4, 0, 7, 2]


def test_random_vocabularies():
    """Small alphabets with many pieces and equal scores, where longest matches often fail."""
    r = random.Random(4)
    for _ in range(60):
        found = list("abc")
        for _ in range(r.randrange(3, 14)):
            found.append(r.choice(found) + r.choice(found))
        found = list(dict.fromkeys(f for f in found if len(f) < 9))
        scores = [-float(r.randrange(6)) for _ in found]
        v = pieces.Vocabulary(("<unk>", "<s>", "</s>", *found), (0.0, 0.0, 0.0, *scores), (2, 3, 3, *[1] * len(found)), 0, 1, 2, False, "?", "test")
        c = pieces.Encoder(v)
        for _ in range(60):
            text = "".join(r.choice("abc") for _ in range(r.randrange(1, 30)))
            assert split(c, text) == merged(v, text)


def test_decodes_any_ids(library, decoder):
    r = random.Random(3)
    for _ in range(3000):
        ids = [r.choice([r.randrange(3), r.randrange(3, 259), r.randrange(32000)]) for _ in range(r.randrange(12))]
        assert decoder.decode(np.array(ids, "<u4").tobytes()) == library.decode(ids)
    with pytest.raises(ValueError):
        decoder.decode(np.array([32000], "<u4").tobytes())


def test_forgets_when_full(coder, monkeypatch):
    monkeypatch.setattr(pieces, "REMEMBERED", 3)
    monkeypatch.setattr(pieces, "REMEMBERED_PAIRS", 3)
    text = "one two three four five six seven one two"
    c = pieces.Encoder(coder.v)
    assert all(c.encode(text) == coder.encode(text) for _ in range(3))


def test_columns_nulls_and_repeats(spark, library):
    rows = [(1, "hello world", "x"), (1, "hello world", "x"), (None, None, None), (3, "", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    out = pieces.decode(pieces.encode(docs, MODEL, begin=False, end=False), MODEL)
    assert out.columns == ["doc_id", "text", "ids", "decoded"]
    got = sorted(((r.doc_id, r.ids, r.decoded) for r in out.collect()), key=repr)
    assert got == sorted([(1, library.encode("hello world"), "hello world")] * 2 + [(None, [], ""), (3, [], "")], key=repr)
    assert pieces.encode(docs.limit(0), MODEL).count() == 0
    once = pieces.encode(docs, MODEL, begin=False, end=False, decoded=True)
    assert once.columns == out.columns and sorted(map(str, once.collect())) == sorted(map(str, out.collect()))
    nothing = spark.createDataFrame([(None,)], "ids array<int>")
    assert pieces.decode(nothing, MODEL).first().decoded is None


def test_query_equals_library(spark, library):
    found = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in queries.op13_merge_backtracking(spark, SF).collect()}
    docs = table(spark, SF, "documents").select("doc_id", "text").collect()
    assert len(found) == len(docs)
    for d in docs:
        ids = library.encode(d.text or "", add_bos=True, add_eos=True)
        assert found[d.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
