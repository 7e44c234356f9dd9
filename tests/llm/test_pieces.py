"""SentencePiece encoding and decoding against the library itself."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import sentencepiece

from tidewater.llm import pieces

PATH = public_tokenizers.path("piece_bpe_32k.model")
PARTS = ["a", "b", "e", "▁", " ", " ", "  ", "\n", "the ", "x", "==", "=", "中", "é", "\x00", "😀", "--", "...", "ing", "ation", "　", "0", "1"]
TEXTS = [None, "", " ", "\n\ta", "<s>a</s><unk>", "a▁b", "same text", "same text", "x" * 3000, "=" * 5000, "ab" * 3000, "中" * 2000, "Straße ﬁ İ"]


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=PATH)


def check(texts, library):
    own = pieces.PieceEncoder(PATH)
    for text, (ids, plain) in zip(texts, own.encode_texts(pa.array(texts, pa.string())), strict=True):
        expected = library.encode(text or "")
        assert np.frombuffer(ids, "<i4").tolist() == expected, text and text[:80]
        assert bytes(plain).decode() == library.decode(expected)


def test_random_texts(library):
    dice = random.Random(5)
    check(["".join(dice.choices(PARTS, k=dice.randint(0, 60))) for _ in range(4000)], library)
    check(["".join(dice.choices("Aaeinrst", k=dice.randint(1, 200))) for _ in range(1000)], library)


def test_runs_of_spaces_and_long_words(library):
    check([" " * k + w for k in range(150) for w in ("", "a", " b", "x y")], library)
    dice = random.Random(6)
    check(TEXTS + [" " * 100_000 + "a", "".join(dice.choices("abcdefgh0123", k=30_000)), "word " * 300_000], library)


def test_few_rounds_leave_the_rest_to_the_heap(library, monkeypatch):
    monkeypatch.setattr(pieces, "ROUNDS", 2)
    dice = random.Random(7)
    check(["".join(dice.choices(PARTS, k=40)) for _ in range(300)], library)


def test_decode_any_ids(library):
    own, dice = pieces.PieceEncoder(PATH), random.Random(8)
    for _ in range(2000):
        ids = [dice.choice([dice.randrange(32_000), dice.randrange(3, 259), dice.randrange(3)]) for _ in range(dice.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids), ids


def test_dataframes(spark, library):
    rows = [(i, t, "clash", 1, "clash") for i, t in enumerate(TEXTS)] + [(None, "no id", "clash", 1, "clash")]
    docs = spark.createDataFrame(rows, "`doc.id` long, text string, ids string, n_tokens int, decoded string")
    got = pieces.piece_encode(docs, PATH, "doc.id")
    assert got.columns == ["doc.id", "ids", "decoded"]
    found = {r[0]: (r[1], r[2]) for r in got.collect()}
    shas = {r[0]: tuple(r)[1:] for r in pieces.piece_digests(docs, PATH, "doc.id").collect()}
    assert len(found) == len(shas) == len(rows)
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        assert found[i] == (ids, library.decode(ids))
        assert shas[i] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest())
    back = {r[0]: r[1] for r in pieces.piece_decode(got, PATH, "doc.id").collect()}
    assert back == {i: x[1] for i, x in found.items()}
    assert pieces.piece_digests(docs.limit(0), PATH, "doc.id").count() == 0
