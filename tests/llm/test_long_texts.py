"""Texts of a megabyte and more, whole, through the operators that read texts one by one."""

import base64
import hashlib
import random

import numpy as np
import public_tokenizers
import pytest

from tests.llm.test_operators import brute_fingerprint, frame
from tidewater.llm import bpe, mixing, pieces, quality, simhash, token_counts, warc


@pytest.fixture(scope="module")
def texts():
    dice = random.Random(1)
    words = ["".join(dice.choices("abcdefgéß", k=dice.randint(1, 9))) for _ in range(3000)]
    prose = "".join(dice.choice(words) + dice.choice([" ", " ", ", ", "\n"]) for _ in range(220_000))
    return [prose, "one word " + "x" * 1_200_000, prose[:1_000_000]]


def test_encoders(spark, texts):
    from sentencepiece import SentencePieceProcessor
    from tokenizers import Tokenizer

    assert all(len(t) >= 1_000_000 for t in texts)
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts[:1] + texts[2:])])
    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    for r in bpe.bpe_digests(docs, path).collect():
        ids = lib.encode((texts[0], texts[2])[r["doc_id"]], add_special_tokens=False).ids
        assert (r["n_tokens"], r["ids_sha256"]) == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest())
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = SentencePieceProcessor(model_file=path)
    for r in pieces.piece_digests(docs, path).collect():
        ids = lib.encode(texts[r["doc_id"]], add_bos=True, add_eos=True)
        assert (r["n_tokens"], r["decoded_sha256"]) == (len(ids), hashlib.sha256(texts[r["doc_id"]].encode()).hexdigest())
    path = public_tokenizers.path("byte_bpe_50k.json")
    lib = Tokenizer.from_file(path)
    for r in token_counts.token_counts(docs.where("doc_id <> 1"), path).collect():
        assert r["n_tokens"] == len(lib.encode(texts[r["doc_id"]], add_special_tokens=False).ids) and r["n_bytes"] == len(texts[r["doc_id"]].encode())


def test_fingerprints_rules_and_sizes(spark, texts):
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    prints = {r["doc_id"]: r["fingerprint"] for r in simhash.simhash_components(docs).collect()}
    assert prints == {i: f"{brute_fingerprint(t):016x}" for i, t in enumerate(texts)}
    for r in quality.quality_verdicts(docs, features=quality.QUERY_FEATURES).collect():
        words = texts[r["doc_id"]].split()
        assert r["n_words"] == len(words) and r["word_chars"] == sum(map(len, words))
        windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
        counts = {}
        for w in windows:
            counts[w] = counts.get(w, 0) + 1
        assert r["n_repeat_words"] == len({i + k for i, w in enumerate(windows) if counts[w] > 1 for k in range(5)})
    assert {r["doc_id"]: r["size"] for r in mixing.mix_sources(docs).collect()} == {i: len(t.split()) for i, t in enumerate(texts)}


def test_payloads(spark, texts, tmp_path):
    pages = spark.createDataFrame([(i, "http://x/", t) for i, t in enumerate([*texts, texts[0]])], "page_id long, url string, html string")
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    got = {r["page_id"]: r for r in warc.query(spark, str(tmp_path)).collect()}
    for i, t in enumerate([*texts, texts[0]]):
        assert got[i]["payload_bytes"] == len(t.encode()) and got[i]["payload_digest"] == base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert (got[0]["record_type"], got[0]["refers_to"], got[3]["record_type"]) == ("revisit", 3, "response")
