"""The pipeline against a plain version of its stages on a small table."""

import hashlib
import random
import re

import numpy as np
import public_tokenizers

import corpus_pipeline
from tests.llm.test_operators import brute_quality
from tidewater.llm import repeats
from tidewater.llm.suffix_array import whole_characters


def rejected(text):
    n_words, chars, symbols, dup, _, base = brute_quality(text)
    letters = sum(b in range(65, 91) or b in range(97, 123) or b >= 0xC3 for b in (text or "").encode())
    upper = sum(c.isascii() and c.isupper() for c in text or "")
    lines = sum(bool(re.search(r"[^\x20\x09-\x0D]", x)) for x in (text or "").split("\n"))
    return base or 4 * symbols > n_words or (letters >= 40 and 2 * upper > letters) or (dup >= 3 and 10 * dup > 3 * lines) or chars < 2 * n_words or chars > 30 * n_words


def shingles5(text):
    words = "".join(c.lower() if c.isascii() else c for c in text).split()
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))}


def one_of_each(docs):
    """One document of each group whose five-word shingles have a similarity of 0.8 or more."""
    sets = {i: shingles5(t) for i, t, _ in docs}
    root = {i: i for i in sets}
    ids, changed = sorted(sets), True
    links = [(a, b) for a in ids for b in ids if a < b and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            if root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    return [d for d in docs if root[d[0]] == d[0]]


def first_copies(docs, length):
    seen, out = set(), []
    for i, _, t, s in sorted((i, repeats.text_key(t.encode()), t, s) for i, t, s in docs):
        raw = t.encode()
        gone = np.zeros(len(raw) + 1, bool)
        for p in range(len(raw) - length + 1):
            w = raw[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        edges = np.nonzero(gone[1:] != gone[:-1])[0] + 1
        edges = [0, *edges] if gone[0] else list(edges)
        runs = whole_characters(raw, list(zip(edges[::2], edges[1::2])))
        for a, b in reversed(runs):
            raw = raw[:a] + raw[b:]
        if not runs or raw.strip():
            out.append((i, raw.decode(), s))
    return out


def test_pipeline(spark, tmp_path):
    from tokenizers import Tokenizer

    draw = random.Random(8)
    words = ["".join(draw.choice("abcdeéghi") for _ in range(draw.randint(3, 8))) for _ in range(400)]
    sentence = lambda n: " ".join(draw.choice(words) for _ in range(n))
    passage = sentence(60)
    docs = [(i, sentence(draw.randint(12, 150)), draw.choice(["a", "b", None])) for i in range(60)]
    docs += [(100 + i, sentence(40) + ". " + passage + " " + sentence(40), "a") for i in range(6)]
    docs += [(200 + i, docs[i][1] + (" end" if i % 2 else ""), "b") for i in range(8)]
    docs += [(300, None, "a"), (301, "few words", "a"), (302, "### " * 50, "b"), (303, "LOUD WORDS HERE AGAIN " * 12, "a"), (304, passage, None)]
    extra = ("null mark", "mix plan", "a.b", "key", "rest")
    kinds = "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{c}` string" for c in extra)
    table = spark.createDataFrame([(i, t, "xx", s, len(t or ""), *extra) for i, t, s in docs], kinds)
    table.write.parquet(str(tmp_path / "documents.parquet"))

    left = first_copies(one_of_each([d for d in docs if not rejected(d[1])]), corpus_pipeline.REPEAT_BYTES)
    stage = table
    for name, f in corpus_pipeline.STAGES[:-1]:
        stage = f(spark, stage, str(tmp_path))
        assert stage.columns == table.columns, name
        stage.write.parquet(str(tmp_path / name))
        stage = spark.read.parquet(str(tmp_path / name))
        if name == "suffix-array dedup":
            got = sorted((r["doc_id"], r["text"], r["source"]) for r in stage.collect())
            assert got == sorted(left) and all(r["n_chars"] == len(r["text"]) for r in stage.collect())
    mixed = stage.collect()
    texts = {i: t for i, t, _ in left}
    assert {r["doc_id"] for r in mixed} <= set(texts) and all(r["text"] == texts[r["doc_id"]] for r in mixed)
    total = sum(len(t.split()) for t in texts.values())
    assert abs(sum(len(r["text"].split()) for r in mixed) - total) <= 3 * 150

    own = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    expected = sorted((r["doc_id"], hashlib.sha256(np.array(own.encode(r["text"], add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for r in mixed)
    assert sorted((r["doc_id"], r["ids_sha256"]) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == expected


def test_empty_and_nulls(spark, tmp_path):
    table = spark.createDataFrame([(None, None, None, None, None)], "doc_id long, text string, lang string, source string, n_chars long")
    for rows in (table, table.limit(0)):
        stage = rows
        for _, f in corpus_pipeline.STAGES:
            stage = f(spark, stage, str(tmp_path))
        assert stage.count() == 0
