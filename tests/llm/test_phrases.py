"""Collocations against counting every phrase as text."""

import random
import re
from collections import Counter

import pytest

from tidewater.llm import phrases

TYPES = "doc_id long, lang string, text string, rank string, phrase string, id string, f string, n string, left string"


def brute(rows, least, top, inside=80):
    out = []
    counts, totals = {}, Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        low = (text or "").translate({i: i + 32 for i in range(65, 91)})
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", low):
            w = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(w)
            for k in range(1, 5):
                counts.setdefault(lang, Counter()).update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    for lang, f in counts.items():
        good = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        found = []
        for p, a in good.items():
            if any(len(q) > len(p) and 100 * b >= inside * a and any(q[i : i + len(p)] == p for i in range(len(q))) for q, b in good.items()):
                continue
            score, _, l, r = min((2_000_000 * a // (f[p[:k]] + f[p[k:]]), k, f[p[:k]], f[p[k:]]) for k in range(1, len(p)))
            found.append((-score, -a, " ".join(p).encode(), l, r))
        out += [(lang, i + 1, p.decode(), -a, l, r, totals[lang], -s) for i, (s, a, p, l, r) in enumerate(sorted(found)[:top])]
    return sorted(out)


def texts(seed, n, long=0):
    dice = random.Random(seed)
    words = ["the", "The", "old", "sea", "of", "salt", "é", "中文", "a-b", "\x85", "x\xa0y", "ÄB", "ß"]
    join = lambda k: "".join(dice.choice(words[: dice.choice([3, 6, 13])]) + dice.choice([" ", " ", " ", "  ", "\t", ". ", ",", "\n", "!?", "\x0b"]) for _ in range(k))
    rows = [(dice.choice(["en", "de", None, "und"]), join(dice.randint(0, 60))) for _ in range(n)] + [("en", None), ("en", ""), (None, " ,. "), ("fr", "sea sea sea sea sea sea sea")]
    return rows + [("en", join(long))] * 2


def frame(spark, rows):
    return spark.createDataFrame([(i, *r, *["clash"] * 6) for i, r in enumerate(rows)], TYPES)


@pytest.mark.parametrize("size", [phrases.BATCH_BYTES, 200])
def test_against_counting(spark, size):
    rows = texts(size, 250, 3000)
    got = phrases.collocations(frame(spark, rows).repartition(3), least=4, top=40, batch_bytes=size)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    found = sorted(tuple(r) for r in got.collect())
    assert found == brute(rows, 4, 40) and len(found) > 100


def test_nothing(spark):
    assert phrases.collocations(frame(spark, [])).count() == 0
    assert phrases.collocations(frame(spark, [(None, None), ("en", "one two three")])).count() == 0


def test_portions_end_with_pieces():
    dice = random.Random(2)
    for _ in range(300):
        raw = bytes(dice.choice(b"ab .,") for _ in range(dice.randint(0, 80)))
        parts = list(phrases._portions(raw, 7))
        assert b"".join(parts) == raw and all(p[-1] in phrases._BREAK for p in parts[:-1])


def test_counts_beyond_64_bits(spark):
    """Products of large counts stay exact."""
    big = 2**62 + 1
    row = spark.createDataFrame([(big, big + 1, big + 2)], "f long, l long, r long")
    cut = phrases._scored(row, "struct(l as l, r as r)").select("cut.score").first()[0]
    assert cut == 2_000_000 * big // (2 * big + 3)
