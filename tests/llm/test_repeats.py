"""Both substring operators against brute force over all windows."""

import hashlib
import random
import time

import numpy as np
import pyarrow as pa
import pytest

from tidewater.llm import common, recompression, repeats, suffix_array

SCHEMA = "doc_id long, text string, spans string, key string"


def brute_words(rows, length=13):
    least = {}
    texts = [(i, (t or "").encode().split()) for i, t in rows]
    for i, words in texts:
        for p in range(len(words) - length + 1):
            w = tuple(words[p : p + length])
            if i is not None and i < least.get(w, i + 1):
                least[w] = i
    out = []
    for i, words in texts:
        gone = [False] * len(words)
        for p in range(len(words) - length + 1):
            if i is not None and least[tuple(words[p : p + length])] < i:
                gone[p : p + length] = [True] * length
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), hashlib.sha256(kept).hexdigest()))
    return out


def brute_bytes(rows, length):
    count = {}
    texts = [(i, (t or "").encode()) for i, t in rows]
    for _, t in texts:
        for p in range(len(t) - length + 1):
            count[t[p : p + length]] = count.get(t[p : p + length], 0) + 1
    out = []
    for i, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            if count[t[p : p + length]] > 1:
                gone[p : p + length] = True
        spans = int(gone[:1].sum() + (gone[1:] & ~gone[:-1]).sum())
        kept = bytes(np.frombuffer(t, np.uint8)[~gone])
        out.append((i, len(t), int(gone.sum()), spans, hashlib.sha256(kept).hexdigest()))
    return out


def brute_first(rows, length):
    """Bytes kept when the first copy in (id, key, place) order stays."""
    texts = sorted({(i, repeats.text_key((t or "").encode()), (t or "").encode()) for i, t in rows})
    seen, out = set(), {}
    for i, key, t in texts:
        gone = np.zeros(len(t), bool)
        for p in range(len(t) - length + 1):
            w = t[p : p + length]
            if w in seen:
                gone[p : p + length] = True
            seen.add(w)
        out[i, t] = bytes(np.frombuffer(t, np.uint8)[~gone])
    return out


def corpus(seed, vocabulary=40, n=60):
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdé") for _ in range(draw.randint(1, 4))) for _ in range(vocabulary)]
    passages = [[draw.choice(words) for _ in range(draw.randint(10, 40))] for _ in range(6)]
    rows = []
    for i in range(n):
        text = []
        for _ in range(draw.randint(0, 5)):
            text += draw.choice(passages) if draw.random() < 0.5 else [draw.choice(words) for _ in range(draw.randint(1, 30))]
            if draw.random() < 0.1:
                text += ["a"] * draw.randint(5, 40)
        rows.append((i, draw.choice([" ", "\n", " "]).join(text)))
    rows += [(n, None), (n + 1, ""), (n + 2, " \t\n"), (n + 3, rows[3][1]), (n + 4, rows[3][1]), (n + 5, "ab " * 200), (n + 6, "x" * 300), rows[5]]
    draw.shuffle(rows)
    return rows


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "clash", "clash") for i, t in rows], SCHEMA)


@pytest.mark.parametrize("seed, hot", [(1, 8000), (2, 2)])
def test_words(spark, seed, hot, monkeypatch):
    monkeypatch.setattr(repeats, "HOT_CONTEXTS", hot)
    monkeypatch.setattr(repeats.find_repeats, "__defaults__", ("doc_id", "text", hot))
    rows = corpus(seed) + [(None, corpus(seed)[0][1])]
    got = recompression.word_repeats(frame(spark, rows)).drop("kept").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_words(rows)))


@pytest.mark.parametrize("seed, length, hot", [(3, 40, 8000), (4, 60, 2)])
def test_bytes_all(spark, seed, length, hot, monkeypatch):
    monkeypatch.setattr(repeats.find_repeats, "__defaults__", ("doc_id", "text", hot))
    rows = corpus(seed) + [(None, corpus(seed)[0][1])]
    got = suffix_array.substring_repeats(frame(spark, rows), length).drop("removed").collect()
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, brute_bytes(rows, length)))


@pytest.mark.parametrize("seed, length, hot", [(5, 40, 8000), (6, 50, 2)])
def test_bytes_later(spark, seed, length, hot, monkeypatch):
    monkeypatch.setattr(repeats.find_repeats, "__defaults__", ("doc_id", "text", hot))
    rows = corpus(seed)
    expected = brute_first(rows, length)
    got = suffix_array.substring_repeats(frame(spark, rows), length, "later").select("doc_id", "kept_sha256").collect()
    assert sorted(map(tuple, got)) == sorted((i, hashlib.sha256(expected[i, (t or "").encode()]).hexdigest()) for i, t in rows)


def test_dedup_keeps_columns(spark):
    rows = corpus(7)
    docs = frame(spark, rows).withColumnRenamed("spans", "lang")
    out = suffix_array.substring_dedup(docs, 40, chars=None)
    assert out.schema == docs.schema
    got = {r["doc_id"]: r["text"] for r in out.collect()}
    assert set(got) <= {i for i, _ in rows}
    assert all((t is None) == (got[i] is None) for i, t in rows if i in got)


def test_patterned_words(spark):
    """Two words that a hash modulo a power of two takes for one are two words."""
    bits = [bin(i).count("1") & 1 for i in range(1024)]
    twelve = "one two three four five six seven eight nine ten eleven twelve "
    rows = [(1, twelve + "".join("ab"[b] for b in bits)), (2, twelve + "".join("ba"[b] for b in bits)), (3, twelve + "".join("ab"[b] for b in bits))]
    got = {r["doc_id"]: r["n_removed"] for r in recompression.word_repeats(frame(spark, rows)).collect()}
    assert got == {1: 0, 2: 0, 3: 13}


def test_bytes_at_400(spark):
    """The query's own length: passages of 300 to 1200 bytes, some of them in many texts, some overlapping."""
    draw = random.Random(9)
    letters = "abcdefghij é"
    passages = ["".join(draw.choice(letters) for _ in range(n)) for n in (300, 399, 400, 401, 650, 1200)]
    rows = []
    for i in range(60):
        parts = ["".join(draw.choice(letters) for _ in range(draw.randint(0, 600)))]
        for _ in range(draw.randint(0, 3)):
            p = draw.choice(passages)
            cut = draw.randint(0, 40)
            parts += [p[cut:] if draw.random() < 0.5 else p, "".join(draw.choice(letters) for _ in range(draw.randint(0, 300)))]
        rows.append((i, "".join(parts)))
    rows += [(100, "z" * 2000), (101, "z" * 400), (102, rows[4][1]), (103, rows[4][1] + "x"), (104, None)]
    got = suffix_array.substring_repeats(frame(spark, rows), shared=200).drop("removed").collect()
    assert sorted(map(str, (tuple(r)[:5] for r in got))) == sorted(map(str, brute_bytes(rows, 400)))
    assert sorted((r["doc_id"], r["n_shared"]) for r in got) == sorted((i, n) for i, _, n, _, _ in brute_bytes(rows, 200))


def test_names_and_ids(spark):
    """Columns named like inner ones or with dots stay; ids that cannot be told apart from none, or are no numbers, are refused."""
    rows = corpus(8)
    docs = spark.createDataFrame([(i, t, "m", 7) for i, t in rows], "doc_id long, text string, `null mark` string, `a.b` int")
    out = suffix_array.substring_dedup(docs, 40, chars=None)
    assert out.schema == docs.schema and {tuple(r[2:]) for r in out.collect()} == {("m", 7)}
    dotted = docs.withColumnRenamed("text", "the.text")
    assert recompression.word_repeats(dotted, text="the.text").count() == len(rows)
    with pytest.raises(TypeError):
        recompression.word_repeats(spark.createDataFrame([("x", "t")], "doc_id string, text string"))
    with pytest.raises(Exception, match="missing id"):
        recompression.word_repeats(spark.createDataFrame([(-(2**63), "t")], "doc_id long, text string")).collect()


def test_empty(spark):
    none = frame(spark, [])
    assert recompression.word_repeats(none).count() == 0
    assert suffix_array.substring_repeats(none).count() == 0
    assert suffix_array.substring_dedup(none, chars=None).count() == 0


def test_long_text(spark):
    base = " ".join(f"w{i * i % 9973}" for i in range(200_000))
    rows = [(1, base), (2, "intro " + base[1000:60_000] + " end")]
    got = {r["doc_id"]: r["n_removed"] for r in recompression.word_repeats(frame(spark, rows)).collect()}
    expected = {i: n for i, _, n, _ in brute_words(rows)}
    assert got == expected


def test_previous_smaller():
    draw = np.random.RandomState(0)
    for n in (0, 1, 2, 50):
        x = draw.randint(0, 20, n)
        expected = [max((j for j in range(i) if x[j] < x[i]), default=-1) for i in range(n)]
        assert suffix_array.previous_smaller(x).tolist() == expected


def test_blocks_round_trip():
    draw = np.random.RandomState(1)
    rows = np.empty(500, repeats.ANCHOR)
    for name in rows.dtype.names:
        rows[name] = draw.randint(0, 200, 500)
    back = repeats.unpack_columns(repeats.pack_columns(rows))
    assert sorted(back.tolist()) == sorted(rows.tolist())


def test_grams_are_cheap():
    """Both scans hash a gram at every byte: that takes less than half of what a hash that proves equality does."""
    data = np.frombuffer(random.Random(9).randbytes(1 << 20), np.uint8)

    def seconds(job):
        job()
        times = []
        for _ in range(5):
            began = time.process_time()
            job()
            times.append(time.process_time() - began)
        return min(times)

    assert seconds(lambda: common.gram_hashes(data, 160)) < 0.5 * seconds(lambda: common.Rolling(data).every(160))


def test_anchors_of_all_windows():
    """Each window has one anchor inside it, at the same place with the same hash wherever its bytes are; patterned texts too."""
    dice = random.Random(1)
    morse = bytes(97 + i.bit_count() % 2 for i in range(4096))
    for _ in range(60):
        length = dice.choice([1, 2, 5, 10, 40])
        texts = [bytes(dice.choice(b"ab") for _ in range(dice.choice([0, 1, length - 1, length, length + 1, 3 * length, 100]))) for _ in range(dice.randint(1, 6))]
        texts.insert(dice.randint(0, len(texts)), morse[(k := dice.randrange(4000)) : k + 96])
        data, offsets = np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])
        found, seen = {}, {}
        for row, pos, lo, hi, gram, _ in zip(*(x.tolist() for x in suffix_array.byte_anchors(length, max(1, length * 2 // 5), data, offsets))):
            for begin in range(pos - lo, pos - hi + 1):
                assert (row, begin) not in found
                found[row, begin] = pos - begin, gram
                assert 0 <= pos - begin <= length - max(1, length * 2 // 5)
        assert set(found) == {(r, k) for r, t in enumerate(texts) for k in range(len(t) - length + 1)}
        for (row, begin), anchor in found.items():
            assert seen.setdefault(texts[row][begin : begin + length], anchor) == anchor


def test_merged_lists():
    """As each list's own merge, nulls and empty lists included, whatever the batch's offset."""
    dice = random.Random(4)
    lists = [None if dice.random() < 0.2 else [{"start": (a := dice.randrange(30)), "end": a + dice.randint(1, 6)} for _ in range(dice.randrange(8))] for _ in range(100)]
    column = pa.array(lists, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())])))
    for part, rows in ((column, lists), (column[7:50], lists[7:50]), (column[:0], [])):
        assert suffix_array.merged_lists(part) == [suffix_array.merged(x) for x in rows]
