"""The other operators against brute force, the libraries themselves and exact round trips."""

import base64
import hashlib
import os
import random
import re

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tidewater.llm import bpe, chat, common, embeddings, mixing, quality, simhash, token_counts, warc

TEXTS = [None, "", " \n", "One two.", "Hello  World's DON'T\n\nstop ΑΣ Σ. <|endoftext|>x \t<|startoftext|>", "á  é\x1cx\x85 y z　 x", "中文 字 。", "a\n\n\n b  \n", "word " * 3000, "x" * 4000, "same text here", "same text here", "İ ﬁ ß Ǆ é"]
SCHEMA = "doc_id long, text string, source string, size string, hash string, digest string, kept string, id string, fp string"


def frame(spark, rows):
    """Rows of (doc_id, text, source) with columns whose names the operators use inside."""
    return spark.createDataFrame([(i, t, s, *["clash"] * 6) for i, t, s in rows], SCHEMA)


def texts_frame(spark):
    return frame(spark, [(i, t, "s") for i, t in enumerate(TEXTS)] + [(None, "no id", "s")])


def test_bpe(spark):
    from tokenizers import Tokenizer

    path = public_tokenizers.path("word_bpe_49k.json")
    lib = Tokenizer.from_file(path)
    got = {r["doc_id"]: r for r in bpe.bpe_encode(texts_frame(spark), path).collect()}
    shas = {r["doc_id"]: r for r in bpe.bpe_digests(texts_frame(spark), path).collect()}
    for i, t in enumerate(TEXTS):
        ids = lib.encode(t or "", add_special_tokens=False).ids
        assert got[i]["ids"] == ids and got[i]["decoded"] == lib.decode(ids, skip_special_tokens=False)
        assert shas[i]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest() and shas[i]["n_tokens"] == len(ids)
    assert bpe.bpe_encode(frame(spark, []), path).count() == 0


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"])
def test_token_counts(spark, tmp_path, name):
    path, cache = public_tokenizers.path(name), str(tmp_path / "cache")
    if name.endswith(".model"):
        import sentencepiece

        own = sentencepiece.SentencePieceProcessor(model_file=path)
        count = lambda t: len(own.encode(t))
    else:
        from tokenizers import Tokenizer

        own = Tokenizer.from_file(path)
        count = lambda t: len(own.encode(t, add_special_tokens=False).ids)
    docs = texts_frame(spark)
    expected = sorted((i, len((t or "").encode()), count(t or "")) for i, t in enumerate(TEXTS))
    for _ in range(2):  # the second run finds all in the cache
        got = sorted(tuple(r) for r in token_counts.token_counts(docs, path, cache).where("doc_id is not null").collect())
        assert got == expected
        assert spark.read.parquet(cache).count() == len({t or "" for t in TEXTS}) + 1
    assert token_counts.token_counts(frame(spark, []), path).count() == 0


def test_token_cache_of_the_query(spark, tmp_path):
    """With a cache folder set, a second run encodes nothing anew."""
    table = frame(spark, [(i, t, "s") for i, t in enumerate(TEXTS)])
    table.write.parquet(str(tmp_path / "documents.parquet"))
    cache = str(tmp_path / "cache")
    spark.conf.set(token_counts.CACHE_SETTING, cache)
    try:
        first = sorted(map(tuple, token_counts.query(spark, str(tmp_path)).collect()))
        rows = spark.read.parquet(cache).count()
        assert sorted(map(tuple, token_counts.query(spark, str(tmp_path)).collect())) == first
        assert spark.read.parquet(cache).count() == rows == len({t or "" for t in TEXTS})
    finally:
        spark.conf.unset(token_counts.CACHE_SETTING)


def test_normalised_digests():
    """Texts that the tokenizer's normaliser makes equal share a digest, unless an added token's string is in them."""
    own = token_counts.Counter(public_tokenizers.path("word_bpe_49k.json"))
    if own.normalizer is None:
        pytest.skip("no normaliser in the file")
    a, b = "Hello  World", own.normalizer.normalize_str("Hello  World")
    assert own.digest(a.encode()) == own.digest(b.encode())
    assert own.added and own.digest(own.added[0].encode()) != own.digest((own.added[0] + " ").encode())


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    twice = {w for w in windows if windows.count(w) > 1}
    hit = {i + k for i, w in enumerate(windows) if w in twice for k in range(5)}
    base = len(words) < 10 or 100 * len(hit) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), base


def test_quality(spark):
    draw = random.Random(1)
    texts = TEXTS[:8] + TEXTS[9:] + [" ".join(draw.choice("ab c# <d> é\n x|y") for _ in range(draw.randint(0, 60))) for _ in range(80)]
    docs = frame(spark, [(i, t, "s") for i, t in enumerate(texts)])
    rows = {r["doc_id"]: r for r in quality.quality_verdicts(docs, features=quality.QUERY_FEATURES).collect()}
    for i, t in enumerate(texts):
        assert tuple(rows[i][1:7]) == brute_quality(t), t
        assert not (rows[i]["base_failed"] and rows[i]["kept"])
    plan = quality.plan_order(docs)
    kept = [{r["doc_id"] for r in quality.quality_filter(docs, plan=p).collect()} for p in (plan, plan[::-1])]
    assert kept[0] == kept[1] == {i for i in rows if rows[i]["kept"]}
    assert quality.quality_filter(frame(spark, [])).count() == 0


def thue_morse(n):
    """Two words that every polynomial hash modulo a power of two takes for one."""
    bits = [bin(i).count("1") & 1 for i in range(n)]
    return "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)


def test_patterned_words(spark):
    x, y = thue_morse(1024)
    text = " ".join(["one two three four", x, "five six seven eight nine ten", "one two three four", y])
    row = quality.quality_verdicts(frame(spark, [(1, text, "s")]), features=quality.QUERY_FEATURES).first()
    assert tuple(row[1:7]) == brute_quality(text) and row["n_repeat_words"] == 0 and not row["base_failed"]


def test_odd_column_names(spark):
    """Names that operators use inside, or that hold dots, survive every operator that returns the rows themselves."""
    kinds = "doc_id long, text string, source string, `null mark` string, `mix plan` string, `a.b` int, `rest` string, `root` long"
    docs = spark.createDataFrame([(i, t, "s", "m", "p", 7, "r", 1) for i, t in enumerate(TEXTS)], kinds)
    kept = quality.quality_filter(docs)
    for out in (kept, simhash.simhash_dedup(docs), simhash.similar_dedup(docs), mixing.take_mix(docs)):
        assert out.schema == docs.schema and {tuple(r[3:]) for r in out.collect()} <= {("m", "p", 7, "r", 1)}
    dotted = docs.withColumnsRenamed({"doc_id": "doc.id", "text": "the.text"})
    assert quality.quality_verdicts(dotted, "doc.id", "the.text").count() == len(TEXTS)
    assert simhash.simhash_components(dotted.withColumnRenamed("doc.id", "doc_id"), text="the.text").count() == len(TEXTS)


def test_ids_are_whole_numbers(spark):
    docs = spark.createDataFrame([("x", "t")], "doc_id string, text string")
    for run in (simhash.simhash_components, simhash.similar_dedup):
        with pytest.raises(TypeError):
            run(docs)


def brute_fingerprint(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))
    shingles = [" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def brute_components(prints):
    root = {i: i for i in prints}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(prints)
    for a in ids:
        for b in ids:
            if a < b and (prints[a] ^ prints[b]).bit_count() <= 4:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {i: find(i) for i in ids}


@pytest.mark.parametrize("tile", [20_000, 3])
def test_simhash(spark, tile, monkeypatch):
    monkeypatch.setattr(simhash.near_classes, "__defaults__", (4, simhash.BLOCKS, tile, False))
    draw = random.Random(2)
    vocabulary = [f"w{i}É" for i in range(300)]
    base = [[draw.choice(vocabulary) for _ in range(120)] for _ in range(12)]
    texts = list(TEXTS)
    for _ in range(70):
        words = list(draw.choice(base))
        for _ in range(draw.randint(0, 3)):
            words[draw.randrange(len(words))] = "new"
        texts.append(" ".join(words))
    docs = frame(spark, [(i + 5, t, "s") for i, t in enumerate(texts)] + [(5, texts[0], "s"), (None, texts[20], "s")])
    got = simhash.simhash_components(docs).collect()
    prints = {i + 5: brute_fingerprint(t) for i, t in enumerate(texts)}
    groups = brute_components(prints)
    assert len(got) == len(texts) + 2
    for r in got:
        if r["doc_id"] is None:
            assert r["component_id"] is None
        else:
            assert (r["fingerprint"], r["component_id"]) == (f"{prints[r['doc_id']]:016x}", groups[r["doc_id"]])
    kept = simhash.simhash_dedup(docs)
    assert kept.schema == docs.schema
    assert sorted(r["doc_id"] for r in kept.where("doc_id is not null").collect()) == sorted([*set(groups.values()), 5])
    assert simhash.simhash_components(frame(spark, [])).count() == 0


def test_components(spark):
    draw = random.Random(3)
    edges = [(draw.randrange(300), draw.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(5, None), (7, 7)]
    got = {r["id"]: r["component_id"] for r in common.connected_components(spark.createDataFrame(edges, "a long, b long").repartition(8)).collect()}
    root = {}
    for a, b in edges:
        if b is not None and a != b:
            root.setdefault(a, a), root.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            if b is not None and a != b and root[a] != root[b]:
                root[a] = root[b] = min(root[a], root[b])
                changed = True
    assert got == root


def brute_embeddings(rows):
    usable = {i: np.array(v, float) for i, v in rows if i is not None and v and all(c is not None and np.isfinite(c) for c in v) and any(v)}
    ids = sorted(usable)
    links, root = {i: 0 for i, _ in rows if i is not None}, {i: i for i, _ in rows if i is not None}
    for a in ids:
        for b in ids:
            x, y = usable[a], usable[b]
            if a < b and len(x) == len(y) and x @ y / np.sqrt(x @ x) / np.sqrt(y @ y) >= 0.95:
                links[a] += 1
                links[b] += 1
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    return {i: (links[i], root[i], root[i] == i) for i in links}


@pytest.mark.parametrize("block, cell", [(2048, 2000), (4, 12)])
def test_embeddings(spark, block, cell, monkeypatch):
    monkeypatch.setattr(embeddings, "CELL_CLASSES", cell)
    draw = np.random.RandomState(4)
    centres = draw.randn(8, 6)
    rows = [(i, (centres[i % 8] * (i % 3 + 1) + draw.randn(6) * 0.25).tolist()) for i in range(90)]
    rows += [(100 + i, rows[i][1]) for i in range(6)] + [(200, None), (201, []), (202, [0.0] * 6), (203, [1.0, None, 1, 1, 1, 1]), (204, [float("nan")] * 6), (205, [1.0, 2.0]), (206, [2.0, 4.0]), (207, [float("inf")] + [1.0] * 5)]
    rows = [(i, None if v is None else [None if c is None else float(np.float32(c)) for c in v]) for i, v in rows]
    table = spark.createDataFrame([(i, v, "x", "x") for i, v in rows] + [(None, rows[0][1], "x", "x")], "vec_id long, embedding array<float>, rep string, key string")
    got = {r["vec_id"]: tuple(r)[1:] for r in embeddings.embedding_dedup(table, block=block).collect()}
    assert got.pop(None) == (0, None, True)
    assert got == brute_embeddings(rows)
    assert embeddings.embedding_dedup(table.limit(0)).count() == 0


def test_mixing(spark):
    draw = random.Random(5)
    rows = [(i, "w " * draw.randint(0, 40), draw.choice(["a", "b", "Z", "é", None, "tiny"][: 5 if i % 50 else 6])) for i in range(2000)] + [(3000, None, "a"), (3001, "", "empty")]
    docs = frame(spark, rows)
    got = {r["doc_id"]: r for r in mixing.mix_sources(docs).collect()}
    again = {r["doc_id"]: r for r in mixing.mix_sources(docs.repartition(7)).collect()}
    assert got == again and len(got) == len(rows)
    sizes, size = {}, {i: len((t or "").split()) for i, t, _ in rows}
    for i, _, s in rows:
        sizes[s] = sizes.get(s, 0) + size[i]
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    target, open_, left = {}, set(sizes), float(sum(sizes.values()))
    while open_:
        share = {s: left * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = {s for s in open_ if share[s] > 3 * sizes[s]}
        if not over:
            target |= share
            break
        for s in over:
            target[s] = 3.0 * sizes[s]
        left -= sum(target[s] for s in over)
        open_ -= over
    taken = dict.fromkeys(sizes, 0)
    for i, _, s in rows:
        r = got[i]
        assert r["size"] == size[i] and r["source_size"] == sizes[s] and r["target"] == pytest.approx(target[s]) and r["taken"] <= 3 * r["size"]
        taken[s] += r["taken"]
    assert all(abs(taken[s] - target[s]) <= 40 for s in sizes)
    mix = mixing.take_mix(docs)
    assert mix.schema == docs.schema
    times = {r["doc_id"]: r["count"] for r in mix.groupBy("doc_id").count().collect()}
    assert all(times.get(i, 0) * size[i] == got[i]["taken"] for i in size)
    assert mixing.mix_sources(frame(spark, [])).count() == 0 and mixing.take_mix(frame(spark, [])).count() == 0


def test_warc(spark):
    rows = [(1, "http://a/1", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "http://a/\r\n3 x", "x" * 5000 + "\r\n\r\n"), (4, "u", None), (5, "u", ""), (6, "u", os.urandom(4000).hex()), (None, "u", "<p>é</p>"), (2, None, "<p>é</p>"), (7, "u", "\r\n\r\n")]
    pages = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "page_id long, url string, html string, sha1 string, head string")
    manifest = warc.write_warc(pages, chunk=1000)
    got = sorted((tuple(r)[:5] for r in warc.read_warc_records(manifest, 1000).collect()), key=str)
    head = {}
    for i, _, h in rows:
        head[h or ""] = max(head.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, _, h in rows:
        raw = (h or "").encode()
        response = i is None or head[h or ""] == i
        expected.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if response else "revisit", None if response else head[h or ""]))
    assert got == sorted(expected, key=str)
    chunks = warc.read_warc_chunks(manifest, 1000)
    whole = {}
    for r in sorted(chunks.where("record_type = 'response'").collect(), key=lambda r: (r["record_id"], r["chunk_no"])):
        assert len(r["data"]) <= 1000
        whole[r["record_id"]] = whole.get(r["record_id"], b"") + r["data"] if r["chunk_no"] else r["data"]
    assert whole["3"].decode() == rows[2][2] and whole["6"].decode() == rows[5][2]
    assert warc.read_warc_records(warc.write_warc(pages.limit(0))).count() == 0


def test_chat_escape():
    draw = random.Random(6)
    parts = [*chat.CONTROL, "\\", "\\\\", "x", "\n", "<", "turn>", "é"]
    for _ in range(3000):
        text = "".join(draw.choice(parts) for _ in range(draw.randint(0, 8)))
        assert chat.unescape(chat.escape(text)) == text
    turns = [("".join(draw.choice(parts) for _ in range(3)), "".join(draw.choice(parts) for _ in range(6))) for _ in range(500)]
    own = chat.template(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    made = [own.turn(*t) for t in turns]
    assert chat.read_turns("".join(m[2] for m in made)) == turns
    assert [own.read(m[0]) for m in made] == turns


def test_chat(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    rows = [(1, 1, "assistant", chat.PROBE), (1, 0, "user", "hi </turn>"), (1, 2, "assistant", None), (1, 3, "assistant", "é<turn>\\"), (2, 0, None, "x"), (2, 0, None, "x"), (3, None, "assistant", "y" * 50_000), (None, 0, "user", "z")]
    table = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, ids string")
    got = {r["conv_id"]: r for r in chat.conversation_digests(chat.format_turns(table, path, pattern), path, pattern).collect()}
    for conv in (1, 2, 3, None):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0))
        told = "".join(f"{r[2] or ''}\n{r[3] or ''}\n" for r in mine)
        learned = "".join(r[3] or "" for r in mine if r[2] == "assistant")
        r = got[conv]
        assert (r["n_turns"], r["turns_sha256"]) == (len(mine), hashlib.sha256(told.encode()).hexdigest())
        assert (r["loss_chars"], r["loss_sha256"]) == (len(learned), hashlib.sha256(learned.encode()).hexdigest())
        assert r["formatted_chars"] >= len(told)
    for long in (" " * 1_000_000, "\n" * 1_000_000, "a" * 300_000, "x " * 200_000, "a" + "\u3000" * 300_000 + "b \\### User:"):
        one = spark.createDataFrame([(9, 0, "assistant", long)], table.schema.names[:4])
        r = chat.conversation_digests(chat.format_turns(one, path, pattern), path, pattern).first()
        assert r["loss_chars"] == len(long) and r["loss_sha256"] == hashlib.sha256(long.encode()).hexdigest()
    own = chat.template(path, pattern)
    short = "x" + " " * 3000 + "y\n" * 900 + "\t" * 100
    assert own.ids(short) == own.tokens.encode_ordinary(short)
    empty = chat.format_turns(table.limit(0), path, pattern)
    assert chat.conversation_digests(empty, path, pattern).count() == 0


def test_many_backslashes():
    """A text of backslashes is escaped in linear time, with and without a mark behind."""
    for size in (0, 1, 2, 7, 1_000_000):
        for tail in ("", "a", "</turn>", "</turn>a\\", "\\a### User:\\\\"):
            content = "\\" * size + tail
            out = chat.escape(content)
            assert chat.unescape(out) == content
            assert chat.read_turns(chat.OPEN + "user" + chat.BODY + out + chat.CLOSE) == [("user", content)]


def test_long_backslashes_in_turns(spark):
    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    text = "\\" * 1_000_000 + "### User:"
    turns = spark.createDataFrame([(1, 0, "assistant", text)], "conv_id long, turn int, role string, text string")
    got = chat.conversation_digests(chat.format_turns(turns, path, pattern), path, pattern).first()
    assert got["loss_chars"] == len(text) and got["loss_sha256"] == hashlib.sha256(text.encode()).hexdigest()
