"""Collocation mining by hierarchical pair naming: words that stand together more often than their parts explain.

Words get numbers inside a batch of texts; batches stay packed arrays of them. In each round Spark counts, over all batches, the
pairs of adjacent named (k-1)-grams, names those that are frequent, and hands the names back to the batches that hold them; a
k-gram's name therefore points to its two (k-1)-grams, and pairs of names one word apart are the k-grams of the next round.
Keys are dealt to buckets by hash and numbered inside theirs by falling count; a name is that number and the bucket, so no numbering
passes through one place. Only distinct pairs of
a batch are exchanged, with their count there, as packed columns by bucket of keys; whatever is rarer than the limit leaves at
once, as nothing longer can be frequent once, as nothing longer can be frequent with it. Scores of cuts and the search for longer phrases follow the pointers in joins.

Defined cases: a null or empty text has no words; a null lang is `und`; upper-case A to Z are lowered, other letters stay; repeated rows
count as often as they come; ties are settled by phrase; an empty table gives no rows. Other columns are not read, whatever
their names. A text of any length is cut, between its pieces, into batches; a single piece is worked on by itself.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, mix, named, release_memory, staged, text_buffers, wide_arrow

#: Text bytes of a batch.
BATCH_BYTES = 10 << 20
#: Bits of a batch's number inside its partition.
BATCH_BITS = 20
#: Parts in which each language's phrases are ranked first.
RANK_PARTS = 64
_BREAK = b".,;:!?\n\x0b\x0c\r"
_CLASS = np.zeros(256, np.uint8)
_CLASS[[0x20, 0x09]] = 1
_CLASS[list(_BREAK)] = 2
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORDS = "batch long, bucket int, lang string, n long, packed binary, words binary"
_PAIRS = "batch long, bucket int, first long, packed binary"
_WORD_NAMES = "batch long, packed binary, id long, f long, lang string, word string"
_PAIR_NAMES = "batch long, packed binary, id long, f long, `left` long, `right` long"


def _pack(*columns: np.ndarray) -> bytes:
    """Whole numbers as differences, byte planes apart, compressed: what rises slowly takes a byte or two a number."""
    planes = [np.diff(c, prepend=0).astype("<i8").view(np.uint8).reshape(-1, 8).T for c in columns]
    return zstandard.compress(np.concatenate(planes).tobytes(), 3)


def _unpack(packed: bytes, n: int) -> list[np.ndarray]:
    planes = np.frombuffer(zstandard.decompress(packed), np.uint8).reshape(8 * n, -1)
    return [np.cumsum(np.ascontiguousarray(planes[8 * i : 8 * i + 8].T).view("<i8").ravel()) for i in range(n)]


def _dealt(bucket: np.ndarray):
    """The places of each bucket, in order: (bucket, places)."""
    order = np.argsort(bucket, kind="stable")
    cuts = np.nonzero(np.diff(bucket[order]))[0] + 1
    for places in np.split(order, cuts) if len(order) else ():
        yield int(bucket[places[0]]), places


def _portions(raw: bytes, most: int):
    """A long text in portions of about most bytes that end with pieces."""
    start = 0
    while len(raw) - start > most:
        cut = max(raw.rfind(bytes([b]), start, start + most) for b in _BREAK)
        if cut < start:
            behind = re.compile(b"[" + re.escape(_BREAK) + b"]").search(raw, start + most)
            if not behind:
                break
            cut = behind.start()
        yield raw[start : cut + 1]
        start = cut + 1
    yield raw[start:]


def _state(codes: np.ndarray) -> bytes:
    """Codes, compressed; of each run of -1 one is kept. A byte for each code, and for those that do not fit four more by planes."""
    keep = np.ones(len(codes), bool)
    keep[1:] = (codes[1:] >= 0) | (codes[:-1] >= 0)
    shown = codes[keep] + 1
    wide = (shown[shown >= 255] - 255).astype("<u4").view(np.uint8).reshape(-1, 4).T
    return zstandard.compress(np.array([len(shown)], "<i8").tobytes() + np.minimum(shown, 255).astype(np.uint8).tobytes() + wide.tobytes(), 3)


def _codes(packed: bytes) -> np.ndarray:
    raw = zstandard.decompress(packed)
    n = int.from_bytes(raw[:8], "little")
    out = np.frombuffer(raw, np.uint8, n, 8).astype(np.int64)
    planes = np.frombuffer(raw, np.uint8, -1, 8 + n).reshape(4, -1) if len(raw) > 8 + n else np.empty((4, 0), np.uint8)
    out[out == 255] += np.ascontiguousarray(planes.T).view("<u4").ravel()
    return out - 1


def _numbered(data: np.ndarray, offsets: np.ndarray, langs: pa.Array):
    """Per language and word of a batch: count, and the batch as word numbers with -1 between pieces."""
    data = _LOWER[data]
    kind = _CLASS[data]
    inside = kind == 0
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    start, end = inside.copy(), inside.copy()
    start[1:] &= ~inside[:-1] | edge[1:-1]
    end[:-1] &= ~inside[1:] | edge[1:-1]
    starts, ends = np.nonzero(start)[0], np.nonzero(end)[0] + 1
    row = np.searchsorted(offsets, starts, side="right") - 1
    breaks = np.concatenate([[0], np.cumsum(kind == 2)])
    apart = (breaks[starts[1:]] != breaks[ends[:-1]]) | (row[1:] != row[:-1])
    bounds = np.concatenate([[0], np.cumsum(ends - starts)])
    raw = data[inside]
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(raw)]).dictionary_encode()
    tongue = langs.dictionary_encode()
    size = max(1, len(words.dictionary))
    key = tongue.indices.to_numpy(zero_copy_only=False).astype(np.int64)[row] * size + words.indices.to_numpy(zero_copy_only=False)
    own, local, n = np.unique(key, return_inverse=True, return_counts=True)
    # Numbers by falling count: common words have small ones, which pack well.
    order = np.argsort(-n, kind="stable")
    number = np.empty(len(order), np.int64)
    number[order] = np.arange(len(order))
    own, n, local = own[order], n[order], number[local]
    codes = np.full(len(local) + int(apart.sum()), -1, np.int64)
    codes[np.arange(len(local)) + np.concatenate([[0], np.cumsum(apart)])[: len(local)]] = local
    return tongue.dictionary.take(pa.array(own // size)), words.dictionary.take(pa.array(own % size)), n, _state(codes)


def _packed_words(batches, most: int, buckets: int):
    """Of each batch of texts: word counts in packed columns, a block for each bucket and language, its totals, and the batch itself."""
    part, seq = TaskContext.get().partitionId(), 0
    texts, langs, size = [], [], 0
    schema = pa.schema([("batch", pa.int64()), ("bucket", pa.int32()), ("lang", pa.string()), ("n", pa.int64()), ("packed", pa.binary()), ("words", pa.binary())])

    def flush():
        nonlocal seq, texts, langs, size
        data, offsets = text_buffers(pa.array(texts, pa.large_binary()))
        if len(data):
            if seq >> BATCH_BITS:
                raise ValueError("too many batches in one partition")
            batch = part << BATCH_BITS | seq
            seq += 1
            lang, word, n, packed = _numbered(data, offsets, pa.array(langs, pa.string()))
            out = [(batch, None, None, None, packed, None)]
            tongues = lang.dictionary_encode()
            tongue, names = tongues.indices.to_numpy(zero_copy_only=False), tongues.dictionary.to_pylist()
            out += [(batch, None, name, int(n[tongue == k].sum()), None, None) for k, name in enumerate(names)]
            hashed = np.fromiter((xxhash.xxh3_64_intdigest(w, 5) for w in word.to_pylist()), U64, len(word))
            key = tongue.astype(np.int64) * buckets + (hashed % U64(buckets)).astype(np.int64)
            for k, places in _dealt(key):
                mine = word.take(pa.array(places))
                raw, ends = text_buffers(mine)
                out.append((batch, k % buckets, names[k // buckets], None, _pack(n[places], places, ends[1:]), zstandard.compress(raw.tobytes(), 3)))
            for i in range(0, len(out), 1000):
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out[i : i + 1000]), schema)], schema=schema)
        texts, langs, size = [], [], 0

    for batch in batches:
        for lang, text in zip(wide_arrow(batch.column(0)).to_pylist(), wide_arrow(batch.column(1)).cast(pa.binary()).to_pylist()):
            if not text:
                continue
            for portion in _portions(text, most) if len(text) > most else (text,):
                if size and size + len(portion) > most:
                    yield from flush()
                texts.append(portion)
                langs.append("und" if lang is None else lang)
                size += len(portion)
    yield from flush()
    release_memory()


def _answers(batch: np.ndarray, local: np.ndarray, key: np.ndarray, n: np.ndarray, least: int, bucket: int, buckets: int):
    """Frequent keys of a bucket, keys being numbers in a fixed order: names, counts, a place of each; and each batch's places with their names."""
    f = np.zeros(key.max(initial=-1) + 1, np.int64)
    np.add.at(f, key, n)
    good = np.nonzero(f >= least)[0]
    good = good[np.argsort(-f[good], kind="stable")]
    name = np.full(len(f), -1, np.int64)
    name[good] = np.arange(len(good)) * buckets + bucket
    place = np.zeros(len(f), np.int64)
    place[key] = np.arange(len(key))
    kept = np.nonzero(name[key] >= 0)[0]
    kept = kept[np.lexsort((local[kept], batch[kept]))]
    cuts = np.nonzero(np.diff(batch[kept]))[0] + 1
    back = [(int(batch[x[0]]), _pack(local[x], name[key[x]])) for x in np.split(kept, cuts) if len(x)]
    release_memory()
    return name[good], f[good], place[good], back


def _named_words(table: pa.Table, least: int, buckets: int) -> pa.Table:
    """Names of the frequent words of a bucket, and each batch's places with their names."""
    parts, words, langs = [], [], []
    for batch, lang, packed, raw in zip(*(table.column(c).to_pylist() for c in ("batch", "lang", "packed", "words"))):
        n, local, ends = _unpack(packed, 3)
        parts.append((np.full(len(n), batch), local, n))
        words.append(pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(n), [None, pa.py_buffer(np.concatenate([[0], ends])), pa.py_buffer(zstandard.decompress(raw))]))
        langs.append((lang, len(n)))
    batch, local, n = (np.concatenate(x) for x in zip(*parts))
    word = pa.concat_arrays(words).dictionary_encode()
    # Keys by language and word in byte order, so that every run gives the same names.
    in_order = lambda d: pc.rank(d, "ascending", tiebreaker="dense").to_numpy().astype(np.int64) - 1
    names = sorted({x for x, _ in langs})
    tongue = np.repeat([names.index(x) for x, _ in langs], [k for _, k in langs])
    key = np.unique(tongue * len(word.dictionary) + in_order(word.dictionary)[word.indices.to_numpy()], return_inverse=True)[1]
    ids, f, place, back = _answers(batch, local, key, n, least, table.column("bucket")[0].as_py(), buckets)
    texts = word.dictionary.take(word.indices.take(pa.array(place))).cast(pa.binary()).cast(pa.string())
    return _rows(ids, f, back, lang=pa.array([names[k] for k in tongue[place]], pa.string()), word=texts)


def _named_pairs(table: pa.Table, least: int, buckets: int) -> pa.Table:
    """Names of the frequent pairs of a bucket, and each batch's places with their names."""
    parts = []
    for batch, first, packed in zip(*(table.column(c).to_pylist() for c in ("batch", "first", "packed"))):
        left, right, n = _unpack(packed, 3)
        parts.append((np.full(len(n), batch), left, right, n, np.arange(first, first + len(n))))
    batch, left, right, n, local = (np.concatenate(x) for x in zip(*parts))
    order = np.lexsort((right, left))
    new = np.zeros(len(order), bool)
    new[1:] = (left[order[1:]] != left[order[:-1]]) | (right[order[1:]] != right[order[:-1]])
    key = np.empty(len(order), np.int64)
    key[order] = np.cumsum(new)
    ids, f, place, back = _answers(batch, local, key, n, least, table.column("bucket")[0].as_py(), buckets)
    return _rows(ids, f, back, left=pa.array(left[place]), right=pa.array(right[place]))


def _rows(ids: np.ndarray, f: np.ndarray, back: list, **parts: pa.Array) -> pa.Table:
    """Rows of names, then a row of packed places for each batch."""
    k, m = len(ids), len(back)
    columns = {"batch": pa.array([None] * k + [b[0] for b in back], pa.int64()), "packed": pa.array([None] * k + [b[1] for b in back], pa.binary()), "id": pa.concat_arrays([pa.array(ids, pa.int64()), pa.nulls(m, pa.int64())]), "f": pa.concat_arrays([pa.array(f, pa.int64()), pa.nulls(m, pa.int64())])}
    return pa.table(columns | {c: pa.concat_arrays([x, pa.nulls(m, x.type)]) for c, x in parts.items()})


def _paired(state: pa.Table, known: pa.Table, buckets: int, last: bool) -> pa.Table:
    """Counts of the adjacent pairs of named places of a batch, in packed columns by bucket, and the batch as pair numbers.

    Pairs are numbered bucket by bucket in the order of their names, so a block says where its numbers begin and no more. The
    last round needs the counts only.
    """
    local, ids = (np.concatenate(x) for x in zip((np.empty(0, np.int64),) * 2, *(_unpack(p, 2) for p in known.column("packed").to_pylist())))
    codes = _codes(state.column("packed")[0].as_py())
    batch = state.column("batch")[0].as_py()
    table = np.full(max(int(codes.max(initial=-1)), int(local.max(initial=-1))) + 2, -1, np.int64)
    table[local] = np.arange(len(local))
    places = table[codes]  # -1 reads the last entry, which is -1
    both = np.nonzero((places[:-1] >= 0) & (places[1:] >= 0))[0]
    own, pair, n = np.unique(places[both] * len(ids) + places[both + 1], return_inverse=True, return_counts=True)
    out = []
    number = np.empty(len(own), np.int64)
    if len(own):
        left, right = ids[own // len(ids)], ids[own % len(ids)]
        bucket = (mix(left.view(U64) ^ mix(right.view(U64) + U64(1))) % U64(buckets)).astype(np.int64)
        order = np.lexsort((right, left, bucket))
        number[order] = np.arange(len(order))
        cuts = np.nonzero(np.diff(bucket[order]))[0] + 1
        for first, x in zip([0, *cuts.tolist()], np.split(order, cuts)):
            out.append((batch, int(bucket[x[0]]), first, _pack(left[x], right[x], n[x])))
    if not last:
        after = np.full(max(0, len(places) - 1), -1, np.int64)
        after[both] = number[pair]
        out.append((batch, None, None, _state(after)))
    release_memory()
    return pa.table({c: pa.array([r[i] for r in out], t) for i, (c, t) in enumerate((("batch", pa.int64()), ("bucket", pa.int32()), ("first", pa.int64()), ("packed", pa.binary())))})


def _name_rows(found: DataFrame, *columns: str) -> DataFrame:
    return found.where("id is not null").select("id", "f", *columns)


def _scored(grams: DataFrame, cuts: str) -> DataFrame:
    """The lowest-scoring cut, the shortest first part among equals; exact beyond 64 bits."""
    exact = lambda x: f"cast({x} as decimal(28,0))"
    cut = F.array_min(F.expr(f"transform(array({cuts}), (c, i) -> struct({exact('f')} * 2000000BD div ({exact('c.l')} + {exact('c.r')}) as score, i as i, c.l as l, c.r as r))"))
    return grams.withColumn("cut", cut)


def collocations(docs: DataFrame, least: int = 30, inside_percent: int = 80, top: int = 2000, text: str = "text", lang: str = "lang", batch_bytes: int = BATCH_BYTES) -> DataFrame:
    """Each language's best phrases of 2 to 4 words: (lang, rank, phrase, a, l, r, n, score).

    a, l and r are the occurrences of the phrase and of the two parts at its lowest-scoring cut, n all words of the language.
    """
    buckets = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = staged(docs.select(named(lang).alias("lang"), named(text).alias("text")).mapInArrow(lambda b: _packed_words(b, batch_bytes, buckets), _WORDS))
    totals = rows.where("n is not null").groupBy("lang").agg(F.sum("n").alias("n"))
    blocks = rows.where("bucket is not null").select("batch", "bucket", "lang", "packed", "words")
    found = [staged(blocks.groupBy("bucket").applyInArrow(lambda t: _named_words(t, least, buckets), _WORD_NAMES))]
    states = rows.where("bucket is null and packed is not null").select("batch", "packed")
    def paired(last: bool):
        return lambda state, known: _paired(state, known, buckets, last)

    for k in (2, 3, 4):
        places = found[-1].where("batch is not null").select("batch", "packed")
        rows = staged(states.groupBy("batch").cogroup(places.groupBy("batch")).applyInArrow(paired(k == 4), _PAIRS))
        states = rows.where("bucket is null").select("batch", "packed")
        found.append(staged(rows.where("bucket is not null").groupBy("bucket").applyInArrow(lambda t: _named_pairs(t, least, buckets), _PAIR_NAMES)))

    # Each table carries what the next one asks of its parents: first and last word, and the counts at both ends.
    one = _name_rows(found[0], "lang", "word").withColumns({"phrase": F.col("word"), "first_f": F.col("f")})

    def grams(k: int, parts: DataFrame) -> DataFrame:
        head = parts.select(F.col("id").alias("left"), "lang", F.col("phrase").alias("head"), F.col("first_f"), F.col("f").alias("head_f"), *([F.col("left").alias("ll"), F.col("right").alias("lr"), F.col("left_f").alias("ll_f")] if k > 2 else []))
        tail = parts.select(F.col("id").alias("right"), F.col("word"), F.col("last_f" if k > 2 else "f").alias("last_f"), F.col("f").alias("tail_f"), *([F.col("right").alias("rr"), F.col("right_f").alias("rr_f")] if k > 2 else []))
        whole = _name_rows(found[k - 1], "left", "right").join(head, "left").join(tail, "right")
        return whole.withColumns({"phrase": F.concat("head", F.lit(" "), "word"), "left_f": F.col("head_f"), "right_f": F.col("tail_f"), "k": F.lit(k)})

    # Each is asked for several times; written once, its joins are made once.
    two = staged(grams(2, one))
    three = staged(grams(3, two))
    four = staged(grams(4, three))
    cut = lambda a, b: f"struct({a} as l, {b} as r)"
    scored = [
        _scored(two, cut("head_f", "tail_f")),
        _scored(three, ", ".join([cut("first_f", "tail_f"), cut("head_f", "last_f")])),
        _scored(four, ", ".join([cut("first_f", "tail_f"), cut("ll_f", "rr_f"), cut("head_f", "last_f")])),
    ]
    inside = lambda k, parts: F.explode(F.array(*(F.struct(F.lit(n).alias("k"), F.col(c).alias("id")) for n, c in parts)))
    longer = three.select("f", inside(3, [(2, "left"), (2, "right")]).alias("p")).unionByName(four.select("f", inside(4, [(3, "left"), (3, "right"), (2, "ll"), (2, "lr"), (2, "rr")]).alias("p")))
    longest = longer.groupBy("p.k", "p.id").agg(F.max("f").alias("longer"))
    every = scored[0].select("k", "id", "lang", "phrase", "f", "cut")
    for x in scored[1:]:
        every = every.unionByName(x.select("k", "id", "lang", "phrase", "f", "cut"))
    kept = every.join(longest, ["k", "id"], "left").where(f"longer is null or cast(longer as decimal(28,0)) * 100 < cast(f as decimal(28,0)) * {inside_percent}")
    order = "order by cut.score desc, f desc, phrase"
    best = kept.withColumn("place", F.expr(f"row_number() over (partition by lang, pmod(xxhash64(phrase), {RANK_PARTS}) {order})")).where(F.col("place") <= top)
    best = best.withColumn("rank", F.expr(f"cast(row_number() over (partition by lang {order}) as long)")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", F.col("f").alias("a"), F.col("cut.l").alias("l"), F.col("cut.r").alias("r"), "n", F.col("cut.score").alias("score"))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return collocations(read_table(spark, sf_dir, "documents"))
