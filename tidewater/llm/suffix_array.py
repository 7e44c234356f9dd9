"""Suffix-array dedup: longest-previous-factor arrays over the suffixes that can repeat, from previous and next smaller positions.

Texts are UTF-8 bytes. A window of `length` bytes is anchored at its leftmost gram of least hash (repeats.py), which leaves the
few contexts where different texts share a gram. Their suffixes are sorted by prefix doubling and tripling up to the window length.
In suffix order each suffix looks for the nearest one on either side that stands earlier in the texts; the longer of the
two common prefixes is its longest previous factor, here known up to the window length. Factors of full length mark bytes
that occur before; with the order of texts reversed they mark bytes that occur again.

Mode "later" removes every byte of later copies and keeps the first; mode "all" removes each byte covered by a string that
also starts anywhere else.

Defined cases: a null or empty text has no bytes; in mode "later" rows that repeat an id and its text are one text, in mode
"all" each is a copy of the other; ids are whole numbers, of which -2**63 is refused; texts under the length repeat nothing; a null id comes first in the order of ids; an
empty table gives an empty result; only the id and text columns are read by substring_repeats, all are kept by the filter.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, content_digests, fresh_name, gram_hashes, mix, named, wide_arrow
from .repeats import NO_ID, SLICE_BYTES, Unit, find_repeats, merge_ranges, packed_texts


#: Bytes of the strings whose copies the query reports beside those of 400: a passage of some 40 words.
SHARED_BYTES = 200
#: Bytes of contents whose suffixes are ordered at once; few enough for the processor's cache.
LOT_BYTES = 1 << 18


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """The least value of each run of that width, from minima running to and from block borders."""
    n = len(values)
    padded = np.full(-(-n // width) * width, np.iinfo(values.dtype).max, values.dtype)
    padded[:n] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[: n - width + 1], ahead[width - 1 : n])


def byte_anchors(length: int, gram: int, data: np.ndarray, offsets: np.ndarray):
    """Anchors of all windows of the rows: (row, pos, lo, hi, gram hash, context hash); places are relative to the row."""
    n = len(data)
    none = np.empty(0, np.int64)
    if n < length:
        return none, none, none, none, none.astype(U64), none.astype(U64)
    grams = gram_hashes(data, gram)
    bits = max(24, int(n).bit_length())
    low = U64((1 << bits) - 1)
    ranked = grams & ~low
    ranked |= np.arange(len(grams), dtype=U64)
    at = sliding_min(ranked, length - gram + 1)
    at &= low
    at = at.view(np.int64)
    # A run of windows with one anchor begins where the anchor changes or a text does, and ends before the next or with its text.
    begins, most = offsets[:-1], offsets[1:] - length
    new = np.ones(len(at), bool)
    np.not_equal(at[1:], at[:-1], out=new[1:])
    new[begins[most >= begins]] = True
    first = np.nonzero(new)[0]
    row = np.searchsorted(offsets, first, side="right") - 1
    last = np.minimum(np.append(first[1:], len(at)) - 1, most[row])
    held = last >= first
    first, last, row = first[held], last[held], row[held]
    pos = at[first]
    lo, hi = pos - first, pos - last
    context = content_digests(data, first, last + length)
    return row, pos - offsets[row], lo, hi, grams[pos], mix(context ^ mix((lo.astype(U64) << U64(32)) ^ hi.astype(U64)))


def suffix_ranks(text: np.ndarray, piece_end: np.ndarray, depth: int) -> np.ndarray:
    """Ranks of all suffixes by their first `depth` bytes, by prefix doubling or tripling; a suffix ends with its piece (piece_end, by place)."""
    n = len(text)
    place = np.arange(n)
    key = np.zeros(n, U64)
    wide = np.concatenate([text, np.zeros(8, np.uint8)]).astype(U64)
    for k in range(8):
        key |= np.where(place + k < piece_end, wide[k : k + n], U64(0)) << U64(56 - 8 * k)

    def ranked(key):
        order = np.argsort(key)
        met = key[order]
        new = np.ones(n, bool)
        np.not_equal(met[1:], met[:-1], out=new[1:])
        rank = np.empty(n, np.int64)
        rank[order] = np.cumsum(new)
        return rank

    rank, done = ranked(key), 8
    while done < depth:
        # Ranks from 0 (no suffix left) to the number of different ones; three are compared at once where they fit in 64 bits.
        base = int(rank.max()) + 1
        ways = 3 if base**3 < 1 << 63 and 2 * done < depth else 2
        key = rank
        for k in range(1, ways):
            step = min(k * done, depth - done)
            ahead = np.zeros(n, np.int64)
            ahead[: max(0, n - step)] = rank[step:]
            ahead[place + step >= piece_end] = 0
            key = key * base + ahead
        rank, done = ranked(key), min(ways * done, depth)
    return rank


def previous_smaller(values: np.ndarray) -> np.ndarray:
    """For each place the nearest one before it with a smaller value, or -1; candidates jump along found pointers."""
    n = len(values)
    found = np.arange(n) - 1
    open_ = np.nonzero(found >= 0)[0]
    while len(open_):
        open_ = open_[values[found[open_]] >= values[open_]]
        if not len(open_):
            break
        found[open_] = found[found[open_]]
        open_ = open_[found[open_] >= 0]
    return found


def long_previous_factors(rank: np.ndarray, place: np.ndarray) -> np.ndarray:
    """True where a suffix's longest previous factor has the full depth of the ranks; place orders the suffixes in the texts."""
    order = np.lexsort((place, rank))
    ranks, places = rank[order], place[order]
    before = previous_smaller(places)
    after = len(places) - 1 - previous_smaller(places[::-1])[::-1]
    full = np.zeros(len(order), bool)
    has = before >= 0
    full[has] = ranks[before[has]] == ranks[has]
    has = after < len(places)
    full[has] |= ranks[after[has]] == ranks[has]
    out = np.empty(len(order), bool)
    out[order] = full
    return out


def byte_contents(length: int, text: bytes, pos, lo, hi):
    return [text[a:b] for a, b in zip((pos - lo).tolist(), (pos - hi + length).tolist())]


def byte_windows(length: int, text: bytes, starts: np.ndarray) -> np.ndarray:
    return Rolling(np.frombuffer(text, np.uint8)).of(starts, starts + length)


def resolve_bytes(length: int, mode: str, rows: np.ndarray, contents: list[bytes]):
    """Runs of windows of each content that repeat: (index, first, last)."""
    sizes = np.fromiter(map(len, contents), np.int64, len(contents))
    ends = np.cumsum(sizes)
    starts = ends - sizes
    text = np.frombuffer(b"".join(contents), np.uint8)
    rank = suffix_ranks(text, np.repeat(ends, sizes), length)
    counts = (rows["lo"] - rows["hi"] + 1).astype(np.int64)
    piece = np.repeat(np.arange(len(rows)), counts)
    shift = np.arange(len(piece)) - np.repeat(np.cumsum(counts) - counts, counts)
    rank = rank[starts[piece] + shift]
    order = np.lexsort((rows["pos"], rows["key"], rows["doc"]))
    turn = np.empty(len(rows), np.int64)
    turn[order] = np.arange(len(rows))
    place = turn[piece] * (int(counts.max()) + 1) + shift
    hit = long_previous_factors(rank, place)
    if mode == "all":
        hit |= long_previous_factors(rank, -place)
    return _window_runs(np.nonzero(hit)[0], piece, shift)


def _window_runs(at: np.ndarray, piece: np.ndarray, shift: np.ndarray):
    if not len(at):
        return at, at, at
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1] + 1) | (piece[at[1:]] != piece[at[:-1]])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], len(at)) - 1
    return piece[at[first]], shift[at[first]], shift[at[last]]


def byte_unit(length: int, mode: str, factors: bool = True) -> Unit:
    """factors: contexts that differ are resolved by longest previous factors; otherwise by their windows' hashes."""
    gram = max(1, length * 2 // 5)
    anchors, windows = partial(byte_anchors, length, gram), partial(byte_windows, length)
    if not factors:
        return Unit(length, mode, SLICE_BYTES, anchors, windows)
    return Unit(length, mode, SLICE_BYTES, anchors, windows, partial(byte_contents, length), partial(resolve_bytes, length, mode), LOT_BYTES)


def merged_lists(column: pa.Array) -> list[list[tuple[int, int]]]:
    """Maximal runs of each row of a column of span lists; a batch's spans are merged at once."""
    column = wide_arrow(column)
    counts = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    start, end = (x.to_numpy(zero_copy_only=False).astype(np.int64) for x in column.flatten().flatten())
    row = np.repeat(np.arange(len(column)), counts)
    row, _, start, end = merge_ranges(row, np.zeros_like(row), start, end)
    runs, cuts = list(zip(start.tolist(), end.tolist())), np.searchsorted(row, np.arange(len(column) + 1)).tolist()
    return [runs[i:j] for i, j in zip(cuts[:-1], cuts[1:])]


def merged(spans) -> list[tuple[int, int]]:
    """Maximal runs of a list of spans."""
    out: list[list[int]] = []
    for s in sorted((s["start"], s["end"]) for s in spans or []):
        if out and s[0] <= out[-1][1]:
            out[-1][1] = max(out[-1][1], s[1])
        else:
            out.append(list(s))
    return [(a, b) for a, b in out]


def cut_out(text: bytes, runs: list[tuple[int, int]]) -> bytes:
    parts, at = [], 0
    for a, b in runs:
        parts.append(text[at:a])
        at = b
    return b"".join(parts) + text[at:]


def whole_characters(text: bytes, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The runs shrunk so that no character is cut."""
    out = []
    for a, b in runs:
        while a < b and text[a] & 0xC0 == 0x80:
            a += 1
        while b > a and b < len(text) and text[b] & 0xC0 == 0x80:
            b -= 1
        if a < b:
            out.append((a, b))
    return out


def substring_repeats(docs: DataFrame, length: int = 400, mode: str = "all", id_col: str = "doc_id", text: str = "text", shared: int | None = None) -> DataFrame:
    """(id, n_bytes, n_removed, n_spans, kept_sha256, removed array<struct<start, end>>) of every row.

    With `shared`, a shorter length, also n_shared: the bytes covered by strings of that length that start elsewhere too. They are
    reported, not removed, and found by a search of their own, in mode "all" by hashes of windows.
    """
    spans = find_repeats(docs, byte_unit(length, mode), id_col, text)
    met = packed_texts(docs, id_col, text).join(spans, ["doc", "key"], "left")
    if shared is not None:
        short = find_repeats(docs, byte_unit(shared, mode, factors=False), id_col, text)
        met = met.join(short.withColumnRenamed("spans", "short"), ["doc", "key"], "left")
    met = met.select("doc", "packed", "spans", *(["short"] if shared is not None else []))
    extra = [("n_shared", pa.int64())] if shared is not None else []

    def finish(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = {"id": [], "n_bytes": [], "n_removed": [], "n_spans": [], "kept_sha256": [], "removed": [], **{name: [] for name, _ in extra}}
            if shared is not None:
                out["n_shared"] = [sum(b - a for a, b in runs) for runs in merged_lists(batch.column(3))]
            for doc, packed, runs in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), merged_lists(batch.column(2))):
                raw = unpack.decompress(packed)
                for name, value in zip(out, (None if doc == NO_ID else doc, len(raw), sum(b - a for a, b in runs), len(runs), hashlib.sha256(cut_out(raw, runs)).hexdigest(), [{"start": a, "end": b} for a, b in runs])):
                    out[name].append(value)
            kinds = pa.schema([("id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string()), ("removed", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), *extra])
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    kinds = "id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, removed array<struct<start: long, end: long>>"
    done = met.mapInArrow(finish, kinds + (", n_shared long" if shared is not None else ""))
    return done.withColumnRenamed("id", id_col)


def substring_dedup(docs: DataFrame, length: int = 400, id_col: str = "doc_id", text: str = "text", chars: str | None = "n_chars") -> DataFrame:
    """docs with later copies of repeated strings cut out of their texts; texts of which nothing but white space is left go.

    Characters are kept whole; a column that counts characters is brought up to date. Null texts stay null.
    """
    spans = find_repeats(docs, byte_unit(length, "later"), id_col, text)
    others = tuple(c for c in docs.columns if c != text)
    # A null text is packed as the empty one; null stays null by the mark that rides along first.
    mark = fresh_name("null mark", docs.columns)
    marked = docs.select(named(text).isNull().alias(mark), *map(named, docs.columns))
    met = packed_texts(marked, id_col, text, (mark, *others)).join(spans, ["doc", "key"], "left").select("packed", "spans", "rest")
    order = docs.columns

    def cut(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            texts, keep = [], []
            null_marks, *rest = batch.column(2).flatten()
            for packed, spans, null in zip(batch.column(0).to_pylist(), merged_lists(batch.column(1)), null_marks.to_pylist()):
                raw = unpack.decompress(packed)
                left = cut_out(raw, whole_characters(raw, spans))
                keep.append(not spans or bool(left.strip()))
                texts.append(None if null else left.decode())
            columns = dict(zip(others, rest)) | {text: pa.array(texts, pa.string())}
            if chars in columns:
                old, kind = columns[chars].to_pylist(), columns[chars].type
                touched = batch.column(1).is_valid().to_pylist()
                columns[chars] = pa.array([len(t) if s and t is not None else c for t, s, c in zip(texts, touched, old)], kind)
            yield pa.RecordBatch.from_arrays([columns[c] for c in order], names=order).filter(pa.array(keep))

    return met.mapInArrow(cut, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return substring_repeats(read_table(spark, sf_dir, "documents"), shared=SHARED_BYTES).drop("removed")
