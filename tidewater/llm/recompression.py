"""Substring dedup by recompression: rounds name runs and pairs of word symbols, the same everywhere, and long repeats share names.

Names are digests of what they stand for, so one name means one word sequence in every task and no dictionary is exchanged.
A round first gives each maximal run of one symbol a name of its symbol and length, then joins each pair whose left name falls
in one half of the alphabet and whose right name in the other. A symbol *knows* the words that decided its shape: itself
and the neighbours that kept it from growing. Inside a window of words, symbols whose known words all lie in the window are
the same wherever the window occurs. Each window is anchored at such a symbol of the highest round, so equal windows meet by
the symbol's name (repeats.py); contexts that differ are compared word by word through hashes of whole windows.

Each word covered by a window whose words also start in a text with a smaller id is removed.

Defined cases: a null or empty text has no words; texts under the window length repeat nothing; rows with one id never remove
each other's words, repeated or not; a row with a null id keeps all words and removes none elsewhere; ids are whole numbers, of which -2**63 is refused; an empty table gives an
empty result; only the id and text columns are read.
"""

from __future__ import annotations

import hashlib
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame

from .common import U64, Rolling, content_digests, mix, word_spans
from .repeats import NO_ID, Unit, find_repeats, packed_texts
from .suffix_array import merged

#: Rounds of pair naming. After so many, symbols in a window of 13 words still know no more than the window.
ROUNDS = 3
#: Bytes of text whose symbols are named at once; words need more room than bytes.
SLICE_BYTES = 1 << 20
_PAIR = [U64(x) for x in (0x8CB92BA72F3D8DD7, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB)]


class Symbols:
    """Symbols of a level: name, words [start, end) and the words [know_start, know_end) that decided them."""

    def __init__(self, name, start, end, know_start, know_end, row):
        self.name, self.start, self.end, self.know_start, self.know_end, self.row = name, start, end, know_start, know_end, row


def _grouped(s: Symbols, first: np.ndarray, name: np.ndarray, know_start: np.ndarray, know_end: np.ndarray) -> Symbols:
    last = np.append(first[1:], len(s.name)) - 1
    return Symbols(name, s.start[first], s.end[last], know_start, know_end, s.row[first])


def name_runs(s: Symbols) -> Symbols:
    """Each maximal run of one name becomes a symbol; a run of one keeps its name. A run knows the symbols beside it."""
    n = len(s.name)
    new = np.ones(n, bool)
    new[1:] = (s.name[1:] != s.name[:-1]) | (s.row[1:] != s.row[:-1])
    first = np.nonzero(new)[0]
    last = np.append(first[1:], n) - 1
    size = last - first + 1
    name = np.where(size > 1, mix(s.name[first] + size.astype(U64) * _PAIR[0]), s.name[first])
    know_start, know_end = _beside(s, first, last)
    return _grouped(s, first, name, know_start, know_end)


def _beside(s: Symbols, first: np.ndarray, last: np.ndarray):
    """Known words from the symbol before to the one behind; at the text's border one word that no window holds."""
    n = len(s.name)
    before, behind = np.maximum(first - 1, 0), np.minimum(last + 1, n - 1)
    has_before, has_behind = (first > 0) & (s.row[before] == s.row[first]), (last < n - 1) & (s.row[behind] == s.row[last])
    return np.where(has_before, s.know_start[before], s.start[first] - 1), np.where(has_behind, s.know_end[behind], s.end[last] + 1)


def name_pairs(s: Symbols, level: int) -> Symbols:
    """Pairs of a left-half name and a right-half name become symbols; a lone one knows the neighbour it could not join."""
    n = len(s.name)
    side = np.array(_PAIR[1:2]) * U64(2 * level + 1)  # an array, in which products wrap without a warning
    right = (mix(s.name ^ side) & U64(1)).astype(bool)
    joins = np.zeros(n, bool)  # with the symbol behind
    joins[:-1] = ~right[:-1] & right[1:] & (s.row[1:] == s.row[:-1])
    second = np.zeros(n, bool)
    second[1:] = joins[:-1]
    first = np.nonzero(~second)[0]
    pair = joins[first]
    last = first + pair
    name = s.name[first].copy()
    name[pair] = mix(s.name[first[pair]] * _PAIR[2] + mix(s.name[last[pair]] + _PAIR[3]))
    near_start, near_end = _beside(s, first, last)
    lone_right = right[first]
    know_start = np.where(pair | ~lone_right, s.know_start[first], np.minimum(near_start, s.know_start[first]))
    know_end = np.where(pair | lone_right, s.know_end[last], np.maximum(near_end, s.know_end[last]))
    return _grouped(s, first, name, know_start, know_end)


def _word_hashes(data: np.ndarray, offsets: np.ndarray):
    starts, ends, row = word_spans(data, offsets)
    return (Rolling(data).of(starts, ends) if len(starts) else np.empty(0, U64)), row


def word_anchors(length: int, data: np.ndarray, offsets: np.ndarray):
    """Anchors of all windows of the rows: (row, pos, lo, hi, gram hash, context hash); pos counts words of the row."""
    none = np.empty(0, np.int64)
    words, row = _word_hashes(data, offsets)
    n = len(words)
    if n < length:
        return none, none, none, none, none.astype(U64), none.astype(U64)
    place = np.arange(n)
    level = Symbols(words, place, place + 1, place, place + 1, row)
    levels = [level, name_runs(level)]
    for k in range(ROUNDS):
        levels.append(name_pairs(levels[-1], k))
    # Every window takes the least key: highest level, then a hash of the name, then the leftmost place. Words come last of all.
    bits = max(24, int(n).bit_length())
    best = np.full(n - length + 1, np.iinfo(np.uint64).max, U64)
    for k, s in enumerate(levels):
        fits = (s.know_end - s.know_start <= length) & (s.know_start >= 0) & (s.know_end <= n)
        if k > 1:  # a symbol that no pair has changed was offered a level below already, with no more to know
            fits &= s.end - s.start > 1
        at = np.nonzero(fits)[0]
        start, end, left = s.know_start[at], s.know_end[at], s.start[at]
        rank = (mix(s.name[at]) >> U64(bits + 3)) << U64(bits) | left.astype(U64) | U64(len(levels) - 1 - k) << U64(61)
        for shift in range(length):
            window = start - shift
            ok = (window >= 0) & (end <= window + length) & (window < len(best))
            np.minimum.at(best, window[ok], rank[ok])
    window = np.nonzero(row[: n - length + 1] == row[length - 1 :])[0]
    key = best[window]
    new = np.ones(len(window), bool)
    new[1:] = (key[1:] != key[:-1]) | (window[1:] != window[:-1] + 1)
    firsts = np.nonzero(new)[0]
    if not len(firsts):
        return none, none, none, none, none.astype(U64), none.astype(U64)
    lasts = np.append(firsts[1:], len(window)) - 1
    chosen = key[firsts]
    pos = (chosen & U64((1 << bits) - 1)).astype(np.int64)
    depth = len(levels) - 1 - (chosen >> U64(61)).astype(np.int64)
    first, last = window[firsts], window[lasts]
    gram, know_start, know_end = np.empty(len(pos), U64), pos.copy(), pos + 1
    for k, s in enumerate(levels):
        mine = np.nonzero(depth == k)[0]
        i = np.searchsorted(s.start, pos[mine])
        gram[mine], know_start[mine], know_end[mine] = s.name[i], s.know_start[i], s.know_end[i]
    roll = Rolling(words)
    # The name together with the words it knows: both are the same in equal windows.
    gram = mix(gram ^ mix(roll.of(know_start, know_end)) ^ (depth.astype(U64) << U64(60)))
    base = np.searchsorted(row, np.arange(len(offsets) - 1))
    own = row[pos]
    lo, hi = pos - first, pos - last
    context = content_digests(words, first, last + length)
    return own, pos - base[own], lo, hi, gram, mix(context ^ mix((lo.astype(U64) << U64(32)) ^ hi.astype(U64)))


def word_windows(length: int, text: bytes, starts: np.ndarray) -> np.ndarray:
    words, _ = _word_hashes(np.frombuffer(text, np.uint8), np.array([0, len(text)], np.int64))
    return Rolling(words).of(starts, starts + length)


def word_unit(length: int) -> Unit:
    return Unit(length, "smaller", SLICE_BYTES, partial(word_anchors, length), partial(word_windows, length))


def word_repeats(docs: DataFrame, length: int = 13, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_words, n_removed, kept_sha256, kept: the remaining words joined by single spaces) of every row."""
    spans = find_repeats(docs, word_unit(length), id_col, text)
    met = packed_texts(docs, id_col, text).join(spans, ["doc", "key"], "left").select("doc", "packed", "spans")

    def finish(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            out = {"id": [], "n_words": [], "n_removed": [], "kept_sha256": [], "kept": []}
            for doc, packed, spans in zip(*(c.to_pylist() for c in batch.columns)):
                words = unpack.decompress(packed).split()
                kept, at = [], 0
                for a, b in merged(spans) if doc != NO_ID else []:
                    kept += words[at:a]
                    at = b
                kept = b" ".join(kept + words[at:] if at else words)
                n_removed = sum(b - a for a, b in merged(spans)) if doc != NO_ID else 0
                for name, value in zip(out, (None if doc == NO_ID else doc, len(words), n_removed, hashlib.sha256(kept).hexdigest(), kept.decode())):
                    out[name].append(value)
            kinds = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string()), ("kept", pa.string())])
            yield pa.RecordBatch.from_pydict(out, schema=kinds)

    return met.mapInArrow(finish, "id long, n_words long, n_removed long, kept_sha256 string, kept string").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return word_repeats(read_table(spark, sf_dir, "documents")).drop("kept")
