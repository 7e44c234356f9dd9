"""Byte-pair encoding and decoding by a priority queue of merge ranks over a doubly linked symbol list.

The tables come from a public tokenizer file (its path is a parameter). Texts are cut at ASCII white space; each distinct
piece is encoded once: special strings are split off, the rest is normalised, cut by the file's pattern, mapped to byte
symbols and merged. A merge pops the lowest rank (leftmost first), skips entries whose symbols have changed since, links
the neighbours anew and pushes the two new pairs. Decoding concatenates vocabulary strings as the file's decoder says.

Defined cases: a null or empty text has no ids and decodes to the empty text; every row, repeated or not, gives one row;
an empty table gives an empty result; only the id and text columns are read. Texts are never cut short.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import struct
import unicodedata

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from tokenizers import Tokenizer

from .common import release_memory, slices, wide_arrow

SLICE_BYTES = 4 << 20
#: Distinct pieces whose encodings a worker keeps.
CACHE_PIECES = 200_000


def byte_symbols() -> list[str]:
    """The printable stand-in of each byte: itself where printable, else the next free code point from 256 on."""
    shown = {*range(33, 127), *range(161, 173), *range(174, 256)}
    hidden = [b for b in range(256) if b not in shown]
    stand_in = {b: chr(256 + k) for k, b in enumerate(hidden)}
    return [stand_in.get(b, chr(b)) for b in range(256)]


class PairEncoder:
    """Encoder and decoder for a word-end byte BPE file with NFC, lower-case and a Split pattern."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        cuts = spec["pre_tokenizer"]["pretokenizers"]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in cuts] != ["Split", "ByteLevel"] or spec["decoder"] is not None:
            raise ValueError(f"{path}: this encoder reads word-end byte BPE files only")
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model["end_of_word_suffix"] or ""
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.strings = {i: s for s, i in self.vocab.items()} | {i: s for s, i in self.special.items()}
        self.split_special = regex.compile("(" + "|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.pattern = regex.compile(cuts[0]["pattern"]["Regex"])
        self.rules = Tokenizer.from_file(path)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        symbols = byte_symbols()
        self.byte_of = {s: b for b, s in enumerate(symbols)}
        self.inner = [self.vocab.get(s, -1) for s in symbols]
        self.last = [self.vocab.get(s + self.end, -1) for s in symbols]
        self.words: dict[bytes, list[int]] = {}
        self.pieces: dict[str, tuple[bytes, bytes]] = {"": (b"", b"")}

    def forget(self) -> None:
        """Drop the encodings met so far: a worker outlives its task and must not keep them while others run in it."""
        self.words.clear()
        self.pieces = {"": (b"", b"")}
        release_memory()

    def merge(self, symbols: list[int]) -> list[int]:
        """Apply the merges to a word's symbols."""
        n, merges = len(symbols), self.merges
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        queue = []
        for i in range(n - 1):
            pair = (symbols[i], symbols[i + 1])
            if pair in merges:
                queue.append((merges[pair][0], i, pair))
        heapq.heapify(queue)
        while queue:
            _, i, pair = heapq.heappop(queue)
            j = after[i]
            if j >= n or symbols[i] != pair[0] or symbols[j] != pair[1]:
                continue  # stale: one side was merged meanwhile
            symbols[i], symbols[j] = merges[pair][1], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                new = (symbols[i], symbols[k])
                if new in merges:
                    heapq.heappush(queue, (merges[new][0], i, new))
            h = before[i]
            if h >= 0:
                new = (symbols[h], symbols[i])
                if new in merges:
                    heapq.heappush(queue, (merges[new][0], h, new))
        return [s for s in symbols if s >= 0]

    def word(self, raw: bytes) -> list[int]:
        if raw in self.words:
            return self.words[raw]
        inner = self.inner
        symbols = [inner[b] for b in raw]
        symbols[-1] = self.last[raw[-1]]
        if -1 in symbols:
            symbols = [s for s in symbols if s >= 0]
        if len(self.words) > CACHE_PIECES:
            self.words.clear()
        ids = self.words[raw] = self.merge(symbols)
        return ids

    def cut(self, text: str) -> list[bytes]:
        """The normalised words of a text. Beyond U+052F, where Unicode versions differ, the file's own rules cut it."""
        if text.isascii():
            return [w.encode() for w in self.pattern.findall(text.lower())]
        if max(text) < "\u0530":
            # Code points are lowered one by one, so a final sigma has no form of its own.
            return [w.encode() for w in self.pattern.findall(unicodedata.normalize("NFC", text).replace("Σ", "σ").lower())]
        shown = self.rules.pre_tokenizer.pre_tokenize_str(self.rules.normalizer.normalize_str(text))
        return [bytes([self.byte_of[c] for c in w]) for w, _ in shown]

    def encode(self, text: str) -> list[int]:
        """Ids of a text, without added special tokens; special strings in the text give their ids."""
        ids: list[int] = []
        for part in self.split_special.split(text) if self.split_special and any(x in text for x in self.special) else [text]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                for word in self.cut(part):
                    ids += self.word(word)
        return ids

    def decode(self, ids: list[int]) -> str:
        """The vocabulary strings of the ids joined by spaces, as a file without decoder asks for."""
        return " ".join([self.strings[i] for i in ids])

    def piece(self, text: str) -> tuple[bytes, bytes]:
        """Little-endian 32-bit ids of a piece without white space, and its decoded text."""
        if text not in self.pieces:
            if len(self.pieces) > CACHE_PIECES:
                self.pieces.clear()
            ids = self.encode(text)
            self.pieces[text] = (struct.pack(f"<{len(ids)}I", *ids), self.decode(ids).encode())
        return self.pieces[text]


_ENCODERS: dict[str, PairEncoder] = {}


def encoder(path: str) -> PairEncoder:
    """The encoder of a file, built once in each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PairEncoder(path)
    return _ENCODERS[path]


def encoded_texts(texts: pa.Array, own: PairEncoder):
    """Ids as bytes and the decoded text, as bytes, of each text of a column."""
    texts = texts.fill_null("")
    offsets = np.concatenate([[0], np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False))]).astype(np.int64)
    for i, j in slices(offsets, SLICE_BYTES):
        pieces = pc.ascii_split_whitespace(texts.slice(i, j - i))
        table = wide_arrow(pieces.flatten()).dictionary_encode()
        known = [own.piece(x) for x in table.dictionary.to_pylist()]
        ids, plain = [k[0] for k in known], [k[1] for k in known]
        codes = table.indices.to_numpy(zero_copy_only=False)
        ends = np.cumsum(pc.list_value_length(pieces).to_numpy(zero_copy_only=False)).tolist()
        start = 0
        for end in ends:
            mine = codes[start:end].tolist()
            start = end
            yield b"".join([ids[c] for c in mine]), b" ".join([plain[c] for c in mine if plain[c]])


def bpe_encode(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for every row of docs; one pass without a shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = encoder(vocab_path)
        for batch in batches:
            rows = list(encoded_texts(batch.column(1), own))
            flat = np.frombuffer(b"".join(r[0] for r in rows), "<u4").astype(np.int32)
            ends = np.concatenate([[0], np.cumsum([len(r[0]) // 4 for r in rows])]).astype(np.int32)
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "ids": pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), "decoded": pa.array([r[1].decode() for r in rows], pa.string())})
        own.forget()

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {id_type}, ids array<int>, decoded string")


def bpe_digests(docs: DataFrame, vocab_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of bpe_encode's outputs, taken in the worker that makes them."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = encoder(vocab_path)
        for batch in batches:
            n, ids_sha, plain_sha = [], [], []
            for ids, plain in encoded_texts(batch.column(1), own):
                n.append(len(ids) // 4)
                ids_sha.append(hashlib.sha256(ids).hexdigest())
                plain_sha.append(hashlib.sha256(plain).hexdigest())
            yield pa.RecordBatch.from_pydict({id_col: batch.column(0), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(ids_sha, pa.string()), "decoded_sha256": pa.array(plain_sha, pa.string())})
        own.forget()

    return docs.select(id_col, text).mapInArrow(run, f"{id_col} {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string")


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read_table

    return bpe_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
