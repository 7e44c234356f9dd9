"""SentencePiece encoding and decoding by vectorised merge rounds over flat symbol arrays.

The vocabulary comes from a public .model file (its path is a parameter). Texts are cut before each run of spaces, where no piece
can reach across; each distinct word of a batch is encoded once. Its symbols lie in flat numpy arrays: a round takes, by a segmented
minimum, the best pair rank of each word, merges that pair's places from the left all at once, and compacts the arrays; words
without a pair leave. A place whose merge makes a pair that is as good or better ("hot") ends its word's round, so that
the order of merges is that of the library. Words that are not through after ROUNDS rounds (very long ones) are finished with
a heap. Decoding joins the pieces' strings and takes off the space that encoding put in front.

Defined cases: a null or empty text has only the begin and end ids and decodes to the empty text; every row, repeated or not, gives
one row; an empty table gives an empty result; only the id and text columns are read, whatever the others are called. Texts are
never cut short; a text of any length is worked on by itself, in memory that grows with its length.
"""

from __future__ import annotations

import codecs
import hashlib
import heapq

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
from pyspark.sql import DataFrame

from .common import named, release_memory, slices, text_buffers, wide_arrow

SLICE_BYTES = 8 << 20
#: Rounds after which the words left are merged one by one with a heap.
ROUNDS = 48
#: Words of more symbols are also cut between characters that no piece holds side by side.
LONG_WORD = 64
SPACE = "▁"
_NONE = np.iinfo(np.int32).max


def _fields(raw: bytes):
    """(number, value) of each field of a protocol-buffer message; only the wire types that model files use."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            byte = raw[at]
            at += 1
            out |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return out

    while at < len(raw):
        key = number()
        kind = key & 7
        if kind == 0:
            yield key >> 3, number()
        else:
            size = number() if kind == 2 else 4 if kind == 5 else 8
            yield key >> 3, raw[at : at + size]
            at += size


def _one_by_one(error):
    return "�" * (error.end - error.start), error.end


codecs.register_error("each_byte", _one_by_one)


class PairTable:
    """Pairs of symbols to slots by open addressing; lookups are a few gathers for whole arrays."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.bits = max(8, int(4 * len(left)).bit_length())
        self.keys = np.full(1 << self.bits, -1, np.int64)
        self.slots = np.full(1 << self.bits, -1, np.int32)
        keys = self._key(left, right)
        todo, at = np.arange(len(keys)), self._hash(keys)
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]
            mine = self.keys[at] == keys[todo]
            self.slots[at[mine]] = todo[mine]
            todo, at = todo[~mine], (at[~mine] + 1) & (len(self.keys) - 1)

    @staticmethod
    def _key(left: np.ndarray, right: np.ndarray) -> np.ndarray:
        return left.astype(np.int64) << 32 | right.astype(np.int64)

    def _hash(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The slot of each pair, -1 where there is none."""
        keys = self._key(left, right)
        at = self._hash(keys)
        have = self.keys[at]
        out = np.where(have == keys, self.slots[at], np.int32(-1))
        more = np.nonzero((have != keys) & (have != -1))[0]
        while len(more):
            at[more] = (at[more] + 1) & (len(self.keys) - 1)
            have = self.keys[at[more]]
            hit = have == keys[more]
            out[more[hit]] = self.slots[at[more[hit]]]
            more = more[~hit & (have != -1)]
        return out


class PieceEncoder:
    """Encoder and decoder for a BPE .model file with identity normalisation, a space in front and byte fallback."""

    def __init__(self, path: str):
        lib = sentencepiece.SentencePieceProcessor(model_file=path)
        spec = dict(_fields(lib.serialized_model_proto()))
        trainer, rules = dict(_fields(spec[2])), dict(_fields(spec[3]))
        n = lib.get_piece_size()
        plain = [i for i in range(n) if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))]
        pieces = {lib.id_to_piece(i): i for i in plain}
        inner = any(SPACE in p.lstrip(SPACE) for p in pieces) or any(p.startswith(SPACE * 2) and p.strip(SPACE) for p in pieces)
        settled = trainer.get(3) == 2 and not trainer.get(24) and rules.get(1) == b"identity" and rules.get(3, 1) and not rules.get(4, 1) and rules.get(5, 1)
        if not settled or inner or any(lib.is_unused(i) for i in plain) or sum(lib.is_byte(i) for i in range(n)) != 256 or 30 in trainer or 31 in trainer:
            raise ValueError(f"{path}: this encoder reads BPE models with identity normalisation and byte fallback only")
        self.begin, self.end, self.unknown = lib.bos_id(), lib.eos_id(), lib.unk_id()
        self.bytes = np.array([lib.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        # Symbols are piece ids; a character that is no piece of its own is n plus its code point.
        self.n = n
        self.symbol = np.arange(n, n + 0x110000, dtype=np.int32)
        for p, i in pieces.items():
            if len(p) == 1:
                self.symbol[ord(p)] = i
        self.symbol[32] = self.symbol[ord(SPACE)]
        number = lambda s: pieces.get(s, n + ord(s) if len(s) == 1 else -1)
        halves = [(number(p[:k]), number(p[k:]), i) for p, i in pieces.items() for k in range(1, len(p))]
        left, right, self.result = (np.array(x, np.int32) for x in zip(*[h for h in halves if h[0] >= 0 and h[1] >= 0], strict=True))
        self.pairs = PairTable(left, right)
        scores = np.array([lib.get_score(i) for i in range(n)])
        # The last entry, reached by slot -1, is the rank of no pair.
        self.rank = np.append(np.unique(-scores[self.result], return_inverse=True)[1], _NONE).astype(np.int32)
        beside = sorted({(p[k], p[k + 1]) for p in pieces for k in range(len(p) - 1)})
        self.beside = PairTable(*(self.symbol[[ord(x[k]) for x in beside]] for k in (0, 1)))
        strings = [b""] * n
        for p, i in pieces.items():
            strings[i] = p.replace(SPACE, " ").encode()
        for b, i in enumerate(self.bytes.tolist()):
            strings[i] = bytes([b])
        if self.unknown >= 0:
            strings[self.unknown] = " ⁇ ".encode()
        self.strings = pa.array(strings, pa.large_binary())
        self.spaced = {i for p, i in pieces.items() if p.startswith(SPACE)}
        most = max((len(p) for p in pieces if not p.strip(SPACE)), default=0)
        self.chunk = most if most > 1 and self._even(most, pieces[SPACE * most]) else 0

    def _even(self, most: int, piece: int) -> bool:
        """Whether a run of spaces gives its longest pieces first, so that a long run may be cut after each."""
        words = [b" " * k + t for t in (b"", b"a") for k in range(2 * most, 4 * most)]
        ids = self.encode_words(pa.array(words, pa.binary()))
        longer = self.encode_words(pa.array([b" " * most + w for w in words], pa.binary()))
        cut = lambda x: np.split(x[0], np.cumsum(x[1])[:-1])
        return all(b.tolist() == [piece, *a.tolist()] for a, b in zip(cut(ids), cut(longer)))

    def _one(self, symbols: list[int]) -> list[int]:
        """A word's merges one by one: the best rank first, the leftmost among equals."""
        n, find = len(symbols), lambda a, b: int(self.pairs.find(np.array([a]), np.array([b]))[0])
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        slots = self.pairs.find(np.array(symbols[:-1]), np.array(symbols[1:])).tolist()
        queue = [(int(self.rank[s]), i, s, symbols[i], symbols[i + 1]) for i, s in enumerate(slots) if s >= 0]
        heapq.heapify(queue)
        known: dict[tuple[int, int], int] = {}

        def push(i: int, j: int) -> None:
            pair = symbols[i], symbols[j]
            if (s := known.get(pair)) is None:
                s = known[pair] = find(*pair)
            if s >= 0:
                heapq.heappush(queue, (int(self.rank[s]), i, s, *pair))

        while queue:
            _, i, s, a, b = heapq.heappop(queue)
            j = after[i]
            if j >= n or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], symbols[j] = int(self.result[s]), -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                push(i, k)
            if before[i] >= 0:
                push(before[i], i)
        return [s for s in symbols if s >= 0]

    def _merged(self, sym: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Symbols and their words after all merges; words must not decrease."""
        out: list[tuple[np.ndarray, np.ndarray]] = []
        slot = np.full(len(sym), -1, np.int32)
        if len(sym) > 1:
            slot[:-1] = self.pairs.find(sym[:-1], sym[1:])
            slot[:-1][word[1:] != word[:-1]] = -1
        for _ in range(ROUNDS):
            if not len(sym):
                break
            rank = self.rank[slot]
            new = np.ones(len(word), bool)
            new[1:] = word[1:] != word[:-1]
            starts = np.nonzero(new)[0]
            of = np.cumsum(new) - 1
            best = np.minimum.reduceat(rank, starts)
            through = best == _NONE
            if through.any():
                gone = through[of]
                out.append((sym[gone], word[gone]))
                stay = ~gone
                sym, word, slot, rank, of = sym[stay], word[stay], slot[stay], rank[stay], (np.cumsum(~through) - 1)[of[stay]]
                best = best[~through]
                if not len(sym):
                    break
            # Places of the best rank; of those that overlap one another, every second one from the left.
            place = rank == best[of]
            at = np.arange(len(sym))
            first = place.copy()
            first[1:] &= ~place[:-1]
            take = place & ((at - np.maximum.accumulate(np.where(first, at, 0))) % 2 == 0)
            t = np.nonzero(take)[0]
            many = np.bincount(of[t], minlength=len(best)) > 1
            if many.any():
                t = t[self._in_turn(t, sym, word, slot, take, rank, of, many)]
            keep = np.ones(len(sym), bool)
            keep[t + 1] = False
            sym[t] = self.result[slot[t]]
            fresh = np.zeros(len(sym), bool)
            fresh[t] = True
            sym, word, slot, fresh = sym[keep], word[keep], slot[keep], fresh[keep]
            fresh[:-1] |= fresh[1:]
            f = np.nonzero(fresh)[0]
            last = f == len(sym) - 1
            slot[f[last]] = -1
            f = f[~last]
            slot[f] = np.where(word[f] == word[f + 1], self.pairs.find(sym[f], sym[f + 1]), -1)
        if len(sym):
            cuts = np.nonzero(word[1:] != word[:-1])[0] + 1
            for s, w in zip(np.split(sym, cuts), np.split(word, cuts)):
                ids = np.array(self._one(s.tolist()), np.int32)
                out.append((ids, np.full(len(ids), w[0], word.dtype)))
        if not out:
            return sym, word
        sym, word = (np.concatenate(x) for x in zip(*out))
        order = np.argsort(word, kind="stable")
        return sym[order], word[order]

    def _in_turn(self, t, sym, word, slot, take, rank, of, many) -> np.ndarray:
        """Which of the places t may be merged at once: in words with several, those up to the first that makes a pair as good."""
        some = np.nonzero(many[of[t]])[0]
        p = t[some]
        made = self.result[slot[p]]
        left, right = p - 1, p + 2
        has_left = (left >= 0) & (word[np.maximum(left, 0)] == word[p])
        has_right = right < len(sym)
        right = np.minimum(right, len(sym) - 1)
        has_right &= word[right] == word[p]
        two = np.maximum(p - 2, 0)
        beside = np.where(take[two] & (p >= 2), self.result[slot[two]], sym[np.maximum(left, 0)])
        hot = has_left & (self.rank[self.pairs.find(beside, made)] <= rank[p])
        hot |= has_right & (self.rank[self.pairs.find(made, sym[right])] <= rank[p])
        before = np.cumsum(hot) - hot
        group = of[p]
        start = np.ones(len(p), bool)
        start[1:] = group[1:] != group[:-1]
        base = before[np.maximum.accumulate(np.where(start, np.arange(len(p)), 0))]
        ok = np.ones(len(t), bool)
        ok[some] = before == base
        return ok

    def encode_words(self, words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all words end to end, and how many each has. Words are UTF-8, at least one byte each, spaces standing for the mark."""
        data, offsets = text_buffers(words)
        points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
        if len(points) != len(data):
            offsets = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
        sym = self.symbol[points]
        word = np.repeat(np.arange(len(words), dtype=np.int32), np.diff(offsets))
        part = word
        if (np.diff(offsets) > LONG_WORD).any():
            cut = np.zeros(len(sym), bool)
            cut[offsets[:-1]] = True
            far = np.nonzero((np.diff(offsets) > LONG_WORD)[word[1:]] & ~cut[1:])[0]
            cut[far + 1] = self.beside.find(sym[far], sym[far + 1]) < 0
            part = np.cumsum(cut, dtype=np.int32) - 1
            word = word[cut]
            sym, part = self._merged(sym, part)
            word = word[part]
        else:
            sym, word = self._merged(sym, word)
        wide = np.nonzero(sym >= self.n)[0]
        if len(wide):  # characters without a piece give their bytes
            raw = [chr(c).encode() for c in (sym[wide] - self.n).tolist()]
            copies = np.ones(len(sym), np.int64)
            copies[wide] = [len(x) for x in raw]
            where = np.repeat(sym >= self.n, copies)
            sym, word = np.repeat(sym, copies), np.repeat(word, copies)
            sym[where] = self.bytes[np.frombuffer(b"".join(raw), np.uint8)]
        return sym, np.bincount(word, minlength=len(words))

    def decode(self, ids: list[int]) -> str:
        """The text of any ids; begin and end ids give nothing, bytes that are no UTF-8 one replacement character each."""
        # Begin and end ids separate bytes: those before and behind one make no character together.
        silent = [-1, *(k for k, i in enumerate(ids) if i in (self.begin, self.end)), len(ids)]
        spans = [self.strings.take(pa.array(ids[a + 1 : b], pa.int32())).to_pylist() for a, b in zip(silent, silent[1:])]
        text = "".join(b"".join(x).decode("utf-8", "each_byte") for x in spans)
        shown = [i for i in ids if i not in (self.begin, self.end)]
        return text[1:] if shown and shown[0] in self.spaced else text

    def encode_texts(self, texts: pa.Array):
        """Little-endian 32-bit ids (without begin and end) and the text decoded from them, both as bytes, of each text."""
        texts = wide_arrow(texts).cast(pa.large_string()).fill_null("")
        _, sizes = text_buffers(texts)
        for i, j in slices(sizes, SLICE_BYTES):
            part = pc.replace_substring(texts.slice(i, j - i), SPACE, " ")
            part = pc.if_else(pc.equal(pc.binary_length(part), 0), part, pc.binary_join_element_wise(pa.scalar(" ", pa.large_string()), part, pa.scalar("", pa.large_string())))
            data, offsets = text_buffers(part)
            if not len(data):
                yield from ((b"", b"") for _ in range(j - i))
                continue
            space = data == 32
            start = space.copy()
            start[1:] &= ~space[:-1]
            start[offsets[:-1][offsets[:-1] < len(data)]] = True
            starts = np.nonzero(start)[0]
            if self.chunk:
                ends = np.append(starts[1:], len(data))
                # Of a long run of spaces, whole longest pieces are cut off while two of them are left.
                far = np.nonzero((ends - starts > 3 * self.chunk) & space[np.minimum(starts + 3 * self.chunk, len(data) - 1)])[0]
                for s, e in zip(starts[far].tolist(), ends[far].tolist()):
                    run = e - s if (full := space[s:e]).all() else int(np.argmin(full))
                    start[s : s + max(0, run - 2 * self.chunk) : self.chunk] = True
                starts = np.nonzero(start)[0]
            bounds = np.append(starts, len(data))
            words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(bounds), pa.py_buffer(data)])
            table = words.dictionary_encode()
            codes = table.indices
            ids, counts = self.encode_words(table.dictionary)
            ends = np.concatenate([[0], np.cumsum(counts)]).astype(np.int64)
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(4 * ends), pa.py_buffer(ids.astype("<i4"))])
            strings, lengths = text_buffers(self.strings.take(pa.array(ids)))
            plain = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(counts), [None, pa.py_buffer(lengths[ends]), pa.py_buffer(strings)])
            rows = np.searchsorted(starts, offsets)
            ids_raw, ids_at = text_buffers(packed.take(codes))
            text_raw, text_at = text_buffers(plain.take(codes))
            ids_view, text_view = memoryview(ids_raw), memoryview(text_raw)
            a, b = ids_at[rows].tolist(), text_at[rows].tolist()
            for k in range(j - i):
                own = ids_view[a[k] : a[k + 1]]
                front = len(own) and int.from_bytes(own[:4], "little") in self.spaced
                yield own, text_view[b[k] + bool(front) : b[k + 1]]


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of a file, built once in each worker."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def piece_encode(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, ids array<int>, decoded string) for every row of docs, begin and end ids included; one pass without a shuffle."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = encoder(model_path)
        begin, end = (np.array([x], "<i4").tobytes() for x in (own.begin, own.end))
        for batch in batches:
            rows = [(begin + bytes(a) + end, bytes(b).decode()) for a, b in own.encode_texts(batch.column(1))]
            flat = np.frombuffer(b"".join(r[0] for r in rows), "<i4")
            ends = np.cumsum([0, *(len(r[0]) // 4 for r in rows)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat)), pa.array([r[1] for r in rows], pa.string())], ["id", "ids", "decoded"])
        release_memory()

    return docs.select(named(id_col).alias("id"), named(text).alias("text")).mapInArrow(run, f"id {id_type}, ids array<int>, decoded string").withColumnRenamed("id", id_col)


def piece_decode(rows: DataFrame, model_path: str, id_col: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(id, text string) of rows with arrays of ids; a null array gives the empty text."""
    id_type = rows.schema[id_col].dataType.simpleString()

    def run(batches):
        own = encoder(model_path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([own.decode(x or []) for x in batch.column(1).to_pylist()], pa.string())], ["id", "text"])

    return rows.select(named(id_col).alias("id"), named(ids).alias("ids")).mapInArrow(run, f"id {id_type}, text string").withColumnRenamed("id", id_col)


def piece_digests(docs: DataFrame, model_path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of piece_encode's outputs, taken in the worker that makes them."""
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches):
        own = encoder(model_path)
        begin, end = (np.array([x], "<i4").tobytes() for x in (own.begin, own.end))
        for batch in batches:
            n, ids_sha, plain_sha = [], [], []
            for ids, plain in own.encode_texts(batch.column(1)):
                n.append(len(ids) // 4 + 2)
                digest = hashlib.sha256(begin)
                digest.update(ids)
                digest.update(end)
                ids_sha.append(digest.hexdigest())
                plain_sha.append(hashlib.sha256(plain).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(plain_sha, pa.string())], ["id", "n_tokens", "ids_sha256", "decoded_sha256"])
        release_memory()

    return docs.select(named(id_col).alias("id"), named(text).alias("text")).mapInArrow(run, f"id {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read_table

    return piece_digests(read_table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
