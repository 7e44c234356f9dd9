"""Token counts through a digest cache: texts are keyed by digest, stored counts are joined, only distinct misses are encoded.

The cache is a Parquet folder of (content digest, tokenizer digest, n_tokens). The tokenizer digest covers the file's
bytes and the library's name and version, so a new version never meets old counts. Content is normalised as the tokenizer
itself does before the digest, if it has a normaliser and no added token's string occurs in the text, where what surrounds it would be
normalised apart; a byte-level file has none, and its texts are digested as they are. Misses are deduplicated inside each scan task, shuffled
compressed by digest, encoded once and appended; the documents then take their counts by a join of small rows.

A miss is cut just before ASCII white space that follows other text, where no token of the pattern can span, and each
distinct segment is given to the tokenizer library once; texts with other kinds of white space go to it whole.

Defined cases: a null or empty text has 0 tokens; repeated rows give repeated counts; an empty table gives an empty
result and leaves the cache as it is; only the id and text columns are read. Texts are never cut short.
"""

from __future__ import annotations

import hashlib
import os

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import distinct, named, release_memory, shared_folder, slices, staged, text_buffers, word_spans

SLICE_BYTES = 4 << 20
#: Distinct segments whose counts a worker keeps, and distinct digests a scan task keeps to drop copies early.
CACHE_SEGMENTS, SEEN_DIGESTS = 1_000_000, 500_000
CACHE_SCHEMA = "digest binary, tokenizer string, n_tokens long"
#: Bytes of UTF-8 that can belong to white space beyond the six ASCII kinds: alone, or with one of the bytes after them.
_ODD = np.isin(np.arange(256), [*range(0x1C, 0x20), 0xC2, 0xE1, 0xE2, 0xE3, 0xEF])
_ODD_NEXT = np.ones((256, 256), bool)
for _lead, _next in ((0xC2, (0x85, 0xA0)), (0xE2, (0x80, 0x81)), (0xE3, (0x80,))):
    _ODD_NEXT[_lead] = np.isin(np.arange(256), _next)


def odd_rows(data: np.ndarray, offsets: np.ndarray) -> list[int]:
    """Rows that may hold white space at which segments must not be cut."""
    at = np.nonzero(_ODD[data])[0]
    at = at[_ODD_NEXT[data[at], data[np.minimum(at + 1, len(data) - 1)]]]
    return distinct(np.searchsorted(offsets, at, side="right") - 1).tolist()


def tokenizer_digest(path: str) -> str:
    import sentencepiece
    import tokenizers

    lib = f"sentencepiece {sentencepiece.__version__}" if path.endswith(".model") else f"tokenizers {tokenizers.__version__}"
    with open(path, "rb") as f:
        return hashlib.sha256(lib.encode() + b"\n" + f.read()).hexdigest()


class Counter:
    """Counts tokens as the library for a file does, without begin, end or added special tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.segments: dict[str, int] = {}
        self.normalizer, self.added = None, []
        if path.endswith(".model"):
            import sentencepiece

            own = sentencepiece.SentencePieceProcessor(model_file=path)
            self.library, self.segmented = lambda texts: [len(x) for x in own.encode(texts, num_threads=1)], False
        else:
            from tokenizers import Tokenizer

            own = Tokenizer.from_file(path)
            own.no_truncation()
            own.no_padding()
            self.library = lambda texts: [len(x) for x in own.encode_batch_fast(texts, add_special_tokens=False)]
            kind = own.pre_tokenizer.__class__.__name__
            self.segmented = own.normalizer is None and kind == "ByteLevel" and not own.pre_tokenizer.add_prefix_space
            if own.normalizer is not None:
                self.normalizer, self.added = own.normalizer, [x.content for x in own.get_added_tokens_decoder().values()]

    def digest(self, text: bytes) -> bytes:
        """Texts of one digest have one count."""
        if self.normalizer is None:
            return hashlib.sha256(text).digest()
        own = text.decode()
        if any(x in own for x in self.added):
            return hashlib.sha256(b"as it is\0" + text).digest()
        return hashlib.sha256(b"normalised\0" + self.normalizer.normalize_str(own).encode()).digest()

    def of(self, texts: pa.Array) -> np.ndarray:
        if not self.segmented:
            return np.array(self.library([x or "" for x in texts.to_pylist()]), np.int64)
        data, offsets = text_buffers(texts)
        out = [self._slice(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in slices(offsets, SLICE_BYTES)]
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def _slice(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        n = len(offsets) - 1
        raw = data.tobytes()
        odd = odd_rows(data, offsets)
        _, ends, _ = word_spans(data, offsets)
        cuts = distinct(np.concatenate([ends, offsets])).astype(np.int32)
        if len(cuts) < 2:
            return np.zeros(n, np.int64)
        whole = pa.StringArray.from_buffers(len(cuts) - 1, pa.py_buffer(cuts.tobytes()), pa.py_buffer(raw))
        table = whole.dictionary_encode()
        segments = table.dictionary.to_pylist()
        if len(self.segments) > CACHE_SEGMENTS:
            self.segments.clear()
        missing = [x for x in segments if x not in self.segments]
        for k in range(0, len(missing), 5000):
            self.segments.update(zip(missing[k : k + 5000], self.library(missing[k : k + 5000])))
        size = np.fromiter(map(self.segments.__getitem__, segments), np.int64, len(segments))[table.indices.to_numpy(zero_copy_only=False)]
        total = np.concatenate([[0], np.cumsum(size)])
        counts = total[np.searchsorted(cuts, offsets[1:])] - total[np.searchsorted(cuts, offsets[:-1])]
        if odd:
            counts[odd] = self.library([raw[offsets[i] : offsets[i + 1]].decode() for i in odd])
        return counts


_COUNTERS: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    if path not in _COUNTERS:
        _COUNTERS[path] = Counter(path)
    return _COUNTERS[path]


def _first_copies(path: str):
    """(digest, compressed text) of each text that this task has not met before; the memory of digests is bounded."""

    def run(batches):
        pack, seen, own = zstandard.ZstdCompressor(level=1), set(), counter(path)
        for batch in batches:
            data, offsets = text_buffers(batch.column(0))
            raw, digests, packed = data.tobytes(), [], []
            for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                d = own.digest(raw[a:b])
                if d not in seen:
                    seen.add(d)
                    digests.append(d)
                    packed.append(pack.compress(raw[a:b]))
            if len(seen) > SEEN_DIGESTS:
                seen.clear()
            yield pa.RecordBatch.from_pydict({"digest": pa.array(digests, pa.binary()), "packed": pa.array(packed, pa.binary())})

    return run


def _digested(docs: DataFrame, path: str, id_col: str, text: str) -> DataFrame:
    """(id, n_bytes, digest) of every row; only a normaliser needs Python."""
    size = F.coalesce(F.octet_length(named(text)), F.lit(0)).cast("long").alias("n_bytes")
    whole = F.coalesce(named(text), F.lit(""))
    if counter(path).normalizer is None:
        return docs.select(named(id_col), size, F.unhex(F.sha2(whole.cast("binary"), 256)).alias("digest"))

    def run(batches):
        own = counter(path)
        for batch in batches:
            data, offsets = text_buffers(batch.column(2))
            raw, o = data.tobytes(), offsets.tolist()
            digests = [own.digest(raw[a:b]) for a, b in zip(o[:-1], o[1:])]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary())], names=[id_col, "n_bytes", "digest"])

    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(named(id_col).alias("id"), size, whole.alias("text")).mapInArrow(run, f"`{id_col}` {kind}, n_bytes long, digest binary")


def token_counts(docs: DataFrame, tokenizer_path: str, cache_path: str | None = None, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n_bytes, n_tokens) of every row; counts that cache_path lacks are encoded and appended to it.

    cache_path is a folder that outlives the call; without it the cache lives in the shared folder for this call alone.
    """
    spark = docs.sparkSession
    cache_path = cache_path or shared_folder(spark)
    version = tokenizer_digest(tokenizer_path)
    spark.createDataFrame([], CACHE_SCHEMA).write.mode("append").parquet(cache_path)

    def stored():  # read anew each time: files are listed when a table is opened
        mine = spark.read.schema(CACHE_SCHEMA).parquet(cache_path).where(F.col("tokenizer") == version)
        return mine.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))

    copies = docs.select(F.coalesce(named(text), F.lit("")).alias("text")).mapInArrow(_first_copies(tokenizer_path), "digest binary, packed binary")
    misses = copies.join(stored().select("digest"), "digest", "left_anti")

    def encode(batches):
        count, unpack, seen = counter(tokenizer_path), zstandard.ZstdDecompressor(), set()
        for batch in batches:
            fresh, texts, held = [], [], 0

            def done():
                return pa.RecordBatch.from_pydict({"digest": pa.array(fresh, pa.binary()), "tokenizer": pa.array([version] * len(fresh), pa.string()), "n_tokens": pa.array(count.of(pa.array(texts, pa.string())))})

            for d, packed in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if d not in seen:
                    seen.add(d)
                    fresh.append(d)
                    texts.append(unpack.decompress(packed).decode())
                    held += len(texts[-1])
                    if held > SLICE_BYTES:
                        yield done()
                        fresh, texts, held = [], [], 0
            if fresh:
                yield done()
        count.segments.clear()  # a worker outlives its task
        release_memory()

    misses.repartition("digest").mapInArrow(encode, CACHE_SCHEMA).write.mode("append").parquet(cache_path)
    # The counts are written first: a join of two plain exchanges is one whose hot digests the engine splits over tasks.
    return _digested(docs, tokenizer_path, id_col, text).join(staged(stored()), "digest").select(named(id_col), "n_bytes", "n_tokens")


#: Session setting that names the folder of the query's cache; unset, each call has its own.
CACHE_SETTING = "spark.tidewater.tokenCache"


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read_table

    counts = token_counts(read_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"), spark.conf.get(CACHE_SETTING, None))
    return counts.withColumn("over_limit", F.col("n_tokens") > 1024)
