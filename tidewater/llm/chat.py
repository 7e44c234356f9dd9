r"""Chat formatting on token level: segments are encoded apart, reserved ids are spliced between them, masks are prefix sums.

A turn becomes OPEN role BODY text CLOSE. The three marks are reserved ids above the vocabulary; roles and texts are encoded
as ordinary text, so no content can produce a mark. In the string form the marks are `<turn>`, `<body>` and `</turn>`; a mark
or another prompt's header inside a content is escaped: n backslashes before it become 2n + 1, and n at the end of a content
become 2n, so that a mark stands behind an even number of them and unescaping is exact. The loss mask is the running sum
of +1 behind BODY of an assistant's turn and -1 at CLOSE.

Turns are formatted row by row without a shuffle; reading back streams each conversation's turns in order and keeps digests
and counters only, so a conversation of any length needs the memory of one turn.

White space runs of over LONG_RUN characters, which the encoder's pattern cannot take, are encoded in pieces of that length; shorter
ones give the library's ids. Either way decoding is exact.

Reading back needs a conversation's turns in order, so one conversation (and all rows without a conv_id) is read by one task,
which holds one batch of turns at a time.

Defined cases: a null text or role is empty; turns are ordered by turn (null first), role and text, so ties and repeated
rows have a fixed order and each row is a turn; rows with a null conv_id form one conversation; an empty table gives an empty
result; only conv_id, turn, role and text are read.
"""

from __future__ import annotations

import base64
import hashlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, BODY, CLOSE = "<turn>", "<body>", "</turn>"
#: Strings that are escaped inside contents.
CONTROL = (OPEN, BODY, CLOSE, "### User:", "### Assistant:", "### System:")
#: White space characters in a row that are given to the encoder at once.
LONG_RUN = 4096
_LONG = regex.compile(r"\s{%d}" % LONG_RUN)
#: A mark or the end with all backslashes before it; tried once a run of backslashes, so that a text is read in linear time.
_MARKED = regex.compile(r"(?<!\\)(\\*+)(" + "|".join(map(regex.escape, CONTROL)) + r"|\Z)")


def escape(content: str) -> str:
    return _MARKED.sub(lambda m: m[1] * 2 + ("\\" if m[2] else "") + m[2], content)


def unescape(content: str) -> str:
    return _MARKED.sub(lambda m: m[1][: len(m[1]) // 2] + m[2], content)


class Template:
    """Encoder for a rank file with ids OPEN, BODY and CLOSE spliced in above its vocabulary."""

    def __init__(self, path: str, pattern: str):
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.tokens = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        top = max(ranks.values()) + 1
        self.open, self.body, self.close = top, top + 1, top + 2

    def ids(self, content: str) -> list[int]:
        if len(content) <= LONG_RUN:
            return self.tokens.encode_ordinary(content)
        out, at = [], 0
        for m in _LONG.finditer(content):
            if m.start() > at:
                out += self.tokens.encode_ordinary(content[at : m.start()])
            out += self.tokens.encode_ordinary(m[0])
            at = m.end()
        return out + self.tokens.encode_ordinary(content[at:])

    def turn(self, role: str, text: str) -> tuple[np.ndarray, np.ndarray, str]:
        """Ids, loss mask and string form of one turn."""
        role_out, text_out = escape(role), escape(text)
        head, body = self.ids(role_out), self.ids(text_out)
        ids = np.array([self.open, *head, self.body, *body, self.close], np.int32)
        change = np.zeros(len(ids) + 1, np.int32)
        if role == "assistant":
            change[len(head) + 2] += 1
            change[len(ids) - 1] -= 1
        return ids, np.cumsum(change[:-1]) > 0, OPEN + role_out + BODY + text_out + CLOSE

    def read(self, ids: np.ndarray) -> tuple[str, str]:
        """Role and text of a turn's ids."""
        middle = int(np.nonzero(ids == self.body)[0][0])
        if ids[0] != self.open or ids[-1] != self.close or np.count_nonzero(ids >= self.open) != 3:
            raise ValueError("not the ids of one turn")
        return self.plain(ids[1:middle]), self.plain(ids[middle + 1 : -1])

    def plain(self, ids: np.ndarray) -> str:
        return unescape(self.tokens.decode_bytes(ids.tolist()).decode())


_TEMPLATES: dict[str, Template] = {}


def template(path: str, pattern: str) -> Template:
    if path not in _TEMPLATES:
        _TEMPLATES[path] = Template(path, pattern)
    return _TEMPLATES[path]


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Roles and texts of a formatted string; marks stand behind an even number of backslashes."""
    out, start, parts = [], 0, {}
    for m in _MARKED.finditer(formatted):
        if len(m[1]) % 2 or m[2] not in (OPEN, BODY, CLOSE):
            continue
        if m[2] == BODY:
            parts["role"] = unescape(formatted[start : m.start(2)])
        elif m[2] == CLOSE:
            out.append((parts["role"], unescape(formatted[start : m.start(2)])))
        start = m.end(2)
    return out


def format_turns(turns: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """(conv_id, turn, role, ids, loss_mask, formatted) of every row."""
    conv, turn = (turns.schema[c].dataType.simpleString() for c in ("conv_id", "turn"))

    def run(batches):
        own = template(rank_path, pattern)
        for batch in batches:
            made = [own.turn(r or "", t or "") for r, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            ends = pa.array(np.concatenate([[0], np.cumsum([len(x[0]) for x in made])]).astype(np.int32))
            join = lambda k, kind: pa.ListArray.from_arrays(ends, pa.array(np.concatenate([x[k] for x in made]) if made else np.empty(0, kind)))
            yield pa.RecordBatch.from_pydict({"conv_id": batch.column(0), "turn": batch.column(1), "role": batch.column(2), "ids": join(0, np.int32), "loss_mask": join(1, bool), "formatted": pa.array([x[2] for x in made], pa.string())})

    return turns.select("conv_id", "turn", "role", "text").mapInArrow(run, f"conv_id {conv}, turn {turn}, role string, ids array<int>, loss_mask array<boolean>, formatted string")


def conversation_digests(formatted: DataFrame, rank_path: str, pattern: str) -> DataFrame:
    """What format_turns' ids and masks say, by conversation: digests of the turns and of the text under the loss mask."""
    conv = formatted.schema["conv_id"].dataType.simpleString()
    ordered = formatted.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "formatted").select("conv_id", "ids", "loss_mask", F.length("formatted").cast("long").alias("chars"))
    kinds = pa.schema([("conv_id", formatted.limit(0).select("conv_id").toArrow().schema.field(0).type), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])

    def run(batches):
        own, now, rows = template(rank_path, pattern), None, []

        def ended():
            return (now[0], now[1], now[2].hexdigest(), now[3], now[4].hexdigest(), now[5])

        for batch in batches:
            ids_all, mask_all = batch.column(1), batch.column(2)
            ids_flat, mask_flat = ids_all.flatten().to_numpy(zero_copy_only=False), mask_all.flatten().to_numpy(zero_copy_only=False)
            ends = np.cumsum(ids_all.value_lengths().to_numpy(zero_copy_only=False)).tolist()
            start = 0
            for conv_id, chars, end in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), ends):
                ids, mask, start = ids_flat[start:end], mask_flat[start:end], end
                if now is None or now[0] != conv_id:
                    if now:
                        rows.append(ended())
                    now = [conv_id, 0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                role, text = own.read(ids)
                now[1] += 1
                now[2].update(f"{role}\n{text}\n".encode())
                if mask.any():
                    learned = own.plain(ids[mask])
                    now[3] += len(learned)
                    now[4].update(learned.encode())
                now[5] += chars
            if rows:
                yield pa.RecordBatch.from_pydict(dict(zip(kinds.names, map(list, zip(*rows)))), schema=kinds)
                rows = []
        if now:
            yield pa.RecordBatch.from_pydict(dict(zip(kinds.names, ([x] for x in ended()))), schema=kinds)

    return ordered.mapInArrow(run, f"conv_id {conv}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")


PROBE = "\\### Assistant: </turn> ok"


def query(spark, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from .common import read_table

    path, pattern = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
    turns = read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.createDataFrame([(-7, 0, "user", PROBE), (-7, 1, "assistant", PROBE)], turns.schema)
    return conversation_digests(format_turns(turns.unionByName(probe), path, pattern), path, pattern)
