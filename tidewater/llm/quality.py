"""Quality rules: a short-circuit cascade whose order comes from costs and rejection rates measured on a sample.

Each rule is a predicate over the features of a text; a document is kept if no rule rejects it. The rules' order only
decides how soon a bad document leaves the cascade, never the verdict, so timing noise cannot change a result.

Defined cases: a null or empty text has no words and fails `too_few_words`; repeated rows and tied ids are judged row by
row; an empty table gives an empty result; only the id and text columns are read, so other columns may have any names.
Texts of any length are judged whole, each by one task in memory that grows with its length.
"""

from __future__ import annotations

import time
from dataclasses import dataclass
from typing import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import U64, Rolling, mix, named, slices, spread, text_buffers, word_spans

#: Bytes of text that vectorised steps hold at once (one longer document is held alone).
SLICE_BYTES = 1 << 20
#: Rows of the sample from which costs and rejection rates are estimated.
SAMPLE_ROWS = 256
MIN_WORDS, MAX_REPEAT_PERCENT, WINDOW = 10, 20, 5

_SPACE = np.zeros(256, bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_UPPER = np.zeros(256, bool)
_UPPER[65:91] = True
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(0xC3, 0x100)]] = True
_MIX = np.random.RandomState(5).randint(1, 2**62, WINDOW).astype(U64) | U64(1)


class Features:
    """Features of a run of documents, each computed when a rule first asks for it."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        self.data, self.offsets, self.memo = data, offsets, {}
        self.n = len(offsets) - 1

    def get(self, name: str) -> np.ndarray:
        if name not in self.memo:
            self.memo[name] = getattr(self, "_" + name)()
        return self.memo[name]

    def subset(self, keep: np.ndarray) -> "Features":
        """The features of some of the documents, with what is known of them."""
        lengths = np.diff(self.offsets)[keep]
        inside = np.repeat(keep, np.diff(self.offsets))
        out = Features(self.data[inside], np.concatenate([[0], np.cumsum(lengths)]).astype(np.int64))
        out.memo = {k: v[keep] for k, v in self.memo.items() if isinstance(v, np.ndarray)}
        return out

    def _per_doc(self, flags: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
        return total[self.offsets[1:]] - total[self.offsets[:-1]]

    def _n_words(self) -> np.ndarray:
        return np.bincount(self.get("words")[2], minlength=self.n).astype(np.int64)

    def _word_chars(self) -> np.ndarray:
        return self._per_doc(~_SPACE[self.data] & ((self.data & 0xC0) != 0x80))

    def _n_symbols(self) -> np.ndarray:
        return self._per_doc(_SYMBOL[self.data])

    def _n_upper(self) -> np.ndarray:
        return self._per_doc(_UPPER[self.data])

    def _n_letters(self) -> np.ndarray:
        return self._per_doc(_LETTER[self.data])

    def _texts(self) -> list[bytes]:
        raw, o = self.data.tobytes(), self.offsets.tolist()
        return [raw[o[i] : o[i + 1]] for i in range(self.n)]

    def _lines(self) -> tuple[np.ndarray, np.ndarray]:
        whole = np.zeros(self.n, np.int64)
        same = np.zeros(self.n, np.int64)
        for i, text in enumerate(self.get("texts")):
            lines = [x for x in text.split(b"\n") if x.strip()]
            whole[i], same[i] = len(lines), len(lines) - len(set(lines))
        return whole, same

    def _n_lines(self) -> np.ndarray:
        return self.get("lines")[0]

    def _n_dup_lines(self) -> np.ndarray:
        return self.get("lines")[1]

    def _words(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return word_spans(self.data, self.offsets)

    def _n_repeat_words(self) -> np.ndarray:
        starts, ends, doc = self.get("words")
        total = len(starts)
        if total < WINDOW:
            return np.zeros(self.n, np.int64)
        h = Rolling(self.data).of(starts, ends)
        m = total - WINDOW + 1
        key = np.zeros(m, U64)
        for k in range(WINDOW):
            key += h[k : k + m] * _MIX[k]
        key = mix(key ^ (doc[:m].astype(U64) * U64(0x9E3779B97F4A7C15)))
        at = np.nonzero(doc[:m] == doc[WINDOW - 1 :])[0]
        order = at[np.argsort(key[at])]
        same = key[order[1:]] == key[order[:-1]]
        twice = np.zeros(len(order), bool)
        twice[1:] |= same
        twice[:-1] |= same
        hit = order[twice]
        covered = spread(hit, hit + WINDOW, total)
        return np.bincount(doc[covered], minlength=self.n).astype(np.int64)


@dataclass(frozen=True)
class Rule:
    """name and a predicate that is True where the documents of Features are rejected."""

    name: str
    rejects: Callable[[Features], np.ndarray]


def too_few_words(f: Features) -> np.ndarray:
    return f.get("n_words") < MIN_WORDS


def repeats_itself(f: Features) -> np.ndarray:
    return 100 * f.get("n_repeat_words") > MAX_REPEAT_PERCENT * f.get("n_words")


def symbol_noise(f: Features) -> np.ndarray:
    """More than one symbol of #*$%&|<> to every fourth word."""
    return 4 * f.get("n_symbols") > f.get("n_words")


def shouting(f: Features) -> np.ndarray:
    """Over half of the letters are capitals A-Z."""
    return (f.get("n_letters") >= 40) & (2 * f.get("n_upper") > f.get("n_letters"))


def repeated_lines(f: Features) -> np.ndarray:
    """Three or more lines, over 30 % of those with words, equal an earlier line; one repeated heading is no fault."""
    return (f.get("n_dup_lines") >= 3) & (10 * f.get("n_dup_lines") > 3 * f.get("n_lines"))


def odd_word_length(f: Features) -> np.ndarray:
    """Words of under 2 or over 30 code points on average."""
    words, chars = f.get("n_words"), f.get("word_chars")
    return (words > 0) & ((chars < 2 * words) | (chars > 30 * words))


BASE_RULES = (Rule("too_few_words", too_few_words), Rule("repeats_itself", repeats_itself))
MORE_RULES = (Rule("symbol_noise", symbol_noise), Rule("shouting", shouting), Rule("repeated_lines", repeated_lines), Rule("odd_word_length", odd_word_length))
RULES = BASE_RULES + MORE_RULES


def _chunks(column: pa.Array):
    data, offsets = text_buffers(column)
    for i, j in slices(offsets, SLICE_BYTES):
        yield i, j, Features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])


def plan_order(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, sample_rows: int = SAMPLE_ROWS, seed: int = 17) -> list[dict]:
    """Measure the rules on a bounded sample; the plan lists them by falling rejection rate per second of cost.

    The rules run where the sample's texts are, a few of them in memory at a time; one row a rule and batch reaches the driver. A
    rule that rejects nothing is ranked by its cost alone, cheapest first.
    """

    def measure(batches):
        for batch in batches:
            for i, j, f in _chunks(batch.column(0)):
                names, costs, rejected = [], [], []
                for rule in rules:
                    began = time.perf_counter()
                    names.append(rule.name)
                    rejected.append(int(rule.rejects(f).sum()))
                    costs.append(time.perf_counter() - began)
                yield pa.RecordBatch.from_pydict({"rule": names, "cost_s": costs, "rejects": pa.array(rejected, pa.int64()), "n": pa.array([j - i] * len(names), pa.int64())})

    sample = docs.select(named(text).alias("text")).sample(0.2, seed).limit(sample_rows)
    found = sample.mapInArrow(measure, "rule string, cost_s double, rejects long, n long").groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("cost_s", "rejects", "n")]).collect()
    seen = {r["rule"]: r for r in found}
    plan = [{"rule": x.name, "cost_s": seen[x.name]["cost_s"] / seen[x.name]["n"], "rejects": seen[x.name]["rejects"] / seen[x.name]["n"]} if x.name in seen else {"rule": x.name, "cost_s": 0.0, "rejects": 0.0} for x in rules]
    return sorted(plan, key=lambda x: (-(x["rejects"] + 1e-6) / max(x["cost_s"], 1e-9), x["rule"]))


def run_cascade(f: Features, rules: list[Rule]) -> np.ndarray:
    """True where no rule rejects; documents that a rule rejects are not shown to the rules behind it."""
    kept, at, now = np.ones(f.n, bool), np.arange(f.n), f
    for rule in rules:
        if not len(at):
            break
        bad = rule.rejects(now)
        if bad.any():
            kept[at[bad]] = False
            at = at[~bad]
            now = now.subset(~bad)
    return kept


def quality_verdicts(docs: DataFrame, id_col: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES, features: tuple[str, ...] = (), plan: list[dict] | None = None) -> DataFrame:
    """One row per row of docs: its id, the long features asked for, base_failed and kept.

    Features that are asked for are computed for every document; other rules run as a short-circuit cascade.
    """
    plan = plan_order(docs, text, rules) if plan is None else plan
    by_name = {r.name: r for r in rules}
    ordered = [by_name[x["rule"]] for x in plan]
    id_type = docs.schema[id_col].dataType.simpleString()
    schema = ", ".join([f"`{id_col}` {id_type}", *(f"{x} long" for x in features), "base_failed boolean", "kept boolean"])

    def judge(batches):
        for batch in batches:
            columns = {x: [] for x in (*features, "base_failed", "kept")}
            for _, _, f in _chunks(batch.column(1)):
                for x in features:
                    columns[x].append(f.get(x))
                columns["base_failed"].append(np.any([r.rejects(f) for r in BASE_RULES], axis=0))
                columns["kept"].append(run_cascade(f, ordered))
            if batch.num_rows:
                yield pa.RecordBatch.from_pydict({id_col: batch.column(0)} | {k: pa.array(np.concatenate(v)) for k, v in columns.items()})

    return docs.select(named(id_col).alias("id"), named(text).alias("text")).mapInArrow(judge, schema)


def quality_filter(docs: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, plan: list[dict] | None = None) -> DataFrame:
    """The rows of docs, all their columns, that no rule rejects; one pass, no shuffle."""
    plan = plan_order(docs, text, rules) if plan is None else plan
    by_name = {r.name: r for r in rules}
    ordered = [by_name[x["rule"]] for x in plan]
    names, at = docs.columns, docs.columns.index(text)

    def keep(batches):
        for batch in batches:
            for i, j, f in _chunks(batch.column(at)):
                yield batch.slice(i, j - i).filter(pa.array(run_cascade(f, ordered))).rename_columns(names)

    return docs.toDF(*[f"c{i}" for i in range(len(docs.columns))]).mapInArrow(keep, docs.schema)


QUERY_FEATURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return quality_verdicts(read_table(spark, sf_dir, "documents"), features=QUERY_FEATURES)
