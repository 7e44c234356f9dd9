"""The pipeline's near-dedup against exact Jaccard similarity of five-word shingles."""

import random

import pyarrow as pa

from tidewater.llm import simhash


def test_all_similar_pairs(spark):
    draw = random.Random(3)
    words = [f"w{i}" for i in range(5000)]
    docs = []
    for k in range(60):  # copies with a few words changed: similarities around 0.8
        text = [draw.choice(words) for _ in range(200)]
        docs.append(text)
        for changed in (2, 4, 5):
            copy = list(text)
            for place in draw.sample(range(200), changed):
                copy[place] = draw.choice(words)
            docs.append(copy)
    sets = [{tuple(d[i : i + 5]) for i in range(len(d) - 4)} for d in docs]
    root, links = list(range(len(docs))), []
    for a in range(len(docs)):
        for b in range(a):
            if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
                links.append((a, b))
    for _ in range(10):
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    table = spark.createDataFrame([(i, " ".join(d)) for i, d in enumerate(docs)] + [(None, "x"), (0, " ".join(docs[0]))], "doc_id long, text string")
    got = sorted(r[0] for r in simhash.similar_dedup(table).select("doc_id").collect() if r[0] is not None)
    assert got == sorted([i for i, r in enumerate(root) if i == r] + [0])
    prints = [simhash.fingerprint(" ".join(d).encode(), 5) for d in docs]
    assert sum((prints[a] ^ prints[b]).bit_count() > 7 for a, b in links) > 10  # pairs that 7 bits do not link


def test_rows_of_a_common_key_all_go_on():
    """A key with more rows than are held together keeps its rows, wherever batches end."""
    draw = random.Random(9)
    for seed in range(200):
        rows = sorted((draw.choice([1, 1, 1, 2, 3, 4]), k) for k in range(draw.randint(1, 40)))
        root = {k: draw.choice([7, 7, 7, 9]) for _, k in rows}
        cuts = sorted(draw.choices(range(len(rows) + 1), k=6))
        parts = [rows[a:b] for a, b in zip([0, *cuts], [*cuts, len(rows)])]
        batches = [pa.RecordBatch.from_pydict({"key": [r[0] for r in p], "rep": [r[1] for r in p], "root": [root[r[1]] for r in p]}, schema=pa.schema([(c, pa.int64()) for c in ("key", "rep", "root")])) for p in parts]
        got = [(k, r) for b in simhash._open_keys(batches, 5) for k, r in zip(b.column(0).to_pylist(), b.column(1).to_pylist())]
        open_ = {k for k in range(5) if len({root[r] for x, r in rows if x == k}) > 1}
        assert len(got) == len(set(got)) and set(got) <= set(rows), seed
        assert {(k, r) for k, r in rows if k in open_} <= set(got), seed
