"""Edit scripts against a table of common subsequences."""

import random

import pytest

from tidewater.operators import difference as df


def longest(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(last[j + 1], row[j]))
    return row[-1]


@pytest.mark.parametrize("row_bytes", [df.ROW_BYTES, 0, 3])
def test_scripts(row_bytes):
    dice = random.Random(row_bytes)
    for _ in range(1500):
        a, b = ([dice.choice("abcd"[: dice.randint(1, 4)]) for _ in range(dice.randint(0, 25))] for _ in range(2))
        if dice.random() < 0.3:
            b = a[: dice.randint(0, len(a))] + b[:3] + a[dice.randint(0, len(a)) :]
        script = df.edit_script(a, b, row_bytes)
        assert sum(n for op, *_, n in script if op == "=") == longest(a, b)
        left = [x for op, s, e, _ in script if op != "+" for x in a[s:e]]
        made = [x for op, s, e, _ in script if op != "-" for x in (b if op == "+" else a)[s:e]]
        assert left == a and made == b
        assert all(x[0] != y[0] for x, y in zip(script, script[1:]))


def test_long_texts():
    dice = random.Random(3)
    a = [dice.randrange(500) for _ in range(20_000)]
    b = [x for x in a if dice.random() > 0.1]
    script = df.edit_script(a, b)
    assert sum(n for op, *_, n in script if op == "=") == len(b)
    other = [dice.randrange(500) for _ in range(20_000)]
    same = lambda r: sum(n for op, *_, n in df.edit_script(a, other, r) if op == "=")
    assert same(df.ROW_BYTES) == same(64 << 20)


def test_pairs(spark):
    rows = [(1, None, None), (2, "", "a b"), (3, "a  b\tc", "a b c"), (4, "Paris in the spring", "Paris in the the spring"), (4, "x", None), (None, "x y z", "x z")]
    got = {(r["id"], r["n_same"], r["n_deleted"], r["n_inserted"], tuple((s["op"], s["units"]) for s in r["script"])) for r in df.text_difference(spark.createDataFrame(rows, "id long, a string, b string")).collect()}
    assert got == {
        (1, 0, 0, 0, ()), (2, 0, 0, 2, (("+", "a b"),)), (3, 3, 0, 0, (("=", "a b c"),)), (4, 4, 0, 1, (("=", "Paris in the"), ("+", "the"), ("=", "spring"))),
        (4, 0, 1, 0, (("-", "x"),)), (None, 2, 1, 0, (("=", "x"), ("-", "y"), ("=", "z"))),
    }
    chars = df.text_difference(spark.createDataFrame([(1, "tin roof", "in roof")], "id long, a string, b string"), "char").first()
    assert (chars["n_same"], chars["n_deleted"], chars["n_inserted"]) == (7, 1, 0)


def test_previous_of_a_key(spark):
    dice = random.Random(5)
    rows = [(i, dice.choice(["a", "b", None]), f"t{i}") for i in dice.sample(range(10**7), 200)]
    got = {(r["id"], r["before"], r["a"], r["b"]) for r in df.with_previous(spark.createDataFrame(rows, "id long, k string, t string"), "k", "id", "t").collect()}
    expected = set()
    for k in "ab":
        ids = sorted(r[0] for r in rows if r[1] == k)
        expected |= {(y, x, f"t{x}", f"t{y}") for x, y in zip(ids, ids[1:])}
    assert got == expected
