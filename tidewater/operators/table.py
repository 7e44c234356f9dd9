"""Table algebra over delimited rows: column selection, lookups, semi and anti filters, set operations and reshaping.

Every function takes and returns DataFrames and adds no action. Missing values are NULL inside the engine; a `missing=`
parameter renders them where an operator's convention shows them.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

#: Keys of at most so many bytes are sent to every task.
MOST_KEY_BYTES = 4 << 20


def column_name(df: DataFrame, ref: int | str) -> str:
    """A column by name or 0-based index; negative indices count from the end."""
    return df.columns[ref] if isinstance(ref, int) else ref


# -- columns ---------------------------------------------------------------------------------------------------------


def cut(df: DataFrame, *refs: int | str, drop_incomplete: bool = False) -> DataFrame:
    """The given columns in the given order; `empty` is a column of empty strings; rows with an empty value can go."""
    chosen = [F.lit("").alias("empty") if r == "empty" else F.col(column_name(df, r)) for r in refs]
    if drop_incomplete:
        for r in refs:
            if r != "empty":
                c = F.col(column_name(df, r)).cast("string")
                df = df.where(c.isNotNull() & (c != ""))
    return df.select(*chosen)


def drop_columns(df: DataFrame, *refs: int | str) -> DataFrame:
    return df.drop(*(column_name(df, r) for r in refs))


def drop_constant_columns(df: DataFrame) -> DataFrame:
    """Without the columns that hold one value or none; one aggregate finds them, NULL counting as a value."""
    if not df.columns:
        return df
    spread = df.agg(*[(F.min(F.col(c).isNull()) != F.max(F.col(c).isNull())).alias(f"n{i}") for i, c in enumerate(df.columns)], *[(F.min(c) != F.max(c)).alias(f"v{i}") for i, c in enumerate(df.columns)]).first()
    return df.select(*[c for i, c in enumerate(df.columns) if spread[f"n{i}"] or spread[f"v{i}"]])


def filter_rows(df: DataFrame, condition: str, keep: list[str] | None = None, remove: list[str] | None = None, prefix: str | None = None) -> DataFrame:
    """Rows for which a SQL condition holds; columns to keep or remove; a SQL expression as first column `prefix`."""
    out = df.where(F.expr(condition))
    columns = [c for c in (keep or df.columns) if c not in (remove or [])]
    return out.select(*([F.expr(prefix).alias("prefix")] if prefix else []), *columns)


def swap_first_two(df: DataFrame) -> DataFrame:
    a, b, *rest = df.columns
    return df.select(b, a, *rest)


def transpose_head(df: DataFrame, order: list[str], n: int = 10) -> DataFrame:
    """The first n rows as columns row_1 .. row_n, one row a field; n is a viewing limit."""
    head = df.orderBy(*order).limit(n).withColumn("at", F.row_number().over(W.orderBy(*order)))
    cells = F.explode(F.array(*[F.struct(F.lit(i).alias("pos"), F.lit(c).alias("field"), F.col(c).cast("string").alias("value")) for i, c in enumerate(df.columns)]))
    long = head.select("at", cells.alias("x")).select("at", "x.*")
    wide = long.groupBy("pos", "field").pivot("at", list(range(1, n + 1))).agg(F.first("value"))
    return wide.orderBy("pos").select("field", *[F.col(str(i)).alias(f"row_{i}") for i in range(1, n + 1)])


def first_sentence(text: str | Column) -> Column:
    """Text before the first period with a space behind it."""
    return F.substring_index(text, ". ", 1)


def share_of_total(df: DataFrame, value: str, out: str = "share") -> DataFrame:
    """value divided by its total; the total is one broadcast row, not a window over a single partition."""
    total = df.agg(F.sum(value).cast("double").alias("total value"))
    return df.crossJoin(F.broadcast(total)).withColumn(out, F.col(value) / F.col("total value")).drop("total value")


def make_unique(df: DataFrame, key: str, order: list[str], line: str) -> DataFrame:
    """Keys that repeat get _DUP_ and their line behind them; the first in order stays."""
    again = F.row_number().over(W.partitionBy(key).orderBy(*order)) > 1
    return df.withColumn(key, F.when(again, F.concat(key, F.lit("_DUP_"), F.col(line).cast("string"))).otherwise(F.col(key)))


# -- lookups and joins -----------------------------------------------------------------------------------------------


def dictionary(df: DataFrame, key: str, value: str, order: list[str], keep: str = "first") -> DataFrame:
    """(key, value) with one value a key: the first or last in order. Aggregation only, no window."""
    rank = F.struct(*order, F.col(value).alias("v"))
    pick = (F.min if keep == "first" else F.max)(rank)
    return df.groupBy(F.col(key).alias("key")).agg(pick.getField("v").alias("value"))


def multimap(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, values): sorted distinct values of each key."""
    return df.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set(value)).alias("values"))


def replace_values(df: DataFrame, column: str, mapping: DataFrame, skip_missing: bool = False, inverse: bool = False) -> DataFrame:
    """column through a (key, value) mapping; misses stay as they are or go; inverse maps values to keys."""
    a, b = ("value", "key") if inverse else ("key", "value")
    m = mapping.select(F.col(a).alias("map from"), F.col(b).alias("map to"))
    met = df.join(m, F.col(column) == F.col("map from"), "inner" if skip_missing else "left")
    return met.withColumn(column, F.coalesce("map to", column)).drop("map from", "map to")


def append_lookup(df: DataFrame, column: str, mapping: DataFrame, out: str, missing=None, filter_missing: bool = False) -> DataFrame:
    """A further column from a (key, value) mapping."""
    m = mapping.select(F.col("key").alias("map from"), F.col("value").alias(out))
    met = df.join(m, F.col(column) == F.col("map from"), "inner" if filter_missing else "left").drop("map from")
    return met if missing is None else met.withColumn(out, F.coalesce(F.col(out).cast("string"), F.lit(missing)))


def lookup_lists(df: DataFrame, column: str, pairs: DataFrame, out: str, expand: bool = False, missing: str = "noJoinPossible", sep: str = ",") -> DataFrame:
    """All values of a key, as a row each or as one list without repeats; keys without values show `missing`."""
    if expand:
        return df.join(pairs.select(F.col("key").alias("map from"), F.col("value").alias(out)), F.col(column) == F.col("map from")).drop("map from")
    lists = pairs.groupBy(F.col("key").alias("map from")).agg(F.array_join(F.array_sort(F.collect_set(F.col("value").cast("string"))), sep).alias(out))
    return df.join(lists, F.col(column) == F.col("map from"), "left").withColumn(out, F.coalesce(out, F.lit(missing))).drop("map from")


def join_or_none(probe: DataFrame, build: DataFrame, probe_key: str, build_key: str, missing: str | None = None) -> DataFrame:
    """Each probe row with the rest of every matching build row; with `missing` unmatched probe rows stay and show it."""
    rest = [c for c in build.columns if c != build_key]
    side = build.select(F.col(build_key).alias("join key"), *[F.col(c).alias(c if c not in probe.columns else f"{c}_2") for c in rest])
    met = probe.join(side, F.col(probe_key) == F.col("join key"), "inner" if missing is None else "left")
    if missing is not None:
        met = met.select(*probe.columns, *[F.when(F.col("join key").isNull(), F.lit(missing)).otherwise(F.col(c).cast("string")).alias(c) for c in side.columns[1:]])
    return met.drop("join key")


def cogroup_lists(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """(key, left rows, right rows) of the keys on both sides; rows as sorted arrays of structs."""
    lists = lambda df, out: df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*[c for c in df.columns if c != key]))).alias(out))
    return lists(left, "left_rows").join(lists(right, "right_rows"), key)


def outer_none(frames: dict[str, DataFrame], inner: bool = False) -> DataFrame:
    """Key and value frames side by side: one aggregate over their union, so one shuffle for any number of frames."""
    tagged = reduce(DataFrame.unionByName, [df.select("key", "value", F.lit(n).alias("src")) for n, df in frames.items()])
    wide = tagged.groupBy("key").agg(*[F.max(F.when(F.col("src") == n, F.col("value"))).alias(n) for n in frames], F.count_distinct("src").alias("n frames"))
    return (wide.where(F.col("n frames") == len(frames)) if inner else wide).drop("n frames")


def rank_compare(left: DataFrame, right: DataFrame) -> DataFrame:
    """(key, rank_left, rank_right, ratio) of two (key, value) frames by falling value; ranks come from sorted partitions."""
    from .ranking import global_rank

    a = global_rank(left, [F.desc("value"), F.asc("key")], "rank_left").select("key", "rank_left")
    b = global_rank(right, [F.desc("value"), F.asc("key")], "rank_right").select("key", "rank_right")
    return a.join(b, "key").withColumn("ratio", F.col("rank_left").cast("double") / F.col("rank_right"))


def coalesce_sources(key: str, value: str, *sources: tuple[str, DataFrame]) -> DataFrame:
    """(key, value, source) with the value of the first source that has one."""
    tagged = reduce(DataFrame.unionByName, [df.select(F.col(key), F.col(value), F.lit(i).alias("at"), F.lit(name).alias("source")) for i, (name, df) in enumerate(sources)])
    best = tagged.where(F.col(value).isNotNull()).groupBy(key).agg(F.min(F.struct("at", value, "source")).alias("b"))
    return best.select(key, f"b.{value}", "b.source")


def two_hop(df: DataFrame, column: str, first: DataFrame, second: DataFrame, names: tuple[str, str]) -> DataFrame:
    """A key through two (key, value) mappings, both results as columns; rows without both go."""
    a = first.select(F.col("key").alias(column), F.col("value").alias(names[0]))
    b = second.select(F.col("key").alias(names[0]), F.col("value").alias(names[1]))
    return df.join(a, column).join(b, names[0]).select(*df.columns, *names)


def prefix_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame, name: str, sep: str = "_") -> DataFrame:
    """Rows of two frames whose names, cut at sep, are a pair (a, b)."""
    a = left.select(F.substring_index(name, sep, 1).alias("a"), F.struct(*left.columns).alias("left_row"))
    b = right.select(F.substring_index(name, sep, 1).alias("b"), F.struct(*right.columns).alias("right_row"))
    return pairs.join(a, "a").join(b, "b")


# -- filters ---------------------------------------------------------------------------------------------------------


def keep_in(df: DataFrame, key: str, other: DataFrame, other_key: str, invert: bool = False, prefix: int | None = None) -> DataFrame:
    """Rows whose key is (or is not) among the other's keys; with prefix only so many characters are compared."""
    side = other.select(F.col(other_key).cast("string").alias("in key"))
    mine = F.col(key).cast("string")
    if prefix:
        side, mine = side.select(F.substring("in key", 1, prefix).alias("in key")), F.substring(mine, 1, prefix)
    return df.join(side.distinct(), mine == F.col("in key"), "left_anti" if invert else "left_semi")


def keep_by_fields(df: DataFrame, line: str, keys: DataFrame, key: str, least: int = 1, remove: bool = False, separators: str = r"[\t,]") -> DataFrame:
    """Lines with at least `least` fields among the keys (repeats count), or with none; fields meet keys by an equi-join."""
    # Equal lines have equal fields, so a line is named by its digest: no row number has to hold over two plans.
    once = df.select(F.sha2(line, 256).alias("line digest"), F.col(line).alias("the line")).dropDuplicates(["line digest"])
    fields = once.select("line digest", F.explode(F.split("the line", separators)).alias("field"))
    hits = fields.join(keys.select(F.col(key).cast("string").alias("field")).distinct(), "field").groupBy("line digest").count()
    same = F.sha2(line, 256) == F.col("line digest")
    return df.join(hits, same, "left_anti") if remove else df.join(hits.where(F.col("count") >= least), same, "left_semi")


def keep_containing(df: DataFrame, text: str, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose text holds a key as a substring, for any number of keys.

    Keys are put in classes by length, each up to twice as long as its shortest. Texts and a class's keys meet by grams of that
    shortest length: a text has a small row for each of its distinct grams, a key its first; so a short key does not make long
    ones meet at random. What meets is verified against the text itself. An empty key is in every text. Keys of a few megabytes at most
    go to every task; the texts' grams never do, whatever size the planner takes them for.
    """
    own = keys.select(F.col(key).cast("string").alias("in key")).where(F.col("in key").isNotNull()).distinct().withColumn("in length", F.length("in key"))
    power = F.when(F.col("in length") > 0, F.floor(F.log2("in length"))).otherwise(-1)
    found = own.groupBy(power.alias("class")).agg(F.min("in length").alias("n"), F.sum(F.col("in length") + 64).alias("bytes")).collect()  # some thirty rows at most
    classes = [r["n"] for r in found]
    if not classes or 0 in classes:
        return df.where(F.col(text).isNotNull() if classes else F.lit(False))
    grams = None
    for n in sorted(classes):
        places = F.sequence(F.lit(1), F.length(text) - n + 1)
        rows = df.where(F.length(text) >= n).select(F.xxhash64(text).alias("text digest"), F.explode(F.array_distinct(F.transform(places, lambda p: F.substring(F.col(text), p, F.lit(n))))).alias("gram"))  # noqa: B023
        grams = rows if grams is None else grams.unionByName(rows)
    first = F.lit(None).cast("string")
    for n in sorted(classes):
        first = F.when(F.col("in length") >= n, F.substring("in key", 1, n)).otherwise(first)
    asked = own.withColumn("gram", first)
    near = grams.join(F.broadcast(asked), "gram") if sum(r["bytes"] for r in found) <= MOST_KEY_BYTES else grams.hint("merge").join(asked, "gram")
    met = near.select("text digest", "in key").distinct().hint("merge")
    return df.join(met, (F.xxhash64(text) == F.col("text digest")) & F.col(text).contains(F.col("in key")), "left_semi")


def first_per(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """The first row of each key in order."""
    at = F.row_number().over(W.partitionBy(*keys).orderBy(*order))
    return df.withColumn("row in key", at).where(F.col("row in key") == 1).drop("row in key")


def repeated_keys(df: DataFrame, key: str, value: str, least: int = 1, most: int | None = None) -> DataFrame:
    """(key, n, values) of keys with a number of values in the range."""
    lists = df.groupBy(key).agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), ",").alias("values"))
    return lists.where((F.col("n") >= least) & (F.lit(True) if most is None else F.col("n") <= most))


def multimap_filter(df: DataFrame, key: str, value: str, *, fewer_than: int | None = None, more_than: int | None = None, not_value: str | None = None, only_value: str | None = None, not_both: tuple[list, list] | None = None, replace: tuple[list, str] | None = None) -> DataFrame:
    """(key, value) rows of the keys whose value sets pass.

    fewer_than, more_than: bounds on the number of distinct values; not_value: no value matches the pattern; only_value: every value
    does; not_both: not values of both sets; replace: a full combination becomes one value.
    """
    sets = df.groupBy(F.col(key).alias("key")).agg(F.array_sort(F.collect_set(F.col(value).cast("string"))).alias("values"))
    n = F.size("values")
    if fewer_than is not None:
        sets = sets.where(n < fewer_than)
    if more_than is not None:
        sets = sets.where(n > more_than)
    if not_value is not None:
        sets = sets.where(~F.exists("values", lambda v: v.rlike(not_value)))
    if only_value is not None:
        sets = sets.where(F.forall("values", lambda v: v.rlike(only_value)))
    if not_both is not None:
        a, b = (F.array(*[F.lit(str(x)) for x in side]) for side in not_both)
        sets = sets.where(~(F.arrays_overlap("values", a) & F.arrays_overlap("values", b)))
    if replace is not None:
        combination = F.array(*[F.lit(str(x)) for x in replace[0]])
        whole = F.size(F.array_except(combination, F.col("values"))) == 0
        rest = F.array_except("values", combination)
        sets = sets.withColumn("values", F.when(whole, F.array_sort(F.concat(rest, F.array(F.lit(replace[1]))))).otherwise(F.col("values")))
    return sets.select("key", F.explode("values").alias("value"))


def common_lines(df: DataFrame, other: DataFrame, line: str, keep_multiplicity: bool = True) -> DataFrame:
    """Lines that the other has too; each match counts, or each line once."""
    return df.join(other.select(line), line) if keep_multiplicity else df.join(other.select(line).distinct(), line, "left_semi")


def token_overlap(df: DataFrame, column: str, tokens: list[str], sep: str = ",", after: str = "=") -> DataFrame:
    """Rows with one of the tokens in the list behind the last `after` of a column."""
    mine = F.split(F.element_at(F.split(column, after), -1), sep)
    return df.where(F.arrays_overlap(mine, F.array(*[F.lit(t) for t in tokens])))


def field_errors(lines: DataFrame, line: str, n_fields: int, sep: str = "\t") -> DataFrame:
    """(n_lines, n_bad): lines whose number of fields is not n_fields."""
    bad = F.size(F.split(line, sep)) != n_fields
    return lines.agg(F.count("*").alias("n_lines"), F.count_if(bad).alias("n_bad"))


# -- sets ------------------------------------------------------------------------------------------------------------


def id_intersect(first: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Rows of first whose key all others have."""
    return reduce(lambda df, o: df.join(o.select(key).distinct(), key, "left_semi"), others, first)


def id_remove(first: DataFrame, key: str, *others: DataFrame) -> DataFrame:
    """Distinct keys of first that no other has; others' keys that start with # are comments."""
    gone = reduce(DataFrame.unionByName, [o.select(F.col(key).cast("string").alias("gone")) for o in others])
    gone = gone.where(~F.col("gone").startswith("#")).distinct()
    return first.select(key).distinct().join(gone, F.col(key).cast("string") == F.col("gone"), "left_anti")


def union_tagged(frames: dict[str, DataFrame], tag: str = "source") -> DataFrame:
    """All rows under their frame's name; columns by name, missing ones NULL."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [df.withColumn(tag, F.lit(n)) for n, df in frames.items()])


def ordered_pairs(df: DataFrame, column: str, group: str | None = None) -> DataFrame:
    """(a, b) of all values a < b, inside groups where given; the result is what grows with the square."""
    keys = [group] if group else []
    a = df.select(*keys, F.col(column).alias("a")).distinct()
    b = df.select(*keys, F.col(column).alias("b")).distinct()
    return (a.join(b, keys) if keys else a.crossJoin(b)).where(F.col("a") < F.col("b"))


# -- reshaping -------------------------------------------------------------------------------------------------------


def expand(df: DataFrame, column: str, sep: str = "|") -> DataFrame:
    """A row for each part of a separated column."""
    return df.withColumn(column, F.explode(F.split(column, "\\Q" + sep + "\\E")))


def collapse(df: DataFrame, key: str, sep: str = ",", order: str | None = None) -> DataFrame:
    """A row a key; each other column shows its distinct values, by first appearance in order or sorted. Empty keys go."""
    rest = [c for c in df.columns if c not in (key, order)]

    def joined(c):
        text = F.col(c).cast("string")
        if order is None:
            return F.array_join(F.array_sort(F.collect_set(text)), sep).alias(c)
        ordered = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), text.alias("v"))))
        return F.array_join(F.array_distinct(F.transform(ordered, lambda x: x["v"])), sep).alias(c)

    return df.where(F.col(key).isNotNull() & (F.col(key).cast("string") != "")).groupBy(key).agg(*map(joined, rest))


def flatten_values(df: DataFrame, key: str, value: str, sep: str = "/") -> DataFrame:
    """(key, values): all values of a key, sorted and joined."""
    return df.groupBy(key).agg(F.array_join(F.array_sort(F.collect_list(F.col(value).cast("string"))), sep).alias("values"))


def presence_matrix(df: DataFrame, key: str, value: str, values: list) -> DataFrame:
    """1 or 0 for each key and each of the bounded list of values; conditional aggregates, so one shuffle."""
    return df.groupBy(key).agg(*[F.max(F.when(F.col(value) == v, 1).otherwise(0)).cast("long").alias(f"{value}_{v}".lower().replace(" ", "_").replace("-", "_")) for v in values])


def crosstab(df: DataFrame, row: str, column: str, values: list) -> DataFrame:
    """Counts of a bounded list of values by row."""
    return df.groupBy(row).agg(*[F.count_if(F.col(column) == v).alias(str(v).lower().replace(" ", "_").replace("-", "_")) for v in values])


def symmetric_long(df: DataFrame, a: str, b: str, value: str, diagonal: float = 1.0) -> DataFrame:
    """(a, b, value) filled on both sides of the diagonal, in long form."""
    both = df.select(F.col(a).alias("a"), F.col(b).alias("b"), F.col(value).alias("value"))
    both = both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"), "value"))
    names = both.select("a").distinct()
    return both.where("a <> b").groupBy("a", "b").agg(F.max("value").alias("value")).unionByName(names.select("a", F.col("a").alias("b"), F.lit(diagonal).alias("value")))


def records_to_wide(df: DataFrame, id_col: str, pairs: str, fields: list[str], missing: str = "NOTFOUND", sep: str = ";", eq: str = "=") -> DataFrame:
    """key=value records as columns of a bounded list of fields; nothing is ever executed."""
    m = F.str_to_map(F.col(pairs), F.lit(sep), F.lit(eq))
    return df.select(id_col, *[F.coalesce(F.element_at(m, f), F.lit(missing)).alias(f) for f in fields])


# -- whole tables ------------------------------------------------------------------------------------------------------


def sort_table(df: DataFrame, column: str, kind: str = "string", reverse: bool = False, unique: bool = False, ties: list[str] | None = None) -> DataFrame:
    """Rows in order of a column as string, int (what is no number counts as 0) or float; unique keeps the first row of each value.

    Rows without the column's value come last. Ties follow the other columns.
    """
    value = F.col(column)
    if kind == "int":
        value = F.when(value.isNotNull(), F.coalesce(value.cast("string").try_cast("long"), F.lit(0)))
    elif kind == "float":
        value = value.cast("string").try_cast("double")
    rest = ties or [c for c in df.columns if c != column]
    order = [value.desc_nulls_last() if reverse else value.asc_nulls_last(), *map(F.col, rest)]
    if unique:
        keyed = df.withColumn("sort value", value)
        first = keyed.groupBy("sort value").agg(F.min(F.struct(*rest, *[c for c in df.columns if c not in rest])).alias("b"))
        df = first.select(*[F.col(f"b.{c}").alias(c) for c in df.columns])
    return df.orderBy(*order)


def sorted_groups(df: DataFrame, key: str, order: list[str]) -> DataFrame:
    """(key, rows): each key's rows in order as one list. The groups of a block reader; one key is one row by its definition."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.array_sort(F.collect_list(F.struct(*order, *[c for c in rest if c not in order]))).alias("rows"))


def unsorted_places(df: DataFrame, key: str, position: str, chunk: int = 1 << 20) -> DataFrame:
    """Rows whose key is smaller than one before them by position, for tables that must come sorted; chunks of positions carry a maximum."""
    from .intervals import prefix_max

    seen = prefix_max(df.withColumn("one table", F.lit(0)), F.col(key), [position], "greatest before", False, by="one table", chunk=chunk)
    return seen.where(F.col(key) < F.col("greatest before")).drop("one table", "greatest before")


def concat_frames(frames: list[DataFrame]) -> DataFrame:
    """Frames end to end under the first one's column names, by place."""
    return reduce(DataFrame.unionAll, [df.toDF(*frames[0].columns) for df in frames])


def key_index(frames: dict[str, DataFrame], key: str) -> DataFrame:
    """(key, n, sources): where a key's rows stand, and how many there are; keys with n over 1 are repeated."""
    tagged = reduce(DataFrame.unionAll, [df.select(F.col(key).cast("string").alias("key"), F.lit(n).alias("s")) for n, df in frames.items()])
    return tagged.groupBy("key").agg(F.count("*").alias("n"), F.array_join(F.array_sort(F.collect_set("s")), ",").alias("sources"))


def union_keys(*frames: DataFrame, key: str) -> DataFrame:
    """The distinct keys of all frames."""
    return reduce(DataFrame.unionAll, [df.select(F.col(key).alias("key")) for df in frames]).distinct()


def only_in_first(first: DataFrame, second: DataFrame, key: str) -> DataFrame:
    """All rows of the keys that the second frame lacks."""
    return first.join(second.select(key).distinct(), key, "left_anti")


def cells_to_records(df: DataFrame, record: str, field: str, value: str, fields: list[str]) -> DataFrame:
    """Rows of cells as one row a record, a column for each of a bounded list of fields; the first value in order counts."""
    return df.groupBy(record).agg(*[F.min(F.when(F.col(field) == f, F.col(value))).alias(f) for f in fields])


def filled_fields(df: DataFrame, key: str) -> DataFrame:
    """(key, json): a row's fields that are neither NULL nor empty, as a JSON object."""
    rest = [c for c in df.columns if c != key]
    pairs = F.map_from_arrays(F.array(*[F.lit(c) for c in rest]), F.array(*[F.col(c).cast("string") for c in rest]))
    return df.select(key, F.to_json(F.map_filter(pairs, lambda k, v: v.isNotNull() & (v != ""))).alias("json"))


def expand_aliased(df: DataFrame, column: str, aliases: dict[str, str], sep: str = ",") -> DataFrame:
    """A row for each part of a list column, trimmed and renamed by a short table of aliases."""
    table = F.create_map(*[F.lit(x) for pair in aliases.items() for x in pair]) if aliases else None
    out = df.withColumn(column, F.explode(F.transform(F.split(column, sep), lambda x: F.trim(x))))
    return out if table is None else out.withColumn(column, F.coalesce(F.element_at(table, F.col(column)), F.col(column)))


def standoff_join(annotations: DataFrame, mentions: DataFrame, slots: DataFrame) -> DataFrame:
    """(doc, start, end, value): annotations (doc, mention, start, end) through mentions (mention, slot) to slots (slot, value)."""
    return annotations.join(mentions, "mention").join(slots, "slot").select("doc", "start", "end", "value")


def best_of_pairs(column: str | Column, pair_sep: str = r"\|", score_sep: str = r"\?s") -> Column:
    """The id with the highest score of a text `id?s score|id?s score`; ties to the greatest id."""
    c = F.col(column) if isinstance(column, str) else column
    scored = F.transform(F.split(c, pair_sep), lambda p: F.struct(F.element_at(F.split(p, score_sep), -1).try_cast("double").alias("score"), F.split(p, score_sep)[0].alias("id")))
    return F.array_max(scored)["id"]


def all_best_hits(df: DataFrame, key: str, hits: DataFrame, score: str, places: list[str]) -> DataFrame:
    """Each row with the places of all its best-scoring hits, each column a comma list in order; none is an empty string."""
    best = hits.groupBy(key).agg(F.max(score).alias("best score"))
    met = hits.join(best, key).where(F.col(score) == F.col("best score"))
    ordered = F.array_sort(F.collect_list(F.struct(*places)))
    lists = met.groupBy(key).agg(ordered.alias("h")).select(key, *[F.array_join(F.col("h")[p].cast("array<string>"), ",").alias(p) for p in places])
    return df.join(lists, key, "left").fillna("", places)


def clone_ends(df: DataFrame) -> DataFrame:
    """(clone, forward, reverse): accessions (clone, end `F` or `R`, accession) without version, in order; clones that miss an end go."""
    bare = F.substring_index("accession", ".", 1)
    side = lambda s: F.array_sort(F.collect_set(F.when(F.col("end") == s, bare)))
    return df.groupBy("clone").agg(side("F").alias("forward"), side("R").alias("reverse")).where((F.size("forward") > 0) & (F.size("reverse") > 0))


def clone_prefixes(df: DataFrame, column: str) -> DataFrame:
    """(prefix): the distinct parts before the first -; empty ones go."""
    return df.select(F.substring_index(column, "-", 1).alias("prefix")).where("prefix <> ''").distinct()


def listed_ids(df: DataFrame, column: str, sep: str = ",") -> DataFrame:
    """(id): the distinct ids of list columns."""
    return df.select(F.explode(F.transform(F.split(column, sep), lambda x: F.trim(x))).alias("id")).where("id <> ''").distinct()


def share_of_rows(df: DataFrame, key: str, parts: int, part: int, skip: DataFrame | None = None) -> DataFrame:
    """The rows that are node `part`'s of `parts` by the hash of their key, without keys to skip; the parts are disjoint and whole."""
    own = df if skip is None else df.join(skip.select(key).distinct(), key, "left_anti")
    return own.where(F.pmod(F.xxhash64(key), F.lit(parts)) == part)


def to_all_groups(docs: DataFrame, groups: DataFrame, key: str, group: str) -> DataFrame:
    """docs with their groups (key, group); a document without one belongs to all groups that there are."""
    known = groups.select(key, group).distinct()
    every = known.select(group).distinct()
    own = docs.join(known, key)
    rest = docs.join(known, key, "left_anti").crossJoin(every)  # the result: each such document once for every group
    return own.unionByName(rest.select(*own.columns))


def write_jdbc(df: DataFrame, url: str, name: str, mode: str = "append", batch: int = 10_000, **options: str) -> None:
    """Rows into a database table, by batches of parameterised inserts; overwrite replaces the table."""
    df.write.format("jdbc").mode(mode).options(url=url, dbtable=name, batchsize=str(batch), **options).save()


def save_tables(frames: dict[str, DataFrame], folder: str) -> dict[str, int]:
    """Write frames as tables of the session's catalogue, in folders of their own, replacing those of their names; their numbers of rows."""
    out = {}
    for name, df in frames.items():
        df.sparkSession.sql(f"DROP TABLE IF EXISTS `{name}`")
        df.write.mode("overwrite").option("path", f"{folder}/{name}").saveAsTable(name)
        out[name] = df.sparkSession.table(name).count()
    return out
