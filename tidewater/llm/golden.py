"""Golden record survivorship: one record per cluster of source records, by map-side dominance pruning.

Each partition keeps, for every cluster, only records that can still win a field whatever other partitions hold:

- email, name and address go by trust, fresh before stale. Which records are stale is known only with the cluster's latest record,
  but within one trust level the order is by recency either way, so a level's first record is its only candidate;
- segment goes by recency: one candidate. Balance prefers the chosen segment, so each segment's first record is a candidate.

With them go counts by timestamp, from which staleness is counted exactly later: timestamps that are too old already by what the
partition knows are one sum, the others stay apart. Only these rows are exchanged, and the last step settles whole clusters in
sorted batches. Clusters with over Limits.dense records in a partition take two more steps, so that no task grows with them:
their candidates are pruned once more by (cluster, some partitions), their timestamps are counted in a join salted by timestamp.

Defined cases: a null cluster id (master and client null) is a cluster like any other; strings without a visible character
count as null, other strings stay untrimmed; sources that are null or not listed have the least trust; a null timestamp is stale and comes
last; a balance that is NaN or infinite counts as null; rows with equal timestamp, trust and client_id go by the field's smallest value
(address: city, then nation, nulls last); a repeated row counts as often as it comes; an empty table gives no rows. Other columns are not
read, whatever their names. Texts may be of any length; a batch holds whole rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import named, release_memory, staged

#: Sources by falling trust.
TRUST = ("partner", "store", "web", "crm")
STALE_HOURS = 30 * 24
_BLANK = r"^[\x20\x09-\x0D]*$"
_STRINGS = ("name", "email", "segment", "city")
_SCHEMA = pa.schema([
    ("cluster_id", pa.int64()), ("ts", pa.int64()), ("n", pa.int64()), ("record", pa.bool_()), ("client_id", pa.int64()), ("trust", pa.int32()),
    *((c, pa.string()) for c in _STRINGS), ("nation_id", pa.int64()), ("balance", pa.float64()),
])
_COLUMNS = "cluster_id long, ts long, n long, record boolean, client_id long, trust int, name string, email string, segment string, city string, nation_id long, balance double"
_ROUTED = f"{_COLUMNS}, dense boolean, times boolean, part int"
_GOLDEN = "cluster_id long, n_records long, n_stale long, name string, email string, segment string, city string, nation_id long, balance_cents long, name_from long, email_from long, segment_from long, balance_from long, address_from long"
_LEAST = np.iinfo(np.int64).min


def _numbers(column: pa.Array, null: int = 0) -> np.ndarray:
    return column.fill_null(null).to_numpy(zero_copy_only=False)


def _there(column: pa.Array) -> np.ndarray:
    return column.is_valid().to_numpy(zero_copy_only=False)


def _order(column: pa.Array) -> np.ndarray:
    """Ranks of the values, nulls last; equal values share one."""
    return pc.rank(column, "ascending", null_placement="at_end", tiebreaker="dense").to_numpy(zero_copy_only=False)


def _groups(*keys: np.ndarray) -> np.ndarray:
    """A number for each row that rows with equal keys share."""
    order = np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


@dataclass(frozen=True)
class Limits:
    """Rows at a time; results do not depend on them."""

    #: Records of a cluster in one partition beyond which the cluster takes the steps for hot ones.
    dense: int = 64
    #: Rows that are gathered before they are pruned or settled.
    batch: int = 100_000
    #: Candidates beyond which a partition hands them on.
    held: int = 400_000


class Rows:
    """Columns of a table of candidates as sort keys."""

    def __init__(self, table: pa.Table):
        self.table = table.combine_chunks()
        one = lambda c: self.table.column(c).combine_chunks() if self.table.num_rows else pa.array([], _SCHEMA.field(c).type)
        self.column = {c: one(c) for c in _SCHEMA.names}
        c = self.column
        self.cluster = _groups(_there(c["cluster_id"]), _numbers(c["cluster_id"]))
        self.record = _numbers(c["record"], False)
        self.ts, self.has_ts = _numbers(c["ts"], _LEAST), _there(c["ts"])
        self.n, self.trust = _numbers(c["n"]), _numbers(c["trust"])
        #: Latest first, then higher trust, then the smaller id; a null id last.
        self.late = ~self.ts
        self.recent = [self.late, -self.trust, ~_there(c["client_id"]), _numbers(c["client_id"])]
        self.filled = _there(c["city"]).astype(int) + _there(c["nation_id"])
        self.length = pc.utf8_length(c["name"]).fill_null(-1).to_numpy(zero_copy_only=False)
        latest = np.full(self.cluster.max(initial=-1) + 1, _LEAST)
        np.maximum.at(latest, self.cluster, self.ts)
        self.latest = latest[self.cluster]

    def stale(self, hours: int) -> np.ndarray:
        old = np.zeros(len(self.ts), bool)
        old[self.has_ts] = self.latest[self.has_ts] - self.ts[self.has_ts] > hours * 3_600_000_000
        return old | ~self.has_ts

    def first(self, rows: np.ndarray, groups: list[np.ndarray], order: list[np.ndarray]) -> np.ndarray:
        """Of the masked rows, the first of each group in the order."""
        at = np.nonzero(rows & self.record)[0]
        groups = [g[at] for g in groups]
        ranked = np.lexsort([k[at] for k in order][::-1] + groups[::-1])
        new = np.ones(len(at), bool)
        if len(at):
            new[1:] = False
            for g in groups:
                new[1:] |= g[ranked][1:] != g[ranked][:-1]
        return at[ranked[new]]


def prune(table: pa.Table, hours: int) -> pa.Table:
    """The rows of a table of candidates that can still win a field, with n over all its rows by timestamp."""
    rows = Rows(table)
    c, cluster = rows.column, rows.cluster
    name, email, segment, city = (_there(c[x]) for x in _STRINGS)
    by_segment = _order(c["segment"]) if table.num_rows else np.empty(0, int)
    kept = [
        rows.first(segment, [cluster], [*rows.recent, by_segment]),
        rows.first(email, [cluster, rows.trust], [*rows.recent, _order(c["email"])]),
        rows.first(name, [cluster, rows.trust], [-rows.length, *rows.recent, _order(c["name"])]),
        rows.first(rows.filled > 0, [cluster, rows.trust], [-rows.filled, *rows.recent, _order(c["city"]), _order(c["nation_id"])]),
        rows.first(_there(c["balance"]), [cluster, by_segment], [*rows.recent, _order(c["balance"])]),
    ]
    keep = np.zeros(len(cluster), bool)
    for x in kept:
        keep[x] = True
    # Counts go by timestamp to a kept row that has it, else to a row of their own; what is old already, to one without a timestamp.
    old = rows.stale(hours)
    ts = np.where(old & ~keep, _LEAST, rows.ts)
    group = _groups(cluster, ts)
    sums = np.zeros(group.max(initial=-1) + 1, np.int64)
    np.add.at(sums, group, rows.n)
    order = np.lexsort((~keep, group))
    lead = np.ones(len(order), bool)
    lead[1:] = group[order][1:] != group[order][:-1]
    bearer = order[lead]
    n = np.zeros(len(cluster), np.int64)
    n[bearer] = sums[group[bearer]]
    bare = bearer[~keep[bearer] & (n[bearer] > 0)]
    take = np.concatenate([np.nonzero(keep)[0], bare])
    real = np.arange(len(take)) < len(take) - len(bare)
    out = rows.table.take(pa.array(take))
    blank = pa.array(~real)
    fields = []
    for f in _SCHEMA:
        column = out.column(f.name)
        if f.name == "ts":
            column = pa.array(ts[take], pa.int64(), mask=ts[take] == _LEAST)
        elif f.name == "n":
            column = pa.array(n[take])
        elif f.name == "record":
            column = pa.array(real)
        elif f.name != "cluster_id":
            column = pc.if_else(blank, pa.scalar(None, f.type), column)
        fields.append(column)
    return pa.Table.from_arrays(fields, schema=_SCHEMA)


def _read(batch: pa.RecordBatch, trust: dict[str, int]) -> pa.Table:
    """A batch of source records as candidates."""
    client, master, source, updated, *strings, nation, balance = batch.columns
    visible = lambda x: pc.if_else(pc.match_substring_regex(x, _BLANK), pa.scalar(None, pa.string()), x)
    codes = source.dictionary_encode()
    known = np.array([trust.get(x, 0) for x in codes.dictionary.to_pylist()] + [0], np.int32)
    balance = balance.cast(pa.float64())
    return pa.Table.from_arrays([
        pc.coalesce(master.cast(pa.int64()), client.cast(pa.int64())), updated.cast(pa.timestamp("us", updated.type.tz)).cast(pa.int64()), pa.array(np.ones(len(batch), np.int64)), pa.array(np.ones(len(batch), bool)),
        client.cast(pa.int64()), pa.array(known[codes.indices.fill_null(len(known) - 1).to_numpy(zero_copy_only=False)]), *(visible(x.cast(pa.string())) for x in strings),
        nation.cast(pa.int64()), pc.if_else(pc.is_finite(balance), balance, pa.scalar(None, pa.float64())),
    ], schema=_SCHEMA)


def _routed(table: pa.Table, dense_rows: int, part: int) -> pa.Table:
    """Candidates with their route: dense clusters by the records met, and the bare timestamps of those."""
    met = table.group_by("cluster_id").aggregate([("n", "sum")])
    at = pc.index_in(table.column("cluster_id"), met.column("cluster_id").combine_chunks())
    dense = pc.greater(met.column("n_sum").take(at), dense_rows)
    bare = pc.and_(pc.and_(dense, pc.invert(table.column("record"))), table.column("ts").is_valid())
    return table.append_column("dense", dense).append_column("times", bare).append_column("part", pa.array(np.full(table.num_rows, part, np.int32)))


def _pruned(batches, hours: int, limits: Limits, ready, part: int):
    """Prune the tables of a partition as they come; candidates beyond limits.held are handed on."""
    held, n, kept = [], 0, 0
    for batch in batches:
        held.append(ready(batch))
        n += batch.num_rows
        if n - kept > limits.batch:
            held = [prune(pa.concat_tables(held), hours)]
            n = kept = held[0].num_rows
            if n > limits.held:
                yield from _routed(held[0], limits.dense, part).to_batches(max_chunksize=20_000)
                held, n, kept = [], 0, 0
    if held:
        yield from _routed(prune(pa.concat_tables(held), hours), limits.dense, part).to_batches(max_chunksize=20_000)
    release_memory()


def settle(table: pa.Table, hours: int) -> pa.Table:
    """The golden records of whole clusters."""
    rows = Rows(table)
    c, cluster = rows.column, rows.cluster
    k = cluster.max(initial=-1) + 1
    stale = rows.stale(hours)
    trusted = [stale, -rows.trust, *rows.recent]
    total = lambda mask: np.bincount(cluster, np.where(mask, rows.n, 0), k).astype(np.int64)
    by_segment = _order(c["segment"]) if table.num_rows else np.empty(0, int)

    def winner(rows_in, order) -> np.ndarray:
        out = np.full(k, -1)
        at = rows.first(rows_in, [cluster], order)
        out[cluster[at]] = at
        return out

    def value(column: str, at: np.ndarray) -> pa.Array:
        return c[column].take(pa.array(at, mask=at < 0))

    segment = winner(_there(c["segment"]), [*rows.recent, by_segment])
    chosen = np.where(segment >= 0, by_segment[segment] if len(by_segment) else 0, -1)[cluster]
    email = winner(_there(c["email"]), [*trusted, _order(c["email"])])
    name = winner(_there(c["name"]), [-rows.length, *trusted, _order(c["name"])])
    address = winner(rows.filled > 0, [-rows.filled, *trusted, _order(c["city"]), _order(c["nation_id"])])
    balance = winner(_there(c["balance"]), [by_segment != chosen, *rows.recent, _order(c["balance"])])
    lead = np.unique(cluster, return_index=True)[1]
    cents = pc.floor(pc.add(pc.multiply(value("balance", balance), 100.0), 0.5)).cast(pa.int64())
    sources = [value("client_id", x) for x in (name, email, segment, balance, address)]
    columns = [c["cluster_id"].take(pa.array(lead)), pa.array(total(True)), pa.array(total(stale)), value("name", name), value("email", email), value("segment", segment), value("city", address), value("nation_id", address), cents, *sources]
    return pa.Table.from_arrays(columns, [x.split()[0] for x in _GOLDEN.split(", ")])


def _settled(batches, hours: int, limits: Limits):
    """Golden records of rows sorted by cluster: all clusters of a batch but its last, which stays open."""
    held, n = [], 0
    for batch in batches:
        held.append(pa.Table.from_arrays(batch.columns, schema=_SCHEMA))
        n += batch.num_rows
        if n < limits.batch:
            continue
        table = pa.concat_tables(held).combine_chunks()
        key = table.column("cluster_id")
        last = key[table.num_rows - 1]
        same = pc.is_null(key) if not last.is_valid else pc.fill_null(pc.equal(key, last), False)
        if not pc.all(same).as_py():
            yield from settle(table.filter(pc.invert(same)), hours).to_batches()
        held = [prune(table.filter(same), hours)]
        n = held[0].num_rows
    if n:
        yield from settle(pa.concat_tables(held), hours).to_batches()
    release_memory()


@dataclass(frozen=True)
class Names:
    """The column names of a table of source records."""

    client: str = "client_id"
    master: str = "master_id"
    source: str = "source"
    updated: str = "updated_at"
    name: str = "name"
    email: str = "email"
    segment: str = "segment"
    city: str = "city"
    nation: str = "nation_id"
    balance: str = "balance"


def golden_records(records: DataFrame, names: Names = Names(), trust: tuple[str, ...] = TRUST, stale_hours: int = STALE_HOURS, limits: Limits = Limits()) -> DataFrame:
    """One row per cluster: counts, the surviving value of each field and the id of the record that gave it."""
    spark = records.sparkSession
    levels = {s: len(trust) - i for i, s in enumerate(trust)}
    picked = records.select(*(named(getattr(names, f)).alias(f) for f in Names.__dataclass_fields__))

    def first_cut(batches):
        yield from _pruned(batches, stale_hours, limits, lambda b: _read(b, levels), TaskContext.get().partitionId())

    def second_cut(batches):
        for b in _pruned(batches, stale_hours, limits, lambda b: pa.Table.from_arrays(b.columns, schema=_SCHEMA), 0):
            yield b.select(_SCHEMA.names)

    rows = staged(picked.mapInArrow(first_cut, _ROUTED))
    plain = [x.split()[0] for x in _COLUMNS.split(", ")]
    # Hot clusters: candidates of some partitions meet first; the square root keeps both steps short.
    parts = max(2, round(picked.rdd.getNumPartitions() ** 0.5))
    met = rows.where("dense and not times").withColumn("some", F.col("part") % parts).repartition("cluster_id", "some").select(*plain).mapInArrow(second_cut, _COLUMNS)
    # Their timestamps count as stale or fresh once the cluster's latest is known; a salt deals them out.
    salts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    latest = rows.groupBy("cluster_id").agg(F.max("ts").alias("latest"), F.max("times").alias("hot")).where("hot").select(F.col("cluster_id").alias("whose"), "latest", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))).alias("salt"))
    times = rows.where("times").select("cluster_id", "ts", "n", F.pmod(F.xxhash64("ts"), F.lit(salts)).cast("int").alias("salt"))
    counted = times.join(latest, times.cluster_id.eqNullSafe(latest.whose) & (times.salt == latest.salt)).groupBy("cluster_id", F.expr(f"if(latest - ts > {stale_hours * 3_600_000_000}, null, latest)").alias("ts")).agg(F.sum("n").alias("n"))
    empty = {x.split()[0]: F.lit(None).cast(x.split()[1]) for x in _COLUMNS.split(", ")}
    counts = counted.select(*(F.lit(False).alias(c) if c == "record" else F.col(c) if c in ("cluster_id", "ts", "n") else empty[c].alias(c) for c in plain))
    whole = rows.where("not dense").select(*plain).unionByName(met).unionByName(counts)
    golden = whole.repartition("cluster_id").sortWithinPartitions("cluster_id").mapInArrow(lambda b: _settled(b, stale_hours, limits), _GOLDEN)
    return golden.withColumn("nation_id", F.col("nation_id").cast(records.schema[names.nation].dataType))


def query(spark, sf_dir: str) -> DataFrame:
    from .common import read_table

    return golden_records(read_table(spark, sf_dir, "clients"))
