"""References to records that do not exist.

State is kept per parent table and key, in buckets of the key (`keyedstate`): the parent rows, a log of the
references seen, and the references listed (pending). `OrphanState.fold` takes in one batch:

* new references probe the parents of their buckets,
* arriving parents resolve listed references of their keys,
* deletions reopen references of their keys, which are read back from the log's buckets.

So a batch reads the buckets it touches and rewrites the pending rows of those to which parents came; whatever
else the state holds is left alone. A reference is covered when an undeleted parent row of its key was loaded no
later than the reference itself. The rest is listed with a reason:

* ``late``     an undeleted parent exists, but was loaded after the reference (resolved, still listed)
* ``deleted``  every parent row of the key is deleted
* ``missing``  no parent row of the key exists

Whole tables are folded in batches too, one per calendar year of what happened (loads and deletions).

Defined results for edge cases: null, blank and ``NULL`` texts are no references and are left out;
letter case, blanks, hyphens and zero padding make no other key; a parent row with a null
``loaded_at`` counts as loaded at the beginning of time; a reference with a null ``loaded_at`` is
covered by any undeleted parent; repeated parent rows change nothing; repeated references are listed
one by one; empty tables give empty results; extra columns are ignored. The result does not depend on how
the events are cut into batches.
"""

from __future__ import annotations

from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.operators.keyedstate import KeyedState
from matchloom.session import keep, scratch, small, table

#: Buckets of the state by its key; more for more data, as a bucket is what a touched key makes a batch read.
BUCKETS = 8

#: child table, reference column, parent table, parent key column
SALES_LINKS = (
    ("banhang", "makh", "khachhang", "makh"),
    ("banhang", "manv", "nhanvien", "manv"),
    ("chitietbanhang", "mahd", "banhang", "mahd"),
    ("chitietbanhang", "mahang", "hang", "mahang"),
)

REFS = "child_table string, ref_column string, parent_table string, row_id bigint, ref_key string, loaded_at timestamp_ntz"
PARENTS = "parent_table string, ref_key string, row_id bigint, loaded_at timestamp_ntz, deleted_at timestamp_ntz"


def _key(c: Column | str) -> Column:
    c = F.col(c) if isinstance(c, str) else c
    bare = F.upper(F.regexp_replace(c, r"[\s\p{Z}\p{Pd}]+", ""))
    return F.regexp_replace(bare, r"^([^0-9]*)0+([0-9])", "$1$2")


def _no_reference(key: Column) -> Column:
    return (key == "") | (key == "NULL")


def reference_key(c: Column | str) -> Column:
    """Upper case without blanks, hyphens and zero padding; null where the text is no reference."""
    return F.when(~_no_reference(_key(c)), _key(c))


def _with_key(df: DataFrame, c: str, *columns: Column) -> DataFrame:
    """`columns` and ref_key of the rows with a reference; as a generator, so that the key is computed once a row and not again for a filter."""
    return df.select(*columns, F.explode(F.filter(F.array(_key(c)), lambda k: ~_no_reference(k))).alias("ref_key"))


def references(df: DataFrame, child_table: str, ref_column: str, parent_table: str, row_id: str = "row_id", loaded_at: str = "loaded_at") -> DataFrame:
    """The rows of `df` that refer to something, in the layout REFS."""
    names = [F.lit(v).alias(k) for k, v in (("child_table", child_table), ("ref_column", ref_column), ("parent_table", parent_table))]
    rows = _with_key(df, ref_column, F.col(row_id).cast("bigint").alias("row_id"), F.col(loaded_at).cast("timestamp_ntz").alias("loaded_at"))
    return rows.select(*names, "row_id", "ref_key", "loaded_at")


def parents(df: DataFrame, parent_table: str, key: str, row_id: str = "row_id", loaded_at: str = "loaded_at", deleted_at: str = "deleted_at") -> DataFrame:
    """The rows of `df` as parents, in the layout PARENTS. A later version of a row_id with deleted_at is its deletion."""
    loaded = F.coalesce(F.col(loaded_at).cast("timestamp_ntz"), F.lit("0001-01-01").cast("timestamp_ntz")).alias("loaded_at")
    rows = _with_key(df, key, F.col(row_id).cast("bigint").alias("row_id"), loaded, F.col(deleted_at).cast("timestamp_ntz").alias("deleted_at"))
    return rows.select(F.lit(parent_table).alias("parent_table"), "ref_key", "row_id", "loaded_at", "deleted_at")


def parent_index(rows: DataFrame, versions: bool = False) -> DataFrame:
    """Per key: the first load of an undeleted row (null: all are deleted).

    `versions` says that a row_id may stand in `rows` more than once (deletions sent after the row).
    """
    if versions:
        gone = rows.where("deleted_at IS NOT NULL").select("parent_table", "ref_key", "row_id").distinct()
        alive = rows.where("deleted_at IS NULL").join(small(gone, None), ["parent_table", "ref_key", "row_id"], "left_anti")
        rows = alive.select("parent_table", "ref_key", "loaded_at").unionByName(gone.select("parent_table", "ref_key", F.lit(None).cast("timestamp_ntz").alias("loaded_at")))
        first = F.min("loaded_at")
    else:
        first = F.min(F.when(F.col("deleted_at").isNull(), F.col("loaded_at")))
    return rows.groupBy("parent_table", "ref_key").agg(first.alias("alive_from"), F.lit(True).alias("known"))


def probe(refs: DataFrame, index: DataFrame) -> DataFrame:
    """Refs with their reason; null: covered. One row per reference.

    The index has one row per key, so no key makes its side of a shuffled hash join uneven, and references need no sort.
    """
    found = refs.join(index.hint("shuffle_hash"), ["parent_table", "ref_key"], "left")
    reason = (
        F.when(F.col("known").isNull(), "missing")
        .when(F.col("alive_from").isNull(), "deleted")
        .when(F.col("alive_from") > F.col("loaded_at"), "late")
    )
    return found.select(*refs.columns, reason.alias("reason"), F.when(reason == "late", F.col("alive_from")).alias("resolved_at"))


LISTED = REFS + ", reason string, resolved_at timestamp_ntz"
_REF_COLUMNS = [c.strip().split(" ")[0] for c in REFS.split(",")]
_KEYS = ("parent_table", "ref_key")


class OrphanState:
    """The folded state in a folder; `batch` is the last batch folded in."""

    def __init__(self, spark: SparkSession, folder: str, buckets: int = BUCKETS, batch: int = -1):
        self.spark, self.batch = spark, batch
        self.store = KeyedState(folder, {"parents": PARENTS, "refs": REFS, "pending": LISTED}, _KEYS, buckets)
        self.manifest = self.store.manifest(spark, batch)

    def pending(self) -> DataFrame:
        """All listed references with their reason."""
        return self.store.read(self.spark, self.manifest, "pending").drop("bucket")

    def fold(self, new_parents: DataFrame, new_refs: DataFrame) -> None:
        """Takes in a batch. A parent row sent again with deleted_at is its deletion."""
        spark, store, batch, old = self.spark, self.store, self.batch + 1, self.manifest
        version = str(batch)
        old = store.compacted(spark, store.compacted(spark, old, "parents", f"{version}p"), "refs", f"{version}r")
        bucketed = lambda rows: rows.withColumn("bucket", store.bucket())
        arrived = store.write("parents", bucketed(new_parents), version)
        logged = store.write("refs", bucketed(new_refs), version)
        now = {
            "parents": store.appended(old["parents"], arrived, version),
            "refs": store.appended(old["refs"], logged, version),
        }
        batch_only = {"parents": dict.fromkeys(arrived, [version]), "refs": dict.fromkeys(logged, [version])}
        index = parent_index(store.read(spark, now, "parents", {*arrived, *logged}), versions=True)

        judged = [probe(store.read(spark, batch_only, "refs"), index)]
        if arrived:
            gone = store.read(spark, batch_only, "parents").where("deleted_at IS NOT NULL").select(*_KEYS, "bucket").distinct()
            hit = {r["bucket"] for r in gone.select("bucket").distinct().collect()}
            waiting = store.read(spark, old, "pending", arrived).select(*_REF_COLUMNS, "bucket")
            if hit:
                gone = small(keep(gone.drop("bucket"), "gone"), None)
                waiting = waiting.join(gone, list(_KEYS), "left_anti")
                judged.append(probe(store.read(spark, old, "refs", hit).join(gone, list(_KEYS), "left_semi"), index))
            judged.append(probe(waiting, index))
        listed = reduce(DataFrame.unionByName, judged).where("reason IS NOT NULL")
        written = store.write("pending", listed, version)
        pending = store.replaced(old["pending"], arrived, written, version)
        self.manifest = {**now, "pending": store.appended(pending, set(written) - set(arrived), version)}
        store.commit(spark, batch, self.manifest)
        self.batch = batch


def snapshot(pending: DataFrame) -> DataFrame:
    """Counts of the listed references per table, column and month of loading."""
    return pending.groupBy("child_table", "ref_column", F.date_format("loaded_at", "yyyy-MM").alias("period"), "reason").agg(F.count(F.lit(1)).alias("orphans"))


def years(parent_rows: DataFrame, refs: DataFrame) -> list[datetime | None]:
    """Ends of the calendar years in which anything happened, the last one open (None)."""
    at = lambda df, *columns: [df.select(F.year(c).alias("y")) for c in columns]
    seen = reduce(DataFrame.unionByName, [*at(parent_rows, "loaded_at", "deleted_at"), *at(refs, "loaded_at")]).where("y IS NOT NULL").distinct()
    found = sorted(r["y"] for r in seen.collect())
    return [datetime(y + 1, 1, 1) for y in found[:-1] if y < 9999] + [None]


def happened(rows: DataFrame, start: datetime | None, end: datetime | None, deletable: bool) -> DataFrame:
    """What happened to `rows` (loaded_at and, if deletable, deleted_at) from `start` on before `end`; None is open.

    A deletion shows only once it has happened, and then the row comes again with it. Rows without a time come first.
    """
    stamp = lambda c: F.col(c).cast("timestamp_ntz")
    before = lambda c: F.lit(True) if end is None else stamp(c) < F.lit(end).cast("timestamp_ntz")
    since = lambda c: F.lit(True) if start is None else stamp(c) >= F.lit(start).cast("timestamp_ntz")
    loads = F.coalesce(since("loaded_at") & before("loaded_at"), F.lit(start is None))
    if not deletable:
        return rows.where(loads)
    deletions = F.col("deleted_at").isNotNull() & since("deleted_at") & before("deleted_at") & F.coalesce(before("loaded_at"), F.lit(True))
    return rows.where(loads | deletions).withColumn("deleted_at", F.when(before("deleted_at"), stamp("deleted_at")))


def folded(spark: SparkSession, read, ends: list[datetime | None], folder: str, buckets: int = BUCKETS, each=None) -> OrphanState:
    """The state after `read(start, end)`, the parents and references of each batch; ends ascend, None is no end.

    `each` is called with the state and the end after every batch, as for periodic snapshots.
    """
    state, start = OrphanState(spark, folder, buckets), None
    for end in ends:
        state.fold(*read(start, end))
        if each:
            each(state, end)
        start = end
    return state


def _tables(spark: SparkSession, sf_dir: str, start: datetime | None, end: datetime | None, links=SALES_LINKS) -> tuple[DataFrame, DataFrame]:
    """Parent rows (each parent table once) and references of one batch; the time is tested before keys are normalised."""
    of = {parent: key for _, _, parent, key in links}
    took = lambda t, *columns: happened(table(spark, sf_dir, t, *columns), start, end, "deleted_at" in columns)
    rows = [parents(took(parent, "row_id", key, "loaded_at", "deleted_at"), parent, key) for parent, key in of.items()]
    refs = [references(took(child, "row_id", column, "loaded_at"), child, column, parent) for child, column, parent, _ in links]
    return reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, refs)


def _times(spark: SparkSession, sf_dir: str, links=SALES_LINKS) -> list[datetime | None]:
    """Batches of these tables, from their time columns alone."""
    of = {parent for _, _, parent, _ in links}
    rows = reduce(DataFrame.unionByName, [table(spark, sf_dir, t, "loaded_at", "deleted_at") for t in sorted(of)])
    refs = reduce(DataFrame.unionByName, [table(spark, sf_dir, t, "loaded_at") for t in sorted({c for c, *_ in links} - of)])
    return years(rows, refs)


def folded_tables(spark: SparkSession, sf_dir: str, each=None) -> OrphanState:
    """The state after the sales tables, one batch per calendar year."""
    read = lambda start, end: _tables(spark, sf_dir, start, end)
    return folded(spark, read, _times(spark, sf_dir), scratch(spark, "orphans"), each=each)


def orphan_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p5_found: child_table, ref_column, row_id."""
    return folded_tables(spark, sf_dir).pending().select("child_table", "ref_column", "row_id")


def orphan_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per child table, column and month of loading: references, and orphans by reason, after the last batch."""
    state = folded_tables(spark, sf_dir)
    by = ["child_table", "ref_column", "period"]
    period = F.date_format("loaded_at", "yyyy-MM").alias("period")
    of = lambda reason: F.count(F.when(F.col("reason") == reason, 1)).alias(reason)
    seen = state.store.read(spark, state.manifest, "refs").groupBy("child_table", "ref_column", period).agg(F.count(F.lit(1)).alias("refs"))
    listed = state.pending().groupBy("child_table", "ref_column", period).agg(F.count(F.lit(1)).alias("orphans"), of("missing"), of("deleted"), of("late"))
    same = [F.col(f"s.{c}").eqNullSafe(F.col(f"o.{c}")) for c in by]
    zero = [F.coalesce(F.col(f"o.{c}"), F.lit(0)).alias(c) for c in ("orphans", "missing", "deleted", "late")]
    return seen.alias("s").join(listed.alias("o"), same, "left").select(*[f"s.{c}" for c in by], "s.refs", *zero)


def orphan_snapshots(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the listed references at the end of each calendar year, as the state stood then, by reason."""
    taken: list[DataFrame] = []

    def take(state: OrphanState, end: datetime | None) -> None:
        counts = snapshot(state.pending()).groupBy("child_table", "ref_column", "reason").agg(F.sum("orphans").alias("orphans"))
        taken.append(keep(counts.select(F.lit(end).cast("timestamp_ntz").alias("before"), "child_table", "ref_column", "reason", "orphans"), "snapshot"))

    folded_tables(spark, sf_dir, each=take)
    return reduce(DataFrame.unionByName, taken)
