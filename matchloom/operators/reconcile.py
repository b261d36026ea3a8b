"""Differences between two copies of data, by set reconciliation.

Each side reduces its rows to hashes in the field of 2^61 - 1, spread over buckets, and keeps of a
bucket only values of its characteristic polynomial, the product of (z - h) over its hashes, at
points z. The ratio of both sides' values is a rational function whose numerator and denominator
have the differing hashes as roots. It is rebuilt under a degree bound, verified at further points,
and buckets that fail are tried again with twice the bound. Only then are the differing rows fetched
and compared field by field. So a bucket costs transfer in proportion to what differs, not to what
it holds.

Repeated rows are counted before anything is moved; the hash covers the count, so a row repeated
any number of times is one element. Defined results: null and NaN equal each other and nothing else;
rows equal in canonical form are no difference; a null key forms a group of its own; empty tables
give the other side's rows as lacking; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import field61 as field
from matchloom.operators import canonical
from matchloom.session import keep, table

KEYS = ("submission_id", "answer_view", "makh")
FIELDS = ("tenkh", "tongtien", "ngayhd")
#: Rows a bucket holds on average, degree bound of the first round, further points for verification.
BUCKET_ROWS, FIRST_BOUND, EXTRA = 32, 8, 2
#: Degree bound up to which buckets are solved; a bucket holds fewer rows than that on average.
LAST_BOUND = 512
#: Hashes a task works on at once.
TASK_ROWS = 250_000
#: Points lie above every hash, so no value is zero.
_TOP = field.P - (1 << 20)


def points(n: int) -> list[int]:
    return [_TOP + 1 + i for i in range(n)]


def _hash(columns: list[Column]) -> Column:
    marked = [F.coalesce(c.cast("string"), F.lit("\0")) for c in columns]
    return F.pmod(F.xxhash64(*marked), F.lit(_TOP))


def hashed(rows: DataFrame, keys: tuple[str, ...], fields: tuple[str, ...], buckets: int) -> DataFrame:
    """Canonical rows with their bucket and row hash."""
    columns = [F.col(c) for c in (*keys, *fields)]
    spread = F.hash(*[F.coalesce(c.cast("string"), F.lit("\0")) for c in columns])
    return rows.select(*keys, *fields, F.pmod(spread, F.lit(buckets)).alias("bucket"), _hash(columns).alias("row_hash"))


def elements(rows: DataFrame) -> DataFrame:
    """Distinct rows of a side as field elements that cover the row's count."""
    counted = rows.groupBy("bucket", "row_hash").agg(F.count(F.lit(1)).alias("n"))
    return counted.withColumn("element", F.pmod(F.xxhash64("row_hash", "n"), F.lit(_TOP)))


def _sketcher(bound: int):
    zs = points(bound + EXTRA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [(b.column(0).to_numpy(), b.column(1).to_numpy()) for b in batches if b.num_rows]
        if not parts:
            return
        bucket, element = (np.concatenate(x) for x in zip(*parts))
        order = np.argsort(bucket, kind="stable")
        bucket, element = bucket[order], element[order].astype(np.uint64)
        starts = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
        values = np.stack([field.segment_products(field.minus(z, element), starts) for z in zs], axis=1)
        flat = pa.array(values.astype(np.int64).ravel())
        lists = pa.FixedSizeListArray.from_arrays(flat, len(zs)).cast(pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(bucket[starts]), pa.array(np.diff(np.r_[starts, len(bucket)])), lists], names=["bucket", "size", "values"])

    return run


def sketch(side: DataFrame, bound: int, tasks: int) -> DataFrame:
    """Per bucket: the number of elements and the characteristic polynomial's values. Whole buckets come to a task."""
    return side.select("bucket", "element").repartition(tasks, "bucket").mapInArrow(_sketcher(bound), "bucket int, size bigint, values array<bigint>")


def solve(size_a: int, a: list[int], size_b: int, b: list[int], bound: int) -> tuple[list[int], list[int]] | None:
    """The elements only a has and only b has, or None when they may be more than the bound allows."""
    delta = size_a - size_b
    if abs(delta) >= bound:
        return None
    zs = points(bound + EXTRA)
    values = [x * field.inverse(y) % field.P for x, y in zip(a, b)]
    top, bottom = field.ratio(zs[:bound], values[:bound], (bound - 1 + delta) // 2)
    if not top or not bottom or len(top) - len(bottom) != delta:
        return None
    if any(field.value(top, z) != v * field.value(bottom, z) % field.P for z, v in zip(zs, values)):
        return None
    only_a, only_b = field.roots(top), field.roots(bottom)
    return None if only_a is None or only_b is None else (only_a, only_b)


def _solver(bound: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {"bucket": [], "side": [], "element": []}
            for r in batch.to_pylist():
                ones = [1] * (bound + EXTRA)
                solved = solve(r["size_a"] or 0, r["a"] or ones, r["size_b"] or 0, r["b"] or ones, bound)
                found = [(None, None)] if solved is None else [(s, e) for s, side in enumerate(solved) for e in side]
                for side, element in found:
                    out["bucket"].append(r["bucket"])
                    out["side"].append(side)
                    out["element"].append(element)
            yield pa.RecordBatch.from_arrays([pa.array(out["bucket"], pa.int32()), pa.array(out["side"], pa.int32()), pa.array(out["element"], pa.int64())], names=list(out))

    return run


def reconcile(a: DataFrame, b: DataFrame, tasks: int, bound: int = FIRST_BOUND) -> DataFrame:
    """(bucket, side, element) of what only side 0 or only side 1 has. a, b: `elements`.

    Each round rebuilds sketches of the buckets that are still open. What no bound up to LAST_BOUND solves (buckets with
    that many differences, or with two equal elements, whose double root no bound splits) is compared element by element.
    """
    done: list[DataFrame] = []
    while bound <= LAST_BOUND:
        sa, sb = (sketch(s, bound, tasks) for s in (a, b))
        both = sa.withColumnsRenamed({"size": "size_a", "values": "a"}).join(sb.withColumnsRenamed({"size": "size_b", "values": "b"}), "bucket", "full")
        result = keep(both.repartition(tasks, "bucket").mapInArrow(_solver(bound), "bucket int, side int, element bigint"), f"solved-{bound}")
        done.append(result.where("side IS NOT NULL"))
        still_open = result.where("side IS NULL").select("bucket")
        if still_open.isEmpty():
            return reduce(DataFrame.unionByName, done)
        # written, as a join right below `sketch` would take the place of its repartitioning and may be
        # changed at run time into one that leaves a bucket's rows in several tasks
        a, b = (keep(s.join(still_open, "bucket", "left_semi"), f"open-{bound}") for s in (a, b))
        bound *= 2
    only = lambda x, y, side: x.select("bucket", F.lit(side).alias("side"), "element").join(y, ["bucket", "element"], "left_anti").select("bucket", "side", "element")
    return reduce(DataFrame.unionByName, [*done, only(a, b, 0), only(b, a, 1)])


def differing_rows(left: DataFrame, right: DataFrame, keys: tuple[str, ...] = KEYS, fields: tuple[str, ...] = FIELDS, rows: int | None = None) -> DataFrame:
    """The rows one side has more often: keys, fields, net (positive: left has so many more).

    left, right: canonical rows. `rows` sizes the buckets and defaults to a count of both sides.
    """
    total = rows if rows is not None else left.count() + right.count()
    buckets = max(1, total // (2 * BUCKET_ROWS))
    tasks = max(int(left.sparkSession.conf.get("spark.sql.shuffle.partitions")), total // TASK_ROWS)
    stored = [keep(hashed(side, keys, fields, buckets), f"rows-{i}") for i, side in enumerate((left, right))]
    counted = [keep(elements(s), f"elements-{i}") for i, s in enumerate(stored)]
    found = reconcile(*counted, tasks)
    parts = []
    for side, (full, counts) in enumerate(zip(stored, counted)):
        hashes = counts.join(found.where(F.col("side") == side).select("bucket", "element"), ["bucket", "element"])
        signed = F.col("n") if side == 0 else -F.col("n")
        parts.append((hashes.select("bucket", "row_hash", signed.alias("n")), full))
    net = parts[0][0].unionByName(parts[1][0]).groupBy("bucket", "row_hash").agg(F.sum("n").alias("net"))
    fetched = [full.join(hashes.select("bucket", "row_hash"), ["bucket", "row_hash"], "left_semi").distinct() for hashes, full in parts]
    return fetched[0].unionByName(fetched[1]).distinct().join(net, ["bucket", "row_hash"]).select(*keys, *fields, "net")


def field_differences(diff: DataFrame, keys: tuple[str, ...] = KEYS, fields: tuple[str, ...] = FIELDS, left: str = "answer_only", right: str = "student_only", tie_order: tuple[str, ...] = ("tongtien", "ngayhd", "tenkh")) -> DataFrame:
    """Per key: which side has more rows, else each field whose values differ, as column ``diff``.

    Where every single field has the same values on both sides and only their combination differs, the first
    field of `tie_order` without which the rows agree is named, and if there is none, all fields.
    """
    groups = [F.coalesce(F.col(k).cast("string"), F.lit("\0")).alias(f"_{k}") for k in keys]
    diff = diff.select(*diff.columns, *groups)
    by = [*keys, *(f"_{k}" for k in keys)]
    views = [(f, [f]) for f in fields] + [(f"without {f}", [g for g in fields if g != f]) for f in fields]
    facets = F.array(*[F.struct(F.lit(name).alias("view"), F.xxhash64(*[F.coalesce(F.col(c).cast("string"), F.lit("\0")) for c in columns]).alias("value")) for name, columns in views])
    per_value = diff.select(*by, "net", F.inline(facets)).groupBy(*by, "view", "value").agg(F.sum("net").alias("net"))
    per_key = per_value.groupBy(*by).agg(
        F.sum(F.when(F.col("view") == fields[0], F.col("net"))).alias("net"),
        F.collect_set(F.when(F.col("net") != 0, F.col("view"))).alias("unequal"),
    )
    single = F.array_intersect("unequal", F.array(*map(F.lit, fields)))
    swapped = reduce(lambda rest, f: F.when(~F.array_contains("unequal", f"without {f}"), F.array(F.lit(f))).otherwise(rest), reversed(tie_order), F.array(*map(F.lit, fields)))
    found = F.when(F.col("net") > 0, F.array(F.lit(left))).when(F.col("net") < 0, F.array(F.lit(right))).when(F.size(single) > 0, single).otherwise(swapped)
    return per_key.select(*keys, F.explode(found).alias("diff"))


def canonical_output(df: DataFrame) -> DataFrame:
    """View output rows of this data in canonical form."""
    return df.select(
        "submission_id",
        "answer_view",
        F.upper(F.regexp_replace("makh", r"(?U)^\s+|\s+$", "")).alias("makh"),
        canonical.text(F.col("tenkh")).alias("tenkh"),
        canonical.number(F.col("tongtien")).alias("tongtien"),
        canonical.date(F.col("ngayhd")).alias("ngayhd"),
    )


def view_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the two copies of every tested view's result that differ, with their net count."""
    copies = [table(spark, sf_dir, f"view_output_{side}", *KEYS, *FIELDS) for side in ("answer", "student")]
    return differing_rows(*map(canonical_output, copies), rows=sum(c.count() for c in copies))


def view_field_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """p3_found: submission_id, answer_view, makh, diff."""
    return field_differences(view_differences(spark, sf_dir))


def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per reported test of a view whose outputs are stored: the counts the report should show, and whether it does.

    Views are taken from the outputs' own (submission_id, answer_view); a view without differences has zeros.
    """
    tests = ["submission_id", "answer_view"]
    plus, minus = F.sum(F.greatest(F.col("net"), F.lit(0))), F.sum(F.greatest(-F.col("net"), F.lit(0)))
    counts = view_differences(spark, sf_dir).groupBy(*tests).agg(plus.alias("a"), minus.alias("s"))
    stored = reduce(DataFrame.unionByName, [table(spark, sf_dir, f"view_output_{side}", *tests).distinct() for side in ("answer", "student")]).distinct()
    report = table(spark, sf_dir, "view_test_report", "test_id", *tests, "answer_minus_student_count", "student_minus_answer_count", "value_mismatch_count")
    known = report.join(stored, tests).join(counts, tests, "left").withColumns({c: F.coalesce(F.col(c), F.lit(0)) for c in ("a", "s")})
    shown = F.struct("answer_minus_student_count", "student_minus_answer_count", "value_mismatch_count")
    right = F.struct(F.col("a").cast("int"), F.col("s").cast("int"), F.least("a", "s").cast("int"))
    return known.select(
        "test_id", *tests, F.col("a").alias("answer_minus_student"), F.col("s").alias("student_minus_answer"), F.least("a", "s").alias("value_mismatch"), shown.eqNullSafe(right).alias("report_agrees")
    )
