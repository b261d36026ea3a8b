"""Comparison of a candidate's output with the reference's: as multisets or row by row in a given order."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.config import ViewRules
from matchloom.functions import text
from matchloom.operators import canonical
from matchloom.session import keep

EMPTY = {"row_count_answer": 0, "row_count_student": 0, "answer_minus_student_count": 0, "student_minus_answer_count": 0, "value_mismatch_count": 0}


class AmbiguousColumns(ValueError):
    """An output column may stand for several expected ones, or several columns for one."""


def _similarity(a: str, b: str) -> float:
    """Indel similarity of two short names, 0 to 100 (driver side, on column names only)."""
    row = [0] * (len(b) + 1)
    for x in a:
        row = [0] + [0] * len(b) if not b else _next_row(row, x, b)
    return 200.0 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def _next_row(above: list[int], x: str, b: str) -> list[int]:
    row = [0]
    for j, y in enumerate(b):
        row.append(above[j] + 1 if x == y else max(above[j + 1], row[-1]))
    return row


#: A name: a numbering, the mark of a question, and what it is called. Dashes and dots belong to what stands before them.
_NAME = re.compile(r"\s*(?P<number>\d+[.\s_–-]*)?(?P<question>cau\s*\d*[.\s_–-]*)?(?P<called>.*)", re.S)


def plain_key(name: str | None) -> str:
    """Compact key of a column name, on the driver: what `functions.text.normalize_key` computes for a column."""
    called = _NAME.match(text.base_letters(name or "").lower())["called"]
    return "".join(filter(str.isalnum, called))


def resolve_columns(columns: Iterable[str], view: ViewRules, accepted: Mapping[str, str] | None = None) -> dict[str, str]:
    """Physical to expected column names: by name or alias, by accepted mappings, by similarity. Ties and two-to-one are errors."""
    expected = {plain_key(c): (c, {plain_key(a) for a in aliases}) for c, _, aliases in view.columns}
    known = {plain_key(k): v for k, v in (accepted or {}).items()}
    out: dict[str, str] = {}
    for physical in columns:
        key = plain_key(physical)
        found = next((c for k, (c, aliases) in expected.items() if key == k or key in aliases), None)
        if found is None and plain_key(known.get(key, "")) in expected:
            found = expected[plain_key(known[key])][0]
        if found is None:
            scores = {c: max(_similarity(key, n) for n in (k, *aliases)) for k, (c, aliases) in expected.items()}
            top = max(scores.values(), default=0.0)
            best = [c for c, s in scores.items() if s == top and s >= view.column_threshold * 100]
            if len(best) > 1:
                raise AmbiguousColumns(f"{physical!r} may be any of {best}")
            found = best[0] if best else None
        if found is not None:
            out[physical] = found
    if len(set(out.values())) < len(out):
        raise AmbiguousColumns(f"several columns stand for one: {out}")
    return out


def canonicalize(df: DataFrame, view: ViewRules, accepted: Mapping[str, str] | None = None, number_as_text: bool = False) -> DataFrame:
    """An output in the expected columns and canonical values. A multiset needs no sort, so none is done."""
    return canonical.align(df, [(c, t) for c, t, _ in view.columns], resolve_columns(df.columns, view, accepted), view.tolerance, number_as_text)


def signed_counts(answer: DataFrame, student: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Distinct rows with `net`, how many more of them the answer has. One shuffle serves both differences.

    Partial sums are built before the shuffle, so repeated rows are moved once per task.
    """
    both = answer.withColumn("net", F.lit(1)).unionByName(student.withColumn("net", F.lit(-1)))
    columns = [c for c in both.columns if c != "net"]
    return both.groupBy(*columns).agg(F.sum("net").alias("net"), F.count(F.when(F.col("net") > 0, 1)).alias("n_answer"), F.count(F.when(F.col("net") < 0, 1)).alias("n_student"))


def minus(counts: DataFrame, answer: bool = True) -> DataFrame:
    """Rows one side has more often, repeated as often as it has them more."""
    n = F.col("net") if answer else -F.col("net")
    columns = [c for c in counts.columns if c not in ("net", "n_answer", "n_student")]
    return counts.where(n > 0).select(*columns, F.explode(F.sequence(F.lit(1), n.cast("int"))).alias("_k")).drop("_k")


def tagged_differences(counts: DataFrame) -> DataFrame:
    """Both differences with `_source`."""
    return minus(counts).withColumn("_source", F.lit("answer_only")).unionByName(minus(counts, False).withColumn("_source", F.lit("student_only")))


def multiset_metrics(answer: DataFrame, student: DataFrame, by: tuple[str, ...] = ()) -> DataFrame:
    """Counts of rows on both sides, both differences and mismatched values (the smaller difference), per `by`."""
    counts = signed_counts(answer, student)
    zero = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    out = counts.groupBy(*by).agg(
        zero("n_answer").alias("row_count_answer"),
        zero("n_student").alias("row_count_student"),
        zero(F.greatest(F.col("net"), F.lit(0))).alias("answer_minus_student_count"),
        zero(F.greatest(-F.col("net"), F.lit(0))).alias("student_minus_answer_count"),
    )
    return out.withColumn("value_mismatch_count", F.least("answer_minus_student_count", "student_minus_answer_count"))


def multiset_status(metrics: DataFrame) -> Column:
    """VIEW_PASS, VIEW_ROW_COUNT_MISMATCH or VIEW_VALUE_MISMATCH."""
    m = {c: metrics[c] for c in EMPTY}
    differ = (m["answer_minus_student_count"] > 0) | (m["student_minus_answer_count"] > 0)
    counts_only = (m["row_count_answer"] != m["row_count_student"]) & (m["value_mismatch_count"] == 0)
    return F.when(~differ, "VIEW_PASS").when(counts_only, "VIEW_ROW_COUNT_MISMATCH").otherwise("VIEW_VALUE_MISMATCH")


def with_position(df: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Adds each row's position, from 0, in the order `df` delivers its rows. The rows are written once, so the order is read once."""
    kept = keep(df.withColumn("_id", F.monotonically_increasing_id()), "positions")
    part, at = F.shiftright("_id", 33), F.col("_id").bitwiseAND(F.lit((1 << 33) - 1))
    # one row per partition of df
    before = kept.groupBy(part.alias("_part")).count().withColumn("_before", F.sum("count").over(Window.orderBy("_part")) - F.col("count"))
    joined = kept.withColumn("_part", part).join(F.broadcast(before), "_part")
    return joined.select((F.col("_before") + at).alias(ordinal), *df.columns)


def ordered_differences(answer: DataFrame, student: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Rows of equal ordinal whose columns differ, with the names of these columns. The ordinal must be unique on each side."""
    columns = [c for c in answer.columns if c != ordinal]
    a = answer.select(ordinal, F.struct(*columns).alias("answer"))
    s = student.select(ordinal, F.struct(*columns).alias("student"))
    differ = F.filter(F.array(*[F.when(~F.col(f"answer.{c}").eqNullSafe(F.col(f"student.{c}")), F.lit(c)) for c in columns]), lambda x: x.isNotNull())
    return a.join(s, ordinal).withColumn("columns", differ).where(F.size("columns") > 0)


def ordered_metrics(answer: DataFrame, student: DataFrame, ordinal: str = "ordinal") -> DataFrame:
    """Row by row comparison; sides of different length have no value mismatches, only their difference in length."""
    n = answer.agg(F.count(F.lit(1)).alias("row_count_answer")).crossJoin(student.agg(F.count(F.lit(1)).alias("row_count_student")))
    wrong = ordered_differences(answer, student, ordinal).agg(F.count(F.lit(1)).alias("wrong"))
    gap = F.col("row_count_answer") - F.col("row_count_student")
    return n.crossJoin(wrong).select(
        "row_count_answer",
        "row_count_student",
        F.greatest(gap, F.lit(0)).alias("answer_minus_student_count"),
        F.greatest(-gap, F.lit(0)).alias("student_minus_answer_count"),
        F.when(gap == 0, F.col("wrong")).otherwise(0).alias("value_mismatch_count"),
    )


def ordered_status(metrics: DataFrame) -> Column:
    return F.when(metrics["row_count_answer"] != metrics["row_count_student"], "VIEW_ROW_COUNT_MISMATCH").when(metrics["value_mismatch_count"] > 0, "VIEW_ORDER_MISMATCH").otherwise("VIEW_PASS")


def compare_view(answer: DataFrame, student: DataFrame, view: ViewRules, accepted: Mapping[str, str] | None = None, ordinal: str | None = None) -> DataFrame:
    """One row of metrics, column lists and status for one pair of outputs. Missing or extra columns end it before any value is read.

    An ordered view needs `ordinal`, a column of both outputs with each row's position.
    """
    spark = answer.sparkSession
    expected = [c for c, *_ in view.columns]
    try:
        names = resolve_columns([c for c in student.columns if c != ordinal], view, accepted)
    except AmbiguousColumns as e:
        return spark.createDataFrame([(*EMPTY.values(), "", "", "", "VIEW_OUTPUT_SCHEMA_MISMATCH", str(e))], ", ".join(f"{c} bigint" for c in EMPTY) + ", matched_columns string, missing_columns string, extra_columns string, status string, reason string")
    lists = {"matched_columns": [c for c in expected if c in names.values()], "missing_columns": [c for c in expected if c not in names.values()], "extra_columns": [c for c in student.columns if c not in names and c != ordinal]}
    if lists["missing_columns"] or lists["extra_columns"]:
        metrics = spark.range(1).select(*[F.lit(v).cast("bigint").alias(c) for c, v in EMPTY.items()])
        status = F.lit("VIEW_OUTPUT_SCHEMA_MISMATCH")
    elif view.ordered:
        if ordinal is None:
            raise ValueError("an ordered comparison needs an ordinal column")
        keyed = [_with_ordinal(df, ordinal, view, accepted if i else None) for i, df in enumerate((answer, student))]
        metrics = ordered_metrics(*keyed)
        status = ordered_status(metrics)
    else:
        metrics = multiset_metrics(canonicalize(answer, view), canonicalize(student, view, accepted))
        status = multiset_status(metrics)
    out = metrics.withColumn("status", status)
    return out.select(*EMPTY, *[F.lit(";".join(v)).alias(k) for k, v in lists.items()], "status", F.lit("").alias("reason"))


def _with_ordinal(df: DataFrame, ordinal: str, view: ViewRules, accepted: Mapping[str, str] | None) -> DataFrame:
    """The canonical columns beside the ordinal, in one projection; an ordered comparison rounds half up."""
    names = resolve_columns([c for c in df.columns if c != ordinal], view, accepted)
    by_name = {v: k for k, v in names.items()}
    cols = [canonical.by_type(df[f"`{by_name[c]}`"], t, view.tolerance, half_up=True).alias(c) for c, t, _ in view.columns if c in by_name]
    return df.select(df[f"`{ordinal}`"].alias("ordinal"), *cols)
