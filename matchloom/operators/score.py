"""Points from statuses: proportional and weighted scores, overrides, counters, priorities and review lists."""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from matchloom.functions import text


def status_histogram(rows: DataFrame, by: list[str], status: str = "status") -> DataFrame:
    return rows.groupBy(*by, status).agg(F.count(F.lit(1)).alias("n"))


def conditional_counters(rows: DataFrame, by: list[str], counters: Mapping[str, Column]) -> DataFrame:
    """One counter per condition."""
    return rows.groupBy(*by).agg(*[F.count(F.when(cond, 1)).alias(name) for name, cond in counters.items()])


def first_failure(rows: DataFrame, by: list[str], ordinal: str, passed: Column, status: str = "status") -> DataFrame:
    """ERROR if any status holds it, else the first that has not passed, else OK."""
    failed = F.min_by(F.when(~passed, F.col(status)), F.when(~passed, F.col(ordinal)))
    error = F.bool_or(F.col(status).contains("ERROR"))
    return rows.groupBy(*by).agg(F.when(error, "ERROR").otherwise(F.coalesce(failed, F.lit("OK"))).alias("test_status"))


def priority_status(rows: DataFrame, by: list[str], order: list[tuple[str, Column]], otherwise: str = "PASS") -> DataFrame:
    """The first status of `order` whose condition any row of the group meets."""
    rank = reduce(lambda rest, k: F.when(order[k][1], k).otherwise(rest), reversed(range(len(order))), F.lit(len(order)))
    names = F.array(*[F.lit(name) for name, _ in order], F.lit(otherwise))
    return rows.groupBy(*by).agg(F.min(rank).alias("_r")).select(*by, F.get(names, F.col("_r")).alias("suggested_status"))


def proportional_points(rubric: DataFrame, items: DataFrame, statuses: DataFrame) -> DataFrame:
    """Points of each rubric row: its share of required items whose status it includes.

    rubric: section, component, total_points, include_statuses ('|' between). items: component, object_name.
    statuses: submission_id, component, object_name, status. An item without a status is MISSING.
    """
    n = items.groupBy("component").agg(F.count(F.lit(1)).alias("n"))
    every = statuses.select("submission_id").distinct().crossJoin(F.broadcast(rubric.join(items, "component").join(n, "component")))
    status = F.coalesce(F.col("status"), F.lit("MISSING"))
    passed = F.array_contains(F.split("include_statuses", r"\|"), status)
    joined = every.join(statuses, ["submission_id", "component", "object_name"], "left")
    return joined.groupBy("submission_id", "section", "component").agg(
        F.first("total_points").alias("points_possible"), F.sum(F.when(passed, F.col("total_points") / F.col("n")).otherwise(0.0)).alias("points"), F.count(F.when(passed, 1)).alias("passed")
    )


def weighted_points(total: Column, checks: Mapping[str, Column], weights: Mapping[str, float]) -> Column:
    """Points of independent checks: the total times the weights of those met."""
    return total * reduce(lambda a, b: a + b, (F.when(F.coalesce(cond, F.lit(False)), weights[name]).otherwise(0.0) for name, cond in checks.items()))


def apply_overrides(points: DataFrame, overrides: DataFrame, keys: list[str]) -> DataFrame:
    """Final points: the first override of a row in file order replaces them; an override's status replaces the status if given."""
    first = overrides.groupBy(*keys).agg(F.min_by(F.struct("override_points", "override_status", "reviewer_note"), "ordinal").alias("o"))
    out = points.join(first, keys, "left")
    status = {"status": F.coalesce(F.when(F.col("o.override_status") != "", F.col("o.override_status")), F.col("status"))} if "status" in points.columns else {}
    return out.withColumns({"final_points": F.coalesce("o.override_points", "points"), "override_applied": F.col("o").isNotNull(), "reviewer_note": F.coalesce("o.reviewer_note", F.lit("")), **status}).drop("o")


def totals(points: DataFrame) -> DataFrame:
    return points.groupBy("submission_id").agg(F.sum("points").alias("auto_score"), F.sum("final_points").alias("final_score"), F.count(F.when(F.col("override_applied"), 1)).alias("overrides"))


def issues(rows: DataFrame, clean: list[str], status: str = "match_status") -> DataFrame:
    """Rows that need a look: flagged, or with a status that is not clean."""
    return rows.where(F.coalesce("review_required", F.lit(False)) | ~F.col(status).isin(*clean))


def unmapped_summary(rows: DataFrame, by: list[str], identifier: str, example: str, ordinal: str) -> DataFrame:
    """How often each identifier is unmapped, with the first example."""
    return rows.groupBy(*by, identifier).agg(F.count(F.lit(1)).alias("n"), F.min_by(example, ordinal).alias("first_example")).orderBy(*by, identifier)


def unmapped_identifiers(rows: DataFrame, lists: str) -> DataFrame:
    """One row per identifier of a ';' list."""
    return rows.withColumn("identifier", F.explode(text.split_identifiers(lists)))


def scope_match(scope: Column, name: Column) -> Column:
    """Whether a rubric's scope means an object: equal, equal as keys, or the whole word inside the name."""
    word = F.concat(F.lit(r"(?i)(^|[^A-Za-z0-9])\Q"), scope, F.lit(r"\E([^A-Za-z0-9]|$)"))
    return (scope == name) | (text.view_key(scope) == text.view_key(name)) | F.rlike(name, word)
