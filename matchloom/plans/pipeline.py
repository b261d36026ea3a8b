"""The whole comparison: snapshots to mappings, keys, reports and a summary; candidate views to an assignment.

All submissions run in one plan. Candidate SQL is the exception: each candidate is a query of its own, so
candidates are planned one after the other on the driver and computed together.
"""

from __future__ import annotations

from collections.abc import Mapping
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.config import Rules, ViewRules
from matchloom.operators import assign, compare, keys, score, structure
from matchloom.plans import sqlviews
from matchloom.session import keep


def _own_tables(rows: DataFrame, accepted: DataFrame, column: str = "table_name_canonical") -> DataFrame:
    """Adds answer_table and student_table to rows that name a candidate's table by its own or its canonical name."""
    named = accepted.select("submission_id", "answer_table", "student_table", F.explode(F.array_distinct(F.array("student_table", "answer_table"))).alias(column))
    return rows.join(named, ["submission_id", column])


def _own_columns(rows: DataFrame, column_map: DataFrame, column: str) -> DataFrame:
    """Adds the reference's name of a candidate's column as <column>_ref; its own name where it is not mapped."""
    names = column_map.where(F.col("match_status").isin(*structure.ACCEPTED_COLUMNS)).select("submission_id", "student_table", F.col("student_column").alias(column), F.col("answer_column").alias(f"{column}_ref"))
    joined = rows.join(names, ["submission_id", "student_table", column], "left")
    return joined.withColumn(f"{column}_ref", F.coalesce(f"{column}_ref", column))


def compare_structure(answer: Mapping[str, DataFrame], students: Mapping[str, DataFrame], rules: Rules) -> dict[str, DataFrame]:
    """Reports of all submissions: table_mapping, column_mapping, structure, primary_keys, relationships, views, row_counts."""
    key_columns = answer["primary_keys"].select(F.col("table_name_canonical").alias("answer_table"), F.col("column_name_canonical").alias("column_name"))
    linked = answer["foreign_keys"]
    for side in ("parent", "referenced"):
        key_columns = key_columns.unionByName(linked.select(F.col(f"{side}_table_canonical").alias("answer_table"), F.col(f"{side}_column_canonical").alias("column_name")))
    table_map = keep(structure.table_mapping(answer["tables"].drop("submission_id"), students["tables"], rules), "table-map")
    column_map = keep(structure.column_mapping(table_map, answer["columns"], students["columns"], rules, key_columns), "column-map")
    accepted = table_map.where(F.col("match_status").isin(*structure.ACCEPTED_TABLES)).select("submission_id", "answer_table", "student_table")

    own_keys = _own_columns(_own_tables(students["primary_keys"], accepted).withColumnRenamed("column_name_canonical", "column_name"), column_map, "column_name")
    own_keys = own_keys.select("submission_id", F.col("student_table").alias("table_name"), F.col("answer_table").alias("table_name_canonical"), F.col("column_name_ref").alias("column_name_canonical"), "column_name", "key_ordinal")
    out = {"table_mapping": table_map, "column_mapping": column_map, "structure": structure.structure_report(table_map, column_map), "row_counts": structure.row_counts(table_map, answer["tables"], students["tables"])}
    out["views"] = structure.view_structure(answer["views"], students["views"], answer["view_columns"], students["view_columns"])
    if rules.keys.mode == "exact":
        out["primary_keys"] = keys.primary_keys_exact(answer["primary_keys"], own_keys, accepted)
        out["relationships"] = keys.foreign_keys_exact(answer["foreign_keys"], students["foreign_keys"], accepted)
        return out

    raw = answer["columns"].select(F.coalesce("table_name_canonical", "table_name").alias("t"), F.coalesce("column_name_canonical", "column_name").alias("c"), "column_name", F.coalesce("is_identity", F.lit(0)).alias("identity"))
    answer_keys = answer["primary_keys"].join(F.broadcast(raw), (F.col("table_name_canonical") == F.col("t")) & (F.col("column_name_canonical") == F.col("c")), "left")
    answer_keys = answer_keys.select("table_name_canonical", "column_name_canonical", F.coalesce("column_name", "column_name_canonical").alias("column_name"), "key_ordinal")
    unique = _own_columns(_own_tables(students["unique_constraints"], accepted).withColumnRenamed("column_name_canonical", "column_name"), column_map, "column_name")
    unique = unique.select("submission_id", F.col("student_table").alias("table_name"), "constraint_name", F.col("column_name_ref").alias("column_name_canonical"))

    lists = lambda df, by, child, parent: df.groupBy(*by, "fk_name").agg(
        F.min("child").alias("child_table"), F.min("parent").alias("parent_table"),
        *[F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce("constraint_column_id", F.lit(0)).alias("o"), F.col(c).alias("c")))), lambda x: x["c"])).alias(n) for c, n in ((child, "child_columns"), (parent, "parent_columns"), ("parent_column", "raw_child_columns"), ("referenced_column", "raw_parent_columns"))],
        F.max("identity").alias("parent_identity"),
    )
    expected = lists(answer["foreign_keys"].withColumns({"child": F.col("parent_table_canonical"), "parent": F.col("referenced_table_canonical"), "identity": F.lit(0)}), [], "parent_column_canonical", "referenced_column_canonical")
    theirs = students["foreign_keys"].drop("parent_table_canonical", "parent_column_canonical", "referenced_table_canonical", "referenced_column_canonical")
    for side, column in (("parent", "child"), ("referenced", "parent")):
        theirs = theirs.join(accepted.select("submission_id", F.col("student_table").alias(f"{side}_table"), F.col("answer_table").alias(column)), ["submission_id", f"{side}_table"], "left").withColumn(column, F.coalesce(column, f"{side}_table"))
        theirs = _own_columns(theirs.withColumn("student_table", F.col(f"{side}_table")), column_map, f"{side}_column").drop("student_table")
    identity = students["columns"].where("is_identity = 1").select("submission_id", F.col("table_name").alias("referenced_table"), F.col("column_name").alias("referenced_column"), F.lit(1).alias("identity"))
    theirs = theirs.join(identity, ["submission_id", "referenced_table", "referenced_column"], "left").withColumn("identity", F.coalesce("identity", F.lit(0)))
    out["relationships"] = keep(keys.relationships(expected, lists(theirs, ["submission_id"], "parent_column_ref", "referenced_column_ref"), accepted, students["columns"], rules.keys), "relationships")
    out["primary_keys"] = keys.primary_keys_adequate(answer_keys, own_keys, table_map, column_map, students["columns"], unique, out["relationships"], rules.keys)
    return out


def summary(reports: Mapping[str, DataFrame]) -> DataFrame:
    """One row per submission: counters of its reports and a suggested status."""
    status = lambda df, column: df.select("submission_id", F.col(column).alias("status"))
    rows = reduce(DataFrame.unionByName, [
        status(reports["table_mapping"], "match_status"), status(reports["column_mapping"], "match_status"), status(reports["primary_keys"], "key_status" if "key_status" in reports["primary_keys"].columns else "status"),
        status(reports["relationships"], "fk_status" if "fk_status" in reports["relationships"].columns else "status"), reports["row_counts"].select("submission_id", F.lit("ROW_COUNT_MISMATCH").alias("status")),
    ])
    s = F.col("status")
    counters = {
        "tables_matched": s.isin(*structure.ACCEPTED_TABLES), "tables_missing": s == "TABLE_MISSING_ANSWER", "columns_matched": s.isin(*structure.ACCEPTED_COLUMNS), "columns_missing": s == "COLUMN_MISSING_ANSWER",
        "type_mismatches": s == "COLUMN_TYPE_MISMATCH", "keys_missing": s == "PK_MISSING", "relationships_met": s.isin(*keys.MET), "review": s.contains("REVIEW") | s.contains("AMBIGUOUS") | s.contains("UNMAPPED"),
    }
    order = [("FAIL_STRUCTURE", s.contains("MISSING") | s.contains("WRONG")), ("FAIL_DATA", s == "ROW_COUNT_MISMATCH"), ("NEEDS_REVIEW", counters["review"]), ("PASS_WITH_WARNINGS", s.contains("MISMATCH") | s.contains("EXTRA") | s.contains("WEAK"))]
    return score.conditional_counters(rows, ["submission_id"], counters).join(score.priority_status(rows, ["submission_id"], order), "submission_id")


_SCORES = "submission_id string, expected_view string, student_view string, candidate_status string, matched_columns int, expected_columns int, row_count_answer bigint, row_count_student bigint, value_mismatch_count bigint, order_mismatch_count bigint, hint_score int, ordinal int, ordered boolean"


#: Column with a row's position, beside the expected ones.
_POSITION = "_position"


def _in_order(df: DataFrame) -> bool:
    """Whether the query ends in an ORDER BY of the whole output; without one, its rows have no order."""
    node = df._jdf.queryExecution().analyzed()
    while node.nodeName() in ("Project", "SubqueryAlias", "GlobalLimit", "LocalLimit", "Offset"):
        node = node.children().head()
    return node.nodeName() == "Sort" and bool(getattr(node, "global")())


def _view_metrics(answer: DataFrame, own: DataFrame, view: ViewRules, in_order: bool) -> DataFrame:
    """Row counts, value_mismatch_count, order_mismatch_count and status of two outputs in canonical values; both with _POSITION if `in_order`.

    Row by row where the view is ordered. A candidate of several rows without an order has all of them out of order.
    """
    if view.ordered and in_order:
        m = compare.ordered_metrics(answer, own, _POSITION)
        return m.withColumns({"order_mismatch_count": F.col("value_mismatch_count"), "candidate_status": compare.ordered_status(m)})
    m = compare.multiset_metrics(answer, own)
    if not view.ordered:
        return m.withColumns({"order_mismatch_count": F.lit(0).cast("bigint"), "candidate_status": compare.multiset_status(m)})
    m = m.withColumn("order_mismatch_count", F.when(F.col("row_count_student") > 1, F.col("row_count_student")).otherwise(0))
    status = F.when(m["row_count_answer"] != m["row_count_student"], "VIEW_ROW_COUNT_MISMATCH").when(m["order_mismatch_count"] > 0, "VIEW_ORDER_MISMATCH")
    return m.withColumn("candidate_status", status.otherwise(compare.multiset_status(m)))


def score_candidates(
    spark: SparkSession, definitions: list[tuple[str, str, str]], views: list[ViewRules], answers: Mapping[str, DataFrame], tables: Mapping[str, DataFrame], table_maps: Mapping[str, Mapping[str, str]], column_maps: Mapping[str, Mapping[tuple[str, str], str]], ordinal: str = "ordinal"
) -> DataFrame:
    """Scores of every candidate view of every submission against every expected view.

    definitions: (submission_id, view name, DDL). answers: reference outputs by view name. table_maps and column_maps: by
    submission. A candidate that cannot run, or whose columns are ambiguous, gets its status and a score of zero; the others'
    counts are computed in one job each. Surplus columns are dropped and missing ones null for the comparison; then only the
    status says VIEW_OUTPUT_SCHEMA_MISMATCH.
    Outputs of ordered views are compared row by row: the reference's by its column `ordinal`, or as it is delivered
    if it has none, a candidate's by its ORDER BY; rows with equal sort keys stand as they are delivered.
    """
    by_ordinal = lambda df, v: df.orderBy(ordinal) if ordinal in df.columns and ordinal not in [c for c, *_ in v.columns] else df
    ranked = {v.name: compare.with_position(compare.canonicalize(by_ordinal(answers[v.name], v), v), _POSITION) for v in views if v.ordered}
    done, failed = [], []
    others: dict[str, tuple[str, ...]] = {}
    for sub, name, _ in definitions:
        others[sub] = (*others.get(sub, ()), name)
    for k, (sub, name, ddl) in enumerate(definitions):
        run = sqlviews.run_view(spark, ddl, tables, table_maps.get(sub, {}), column_maps.get(sub, {}), others[sub])
        for v, view in enumerate(views):
            place, n = k * len(views) + v, len(view.columns)
            hint = int(compare.plain_key(name) == compare.plain_key(view.name))
            base = (sub, view.name, name)
            if run.data is None:
                failed.append((*base, f"VIEW_SQL_{run.status}", 0, n, 0, 0, 0, 0, hint, place, view.ordered))
                continue
            try:
                known = compare.resolve_columns(run.data.columns, view)
            except compare.AmbiguousColumns:
                known = None
            if known is None or any(run.data.columns.count(c) > 1 for c in known):  # which column is meant is not known
                failed.append((*base, "VIEW_OUTPUT_SCHEMA_MISMATCH", 0, n, 0, 0, 0, 0, hint, place, view.ordered))
                continue
            other_columns = len(known) < n or len(run.data.columns) > n
            own = DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, run.data._jdf.queryExecution().analyzed()), spark)
            in_order = view.ordered and _in_order(run.data)
            answer, own = compare.canonicalize(answers[view.name], view), compare.canonicalize(own, view)
            m = _view_metrics(ranked[view.name] if in_order else answer, compare.with_position(own, _POSITION) if in_order else own, view, in_order)
            done.append(
                m.withColumn("candidate_status", F.lit("VIEW_OUTPUT_SCHEMA_MISMATCH") if other_columns else F.col("candidate_status")).select(
                    *[F.lit(x).alias(c) for c, x in zip(("submission_id", "expected_view", "student_view"), base)], "candidate_status", F.lit(len(known)).alias("matched_columns"), F.lit(n).alias("expected_columns"),
                    "row_count_answer", "row_count_student", "value_mismatch_count", "order_mismatch_count", F.lit(hint).alias("hint_score"), F.lit(place).alias("ordinal"), F.lit(view.ordered).alias("ordered"), F.lit(True).alias("compared"),
                )
            )
    out = reduce(DataFrame.unionByName, done, spark.createDataFrame(failed, _SCORES).withColumn("compared", F.lit(False)))
    scored = out.withColumns(assign.score_columns(F.col("ordered")))
    return scored.withColumn("total_match_score", F.when(F.col("compared"), F.col("total_match_score")).otherwise(0.0)).drop("compared")


def assign_views(scores: DataFrame) -> DataFrame:
    """The assignment of candidates to expected views, with the scores of the pair that was taken."""
    return assign.assign(scores.select("submission_id", "expected_view", "student_view", "total_match_score", "hint_score", "candidate_status", "ordinal"))


def mapped_names(table_map: DataFrame, column_map: DataFrame) -> tuple[dict[str, dict[str, str]], dict[str, dict[tuple[str, str], str]]]:
    """Accepted mappings by submission, for `score_candidates`; a submission's names are few."""
    tables: dict[str, dict[str, str]] = {}
    columns: dict[str, dict[tuple[str, str], str]] = {}
    for r in table_map.where(F.col("match_status").isin(*structure.ACCEPTED_TABLES)).select("submission_id", "student_table", "answer_table").toLocalIterator():
        tables.setdefault(r["submission_id"], {})[r["student_table"]] = r["answer_table"]
    for r in column_map.where(F.col("match_status").isin(*structure.ACCEPTED_COLUMNS)).select("submission_id", "student_table", "student_column", "answer_column").toLocalIterator():
        columns.setdefault(r["submission_id"], {})[r["student_table"], r["student_column"]] = r["answer_column"]
    return tables, columns
