"""Structure of candidates against a reference: tables, columns, views. One plan for all submissions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.config import Rules
from matchloom.functions import text
from matchloom.operators import names, types
from matchloom.session import keep

ACCEPTED_TABLES = ("TABLE_MATCHED_EXACT", "TABLE_MATCHED_ALIAS", "TABLE_MATCHED_ABBREVIATION", "TABLE_MATCHED_FUZZY_HIGH", "TABLE_MATCHED_WEAK_ALIAS")
ACCEPTED_COLUMNS = ("COLUMN_MATCHED_EXACT", "COLUMN_MATCHED_ALIAS", "COLUMN_MATCHED_ABBREVIATION", "COLUMN_MATCHED_FUZZY_HIGH", "COLUMN_MATCHED_WEAK_ALIAS")


def active(rows: DataFrame, rules: Rules, column: str = "table_name") -> DataFrame:
    """Rows whose table is not excluded."""
    keys = [k.lower() for k in rules.names.excluded_tables]
    return rows.where(~F.lower(text.remove_accents(column)).isin(*keys)) if keys else rows


def required_tables(answer_tables: DataFrame) -> DataFrame:
    """(answer_table, raw_answer_table, row_count): one row per canonical name, the first by object_id and name.

    With a column submission_id the reference of each submission is its own.
    """
    own = [c for c in ("submission_id",) if c in answer_tables.columns]
    named = answer_tables.withColumn("answer_table", F.coalesce(F.when(F.col("table_name_canonical") != "", F.col("table_name_canonical")), F.col("table_name")))
    first = F.struct(F.coalesce("object_id", F.lit(0)), "table_name")
    return named.groupBy(*own, "answer_table").agg(F.min_by("table_name", first).alias("raw_answer_table"), F.min_by("row_count", first).alias("row_count"))


def all_covered(required: DataFrame, mapped: DataFrame, by: list[str], key: str, groups: DataFrame) -> DataFrame:
    """Relational division: the `groups` for which every required key is mapped."""
    on = [c for c in by if c in required.columns]
    wanted = groups.join(required, on) if on else groups.crossJoin(F.broadcast(required))
    missing = wanted.join(mapped, [*by, key], "left_anti")
    return groups.join(missing.select(*by).distinct(), by, "left_anti")


def table_mapping(answer_tables: DataFrame, student_tables: DataFrame, rules: Rules) -> DataFrame:
    """The table mapping of every submission: matches, competing ones made ambiguous, extra and missing tables."""
    required = required_tables(active(answer_tables, rules)).drop("row_count")
    own = [c for c in ("submission_id",) if c in required.columns]
    students = active(student_tables, rules).select("submission_id", "table_name").distinct()
    mapped = keep(names.map_tables(students, rules.names), "tables")  # several branches read it below
    rivals = F.count(F.when(F.col("match_status").isin(*ACCEPTED_TABLES), 1)).over(Window.partitionBy("submission_id", "answer_table"))
    compete = F.col("match_status").isin(*ACCEPTED_TABLES) & (F.col("rivals") > 1)
    mapped = mapped.withColumn("rivals", rivals)
    mapped = mapped.select(
        "submission_id",
        F.when(~compete, F.col("answer_table")).alias("answer_table"),
        F.col("table_name").alias("student_table"),
        F.when(compete, "TABLE_AMBIGUOUS").otherwise(F.col("match_status")).alias("match_status"),
        F.when(compete, "multiple_matches").otherwise(F.col("match_method")).alias("match_method"),
        "match_score",
        F.when(compete, F.concat(F.lit("# Competing match for "), "answer_table")).alias("suggested_alias_entry"),
        (F.col("review_required") | compete).alias("review_required"),
        "candidate_tables",
        F.col("compact").alias("normalized_key"),
    )
    groups = students.select("submission_id").distinct()
    taken = mapped.where("answer_table IS NOT NULL").select("submission_id", "answer_table").distinct()
    full = all_covered(required.select(*own, "answer_table"), taken, ["submission_id"], "answer_table", groups).withColumn("full", F.lit(True))
    extra = (F.col("match_status") == "TABLE_UNMAPPED") & F.coalesce("full", F.lit(False))
    mapped = (
        mapped.join(full, "submission_id", "left")
        .withColumn("match_status", F.when(extra, "TABLE_EXTRA_STUDENT").otherwise(F.col("match_status")))
        .withColumn("review_required", F.col("review_required") & ~(F.col("match_status") == "TABLE_EXTRA_STUDENT"))
        .drop("full")
        .join(required, [*own, "answer_table"], "left")
    )
    missing = (groups.join(required, own) if own else groups.crossJoin(F.broadcast(required))).join(taken, ["submission_id", "answer_table"], "left_anti").select(
        "submission_id", "answer_table", "raw_answer_table", F.lit("TABLE_MISSING_ANSWER").alias("match_status"), F.lit(0.0).alias("match_score"),
        F.lit(True).alias("review_required"), text.normalize_key("answer_table").alias("normalized_key"),
    )
    return mapped.unionByName(missing, allowMissingColumns=True)


def column_mapping(table_map: DataFrame, answer_columns: DataFrame, student_columns: DataFrame, rules: Rules, answer_keys: DataFrame | None = None) -> DataFrame:
    """The column mapping of every matched table: matches, demoted duplicates, types, extra and missing columns.

    answer_keys: (answer_table, column_name) of columns that take part in a primary or foreign key.
    """
    pairs = table_map.where(F.col("match_status").isin(*ACCEPTED_TABLES)).select("submission_id", "answer_table", "student_table", (F.col("match_status") == "TABLE_MATCHED_WEAK_ALIAS").alias("weak"))
    expected = active(answer_columns, rules).select(F.coalesce("table_name_canonical", "table_name").alias("answer_table"), "column_name", F.col("data_type").alias("answer_type"), F.col("scale").alias("answer_scale")).dropDuplicates(["answer_table", "column_name"])
    own = student_columns.select("submission_id", F.col("table_name").alias("student_table"), "column_name", F.col("data_type").alias("student_type"), F.col("scale").alias("student_scale"))
    pairs = keep(pairs, "pairs")
    mapped = keep(names.map_columns(own.join(pairs, ["submission_id", "student_table"]), expected, rules.names), "columns")
    mapped = mapped.join(pairs, ["submission_id", "answer_table", "student_table"]).join(own, ["submission_id", "student_table", "column_name"])
    matched = F.col("match_status").isin(*ACCEPTED_COLUMNS)
    weak = matched & F.col("weak")
    mapped = mapped.withColumn("is_weak_alias", weak).withColumn("match_status", F.when(weak, "COLUMN_MATCHED_WEAK_ALIAS").otherwise(F.col("match_status")))

    ranks = {m: r for m, (_, r) in names.COLUMN_METHODS.items()}
    rank = reduce(lambda rest, m: F.when(F.col("match_method") == m, ranks[m]).otherwise(rest), ranks, F.lit(0))
    rivals = Window.partitionBy("submission_id", "answer_table", "answer_column", matched)
    order = rivals.orderBy(rank.desc(), F.col("match_score").desc(), "column_name")
    mapped = mapped.withColumns({"n": F.count(F.lit(1)).over(rivals), "place": F.row_number().over(order)})
    duplicate, kept = matched & (F.col("n") > 1) & (F.col("place") > 1), matched & (F.col("n") > 1) & (F.col("place") == 1)
    mapped = mapped.withColumn("duplicate_resolution", F.when(duplicate, "demoted_duplicate").when(kept, "accepted")).withColumn(
        "match_status", F.when(duplicate, "DUPLICATE_MAPPING_REVIEW").otherwise(F.col("match_status"))
    )

    in_key = F.lit(False)
    mapped = mapped.join(expected.withColumnRenamed("column_name", "answer_column"), ["answer_table", "answer_column"], "left")
    if answer_keys is not None:
        keys = answer_keys.select("answer_table", F.col("column_name").alias("answer_column")).distinct().withColumn("in_key", F.lit(True))
        mapped = mapped.join(F.broadcast(keys), ["answer_table", "answer_column"], "left")
        in_key = F.col("in_key")
    still = F.col("match_status").isin(*ACCEPTED_COLUMNS)
    compared = types.compare_types("answer_type", "student_type", "answer_column", in_key, rules.types, F.col("answer_scale"), F.col("student_scale"))
    mapped = mapped.withColumn("t", F.when(still, compared))
    wrong = F.coalesce(F.col("t.type_status") == "TYPE_MISMATCH", F.lit(False))
    mapped = mapped.withColumn("match_status", F.when(wrong, "COLUMN_TYPE_MISMATCH").otherwise(F.col("match_status")))

    by = ["submission_id", "answer_table"]
    counts_as_mapped = F.col("match_status").isin(*ACCEPTED_COLUMNS, "DUPLICATE_MAPPING_REVIEW")
    taken = mapped.where(counts_as_mapped & F.col("answer_column").isNotNull()).select(*by, "answer_column").distinct()
    wanted = expected.select("answer_table", F.col("column_name").alias("answer_column"))
    full = all_covered(wanted, taken, by, "answer_column", pairs.select(*by).distinct()).withColumn("full", F.lit(True))
    extra = (F.col("match_status") == "COLUMN_UNMAPPED") & F.coalesce("full", F.lit(False))
    out = mapped.join(full, by, "left").withColumn("match_status", F.when(extra, "COLUMN_EXTRA_STUDENT").otherwise(F.col("match_status"))).select(
        *by, "student_table", "answer_column", F.col("column_name").alias("student_column"), "match_status", "match_method", "match_score", "is_weak_alias", "duplicate_resolution",
        "answer_type", "student_type", F.col("t.answer_group").alias("answer_type_group"), F.col("t.student_group").alias("student_type_group"), F.col("t.type_status").alias("type_status"), F.col("t.type_score").alias("type_score"),
        (~F.col("match_status").startswith("COLUMN_MATCHED") & (F.col("match_status") != "COLUMN_EXTRA_STUDENT") | weak).alias("review_required"),
        F.col("compact").alias("normalized_key"),
    )
    missing = pairs.select(*by, "student_table").join(wanted.join(expected.select("answer_table", F.col("column_name").alias("answer_column"), "answer_type"), ["answer_table", "answer_column"]), "answer_table").join(taken, [*by, "answer_column"], "left_anti")
    missing = missing.select(*by, "student_table", "answer_column", "answer_type", F.lit("COLUMN_MISSING_ANSWER").alias("match_status"), F.lit(0.0).alias("match_score"), F.lit(True).alias("review_required"), text.normalize_key("answer_column").alias("normalized_key"))
    return out.unionByName(missing, allowMissingColumns=True)


def row_counts(table_map: DataFrame, answer_tables: DataFrame, student_tables: DataFrame) -> DataFrame:
    """Row counts of matched tables that differ."""
    answer = required_tables(answer_tables).select("answer_table", F.col("row_count").alias("answer_rows"))
    student = student_tables.select("submission_id", F.col("table_name").alias("student_table"), F.col("row_count").alias("student_rows"))
    matched = table_map.where(F.col("match_status").isin(*ACCEPTED_TABLES)).select("submission_id", "answer_table", "student_table")
    both = matched.join(F.broadcast(answer), "answer_table").join(student, ["submission_id", "student_table"])
    return both.where("NOT answer_rows <=> student_rows").withColumn("difference", F.col("student_rows") - F.col("answer_rows"))


def view_structure(answer_views: DataFrame, student_views: DataFrame, answer_view_columns: DataFrame, student_view_columns: DataFrame) -> DataFrame:
    """Views by canonical name: missing, failing, with another set of columns, equal, extra."""
    cols = lambda df, by: df.groupBy(*by, "view_name_canonical").agg(F.array_sort(F.collect_set("column_name_canonical")).alias("columns"))
    answer = answer_views.select("view_name_canonical", F.col("view_name").alias("answer_view")).join(cols(answer_view_columns, []), "view_name_canonical", "left").withColumnRenamed("columns", "wanted")
    student = student_views.select("submission_id", "view_name_canonical", F.col("view_name").alias("student_view"), "execution_status").join(cols(student_view_columns, ["submission_id"]), ["submission_id", "view_name_canonical"], "left")
    every = student.select("submission_id").distinct().crossJoin(F.broadcast(answer))
    both = every.join(student, ["submission_id", "view_name_canonical"], "full")
    none = F.array().cast("array<string>")
    lacking = F.array_except(F.coalesce("wanted", none), F.coalesce("columns", none))
    surplus = F.array_except(F.coalesce("columns", none), F.coalesce("wanted", none))
    status = (
        F.when(F.col("answer_view").isNull(), "EXTRA")
        .when(F.col("student_view").isNull(), "MISSING")
        .when(F.col("execution_status") != "OK", "EXECUTION_ERROR")
        .when((F.size(lacking) > 0) | (F.size(surplus) > 0), "SCHEMA_MISMATCH")
        .otherwise("PASS")
    )
    known = F.col("answer_view").isNotNull() & F.col("student_view").isNotNull()
    return both.select("submission_id", "view_name_canonical", "answer_view", "student_view", status.alias("status"), F.when(known, F.concat_ws(";", lacking)).alias("missing_columns"), F.when(known, F.concat_ws(";", surplus)).alias("extra_columns"))


# Severity of each status of a mapping.
SEVERITY = {"MATCHED": "info", "EXTRA": "low", "MISSING": "high", "UNMAPPED": "medium", "AMBIGUOUS": "medium", "MISMATCH": "high", "DUPLICATE": "medium", "INCOMPATIBLE": "medium"}


def severity(status: Column) -> Column:
    return reduce(lambda rest, mark: F.when(status.contains(mark), SEVERITY[mark]).otherwise(rest), reversed(SEVERITY), F.lit("info"))


def structure_report(table_map: DataFrame, column_map: DataFrame) -> DataFrame:
    """One row per mapped, missing or extra object with a label and a severity."""
    label = lambda t, c: F.concat_ws(".", F.when(F.coalesce(t, F.lit("")) != "", t), F.when(F.coalesce(c, F.lit("")) != "", c))
    tables = table_map.select("submission_id", F.lit("TABLE").alias("component"), F.col("answer_table").alias("answer_object"), F.col("student_table").alias("student_object"), F.col("match_status").alias("status"), "review_required")
    columns = column_map.select("submission_id", F.lit("COLUMN").alias("component"), label(F.col("answer_table"), F.col("answer_column")).alias("answer_object"), label(F.col("student_table"), F.col("student_column")).alias("student_object"), F.col("match_status").alias("status"), "review_required")
    return tables.unionByName(columns).withColumn("severity", severity(F.col("status")))
