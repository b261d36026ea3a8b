"""Resolution of candidate names to reference names: exact, alias, abbreviation, weak alias, similar.

All aliases form one small table in long form; names meet it by equi-joins on their keys, and only names
that found nothing are compared by similarity with the names of their own scope. Every candidate of a name
keeps its best method; more than one reference name left is ambiguous.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.config import NameRules
from matchloom.functions import text
from matchloom.session import keep

#: Methods of tables and columns with their status and rank (the higher is preferred).
TABLE_METHODS = {"exact": ("TABLE_MATCHED_EXACT", 5), "alias": ("TABLE_MATCHED_ALIAS", 4), "abbreviation": ("TABLE_MATCHED_ABBREVIATION", 3), "weak_alias": ("TABLE_MATCHED_WEAK_ALIAS", 2)}
COLUMN_METHODS = {
    "table_alias": ("COLUMN_MATCHED_ALIAS", 5),
    "natural_key_alias": ("COLUMN_MATCHED_ALIAS", 4),
    "exact": ("COLUMN_MATCHED_EXACT", 3),
    "global_alias": ("COLUMN_MATCHED_ALIAS", 2),
    "abbreviation": ("COLUMN_MATCHED_ABBREVIATION", 1),
}


def _status(methods: dict) -> Column:
    return reduce(lambda rest, m: F.when(F.col("method") == m, methods[m][0]).otherwise(rest), methods, F.lit(None).cast("string"))


def _rank(methods: dict) -> Column:
    return reduce(lambda rest, m: F.when(F.col("method") == m, methods[m][1]).otherwise(rest), methods, F.lit(0))


def table_aliases(spark: SparkSession, rules: NameRules) -> DataFrame:
    """(canonical, method, key, spelled) of all reference tables and their aliases."""
    rows = [(t, "exact", t) for t in rules.tables] + [(t, "alias", a) for t, names in rules.tables.items() for a in names]
    out = spark.createDataFrame(rows, "canonical string, method string, name string")
    weak = out.withColumn("key", text.normalize_key("name"))
    method = F.when((F.col("method") == "alias") & F.col("key").isin(*rules.weak_aliases or ("",)), "weak_alias").otherwise(F.col("method"))
    return weak.select("canonical", method.alias("method"), "key", F.lower("name").alias("spelled"))


def column_aliases(expected: DataFrame, rules: NameRules) -> DataFrame:
    """(answer_table, canonical, method, key, spelled) of the expected columns (answer_table, column_name) and their aliases."""
    spark = expected.sparkSession
    scoped = [(t, c, m, a) for m, source in (("table_alias", rules.columns_by_table), ("natural_key_alias", rules.natural_keys)) for t, cs in source.items() for c, names in cs.items() for a in names]
    everywhere = [(c, "global_alias", a) for c, names in rules.columns_global.items() for a in names]
    own = expected.select("answer_table", F.col("column_name").alias("canonical")).distinct()
    exact = own.select("answer_table", "canonical", F.lit("exact").alias("method"), F.col("canonical").alias("name"))
    by_table = own.join(F.broadcast(spark.createDataFrame(scoped, "answer_table string, canonical string, method string, name string")), ["answer_table", "canonical"])
    overall = own.join(F.broadcast(spark.createDataFrame(everywhere, "canonical string, method string, name string")), "canonical").select("answer_table", "canonical", "method", "name")
    out = exact.unionByName(by_table.select(*exact.columns)).unionByName(overall)
    return out.select("answer_table", "canonical", "method", text.normalize_key("name").alias("key"), F.lower("name").alias("spelled"))


def with_keys(names: DataFrame, name: str, rules: NameRules) -> DataFrame:
    """Adds cleaned, expanded and compact forms of a name."""
    cleaned = text.clean_name(name)
    return names.withColumns({"normalized": cleaned, "expanded": text.expand_abbreviations(cleaned, rules.abbreviations), "compact": text.normalize_key(name)})


def _resolve(names: DataFrame, ids: list[str], aliases: DataFrame, scope: list[str], methods: dict, accept: float, ambiguous: float, prefix: str) -> DataFrame:
    """(ids, canonicals, method, status, score): for each name the reference names of its best way to match."""
    given = names.select(*ids, *[c for c in scope if c not in ids], "normalized", "expanded", "compact").distinct()
    small = F.broadcast(aliases)
    by_key = given.join(small.withColumnRenamed("key", "compact"), [*scope, "compact"]).select(*ids, "canonical", "method", F.lit(100.0).alias("score"))
    spelled_out = given.where((F.col("expanded") != F.col("normalized")) | (F.length("normalized") <= 3))
    by_abbreviation = spelled_out.join(small.select(*scope, F.col("key").alias("expanded"), "canonical"), [*scope, "expanded"]).select(*ids, "canonical", F.lit("abbreviation").alias("method"), F.lit(100.0).alias("score"))
    sure = by_key.unionByName(by_abbreviation).withColumn("rank", _rank(methods))
    if prefix == "TABLE":  # the first way that finds anything decides; columns keep all ways
        best = Window.partitionBy(*ids)
        sure = sure.withColumn("top", F.max("rank").over(best)).where("rank = top").drop("top")
    sure = sure.groupBy(*ids, "canonical").agg(F.max_by(F.struct("method", "score"), "rank").alias("m")).select(*ids, "canonical", "m.method", "m.score").withColumn("status", _status(methods))

    sure = keep(sure, "sure")
    rest = given.where(F.length("normalized") > 3).join(sure.select(*ids).distinct(), ids, "left_anti")
    # names of one spelling are compared once; the names of a scope are few, and lengths alone rule out most pairs
    spellings = rest.select(*scope, "normalized", "expanded").distinct()
    others = small.where(F.col("method") != "natural_key_alias").select(*scope, "canonical", "spelled").distinct()
    pairs = spellings.join(others, scope) if scope else spellings.crossJoin(others)
    possible = F.greatest(text.most_similar(F.col("normalized"), F.col("spelled")), text.most_similar(F.col("expanded"), F.col("spelled"))) >= ambiguous * 100
    similarity = F.greatest(text.indel_similarity("normalized", "spelled"), text.indel_similarity("expanded", "spelled"))
    key = [*scope, "normalized", "expanded"]
    scored = pairs.where(possible).withColumn("s", similarity).groupBy(*key, "canonical").agg(F.max("s").alias("score")).where(F.col("score") >= ambiguous * 100)
    top = scored.withColumn("top", F.max("score").over(Window.partitionBy(*key))).where("score = top").drop("top")
    top = rest.select(*dict.fromkeys([*ids, *scope]), "normalized", "expanded").join(top, key)
    status = F.when(F.col("score") >= accept * 100, f"{prefix}_MATCHED_FUZZY_HIGH").otherwise(f"{prefix}_AMBIGUOUS")
    return sure.unionByName(top.select(*ids, "canonical", F.lit("fuzzy").alias("method"), "score", status.alias("status")))


def map_tables(tables: DataFrame, rules: NameRules) -> DataFrame:
    """One row per (submission_id, table_name): answer_table, match_status, match_method, match_score, candidates and key forms."""
    ids = ["submission_id", "table_name"]
    keyed = keep(with_keys(tables, "table_name", rules), "table-keys")
    found = _resolve(keyed, ids, table_aliases(tables.sparkSession, rules), [], TABLE_METHODS, rules.table_accept, rules.table_ambiguous, "TABLE")
    best = found.groupBy(*ids).agg(F.array_sort(F.collect_set("canonical")).alias("candidates"), F.first(F.struct("method", "status", "score")).alias("m"))
    single = F.size("candidates") == 1
    status = F.when(F.col("candidates").isNull(), "TABLE_UNMAPPED").when(single, F.col("m.status")).otherwise("TABLE_AMBIGUOUS")
    return keyed.join(best, ids, "left").select(
        *ids,
        F.when(single, F.col("candidates")[0]).alias("answer_table"),
        status.alias("match_status"),
        F.when(single, F.col("m.method")).when(F.size("candidates") > 1, "multiple_matches").alias("match_method"),
        F.when(single, F.col("m.score")).otherwise(0.0).alias("match_score"),
        F.concat_ws(";", "candidates").alias("candidate_tables"),
        (~single | status.isin("TABLE_AMBIGUOUS", "TABLE_MATCHED_WEAK_ALIAS") | F.col("candidates").isNull()).alias("review_required"),
        "normalized",
        "expanded",
        "compact",
    )


def map_columns(columns: DataFrame, expected: DataFrame, rules: NameRules) -> DataFrame:
    """One row per (submission_id, student_table, column_name) inside its answer_table: the column it stands for.

    columns: submission_id, answer_table, student_table, column_name. expected: answer_table, column_name.
    A match whose role contradicts the reference column's is incompatible and counts only if no other is left.
    """
    ids = ["submission_id", "answer_table", "student_table", "column_name"]
    keyed = keep(with_keys(columns.select(*ids).distinct(), "column_name", rules), "column-keys")
    found = _resolve(keyed, ids, column_aliases(expected, rules), ["answer_table"], COLUMN_METHODS, rules.column_accept, rules.column_ambiguous, "COLUMN")
    fits = text.roles_compatible(text.column_role("canonical"), text.column_role("column_name"))
    guarded = found.withColumn("fits", fits)
    kept = guarded.withColumn("any", F.max("fits").over(Window.partitionBy(*ids))).where("fits OR NOT any")
    best = kept.groupBy(*ids).agg(F.array_sort(F.collect_set("canonical")).alias("candidates"), F.min_by(F.struct("method", "status", "score", "fits"), "canonical").alias("m"))
    single, fit = F.size("candidates") == 1, F.col("m.fits")
    status = (
        F.when(F.col("candidates").isNull(), "COLUMN_UNMAPPED")
        .when(~fit, "COLUMN_INCOMPATIBLE_ROLE")
        .when(single, F.col("m.status"))
        .otherwise("COLUMN_AMBIGUOUS")
    )
    named = F.when(single | ~fit, F.col("candidates")[0])
    return keyed.join(best, ids, "left").select(
        *ids,
        named.alias("answer_column"),
        status.alias("match_status"),
        F.when(single | ~fit, F.col("m.method")).when(F.size("candidates") > 1, "multiple_matches").alias("match_method"),
        F.when(single | ~fit, F.col("m.score")).otherwise(0.0).alias("match_score"),
        (~status.startswith("COLUMN_MATCHED")).alias("review_required"),
        "normalized",
        "expanded",
        "compact",
    )
