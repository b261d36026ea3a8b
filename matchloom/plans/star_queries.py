"""The comparison operators on the star schema and the report tables, each with the SQL it is checked against.

Every query runs over its whole tables. Cases the data lacks (nulls, duplicates, defects) are made by a rule on
values that both sides apply alike.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from matchloom.config import NameRules, Rules, TypeRules, ViewRules
from matchloom.functions import text
from matchloom.operators import assign, canonical, compare, keys, score, structure, types
from matchloom.plans import sqlviews
from matchloom.session import table

TABLES = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings")
Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    """Registers a query with its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


# --- sources and canonical values ---


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS row_count FROM {t}" for t in TABLES))
def snapshot_row_counts(spark, d):
    parts = [table(spark, d, t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count") for t in TABLES]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


_SQL_TEXT = r"regexp_replace(lower(regexp_replace(nfc_normalize({c}), '^\s+|\s+$', '', 'g')), '\s+', ' ', 'g')"


@query(f"SELECT p_partkey, {_SQL_TEXT.format(c='p_name')} AS name, {_SQL_TEXT.format(c='p_type')} AS type FROM part")
def canonical_text(spark, d):
    return table(spark, d, "part").select("p_partkey", canonical.text(F.col("p_name")).alias("name"), canonical.text(F.col("p_type")).alias("type"))


@query("SELECT doc_id, length(regexp_replace(lower(regexp_replace(text, '^\\s+|\\s+$', '', 'g')), '\\s+', ' ', 'g')) AS n FROM documents WHERE text IS NOT NULL")
def canonical_text_length(spark, d):
    plain = F.regexp_replace(F.lower(F.regexp_replace("text", r"^\s+|\s+$", "")), r"\s+", " ")
    return table(spark, d, "documents", "doc_id", "text").where("text IS NOT NULL").select("doc_id", F.length(plain).cast("bigint").alias("n"))


@query("SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, round_even(l_extendedprice * (1 - l_discount), 2) AS amount FROM lineitem")
def canonical_number(spark, d):
    return table(spark, d, "lineitem").select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", canonical.number(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("amount"))


@query("SELECT o_orderkey, CASE WHEN bool_and(strftime(o_orderdate, '%H:%M:%S') = '00:00:00') OVER () THEN strftime(o_orderdate, '%Y-%m-%d') ELSE strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') END AS orderdate FROM orders")
def canonical_date_column(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_orderdate")
    return orders.select("o_orderkey", canonical.date_column(orders, "o_orderdate").alias("orderdate"))


@query("SELECT row_id, coalesce(CASE WHEN regexp_matches(s, '^[0-9]{4}-[0-9]{2}-[0-9]{2}') THEN s ELSE lower(s) END, '') AS day FROM (SELECT row_id, regexp_replace(regexp_replace(regexp_replace(trim(ngayhd), '^([0-9]{4}-[0-9]{1,2}-[0-9]{1,2})[ T]00:00(:00(\\.0+)?)?$', '\\1'), '^([0-9]{4})-([0-9])-', '\\1-0\\2-'), '^([0-9]{4}-[0-9]{2})-([0-9])($|[ T])', '\\1-0\\2\\3') AS s FROM banhang)")
def canonical_date_values(spark, d):
    return table(spark, d, "banhang").select("row_id", F.coalesce(canonical.date(F.col("ngayhd")), F.lit("")).alias("day"))


@query("SELECT s_suppkey AS supplier_id, trim(lower(s_name)) AS supplier_name, round_even(s_acctbal, 2) AS balance, CAST(NULL AS VARCHAR) AS phone FROM supplier")
def align_missing_columns(spark, d):
    expected = [("supplier_id", "integer"), ("supplier_name", "text"), ("balance", "decimal"), ("phone", "text")]
    out = canonical.align(table(spark, d, "supplier"), expected, {"s_suppkey": "supplier_id", "s_name": "supplier_name", "s_acctbal": "balance"})
    return out.withColumn("supplier_id", F.col("supplier_id").cast("bigint"))


# --- comparison of outputs ---

_ANSWER = "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem"
_STUDENT = "SELECT l_orderkey, l_linenumber, CASE WHEN l_discount > 0.095 THEN l_quantity + 1 ELSE l_quantity END AS l_quantity FROM lineitem WHERE l_tax < 0.079 UNION ALL SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_quantity = 50"


def _sides(spark, d):
    lines = table(spark, d, "lineitem", "l_orderkey", "l_linenumber", "l_quantity", "l_discount", "l_tax")
    columns = ["l_orderkey", "l_linenumber", "l_quantity"]
    wrong = F.when(F.col("l_discount") > 0.095, F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    student = lines.where("l_tax < 0.079").withColumn("l_quantity", wrong).select(*columns).unionByName(lines.where("l_quantity = 50").select(*columns))
    return lines.select(*columns), student


@query(f"({_ANSWER}) EXCEPT ALL ({_STUDENT})")
def multiset_answer_minus(spark, d):
    return compare.minus(compare.signed_counts(*_sides(spark, d)))


@query(f"({_STUDENT}) EXCEPT ALL ({_ANSWER})")
def multiset_student_minus(spark, d):
    return compare.minus(compare.signed_counts(*_sides(spark, d)), answer=False)


@query(
    f"SELECT *, least(answer_minus_student_count, student_minus_answer_count) AS value_mismatch_count FROM (SELECT (SELECT count(*) FROM ({_ANSWER})) AS row_count_answer, (SELECT count(*) FROM ({_STUDENT})) AS row_count_student, "
    f"(SELECT count(*) FROM (({_ANSWER}) EXCEPT ALL ({_STUDENT}))) AS answer_minus_student_count, (SELECT count(*) FROM (({_STUDENT}) EXCEPT ALL ({_ANSWER}))) AS student_minus_answer_count)"
)
def multiset_metrics(spark, d):
    return compare.multiset_metrics(*_sides(spark, d))


@query(f"SELECT *, 'answer_only' AS _source FROM (({_ANSWER}) EXCEPT ALL ({_STUDENT})) UNION ALL SELECT *, 'student_only' AS _source FROM (({_STUDENT}) EXCEPT ALL ({_ANSWER}))")
def tagged_differences(spark, d):
    return compare.tagged_differences(compare.signed_counts(*_sides(spark, d)))


_ORD = "SELECT row_number() OVER (PARTITION BY o_custkey ORDER BY {by}) AS n, o_custkey, o_orderkey, o_orderstatus FROM orders"


@query(
    f"SELECT a.o_custkey, a.n, CAST((a.o_orderkey IS DISTINCT FROM s.o_orderkey)::INT + (a.o_orderstatus IS DISTINCT FROM s.o_orderstatus)::INT AS INTEGER) AS wrong FROM ({_ORD.format(by='o_orderdate, o_orderkey')}) a JOIN ({_ORD.format(by='o_totalprice, o_orderkey')}) s ON a.o_custkey = s.o_custkey AND a.n = s.n WHERE a.o_orderkey IS DISTINCT FROM s.o_orderkey OR a.o_orderstatus IS DISTINCT FROM s.o_orderstatus"
)
def ordered_compare(spark, d):
    orders = table(spark, d, "orders")
    side = lambda *by: orders.select(F.struct("o_custkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(*by)).alias("n")).alias("ordinal"), "o_orderkey", "o_orderstatus")
    wrong = compare.ordered_differences(side("o_orderdate", "o_orderkey"), side("o_totalprice", "o_orderkey"))
    return wrong.select("ordinal.o_custkey", "ordinal.n", F.size("columns").alias("wrong"))


_STATUS_CASE = "CASE WHEN answer_minus_student_count = 0 AND student_minus_answer_count = 0 THEN 'VIEW_PASS' WHEN row_count_answer <> row_count_student AND least(answer_minus_student_count, student_minus_answer_count) = 0 THEN 'VIEW_ROW_COUNT_MISMATCH' ELSE 'VIEW_VALUE_MISMATCH' END"
_BY_STATUS = "SELECT o_orderpriority AS v, {k} AS k, {net} AS net FROM orders{where}"


@query(
    "WITH d AS (SELECT v, k, sum(net) AS net, count(*) FILTER (WHERE net > 0) AS na, count(*) FILTER (WHERE net < 0) AS ns FROM ("
    + _BY_STATUS.format(k="o_orderkey", net=1, where="")
    + " UNION ALL "
    + _BY_STATUS.format(k="CASE WHEN o_orderpriority = '1-URGENT' AND o_totalprice > 400000 THEN -o_orderkey ELSE o_orderkey END", net=-1, where=" WHERE NOT (o_orderpriority LIKE '2%' AND o_totalprice < 1500)")
    + ") GROUP BY v, k), m AS (SELECT v, sum(na) AS row_count_answer, sum(ns) AS row_count_student, sum(greatest(net, 0)) AS answer_minus_student_count, sum(greatest(-net, 0)) AS student_minus_answer_count FROM d GROUP BY v) "
    f"SELECT v, {_STATUS_CASE} AS status FROM m"
)
def view_status(spark, d):
    orders = table(spark, d, "orders", "o_orderkey", "o_orderpriority", "o_totalprice")
    answer = orders.select(F.col("o_orderpriority").alias("v"), F.col("o_orderkey").alias("k"))
    wrong = F.when((F.col("o_orderpriority") == "1-URGENT") & (F.col("o_totalprice") > 400000), -F.col("o_orderkey")).otherwise(F.col("o_orderkey"))
    student = orders.where("NOT (o_orderpriority LIKE '2%' AND o_totalprice < 1500)").select(F.col("o_orderpriority").alias("v"), wrong.alias("k"))
    metrics = compare.multiset_metrics(answer, student, ("v",))
    return metrics.select("v", compare.multiset_status(metrics).alias("status"))


@query(
    "WITH a AS (SELECT l_returnflag AS flag, l_linestatus AS status, round_even(sum(l_quantity), 0) AS total FROM lineitem GROUP BY 1, 2), s AS (SELECT l_returnflag AS flag, l_linestatus AS status, round_even(sum(CASE WHEN l_returnflag = 'R' THEN l_quantity + 1 ELSE l_quantity END), 0) AS total FROM lineitem GROUP BY 1, 2) "
    "SELECT (SELECT count(*) FROM a) AS row_count_answer, (SELECT count(*) FROM s) AS row_count_student, (SELECT count(*) FROM (FROM a EXCEPT ALL FROM s)) AS answer_minus_student_count, (SELECT count(*) FROM (FROM s EXCEPT ALL FROM a)) AS student_minus_answer_count, (SELECT count(*) FROM (FROM s EXCEPT ALL FROM a)) AS value_mismatch_count, 'Flag;LineStatus;Total' AS matched_columns, '' AS missing_columns, '' AS extra_columns, 'VIEW_VALUE_MISMATCH' AS status, '' AS reason"
)
def revenue_view(spark, d):
    lines = table(spark, d, "lineitem", "l_returnflag", "l_linestatus", "l_quantity")
    view = ViewRules("revenue", [("Flag", "text", ("returnflag",)), ("LineStatus", "text", ()), ("Total", "number", ("SumQty",))], tolerance=1.0)
    answer = lines.groupBy(F.col("l_returnflag").alias("Flag"), F.col("l_linestatus").alias("LineStatus")).agg(F.sum("l_quantity").alias("Total"))
    wrong = F.when(F.col("l_returnflag") == "R", F.col("l_quantity") + 1).otherwise(F.col("l_quantity"))
    student = lines.groupBy(F.concat(F.lit(" "), F.lower("l_returnflag")).alias("ReturnFlag"), F.col("l_linestatus").alias("Line_Status")).agg(F.sum(wrong).alias("sum_qty"))
    return compare.compare_view(answer, student, view)


# --- joins, keys, aggregation ---


@query("SELECT n_nationkey, CASE WHEN r_regionkey IS NULL THEN 'MISSING' WHEN n_name < r_name THEN 'PASS' ELSE 'PK_MISMATCH' END AS status FROM nation LEFT JOIN region ON n_regionkey = r_regionkey")
def exact_pk_lookup(spark, d):
    both = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return both.select("n_nationkey", F.when(F.col("r_regionkey").isNull(), "MISSING").when(F.col("n_name") < F.col("r_name"), "PASS").otherwise("PK_MISMATCH").alias("status"))


@query("SELECT coalesce(a.k, s.k) AS k, CASE WHEN s.k IS NULL THEN 'MISSING' WHEN a.k IS NULL THEN 'EXTRA' ELSE 'PASS' END AS status FROM (SELECT DISTINCT c_nationkey AS k FROM customer WHERE c_acctbal > 9900) a FULL JOIN (SELECT DISTINCT s_nationkey AS k FROM supplier WHERE s_acctbal > 5000) s ON a.k = s.k")
def fk_full_outer(spark, d):
    a = table(spark, d, "customer").where("c_acctbal > 9900").select(F.col("c_nationkey").alias("k")).distinct().withColumn("a", F.lit(True))
    s = table(spark, d, "supplier").where("s_acctbal > 5000").select(F.col("s_nationkey").alias("k")).distinct().withColumn("s", F.lit(True))
    return a.join(s, "k", "full").select("k", F.when(F.col("s").isNull(), "MISSING").when(F.col("a").isNull(), "EXTRA").otherwise("PASS").alias("status"))


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def missing_anti(spark, d):
    return table(spark, d, "orders", "o_orderkey").join(table(spark, d, "lineitem", "l_orderkey"), F.col("l_orderkey") == F.col("o_orderkey"), "left_anti")


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')")
def accepted_semi(spark, d):
    urgent = table(spark, d, "orders", "o_custkey", "o_orderpriority").where("o_orderpriority = '1-URGENT'")
    return table(spark, d, "customer", "c_custkey").join(urgent, F.col("o_custkey") == F.col("c_custkey"), "left_semi")


@query("SELECT o_custkey AS submission_id FROM orders GROUP BY o_custkey HAVING count(DISTINCT o_orderpriority) = (SELECT count(DISTINCT o_orderpriority) FROM orders)")
def relational_division(spark, d):
    orders = table(spark, d, "orders", "o_custkey", "o_orderpriority").select(F.col("o_custkey").alias("submission_id"), F.col("o_orderpriority").alias("answer_table"))
    return structure.all_covered(orders.select("answer_table").distinct(), orders.distinct(), ["submission_id"], "answer_table", orders.select("submission_id").distinct())


@query("SELECT l_orderkey AS submission_id, string_agg(l_partkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS child_columns, string_agg(l_suppkey::VARCHAR, ',' ORDER BY l_linenumber, l_partkey, l_suppkey) AS parent_columns, FALSE AS order_unknown FROM lineitem GROUP BY l_orderkey")
def fk_signature(spark, d):
    rows = table(spark, d, "lineitem", "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber").select(
        F.col("l_orderkey").alias("submission_id"), F.lit("fk").alias("fk_name"), F.lit("lineitem").alias("child_table"), F.lit("part").alias("parent_table"), F.col("l_partkey").alias("child_column"), F.col("l_suppkey").alias("parent_column"), F.col("l_linenumber").alias("ordinal")
    )
    return keys.signatures(rows, ["submission_id"]).select("submission_id", "child_columns", "parent_columns", "order_unknown")


@query("SELECT c_custkey, count(*) OVER (PARTITION BY c_nationkey, c_mktsegment) AS rivals FROM customer")
def competing_mappings(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.count(F.lit(1)).over(Window.partitionBy("c_nationkey", "c_mktsegment")).alias("rivals"))


@query("SELECT p_partkey, CASE WHEN row_number() OVER (PARTITION BY p_brand, p_size ORDER BY p_retailprice DESC, p_partkey) = 1 THEN 'accepted' ELSE 'demoted_duplicate' END AS resolution FROM part")
def duplicate_demotion(spark, d):
    place = F.row_number().over(Window.partitionBy("p_brand", "p_size").orderBy(F.col("p_retailprice").desc(), "p_partkey"))
    return table(spark, d, "part").select("p_partkey", F.when(place == 1, "accepted").otherwise("demoted_duplicate").alias("resolution"))


@query("SELECT o_custkey, o_orderkey FROM (SELECT *, rank() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC) AS r FROM orders) WHERE r = 1")
def top_with_ties(spark, d):
    orders = table(spark, d, "orders", "o_custkey", "o_orderkey", "o_orderdate")
    newest = F.max("o_orderdate").over(Window.partitionBy("o_custkey"))
    return orders.withColumn("newest", newest).where("o_orderdate = newest").select("o_custkey", "o_orderkey")


@query("SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY CASE WHEN o_totalprice > 300000 THEN NULL ELSE o_totalprice END ASC NULLS LAST, o_orderkey) AS place FROM orders")
def sort_nulls_last(spark, d):
    price = F.when(F.col("o_totalprice") <= 300000, F.col("o_totalprice"))
    return table(spark, d, "orders").select("o_custkey", "o_orderkey", F.row_number().over(Window.partitionBy("o_custkey").orderBy(price.asc_nulls_last(), "o_orderkey")).alias("place"))


@query("SELECT match_status, count(*) AS n FROM column_mapping_report GROUP BY 1")
def status_histogram(spark, d):
    return score.status_histogram(table(spark, d, "column_mapping_report", "match_status"), [], "match_status")


@query("SELECT submission_id, count(*) FILTER (WHERE match_status LIKE 'COLUMN_MATCHED%') AS matched, count(*) FILTER (WHERE match_status = 'COLUMN_MISSING_ANSWER') AS missing, count(*) FILTER (WHERE review_required) AS review FROM column_mapping_report GROUP BY 1")
def conditional_counters(spark, d):
    rows = table(spark, d, "column_mapping_report", "submission_id", "match_status", "review_required")
    return score.conditional_counters(rows, ["submission_id"], {"matched": F.col("match_status").startswith("COLUMN_MATCHED"), "missing": F.col("match_status") == "COLUMN_MISSING_ANSWER", "review": F.col("review_required")})


@query("SELECT submission_id, count(DISTINCT lower(trim(answer_view))) AS views FROM view_test_report GROUP BY 1")
def distinct_views(spark, d):
    return table(spark, d, "view_test_report", "submission_id", "answer_view").groupBy("submission_id").agg(F.count_distinct(F.lower(F.trim("answer_view"))).alias("views"))


@query("SELECT submission_id, CASE WHEN bool_or(status LIKE '%ERROR%') THEN 'ERROR' ELSE coalesce(arg_min(status, test_id) FILTER (WHERE status NOT IN ('VIEW_PASS', 'VIEW_OUTPUT_MATCH')), 'OK') END AS test_status FROM view_test_report GROUP BY 1")
def first_failure(spark, d):
    rows = table(spark, d, "view_test_report", "submission_id", "test_id", "status")
    return score.first_failure(rows, ["submission_id"], "test_id", F.col("status").isin("VIEW_PASS", "VIEW_OUTPUT_MATCH"))


_CLEAN = ("COLUMN_MATCHED_EXACT", "COLUMN_MATCHED_ALIAS", "COLUMN_MATCHED_ABBREVIATION", "TABLE_MATCHED_EXACT", "TABLE_MATCHED_ALIAS", "TABLE_MATCHED_ABBREVIATION")


@query(" UNION ALL ".join(f"SELECT '{t}' AS report, map_id, match_status FROM {t} WHERE coalesce(review_required, FALSE) OR match_status NOT IN {_CLEAN}" for t in ("column_mapping_report", "table_mapping_report")))
def issue_union(spark, d):
    part = lambda t: score.issues(table(spark, d, t, "map_id", "match_status", "review_required"), list(_CLEAN)).select(F.lit(t).alias("report"), "map_id", "match_status")
    return part("column_mapping_report").unionByName(part("table_mapping_report"))


@query("SELECT assignment_code, raw_student_column AS identifier, count(*) AS n, arg_min(submission_id, map_id) AS first_example FROM column_mapping_report WHERE match_status = 'COLUMN_UNMAPPED' GROUP BY 1, 2")
def unmapped_summary(spark, d):
    rows = table(spark, d, "column_mapping_report", "assignment_code", "raw_student_column", "submission_id", "map_id", "match_status").where("match_status = 'COLUMN_UNMAPPED'")
    return score.unmapped_summary(rows.withColumnRenamed("raw_student_column", "identifier"), ["assignment_code"], "identifier", "submission_id", "map_id")


@query("SELECT submission_id, CASE min(CASE WHEN match_status = 'COLUMN_MISSING_ANSWER' THEN 0 WHEN match_status = 'COLUMN_TYPE_MISMATCH' THEN 1 WHEN review_required THEN 2 ELSE 3 END) WHEN 0 THEN 'FAIL_STRUCTURE' WHEN 1 THEN 'FAIL_DATA' WHEN 2 THEN 'NEEDS_REVIEW' ELSE 'PASS' END AS suggested_status FROM column_mapping_report GROUP BY 1")
def suggested_status(spark, d):
    rows = table(spark, d, "column_mapping_report", "submission_id", "match_status", "review_required")
    order = [("FAIL_STRUCTURE", F.col("match_status") == "COLUMN_MISSING_ANSWER"), ("FAIL_DATA", F.col("match_status") == "COLUMN_TYPE_MISMATCH"), ("NEEDS_REVIEW", F.col("review_required"))]
    return score.priority_status(rows, ["submission_id"], order)


@query("SELECT o_custkey AS submission_id, round(10.0 * count(DISTINCT CASE WHEN o_orderstatus = 'F' THEN o_orderpriority END) / (SELECT count(DISTINCT o_orderpriority) FROM orders), 6) AS points FROM orders GROUP BY 1")
def proportional_score(spark, d):
    orders = table(spark, d, "orders", "o_custkey", "o_orderpriority", "o_orderstatus")
    statuses = orders.groupBy(F.col("o_custkey").alias("submission_id"), F.lit("c").alias("component"), F.col("o_orderpriority").alias("object_name")).agg(F.when(F.bool_or(F.col("o_orderstatus") == "F"), "PASS").otherwise("MISSING").alias("status"))
    items = orders.select(F.lit("c").alias("component"), F.col("o_orderpriority").alias("object_name")).distinct()
    rubric = spark.createDataFrame([("s", "c", 10.0, "PASS|OK")], "section string, component string, total_points double, include_statuses string")
    return score.proportional_points(rubric, items, statuses).select("submission_id", F.round("points", 6).alias("points"))


@query("SELECT test_id, round(10 * ((CASE WHEN status <> 'VIEW_NOT_FOUND' THEN 2 ELSE 0 END + CASE WHEN missing_columns IS NULL OR trim(missing_columns) = '' THEN 2 ELSE 0 END + CASE WHEN row_count_answer = row_count_student THEN 2 ELSE 0 END + CASE WHEN value_mismatch_count = 0 THEN 3 ELSE 0 END) / 9.0), 6) AS points FROM view_test_report")
def weighted_score(spark, d):
    checks = {"exists": F.col("status") != "VIEW_NOT_FOUND", "schema": F.trim(F.coalesce("missing_columns", F.lit(""))) == "", "rows": F.col("row_count_answer") == F.col("row_count_student"), "values": F.col("value_mismatch_count") == 0}
    points = score.weighted_points(F.lit(10.0), checks, {"exists": 2 / 9, "schema": 2 / 9, "rows": 2 / 9, "values": 3 / 9})
    return table(spark, d, "view_test_report").select("test_id", F.round(points, 6).alias("points"))


@query("SELECT test_id, coalesce(CASE WHEN o.points IS NOT NULL THEN o.points END, coalesce(total_match_score, 0.0)) AS final_points, o.points IS NOT NULL AS override_applied FROM view_test_report v LEFT JOIN (SELECT submission_id, answer_view, arg_min(value_score, test_id) AS points FROM view_test_report WHERE status = 'VIEW_VALUE_MISMATCH' AND value_score IS NOT NULL GROUP BY 1, 2) o ON v.submission_id = o.submission_id AND v.answer_view = o.answer_view")
def override_score(spark, d):
    tests = table(spark, d, "view_test_report", "test_id", "submission_id", "answer_view", "status", "value_score", "total_match_score")
    overrides = tests.where("status = 'VIEW_VALUE_MISMATCH' AND value_score IS NOT NULL").select("submission_id", "answer_view", F.col("value_score").alias("override_points"), F.lit("").alias("override_status"), F.lit("").alias("reviewer_note"), F.col("test_id").alias("ordinal"))
    points = tests.select("test_id", "submission_id", "answer_view", F.coalesce("total_match_score", F.lit(0.0)).alias("points"))
    return score.apply_overrides(points, overrides, ["submission_id", "answer_view"]).select("test_id", "final_points", "override_applied")


@query(
    "WITH a AS (SELECT r_name AS expected_view, count(*) AS n FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY 1), s AS (SELECT c_mktsegment AS student_view, count(DISTINCT c_nationkey) AS n FROM customer GROUP BY 1) "
    "SELECT expected_view, student_view, round((2 * 1.0 + 2 * greatest(0.0, 1 - abs(a.n - s.n) / greatest(a.n, 1)) + 5 * greatest(0.0, 1 - least(a.n, s.n) / 2.0 / greatest(a.n, 1))) / 9, 6) AS total_match_score FROM a CROSS JOIN s"
)
def candidate_cross_scores(spark, d):
    a = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).groupBy(F.col("r_name").alias("expected_view")).agg(F.count(F.lit(1)).alias("row_count_answer"))
    s = table(spark, d, "customer").groupBy(F.col("c_mktsegment").alias("student_view")).agg(F.count_distinct("c_nationkey").alias("row_count_student"))
    # expected views are a handful per assignment, as are a submission's candidates
    pairs = a.crossJoin(F.broadcast(s)).withColumns({"matched_columns": F.lit(3), "expected_columns": F.lit(3), "value_mismatch_count": F.least("row_count_answer", "row_count_student") / 2, "order_mismatch_count": F.lit(0)})
    return pairs.withColumns(assign.score_columns()).select("expected_view", "student_view", F.round("total_match_score", 6).alias("total_match_score"))


@query(None)
def greedy_assignment(spark, d):
    """Candidates of each submission by their reported scores, assigned one to one."""
    tests = table(spark, d, "view_test_report", "submission_id", "answer_view", "student_view", "total_match_score", "status", "test_id").where("student_view IS NOT NULL")
    names = F.count(F.lit(1)).over(Window.partitionBy("submission_id"))
    pairs = tests.alias("e").join(tests.alias("s"), "submission_id").select(
        "submission_id", F.col("e.answer_view").alias("expected_view"), F.col("s.student_view").alias("student_view"),
        F.when(F.col("e.test_id") == F.col("s.test_id"), F.coalesce("e.total_match_score", F.lit(0.0))).otherwise(0.0).alias("total_match_score"),
        (text.view_key(F.col("e.answer_view")) == text.view_key(F.col("s.student_view"))).cast("int").alias("hint_score"), F.col("e.status").alias("candidate_status"), (F.col("e.test_id") * 1_000_000 + F.col("s.test_id")).alias("ordinal"),
    )
    return assign.assign(pairs)


@query("SELECT r_name, n_name FROM region JOIN nation ON r_name = n_name OR regexp_replace(lower(r_name), '[^a-z0-9]', '', 'g') = regexp_replace(lower(n_name), '[^a-z0-9]', '', 'g') OR regexp_matches(n_name, '(?i)(^|[^A-Za-z0-9])' || r_name || '([^A-Za-z0-9]|$)')")
def scope_theta_match(spark, d):
    return F.broadcast(table(spark, d, "region", "r_name")).join(table(spark, d, "nation", "n_name"), score.scope_match(F.col("r_name"), F.col("n_name")))


# --- names and types ---

_KEY_SQL = (
    r"regexp_replace(regexp_replace(trim(regexp_replace(trim(regexp_replace(trim(replace(lower(strip_accents({c})), 'đ', 'd')), '^[0-9]+[.\s_–-]*', '')), '^cau\s*[0-9]*[.\s_–-]*', '')), '[^\p{{L}}\p{{N}}_\s]', '', 'g'), '[\s_–-]+', '', 'g')"
)


@query(f"SELECT map_id, {_KEY_SQL.format(c='raw_student_column')} AS key FROM column_mapping_report WHERE raw_student_column IS NOT NULL")
def normalize_key(spark, d):
    return table(spark, d, "column_mapping_report", "map_id", "raw_student_column").where("raw_student_column IS NOT NULL").select("map_id", text.normalize_key("raw_student_column").alias("key"))


@query(
    "SELECT canonical_name, CASE WHEN regexp_matches(n, 'ma|id|code|key') THEN 'ma' WHEN regexp_matches(n, 'ten|name') THEN 'ten' WHEN regexp_matches(n, 'ngay|date|time') THEN 'ngay' WHEN regexp_matches(n, 'soluong|qty|quantity') THEN 'soluong' WHEN regexp_matches(n, 'dongia|price') AND NOT contains(n, 'tongtien') THEN 'dongia' WHEN regexp_matches(n, 'tongtien|amount|thanhtien') THEN 'tongtien' END AS role FROM (SELECT canonical_name, lower(canonical_name) AS n FROM canonical_names WHERE kind = 'column')"
)
def column_role(spark, d):
    return table(spark, d, "canonical_names").where("kind = 'column'").select("canonical_name", text.column_role("canonical_name").alias("role"))


_BARE = "trim(regexp_replace(lower({c}), '\\s*\\(.*\\)\\s*$', ''))"
_GROUP = "CASE " + " ".join(f"WHEN {_BARE} IN ({', '.join(repr(t) for t in ts)}) THEN '{g}'" for g, ts in types.GROUPS.items()) + " ELSE 'unknown' END"


@query(f"SELECT map_id, {_GROUP.format(c='student_type_raw')} AS type_group FROM column_mapping_report WHERE student_type_raw IS NOT NULL")
def sql_type_group(spark, d):
    return table(spark, d, "column_mapping_report", "map_id", "student_type_raw").where("student_type_raw IS NOT NULL").select("map_id", types.type_group("student_type_raw").alias("type_group"))


def _kind(c: str) -> str:
    return f"CASE WHEN {_GROUP.format(c=c)} = 'integer' THEN 'i' WHEN {_BARE.format(c=c)} IN ('char', 'varchar', 'nchar', 'nvarchar') THEN 't' WHEN {_BARE.format(c=c)} IN ('decimal', 'numeric') AND regexp_matches({c}, ',\\s*0\\s*\\)') THEN 'w' END"


@query(
    f"SELECT map_id, CASE WHEN {_BARE.format(c='a')} = {_BARE.format(c='s')} THEN 'TYPE_MATCH_EXACT' WHEN ga = gs AND ga <> 'unknown' THEN 'TYPE_MATCH_GROUP' WHEN regexp_matches(lower(answer_column), 'ma|id|code|key') AND ({_kind('a')}) <> ({_kind('s')}) THEN 'TYPE_IDENTIFIER_COMPATIBLE_WARNING' "
    "WHEN (ga, gs) IN (('fixed_decimal', 'floating'), ('floating', 'fixed_decimal'), ('integer', 'fixed_decimal'), ('fixed_decimal', 'integer')) THEN 'TYPE_COMPATIBLE_WARNING' ELSE 'TYPE_MISMATCH' END AS type_status "
    f"FROM (SELECT map_id, answer_column, answer_type_raw AS a, student_type_raw AS s, {_GROUP.format(c='answer_type_raw')} AS ga, {_GROUP.format(c='student_type_raw')} AS gs FROM column_mapping_report WHERE answer_type_raw IS NOT NULL AND student_type_raw IS NOT NULL AND answer_column IS NOT NULL)"
)
def type_compatibility(spark, d):
    rows = table(spark, d, "column_mapping_report", "map_id", "answer_column", "answer_type_raw", "student_type_raw").dropna()
    return rows.select("map_id", types.compare_types("answer_type_raw", "student_type_raw", "answer_column", rules=TypeRules())["type_status"].alias("type_status"))


@query(None)
def indel_similarity(spark, d):
    """Similarity of every matched pair of names; SQL has no longest common subsequence."""
    rows = table(spark, d, "column_mapping_report", "student_column", "answer_column").where("student_column <> '' AND answer_column <> ''").groupBy("student_column", "answer_column").agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("similarity", F.round(text.indel_similarity(F.lower("student_column"), F.lower("answer_column")), 4))


@query("SELECT doc_id, CASE WHEN t = '' THEN '' ELSE sha256(t) END AS hash FROM (SELECT doc_id, trim(lower(regexp_replace(coalesce(text, ''), '[\\t\\n\\x0b\\f\\r\\x{85}\\p{Z}]+', ' ', 'g'))) AS t FROM documents)")
def sha_fingerprint(spark, d):
    return table(spark, d, "documents", "doc_id", "text").select("doc_id", text.fingerprint("text").alias("hash"))


@query("SELECT map_id, len(list_filter(list_transform(string_split(coalesce(candidate_tables, ''), ';'), lambda x: trim(x)), lambda x: x <> ''))::INTEGER AS n FROM table_mapping_report")
def split_identifiers(spark, d):
    return table(spark, d, "table_mapping_report", "map_id", "candidate_tables").select("map_id", F.size(text.split_identifiers("candidate_tables")).alias("n"))


@query("SELECT row_id, CASE WHEN trim(soluong) <> '' AND upper(trim(soluong)) <> 'NULL' THEN trim(soluong) END AS soluong, coalesce(try_cast(trim(dongia) AS DOUBLE), 0.0) AS dongia FROM chitietbanhang")
def seed_values(spark, d):
    return table(spark, d, "chitietbanhang", "row_id", "soluong", "dongia").select("row_id", text.parse_value("soluong").alias("soluong"), text.safe_double("dongia").alias("dongia"))


# --- lists, keys and latest entries of the reports ---


@query("SELECT submission_id, answer_view, arg_max(status, (tested_at, test_id)) AS status FROM view_test_report GROUP BY 1, 2")
def latest_entry(spark, d):
    rows = table(spark, d, "view_test_report", "submission_id", "answer_view", "status", "tested_at", "test_id")
    return rows.groupBy("submission_id", "answer_view").agg(F.max_by("status", F.struct("tested_at", "test_id")).alias("status"))


@query("SELECT submission_id, identifier, count(*) AS n FROM (SELECT submission_id, unnest(list_filter(list_transform(string_split(coalesce(matched_columns, ''), ';'), lambda x: trim(x)), lambda x: x <> '')) AS identifier FROM view_test_report) GROUP BY 1, 2")
def listed_identifiers(spark, d):
    rows = score.unmapped_identifiers(table(spark, d, "view_test_report", "submission_id", "matched_columns"), "matched_columns")
    return rows.groupBy("submission_id", "identifier").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT test_id, regexp_replace(lower(answer_view), '[^a-z0-9]', '', 'g') = regexp_replace(lower(student_view), '[^a-z0-9]', '', 'g') AS hint FROM view_test_report")
def name_hints(spark, d):
    return table(spark, d, "view_test_report", "test_id", "answer_view", "student_view").select("test_id", (text.view_key("answer_view") == text.view_key("student_view")).alias("hint"))


@query("SELECT canonical_name, regexp_matches(lower(canonical_name), 'ma|id|code|key') AS identifier FROM canonical_names WHERE kind = 'column'")
def identifier_columns(spark, d):
    return table(spark, d, "canonical_names").where("kind = 'column'").select("canonical_name", types.is_identifier("canonical_name").alias("identifier"))


@query("SELECT map_id FROM table_mapping_report WHERE lower(raw_student_table) NOT IN ('sysdiagrams', 'test_sheet', 'taixe')")
def exclusion_filter(spark, d):
    rules = Rules(names=NameRules(excluded_tables=("sysdiagrams", "test_sheet", "TaiXe")))
    return structure.active(table(spark, d, "table_mapping_report", "map_id", "raw_student_table"), rules, "raw_student_table").select("map_id")


@query(
    "SELECT submission_id, max(CASE WHEN r = 1 THEN student_view END) AS best, max(CASE WHEN r = 2 THEN student_view END) AS second FROM (SELECT submission_id, student_view, row_number() OVER (PARTITION BY submission_id ORDER BY total_match_score DESC, test_id) AS r FROM view_test_report WHERE total_match_score IS NOT NULL AND student_view IS NOT NULL) GROUP BY 1"
)
def best_two_views(spark, d):
    rows = table(spark, d, "view_test_report", "submission_id", "student_view", "total_match_score", "test_id").where("total_match_score IS NOT NULL AND student_view IS NOT NULL")
    return assign.best_two(rows, ["submission_id"], tie="test_id").select("submission_id", "best", "second")


@query("SELECT makh, count(*) AS n, count(tenkh) AS named FROM (SELECT upper(trim(makh)) AS makh, nullif(trim(tenkh), '') AS tenkh FROM khachhang) GROUP BY 1 HAVING count(*) > 1")
def repeated_keys(spark, d):
    rows = table(spark, d, "khachhang", "makh", "tenkh").select(F.upper(F.trim("makh")).alias("makh"), F.nullif(F.trim("tenkh"), F.lit("")).alias("tenkh"))
    return rows.groupBy("makh").agg(F.count(F.lit(1)).alias("n"), F.count("tenkh").alias("named")).where("n > 1")


# --- candidate SQL ---


def _candidate(spark, d, sql: str, **tables: str) -> DataFrame:
    run = sqlviews.run_view(spark, sql, {t: table(spark, d, t) for t in tables.values()}, tables)
    if run.data is None:
        raise ValueError(f"{run.status}: {run.error}")
    return DataFrame(spark._jvm.org.apache.spark.sql.classic.Dataset.ofRows(spark._jsparkSession, run.data._jdf.queryExecution().analyzed()), spark)


@query("SELECT c_custkey AS ma, n FROM customer, LATERAL (SELECT count(*) AS n FROM orders WHERE o_custkey = c_custkey) a")
def tsql_apply(spark, d):
    return _candidate(spark, d, "CREATE VIEW dbo.v AS SELECT k.[c_custkey] AS ma, a.n FROM dbo.KhachHang k CROSS APPLY (SELECT COUNT(*) AS n FROM dbo.HoaDon h WHERE h.o_custkey = k.c_custkey) a;", KhachHang="customer", HoaDon="orders")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25 OFFSET 10")
def tsql_top_offset(spark, d):
    return _candidate(spark, d, "CREATE VIEW v AS SELECT o_orderkey, o_totalprice FROM HoaDon ORDER BY o_totalprice DESC, o_orderkey OFFSET 10 ROWS FETCH NEXT 25 ROWS ONLY", HoaDon="orders")


@query("WITH a AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F'), b AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'O') SELECT o_custkey FROM a INTERSECT SELECT o_custkey FROM b")
def tsql_cte_set_ops(spark, d):
    return _candidate(spark, d, "CREATE VIEW v AS WITH a AS (SELECT o_custkey FROM dbo.HoaDon WHERE o_orderstatus = N'F'), b AS (SELECT o_custkey FROM dbo.HoaDon WHERE o_orderstatus = N'O') SELECT o_custkey FROM a INTERSECT SELECT o_custkey FROM b", HoaDon="orders")


# --- evidence of keys in the data ---


@query("SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def key_uniqueness_evidence(spark, d):
    return table(spark, d, "lineitem", "l_orderkey", "l_linenumber").groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("n")).where("n > 1")


@query("SELECT o_orderkey FROM orders WHERE NOT EXISTS (SELECT 1 FROM customer WHERE c_custkey = o_custkey AND c_acctbal > 0)")
def fk_orphans(spark, d):
    parents = table(spark, d, "customer", "c_custkey", "c_acctbal").where("c_acctbal > 0")
    return table(spark, d, "orders", "o_orderkey", "o_custkey").join(parents, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("o_orderkey")


# --- mapping and structure on the report tables ---


def _reference(spark, d) -> tuple[DataFrame, DataFrame, Rules]:
    """Reference tables and columns per assignment's matched rows, with the canonical list's aliases as rules."""
    names = table(spark, d, "canonical_names").collect()
    alias = lambda r: [x for x in [r["label_en"], *(r["known_aliases"] or "").split(";")] if x]
    rules = NameRules(tables={r["canonical_name"]: alias(r) for r in names if r["kind"] == "table"}, columns_global={r["canonical_name"]: alias(r) for r in names if r["kind"] == "column"})
    report = table(spark, d, "table_mapping_report", "submission_id", "assignment_code", "raw_answer_table").where("submission_id IS NOT NULL")
    used = report.where("raw_answer_table <> ''").select("assignment_code", F.col("raw_answer_table").alias("table_name")).distinct()
    t = report.select("submission_id", "assignment_code").distinct().join(used, "assignment_code").select("submission_id", F.lit(None).cast("string").alias("table_name_canonical"), "table_name", F.lit(0).alias("object_id"), F.lit(0).alias("row_count"))
    c = table(spark, d, "column_mapping_report").where("answer_table <> '' AND answer_column <> ''").groupBy(F.col("answer_table").alias("table_name_canonical"), F.col("answer_column").alias("column_name")).agg(F.min("answer_type_raw").alias("data_type"))
    return t, c.withColumns({"table_name": F.col("table_name_canonical"), "scale": F.lit(None).cast("int")}), Rules(names=rules)


@query(None)
def map_tables(spark, d):
    """Table mapping of every submission from the names in the report."""
    answer, _, rules = _reference(spark, d)
    student = table(spark, d, "table_mapping_report", "submission_id", "raw_student_table").where("raw_student_table <> ''").select("submission_id", F.col("raw_student_table").alias("table_name")).distinct()
    return structure.table_mapping(answer, student, rules)


@query(None)
def map_columns(spark, d):
    """Column mapping of every matched table of every submission from the names in the report."""
    answer, expected, rules = _reference(spark, d)
    own = table(spark, d, "column_mapping_report", "submission_id", "student_table", "raw_student_column", "student_type_raw").where("raw_student_column <> '' AND student_table <> ''")
    tables = own.select("submission_id", F.col("student_table").alias("table_name")).distinct()
    columns = own.groupBy("submission_id", F.col("student_table").alias("table_name"), F.col("raw_student_column").alias("column_name")).agg(F.min("student_type_raw").alias("data_type")).withColumn("scale", F.lit(None).cast("int"))
    return structure.column_mapping(structure.table_mapping(answer, tables, rules), expected, columns, rules)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)
