"""Primary and foreign keys of candidates against the reference: exact, and by adequacy."""

from __future__ import annotations

from collections.abc import Iterable

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.config import KeyRules
from matchloom.operators.structure import ACCEPTED_COLUMNS, ACCEPTED_TABLES


def ordered_keys(rows: DataFrame, by: list[str], column: str = "column_name_canonical", ordinal: str = "key_ordinal") -> DataFrame:
    """(by, columns): the key's columns in the order of their ordinals."""
    pairs = F.array_sort(F.collect_list(F.struct(F.col(ordinal).alias("o"), F.col(column).alias("c"))))
    return rows.groupBy(*by).agg(F.transform(pairs, lambda p: p["c"]).alias("columns"))


def primary_keys_exact(answer: DataFrame, student: DataFrame, accepted: DataFrame) -> DataFrame:
    """PASS, PK_MISMATCH or MISSING per submission and accepted table (submission_id, answer_table), by ordered columns."""
    wanted = ordered_keys(answer, ["table_name_canonical"]).withColumnsRenamed({"columns": "wanted", "table_name_canonical": "answer_table"})
    own = ordered_keys(student, ["submission_id", "table_name_canonical"]).withColumnRenamed("table_name_canonical", "answer_table")
    both = accepted.join(F.broadcast(wanted), "answer_table").join(own, ["submission_id", "answer_table"], "left")
    status = F.when(F.col("columns").isNull(), "MISSING").when(F.col("columns") == F.col("wanted"), "PASS").otherwise("PK_MISMATCH")
    return both.select("submission_id", "answer_table", F.concat_ws(";", "wanted").alias("answer_columns"), F.concat_ws(";", "columns").alias("student_columns"), status.alias("status"))


FK = ["parent_table_canonical", "parent_column_canonical", "referenced_table_canonical", "referenced_column_canonical"]


def foreign_keys_exact(answer: DataFrame, student: DataFrame, accepted: DataFrame) -> DataFrame:
    """PASS, RULE_MISMATCH, MISSING or EXTRA per submission and foreign key column pair; both tables must be accepted."""
    rules = ["delete_rule", "update_rule"]
    tables = accepted.select("submission_id", "answer_table")
    both_ends = lambda df: df.join(tables.withColumnRenamed("answer_table", FK[0]), ["submission_id", FK[0]], "left_semi").join(tables.withColumnRenamed("answer_table", FK[2]), ["submission_id", FK[2]], "left_semi")
    wanted = both_ends(tables.select("submission_id").distinct().crossJoin(F.broadcast(answer.select(*FK, *rules).distinct()))).withColumn("a", F.struct(*rules)).drop(*rules)
    own = both_ends(student.select("submission_id", *FK, *rules).distinct()).withColumn("s", F.struct(*rules)).drop(*rules)
    status = F.when(F.col("s").isNull(), "MISSING").when(F.col("a").isNull(), "EXTRA").when(F.col("a").eqNullSafe(F.col("s")), "PASS").otherwise("RULE_MISMATCH")
    label = F.format_string("FK: %s.%s -> %s.%s", *FK)
    return wanted.join(own, ["submission_id", *FK], "full").select("submission_id", label.alias("object"), status.alias("status"))


def signatures(rows: DataFrame, by: list[str]) -> DataFrame:
    """One row per constraint: tables, column lists and the relationship's signature.

    rows: by, fk_name, child_table, parent_table, child_column, parent_column, ordinal. The pairs stand in the order of
    their ordinals if all have one, else by name (order_unknown).
    """
    known = F.count("ordinal") == F.count(F.lit(1))
    by_ordinal = F.array_sort(F.collect_list(F.struct(F.col("ordinal").cast("int").alias("o"), F.col("child_column").alias("c"), F.col("parent_column").alias("p"))))
    by_name = F.array_sort(F.collect_list(F.struct(F.lit(None).cast("int").alias("o"), F.col("child_column").alias("c"), F.col("parent_column").alias("p"))))
    pairs = F.when(known, by_ordinal).otherwise(by_name)
    out = rows.groupBy(*by, "fk_name").agg(F.min("child_table").alias("child_table"), F.min("parent_table").alias("parent_table"), pairs.alias("pairs"), (~known).alias("order_unknown"))
    lists = lambda side: F.concat_ws(",", F.transform("pairs", lambda p: p[side]))
    out = out.withColumns({"child_columns": lists("c"), "parent_columns": lists("p")}).drop("pairs")
    return out.withColumn("signature", F.concat_ws("|", "child_table", "parent_table", "child_columns", "parent_columns"))


def _surrogate(name: str, tables: Iterable[str], identity: bool, rules: KeyRules) -> bool:
    """Whether a column is a surrogate key: identity, named by a pattern, or an id that holds its table's name."""
    low = name.lower().strip()
    squeezed = {"".join(c for c in t.lower() if c.isalnum()).lstrip("0123456789") for t in tables if t} | {t.lower().strip() for t in tables if t}
    if identity or low == "id":
        return True
    if any(low == p.lower().replace("{table}", t) for p in rules.surrogate_patterns if p.lower() != "id" for t in squeezed):
        return True
    return low.endswith("id") and any(len(t) > 2 and t in low for t in squeezed)


_RELATION = "submission_id string, answer_fk string, student_fk string, child string, parent string, fk_status string, match_method string, fk_severity string, review_required boolean"
# Severity of each way a relationship was found.
_FOUND = {"exact": "info", "alias": "info", "surrogate": "info", "natural": "info", "wrong_child_columns": "high", "wrong_parent_columns": "high", "wrong_parent": "high", "wrong_child": "high", "implied": "warning", "missing": "high"}
_STATUS = {"exact": "MATCH", "alias": "MATCH_ALIAS_EQUIVALENT", "surrogate": "SURROGATE_ACCEPTED", "natural": "NATURAL_ACCEPTED", "implied": "IMPLIED_REVIEW_REQUIRED"}


def relationships(answer: DataFrame, student: DataFrame, accepted: DataFrame, student_columns: DataFrame, rules: KeyRules | None = None) -> DataFrame:
    """How each expected relationship is met by each submission's declared foreign keys.

    answer: `signatures` with canonical and raw column lists (fk_name, child_table, parent_table, child_columns,
    parent_columns, raw_child_columns, raw_parent_columns, parent_identity). student: the same with submission_id.
    accepted: submission_id, answer_table, student_table. student_columns: submission_id, table_name, column_name,
    column_name_canonical. A foreign key answers one expected relationship, the first in the order of its names that
    takes it: same two tables, an accepted other parent, another parent, another child; columns then decide. The choice
    depends on its order, so it runs per submission; what a submission declares is small.
    """
    rules = rules or KeyRules()
    expected = [r.asDict() for r in answer.orderBy("fk_name").collect()]
    fields = ("fk_name", "child_table", "parent_table", "child_columns", "parent_columns", "raw_child_columns", "raw_parent_columns", "parent_identity")
    keys = student.groupBy("submission_id").agg(F.array_sort(F.collect_list(F.struct(*fields))).alias("fks"))
    tables = accepted.groupBy("submission_id").agg(F.map_from_entries(F.collect_list(F.struct("answer_table", "student_table"))).alias("tables"))
    own = student_columns.join(accepted.withColumnRenamed("student_table", "table_name"), ["submission_id", "table_name"]).groupBy("submission_id").agg(
        F.collect_set(F.struct("answer_table", F.lower("column_name").alias("raw"), F.lower(F.coalesce("column_name_canonical", "column_name")).alias("canonical"))).alias("columns")
    )

    def columns_method(a: dict, s: dict, names: list[str]) -> str:
        if (s["child_columns"], s["parent_columns"]) == (a["child_columns"], a["parent_columns"]):
            raw = lambda r: (r["raw_child_columns"].lower(), r["raw_parent_columns"].lower())
            return "exact" if raw(s) == raw(a) else "alias"
        theirs = _surrogate(s["raw_parent_columns"], names, s["parent_identity"] == 1, rules)
        ours = _surrogate(a["raw_parent_columns"], [a["parent_table"]], a["parent_identity"] == 1, rules)
        if theirs != ours:
            return "surrogate" if theirs else "natural"
        return "wrong_parent_columns" if s["child_columns"] == a["child_columns"] and s["parent_columns"] != a["parent_columns"] else "wrong_child_columns"

    def judge(frames):
        for frame in frames:
            out = []
            for r in frame.to_dict("records"):
                fks = [f if isinstance(f, dict) else f.asDict() for f in (r["fks"] if r["fks"] is not None else [])]
                tables_of = dict(r["tables"]) if r["tables"] is not None else {}
                cols = r["columns"] if r["columns"] is not None else []
                free = {f["fk_name"]: f for f in fks}
                for a in expected:
                    child, parent = a["child_table"], a["parent_table"]
                    take = lambda test: next((f for f in free.values() if test(f)), None)  # noqa: B023, E731
                    found, method = None, "missing"
                    if child in tables_of and parent in tables_of:
                        found = take(lambda f: (f["child_table"], f["parent_table"]) == (child, parent))  # noqa: B023
                        if found:
                            method = columns_method(a, found, [parent, tables_of[parent]])
                        elif found := take(lambda f: f["child_table"] == child and f["parent_table"] in rules.accepted_parents.get(child, ())):  # noqa: B023
                            method = "exact"
                        elif found := take(lambda f: f["child_table"] == child):  # noqa: B023
                            method = "wrong_parent"
                        elif found := take(lambda f: f["parent_table"] == parent):  # noqa: B023
                            method = "wrong_child"
                        else:
                            hints = {a["parent_columns"].lower(), f"{parent}id".lower(), f"{parent}_id".lower(), "id"}
                            if any(c["answer_table"] == child and ({c["raw"], c["canonical"]} & hints) for c in cols):
                                method = "implied"
                    if found:
                        free.pop(found["fk_name"])
                    status = "FK_RELATIONSHIP_" + _STATUS.get(method, method.upper())
                    out.append((r["submission_id"], a["fk_name"], found["fk_name"] if found else None, child, parent, status, method, _FOUND[method], method == "implied"))
            yield pd.DataFrame(out, columns=[c.split(" ")[0] for c in _RELATION.split(", ")])

    groups = accepted.select("submission_id").distinct().join(keys, "submission_id", "left").join(tables, "submission_id", "left").join(own, "submission_id", "left")
    return groups.mapInPandas(judge, _RELATION)


MET = ("FK_RELATIONSHIP_MATCH", "FK_RELATIONSHIP_MATCH_ALIAS_EQUIVALENT", "FK_RELATIONSHIP_SURROGATE_ACCEPTED", "FK_RELATIONSHIP_NATURAL_ACCEPTED")


def primary_keys_adequate(
    answer_keys: DataFrame, student_keys: DataFrame, table_map: DataFrame, column_map: DataFrame, student_columns: DataFrame, unique_keys: DataFrame, relations: DataFrame, rules: KeyRules | None = None
) -> DataFrame:
    """PK_MATCH_EXACT, _ALIAS_EQUIVALENT, _SURROGATE_ACCEPTED, _NATURAL_ACCEPTED, PK_REVIEW_REQUIRED or PK_MISSING per required key.

    answer_keys: table_name_canonical, column_name_canonical, column_name, key_ordinal. student_keys, unique_keys: the same with
    submission_id and table_name (and constraint_name). student_columns: submission_id, table_name, column_name, is_nullable, is_identity.
    """
    rules = rules or KeyRules()
    wanted = ordered_keys(answer_keys, ["table_name_canonical"]).withColumnRenamed("columns", "wanted")
    wanted = wanted.join(ordered_keys(answer_keys, ["table_name_canonical"], "column_name").withColumnRenamed("columns", "wanted_raw"), "table_name_canonical").withColumnRenamed("table_name_canonical", "answer_table")
    own = ordered_keys(student_keys, ["submission_id", "table_name"]).withColumnRenamed("columns", "has")
    own = own.join(ordered_keys(student_keys, ["submission_id", "table_name"], "column_name").withColumnRenamed("columns", "has_raw"), ["submission_id", "table_name"]).withColumnRenamed("table_name", "student_table")
    matched = table_map.where(F.col("match_status").isin(*ACCEPTED_TABLES)).select("submission_id", "answer_table", "student_table")
    every = table_map.select("submission_id").distinct().crossJoin(F.broadcast(wanted)).join(matched, ["submission_id", "answer_table"], "left").join(own, ["submission_id", "student_table"], "left")

    identity = student_columns.where("is_identity = 1").select("submission_id", F.col("table_name").alias("student_table"), F.array(F.lower("column_name")).alias("only")).withColumn("identity", F.lit(True))
    every = every.join(identity.withColumnRenamed("only", "lowered"), (every["submission_id"] == identity["submission_id"]) & (every["student_table"] == identity["student_table"]) & (F.transform("has_raw", lambda c: F.lower(c)) == F.col("lowered")), "left").drop(identity["submission_id"], identity["student_table"])

    # business columns: present and not nullable
    business = column_map.where(F.col("match_status").isin(*ACCEPTED_COLUMNS)).select("submission_id", "answer_table", "student_table", "answer_column", F.col("student_column").alias("column_name"))
    nullable = student_columns.select("submission_id", F.col("table_name").alias("student_table"), "column_name", "is_nullable")
    solid = business.join(nullable, ["submission_id", "student_table", "column_name"]).where("is_nullable = 0").groupBy("submission_id", "answer_table").agg(F.collect_set("answer_column").alias("solid"))
    unique = unique_keys.groupBy("submission_id", "table_name", "constraint_name").agg(F.array_sort(F.collect_set("column_name_canonical")).alias("u")).groupBy("submission_id", F.col("table_name").alias("student_table")).agg(F.collect_set("u").alias("uniques"))
    unmet = relations.where(~F.col("fk_status").isin(*MET)).select("submission_id", F.col("child").alias("answer_table")).distinct().withColumn("unmet", F.lit(True))
    every = every.join(solid, ["submission_id", "answer_table"], "left").join(unique, ["submission_id", "student_table"], "left").join(unmet, ["submission_id", "answer_table"], "left")

    def surrogate(column, *tables):
        name = F.lower(F.trim(column))
        hit = name == "id"
        for t in tables:
            plain, squeezed = F.lower(F.trim(t)), F.regexp_replace(F.lower(t), r"^[^\p{L}]*|[^\p{L}\p{N}]+", "")
            for v in (plain, squeezed):
                for p in rules.surrogate_patterns:
                    if p.lower() != "id":
                        hit = hit | (name == F.replace(F.lit(p.lower()), F.lit("{table}"), v))
                hit = hit | (name.endswith("id") & (F.length(v) > 2) & name.contains(v))
        return F.coalesce(hit, F.lit(False))

    lowered = lambda c: F.transform(c, lambda x: F.lower(x))
    is_surrogate = (F.size("has") == 1) & (F.coalesce("identity", F.lit(False)) | surrogate(F.col("has_raw")[0], F.col("student_table"), F.col("answer_table")))
    expects_surrogate = (F.size("wanted") == 1) & surrogate(F.col("wanted_raw")[0], F.col("answer_table"))
    no_names = F.array().cast("array<string>")
    present = F.size(F.array_except("wanted", F.coalesce("solid", no_names))) == 0
    verified = F.coalesce(F.array_contains("uniques", F.array_sort("wanted")), F.lit(False)) if rules.business_key_unique else F.lit(True)
    status = (
        F.when(F.col("has").isNull(), "PK_MISSING")
        .when(lowered("has_raw") == lowered("wanted_raw"), "PK_MATCH_EXACT")
        .when(F.col("has") == F.col("wanted"), "PK_MATCH_ALIAS_EQUIVALENT")
        .when(is_surrogate, F.when(present & verified & F.col("unmet").isNull(), "PK_SURROGATE_ACCEPTED").otherwise("PK_REVIEW_REQUIRED"))
        .when(expects_surrogate, "PK_NATURAL_ACCEPTED")
        .otherwise("PK_REVIEW_REQUIRED")
    )
    return every.select("submission_id", "answer_table", "student_table", F.concat_ws(";", "wanted").alias("answer_pk_columns"), F.concat_ws(";", "has").alias("student_pk_columns"), status.alias("key_status"))
