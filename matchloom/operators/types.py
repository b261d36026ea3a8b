"""Groups of SQL types and how well a candidate's type fits the reference's."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from matchloom.config import TypeRules
from matchloom.functions.text import column, let

# Types of each group.
GROUPS = {
    "integer": ("tinyint", "smallint", "int", "bigint"),
    "fixed_decimal": ("decimal", "numeric", "money", "smallmoney"),
    "floating": ("real", "float"),
    "text": ("char", "varchar", "nchar", "nvarchar", "text", "ntext"),
    "date_time": ("date", "datetime", "datetime2", "smalldatetime", "time", "datetimeoffset"),
    "boolean": ("bit",),
    "binary": ("binary", "varbinary", "image"),
    "guid": ("uniqueidentifier",),
    "xml_json": ("xml", "json"),
}
# Types that a keyed column may have as text.
KEY_TEXT = ("char", "varchar", "nchar", "nvarchar")
# Parts of a name that make a column an identifier.
KEY_MARKS = ("ma", "id", "code", "key")


def bare_type(c: Column | str) -> Column:
    """Type name alone: lower case, without length and brackets."""
    return F.trim(F.regexp_extract(F.lower(F.coalesce(column(c), F.lit(""))), r"^\s*\[?([^\[\](]*)", 1))


def type_group(c: Column | str) -> Column:
    known = F.create_map(*[F.lit(x) for g, names in GROUPS.items() for t in names for x in (t, g)])
    return F.coalesce(F.try_element_at(known, bare_type(c)), F.lit("unknown"))


def whole_decimal(c: Column | str, scale: Column | None = None) -> Column:
    """Whether a decimal type has no decimals; `scale` wins over the scale in the type's text."""
    written = F.regexp_extract(F.coalesce(column(c), F.lit("")), r"\(\s*\d+\s*,\s*(\d+)\s*\)", 1).try_cast("int")
    known = written if scale is None else F.coalesce(scale.cast("int"), written)
    return bare_type(c).isin("decimal", "numeric") & F.coalesce(known == 0, F.lit(False))


def is_identifier(name: Column | str, in_key: Column | None = None, listed: tuple[str, ...] = ()) -> Column:
    """Whether a column serves as an identifier: part of a key, named like one, or listed."""
    low = F.lower(F.coalesce(column(name), F.lit("")))
    named = reduce(lambda a, b: a | b, (low.contains(m) for m in KEY_MARKS))
    named = named | low.isin(*[x.lower() for x in listed]) if listed else named
    return (low != "") & (named if in_key is None else F.coalesce(in_key, F.lit(False)) | named)


def compare_types(
    answer: Column | str,
    student: Column | str,
    name: Column | str,
    in_key: Column | None = None,
    rules: TypeRules | None = None,
    answer_scale: Column | None = None,
    student_scale: Column | None = None,
) -> Column:
    """Struct (answer_group, student_group, type_status, type_score) of two types of one column."""
    rules = rules or TypeRules()
    identifier = is_identifier(name, in_key, rules.identifiers)
    sides = F.struct(
        bare_type(answer).alias("a"), bare_type(student).alias("s"), type_group(answer).alias("ga"), type_group(student).alias("gs"),
        whole_decimal(answer, answer_scale).alias("wa"), whole_decimal(student, student_scale).alias("ws"), identifier.alias("key"),
    )

    def key_kind(bare: Column, group: Column, whole: Column) -> Column:
        return F.when(group == "integer", "integer").when(bare.isin(*KEY_TEXT), "text").when(whole, "whole")

    def judge(t: Column) -> Column:
        pair = lambda x, y: F.array_sort(F.array(t["ga"], t["gs"])) == F.array(*map(F.lit, sorted((x, y))))
        status = F.when(t["a"] == t["s"], "TYPE_MATCH_EXACT")
        if rules.mode != "exact":
            status = status.when((t["ga"] == t["gs"]) & (t["ga"] != "unknown"), "TYPE_MATCH_GROUP")
            if rules.identifier_integer_text:
                fit = key_kind(t["a"], t["ga"], t["wa"]) != key_kind(t["s"], t["gs"], t["ws"])
                status = status.when(t["key"] & F.coalesce(fit, F.lit(False)), "TYPE_IDENTIFIER_COMPATIBLE_WARNING")
            for allowed, x, y in ((rules.decimal_float, "fixed_decimal", "floating"), (rules.integer_decimal, "integer", "fixed_decimal"), (rules.bit_integer, "boolean", "integer")):
                if allowed:
                    status = status.when(pair(x, y), "TYPE_COMPATIBLE_WARNING")
        return F.struct(t["ga"].alias("answer_group"), t["gs"].alias("student_group"), status.otherwise("TYPE_MISMATCH").alias("type_status"))

    def with_score(t: Column) -> Column:
        score = F.when(t["type_status"].startswith("TYPE_MATCH"), 1.0).when(t["type_status"] == "TYPE_MISMATCH", 0.0).otherwise(rules.warning_score)
        return F.struct(t["answer_group"].alias("answer_group"), t["student_group"].alias("student_group"), t["type_status"].alias("type_status"), score.alias("type_score"))

    return let(let(sides, judge), with_score)
