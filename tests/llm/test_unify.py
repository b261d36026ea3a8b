import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.llm import unify as U

CASES = {
    "Ｃửａ ｈàｎｇ": "Cửa hàng",
    "Cơ sở Nó⁣n HВТ": "Cơ sở Nón HBT",
    "Тrạm Vĩnh͏ Khê": "Trạm Vĩnh Khê",
    "Kho K9": "Kho K9",
    "Hồng Ⅱ": "Hồng II",
    "ﬁeldplot": "fieldplot",
    "24‑7": "24-7",
    "Ðông Ɖồi": "Đông Đồi",
    "‍Quán﻿": "Quán",
    "ệ": "ệ",
    "ệ": "ệ",
    "Khο Τrầm": "Kho Trầm",
    "а́n bánh": "án bánh",
}
KEPT = ["Дом Ткани 5", "Αποθήκη Λευκή", "ナミ商店 2", "みどり文具", "Kho 20 m²", "Tiệm 3½", "Trạm № 7", "Lá™", "Ørn Handel", "Straße Nord", "Łąka Shop", "Café Brûlé", "表一", "Shop Восток", "Þórð Ðal", "a", "", "👩‍👩‍👧 Shop", "نمی‌خواهم"]


@pytest.mark.parametrize("given_, expected", CASES.items())
def test_rewritten(given_, expected):
    assert U.unify_text(given_) == unicodedata.normalize("NFC", expected)


@pytest.mark.parametrize("text", KEPT)
def test_kept(text):
    assert U.unify_text(text) == text


@given(st.text(max_size=30))
def test_stable(text):
    once = U.unify_text(text)
    assert unicodedata.is_normalized("NFC", once)
    assert U.unify_text(once) == once


def test_mappings_do_not_conflict():
    for script in (None, *U.SCRIPTS):
        rules = U.transducer(script).fold
        assert all(c not in rules for target in rules.values() for c in target)
    with pytest.raises(U.Conflict):
        U.check({"a": "b", "b": "c"})
    with pytest.raises(U.Conflict):
        U._add({"a": "b"}, "a", "c")


def test_every_plain_text_is_stable():
    letters = [chr(c) for c in range(0x20, 0x1F00)]
    import re

    plain = [c for c in letters if re.match(U.PLAIN, c)]
    assert len(plain) > 300
    assert [c for c in plain if U.unify_text(c) != c] == []


def write(spark, path, names, tables):
    spark.createDataFrame(names, "row_id bigint, tenkh string").withColumns({"value": F.lit("x"), "field_name": F.lit("y")}).write.parquet(f"{path}/khachhang.parquet")
    spark.createDataFrame(tables, "map_id bigint, normalized_student_table string").withColumn("unified", F.lit("z")).write.parquet(f"{path}/table_mapping_report.parquet")


def test_queries(spark, tmp_path):
    long = "Kho " * 20000 + "В"
    write(spark, tmp_path, [(1, "Kho"), (2, "Khо"), (2, "Khо"), (3, None), (4, ""), (5, long)], [(7, "khachhang"), (8, "khаchhang"), (9, None)])
    found = sorted(map(tuple, U.odd_values(spark, str(tmp_path)).collect()))
    assert found == [("khachhang.tenkh", 2), ("khachhang.tenkh", 2), ("khachhang.tenkh", 5), ("table_mapping_report.normalized_student_table", 8)]
    rows = {(r["field_name"], r["row_id"]): r["unified"] for r in U.unified_values(spark, str(tmp_path)).collect()}
    assert rows["khachhang.tenkh", 2] == "Kho" and rows["khachhang.tenkh", 3] is None and rows["khachhang.tenkh", 4] == ""
    assert rows["khachhang.tenkh", 5] == long[:-1] + "B"
    assert {tuple(r) for r in U.equal_looking(spark, str(tmp_path)).collect()} == {("khachhang.tenkh", "Kho", 2, 3), ("table_mapping_report.normalized_student_table", "khachhang", 2, 2)}


def test_empty(spark, tmp_path):
    write(spark, tmp_path, [], [])
    assert U.odd_values(spark, str(tmp_path)).count() == 0
    assert U.unified_values(spark, str(tmp_path)).count() == 0


def test_line_separators_fillers_and_controls(spark):
    given_ = {"Kho\u2028": "Kho ", "Kho\u2029": "Kho ", "Kho\x85": "Kho ", "Kho\u3164": "Kho", "K\u3164ho": "Kho", "Kho\uffa0": "Kho", "K\x00ho\x7f\x9f": "Kho", "Kho\t1\n": "Kho 1 ", "Kho\tКо": "Kho Ko", "Kho 1": "Kho 1"}
    assert {t: U.unify_text(t) for t in given_} == given_ and all(U.unify_text(t) == t for t in given_.values())
    rows = spark.createDataFrame([(t,) for t in given_], "value string")
    assert {r["value"]: r["unified"] for r in rows.select("value", U.unified(F.col("value")).alias("unified")).collect()} == given_
    assert {r["value"] for r in rows.where(~F.col("value").rlike(U.PLAIN)).collect()} == {t for t in given_ if t != "Kho 1"}
