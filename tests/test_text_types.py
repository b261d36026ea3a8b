import unicodedata

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.config import TypeRules, from_mapping
from matchloom.functions import text as T
from matchloom.operators import canonical as C
from matchloom.operators import types as Y
from matchloom.operators.compare import plain_key


def column(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")


def apply(spark, values, f, kind="string"):
    return [r[0] for r in column(spark, values, kind).orderBy("i").select(f(F.col("v"))).collect()]


def test_accents_and_keys(spark):
    names = ["Nhân Viên", "Khách Hàng", "Đại Lý", unicodedata.normalize("NFD", "Hàng Hóa"), None, ""]
    assert apply(spark, names, T.remove_accents) == ["Nhan Vien", "Khach Hang", "Dai Ly", "Hang Hoa", None, ""]
    keys = ["Hàng Hóa", "01. HTK", "06_Chi Tiết", "Câu 3. Trả", "Câu trả", "a-b_c d!", None, "  "]
    assert apply(spark, keys, T.normalize_key) == ["hanghoa", "htk", "chitiet", "tra", "tra", "abcd", "", ""]
    assert apply(spark, ["01. HTK", "Câu 2 - Bán", "Cau"], T.clean_name) == ["htk", "ban", "cau"]
    assert [plain_key(k) for k in keys] == apply(spark, keys, T.normalize_key)


def test_abbreviations(spark):
    rules = {"NCC": "nhacungcap", "KH": "khachhang"}
    got = apply(spark, ["ct_mua", "ct", "cthd", "ncc", "ds_ncc", "makh"], lambda c: T.expand_abbreviations(c, rules))
    assert got == ["chitietmua", "chitiet", "chitiethd", "nhacungcap", "dsnhacungcap", "makhachhang"]


def test_abbreviations_inside_names(spark):
    rules = {"HD": "hoadon", "KH": "khachhang"}
    got = apply(spark, ["hd_kh", "a hd b", "a_hd_b", "hdkh", "kh", "akhb"], lambda c: T.expand_abbreviations(c, rules))
    assert got == ["hoadonkhachhang", "ahoadonb", "ahdb", "hoadonkhachhang", "khachhang", "akhb"]


def test_bare_types(spark):
    assert apply(spark, ["NVARCHAR(50)", " [Decimal] (10, 2) ", "int", None, "[datetime]"], Y.bare_type) == ["nvarchar", "decimal", "int", "", "datetime"]


def test_roles(spark):
    assert apply(spark, ["MaNV", "TenNV", "NgayLap", "SoLuong", "DonGia", "TongTien", "xyz", None], T.column_role) == ["ma", "ten", "ngay", "soluong", "dongia", "tongtien", None, None]


def lcs(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for j, y in enumerate(b):
            new.append(row[j] + 1 if x == y else max(row[j + 1], new[-1]))
        row = new
    return row[-1]


@given(st.text("abcđ", max_size=12), st.text("abcđ", max_size=12))
def test_common_subsequence(a, b):
    assert T._lcs(a, b) == lcs(a, b)


def test_similarity(spark):
    pairs = [("customers", "customer"), ("invoices", "invoice"), ("makh", "mahang"), ("", ""), ("a", ""), (None, "a")]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string")
    got = [r[0] for r in df.orderBy("i").select(F.round(T.indel_similarity("a", "b"), 4)).collect()]
    assert got == [94.1176, 93.3333, 60.0, 100.0, 0.0, None]


def test_small_functions(spark):
    assert apply(spark, [" a ; b;;c ", None, ""], T.split_identifiers) == [["a", "b", "c"], [], []]
    assert apply(spark, ["", "NULL", "null", " x ", None], T.parse_value) == [None, None, None, "x", None]
    assert apply(spark, ["3", "x", None, "2.7"], T.safe_int) == [3, 0, 0, 2]
    assert apply(spark, ["3.5", "x", None], T.safe_double) == [3.5, 0.0, 0.0]
    assert apply(spark, ["QLBH_20123456_An", "bài làm", "", "!!"], T.submission_id)[0] == "20123456"
    assert apply(spark, ["", "!!"], T.submission_id) == ["unknown", "unknown"]
    assert apply(spark, [None, " \t", "A  b", "a B "], T.fingerprint) == ["", "", *[apply(spark, ["a b"], T.fingerprint)[0]] * 2]
    assert apply(spark, ["grade_1", "1a", "a b", "a;b", None], T.is_safe_name) == [True, False, False, False, False]


def test_canonical_values(spark):
    assert [C.decimals(t) for t in (0.01, 0.001, 0.1, 1.0, 0)] == [2, 3, 1, 0, 0]
    assert apply(spark, [100.123, 100.12, 100.126, float("nan"), None, -0.001, 0.125, 0.135], C.number, "double") == [100.12, 100.12, 100.13, None, None, 0.0, 0.12, 0.14]
    assert apply(spark, [100.125, 0.285], C.number_half_up, "double") == [100.13, 0.29]
    assert apply(spark, ["2023-5-10", "2023-05-10", "2024-01-07 00:00:00", "2024-1-7T00:00", "2024-01-07 15:30:00", " 01/02/2024 ", None], C.date) == ["2023-05-10", "2023-05-10", "2024-01-07", "2024-01-07", "2024-01-07 15:30:00", "01/02/2024", None]
    got = apply(spark, ["  Hà   Nội  ", unicodedata.normalize("NFD", "Hà Nội"), " X\n", None, "", "y" * 40000], C.text)
    assert got[:5] == ["hà nội", "hà nội", "x", None, ""] and len(got[5]) == 40000


def test_date_column(spark):
    mixed = column(spark, ["2026-06-20 15:30:00", "2026-06-19 00:00:00"])
    assert [r[0] for r in mixed.orderBy("i").select(C.date_column(mixed, "v")).collect()] == ["2026-06-20 15:30:00", "2026-06-19 00:00:00"]
    days = column(spark, ["2026-06-20 00:00:00"])
    assert days.select(C.date_column(days, "v")).first()[0] == "2026-06-20"
    with_null = column(spark, ["2026-06-20 00:00:00", None])
    assert with_null.orderBy("i").select(C.date_column(with_null, "v")).first()[0] == "2026-06-20 00:00:00"


def test_align(spark):
    df = spark.createDataFrame([(" A ", "1.239", 5)], "ten string, gia string, extra int")
    out = C.align(df, [("TenHang", "text"), ("DonGia", "number"), ("extra2", "text")], {"ten": "TenHang", "gia": "DonGia"})
    assert out.columns == ["TenHang", "DonGia", "extra2"] and tuple(out.first()) == ("a", 1.24, None)
    assert C.align(df.limit(0), [("TenHang", "text")], {"ten": "TenHang"}).columns == ["TenHang"]
    clash = C.align(df.withColumnRenamed("extra", "TenHang"), [("TenHang", "text")], {"ten": "TenHang"})
    assert tuple(clash.first()) == ("a",)


@pytest.mark.parametrize(
    "answer, student, name, expected",
    [
        ("int", "char", "MaNhanVien", "TYPE_IDENTIFIER_COMPATIBLE_WARNING"), ("int", "varchar(50)", "MaNhaCungCap", "TYPE_IDENTIFIER_COMPATIBLE_WARNING"), ("decimal(18,2)", "char(10)", "DonGia", "TYPE_MISMATCH"),
        ("datetime", "char(10)", "NgayMuaHang", "TYPE_MISMATCH"), ("decimal(18,2)", "money", "DonGia", "TYPE_MATCH_GROUP"), ("[nvarchar](20)", "NVARCHAR(50)", "x", "TYPE_MATCH_EXACT"), ("decimal(5,0)", "int", "MaX", "TYPE_IDENTIFIER_COMPATIBLE_WARNING"),
        ("int", "decimal(5,2)", "SoLuong", "TYPE_COMPATIBLE_WARNING"), ("float", "decimal(5,2)", "x", "TYPE_COMPATIBLE_WARNING"), ("bit", "int", "x", "TYPE_MISMATCH"), ("geography", "geometry", "x", "TYPE_MISMATCH"), (None, None, "x", "TYPE_MATCH_EXACT"), ("int", "text", "MaX", "TYPE_MISMATCH"),
    ],
)
def test_types(spark, answer, student, name, expected):
    df = spark.createDataFrame([(answer, student, name)], "a string, s string, n string")
    r = df.select(Y.compare_types("a", "s", "n").alias("t")).first()["t"]
    assert r["type_status"] == expected
    assert r["type_score"] == (1.0 if expected.startswith("TYPE_MATCH") else 0.0 if expected == "TYPE_MISMATCH" else 0.75)


def test_type_rules(spark):
    df = spark.createDataFrame([("bit", "int", "x"), ("int", "bigint", "x"), ("float", "decimal(5,2)", "x")], "a string, s string, n string")
    get = lambda rules, key=None: [r[0] for r in df.select(Y.compare_types("a", "s", "n", key, rules)["type_status"]).collect()]
    assert get(TypeRules(bit_integer=True))[0] == "TYPE_COMPATIBLE_WARNING"
    assert get(TypeRules(mode="exact")) == ["TYPE_MISMATCH"] * 3
    assert get(TypeRules(decimal_float=False))[2] == "TYPE_MISMATCH"


def test_config():
    rules = from_mapping({"names": {"tables": {"A": ["b"]}, "excluded_tables": ["x"]}, "views": [{"name": "v", "columns": [{"canonical": "K", "type": "text", "aliases": ["kk"]}]}]})
    assert rules.names.tables == {"A": ["b"]} and rules.views[0].columns == [("K", "text", ("kk",))]
    with pytest.warns(UserWarning):
        from_mapping({"names": {"matching_threshold": 1}})
    with pytest.raises(ValueError):
        from_mapping({"names": {"no_such": 1}})
