import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from matchloom.llm import canon as K

ENTRIES = [  # kind, entry_id, canonical_name, label_vi, label_en, known_aliases
    ("column", 1, "MaBanAn", "Mã bàn ăn", "dining table id", None),
    ("column", 2, "NgaySinh", "Ngày sinh", "birth date", "dob;ngay thang nam sinh"),
    ("column", 3, "TinhTrang", "Tình trạng", "status flag", "state"),
    ("column", 4, "HoTen", "Họ tên", "full name", None),
    ("column", 5, "DeVo", "Dễ vỡ", "fragile flag", None),
    ("column", 6, "KhoiLuong", "Khối lượng", "parcel weight", None),
    ("table", 7, "SinhVien", "Sinh viên", "pupil", "learner"),
    ("table", 8, "PhieuGoiMon", "Phiếu gọi món", "meal ticket", None),
]
COLUMNS = [e[1:] for e in ENTRIES if e[0] == "column"]
OTHERS = [e[1:] for e in ENTRIES if e[0] == "table"]


@pytest.fixture(scope="module")
def matcher():
    return K.Matcher(COLUMNS, OTHERS)


def best(matcher, value):
    found = matcher.candidates(value)
    return min(found, key=lambda e: (found[e], e)) if found else None


@pytest.mark.parametrize(
    "value, entry",
    [
        ("MaBanAn", 1), ("ma_ban_an", 1), ("Mã bàn ăn", 1), ("MaxBafnAwn", 1), ("04. Mã bàn ăn", 1), ("  Mã bàn ăn (bắt buộc)", 1), ("[Mã bàn ăn]", 1), ("MaBanA", 1), ("mabannan", 1), ("DiningTableId", 1),
        ("dob", 2), ("NgaySinh_SinhVien", 2), ("Ngafy sinh", 2), ("SinhNgay", 2), ("chắc là NgaySih !", 2), ("map to birth_date?", 2), ("brth_date", 2), ("NgaySinh_2", 2),
        ("stts_flag", 3), ("TinhTr", 3), ("-> TINH_TRANG (?)", 3), ("TenHo", 4), ("DeVoo", 5), ("prcl_wght", 6), ("KohLiuong", 6),
        ("không rõ", None), ("skip", None), ("Màu vỏ hộp", None), ("SoThich", None), ("???", None), ("cot4", None), ("", None), ("x" * 5000, None),
    ],
)
def test_values(matcher, value, entry):
    assert best(matcher, value) == entry


def osa(a, b):
    """Plain Damerau-Levenshtein (swaps of neighbours), the slow way."""
    d = {(i, j): i + j for i in range(len(a) + 1) for j in range(len(b) + 1) if i * j == 0}
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            d[i, j] = min(d[i - 1, j] + 1, d[i, j - 1] + 1, d[i - 1, j - 1] + (a[i - 1] != b[j - 1]))
            if i > 1 and j > 1 and a[i - 1] == b[j - 2] and a[i - 2] == b[j - 1]:
                d[i, j] = min(d[i, j], d[i - 2, j - 2] + 1)
    return d[len(a), len(b)]


@given(st.text("abqws", max_size=7), st.text("abqws", max_size=7))
def test_weighted_distance(a, b):
    got = K.weighted_distance(a, b, 99)
    assert got <= osa(a, b) + 1e-9 and got >= 0.6 * osa(a, b) - 1e-9
    assert (got == 0) == (a == b) and abs(got - K.weighted_distance(b, a, 99)) < 1e-9


def typed_wrong(rng, form):
    """A form with up to three edits of all kinds, doubled letters among them."""
    key = list(form)
    for _ in range(rng.randrange(4)):
        p = rng.randrange(len(key))
        kind = rng.randrange(6)
        if kind == 0:
            key[p] = rng.choice("abcxyz")
        elif kind == 1 and len(key) > 2:
            del key[p]
        elif kind == 2:
            key.insert(p, rng.choice("abcxyz"))
        elif kind == 3 and p + 1 < len(key):
            key[p], key[p + 1] = key[p + 1], key[p]
        else:
            key.insert(p, key[p])
    return "".join(key)


def brute_force(d, key):
    found = {}
    for form, own in d.forms.items():
        distance = K.weighted_distance(key, form, 99)
        for entry, penalty, edits in own:
            if distance <= min(K.allowed(min(len(form), len(key) + 1)), edits) + 1e-9:
                found[entry] = min(found.get(entry, 9.0), distance + penalty)
    return found


DICTIONARY = K.Dictionary([*COLUMNS, (9, "SoLuongHangHoa", "Số lượng hàng hóa", "quantity of the goods", "doob;ddb;aabb")])


@settings(max_examples=150, deadline=None)
@given(st.integers(0, 10**6))
def test_lookup_equals_brute_force(seed):
    rng = random.Random(seed)
    key = typed_wrong(rng, rng.choice(sorted(DICTIONARY.forms)))
    assert DICTIONARY.near(key) == pytest.approx(brute_force(DICTIONARY, key))


@pytest.mark.parametrize("key", ["ssolluongghanghoa", "soluuonghhanghoaa", "sooluonnghannghoa", "db", "dob", "abb", "ab"])
def test_doubled_letters(key):
    assert DICTIONARY.near(key) == pytest.approx(brute_force(DICTIONARY, key)) and 9 in DICTIONARY.near(key)


def test_long_names():
    """Long forms are compared one by one, and the number of forms grows with a label's words, not with their combinations."""
    words = " ".join(f"wordnumber{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(40))
    assert len(K.forms([], [], [words])) < 1000
    d = K.Dictionary([(1, None, None, words, None)])
    assert 1 in d.near(words.replace(" ", "").replace("ab", "xb", 1)) and d.near("x" * 5000) == {}


def frames(spark, typed, used=()):
    t = spark.createDataFrame(typed, "field_name string, map_id bigint, context string, value string")
    e = spark.createDataFrame(ENTRIES, "kind string, entry_id bigint, canonical_name string, label_vi string, label_en string, known_aliases string").withColumns({"value": F.lit("clash"), "cost": F.lit("x")})
    return t, e, spark.createDataFrame(list(used), "context string, name string, n bigint")


def test_map_values(spark):
    typed = [("f", 1, "A", "MaBanAn"), ("f", 1, "A", "MaBanAn"), ("f", 2, None, "dob"), ("f", 3, "B", "skip")]
    out = K.map_values(*frames(spark, typed), "column", "table").collect()
    assert sorted((r["map_id"], r["entry_id"] or 0) for r in out) == [(1, 1), (1, 1), (2, 2), (3, 0)]
    assert K.map_values(*frames(spark, []), "column", "table").count() == 0


def test_context_decides(spark):
    two = [("column", 10, "NgayGat", "Ngày gặt", None, None), ("column", 11, "NgayGiao", "Ngày giao", None, None)]
    t = spark.createDataFrame([("f", 1, "X", "NgayG"), ("f", 2, "Y", "NgayG")], "field_name string, map_id bigint, context string, value string")
    e = spark.createDataFrame(two, "kind string, entry_id bigint, canonical_name string, label_vi string, label_en string, known_aliases string")
    u = spark.createDataFrame([("X", "NgayGat", 3), ("Y", "NgayGiao", 3)], "context string, name string, n bigint")
    assert {r["map_id"]: r["entry_id"] for r in K.map_values(t, e, u, "column", "table").collect()} == {1: 10, 2: 11}


def test_blocks(spark, monkeypatch):
    typed = [("f", i, "A", v) for i, v in enumerate(["MaBanAn", "dob", "NgaySinh_SinhVien", "state", "skip"])]
    whole = sorted(map(str, K.map_values(*frames(spark, typed), "column", "table").collect()))
    monkeypatch.setattr(K, "BLOCK_ENTRIES", 1)
    assert sorted(map(str, K.map_values(*frames(spark, typed), "column", "table").collect())) == whole


def test_fields(spark, tmp_path):
    columns = [(1, "A", "mabanan", None, None), (2, "A", "mabanan", "", None), (3, "A", "mabanan", "MaBanAn", "xem dob?"), (4, "A", None, None, ""), (5, "A", "skip", None, None)]
    spark.createDataFrame(columns, "map_id bigint, assignment_code string, raw_student_column string, answer_column string, suggested_alias_entry string").write.parquet(f"{tmp_path}/column_mapping_report.parquet")
    spark.createDataFrame([(6, "A", "Learner", None), (7, "A", None, "SinhVien")], "map_id bigint, assignment_code string, raw_student_table string, answer_table string").write.parquet(f"{tmp_path}/table_mapping_report.parquet")
    spark.createDataFrame(ENTRIES, "kind string, entry_id bigint, canonical_name string, label_vi string, label_en string, known_aliases string").write.parquet(f"{tmp_path}/canonical_names.parquet")
    found = sorted(map(tuple, K.named_entries(spark, str(tmp_path)).collect()))
    assert found == [("raw_student_column", 1, 1), ("raw_student_column", 2, 1), ("raw_student_table", 6, 7), ("suggested_alias_entry", 3, 2)]
    assert [tuple(r) for r in K.unmatched_values(spark, str(tmp_path)).collect()] == [("raw_student_column", "skip", 1)]
