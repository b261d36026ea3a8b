import pytest
from pyspark.sql import functions as F

from matchloom.config import KeyRules, NameRules, Rules
from matchloom.operators import keys as K
from matchloom.operators import names as N
from matchloom.operators import structure as S
from matchloom.sources.snapshot import SCHEMAS

RULES = Rules(
    names=NameRules(
        tables={"KhachHang": ["Customer", "KH", "DMKhachHang"], "HoaDon": ["Invoice", "Bill"], "NhaCungCap": ["Supplier"], "ChiTietTraTien": ["CTCT", "chi tra"]},
        columns_global={"MaKH": ["CustomerID"], "TenKH": ["CustomerName"]},
        columns_by_table={"NhaCungCap": {"MaNCC": ["ma"]}, "KhachHang": {"MaKH": ["ma", "PMH", "SoHD"]}},
        abbreviations={"ncc": "nhacungcap"},
    )
)


def part(spark, name, rows):
    """Rows of a snapshot part given as dicts; what is left out is null."""
    schema = SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def tables(spark, *names, sub="s1"):
    return part(spark, "tables", [{"submission_id": sub, "table_name": n, "row_count": 1} for n in names])


def mapped(df, key="student_table", value="match_status"):
    return {r[key]: r[value] for r in df.collect()}


def test_table_names(spark):
    given = ["khachhang", "KH", "Invoice", "KhachHangs", "NonExistentTable", "NCC", "ABC", "NhaCungCaps", "CTCT", "01. Hóa Đơn", "Customer"]
    df = spark.createDataFrame([("s", n) for n in given], "submission_id string, table_name string")
    rows = {r["table_name"]: r for r in N.map_tables(df, RULES.names).collect()}
    status = {n: rows[n]["match_status"].replace("TABLE_", "") for n in given}
    assert status == {"khachhang": "MATCHED_EXACT", "KH": "MATCHED_ALIAS", "Invoice": "MATCHED_ALIAS", "KhachHangs": "MATCHED_FUZZY_HIGH", "NonExistentTable": "UNMAPPED", "NCC": "MATCHED_ABBREVIATION", "ABC": "UNMAPPED", "NhaCungCaps": "MATCHED_FUZZY_HIGH", "CTCT": "MATCHED_WEAK_ALIAS", "01. Hóa Đơn": "MATCHED_EXACT", "Customer": "MATCHED_ALIAS"}
    assert rows["KH"]["answer_table"] == "KhachHang" and rows["ABC"]["answer_table"] is None
    assert rows["CTCT"]["review_required"] and not rows["KH"]["review_required"]


def test_ambiguous_alias(spark):
    rules = NameRules(tables={"A": ["XYZ1"], "B": ["XYZ1"]})
    df = spark.createDataFrame([("s", "XYZ1")], "submission_id string, table_name string")
    r = N.map_tables(df, rules).first()
    assert r["match_status"] == "TABLE_AMBIGUOUS" and r["candidate_tables"] == "A;B"


def test_table_mapping(spark):
    answer = tables(spark, "KhachHang", "HoaDon", sub=None).drop("submission_id")
    full = tables(spark, "KH", "Bill", "Zebra", "sysdiagrams")
    rows = mapped(S.table_mapping(answer, full, RULES))
    assert rows == {"KH": "TABLE_MATCHED_ALIAS", "Bill": "TABLE_MATCHED_ALIAS", "Zebra": "TABLE_EXTRA_STUDENT"}
    rivals = S.table_mapping(answer, tables(spark, "KH", "Customer", "Zebra"), RULES)
    assert mapped(rivals) == {"KH": "TABLE_AMBIGUOUS", "Customer": "TABLE_AMBIGUOUS", "Zebra": "TABLE_UNMAPPED", None: "TABLE_MISSING_ANSWER"}
    assert rivals.where("match_status = 'TABLE_MISSING_ANSWER'").count() == 2
    assert S.table_mapping(answer, tables(spark).limit(0), RULES).count() == 0


def columns(spark, table_name, specs, sub="s1", canonical=None):
    return part(spark, "columns", [{"submission_id": sub, "table_name": table_name, "table_name_canonical": canonical or table_name, "column_name": c, "data_type": t} for c, t in specs])


def test_column_mapping(spark):
    answer = columns(spark, "KhachHang", [("MaKH", "int"), ("TenKH", "nvarchar"), ("NgaySinh", "date")])
    table_map = spark.createDataFrame([("s1", "KhachHang", "KH", "TABLE_MATCHED_ALIAS"), ("s2", "KhachHang", "weak", "TABLE_MATCHED_WEAK_ALIAS")], "submission_id string, answer_table string, student_table string, match_status string")
    student = columns(spark, "KH", [("PMH", "char"), ("SoHD", "int"), ("CustomerName", "nvarchar"), ("NgaySinhh", "varchar"), ("Zzz", "int")]).unionByName(columns(spark, "weak", [("MaKH", "int"), ("TenKH", "varchar"), ("NgaySinh", "date"), ("More", "int")], "s2"))
    rows = {(r["submission_id"], r["student_column"]): r for r in S.column_mapping(table_map, answer, student, RULES).collect()}
    status = {k: r["match_status"] for k, r in rows.items()}
    assert status["s1", "CustomerName"] == "COLUMN_MATCHED_ALIAS"
    assert {status["s1", "PMH"], status["s1", "SoHD"]} == {"COLUMN_MATCHED_ALIAS", "DUPLICATE_MAPPING_REVIEW"}
    assert status["s1", "PMH"] == "COLUMN_MATCHED_ALIAS" and rows["s1", "PMH"]["type_status"] == "TYPE_IDENTIFIER_COMPATIBLE_WARNING"
    assert status["s1", "NgaySinhh"] == "COLUMN_TYPE_MISMATCH"
    assert status["s1", "Zzz"] == "COLUMN_UNMAPPED" and status["s1", None] == "COLUMN_MISSING_ANSWER"
    assert status["s2", "MaKH"] == "COLUMN_MATCHED_WEAK_ALIAS" and status["s2", "More"] == "COLUMN_EXTRA_STUDENT"


def test_scoped_aliases(spark):
    expected = spark.createDataFrame([("NhaCungCap", "MaNCC"), ("KhachHang", "MaKH")], "answer_table string, column_name string")
    cols = spark.createDataFrame([("s", "NhaCungCap", "a", "ma"), ("s", "KhachHang", "b", "ma")], "submission_id string, answer_table string, student_table string, column_name string")
    assert {r["answer_table"]: r["answer_column"] for r in N.map_columns(cols, expected, RULES.names).collect()} == {"NhaCungCap": "MaNCC", "KhachHang": "MaKH"}


def test_role_guard(spark):
    expected = spark.createDataFrame([("T", "MaHang")], "answer_table string, column_name string")
    rules = NameRules(columns_global={"MaHang": ["TenHangHoa"]})
    cols = spark.createDataFrame([("s", "T", "t", "TenHangHoa")], "submission_id string, answer_table string, student_table string, column_name string")
    r = N.map_columns(cols, expected, rules).first()
    assert r["match_status"] == "COLUMN_INCOMPATIBLE_ROLE" and r["answer_column"] == "MaHang" and r["review_required"]


def test_row_counts_and_views(spark):
    table_map = spark.createDataFrame([("s1", "A", "a", "TABLE_MATCHED_EXACT")], "submission_id string, answer_table string, student_table string, match_status string")
    answer = part(spark, "tables", [{"table_name": "A", "row_count": 5}])
    student = part(spark, "tables", [{"submission_id": "s1", "table_name": "a", "row_count": 7}])
    assert [r["difference"] for r in S.row_counts(table_map, answer, student).collect()] == [2]
    views = lambda *rows: part(spark, "views", [{"submission_id": s, "view_name": v, "view_name_canonical": v, "execution_status": e} for s, v, e in rows])
    cols = lambda *rows: part(spark, "view_columns", [{"submission_id": s, "view_name_canonical": v, "column_name_canonical": c} for s, v, c in rows])
    got = S.view_structure(views((None, "v1", "OK"), (None, "v2", "OK"), (None, "v3", "OK"), (None, "v4", "OK")), views(("s1", "v1", "OK"), ("s1", "v2", "ERROR"), ("s1", "v3", "OK"), ("s1", "x", "OK")), cols((None, "v1", "a"), (None, "v3", "a")), cols(("s1", "v1", "a"), ("s1", "v3", "b")))
    assert {r["view_name_canonical"]: r["status"] for r in got.collect()} == {"v1": "PASS", "v2": "EXECUTION_ERROR", "v3": "SCHEMA_MISMATCH", "v4": "MISSING", "x": "EXTRA"}


def test_report(spark):
    table_map = spark.createDataFrame([("s", "A", "a", "TABLE_MATCHED_EXACT", False), ("s", "B", None, "TABLE_MISSING_ANSWER", True)], "submission_id string, answer_table string, student_table string, match_status string, review_required boolean")
    column_map = spark.createDataFrame([("s", "A", "a", "c", "d", "COLUMN_TYPE_MISMATCH", True)], "submission_id string, answer_table string, student_table string, answer_column string, student_column string, match_status string, review_required boolean")
    got = {(r["component"], r["answer_object"]): r["severity"] for r in S.structure_report(table_map, column_map).collect()}
    assert got == {("TABLE", "A"): "info", ("TABLE", "B"): "high", ("COLUMN", "A.c"): "high"}


def test_exact_keys(spark):
    pk = lambda sub, t, *cols: [{"submission_id": sub, "table_name_canonical": t, "column_name_canonical": c, "key_ordinal": i} for i, c in enumerate(cols)]
    answer = part(spark, "primary_keys", pk(None, "A", "x", "y") + pk(None, "B", "x") + pk(None, "C", "x"))
    student = part(spark, "primary_keys", pk("s", "A", "y", "x") + pk("s", "B", "x"))
    accepted = spark.createDataFrame([("s", t) for t in "ABC"], "submission_id string, answer_table string")
    assert {r["answer_table"]: r["status"] for r in K.primary_keys_exact(answer, student, accepted).collect()} == {"A": "PK_MISMATCH", "B": "PASS", "C": "MISSING"}
    fk = lambda sub, c, p, rule="NO_ACTION": {"submission_id": sub, "parent_table_canonical": c, "parent_column_canonical": "x", "referenced_table_canonical": p, "referenced_column_canonical": "x", "delete_rule": rule, "update_rule": "NO_ACTION"}
    a = part(spark, "foreign_keys", [fk(None, "A", "B"), fk(None, "A", "C"), fk(None, "B", "C"), fk(None, "A", "Z")])
    s = part(spark, "foreign_keys", [fk("s", "A", "B"), fk("s", "A", "C", "CASCADE"), fk("s", "C", "B")])
    assert {r["object"]: r["status"] for r in K.foreign_keys_exact(a, s, accepted).collect()} == {"FK: A.x -> B.x": "PASS", "FK: A.x -> C.x": "RULE_MISMATCH", "FK: B.x -> C.x": "MISSING", "FK: C.x -> B.x": "EXTRA"}


def test_signatures(spark):
    rows = [("s", "f", "A", "B", "c2", "p2", 2), ("s", "f", "A", "B", "c1", "p1", 1), ("s", "g", "A", "B", "z", "p", None), ("s", "g", "A", "B", "a", "q", 1)]
    df = spark.createDataFrame(rows, "submission_id string, fk_name string, child_table string, parent_table string, child_column string, parent_column string, ordinal int")
    got = {r["fk_name"]: (r["signature"], r["order_unknown"]) for r in K.signatures(df, ["submission_id"]).collect()}
    assert got == {"f": ("A|B|c1,c2|p1,p2", False), "g": ("A|B|a,z|q,p", True)}


FKS = "fk_name string, child_table string, parent_table string, child_columns string, parent_columns string, raw_child_columns string, raw_parent_columns string, parent_identity int"


@pytest.mark.parametrize(
    "theirs, columns_, expected",
    [
        ([("x", "CT", "Hang", "MaHang", "MaHang", "MaHang", "MaHang", 0)], [], "FK_RELATIONSHIP_MATCH"),
        ([("auto_1", "CT", "Hang", "MaHang", "MaHang", "MaHang", "MaHTK", 0)], [], "FK_RELATIONSHIP_MATCH_ALIAS_EQUIVALENT"),
        ([("x", "CT", "Hang", "HangID", "id", "HangID", "id", 1)], [], "FK_RELATIONSHIP_SURROGATE_ACCEPTED"),
        ([("x", "CT", "Hang", "Other", "MaHang", "Other", "MaHang", 0)], [], "FK_RELATIONSHIP_WRONG_CHILD_COLUMNS"),
        ([("x", "CT", "Hang", "MaHang", "Ten", "MaHang", "Ten", 0)], [], "FK_RELATIONSHIP_WRONG_PARENT_COLUMNS"),
        ([("x", "CT", "Khac", "MaHang", "Ma", "MaHang", "Ma", 0)], [], "FK_RELATIONSHIP_WRONG_PARENT"),
        ([("x", "Khac", "Hang", "MaHang", "MaHang", "MaHang", "MaHang", 0)], [], "FK_RELATIONSHIP_WRONG_CHILD"),
        ([], [("s", "ct", "MaHang", "MaHang")], "FK_RELATIONSHIP_IMPLIED_REVIEW_REQUIRED"),
        ([], [("s", "ct", "Gia", "Gia")], "FK_RELATIONSHIP_MISSING"),
    ],
)
def test_relationships(spark, theirs, columns_, expected):
    answer = spark.createDataFrame([("fk1", "CT", "Hang", "MaHang", "MaHang", "MaHang", "MaHang", 0)], FKS)
    student = spark.createDataFrame([("s", *t) for t in theirs], "submission_id string, " + FKS)
    accepted = spark.createDataFrame([("s", "CT", "ct"), ("s", "Hang", "h")], "submission_id string, answer_table string, student_table string")
    cols = spark.createDataFrame(columns_, "submission_id string, table_name string, column_name string, column_name_canonical string")
    assert [r["fk_status"] for r in K.relationships(answer, student, accepted, cols).collect()] == [expected]


def test_accepted_parents_and_one_use(spark):
    answer = spark.createDataFrame([("a", "Mua", "LoaiTien", "MaLT", "MaLT", "MaLT", "MaLT", 0), ("b", "Mua", "Khac", "MaLT", "MaLT", "MaLT", "MaLT", 0)], FKS)
    student = spark.createDataFrame([("s", "x", "Mua", "Vi", "m", "m", "m", "m", 0)], "submission_id string, " + FKS)
    accepted = spark.createDataFrame([("s", t, t.lower()) for t in ("Mua", "LoaiTien", "Khac")], "submission_id string, answer_table string, student_table string")
    cols = spark.createDataFrame([], "submission_id string, table_name string, column_name string, column_name_canonical string")
    got = {r["answer_fk"]: r["fk_status"] for r in K.relationships(answer, student, accepted, cols, KeyRules(accepted_parents={"Mua": ("Vi",)})).collect()}
    assert got == {"a": "FK_RELATIONSHIP_MATCH", "b": "FK_RELATIONSHIP_MISSING"}


@pytest.mark.parametrize(
    "pk, unique, nullable, unmet, expected",
    [
        (["MaHang"], [], 0, False, "PK_MATCH_EXACT"), (["MaHTK"], [], 0, False, "PK_MATCH_ALIAS_EQUIVALENT"), (["Hang_ID"], ["MaHang"], 0, False, "PK_SURROGATE_ACCEPTED"), (["Hang_ID"], [], 0, False, "PK_REVIEW_REQUIRED"),
        (["Hang_ID"], ["MaHang"], 1, False, "PK_REVIEW_REQUIRED"), (["Hang_ID"], ["MaHang"], 0, True, "PK_REVIEW_REQUIRED"), (["Ten"], [], 0, False, "PK_REVIEW_REQUIRED"), ([], [], 0, False, "PK_MISSING"),
    ],
)
def test_adequate_keys(spark, pk, unique, nullable, unmet, expected):
    canonical = {"MaHTK": "MaHang"}
    key = "table_name_canonical string, column_name_canonical string, column_name string, key_ordinal int"
    answer = spark.createDataFrame([("Hang", "MaHang", "MaHang", 1)], key)
    student = spark.createDataFrame([("s", "hang", canonical.get(c, c), c, i) for i, c in enumerate(pk)], "submission_id string, table_name string, column_name_canonical string, column_name string, key_ordinal int")
    table_map = spark.createDataFrame([("s", "Hang", "hang", "TABLE_MATCHED_EXACT")], "submission_id string, answer_table string, student_table string, match_status string")
    column_map = spark.createDataFrame([("s", "Hang", "hang", "MaHang", "MaHang", "COLUMN_MATCHED_EXACT")], "submission_id string, answer_table string, student_table string, answer_column string, student_column string, match_status string")
    cols = spark.createDataFrame([("s", "hang", "MaHang", nullable, 0), ("s", "hang", "Hang_ID", 0, 0)], "submission_id string, table_name string, column_name string, is_nullable int, is_identity int")
    uniques = spark.createDataFrame([("s", "hang", "u", c) for c in unique], "submission_id string, table_name string, constraint_name string, column_name_canonical string")
    relations = spark.createDataFrame([("s", "Hang", "FK_RELATIONSHIP_MISSING")] if unmet else [], "submission_id string, child string, fk_status string")
    got = K.primary_keys_adequate(answer, student, table_map, column_map, cols, uniques, relations).collect()
    assert [r["key_status"] for r in got] == [expected]


def test_surrogates():
    rules = KeyRules()
    assert all(K._surrogate(c, ["MuaHang"], False, rules) for c in ("MuaHangID", "muahang_id", "id", "ID"))
    assert K._surrogate("x", ["MuaHang"], True, rules) and not K._surrogate("MaHangHoa", ["MuaHang"], False, rules)
    assert not K._surrogate("LoaiTien_ID", ["ChiTietTraTien"], False, rules) and K._surrogate("ChiTietTraTienID", ["ChiTietTraTien"], False, rules)


def test_division(spark):
    required = spark.createDataFrame([("A",), ("B",)], "t string")
    got = spark.createDataFrame([("s1", "A"), ("s1", "B"), ("s2", "A")], "submission_id string, t string")
    groups = got.select("submission_id").distinct()
    assert [r[0] for r in S.all_covered(required, got, ["submission_id"], "t", groups).collect()] == ["s1"]
    assert S.all_covered(required.limit(0), got, ["submission_id"], "t", groups).count() == 2
    assert F.lit(1) is not None
