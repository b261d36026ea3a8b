import pytest
from pyspark.sql import functions as F

from matchloom.config import NameRules, Rules, ViewRules
from matchloom.plans import pipeline as P
from matchloom.sources.snapshot import SCHEMAS


def part(spark, name, rows):
    schema = SCHEMAS[name]
    return spark.createDataFrame([tuple(r.get(f.name) for f in schema) for r in rows], schema)


def snapshot(spark, sub, tables, pks, fks, uniques=(), rows=3):
    """tables: name to (column, type, nullable, identity)"""
    given = {
        "tables": [{"submission_id": sub, "table_name": t, "row_count": rows} for t in tables],
        "columns": [{"submission_id": sub, "table_name": t, "table_name_canonical": t, "column_name": c, "column_name_canonical": c, "data_type": k, "is_nullable": n, "is_identity": i} for t, cs in tables.items() for c, k, n, i in cs],
        "primary_keys": [{"submission_id": sub, "table_name_canonical": t, "column_name_canonical": c, "key_ordinal": o} for t, cs in pks.items() for o, c in enumerate(cs, 1)],
        "foreign_keys": [{"submission_id": sub, "fk_name": f, "parent_table": a, "parent_column": x, "referenced_table": b, "referenced_column": y, "parent_table_canonical": a, "parent_column_canonical": x, "referenced_table_canonical": b, "referenced_column_canonical": y, "constraint_column_id": 1} for f, a, x, b, y in fks],
        "unique_constraints": [{"submission_id": sub, "table_name_canonical": t, "constraint_name": n, "column_name_canonical": c, "key_ordinal": 1} for t, n, c in uniques],
    }
    return {p: part(spark, p, given.get(p, [])) for p in SCHEMAS}


RULES = Rules(names=NameRules(tables={"HangHoa": ["HangTonKho"], "ChiTietMuaHang": ["CT_MuaHang"]}, columns_global={"MaHangHoa": ["MaHTK", "MaHang"], "SoLuong": ["qty"]}))
ANSWER = ({"HangHoa": [("MaHangHoa", "int", 0, 0), ("TenHangHoa", "nvarchar", 1, 0)], "ChiTietMuaHang": [("MaHangHoa", "int", 0, 0), ("SoLuong", "int", 1, 0)]}, {"HangHoa": ["MaHangHoa"], "ChiTietMuaHang": ["MaHangHoa"]}, [("fk", "ChiTietMuaHang", "MaHangHoa", "HangHoa", "MaHangHoa")])


@pytest.fixture(scope="module")
def reports(spark):
    answer = snapshot(spark, "ref", *ANSWER)
    good = snapshot(spark, "good", {"HangTonKho": [("MaHTK", "int", 0, 0), ("TenHangHoa", "nvarchar", 1, 0)], "CT_MuaHang": [("MaHang", "int", 0, 0), ("qty", "int", 1, 0)]}, {"HangTonKho": ["MaHTK"], "CT_MuaHang": ["MaHang"]}, [("auto", "CT_MuaHang", "MaHang", "HangTonKho", "MaHTK")])
    bad = snapshot(spark, "bad", {"HangHoa": [("MaHangHoa", "int", 0, 0), ("HangHoaID", "int", 0, 1)]}, {"HangHoa": ["HangHoaID"]}, [], [("HangHoa", "u", "MaHangHoa")], rows=9)
    students = {p: good[p].unionByName(bad[p]) for p in SCHEMAS}
    return P.compare_structure(answer, students, RULES), students


def test_compare_structure(reports):
    out, _ = reports
    tables = {(r["submission_id"], r["answer_table"]): r["match_status"] for r in out["table_mapping"].collect()}
    assert tables == {("good", "HangHoa"): "TABLE_MATCHED_ALIAS", ("good", "ChiTietMuaHang"): "TABLE_MATCHED_ALIAS", ("bad", "HangHoa"): "TABLE_MATCHED_EXACT", ("bad", "ChiTietMuaHang"): "TABLE_MISSING_ANSWER"}
    pks = {(r["submission_id"], r["answer_table"]): r["key_status"] for r in out["primary_keys"].collect()}
    assert pks == {("good", "HangHoa"): "PK_MATCH_ALIAS_EQUIVALENT", ("good", "ChiTietMuaHang"): "PK_MATCH_ALIAS_EQUIVALENT", ("bad", "HangHoa"): "PK_SURROGATE_ACCEPTED", ("bad", "ChiTietMuaHang"): "PK_MISSING"}
    fks = {r["submission_id"]: r["fk_status"] for r in out["relationships"].collect()}
    assert fks == {"good": "FK_RELATIONSHIP_MATCH_ALIAS_EQUIVALENT", "bad": "FK_RELATIONSHIP_MISSING"}
    assert [(r["submission_id"], r["difference"]) for r in out["row_counts"].collect()] == [("bad", 6)]
    lines = {r["submission_id"]: r for r in P.summary(out).collect()}
    assert lines["good"]["tables_matched"] == 2 and lines["good"]["columns_matched"] == 4 and lines["good"]["suggested_status"] == "PASS"
    assert lines["bad"]["suggested_status"] == "FAIL_STRUCTURE" and lines["bad"]["keys_missing"] == 1


def test_views(spark, reports):
    out, _ = reports
    tables, columns = P.mapped_names(out["table_mapping"], out["column_mapping"])
    data = {"HangHoa": spark.createDataFrame([(1, "A"), (2, "B")], "MaHangHoa int, TenHangHoa string"), "ChiTietMuaHang": spark.createDataFrame([(1, 5), (1, 2), (2, 7)], "MaHangHoa int, SoLuong int")}
    views = [ViewRules("vTong", [("MaHangHoa", "int", ()), ("Tong", "number", ("total",))]), ViewRules("vTen", [("TenHangHoa", "text", ())])]
    answers = {"vTong": data["ChiTietMuaHang"].groupBy("MaHangHoa").sum("SoLuong").toDF("MaHangHoa", "Tong"), "vTen": data["HangHoa"].select("TenHangHoa")}
    definitions = [
        ("good", "v_1", "CREATE VIEW v_1 AS SELECT MaHang AS MaHangHoa, SUM(qty) AS total FROM dbo.CT_MuaHang GROUP BY MaHang"),
        ("good", "vTen", "CREATE VIEW vTen AS SELECT TenHangHoa FROM HangTonKho WHERE MaHTK > 1"),
        ("bad", "x", "CREATE VIEW x AS DELETE FROM HangHoa"),
        ("bad", "y", "CREATE VIEW y AS SELECT * FROM Nowhere"),
    ]
    got = {(r["submission_id"], r["expected_view"]): r for r in P.assign_views(P.score_candidates(spark, definitions, views, answers, data, tables, columns)).collect()}
    assert (got["good", "vTong"]["student_view"], got["good", "vTong"]["status"]) == ("v_1", "VIEW_PASS")
    assert (got["good", "vTen"]["student_view"], got["good", "vTen"]["status"], got["good", "vTen"]["match_method"]) == ("vTen", "VIEW_ROW_COUNT_MISMATCH", "name_hint_then_output")
    assert got["bad", "vTong"]["status"] in ("VIEW_SQL_UNSAFE_REVIEW", "VIEW_SQL_UNMAPPED_TABLE") and got["bad", "vTong"]["total_match_score"] == 0


def test_ordered_views(spark):
    data = {"Hang": spark.createDataFrame([(k, f"N{k}", 40 - k) for k in range(40)], "Ma int, Ten string, Gia int").repartition(4)}
    views = [ViewRules("vGia", [("Ten", "text", ()), ("Gia", "int", ())], ordered=True)]
    sql = {"right": "SELECT Ten, Gia FROM Hang ORDER BY Gia", "wrong": "SELECT Ten, Gia FROM Hang ORDER BY Gia DESC", "none": "SELECT Ten, Gia FROM Hang", "hidden": "SELECT Ten, Gia FROM Hang ORDER BY Ma DESC", "short": "SELECT TOP 30 Ten, Gia FROM Hang ORDER BY Gia"}
    definitions = [(sub, "v", f"CREATE VIEW v AS {q}") for sub, q in sql.items()]
    maps = {sub: {"Hang": "Hang"} for sub in sql}
    for answer in (data["Hang"].orderBy("Gia").select("Ten", "Gia"), data["Hang"].select("Ten", "Gia", (F.col("Gia") * 2).alias("ordinal"))):
        got = {r["submission_id"]: r for r in P.score_candidates(spark, definitions, views, {"vGia": answer}, data, maps, {}).collect()}
        assert {s: r["candidate_status"] for s, r in got.items()} == {"right": "VIEW_PASS", "wrong": "VIEW_ORDER_MISMATCH", "none": "VIEW_ORDER_MISMATCH", "hidden": "VIEW_PASS", "short": "VIEW_ROW_COUNT_MISMATCH"}
        assert {s: r["order_mismatch_count"] for s, r in got.items()} == {"right": 0, "wrong": 40, "none": 40, "hidden": 0, "short": 0}
        assert [got[s]["order_score"] for s in ("right", "wrong", "none")] == [1, 0, 0]
        assert got["right"]["total_match_score"] == pytest.approx(1) and got["wrong"]["total_match_score"] == pytest.approx(0.4) and got["none"]["total_match_score"] == pytest.approx(0.9)


def test_other_columns_are_compared(spark):
    data = {"Hang": spark.createDataFrame([(k, f"N{k}", 10 * k) for k in range(8)], "Ma int, Ten string, Gia int")}
    columns = [("Ten", "text", ()), ("Gia", "int", ())]
    views = [ViewRules("vGia", columns), ViewRules("vThuTu", columns, ordered=True)]
    sql = {
        "surplus": "SELECT Ten, Gia, Ma * 2 AS Khac FROM Hang ORDER BY Gia", "missing": "SELECT Ten FROM Hang ORDER BY Gia", "fewer": "SELECT Ten, Gia, Ma AS Khac FROM Hang WHERE Ma > 1 ORDER BY Gia",
        "twice": "SELECT Ten, Ten, Gia FROM Hang", "surplus_twice": "SELECT Ten, Gia, Ma AS Khac, Ma AS Khac FROM Hang ORDER BY Gia", "none": "SELECT Ma AS Khac FROM Hang ORDER BY Ma", "ambiguous": "SELECT Ten, TEN AS TEN, Gia FROM Hang",
    }
    definitions = [(sub, "v", f"CREATE VIEW v AS {q}") for sub, q in sql.items()]
    answer = data["Hang"].orderBy("Gia").select("Ten", "Gia")
    rows = P.score_candidates(spark, definitions, views, {"vGia": answer, "vThuTu": answer}, data, {sub: {"Hang": "Hang"} for sub in sql}, {}).collect()
    assert {r["candidate_status"] for r in rows} == {"VIEW_OUTPUT_SCHEMA_MISMATCH"} and len(rows) == 2 * len(sql)
    got = {(r["submission_id"], r["ordered"]): (r["matched_columns"], r["row_count_answer"], r["row_count_student"], r["value_mismatch_count"], r["order_mismatch_count"], round(r["total_match_score"], 6)) for r in rows}
    ninth = lambda x: round(x / 9, 6)
    assert got["surplus", False] == got["surplus_twice", False] == (2, 8, 8, 0, 0, 1)
    assert got["surplus", True] == got["surplus_twice", True] == (2, 8, 8, 0, 0, 1)
    # the first row is priced 0, so all eight differ from null
    assert got["missing", False] == (1, 8, 8, 8, 0, ninth(1 + 2)) and got["missing", True] == (1, 8, 8, 8, 8, 0.3)
    assert got["fewer", False] == (2, 8, 6, 0, 0, ninth(2 + 1.5 + 5)) and got["fewer", True] == (2, 8, 6, 0, 0, 0.95)
    assert got["none", False] == (0, 8, 8, 8, 0, ninth(2))
    assert got["twice", False] == got["ambiguous", False] == (0, 0, 0, 0, 0, 0)
    assert {r["student_view"] for r in P.assign_views(spark.createDataFrame(rows).where("submission_id = 'surplus'")).collect()} >= {"v"}
