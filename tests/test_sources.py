import json

import pytest
from pyspark.sql import functions as F

from matchloom.sources import sinks as W
from matchloom.sources import snapshot as S


def test_snapshot_round_trip(spark, tmp_path):
    df = spark.createDataFrame([("s1", "KhachHang", "5", "junk")], "submission_id string, table_name string, row_count string, unknown string")
    parts = {p: (df if p == "tables" else spark.createDataFrame([], S.SCHEMAS[p])) for p in S.SCHEMAS}
    S.write_snapshot(parts, str(tmp_path / "p"))
    back = S.read_snapshot(spark, str(tmp_path / "p"), "parquet")
    r = back["tables"].first()
    assert back["tables"].schema == S.SCHEMAS["tables"] and r["row_count"] == 5 and r["schema_name"] is None
    with pytest.raises(KeyError):
        S.project(df, "nothing")


def test_csv_parts(spark, tmp_path):
    for sub in ("s1", "s2"):
        folder = tmp_path / sub
        folder.mkdir()
        (folder / "tables.csv").write_text("﻿table_name,row_count\nA,3\n\"B, c\",x\n", encoding="utf-8")
    rows = S.read_part(spark, str(tmp_path), "tables").collect()
    assert sorted((r["submission_id"], r["table_name"], r["row_count"]) for r in rows) == [("s1", "A", 3), ("s1", "B, c", None), ("s2", "A", 3), ("s2", "B, c", None)]
    assert S.read_part(spark, str(tmp_path), "views").count() == 0


def test_seed_rubric_overrides(spark, tmp_path):
    (tmp_path / "s.csv").write_text("﻿MaKH,TenKH\n1, Nha Cung Cap A \n2,NULL\n3,\n", encoding="utf-8")
    assert [tuple(r) for r in S.read_seed(spark, str(tmp_path / "s.csv")).collect()] == [("1", "Nha Cung Cap A"), ("2", None), ("3", None)]
    (tmp_path / "r.csv").write_text("section,total_points\na,2.5\n", encoding="utf-8")
    assert S.read_rubric(spark, str(tmp_path / "r.csv")).first()["total_points"] == 2.5
    (tmp_path / "bad.csv").write_text("section,total_points\na,-1\n", encoding="utf-8")
    with pytest.raises(Exception, match="bad points"):
        S.read_rubric(spark, str(tmp_path / "bad.csv")).collect()
    (tmp_path / "o.csv").write_text("submission_id,override_points\na,\nb,1.5\n", encoding="utf-8")
    assert [r["override_points"] for r in S.read_overrides(spark, str(tmp_path / "o.csv")).collect()] == [0.0, 1.5]


def test_catalog(spark):
    spark.createDataFrame([(1, "a"), (2, None)], "id bigint, name string").createOrReplaceTempView("t_catalog")
    spark.sql("SELECT id, assert_true(id < 0) AS x FROM t_catalog").createOrReplaceTempView("t_bad")
    assert S.catalog_tables(spark, ["t_catalog"], "ref").first()["row_count"] == 2
    assert S.catalog_tables(spark, [], "ref").count() == 0
    assert [(r["column_name"], r["data_type"]) for r in S.catalog_columns(spark, ["t_catalog"], "ref").collect()] == [("id", "bigint"), ("name", "nvarchar")]
    views = {r["view_name"]: (r["execution_status"], r["row_count"]) for r in S.catalog_views(spark, ["t_catalog", "t_none"], "ref").collect()}
    assert views == {"t_catalog": ("OK", 2), "t_none": ("ERROR", -1)}


def test_candidates(spark):
    rows = [("/a/20230001_An.bak", 5, 1), ("/a/bai_20230001.bak", 5, 2), ("/a/.hidden.bak", 5, 1), ("/a/~$x.bak", 5, 1), ("/a/empty.bak", 0, 1), ("/a/x.txt", 3, 1), ("/a/20230002.bak", 1, 1), ("/b/20230002.bak", 1, 1)]
    files = S.candidate_files(spark.createDataFrame(rows, "path string, length int, modificationTime int"))
    reasons = {r["path"]: r["skip_reason"] for r in files.collect()}
    assert [reasons[p] for p, *_ in rows] == [None, None, "hidden", "lock", "empty", "suffix", None, None]
    chosen = {r["submission_id"]: (r["path"], r["error"]) for r in S.select_candidate(files).collect()}
    assert chosen["20230001"] == ("/a/bai_20230001.bak", None) and chosen["20230002"][1] == "AMBIGUOUS_SOURCE"
    df = spark.createDataFrame([("bai_master", "1"), ("x", "master"), ("a;b", "1"), ("ok", "1")], "stem string, submission_id string")
    assert [r[0] for r in df.select(S.quarantined("stem", "submission_id", ["master"])).collect()] == [True, True, True, False]


def test_manifest(spark):
    rows = [("a", "ERROR", "1", "1"), ("a", "OK", "2", "3"), ("b", "OK", "1", "1")]
    df = spark.createDataFrame(rows, "submission_id string, status string, started_at string, finished_at string")
    assert {r["submission_id"]: r["status"] for r in S.latest_manifest(df).collect()} == {"a": "OK", "b": "OK"}


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([("s", ["a", "b"], None)], "submission_id string, l array<string>, n int")
    W.write_report(df, str(tmp_path / "r"))
    back = S.read_csv(spark, str(tmp_path / "r"))
    assert tuple(back.first()) == ("s", "a;b", None)
    W.write_report(df, str(tmp_path / "p"), "parquet", "submission_id")
    assert spark.read.parquet(str(tmp_path / "p")).count() == 1
    W.write_single_csv(df.drop("l").limit(0), str(tmp_path / "one.csv"))
    assert (tmp_path / "one.csv").read_text() == "submission_id,n\n"
    with pytest.raises(W.TooLarge):
        W.bounded(spark.range(5), 4)
    rows = spark.createDataFrame([("s", "TABLE", "a", "MISSING", "no table"), ("s", "COLUMN", None, "OK", None)], "submission_id string, component string, object string, status string, message string")
    text = W.write_feedback(rows, str(tmp_path / "f")).first()["markdown"]
    assert "- **TABLE** a: MISSING - no table" in text and text.startswith("# Feedback s")
    W.write_metadata({"x": 1}, str(tmp_path / "m.json"), str(tmp_path / "one.csv"))
    meta = json.loads((tmp_path / "m.json").read_text())
    assert meta["x"] == 1 and len(meta["sha256"]["one.csv"]) == 64
    assert F.lit(1) is not None
