"""Catalog snapshots: fixed schemas, CSV readers and writers, and extraction from a Spark catalog.

A snapshot is eight row sets that carry `submission_id`, so all submissions are read as one set of
DataFrames: `root/<submission>/<part>.csv`, or Parquet folders of the same names.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from matchloom.functions import text

# Columns of each part of a snapshot; int marks the integers.
_LAYOUT = {
    "tables": "database_role submission_id schema_name table_name table_name_canonical object_id:int column_count:int row_count:int",
    "columns": "submission_id schema_name table_name table_name_canonical column_name column_name_canonical ordinal_position:int data_type max_length:int precision:int scale:int is_nullable:int is_identity:int default_definition",
    "primary_keys": "submission_id table_name_canonical constraint_name column_name_canonical key_ordinal:int",
    "foreign_keys": "submission_id fk_name parent_table parent_column referenced_table referenced_column parent_table_canonical parent_column_canonical referenced_table_canonical referenced_column_canonical delete_rule update_rule constraint_column_id:int",
    "views": "submission_id view_name view_name_canonical definition_normalized definition_hash execution_status row_count:int column_count:int",
    "view_columns": "submission_id view_name_canonical ordinal_position:int column_name column_name_canonical data_type",
    "unique_constraints": "submission_id table_name_canonical constraint_name column_name_canonical key_ordinal:int",
    "view_definitions": "submission_id role view_schema view_name view_name_canonical definition_found raw_definition raw_definition_path extract_status extract_error",
}
SCHEMAS = {
    part: T.StructType([T.StructField(c.split(":")[0], T.IntegerType() if c.endswith(":int") else T.StringType()) for c in layout.split()])
    for part, layout in _LAYOUT.items()
}


def project(df: DataFrame, part: str) -> DataFrame:
    """The part's columns in their order; missing ones null, unknown ones dropped. An unknown part is an error."""
    if part not in SCHEMAS:
        raise KeyError(f"no snapshot part {part!r}")
    known = {c.lower(): c for c in df.columns}
    value = lambda f: F.col(f"`{known[f.name]}`") if f.name in known else F.lit(None)
    cast = lambda f: value(f).try_cast("int") if isinstance(f.dataType, T.IntegerType) else value(f).cast("string")
    return df.select(*[cast(f).alias(f.name) for f in SCHEMAS[part]])


def _exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_csv(spark: SparkSession, path: str, columns: Iterable[str] | None = None) -> DataFrame:
    """A CSV with a header, all strings; a byte order mark is dropped. `path` may be a glob."""
    df = spark.read.csv(path, header=True, multiLine=True, escape='"')
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*columns) if columns else df


def read_part(spark: SparkSession, root: str, part: str, fmt: str = "csv") -> DataFrame:
    """One part of all submissions' snapshots; empty where no file is there. The folder names the submission if the rows don't."""
    schema = SCHEMAS[part]
    path = f"{root}/*/{part}.csv" if fmt == "csv" else f"{root}/{part}"
    if not _exists(spark, path):
        return spark.createDataFrame([], schema)
    if fmt != "csv":
        return project(spark.read.format(fmt).load(path), part)
    rows = spark.read.csv(path, header=True, multiLine=True, escape='"')
    rows = rows.toDF(*[c.lstrip("﻿") for c in rows.columns]).withColumn("_folder", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
    own = F.coalesce(F.col("submission_id"), F.col("_folder")) if "submission_id" in rows.columns else F.col("_folder")
    return project(rows.withColumn("submission_id", own), part)


def read_snapshot(spark: SparkSession, root: str, fmt: str = "csv") -> dict[str, DataFrame]:
    return {part: read_part(spark, root, part, fmt) for part in SCHEMAS}


def write_snapshot(parts: dict[str, DataFrame], root: str, fmt: str = "parquet", submission: str = "all") -> None:
    """Writes each part; CSV as root/<submission>/<part>.csv with empty texts for nulls."""
    for part, df in parts.items():
        out = project(df, part)
        if fmt == "csv":
            out.fillna("").write.mode("overwrite").csv(f"{root}/{submission}/{part}.csv", header=True, emptyValue="")
        else:
            out.write.mode("overwrite").format(fmt).save(f"{root}/{part}")


def read_seed(spark: SparkSession, path: str) -> DataFrame:
    """Seed rows, all strings; blank and NULL texts are null."""
    df = read_csv(spark, path)
    return df.select(*[text.parse_value(f"`{c}`").alias(c.strip()) for c in df.columns])


def read_rubric(spark: SparkSession, path: str) -> DataFrame:
    """Rubric rows with points; a negative or unreadable number of points is an error when read."""
    points = text.strip("total_points").try_cast("double")
    checked = F.when(points >= 0, points).otherwise(F.raise_error(F.concat(F.lit("bad points: "), F.coalesce("total_points", F.lit("none")))).cast("double"))
    return read_csv(spark, path).withColumn("total_points", checked).withColumn("ordinal", F.monotonically_increasing_id())


def read_overrides(spark: SparkSession, path: str) -> DataFrame:
    """Override rows; blank points are 0."""
    return read_csv(spark, path).withColumn("override_points", text.safe_double("override_points")).withColumn("ordinal", F.monotonically_increasing_id())


def catalog_tables(spark: SparkSession, names: Iterable[str], submission: str, role: str = "reference") -> DataFrame:
    """Table metadata of registered tables; rows are counted in one plan."""
    names = list(names)
    if not names:
        return spark.createDataFrame([], SCHEMAS["tables"])
    parts = [
        spark.table(n).agg(F.count(F.lit(1)).cast("int").alias("row_count")).select(
            F.lit(role).alias("database_role"), F.lit(submission).alias("submission_id"), F.lit(n).alias("table_name"), F.lit(len(spark.table(n).columns)).alias("column_count"), "row_count"
        )
        for n in names
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return project(out, "tables")


# SQL type names of Spark types.
_SQL_NAMES = {"string": "nvarchar", "bigint": "bigint", "int": "int", "smallint": "smallint", "tinyint": "tinyint", "double": "float", "float": "real", "boolean": "bit", "binary": "varbinary", "date": "date", "timestamp": "datetimeoffset", "timestamp_ntz": "datetime2"}


def catalog_columns(spark: SparkSession, names: Iterable[str], submission: str) -> DataFrame:
    """Column metadata of registered tables, from their schemas alone."""
    rows = []
    for n in names:
        for k, f in enumerate(spark.table(n).schema, 1):
            kind = f.dataType.simpleString()
            decimal = isinstance(f.dataType, T.DecimalType)
            rows.append((submission, n, f.name, k, "decimal" if decimal else _SQL_NAMES.get(kind, kind), f.dataType.precision if decimal else None, f.dataType.scale if decimal else None, int(f.nullable)))
    schema = "submission_id string, table_name string, column_name string, ordinal_position int, data_type string, precision int, scale int, is_nullable int"
    return project(spark.createDataFrame(rows, schema), "columns")


def catalog_views(spark: SparkSession, names: Iterable[str], submission: str) -> DataFrame:
    """View metadata with a dry run: a view that fails has status ERROR and -1 rows."""
    rows = []
    for n in names:
        try:
            df = spark.table(n)
            rows.append((submission, n, "OK", df.count(), len(df.columns)))
        except Exception:
            rows.append((submission, n, "ERROR", -1, 0))
    return project(spark.createDataFrame(rows, "submission_id string, view_name string, execution_status string, row_count int, column_count int"), "views")


def latest_manifest(entries: DataFrame) -> DataFrame:
    """Last entry of each submission by finished_at, then started_at."""
    newest = F.struct("finished_at", "started_at", "status")
    rest = [c for c in entries.columns if c != "submission_id"]
    return entries.groupBy("submission_id").agg(F.max_by(F.struct(*rest), newest).alias("e")).select("submission_id", "e.*")


def candidate_files(files: DataFrame, suffixes: tuple[str, ...] = (".bak",)) -> DataFrame:
    """Files (path, length, modificationTime) that may be a submission, with a reason for those that may not."""
    name = F.element_at(F.split("path", "/"), -1)
    low = F.lower(name)
    ends = F.lit(False)
    for s in suffixes:
        ends = ends | low.endswith(s.lower())
    reason = F.when(name.startswith("."), "hidden").when(name.startswith("~$") | low.endswith(".lock"), "lock").when(F.col("length") == 0, "empty").when(~ends, "suffix")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    return files.dropDuplicates(["path"]).select("path", "length", "modificationTime", stem.alias("stem"), text.submission_id(stem).alias("submission_id"), reason.alias("skip_reason"))


def select_candidate(files: DataFrame) -> DataFrame:
    """One file per submission: its name holds the id, then the latest; several alike are an error in `error`."""
    ok = files.where("skip_reason IS NULL").withColumn("named", F.col("stem").contains(F.col("submission_id")).cast("int"))
    rank = F.struct("named", "modificationTime")
    best = ok.groupBy("submission_id").agg(F.max(rank).alias("best"))
    tied = ok.join(best, "submission_id").where(rank == F.col("best")).groupBy("submission_id").agg(F.min("path").alias("path"), F.count(F.lit(1)).alias("n"))
    return tied.select("submission_id", "path", F.when(F.col("n") > 1, "AMBIGUOUS_SOURCE").alias("error"))


def quarantined(stem, submission, protected: Iterable[str]):
    """Whether a file must not be touched: a protected name inside its stem, an id equal to one, or unsafe characters."""
    low = F.lower(text.column(stem))
    names = [p.lower() for p in protected]
    inside = F.lit(False)
    for p in names:
        inside = inside | low.contains(p)
    return inside | F.lower(text.column(submission)).isin(*names or [""]) | low.rlike(r"[;'\"\[\]]|--")
