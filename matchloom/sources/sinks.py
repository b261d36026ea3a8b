"""Writers of reports. DataFrames go to files by Spark; only small, bounded frames come to the driver."""

from __future__ import annotations

import csv
import hashlib
import json
from pathlib import Path

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Rows a workbook sheet or a feedback file may have; a larger frame belongs into Parquet or CSV.
SHEET_ROWS = 100_000


class TooLarge(ValueError):
    """A frame is too large for a file that is written by the driver."""


def bounded(df: DataFrame, limit: int = SHEET_ROWS):
    """The frame as pandas, or TooLarge; never more than limit + 1 rows reach the driver."""
    out = df.limit(limit + 1).toPandas()
    if len(out) > limit:
        raise TooLarge(f"more than {limit} rows")
    return out


def write_report(df: DataFrame, path: str, fmt: str = "csv", partition_by: str | None = None) -> None:
    """CSV with a header (lists joined by ';', nulls empty), or Parquet."""
    if fmt == "csv":
        lists = {f.name for f in df.schema if f.dataType.typeName() == "array"}
        df = df.select(*[F.concat_ws(";", c).alias(c) if c in lists else F.col(f"`{c}`") for c in df.columns])
        writer = df.write.mode("overwrite").option("header", True).option("emptyValue", "")
    else:
        writer = df.write.mode("overwrite")
    (writer.partitionBy(partition_by) if partition_by else writer).format(fmt).save(path)


def write_single_csv(df: DataFrame, path: str) -> None:
    """One CSV file with a header on the driver, for small reports; an empty frame gives the header alone."""
    frame = bounded(df)
    with open(path, "w", newline="", encoding="utf-8") as out:
        writer = csv.writer(out)
        writer.writerow(df.columns)
        writer.writerows([["" if v is None or v != v else v for v in row] for row in frame.itertuples(index=False)])


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """An XLSX file with one sheet per frame, where openpyxl is installed."""
    import pandas as pd

    with pd.ExcelWriter(path) as book:
        for name, df in sheets.items():
            bounded(df).to_excel(book, sheet_name=name[:31], index=False)


def write_feedback(rows: DataFrame, folder: str, title: str = "Feedback") -> DataFrame:
    """One Markdown text per submission as (submission_id, markdown), written as text partitioned by submission.

    rows: submission_id, component, object, status, message.
    """
    line = F.concat(F.lit("- **"), F.col("component"), F.lit("** "), F.coalesce("object", F.lit("")), F.lit(": "), F.col("status"), F.when(F.coalesce("message", F.lit("")) != "", F.concat(F.lit(" - "), "message")).otherwise(""))
    lines = F.array_sort(F.collect_list(F.struct("component", line.alias("line"))))
    out = rows.groupBy("submission_id").agg(lines.alias("lines")).select(
        "submission_id", F.concat(F.lit(f"# {title} "), "submission_id", F.lit("\n\n"), F.concat_ws("\n", F.transform("lines", lambda x: x["line"]))).alias("markdown")
    )
    out.select(F.col("markdown").alias("value"), "submission_id").write.mode("overwrite").partitionBy("submission_id").text(folder)
    return out


def write_metadata(values: dict, path: str, *files: str) -> None:
    """A JSON file with values and the SHA-256 of files."""
    sums = {Path(f).name: hashlib.sha256(Path(f).read_bytes()).hexdigest() for f in files}
    Path(path).write_text(json.dumps({**values, "sha256": sums}, indent=2, sort_keys=True, ensure_ascii=False), encoding="utf-8")
