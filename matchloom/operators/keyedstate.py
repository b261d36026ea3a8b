"""Keyed state on shared storage: parts cut into buckets of their key, each bucket a list of immutable segments.

A fold of batch k reads manifest k - 1, writes its segments under its own number and then manifest k, so a
batch that is run again overwrites its own segments and nothing else. Only the buckets a batch touches are
read or replaced; new rows are appended as segments, and a bucket of many segments is rewritten as one. What
neither manifest k nor k - 1 names is deleted once manifest k stands.
"""

from __future__ import annotations

import json
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Segments of a bucket from which on it is rewritten as one.
SEGMENTS = 8

Manifest = dict[str, dict[int, list[str]]]


class KeyedState:
    """Parts (name to schema) in `folder`, in `buckets` buckets by the columns `keys`."""

    def __init__(self, folder: str, parts: dict[str, str], keys: tuple[str, ...], buckets: int):
        self.folder, self.parts, self.keys, self.buckets = folder.rstrip("/"), parts, keys, buckets

    def bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int").alias("bucket")

    # --- files ---

    def _fs(self, spark: SparkSession, path: str):
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(spark._jsc.hadoopConfiguration()), p

    def manifest(self, spark: SparkSession, batch: int) -> Manifest:
        """What stood after a batch; before the first one nothing."""
        if batch < 0:
            return {part: {} for part in self.parts}
        text = "\n".join(r[0] for r in spark.read.text(f"{self.folder}/manifest-{batch}.json").collect())
        return {part: {int(b): v for b, v in of.items()} for part, of in json.loads(text).items()}

    def commit(self, spark: SparkSession, batch: int, manifest: Manifest) -> None:
        """Writes the manifest under another name first, then drops what no manifest in reach names."""
        fs, temporary = self._fs(spark, f"{self.folder}/_manifest-{batch}.tmp")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(manifest, sort_keys=True).encode()))
        out.close()
        _, final = self._fs(spark, f"{self.folder}/manifest-{batch}.json")
        fs.delete(final, False)
        fs.rename(temporary, final)
        named = lambda m: {(p, v, b) for p, of in m.items() for b, vs in of.items() for v in vs}
        _, older = self._fs(spark, f"{self.folder}/manifest-{batch - 2}.json")
        if batch >= 2 and fs.exists(older):
            for part, version, b in named(self.manifest(spark, batch - 2)) - named(self.manifest(spark, batch - 1)) - named(manifest):
                fs.delete(self._fs(spark, f"{self.folder}/{part}/v={version}/bucket={b}")[1], True)
            fs.delete(older, False)

    def write(self, part: str, rows: DataFrame, version: str) -> list[int]:
        """Writes a segment of each bucket in `rows`, which have the column `bucket`; the buckets written."""
        spark, path = rows.sparkSession, f"{self.folder}/{part}/v={version}"
        columns = [c.strip().split(" ")[0] for c in self.parts[part].split(",")]
        # adaptive execution splits the buckets of hot keys and joins small ones
        rows.select(*columns, "bucket").hint("rebalance", "bucket").write.mode("overwrite").partitionBy("bucket").parquet(path)
        fs, p = self._fs(spark, path)
        names = [s.getPath().getName() for s in fs.listStatus(p)]
        return sorted(int(n.split("=")[1]) for n in names if n.startswith("bucket="))

    def read(self, spark: SparkSession, manifest: Manifest, part: str, buckets: Iterable[int] | None = None) -> DataFrame:
        """Rows of the named buckets (all by default) as a manifest names them, with the column `bucket`."""
        wanted = sorted(manifest[part]) if buckets is None else sorted(set(buckets) & set(manifest[part]))
        paths = [f"{self.folder}/{part}/v={v}/bucket={b}" for b in wanted for v in manifest[part][b]]
        schema = self.parts[part] + ", v string, bucket int"
        rows = spark.read.schema(schema).option("basePath", f"{self.folder}/{part}").parquet(*paths) if paths else spark.createDataFrame([], schema)
        return rows.drop("v")

    # --- manifests ---

    @staticmethod
    def appended(of: dict[int, list[str]], buckets: Iterable[int], version: str) -> dict[int, list[str]]:
        return {**of, **{b: [*(v for v in of.get(b, []) if v != version), version] for b in buckets}}

    @staticmethod
    def replaced(of: dict[int, list[str]], buckets: Iterable[int], written: Iterable[int], version: str) -> dict[int, list[str]]:
        """`buckets` consist of nothing but the new segment, and of nothing at all where none was written."""
        kept = {b: v for b, v in of.items() if b not in set(buckets)}
        return {**kept, **{b: [version] for b in set(buckets) & set(written)}}

    def compacted(self, spark: SparkSession, manifest: Manifest, part: str, version: str) -> Manifest:
        """The manifest after buckets of many segments of a part were rewritten."""
        long = [b for b, versions in manifest[part].items() if len(versions) > SEGMENTS]
        if not long:
            return manifest
        written = self.write(part, self.read(spark, manifest, part, long), version)
        return {**manifest, part: self.replaced(manifest[part], long, written, version)}
