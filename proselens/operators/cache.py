"""Incremental scans (S13, S14, J1, J2): results keyed by path, stamp and run key in a Parquet snapshot."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

KEY = ["path", "run_key", "stamp"]


def run_key(*parts: object) -> str:
    """What results depend on besides the file: code version, model, options."""
    import hashlib

    return hashlib.blake2b(json.dumps(parts, sort_keys=True, default=str).encode(), digest_size=16).hexdigest()


def stamped(files: DataFrame, key: str) -> DataFrame:
    """files(path, content) with the normal path, run key and a stamp of size and digest."""
    return files.withColumns({"path": F.replace("path", F.lit("\\"), F.lit("/")), "run_key": F.lit(key), "stamp": F.concat_ws(":", F.octet_length("content"), F.sha2("content", 256))})


def hits(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files whose stored results hold."""
    return files.join(cache, KEY)


def misses(files: DataFrame, cache: DataFrame) -> DataFrame:
    """Files to scan."""
    return files.join(cache, KEY, "left_anti")


def pruned(cache: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of files still there."""
    return cache.join(files, "path", "left_semi")


class Store:
    """Snapshots in a folder; a pointer file names the current one, so readers never see half a write."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def _pointer(self):
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/CURRENT")
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), path

    def load(self) -> DataFrame | None:
        fs, path = self._pointer()
        if not fs.exists(path):
            return None
        name = self.spark.read.text(f"{self.folder}/CURRENT").first()[0]
        return self.spark.read.parquet(f"{self.folder}/{name}")

    def save(self, entries: DataFrame, name: str) -> None:
        entries.write.mode("overwrite").parquet(f"{self.folder}/{name}")
        fs, path = self._pointer()
        aside = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/CURRENT.{name}")
        out = fs.create(aside, True)
        out.write(bytearray(name.encode()))
        out.close()
        # renamed over the old one, so that a reader finds one or the other
        files = self.spark.sparkContext._jvm.org.apache.hadoop.fs.FileContext.getFileContext(path.toUri() if path.toUri().getScheme() else fs.getUri(), self.spark.sparkContext._jsc.hadoopConfiguration())
        options = self.spark.sparkContext._gateway.new_array(self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        options[0] = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Options.Rename.OVERWRITE
        files.rename(fs.makeQualified(aside), fs.makeQualified(path), options)
