"""Files of repositories as tables, and snapshots as tables on disk."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracefold.operators.chunking import LANGUAGES, language_of

#: Folders whose files are left out, wherever they are below the root.
EXCLUDED = (".git", "node_modules", "__pycache__", ".venv", "venv")


def scan_repository(spark: SparkSession, root: str, repo_name: str | None = None) -> DataFrame:
    """repo_name, file_path (relative), language and source of the files that have a known language.

    Malformed UTF-8 becomes replacement characters.
    """
    base = root.rstrip("/")
    # The reader's own file listing; the pattern keeps other files from being read.
    names = "{" + ",".join(sorted({x for e in LANGUAGES for x in (e, e.upper(), e.capitalize())})) + "}"
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", f"*.{names}").load(base)
    whole = F.regexp_replace("path", "^file:/*", "/")
    start = base.removeprefix("file://")
    path = F.substring("_p", len(start) + 2, 1 << 20)
    listed = files.withColumn("_p", whole).withColumn("file_path", path)
    parts = F.split("file_path", "/")
    kept = listed.filter(~F.arrays_overlap(parts, F.array(*[F.lit(x) for x in EXCLUDED])))
    text = F.make_valid_utf8(F.col("content").cast("string"))
    return kept.select(F.lit(repo_name or base.rsplit("/", 1)[-1]).alias("repo_name"), "file_path", language_of(F.col("file_path")).alias("language"), text.alias("source"))


class SnapshotStore:
    """Snapshots as partitions of Parquet tables below a folder, manifests beside them.

    A manifest is written last, so a snapshot without one doesn't exist for readers.
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")

    def _path(self, table: str) -> str:
        return f"{self.root}/{table}"

    def _exists(self, table: str) -> bool:
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self._path(table))
        return path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)

    def write(self, table: str, rows: DataFrame, snapshot_id: str) -> None:
        """Replace the snapshot's partition of ``table``; other snapshots stay."""
        out = rows.drop("snapshot_id").withColumn("snapshot_id", F.lit(snapshot_id))
        out.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("snapshot_id").parquet(self._path(table))

    def read(self, table: str, snapshots: list[str] | None = None) -> DataFrame | None:
        """The rows of ``table``, of some snapshots (pruned to their partitions) or all; None if never written."""
        if not self._exists(table):
            return None
        rows = self.spark.read.parquet(self._path(table)).withColumn("snapshot_id", F.col("snapshot_id").cast("string"))
        return rows if snapshots is None else rows.filter(F.col("snapshot_id").isin(snapshots))

    def add_manifest(self, manifest: DataFrame) -> None:
        manifest.write.mode("append").parquet(self._path("manifests"))

    def manifests(self) -> DataFrame | None:
        """The last manifest written for each snapshot, newest snapshot first."""
        if not self._exists("manifests"):
            return None
        rows = self.spark.read.parquet(self._path("manifests"))
        return rows.groupBy("snapshot_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "snapshot_id"]), "ts").alias("m")).select("snapshot_id", "m.*").orderBy(F.desc("ts"), "snapshot_id")

    def has(self, snapshot_id: str) -> bool:
        found = self.manifests()
        return found is not None and not found.filter(F.col("snapshot_id") == snapshot_id).isEmpty()


def write_results(rows: DataFrame, path: str) -> None:
    """Results as JSON lines."""
    rows.write.mode("overwrite").json(path)
