"""An index kept up by a stream of files: each batch makes a snapshot, and a manifest says which one counts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from ..operators import chunking

DOCUMENTS = "path string, sha256 string"
CHUNKS = "path string, ordinal int, start_line int, end_line int, body string, cut boolean"


class Snapshots:
    """Tables documents and chunks under a root folder, as of the last batch that was committed.

    A batch writes a snapshot folder of its own and then renames a file into
    the manifest, which is what makes it count. So a batch that fails half way
    changes nothing, and one that is replayed is found there and left out.
    Older snapshots stay until prune().
    """

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        path = spark._jvm.org.apache.hadoop.fs.Path
        self._path = lambda *parts: path("/".join((self.root, *parts)))
        self._fs = self._path("manifest").getFileSystem(spark._jsc.hadoopConfiguration())

    def committed(self) -> list[int]:
        """Batches in the manifest, in order."""
        if not self._fs.exists(self._path("manifest")):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path("manifest"))]
        return sorted(int(n) for n in names if n.isdigit())

    def _read(self, name: str, schema: str) -> DataFrame:
        done = self.committed()
        if not done:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(f"{self.root}/snapshot-{done[-1]}/{name}")

    def documents(self) -> DataFrame:
        return self._read("documents", DOCUMENTS)

    def chunks(self) -> DataFrame:
        return self._read("chunks", CHUNKS)

    def commit(self, batch: int, documents: DataFrame, chunks: DataFrame) -> None:
        documents.write.mode("overwrite").parquet(f"{self.root}/snapshot-{batch}/documents")
        chunks.write.mode("overwrite").parquet(f"{self.root}/snapshot-{batch}/chunks")
        self._fs.mkdirs(self._path("manifest"))
        part = self._path("manifest", f".{batch}.partial")
        self._fs.create(part, True).close()
        if not self._fs.rename(part, self._path("manifest", str(batch))):
            raise OSError(f"batch {batch} could not be committed")

    def prune(self) -> None:
        """Deletes snapshots that no longer count; for when nothing reads them."""
        done = self.committed()
        for batch in done[:-1]:
            self._fs.delete(self._path(f"snapshot-{batch}"), True)


def upserting(spark: SparkSession, root: str, most_lines: int = 40, max_tokens: int = 256) -> Callable[[DataFrame, int], None]:
    """A function for foreachBatch over files (path, modified, text): new and changed texts are cut to chunks, the others left alone.

    Of several versions of a path in one batch the last counts. A batch whose
    id is in the manifest changes nothing.
    """
    held = Snapshots(spark, root)

    def run(batch: DataFrame, batch_id: int) -> None:
        done = held.committed()
        if done and batch_id <= done[-1]:
            return
        last = F.row_number().over(W.partitionBy("path").orderBy(F.desc("modified"), F.desc("sha256")))
        files = batch.where("path is not null").withColumn("sha256", F.sha2(F.coalesce("text", F.lit("")), 256)).withColumn("_n", last).where("_n = 1")
        documents, chunks = held.documents(), held.chunks()
        fresh = files.join(documents, ["path", "sha256"], "left_anti").select("path", "sha256", "text")
        gone = fresh.select("path")
        cut = chunking.chunked(fresh.select(F.xxhash64("path").alias("doc_id"), "text"), most_lines, max_tokens)
        named = cut.join(fresh.select(F.xxhash64("path").alias("doc_id"), "path"), "doc_id").select(*[c.split()[0] for c in CHUNKS.split(", ")])
        held.commit(batch_id, documents.join(gone, "path", "left_anti").unionByName(fresh.select("path", "sha256")), chunks.join(gone, "path", "left_anti").unionByName(named))

    return run
