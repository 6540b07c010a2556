"""What the corpus operators share: table reading, the shared folder, Arrow maps."""

from __future__ import annotations

import atexit
import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager, suppress
from contextvars import ContextVar
from itertools import chain
from typing import Any, NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of characters other than ASCII white space (SPACE, TAB to CR).
WORD = r"[^\x20\x09-\x0D]+"
SPACES = r"[\x20\x09-\x0D]+"
WORD_RE = re.compile(WORD)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir; one of our own where that is unset and Spark runs in one process."""
    found = spark.sparkContext.getCheckpointDir() or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
        found = spark.sparkContext.getCheckpointDir()
    return found


#: Paths written by each scratch() that is open around the caller, innermost last; every thread has its own.
_open: ContextVar[tuple[list[Path], ...]] = ContextVar("scratch", default=())


class Path(NamedTuple):
    """A path in the shared folder, with what it takes to delete it."""

    jvm: Any
    conf: Any
    name: str

    def delete(self) -> None:
        path = self.jvm.org.apache.hadoop.fs.Path(self.name)
        path.getFileSystem(self.conf).delete(path, True)


#: What was written outside any scratch(): results may read it as long as the process lives.
_left: list[Path] = []


@atexit.register
def _leave() -> None:
    for path in _left:
        with suppress(Exception):  # the JVM may be gone
            path.delete()


def owned(spark: SparkSession, name: str, outlives: bool = False) -> str:
    """The path `name`, which is deleted when the innermost scratch() ends, or the one around that if it `outlives` it; at the end of the process where there is none."""
    open_ = _open.get()
    (open_[-1 - outlives] if len(open_) > outlives else _left).append(Path(spark._jvm, spark._jsc.hadoopConfiguration(), name))
    return name


def saved(df: DataFrame, outlives: bool = False) -> DataFrame:
    """The rows as a table in the shared folder, owned(); lineage ends there."""
    spark = df.sparkSession
    path = owned(spark, f"{shared_dir(spark).rstrip('/')}/lexmill-{uuid.uuid4().hex}", outlives)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes what is saved inside once it ends; nothing lazy that reads it may be returned."""
    own: list[Path] = []
    token = _open.set((*_open.get(), own))
    try:
        yield
    finally:
        _open.reset(token)
        for path in own:
            path.delete()


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def learns(doc_id: Column) -> Column:
    """True for documents whose labels may be learnt from: crc32(doc_id as text) mod 4 is not 2."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 != 2, F.lit(False))


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def mapped(df: DataFrame, schema: str, rows: Callable[[Iterator[dict]], Iterator[tuple]], size: int = 512) -> DataFrame:
    """mapInArrow over Python tuples: `rows` gets an iterator of column-name -> value dicts and yields tuples of `schema`."""
    fields = df.sparkSession.createDataFrame([], schema).schema
    names = fields.names
    from pyspark.sql.pandas.types import to_arrow_schema

    arrow = to_arrow_schema(fields)

    def batch(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), arrow.types, strict=True)], schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = chain.from_iterable(b.to_pylist() for b in batches)
        out: list[tuple] = []
        for row in rows(each):
            out.append(row)
            if len(out) >= size:
                yield batch(out)
                out = []
        if out:
            yield batch(out)

    assert len(names) == len(arrow.names)
    return df.mapInArrow(run, fields)
