"""What the operators of this folder share: the shared folder, written cuts of the lineage, Arrow batches."""

from __future__ import annotations

import tempfile
import time
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
import pyarrow.compute  # noqa: F401
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_own: list[str] = []
#: Seconds between two looks of the collector, and when the last was.
FREE_SECONDS = 5.0
_freed = [0.0]
#: Tables written in the innermost ``cleared`` block.
_made: ContextVar[list[DataFrame] | None] = ContextVar("made", default=None)


def shared_dir(spark: SparkSession, label: str) -> str:
    """A new folder name under ``spark.checkpoint.dir``, which driver and executors share (or the context's checkpoint folder).

    Only in local mode, where the session sets no such folder, is a local one made; on a cluster that is an error."""
    context = spark.sparkContext
    base = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if not base:
        if not context.master.startswith("local") or context.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        if not _own:
            _own.append("file://" + tempfile.mkdtemp(prefix="spark-llm-"))
        base = _own[0]
    return f"{base.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder, read back: cuts the lineage, and outlives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark, label)
    df.write.option("compression", "zstd").parquet(path)
    # the shuffles behind the table are done with; Spark removes their files once the driver's collector has seen that
    if time.monotonic() - _freed[0] > FREE_SECONDS:
        spark.sparkContext._jvm.java.lang.System.gc()
        _freed[0] = time.monotonic()
    out = spark.read.schema(df.schema).parquet(path)
    out._written_at = path
    if (made := _made.get()) is not None:
        made.append(out)
    return out


def removed(table: DataFrame) -> None:
    """Deletes the files of a table that ``written`` gave, once nothing reads it any more."""
    spark = table.sparkSession
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(table._written_at)
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


@contextmanager
def cleared() -> Iterator[list[DataFrame]]:
    """Deletes the tables that ``written`` made in the block, unless they are taken out of the list it gives. Nothing that is
    read after the block may depend on them."""
    made: list[DataFrame] = []
    token = _made.set(made)
    try:
        yield made
    finally:
        _made.reset(token)
        for table in made:
            removed(table)


def batch(schema: pa.Schema, columns: dict[str, list]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) for f in schema], schema=schema)


def texts(column: pa.Array) -> list[str]:
    """The strings of a column; null counts as empty."""
    return [x if x is not None else "" for x in column.to_pylist()]


def slices(batches: Iterable[pa.RecordBatch], most: int = 4_000_000, name: str = "text") -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``most`` bytes of column ``name``, so a task holds little at once."""
    for b in batches:
        size, start = 0, 0
        column = b.column(b.schema.get_field_index(name))
        if column.nbytes <= most:
            if b.num_rows:
                yield b
            continue
        for i, n in enumerate(pa.compute.binary_length(column).to_pylist()):
            size += n or 0
            if size >= most:
                yield b.slice(start, i + 1 - start)
                size, start = 0, i + 1
        if start < b.num_rows:
            yield b.slice(start)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def free_name(df: DataFrame, name: str) -> str:
    """``name``, or with underscores added until ``df`` has no such column."""
    have = {c.lower() for c in df.columns}
    while name.lower() in have:
        name += "_"
    return name


def text_of(name: str = "text"):
    return F.coalesce(F.col(name), F.lit(""))
