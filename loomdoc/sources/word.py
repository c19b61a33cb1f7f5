"""Word documents as a data source of Spark: ``register(spark)``, then ``spark.read.format("word_blocks").load(path)``."""

from __future__ import annotations

import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition

from .files import docx_blocks

BLOCKS = "path string, block_idx int, text string, font_size double, is_table boolean, error string"
SCHEMA = pa.schema([("path", pa.string()), ("block_idx", pa.int32()), ("text", pa.string()), ("font_size", pa.float64()), ("is_table", pa.bool_()), ("error", pa.string())])
#: Bytes and files of a partition, unless the options ``partitionBytes`` and ``partitionFiles`` say otherwise.
PARTITION_BYTES, PARTITION_FILES = 64 << 20, 1000


@dataclass
class Files(InputPartition):
    paths: list[str]


def _store(path: str) -> tuple[fs.FileSystem, str]:
    """The store that a URI or an absolute path names, and the path in it."""
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else "file://" + path)


class WordReader(DataSourceReader):
    """Splits are files packed up to a size, so small files share a task; conditions on ``path`` choose files before any is opened."""

    def __init__(self, path: str, most_bytes: int, most_files: int) -> None:
        self.path, self.most_bytes, self.most_files = path, most_bytes, most_files
        self.wanted: set[str] | None = None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            values = {f.value} if isinstance(f, EqualTo) else set(f.value) if isinstance(f, In) else None
            if values is None or f.attribute != ("path",):
                yield f
            else:
                self.wanted = values if self.wanted is None else self.wanted & values

    def partitions(self) -> list[Files]:
        store, root = _store(self.path)
        info = store.get_file_info(root)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        infos = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(root, recursive=True))
        found = sorted((i.path, i.size or 0) for i in infos if i.type == fs.FileType.File and i.path.lower().endswith(".docx"))
        out: list[Files] = []
        size = 0
        for path, n in found:
            if self.wanted is not None and path not in self.wanted:
                continue
            if not out or len(out[-1].paths) >= self.most_files or size + n > self.most_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(path)
            size += n
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        store, _ = _store(self.path)
        # a batch a file: a task holds one document at a time
        for path in partition.paths:
            with store.open_input_stream(path) as f:
                rows = blocks_of(path, f.read())
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], f.type) for j, f in enumerate(SCHEMA)], schema=SCHEMA)


class WordBlocks(DataSource):
    """Blocks of the ``.docx`` files below a folder, or of one file: ``path`` (in its store, without the scheme), ``block_idx``, ``text``, ``font_size``, ``is_table``, ``error``.

    A damaged file gives one row with an error and no block; one without blocks gives no row; other kinds of files are left out."""

    @classmethod
    def name(cls) -> str:
        return "word_blocks"

    def schema(self) -> str:
        return BLOCKS

    def reader(self, schema) -> WordReader:
        return WordReader(self.options["path"], int(self.options.get("partitionBytes", PARTITION_BYTES)), int(self.options.get("partitionFiles", PARTITION_FILES)))


def register(spark: SparkSession) -> None:
    """Makes the source known to a session, and lets it take filters (off by default in Spark)."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(WordBlocks)


def blocks_of(path: str | None, data: bytes | None) -> list[tuple]:
    """Rows of the source for one file."""
    try:
        return [(path, i, *b, None) for i, b in enumerate(docx_blocks(data or b""))]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError) as e:
        return [(path, None, None, None, None, f"{type(e).__name__}: {e}")]
