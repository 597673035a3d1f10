"""A pluggable source: list documents, fetch one, parse it; as a Spark data source.

A port says what there is (``list_documents``), brings the raw form of one listed part
(``fetch_raw``) and makes records of it (``parse``). Spark reads a port through one data source:
a partition a listed part, fetched and parsed in the task that reads it, so nothing passes the
driver but the list. What can't be fetched or parsed is a row with a reason. The stream form
reads parts in the order of the list; its offset is how many it has seen.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "external_id string, title string, body string, content_sha256 string, reason string"


@dataclass
class Ref(InputPartition):
    """A listed part: a file and a row group in it."""

    file: str
    group: int

    def __post_init__(self) -> None:
        super().__init__((self.file, self.group))


class TablePort:
    """Documents of a Parquet table: an id column and a text column."""

    def __init__(self, path: str, id_col: str, text_col: str):
        self.path, self.id_col, self.text_col = path, id_col, text_col

    def _store(self) -> tuple[fs.FileSystem, str]:
        return fs.FileSystem.from_uri(self.path) if "://" in self.path or self.path.startswith("file:") else (fs.LocalFileSystem(), self.path)

    def list_documents(self) -> list[Ref]:
        """Row groups of all files, by name; only footers are read."""
        store, at = self._store()
        info = store.get_file_info(at)
        found = [info] if info.type == fs.FileType.File else store.get_file_info(fs.FileSelector(at, recursive=True))
        files = sorted(x.path for x in found if x.type == fs.FileType.File and not x.base_name.startswith(("_", ".")))
        out = []
        for file in files:
            try:
                with store.open_input_file(file) as f:
                    out += [Ref(file, g) for g in range(pq.ParquetFile(f).num_row_groups)]
            except (pa.ArrowInvalid, OSError):
                out.append(Ref(file, -1))
        return out

    def fetch_raw(self, ref: Ref) -> Iterator[tuple[str | None, str | None]]:
        """Ids and texts of a part, a bounded batch at a time."""
        store, _ = self._store()
        with store.open_input_file(ref.file) as f:
            for batch in pq.ParquetFile(f).iter_batches(batch_size=1000, row_groups=[ref.group], columns=[self.id_col, self.text_col]):
                for i, text in zip(batch.column(self.id_col).to_pylist(), batch.column(self.text_col).to_pylist(), strict=True):
                    yield None if i is None else str(i), text

    @staticmethod
    def parse(external_id: str | None, text: str | None) -> tuple:
        """A record: the first line is the title, the rest the body; or a reason."""
        if external_id is None:
            return None, None, None, None, "NO_ID"
        if text is None:
            return external_id, None, None, None, "NO_TEXT"
        title, _, body = text.partition("\n")
        reason = "NO_WORDS" if not text.strip() else "NO_BODY" if not body.strip() else None
        if reason:
            return external_id, None, None, None, reason
        return external_id, title, body, hashlib.sha256(text.encode()).hexdigest(), None

    def records(self, ref: Ref) -> Iterator[tuple]:
        """Records of a part; a part that can't be read is one row."""
        try:
            for external_id, text in self.fetch_raw(ref):
                yield self.parse(external_id, text)
        except (pa.ArrowInvalid, OSError, KeyError) as e:
            yield None, None, None, None, f"UNREADABLE_PART:{ref.file.rsplit('/', 1)[-1]}:{type(e).__name__}"


def _port(options: dict) -> TablePort:
    return TablePort(options["path"], options.get("id", "doc_id"), options.get("text", "text"))


class PortReader(DataSourceReader):
    def __init__(self, port: TablePort):
        self.port = port

    def partitions(self) -> list[Ref]:
        return self.port.list_documents()

    def read(self, partition: Ref) -> Iterator[tuple]:
        return self.port.records(partition)


class PortStreamReader(DataSourceStreamReader):
    def __init__(self, port: TablePort):
        self.port = port

    def initialOffset(self) -> dict:
        return {"parts": 0}

    def latestOffset(self) -> dict:
        return {"parts": len(self.port.list_documents())}

    def partitions(self, start: dict, end: dict) -> list[Ref]:
        return self.port.list_documents()[start["parts"] : end["parts"]]

    def read(self, partition: Ref) -> Iterator[tuple]:
        return self.port.records(partition)


class PortSource(DataSource):
    """Format ``corpus_port``; options path, id, text."""

    @classmethod
    def name(cls) -> str:
        return "corpus_port"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> PortReader:
        return PortReader(_port(self.options))

    def streamReader(self, schema) -> PortStreamReader:
        return PortStreamReader(_port(self.options))


def read_port(spark: SparkSession, path: str, id_col: str = "doc_id", text_col: str = "text", stream: bool = False) -> DataFrame:
    """Records of a table through the port."""
    spark.dataSource.register(PortSource)
    reader = spark.readStream if stream else spark.read
    return reader.format("corpus_port").option("path", path).option("id", id_col).option("text", text_col).load()
