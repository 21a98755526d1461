"""The data source ``document``: ``spark.read.format("document").load(folder)`` over txt, md, docx and pdf files.

Options: ``path`` (a file or a folder, which is searched with its folders; a local or shared path, or a URI that pyarrow opens),
``bytesPerPartition`` (files are dealt to partitions of about this size, a larger file alone), ``onError`` (``fail``, or ``row``: a file that
cannot be read is a row with its error and without content)."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

SCHEMA = "path string, label string, content string, content_type string, bytes bigint, error string"


@dataclass
class Files(InputPartition):
    paths: list[tuple[str, int]]


class DocumentReader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path = options.get("path")
        if not self.path:
            raise ValueError("the data source needs a path")
        self.most = int(options.get("bytesPerPartition", 64 << 20))
        self.keep = options.get("onError", "fail") == "row"

    def _opened(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.path) if ":/" in self.path else (fs.LocalFileSystem(), self.path)

    def partitions(self) -> list[Files]:
        from pyarrow import fs

        store, path = self._opened()
        info = store.get_file_info(path)
        if info.type == fs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        found = [info] if info.is_file else store.get_file_info(fs.FileSelector(path, recursive=True))
        out: list[Files] = [Files([])]
        size = 0
        for f in sorted((f for f in found if f.is_file and not f.base_name.startswith((".", "_"))), key=lambda f: f.path):
            if out[-1].paths and size + f.size > self.most:
                out.append(Files([]))
                size = 0
            out[-1].paths.append((f.path, f.size))
            size += f.size
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        from casegrid.sources.files import text_of
        from casegrid.sources.pdf import page_texts

        store, _ = self._opened()
        for path, size in partition.paths:
            label = path.rsplit("/", 1)[-1]
            try:
                with store.open_input_stream(path) as f:
                    content, kind = text_of(label, f.read(), page_texts)
                yield path, label, content, kind, size, None
            except Exception as e:
                if not self.keep:
                    raise
                yield path, label, None, None, size, f"{type(e).__name__}: {e}"


class DocumentSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> DocumentReader:
        return DocumentReader(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentSource)
