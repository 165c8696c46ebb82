"""A source of text folders: spark.read.format("text_folder").load(folder) gives (documento_id, text) of every *.txt in it.

Unlike Spark's file sources it has empty files and names that begin with a dot or underscore. The driver only lists names;
a partition is a group of files of about `group_bytes` in all (an empty file counts as file_bytes), which an executor reads.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from lexspan.sources import files

END = ".txt"
GROUP_BYTES, FILE_BYTES, BATCH_CHARS = 64 << 20, 64 << 10, 4 << 20


class Files(InputPartition):
    def __init__(self, names: list[str]):
        self.names = names


class TextFolderReader(DataSourceReader):
    def __init__(self, options: dict):
        self.folder = options["path"]
        self.group = int(options.get("group_bytes", GROUP_BYTES))

    def partitions(self) -> list[Files]:
        out, size = [], self.group
        for name, n in files.names(self.folder, END):
            if size >= self.group:
                out.append(Files([]))
                size = 0
            out[-1].names.append(name)
            size += max(n, FILE_BYTES)
        return out or [Files([])]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        ids, texts, size = [], [], 0
        for name in partition.names:
            ids.append(name[: -len(END)])
            texts.append(files.read(self.folder, name).decode("utf-8", "replace").replace("\r\n", "\n").replace("\r", "\n"))
            size += len(texts[-1])
            if size > BATCH_CHARS:
                yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["documento_id", "text"])
                ids, texts, size = [], [], 0
        if ids:
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(texts)], ["documento_id", "text"])


class TextFolderSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "text_folder"

    def schema(self) -> str:
        return "documento_id string, text string"

    def reader(self, schema) -> TextFolderReader:
        return TextFolderReader(dict(self.options))
