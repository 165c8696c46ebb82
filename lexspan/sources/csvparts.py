"""A sink of ordered CSV parts: frame.write.format("csv_parts").mode("overwrite").save(folder).

Each task writes its own part under a name that no other attempt has; the commit renames what the successful attempts wrote
to part-00000.csv, part-00001.csv, ... in the order of the frame's partitions, and removes what was there before. Only the
first part has the header. So the parts of a sorted frame, end to end, are the bytes of one sorted file, and no task writes
it all. An aborted write leaves the folder as it was.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import Row

from lexspan.sources import files

#: Rows that are formatted together.
TOGETHER = 4096


@dataclass
class Part(WriterCommitMessage):
    order: int
    name: str


class CsvPartsWriter(DataSourceWriter):
    def __init__(self, folder: str, names: list[str], overwrite: bool):
        self.folder, self.names, self.overwrite = folder, names, overwrite

    def write(self, iterator: Iterator[Row]) -> Part:
        order = TaskContext.get().partitionId()
        name = files.unique(f".part-{order:05d}")
        fs, path = files.opened(self.folder)
        fs.create_dir(path)
        buffer = io.StringIO()
        lines = csv.writer(buffer, lineterminator="\r\n")
        if order == 0:
            lines.writerow(self.names)
        try:
            with fs.open_output_stream(f"{path}/{name}") as out:
                for k, row in enumerate(iterator):
                    lines.writerow(row)
                    if k % TOGETHER == TOGETHER - 1:
                        out.write(buffer.getvalue().encode())
                        buffer.seek(0)
                        buffer.truncate()
                out.write(buffer.getvalue().encode())
        except BaseException:
            fs.delete_file(f"{path}/{name}")
            raise
        return Part(order, name)

    def _there(self, begins: str) -> list[str]:
        fs, path = files.opened(self.folder)
        found = fs.get_file_info(pafs.FileSelector(path, allow_not_found=True))
        return sorted(f.base_name for f in found if f.base_name.startswith(begins))

    def commit(self, messages: list[Part | None]) -> None:
        fs, path = files.opened(self.folder)
        old = self._there("part-")
        if old and not self.overwrite:
            self.abort(messages)
            raise ValueError(f"{self.folder} has parts already")
        for name in old:
            fs.delete_file(f"{path}/{name}")
        for k, part in enumerate(sorted((m for m in messages if m), key=lambda m: m.order)):
            fs.move(f"{path}/{part.name}", f"{path}/part-{k:05d}.csv")
        for name in self._there(".part-"):  # of attempts that were lost
            fs.delete_file(f"{path}/{name}")
        with fs.open_output_stream(f"{path}/_SUCCESS"):
            pass

    def abort(self, messages: list[Part | None]) -> None:
        fs, path = files.opened(self.folder)
        for part in messages:
            if part:
                fs.delete_file(f"{path}/{part.name}")


class CsvPartsSink(DataSource):
    @classmethod
    def name(cls) -> str:
        return "csv_parts"

    def schema(self) -> str:
        raise ValueError("csv_parts only writes; read its folder with Spark's csv source")

    def writer(self, schema, overwrite: bool) -> CsvPartsWriter:
        return CsvPartsWriter(self.options["path"], schema.names, overwrite)
