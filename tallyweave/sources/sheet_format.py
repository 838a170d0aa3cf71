"""Workbooks as a data source: spark.read.format("sheet") and df.write.format("sheet").

    spark.dataSource.register(SheetSource)
    spark.read.format("sheet").option("sheet", "input").load("/data/tables")
    save_sheets(results, "/data/results", ["row_ord"])

Paths are local or mounted folders, or any store that pyarrow opens by address. For others, `sheet.read_sheets` reads
workbooks through Spark's own files.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby
from urllib.parse import quote, unquote

from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import LongType, StringType, StructType

from tallyweave.sources.sheet import deduplicated, sheet_bytes, sheet_rows

OWN = ("batch_id", "row_ord")
PARTIAL = "_partial"


def opened(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path or address, and the path within it."""
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def workbooks(path: str) -> list[fs.FileInfo]:
    """The .xlsx files at a path: those of a folder, in order of names, or the one file."""
    files, at = opened(path)
    info = files.get_file_info(at)
    if info.type == fs.FileType.NotFound:
        raise ValueError(f"no such path: {path}")
    found = files.get_file_info(fs.FileSelector(at)) if info.type == fs.FileType.Directory else [info]
    return sorted((x for x in found if x.type == fs.FileType.File and x.base_name.lower().endswith(".xlsx") and x.base_name[0] not in "._~"), key=lambda x: x.path)


@dataclass
class Workbook(InputPartition):
    path: str


class SheetReader(DataSourceReader):
    """A partition a workbook, opened where its task runs."""

    def __init__(self, schema: StructType, options: dict[str, str]):
        self.path, self.columns = options["path"], schema.names
        self.sheet, self.most = sheet_of(options), int(options.get("maxbytes", 16 << 20))

    def partitions(self) -> list[Workbook]:
        found = workbooks(self.path)
        if large := [x.path for x in found if x.size > self.most]:
            raise ValueError(f"larger than {self.most} bytes: {', '.join(large)}")
        return [Workbook(x.path) for x in found]

    def read(self, partition: Workbook | None) -> Iterator[tuple]:
        if partition is None:  # what Spark reads where there is no workbook
            return
        rows = rows_of(opened(self.path)[0], partition.path, self.sheet)
        head = deduplicated(next(rows, []))
        name = unquote(partition.path.rpartition("/")[2])
        for i, row in enumerate(rows):
            cells = dict(zip(head, row, strict=False)) | {"batch_id": name, "row_ord": i}
            yield tuple(cells.get(c, "") for c in self.columns)


def sheet_of(options: dict[str, str]) -> str | int:
    named = options.get("sheet", "0")
    return int(named) if named.isdigit() else named


def rows_of(files: fs.FileSystem, path: str, sheet: str | int) -> Iterator[list[str]]:
    with files.open_input_file(path) as f:
        return sheet_rows(f.read(), sheet)


@dataclass
class Written(WriterCommitMessage):
    """The workbooks of one task's last attempt: (name, where it lies for now)."""

    files: list[tuple[str, str]]


class SheetWriter(DataSourceWriter):
    """A workbook a batch. Tasks write beside the results, under names of their own; only when all are done are the files moved.

    So a task that fails, or runs twice, leaves nothing among the results: its files are not among those that are moved,
    and go with the run's folder for what isn't done (all but what a task writes after the run has failed).
    """

    def __init__(self, schema: StructType, options: dict[str, str], overwrite: bool):
        self.path, self.names, self.overwrite, self.run = options["path"], schema.names, overwrite, uuid.uuid4().hex
        if "batch_id" not in self.names:
            raise ValueError("a column batch_id tells which workbook a row goes to")

    def write(self, iterator: Iterator) -> Written:
        files, at = opened(self.path)
        folder, done = f"{at}/{PARTIAL}/{self.run}/{uuid.uuid4().hex}", []
        files.create_dir(folder)
        batch, columns = self.names.index("batch_id"), [i for i, c in enumerate(self.names) if c not in OWN]
        for key, rows in groupby(iterator, lambda row: row[batch]):
            name = quote("" if key is None else str(key), safe=" ") + ".xlsx"
            if name in {n for n, _ in done}:
                raise ValueError(f"the rows of batch {key} aren't next to each other")
            content = sheet_bytes([self.names[i] for i in columns], ([row[i] for i in columns] for row in rows))
            with files.open_output_stream(f"{folder}/{name}") as f:
                f.write(content)
            done.append((name, f"{folder}/{name}"))
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, at = opened(self.path)
        done = [x for m in messages if m is not None for x in m.files]
        names = [n for n, _ in done]
        if twice := sorted({n for n in names if names.count(n) > 1}) if len(set(names)) < len(names) else []:
            self.abort(messages)
            raise ValueError(f"rows of one batch in several tasks: {', '.join(twice)}")
        old = [x.path for x in workbooks(self.path) if x.base_name not in set(names)] if self.overwrite else []
        for name, lies in done:
            files.move(lies, f"{at}/{name}")
        for path in old:
            files.delete_file(path)
        self._clear()

    def abort(self, messages: list[Written | None]) -> None:
        self._clear()

    def _clear(self) -> None:
        files, at = opened(self.path)
        own, all_ = f"{at}/{PARTIAL}/{self.run}", f"{at}/{PARTIAL}"
        if files.get_file_info(own).type == fs.FileType.Directory:
            files.delete_dir(own)
        if files.get_file_info(all_).type == fs.FileType.Directory and not files.get_file_info(fs.FileSelector(all_)):
            files.delete_dir(all_)


class SheetSource(DataSource):
    """Options: path; sheet, by name or number (the first); maxBytes of a workbook.

    Without a schema, the columns are batch_id (the file's name), row_ord, and the headers of the first workbook, all
    texts; a workbook that lacks one has '' there. A path without workbooks has the first two alone.
    """

    @classmethod
    def name(cls) -> str:
        return "sheet"

    def schema(self) -> StructType:
        out = StructType().add("batch_id", StringType()).add("row_ord", LongType())
        for book in workbooks(self.options["path"])[:1]:
            for header in deduplicated(next(rows_of(opened(self.options["path"])[0], book.path, sheet_of(self.options)), [])):
                if header not in OWN:
                    out = out.add(header, StringType())
        return out

    def reader(self, schema: StructType) -> SheetReader:
        return SheetReader(schema, self.options)

    def writer(self, schema: StructType, overwrite: bool) -> SheetWriter:
        return SheetWriter(schema, self.options, overwrite)


def save_sheets(df: DataFrame, path: str, order: list[str], mode: str = "append") -> None:
    """Writes one styled workbook for each batch_id into a folder, its rows in order; a batch is one file's rows, and lies in one task."""
    df.sparkSession.dataSource.register(SheetSource)
    df.repartition("batch_id").sortWithinPartitions("batch_id", *order).write.format("sheet").mode(mode).save(path)
