"""Bank files as Spark data sources: spark.read.format("tally_csv" | "tally_ofx" | "tally_pdf").load(folder), after `register(spark)`.

Each gives raw rows, as the files have them; `transactions` makes typed ones of them by column expressions. Files are listed once, a folder at a time, packed to partitions of about
PART_BYTES or PART_FILES, and read where the tasks run, through pyarrow's file systems (local, hdfs, s3 and others, by the path's scheme). Conditions on source_file (equal, one of,
begins with) are pushed down to the list of files. The driver holds the names of a partition's files compressed, a few bytes each. A file that can't be read gives one row that says why.

"tally_files" writes rows (path, content) as files below a folder, and reads them again. Each task writes to a folder of its own beside, with a list of the files' places, and
the driver moves the files there when all tasks are done, a list at a time, so a task that runs twice leaves one file."""

from __future__ import annotations

import csv
import io
import itertools
import json
import os
import re
import uuid
import zlib
from collections.abc import Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, In, InputPartition, StringStartsWith, WriterCommitMessage

from . import csv_files, ofx, pdf, pdf_lines

PART_BYTES, PART_FILES, BATCH_ROWS = 32 << 20, 20_000, 10_000
#: What a task's own folder begins with, and the files that the driver moves at a time, by so many threads.
WRITING, MOVES, THREADS = "_writing-", 10_000, 16
CSV_FIELDS = ["date", "amount", "debit", "credit", "description", "account", "transaction_id", "balance", "transaction_type"]


class Files(InputPartition):
    """Paths of files, compressed: the driver has those of all partitions."""

    def __init__(self, paths: list[str]) -> None:
        self.packed = zlib.compress("\0".join(paths).encode("utf-8", "surrogateescape"))

    @property
    def paths(self) -> list[str]:
        found = zlib.decompress(self.packed).decode("utf-8", "surrogateescape")
        return found.split("\0") if found else []


def _system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def plain(path: str) -> str:
    """path as the rows have it, without scheme."""
    return _system(path)[1]


def listed(system: fs.FileSystem, root: str, recursive: bool) -> Iterator[tuple[str, int]]:
    """Paths and sizes of the files of a folder, one after another; other stores than local disks list each folder whole."""
    folders = [root]
    while folders:
        folder = folders.pop()
        if isinstance(system, fs.LocalFileSystem):
            with os.scandir(folder) as entries:
                for e in entries:
                    if not e.is_dir():
                        if e.is_file():
                            yield f"{folder.rstrip('/')}/{e.name}", e.stat().st_size
                    elif recursive and not e.name.startswith(WRITING):
                        folders.append(f"{folder.rstrip('/')}/{e.name}")
            continue
        for i in system.get_file_info(fs.FileSelector(folder)):
            if i.is_file:
                yield i.path, i.size
            elif recursive and not i.base_name.startswith(WRITING):
                folders.append(i.path)


class Reader(DataSourceReader):
    """Rows of a folder's files with some endings. `rows` turns a file into rows; the first column is its path."""

    def __init__(self, options: dict, schema: pa.Schema, endings: tuple[str, ...], rows) -> None:
        self.path, self.schema, self.endings, self.rows = options["path"], schema, endings, rows
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.wanted: list = []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        column = self.schema.names[0]
        for f in filters:
            if isinstance(f, (EqualTo, In, StringStartsWith)) and f.attribute == (column,):
                self.wanted.append(f)
            else:
                yield f

    def _is_wanted(self, path: str) -> bool:
        return all(path == f.value if isinstance(f, EqualTo) else path in f.value if isinstance(f, In) else path.startswith(f.value) for f in self.wanted)

    def partitions(self) -> list[Files]:
        system, root = _system(self.path)
        out, paths, held = [], [], 0
        for path, size in listed(system, root, self.recursive):
            if not size or not path.lower().endswith(self.endings) or not self._is_wanted(path):
                continue
            if paths and (held + size > PART_BYTES or len(paths) == PART_FILES):
                out.append(Files(paths))
                paths, held = [], 0
            paths.append(path)
            held += size
        return [*out, Files(paths)] if paths or not out else out

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        system, _ = _system(self.path)
        held: list[tuple] = []
        for path in partition.paths:
            with system.open_input_stream(path) as f:
                for row in self.rows(f):
                    held.append((path, *row))
                    if len(held) == BATCH_ROWS:
                        yield self._batch(held)
                        held = []
        if held:
            yield self._batch(held)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), self.schema.types, strict=True)], schema=self.schema)


def _csv_rows(f: io.RawIOBase) -> Iterator[tuple]:
    """(line_no, CSV_FIELDS, problem)."""
    try:
        lines = csv.reader(io.TextIOWrapper(f, encoding="utf-8-sig", errors="replace", newline=""))
        names = next(lines, [])
        mapping = csv_files.mapped(names)
        if lack := csv_files.missing(mapping):
            yield 0, *[None] * len(CSV_FIELDS), f"missing columns: {', '.join(lack)}"
            return
        at = [names.index(mapping[c]) if c in mapping else None for c in CSV_FIELDS]
        n = 0
        for row in lines:
            if row:
                n += 1
                yield n, *[row[i] if i is not None and i < len(row) else None for i in at], None
    except csv.Error as e:
        yield 0, *[None] * len(CSV_FIELDS), str(e)


_STATEMENT = re.compile(r"<(?:CC)?STMTRS>.*?(?=<(?:CC)?STMTRS>|\Z)", re.S | re.I)
_TRANSACTION = re.compile(r"<STMTTRN>(.*?)(?=</STMTTRN>|<STMTTRN>|</BANKTRANLIST>|\Z)", re.S | re.I)


def _ofx_rows(f: io.RawIOBase) -> Iterator[tuple]:
    """(line_no, statement, transaction): the text before a statement's transactions, and that of each."""
    text = f.read().decode("utf-8", "replace")
    if any(m in text[:1024] for m in ofx.MARKS):
        for nth, m in enumerate(_STATEMENT.finditer(text)):
            head = re.split("<STMTTRN>", m[0], maxsplit=1, flags=re.I)[0]
            for row, t in enumerate(_TRANSACTION.findall(m[0])):
                yield nth * 1_000_000 + row + 1, head, t


def _pdf_rows(f: io.RawIOBase) -> Iterator[tuple]:
    try:
        yield from pdf.rows_of(f.read())
    except Exception as e:  # whatever is broken in a file is that file's error
        yield 0, 0, "error", None, None, None, f"{type(e).__name__}: {e}"


_s, _i, _texts = pa.string(), pa.int32(), pa.list_(pa.string())
KINDS = {
    "tally_csv": (pa.schema([("source_file", _s), ("line_no", _i), *[(c, _s) for c in CSV_FIELDS], ("problem", _s)]), (".csv",), _csv_rows),
    "tally_ofx": (pa.schema([("source_file", _s), ("line_no", _i), ("statement", _s), ("transaction", _s)]), (".qfx", ".ofx"), _ofx_rows),
    "tally_pdf": (pa.schema([("path", _s), ("page", _i), ("line_no", _i), ("kind", _s), ("table_no", _i), ("header", _texts), ("cells", _texts), ("line", _s)]), (".pdf",), _pdf_rows),
    "tally_files": (pa.schema([("path", _s), ("content", pa.binary())]), ("",), lambda f: [(f.read(),)]),
}


@dataclass
class Written(WriterCommitMessage):
    """A task's own folder: files 0, 1, 2, ... and a list of their places, a line of JSON each."""

    folder: str


class Writer(DataSourceWriter):
    def __init__(self, options: dict) -> None:
        self.path = options["path"].rstrip("/")

    def write(self, rows: Iterator) -> Written:
        system, root = _system(self.path)
        folder = f"{root}/{WRITING}{uuid.uuid4().hex}"
        system.create_dir(folder, recursive=True)
        made = set()
        with system.open_output_stream(f"{folder}/places") as places:
            for n, r in enumerate(rows):
                place = f"{root}/{r['path']}"
                above = place.rsplit("/", 1)[0]
                if above not in made:
                    system.create_dir(above, recursive=True)
                    made = made | {above} if len(made) < MOVES else {above}
                with system.open_output_stream(f"{folder}/{n}") as f:
                    f.write(r["content"] or b"")
                places.write(json.dumps(place).encode() + b"\n")
        return Written(folder)

    def commit(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        with ThreadPoolExecutor(THREADS) as pool:
            for m in filter(None, messages):
                with system.open_input_stream(f"{m.folder}/places") as f:
                    # the last of equal places stays, as the files are moved in order of each place
                    moves = ((f"{m.folder}/{n}", json.loads(line)) for n, line in enumerate(io.TextIOWrapper(f, encoding="utf-8")))
                    while some := list(itertools.islice(moves, MOVES)):
                        last = {place: beside for beside, place in some}
                        list(pool.map(system.move, last.values(), last))
                system.delete_dir(m.folder)

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = _system(self.path)
        for m in filter(None, messages):
            system.delete_dir(m.folder)


def _source(kind: str) -> type[DataSource]:
    fields, endings, rows = KINDS[kind]

    class Source(DataSource):
        @classmethod
        def name(cls) -> str:
            return kind

        def schema(self) -> str:
            ddl = {_s: "string", _i: "int", _texts: "array<string>", pa.binary(): "binary"}
            return ", ".join(f"`{f.name}` {ddl[f.type]}" for f in fields)

        def reader(self, schema) -> Reader:
            return Reader(self.options, fields, endings, rows)

        def writer(self, schema, overwrite: bool) -> Writer:
            if kind != "tally_files" or overwrite:
                raise ValueError(f"{kind} can't be written in this mode")
            return Writer(self.options)

    return Source


def register(spark: SparkSession) -> None:
    """Make the sources known to the session, and let conditions on paths reach them."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    for kind in KINDS:
        spark.dataSource.register(_source(kind))


def transactions(rows: DataFrame, kind: str, this_year: int) -> DataFrame:
    """Transactions and their problems of the raw rows of tally_csv, tally_ofx or tally_pdf."""
    if kind == "tally_csv":
        fine = csv_files.projected(rows.where("problem is null"), {c: c for c in CSV_FIELDS})
        bad = rows.where("problem is not null")
        return fine.unionByName(bad.select("source_file", "line_no", *[F.lit(None).cast(f.dataType).alias(f.name) for f in fine.schema if f.name not in ("source_file", "line_no", "problem")], "problem"))
    if kind == "tally_ofx":
        return ofx.projected(rows.select("source_file", "line_no", ofx.account(F.col("statement")).alias("account"), F.col("transaction").alias("t")))
    return pdf_lines.of_rows(rows, this_year)
