"""CSV files with differing headers as one scan: a data source whose partitions are file ranges.

A reader that takes one header for all files shifts columns when a column was added later,
and a union of one reader per file grows the plan with the files. Here every range is read
by the header of its own file and gives the wanted columns by name, as text.
"""

from __future__ import annotations

import csv
import io
import json
import os
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from fnmatch import fnmatch

import pyarrow as pa
import pyarrow.csv as pc
import pyarrow.fs as pf
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

RANGE_BYTES = 64 << 20
BLOCK_BYTES = 4 << 20
PACKED = (".gz", ".bz2", ".zst")


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int | None  # None: to the end of a packed file, which cannot be entered midway


def _place(path: str):
    """File system and its own name of a path or URI."""
    if re.match(r"\w+:/", path):
        return pf.FileSystem.from_uri(path)
    return pf.LocalFileSystem(), path


def list_files(path: str) -> list[tuple[str, int]]:
    """Files of a path, a folder, or a pattern in the last path element, with their sizes."""
    folder, name = os.path.split(path)
    if not any(c in name for c in "*?["):
        fs, place = _place(path)
        info = fs.get_file_info(place)
        if info.type == pf.FileType.NotFound:
            raise FileNotFoundError(path)
        if info.is_file:
            return [(path, info.size)]
        folder, name = path, "*"
    fs, place = _place(folder or ".")
    found = [i for i in fs.get_file_info(pf.FileSelector(place)) if i.is_file
             and not i.base_name.startswith(("_", ".")) and fnmatch(i.base_name, name)]
    return sorted((os.path.join(folder, i.base_name), i.size) for i in found)


def _open(path: str):
    fs, place = _place(path)
    return fs.open_input_stream(place) if path.endswith(PACKED) else fs.open_input_file(place)


def _blocks(stream, size: int | None) -> Iterator[bytes]:
    """Whole lines in blocks of bounded bytes: those that start in the next ``size`` bytes.

    A line longer than a block makes that block longer.
    """
    rest, at = b"", 0
    while True:
        data = stream.read(BLOCK_BYTES)
        rest += data
        if size is not None and at + len(rest) >= size:
            stop = rest.find(b"\n", max(size - 1 - at, 0))  # end of the line that holds the last byte
            if stop >= 0 or not data:
                yield rest if stop < 0 else rest[:stop + 1]
                return
            continue
        if not data:
            if rest:
                yield rest
            return
        cut = rest.rfind(b"\n") + 1
        if cut:
            yield rest[:cut]
            rest, at = rest[cut:], at + cut


def _first_line(stream) -> bytes:
    line = b""
    while b"\n" not in line:
        data = stream.read(1 << 16)
        if not data:
            break
        line += data
    return line.split(b"\n", 1)[0] + b"\n"


def parse_block(block: bytes, header: Sequence[str], wanted: Sequence[str]) -> pa.RecordBatch:
    """The wanted columns of some lines by name; absent columns and missing tails are null.

    A line with too few or too many fields is filled or cut; such lines come after the others
    of the block. Of headings that repeat, the first one counts.
    """
    names = [n if n and header.index(n) == i else f"_{i}" for i, n in enumerate(header)]
    have = [n for n in wanted if n in names]
    odd: list[str] = []

    def repair(row):
        odd.append(row.text)
        return "skip"

    table = pc.read_csv(
        io.BytesIO(block),
        read_options=pc.ReadOptions(column_names=names, use_threads=False, block_size=len(block) + 1),
        parse_options=pc.ParseOptions(invalid_row_handler=repair),
        convert_options=pc.ConvertOptions(
            column_types={n: pa.string() for n in names}, null_values=[""], strings_can_be_null=True))
    fixed = list(csv.reader(odd))
    columns = {}
    for n in have:
        at = names.index(n)
        late = pa.array([r[at] or None if at < len(r) else None for r in fixed], pa.string())
        columns[n] = pa.concat_arrays([*table[n].chunks, late])
    nothing = pa.nulls(table.num_rows + len(fixed), pa.string())
    return pa.RecordBatch.from_arrays([columns.get(n, nothing) for n in wanted], names=list(wanted))


class _Reader(DataSourceReader):
    def __init__(self, paths: list[str], wanted: list[str], range_bytes: int):
        self.paths, self.wanted, self.range_bytes = paths, wanted, range_bytes

    def partitions(self) -> list[FileRange]:
        out = []
        for given in self.paths:
            for path, size in list_files(given):
                if path.endswith(PACKED):
                    out.append(FileRange(path, 0, None))
                else:
                    out += [FileRange(path, a, min(a + self.range_bytes, size))
                            for a in range(0, size, self.range_bytes)]
        return out

    def read(self, part: FileRange) -> Iterator[pa.RecordBatch]:
        with _open(part.path) as stream:
            head = _first_line(stream).decode("utf-8-sig").strip("\r\n")
        header = [h.strip() for h in next(csv.reader([head]), [])]
        # one byte back: that byte tells whether the range starts with a line of its own
        back = max(part.start - 1, 0)
        with _open(part.path) as stream:
            if back:
                stream.seek(back)
            blocks = _blocks(stream, None if part.end is None else part.end - back)
            for i, block in enumerate(blocks):
                if i == 0:  # the header, or the rest of a line of the range before
                    block = block.partition(b"\n")[2]
                if block.strip():
                    yield parse_block(block, header, self.wanted)


class CsvDays(DataSource):
    """Options ``paths`` and ``columns`` (JSON lists of text), ``rangeBytes``."""

    @classmethod
    def name(cls) -> str:
        return "tickloom_csv_days"

    def schema(self) -> str:
        return ", ".join(f"`{c}` STRING" for c in json.loads(self.options["columns"]))

    def reader(self, schema) -> DataSourceReader:
        return _Reader(json.loads(self.options["paths"]), json.loads(self.options["columns"]),
                       int(self.options.get("rangeBytes", RANGE_BYTES)))


def read_csv_days(spark: SparkSession, paths: Sequence[str], columns: Sequence[str],
                  range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Text columns of CSV files, each by its own header, as one scan.

    Plain files are split into ranges of ``range_bytes``; packed ones are one task each, read
    as a stream. Lines end at a line feed: fields must not hold one. Files are opened with
    Arrow's file systems (local, hdfs, s3, gs), by the path the executors know them by.
    """
    spark.dataSource.register(CsvDays)
    return (spark.read.format(CsvDays.name()).option("paths", json.dumps(list(paths)))
            .option("columns", json.dumps(list(columns))).option("rangeBytes", str(range_bytes)).load())
