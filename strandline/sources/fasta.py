"""FASTA text files as DataFrames: the data source ``fasta``, and a reader and a writer that Spark's text source does.

    register(spark)
    spark.read.format("fasta").option("split", 64 << 20).load("folder, file or pattern")

A record begins where a line begins with >. The title is the rest of that line (further > stay); line ends, Windows ones
too, and blanks are no residues. A record without a title or without residues is a record. Files are cut into ranges of
bytes; a range has the records that begin in it. seq_ordinal is the place of a record's first byte in all files, one after
another in order of path. So it is the same in every run, however files are cut and packed, and follows their order.
"""

from __future__ import annotations

import fnmatch
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

SCHEMA = "seq_ordinal long, title string, residues string"
#: Bytes of a range, of a read, and of a batch.
SPLIT, READ, BATCH = 64 << 20, 4 << 20, 8 << 20
#: Bytes that a first read takes beyond its range, and of ranges that a task reads one after another.
AHEAD, TASK = 16 << 10, 8 << 20
#: Stores that Arrow opens by itself; others are left to Spark's text source.
STORES = ("file", "hdfs", "s3", "gs", "gcs", "abfs", "abfss")
_BLANKS = b" \t\r\n\x0b\x0c"


def _opened(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(re.sub("^file:/(?!/)", "file:///", path))


def files_at(path: str) -> list[tuple[str, int]]:
    """Paths and sizes of the files that a path (a file, a folder, or a pattern in its last part) names, in order of path.
    Names that begin with . or _ are left out, as Spark does."""
    store, at = _opened(path.rstrip("/"))
    folder, _, last = at.rpartition("/")
    if any(c in last for c in "*?["):
        found = [f for f in store.get_file_info(pyarrow.fs.FileSelector(folder or "/")) if fnmatch.fnmatchcase(f.base_name, last)]
    else:
        one = store.get_file_info(at)
        if one.type == pyarrow.fs.FileType.NotFound:
            raise FileNotFoundError(path)
        found = store.get_file_info(pyarrow.fs.FileSelector(at, recursive=True)) if one.type == pyarrow.fs.FileType.Directory else [one]
    hidden = lambda f: any(x[:1] in "._" for x in f.path[len(folder) :].strip("/").split("/"))
    return sorted((f.path, f.size) for f in found if f.type == pyarrow.fs.FileType.File and f.size and not hidden(f))


def records(file, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Offset and bytes of the records that begin from start to before end."""
    at = max(0, start - 1)
    file.seek(at)
    least = READ if start == 0 else min(READ, end - at + AHEAD)  # a range of few bytes reads few
    data, begin, size = file.read(least), None, least
    if at == 0 and start == 0:
        head = len(data) - len(data.lstrip(_BLANKS))
        first = data[head : head + 1]
        if first not in (b">", b"") or first and head and data[head - 1 : head] != b"\n":
            raise ValueError("a FASTA file begins with >")
        if head == 0 and data:
            begin = 0  # later ones come after a line end, which the search below finds
    seen = begin + 1 if begin is not None else 0
    while True:
        found = data.find(b"\n>", seen)
        if found >= 0:
            if begin is not None:
                yield at + begin, data[begin:found]
            begin = found + 1
            seen = begin + 1
            if at + begin >= end:
                return
            continue
        if begin is None and at + len(data) > end + 1:
            return
        more = file.read(size)
        if not more:
            if begin is not None:
                yield at + begin, data[begin:]
            return
        keep = begin if begin is not None else max(0, len(data) - 1)
        size = max(least, len(data) - keep)  # a long record is read in growing steps, so that it is not copied again and again
        seen = max(0, len(data) - 1 - keep)
        at, data, begin = at + keep, data[keep:] + more, None if begin is None else 0


@dataclass
class FileRange(InputPartition):
    path: str
    start: int
    end: int
    before: int


@dataclass
class FileRanges(InputPartition):
    ranges: list[FileRange]


class FastaReader(DataSourceReader):
    def __init__(self, path: str, split: int):
        self.path, self.split = path, split

    def partitions(self):
        out, before = [], 0
        for path, size in files_at(self.path):
            out += [FileRange(path, a, min(size, a + self.split), before) for a in range(0, size, self.split)]
            before += size
        return out or [FileRange("", 0, 0, 0)]

    def read(self, partition):
        return self._rows([partition])

    def _rows(self, every: list[FileRange]) -> Iterator[pa.RecordBatch]:
        store, _ = _opened(self.path)
        rows, size = [], 0
        for path, ranges in groupby(every, lambda x: x.path):
            if not path:
                return
            with store.open_input_file(path) as file:
                for own in ranges:
                    for offset, record in records(file, own.start, own.end):
                        head, _, body = record.partition(b"\n")
                        rows.append((own.before + offset, head[1:].rstrip().decode("utf-8", "replace"), body.translate(None, _BLANKS).decode("utf-8", "replace")))
                        size += len(record)
                        if size >= BATCH or len(rows) >= 5_000:
                            yield self._batch(rows)
                            rows, size = [], 0
        if rows:
            yield self._batch(rows)

    @staticmethod
    def _batch(rows: list) -> pa.RecordBatch:
        kinds = (pa.int64(), pa.string(), pa.string())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], ["seq_ordinal", "title", "residues"])


class PackedReader(FastaReader):
    """Small ranges are packed to tasks of TASK bytes, as a task costs more than the reading of a small range."""

    def partitions(self):
        out, room = [], 0
        for own in super().partitions():
            if not out or room < own.end - own.start:
                out.append(FileRanges([]))
                room = TASK
            out[-1].ranges.append(own)
            room -= own.end - own.start
        return out

    def read(self, partition):
        return self._rows(partition.ranges)


class FastaSource(DataSource):
    """Options: path; split (bytes of a range)."""

    @classmethod
    def name(cls) -> str:
        return "fasta"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        split = int(self.options.get("split", SPLIT))
        if split < 1 or "path" not in self.options:
            raise ValueError("fasta needs a path, and a split of a byte or more")
        return PackedReader(self.options["path"], split)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(FastaSource)


def read_fasta(spark: SparkSession, path: str, split: int = SPLIT) -> DataFrame:
    """seq_ordinal, title, residues of each record of one or more files. In a store that only Spark's own readers open,
    seq_ordinal follows the order of records within a file's part only (``read_fasta_lines``)."""
    store = re.match(r"(\w+):", path)
    if store and store[1] not in STORES:
        return read_fasta_lines(spark, path)
    register(spark)
    return spark.read.format("fasta").option("split", split).load(path)


def read_fasta_lines(spark: SparkSession, path: str) -> DataFrame:
    """As read_fasta, by Spark's text source, from any store that Spark reads; seq_ordinal is unique, but changes with how Spark packs files."""
    lines = spark.read.option("lineSep", "\n>").text(path)
    record = F.regexp_replace("value", r"\A\s*>|\A\s+\z", "")
    parts = F.split(record, "\n", 2)
    rows = lines.where(F.trim(F.regexp_replace("value", r"\s", "")) != "").select(F.monotonically_increasing_id().alias("seq_ordinal"), parts.alias("p"))
    return rows.select("seq_ordinal", F.rtrim(F.regexp_replace(F.get("p", F.lit(0)), "\r", "")).alias("title"), F.coalesce(F.regexp_replace(F.get("p", F.lit(1)), r"\s", ""), F.lit("")).alias("residues"))


def write_fasta(sequences: DataFrame, path: str, width: int = 60) -> None:
    """title and residues as FASTA text, residues in lines of ``width``. A null title or null residues are empty; line ends in
    a title become blanks; blanks and > in residues, which FASTA can't hold, are left out."""
    title = F.regexp_replace(F.coalesce("title", F.lit("")), r"[\r\n]+", " ")
    residues = F.regexp_replace(F.coalesce("residues", F.lit("")), r"[\s>]", "")
    wrapped = F.regexp_replace(residues, f"(.{{{width}}})(?=.)", "$1\n")
    sequences.select(F.concat(F.lit(">"), title, F.lit("\n"), wrapped).alias("value")).write.text(path)
