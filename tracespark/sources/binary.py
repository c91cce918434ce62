"""Raw movies, .npy trace matrices and logs as Spark data sources: byte ranges of files are partitions."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql.datasource import (
    DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan,
    LessThanOrEqual, WriterCommitMessage,
)

#: Bytes that a partition reads, and that one Arrow batch of it holds, at most (one record at least).
SPLIT, BATCH = 64 << 20, 4 << 20


def opened(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if re.match(r"^[a-z0-9]+:", path) else f"file://{path}")


def files_under(path: str, pattern: str) -> list[fs.FileInfo]:
    """The files of a folder, or a file by itself, whose names fit a pattern, in order of path.
    Names that begin with an underscore or a dot are not data."""
    system, root = opened(path)
    info = system.get_file_info(root)
    if info.type == fs.FileType.File:
        return [info]
    found = system.get_file_info(fs.FileSelector(root, recursive=True))
    return sorted((f for f in found if f.type == fs.FileType.File and f.base_name[0] not in "_." and re.search(pattern, f.base_name)), key=lambda f: f.path)


@dataclass
class Range(InputPartition):
    """``count`` records of ``size`` bytes from byte ``start`` of a file on, the first of number ``first``."""

    path: str
    start: int
    first: int
    count: int
    size: int
    name: str = ""
    kind: str = "<i2"


class _Reader(DataSourceReader):
    """Records of files cut into ranges; only records ``low`` .. ``high`` - 1 are planned."""

    column = ""

    def __init__(self, options: dict):
        self.options = options
        self.low, self.high = int(options.get("from", 0)), int(options.get("to", 2**62))
        self.split = int(options.get("split", SPLIT))

    def narrowed(self, filters: list[Filter]) -> Iterable[Filter]:
        """Takes limits on the record's number; others are Spark's."""
        for f in filters:
            if getattr(f, "attribute", None) != (self.column,):
                yield f
            elif isinstance(f, EqualTo):
                self.low, self.high = max(self.low, f.value), min(self.high, f.value + 1)
            elif isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.low = max(self.low, f.value + isinstance(f, GreaterThan))
            elif isinstance(f, (LessThan, LessThanOrEqual)):
                self.high = min(self.high, f.value + isinstance(f, LessThanOrEqual))
            else:
                yield f

    def ranges(self, file: str, begin: int, first: int, n: int, size: int, name: str = "", kind: str = "<i2") -> Iterator[Range]:
        """Ranges of the file's records first .. first + n - 1 that are asked for."""
        low, high = max(self.low, first), min(self.high, first + n)
        step = max(1, self.split // max(1, size))
        for at in range(low, high, step):
            yield Range(file, begin + (at - first) * size, at, min(step, high - at), size, name, kind)

    def records(self, part: Range) -> Iterator[tuple[int, bytes]]:
        """Pieces of a range: the number of the first record, and bytes of whole records."""
        system, _ = opened(self.options["path"])
        with system.open_input_file(part.path) as file:
            file.seek(part.start)
            step = max(1, BATCH // max(1, part.size))
            for at in range(0, part.count, step):
                n = min(step, part.count - at)
                data = file.read(n * part.size)
                if len(data) != n * part.size:
                    raise ValueError(f"{part.path} ends within record {part.first + at}")
                yield part.first + at, data


class MovieReader(_Reader):
    column = "frame"

    def partitions(self) -> list[Range]:
        size = 2 * int(self.options["height"]) * int(self.options["width"])
        found, first = [], 0
        for file in files_under(self.options["path"], self.options.get("pattern", ".")):
            if file.size % size:
                raise ValueError(f"{file.path}: {file.size} bytes are no whole number of frames of {size} bytes")
            found += self.ranges(file.path, 0, first, file.size // size, size)
            first += file.size // size
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        for first, data in self.records(partition):
            pixels = np.frombuffer(data, "<i2").reshape(-1, partition.size // 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(first, first + len(pixels))), pa.array([x.tobytes() for x in pixels], pa.binary()), pa.array(pixels.mean(1))],
                names=["frame", "pixels", "mean"])


class PushedMovieReader(MovieReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return list(self.narrowed(filters))


class TraceReader(_Reader):
    """Rows of two-dimensional .npy matrices; the headers are read when the scan is planned."""

    column = "roi"

    def partitions(self) -> list[Range]:
        system, _ = opened(self.options["path"])
        found = []
        for info in files_under(self.options["path"], self.options.get("pattern", r"\.npy$")):
            with system.open_input_file(info.path) as file:
                version = np.lib.format.read_magic(file)
                read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
                shape, by_column, kind = read(file)
                begin = file.tell()
            if len(shape) != 2 or by_column or kind.kind not in "fiu":
                raise ValueError(f"{info.path}: not a matrix of numbers by rows")
            size = shape[1] * kind.itemsize
            if info.size != begin + shape[0] * size:
                raise ValueError(f"{info.path}: {info.size} bytes do not fit its header's {shape[0]} x {shape[1]} {kind.str}")
            name = re.search(self.options["rec"], info.path)
            found += self.ranges(info.path, begin, 0, shape[0], size, name.group(1) if name else "", kind.str)
        return found

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kind = np.dtype(partition.kind)
        for first, data in self.records(partition):
            n = len(data) // partition.size if partition.size else 0
            values = np.frombuffer(data, kind).astype(float)
            each = partition.size // kind.itemsize
            yield pa.RecordBatch.from_arrays(
                [pa.array([partition.name] * n, pa.string()), pa.array(np.arange(first, first + n)),
                 pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * each, pa.int32()), pa.array(values))], names=["rec", "roi", "values"])


class PushedTraceReader(TraceReader):
    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        return list(self.narrowed(filters))


@dataclass
class Written(WriterCommitMessage):
    """Files of a task under their temporary and final names."""

    files: list[tuple[str, str]]


class _Writer(DataSourceArrowWriter):
    """Files appear under their names when the job commits; a task that runs twice leaves no trace."""

    def __init__(self, options: dict):
        self.path = options["path"]

    def named(self, final: str) -> tuple[str, str]:
        context = TaskContext.get()
        return f"_{context.partitionId()}-{context.taskAttemptId()}-{final}", final

    def commit(self, messages: list[Written]) -> None:
        system, root = opened(self.path)
        for message in messages:
            for now, final in message.files:
                system.move(f"{root}/{now}", f"{root}/{final}")

    def abort(self, messages: list[Written]) -> None:
        system, root = opened(self.path)
        for message in messages:
            for now, _ in message.files if message else []:
                system.delete_file(f"{root}/{now}")


class MovieWriter(_Writer):
    """Each task's frames, in the order in which they come, as one raw file; files in order of tasks."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        now, final = self.named(f"part-{TaskContext.get().partitionId():06d}.bin")
        n = 0
        with system.open_output_stream(f"{root}/{now}") as out:
            for batch in iterator:
                n += batch.num_rows
                for pixels in batch.column("pixels"):
                    out.write(pixels.as_buffer())
        if not n:
            system.delete_file(f"{root}/{now}")
        return Written([(now, final)] if n else [])


class TraceWriter(_Writer):
    """One .npy matrix per recording, written row by row: rows come sorted by recording and
    ROI, with the recording's numbers of rows and samples for the header."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        files, rec, out = [], None, None
        for batch in iterator:
            for row in range(batch.num_rows):
                own, n, m = (batch.column(c)[row].as_py() for c in ("rec", "n_rows", "n_samples"))
                if out is None or own != rec:
                    if out is not None:
                        out.close()
                    rec = own
                    files.append(self.named(f"{own}.npy"))
                    out = system.open_output_stream(f"{root}/{files[-1][0]}")
                    np.lib.format.write_array_header_1_0(out, {"descr": "<f8", "fortran_order": False, "shape": (n, m)})
                values = batch.column("values")[row].values.to_numpy(zero_copy_only=False).astype("<f8")
                if len(values) != m:
                    raise ValueError(f"recording {own}: traces of {len(values)} and {m} samples")
                out.write(values.tobytes())
        if out is not None:
            out.close()
        return Written(files)


class LogWriter(_Writer):
    """One text file per recording: rows come sorted by recording and line."""

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        system, root = opened(self.path)
        system.create_dir(root, recursive=True)
        files, rec, out = [], None, None
        for batch in iterator:
            each = batch.column("rec").to_pylist()
            begins = [k for k, own in enumerate(each) if not k or own != each[k - 1]]
            lines = batch.column("raw")
            for a, z in zip(begins, [*begins[1:], len(each)]):
                if not re.fullmatch(r"[a-zA-Z0-9][\w.-]*", each[a] or "", re.ASCII):
                    raise ValueError(f"recording {each[a]!r} cannot name a file")
                if out is None or each[a] != rec:
                    if out is not None:
                        out.close()
                    rec = each[a]
                    files.append(self.named(f"{rec}.txt"))
                    out = system.open_output_stream(f"{root}/{files[-1][0]}")
                out.write("".join(f"{x or ''}\n" for x in lines.slice(a, z - a).to_pylist()).encode())
        if out is not None:
            out.close()
        return Written(files)


class RawMovie(DataSource):
    """Raw int16 movies. Options: path, height, width, from and to (frames), split (bytes), pushed."""

    @classmethod
    def name(cls) -> str:
        return "rawmovie"

    def schema(self) -> str:
        return "frame long, pixels binary, mean double"

    def reader(self, schema) -> DataSourceReader:
        return (PushedMovieReader if self.options.get("pushed") == "true" else MovieReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return MovieWriter(dict(self.options))


class TraceMatrices(DataSource):
    """.npy matrices of traces. Options: path, pattern, rec, from and to (ROIs), split (bytes), pushed."""

    @classmethod
    def name(cls) -> str:
        return "npytraces"

    def schema(self) -> str:
        return "rec string, roi long, values array<double>"

    def reader(self, schema) -> DataSourceReader:
        return (PushedTraceReader if self.options.get("pushed") == "true" else TraceReader)(dict(self.options))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return TraceWriter(dict(self.options))


class LogFiles(DataSource):
    """Text files of recordings' lines, to be read as text. Options: path."""

    @classmethod
    def name(cls) -> str:
        return "logfiles"

    def schema(self) -> str:
        return "rec string, raw string"

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        return LogWriter(dict(self.options))
