"""Files that Spark has no reader for, as Python data sources: numbers by position, and lines of text under a checksum.

`register(spark)` makes both known. Paths go through Arrow's file systems, so folders in a store will do as well as local ones.
"""

from __future__ import annotations

import hashlib
import io
import json
import re
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass, field
from urllib.parse import quote, unquote

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage

#: Numbers of a file at most, of a partition that reads, and of a batch; bytes read at once.
PIECE, SPAN, BATCH, CHUNK = 1_000_000, 4_000_000, 65_536, 1 << 20
#: Files that one partition reads at most.
FILES = 500
KINDS = {"f8": "double", "f4": "float", "i8": "long", "i4": "int", "i2": "short", "b1": "boolean"}
FILE = re.compile(r"(.*)@(\d+)-\w+\.npy")


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Arrays)
    spark.dataSource.register(VerifiedLines)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def _at(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if re.match(r"\w+:", path):
        return arrow_fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", path))
    return arrow_fs.LocalFileSystem(), path


def _files(path: str) -> list[arrow_fs.FileInfo]:
    store, where = _at(path)
    found = store.get_file_info(arrow_fs.FileSelector(where, recursive=True, allow_not_found=True))
    return sorted((x for x in found if x.is_file), key=lambda x: x.path)


# ---- numbers by position


@dataclass
class Stretch(InputPartition):
    """Some numbers of one file: where they stand there, and the position of the first; and more such that are read along with it."""

    path: str
    name: str
    skip: int
    count: int
    first: int
    kind: str
    more: list[Stretch] = field(default_factory=list)


def _header(store, path: str) -> tuple[np.dtype, int, int]:
    """A file's type, length, and where its numbers begin."""
    with store.open_input_file(path) as f:
        head = io.BytesIO(f.read(4096))
    version = np.lib.format.read_magic(head)
    read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
    shape, _, kind = read(head)
    if len(shape) != 1 or kind.str[1:] not in KINDS:
        raise ValueError(f"{path} is not a row of numbers")
    return kind, shape[0], head.tell()


class Arrays(DataSource):
    """Rows name, pos, value: each name's numbers by position, in files of fixed width that hold a stretch of positions each.

    Writing takes rows in any partitioning; where rows of a name follow each other by position, they share files. Tasks write beside the
    table; one move of a folder makes a job's files part of it, so a job that fails, and an attempt that was lost, leave nothing. Reading takes the
    type from a header, cuts files into partitions, and leaves out what filters on name and position exclude without opening it.
    """

    @classmethod
    def name(cls) -> str:
        return "arrays"

    def _parts(self) -> list[tuple[str, str, int]]:
        """path, name and first position of each file that a job has committed."""
        out = []
        for x in _files(self.options["path"]):
            if "/part-" in x.path and (m := FILE.fullmatch(x.base_name)):
                out.append((x.path, unquote(m[1]), int(m[2])))
        return out

    def schema(self) -> str:
        parts = self._parts()
        if not parts:
            raise FileNotFoundError(f"no arrays at {self.options['path']}")
        kind = _header(_at(self.options["path"])[0], parts[0][0])[0]
        return f"name string, pos long, value {KINDS[kind.str[1:]]}"

    def reader(self, schema) -> DataSourceReader:
        return ArraysReader(self.options["path"], self._parts())

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if [f.name for f in schema] != ["name", "pos", "value"]:
            raise ValueError("arrays have the columns name, pos and value")
        return ArraysWriter(self.options["path"], overwrite)


class ArraysReader(DataSourceReader):
    def __init__(self, path: str, parts: list):
        self.path, self.parts = path, parts
        self.least, self.most, self.only = 0, 1 << 62, None

    def pushFilters(self, filters):
        for f in filters:
            if isinstance(f, EqualTo) and f.attribute == ("name",):
                self.only = f.value if self.only in (None, f.value) else ""
            elif f.__class__ in (EqualTo, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual) and f.attribute == ("pos",):
                if not isinstance(f, (LessThan, LessThanOrEqual)):
                    self.least = max(self.least, f.value + isinstance(f, GreaterThan))
                if not isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                    self.most = min(self.most, f.value - isinstance(f, LessThan))
            else:
                yield f

    def partitions(self) -> list[Stretch]:
        store, out = _at(self.path)[0], []
        parts = [(path, name, begin) for path, name, begin in self.parts if self.only in (None, name) and begin <= self.most and begin + PIECE > self.least]
        with ThreadPoolExecutor(16) as pool:
            headers = list(pool.map(lambda x: _header(store, x[0]), parts))
        size = 0
        for (path, name, begin), (kind, n, _) in zip(parts, headers):
            first, last = max(begin, self.least), min(begin + n - 1, self.most)
            for at in range(first, last + 1, SPAN):
                own = Stretch(path, name, at - begin, min(SPAN, last - at + 1), at, kind.str)
                if out and size + own.count <= SPAN and len(out[-1].more) < FILES - 1:  # small files share a partition
                    out[-1].more.append(own)
                    size += own.count
                else:
                    out.append(own)
                    size = own.count
        return out or [Stretch("", "", 0, 0, 0, "<f8")]

    def read(self, partition: Stretch):
        store = _at(self.path)[0]
        for own in [partition, *partition.more] if partition.count else []:
            yield from self._numbers(store, own)

    def _numbers(self, store, partition: Stretch):
        kind = np.dtype(partition.kind)
        begin = _header(store, partition.path)[2]
        with store.open_input_file(partition.path) as f:
            f.seek(begin + partition.skip * kind.itemsize)
            for at in range(0, partition.count, BATCH):
                n = min(BATCH, partition.count - at)
                values = np.frombuffer(f.read(n * kind.itemsize), dtype=kind)
                if len(values) < n:
                    raise ValueError(f"{partition.path} is shorter than its header says")
                first = partition.first + at
                yield pa.RecordBatch.from_arrays([pa.array([partition.name] * n), pa.array(np.arange(first, first + n)), pa.array(values)], names=["name", "pos", "value"])


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


class ArraysWriter(DataSourceArrowWriter):
    def __init__(self, path: str, overwrite: bool):
        self.path, self.overwrite, self.job = path, overwrite, uuid.uuid4().hex

    def _staged(self) -> tuple[arrow_fs.FileSystem, str, str]:
        store, where = _at(self.path)
        return store, where, f"{where}/_staged-{self.job}"

    def write(self, iterator) -> Written:
        store, _, staged = self._staged()
        store.create_dir(staged, recursive=True)
        files, held, name, first = [], [], None, 0

        def flush():
            nonlocal held
            if held:
                files.append(f"{staged}/{quote(name, safe='')}@{first}-{uuid.uuid4().hex}.npy")
                out = io.BytesIO()
                np.lib.format.write_array(out, np.concatenate(held), version=(1, 0))
                with store.open_output_stream(files[-1]) as f:
                    f.write(out.getvalue())
            held = []

        for b in iterator:
            names, pos, values = b.column(0), b.column(1).to_numpy(), b.column(2)
            if b.column(0).null_count or b.column(1).null_count or values.null_count:
                raise ValueError("arrays hold no nulls")
            kinds, values = names.dictionary_encode(), values.to_numpy(zero_copy_only=False)
            code = kinds.indices.to_numpy()
            edges = np.flatnonzero((np.diff(code) != 0) | (np.diff(pos) != 1)) + 1
            for begin, end in zip([0, *edges.tolist()], [*edges.tolist(), len(pos)]):
                while begin < end:
                    own, n = kinds.dictionary[int(code[begin])].as_py(), sum(map(len, held))
                    # no file crosses a multiple of PIECE, so a file's name tells all positions it may hold
                    if n and (own != name or pos[begin] != first + n or pos[begin] % PIECE == 0):
                        flush()
                        n = 0
                    if not n:
                        name, first = own, int(pos[begin])
                    stop = min(end, begin + PIECE - int(pos[begin]) % PIECE)
                    held.append(values[begin:stop])
                    begin = stop
        flush()
        return Written(files)

    def commit(self, messages) -> None:
        store, where, staged = self._staged()
        kept = {f for m in messages if m for f in m.files}
        old = {x.path.rpartition("/")[0] for x in _files(self.path) if "/part-" in x.path} if self.overwrite else set()
        names = {k.rpartition("/")[2] for k in kept}
        for x in _files(staged):
            if x.path.rpartition("/")[2] not in names:
                store.delete_file(x.path)  # of an attempt that doesn't count
        if kept:
            store.move(staged, f"{where}/part-{self.job}")
        for folder in old:
            store.delete_dir(folder)

    def abort(self, messages) -> None:
        store, _, staged = self._staged()
        if store.get_file_info(staged).type != arrow_fs.FileType.NotFound:
            store.delete_dir(staged)


# ---- lines under a checksum


@dataclass
class Whole(InputPartition):
    file: str
    sha256: str


class VerifiedLines(DataSource):
    """Rows file, line_no (from 1), text of the files that a manifest names (option manifest: JSON of file to SHA-256, or the path of such a file).

    The digest is taken of the bytes that give the rows, as they stream by, and compared at each file's end: a job over a file that isn't what was
    recorded, or is missing, fails. No file is held whole. Lines end at line feeds; a file's last may lack its own.
    """

    @classmethod
    def name(cls) -> str:
        return "verified_lines"

    def schema(self) -> str:
        return "file string, line_no long, text string"

    def reader(self, schema) -> DataSourceReader:
        given = self.options["manifest"]
        if not given.lstrip().startswith("{"):
            store, where = _at(given)
            with store.open_input_stream(where) as f:
                given = f.read().decode()
        return VerifiedReader(self.options["path"], json.loads(given))


class VerifiedReader(DataSourceReader):
    def __init__(self, path: str, manifest: dict[str, str]):
        self.path, self.manifest = path, manifest

    def partitions(self) -> list[Whole]:
        return [Whole(f, h) for f, h in sorted(self.manifest.items())] or [Whole("", "")]

    def read(self, partition: Whole):
        if not partition.file:
            return
        store, where = _at(self.path)
        if store.get_file_info(f"{where}/{partition.file}").type == arrow_fs.FileType.NotFound:
            raise FileNotFoundError(f"{partition.file} is missing")
        digest, rest, n = hashlib.sha256(), [], 0
        with store.open_input_stream(f"{where}/{partition.file}") as f:
            while chunk := f.read(CHUNK):
                digest.update(chunk)
                *lines, last = chunk.split(b"\n")
                if lines:
                    lines[0] = b"".join([*rest, lines[0]])
                    yield self._rows(partition.file, n, lines)
                    n, rest = n + len(lines), []
                rest.append(last)
        if last := b"".join(rest):
            yield self._rows(partition.file, n, [last])
        if digest.hexdigest() != partition.sha256:
            raise ValueError(f"{partition.file} is not what was recorded: {digest.hexdigest()}")

    @staticmethod
    def _rows(file: str, n: int, lines: list[bytes]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([file] * len(lines)), pa.array(np.arange(n + 1, n + 1 + len(lines))), pa.array([x.decode() for x in lines], pa.string())], names=["file", "line_no", "text"])
