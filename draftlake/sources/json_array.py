"""A data source for JSON arrays: one large array is read by many tasks, each over a range of bytes.

A byte alone does not tell whether it lies in a string, or how deep. So a first pass notes for each range, under
either supposition about its start (outside or inside a string), whether its quotes end in the other state and how the
brackets change the depth. These are three small numbers a range; put together in order they give the true state at
the start of each. A task then finds the first border of records in its range, reads on over the end of the
range to the end of its last record, and parses record by record: it holds one record and a block, not the file.

Records are objects; a repeated key, NaN or infinity, broken JSON, or anything but white space around the array fails by code.
Files are opened by ``pyarrow.fs`` (local paths, s3, gs, hdfs), as Python workers have no Hadoop file system.
"""

from __future__ import annotations

import codecs
import hashlib
import json
import re
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from draftlake.session import ship

# Why a file is refused.
DUPLICATE_KEY, NON_FINITE, INVALID, UNREADABLE, SCHEMA = (
    "E_EVIDENCE_DUPLICATE_JSON_KEY", "E_EVIDENCE_JSON_NONFINITE", "E_EVIDENCE_JSON_INVALID", "E_EVIDENCE_FILE_UNREADABLE", "E_TIME_SOURCE_SCHEMA",
)
BLOCK = 1 << 20
RANGE = 64 << 20
RECORD = 64 << 20  # bytes of the largest record: what is never closed fails there, not at the end of the file
SPACE = b" \t\n\r"
BLANK = re.compile("[ \t\n\r]*")


class EvidenceError(ValueError):
    """A refused document; the message begins with its code."""


def unique_object(items: list) -> dict:
    if len({k for k, _ in items}) < len(items):
        raise EvidenceError(DUPLICATE_KEY)
    return dict(items)


def _no_constant(name: str):
    raise EvidenceError(f"{NON_FINITE}: {name}")


def strict_decoder() -> json.JSONDecoder:
    return json.JSONDecoder(object_pairs_hook=unique_object, parse_constant=_no_constant)


def opened(path: str):
    """A file open for random access."""
    from pyarrow import fs

    try:
        system, own = fs.FileSystem.from_uri(path)
        return system.open_input_file(own)
    except (OSError, pa.ArrowInvalid) as error:
        raise EvidenceError(f"{UNREADABLE}: {path}: {error}") from None


def files_under(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of a file or of the files in a folder, by name; hidden ones and those of other writers' making (_...) are none."""
    from pyarrow import fs

    try:
        system, own = fs.FileSystem.from_uri(path)
        info = system.get_file_info(own)
        if info.type == fs.FileType.File:
            return [(path, info.size)]
        found = system.get_file_info(fs.FileSelector(own))
    except (OSError, pa.ArrowInvalid) as error:
        raise EvidenceError(f"{UNREADABLE}: {path}: {error}") from None
    return sorted((f"{path.rstrip('/')}/{f.base_name}", f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


class Structure:
    """Brackets outside strings in blocks that follow each other, given the state at the start."""

    def __init__(self, in_string: bool, escaped: bool):
        self.in_string, self.escaped = in_string, escaped

    def marks(self, block: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The bytes of a block, and which of them stand outside strings (quotes themselves do not)."""
        b = np.frombuffer(block, np.uint8)
        quote = b == ord('"')
        slash = np.flatnonzero(b == ord("\\"))
        if len(slash):  # a quote after an odd number of backslashes is part of a string
            first = np.concatenate([[True], np.diff(slash) > 1])
            begins = slash[first]
            sizes = np.diff(np.append(np.flatnonzero(first), len(slash)))
            if self.escaped and begins[0] == 0:
                sizes[0] += 1
            after = begins + np.diff(np.append(np.flatnonzero(first), len(slash)))
            odd = after[sizes % 2 == 1]
            quote[odd[odd < len(b)]] = False
            tail = sizes[-1] % 2 == 1 and after[-1] == len(b)
        else:
            tail = False
        if self.escaped and len(b) and b[0] == ord('"'):
            quote[0] = False
        count = np.cumsum(quote)
        inside = ((count + self.in_string) % 2 == 1) | quote
        self.in_string = bool((int(count[-1]) + self.in_string) % 2) if len(b) else self.in_string
        self.escaped = bool(tail) if len(b) else self.escaped
        return b, ~inside


def depths(b: np.ndarray, outside: np.ndarray) -> np.ndarray:
    """The change of depth after each byte."""
    opens = (b == ord("[")) | (b == ord("{"))
    closes = (b == ord("]")) | (b == ord("}"))
    return np.cumsum((opens & outside).astype(np.int64) - (closes & outside))


def _escaped_at(file, at: int) -> bool:
    """Whether an odd number of backslashes stands just before a place."""
    n = 0
    while at - n > 0 and file.read_at(1, at - n - 1) == b"\\":
        n += 1
    return n % 2 == 1


def summarise(path: str, low: int, high: int) -> tuple[bool, bool, int, int]:
    """(has something other than white space, quotes toggle the state, change of depth if the range begins outside a string, if it begins inside one)."""
    with opened(path) as file:
        escaped = _escaped_at(file, low)
        two = [Structure(inside, escaped) for inside in (False, True)]
        change, written = [0, 0], False
        for at in range(low, high, BLOCK):
            block = file.read_at(min(BLOCK, high - at), at)
            written = written or bool(block.strip(SPACE))
            for i, s in enumerate(two):
                b, outside = s.marks(block)
                if len(b):
                    change[i] += int(depths(b, outside)[-1])
    return written, two[0].in_string, change[0], change[1]


@dataclass
class Part(InputPartition):
    """A range of a file, and the state at its start."""

    path: str
    low: int
    high: int
    size: int
    begun: bool  # something other than white space lies before
    in_string: bool
    depth: int


def first_border(file, part: Part) -> int | None:
    """The place after the first comma between records in the range."""
    s, depth = Structure(part.in_string, _escaped_at(file, part.low)), part.depth
    for at in range(part.low, part.high, BLOCK):
        b, outside = s.marks(file.read_at(min(BLOCK, part.high - at), at))
        after = depths(b, outside) + depth
        found = np.flatnonzero(outside & (b == ord(",")) & (after == 1))
        if len(found):
            return at + int(found[0]) + 1
        depth = int(after[-1]) if len(b) else depth
    return None


class Text:
    """Text of a file from a place on. Of what was read only the block around the present place is held."""

    def __init__(self, file, at: int, path: str):
        self.file, self.next, self.path = file, at, path
        self.decode = codecs.getincrementaldecoder("utf-8")().decode
        self.buffer, self.at = "", 0
        self.known, self.bytes = 0, at  # a place in the buffer, and where that is in the file

    def more(self) -> bool:
        self.place()
        self.buffer, self.known, self.at = self.buffer[self.at :], 0, 0
        block = self.file.read_at(BLOCK, self.next)
        self.next += len(block)
        try:
            self.buffer += self.decode(block, not block)
        except UnicodeDecodeError as error:
            raise EvidenceError(f"{INVALID}: {self.path}: {error}") from None
        return bool(block)

    def sign(self) -> str:
        """The next sign that is no white space; none at the end of the file."""
        while True:
            self.at = BLANK.match(self.buffer, self.at).end()
            if self.at < len(self.buffer):
                return self.buffer[self.at]
            if not self.more():
                return ""

    def place(self) -> int:
        """Where the present place is in the file."""
        self.bytes += len(self.buffer[self.known : self.at].encode())
        self.known = self.at
        return self.bytes

    def value(self, decoder: json.JSONDecoder):
        while True:
            try:
                found, end = decoder.raw_decode(self.buffer, self.at)
            except json.JSONDecodeError as error:
                if len(self.buffer) - self.at > RECORD or not self.more():
                    raise EvidenceError(f"{INVALID}: {self.path}: {error}") from None
                continue
            length = end - self.at
            if end < len(self.buffer) or not self.more():  # a number at the end of the block may go on
                self.at += length  # more() has moved the text to the start of the buffer
                return found


def records(part: Part) -> Iterator[dict]:
    """The records that follow a border in the range."""
    decoder = strict_decoder()
    with opened(part.path) as file:
        if part.begun:
            border = first_border(file, part)
            if border is None:
                return
            text = Text(file, border, part.path)
        else:
            text = Text(file, part.low, part.path)
            sign = text.sign()
            if sign and text.place() >= part.high:
                return  # white space only: the array is the next range's
            if sign != "[":
                raise EvidenceError(f"{SCHEMA}: {part.path}: no array")
            text.at += 1
            if text.sign() == "]":
                text.at += 1
                if text.sign():
                    raise EvidenceError(f"{INVALID}: {part.path}: text after the array")
                return
        while True:
            if text.sign() == "":
                raise EvidenceError(f"{INVALID}: {part.path}: the array is not closed")
            row = text.value(decoder)
            if not isinstance(row, dict):
                raise EvidenceError(f"{SCHEMA}: {part.path}: a record is no object")
            yield row
            sign = text.sign()
            place = text.place()
            if sign == "]":
                text.at += 1
                break
            if sign != ",":
                raise EvidenceError(f"{INVALID}: {part.path}: no comma after a record")
            if place >= part.high:
                return  # the next record is the next range's
            text.at += 1
        if text.sign():
            raise EvidenceError(f"{INVALID}: {part.path}: text after the array")


class ArrayReader(DataSourceReader):
    def __init__(self, schema: T.StructType, parts: list[Part], lenient: bool):
        self.schema, self.parts, self.lenient = schema, parts, lenient

    def partitions(self) -> list[Part]:
        return self.parts

    def read(self, partition: Part) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        names = self.schema.names
        kinds = [to_arrow_type(f.dataType) for f in self.schema.fields]
        own = [n for n in names if n not in (SOURCE, PLACE)]

        def batch(rows: list[dict], first: int) -> pa.RecordBatch:
            columns = []
            for name, kind in zip(names, kinds, strict=True):
                if name == SOURCE:
                    values = [partition.path] * len(rows)
                elif name == PLACE:
                    values = list(range(first, first + len(rows)))
                else:
                    values = [r.get(name) for r in rows]
                    if kind == pa.string():  # anything but a string keeps its JSON text
                        values = [v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, sort_keys=True, separators=(",", ":")) for v in values]
                    elif self.lenient and kind == pa.int64():
                        values = [v if type(v) is int and -(1 << 63) <= v < 1 << 63 else None for v in values]
                try:
                    columns.append(pa.array(values, kind))
                except (pa.ArrowInvalid, pa.ArrowTypeError, OverflowError) as error:
                    raise EvidenceError(f"{SCHEMA}: {partition.path}: {name}: {error}") from None
            return pa.RecordBatch.from_arrays(columns, names=names)

        rows, first = [], partition.low << 20  # of the range: ascending within it and over the ranges of a file
        for row in records(partition):
            rows.append({n: row.get(n) for n in own})
            if len(rows) == 1000:
                yield batch(rows, first)
                first += len(rows)
                rows = []
        if rows:
            yield batch(rows, first)


SOURCE, PLACE = "source_file", "source_order"


class JsonArraySource(DataSource):
    """Option ``parts``: the ranges with their states, as JSON (see ``read_array``); without it, each file of ``path`` is one range."""

    @classmethod
    def name(cls) -> str:
        return "json_array"

    def schema(self) -> str:
        raise EvidenceError(f"{SCHEMA}: give a schema")

    def reader(self, schema: T.StructType) -> ArrayReader:
        if "parts" in self.options:
            parts = [Part(*p) for p in json.loads(self.options["parts"])]
        else:
            parts = [Part(path, 0, size, size, False, False, 0) for path, size in files_under(self.options["path"])]
        return ArrayReader(schema, parts, self.options.get("lenient") == "true")


def _states(ranges: list[tuple[str, int, int, int]], found: dict[tuple[str, int], tuple[bool, bool, int, int]]) -> Iterator[Part]:
    """Ranges in order with the state at the start of each."""
    path, begun, in_string, depth = None, False, False, 0
    for name, low, high, size in ranges:
        if name != path:
            path, begun, in_string, depth = name, False, False, 0
        yield Part(name, low, high, size, begun, in_string, depth)
        written, toggles, outside, inside = found.get((name, low), (False, False, 0, 0))
        depth += inside if in_string else outside
        begun, in_string = begun or written, in_string ^ toggles


def read_array(spark: SparkSession, paths: str | Iterable[str], columns: str, range_bytes: int = RANGE, lenient: bool = False) -> DataFrame:
    """``columns`` (a DDL string) of the records of all arrays under ``paths``; of two names it may hold, source_file is the
    file and source_order ascends with the records of a file. A missing key is null; a string column holds the JSON text of other
    values. A value of another type than its column's fails, or is null in a ``lenient`` long column.
    """
    ship(spark)
    files = [f for p in ([paths] if isinstance(paths, str) else paths) for f in files_under(p)]
    ranges = [(name, low, min(low + range_bytes, size), size) for name, size in files for low in range(0, max(size, 1), range_bytes)]
    several = [r for r in ranges if r[3] > range_bytes]
    found = {}
    if several:

        def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for frame in frames:
                rows = [(r.path, r.low, *summarise(r.path, r.low, r.high)) for r in frame.itertuples()]
                yield pd.DataFrame(rows, columns=["path", "low", "written", "toggles", "outside", "inside"])

        frame = spark.createDataFrame([r[:3] for r in several], "path string, low long, high long").repartition(len(several))
        for r in frame.mapInPandas(run, "path string, low long, written boolean, toggles boolean, outside long, inside long").collect():  # a row a range
            found[r.path, r.low] = (r.written, r.toggles, r.outside, r.inside)
    parts = [(p.path, p.low, p.high, p.size, p.begun, p.in_string, p.depth) for p in _states(ranges, found)]
    spark.dataSource.register(JsonArraySource)
    return spark.read.format("json_array").schema(columns).option("parts", json.dumps(parts)).option("lenient", str(lenient).lower()).load()


def file_digests(spark: SparkSession, paths: str | Iterable[str]) -> DataFrame:
    """(source_file, n_bytes, source_sha256) of the files under ``paths``, each read once in blocks by one task."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for name in frame["source_file"]:
                digest, size = hashlib.sha256(), 0
                with opened(name) as file:
                    while block := file.read(BLOCK):
                        digest.update(block)
                        size += len(block)
                rows.append((name, size, digest.hexdigest()))
            yield pd.DataFrame(rows, columns=["source_file", "n_bytes", "source_sha256"])

    ship(spark)
    files = [f for p in ([paths] if isinstance(paths, str) else paths) for f in files_under(p)]
    frame = spark.createDataFrame([(name,) for name, _ in files], "source_file string").repartition(max(1, len(files)))
    return frame.mapInPandas(run, "source_file string, n_bytes long, source_sha256 string")
