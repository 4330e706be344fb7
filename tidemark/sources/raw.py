"""Flat binary segments and framed logs, for tables that other tools wrote.

A segment folder holds `meta.json` (id, row_count, min_ts, max_ts, columns) and
one file a column: little-endian 8-byte values, or a FixedStr's bytes one after
another.  `RawSegments` reads them as a Spark data source, in blocks of rows, and
skips segments and blocks by time.  A log is a run of records: magic, number
(u64), length (u32), payload, CRC-32 (u32), all little-endian.
"""

from __future__ import annotations

import json
import os
import struct
import zlib
from collections.abc import Iterator
from glob import glob

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual

from ..errors import BatchError, LogError
from ..schema import DType, TableSchema

BLOCK = 1 << 20
#: How a payload marks the types of its columns.
TAGS = {0: "F64", 1: "I64", 2: "Timestamp", 3: "FixedStr"}
_NUMPY = {"F64": "<f8", "I64": "<i8", "Timestamp": "<i8"}


def write_segment(folder: str, schema: TableSchema, number: int, columns: dict[str, list]) -> None:
    """Write one flat segment (small ones, from the driver)."""
    os.makedirs(folder, exist_ok=True)
    rows = len(columns[schema.time_column])
    times = columns[schema.time_column]
    metas = []
    for c in schema.columns:
        raw = b"".join(columns[c.name]) if c.dtype.width else np.array(columns[c.name], _NUMPY[c.dtype.name]).tobytes()
        if len(raw) != rows * c.dtype.row_bytes:
            raise BatchError(f"{c.name}: {len(raw)} bytes for {rows} rows")
        with open(f"{folder}/{c.name}.col", "wb") as f:
            f.write(raw)
        metas.append({"name": c.name, "dtype": c.dtype.name, "fixed_width": c.dtype.width, "file": f"{c.name}.col"})
    with open(f"{folder}/meta.json", "w") as f:
        json.dump({"id": number, "row_count": rows, "min_ts": min(times, default=None), "max_ts": max(times, default=None), "columns": metas}, f)


class _Block(InputPartition):
    def __init__(self, folder: str, first: int, rows: int, files: dict[str, str]):
        self.folder, self.first, self.rows, self.files = folder, first, rows, files


class _Reader(DataSourceReader):
    def __init__(self, path: str, schema: TableSchema):
        self.path, self.table, self.bounds = path, schema, [-(1 << 63), (1 << 63) - 1]

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Times bound what is read; Spark applies all filters again to the rows."""
        for f in filters:
            value = getattr(f, "value", None)
            if getattr(f, "attribute", None) == (self.table.time_column,) and isinstance(value, int):
                if isinstance(f, (GreaterThan, GreaterThanOrEqual, EqualTo)):
                    self.bounds[0] = max(self.bounds[0], value)
                if isinstance(f, (LessThan, LessThanOrEqual, EqualTo)):
                    self.bounds[1] = min(self.bounds[1], value)
            yield f

    def partitions(self) -> list[_Block]:
        out = []
        for folder in sorted(glob(f"{self.path}/seg-*")):
            with open(f"{folder}/meta.json") as f:
                meta = json.load(f)
            rows = meta["row_count"]
            if not rows or meta["max_ts"] < self.bounds[0] or meta["min_ts"] > self.bounds[1]:
                continue
            known = {c["name"]: c for c in meta["columns"]}
            files = {}
            for c in self.table.columns:
                m = known.get(c.name)
                if m is None or DType(m["dtype"], m.get("fixed_width")) != c.dtype:
                    raise BatchError(f"{folder}: {c.name} is {m and m['dtype']}, not {c.dtype.name}")
                files[c.name] = m["file"]
                if (size := os.path.getsize(f"{folder}/{m['file']}")) != rows * c.dtype.row_bytes:
                    raise BatchError(f"{folder}/{m['file']} has {size} bytes for {rows} rows")
            out += [_Block(folder, a, min(BLOCK, rows - a), files) for a in range(0, rows, BLOCK)]
        return out or [_Block("", 0, 0, {})]

    def read(self, block: _Block) -> Iterator[pa.RecordBatch]:
        for a in range(block.first, block.first + block.rows, 1 << 16):
            n = min(1 << 16, block.first + block.rows - a)
            cols = []
            for c in self.table.columns:
                size = c.dtype.row_bytes
                with open(f"{block.folder}/{block.files[c.name]}", "rb") as f:
                    f.seek(a * size)
                    raw = f.read(n * size)
                cols.append(pa.array([raw[i : i + size] for i in range(0, len(raw), size)], pa.binary()) if c.dtype.width else pa.array(np.frombuffer(raw, _NUMPY[c.dtype.name])))
            yield pa.RecordBatch.from_arrays(cols, self.table.names)


class RawSegments(DataSource):
    """`spark.read.format("tidemark_raw").option("table", json of a schema).load(folder)`."""

    @classmethod
    def name(cls) -> str:
        return "tidemark_raw"

    def _table(self) -> TableSchema:
        return TableSchema.from_json(json.loads(self.options["table"]))

    def schema(self):
        return self._table().spark()

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options["path"], self._table())


def read_segments(spark: SparkSession, folder: str, schema: TableSchema) -> DataFrame:
    """All flat segments below a folder that executors can open; time filters reach the reader."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RawSegments)
    return spark.read.format("tidemark_raw").option("table", json.dumps(schema.to_json())).load(folder)


def frame(number: int, payload: bytes, magic: bytes) -> bytes:
    """One log record."""
    if len(payload) >= 1 << 32 or not 0 <= number < 1 << 64:
        raise LogError("payload or number out of range")
    return magic + struct.pack("<QI", number, len(payload)) + payload + struct.pack("<I", zlib.crc32(payload))


def unframe(data: bytes, magic: bytes) -> list[tuple[int, bytes]]:
    """(number, payload) of the records; a short header or another magic ends the log, damage is an error."""
    out, at, head = [], 0, len(magic) + 12
    while at + head <= len(data) and data[at : at + len(magic)] == magic:
        number, size = struct.unpack_from("<QI", data, at + len(magic))
        payload = data[at + head : at + head + size]
        tail = data[at + head + size : at + head + size + 4]
        if len(payload) < size or len(tail) < 4:
            raise LogError(f"record {number} is cut short")
        if struct.unpack("<I", tail)[0] != zlib.crc32(payload):
            raise LogError(f"record {number}: checksum mismatch")
        out.append((number, payload))
        at += head + size + 4
    return out


def encode_payload(schema: TableSchema, columns: dict[str, list]) -> bytes:
    """A batch as one payload: rows, columns, then each column's name, tag, width, count and values.

    A FixedStr's values have their length (u32) in front of each.
    """
    rows = len(columns[schema.names[0]])
    tags = {v: k for k, v in TAGS.items()}
    out = [struct.pack("<QQ", rows, len(schema.columns))]
    for c in schema.columns:
        name, values = c.name.encode(), columns[c.name]
        out.append(struct.pack("<I", len(name)) + name + bytes([tags[c.dtype.name]]))
        if c.dtype.width:
            out.append(struct.pack("<Q", c.dtype.width))
        out.append(struct.pack("<Q", len(values)))
        out.append(b"".join(struct.pack("<I", len(v)) + v for v in values) if c.dtype.width else np.array(values, _NUMPY[c.dtype.name]).tobytes())
    return b"".join(out)


def decode_payload(schema: TableSchema, data: bytes) -> dict[str, list]:
    """The columns of a payload; names, order and types must be the schema's."""
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(data):
            raise LogError("payload is cut short")
        at += n
        return data[at - n : at]

    number = lambda f: struct.unpack(f, take(struct.calcsize(f)))[0]
    rows, count = number("<Q"), number("<Q")
    if count != len(schema.columns):
        raise LogError(f"{count} columns, not {len(schema.columns)}")
    out = {}
    for c in schema.columns:
        name, kind = take(number("<I")).decode(), TAGS.get(take(1)[0])
        width = number("<Q") if kind == "FixedStr" else None
        if name != c.name or kind != c.dtype.name or width != c.dtype.width:
            raise LogError(f"column {name} is {kind}, expected {c.name} as {c.dtype.name}")
        if (n := number("<Q")) != rows:
            raise LogError(f"{name} has {n} of {rows} rows")
        if width:
            out[name] = [take(number("<I")) for _ in range(n)]
            if any(len(v) != width for v in out[name]):
                raise LogError(f"{name} has values that are not {width} bytes")
        else:
            out[name] = np.frombuffer(take(n * 8), _NUMPY[kind]).tolist()
    if at != len(data):
        raise LogError("bytes after the last column")
    return out


def read_log(spark: SparkSession, path: str, schema: TableSchema, magic: bytes, first: int = 0) -> DataFrame:
    """Rows of framed log files from record `first` on, with `_rec`; a file is one task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for data in x.column("content").to_pylist():
                for number, payload in unframe(data, magic):
                    if number < first:
                        continue
                    got = decode_payload(schema, payload)
                    kinds = [pa.binary() if c.dtype.width else pa.float64() if c.dtype.name == "F64" else pa.int64() for c in schema.columns]
                    n = len(got[schema.names[0]])
                    yield pa.RecordBatch.from_arrays([*[pa.array(got[c.name], k) for c, k in zip(schema.columns, kinds)], pa.array([number] * n, pa.int64())], [*schema.names, "_rec"])

    from pyspark.sql import types as T

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(run, T.StructType([*schema.spark().fields, T.StructField("_rec", T.LongType())]))
