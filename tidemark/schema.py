"""Table schemas: four logical types and exactly one time column."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import types as T

from .errors import SchemaError

_SPARK = {"F64": T.DoubleType(), "I64": T.LongType(), "Timestamp": T.LongType(), "FixedStr": T.BinaryType()}


@dataclass(frozen=True)
class DType:
    """F64, I64, Timestamp (nanoseconds since 1970 as a long) or FixedStr of `width` bytes."""

    name: str
    width: int | None = None

    def __post_init__(self):
        if self.name not in _SPARK:
            raise SchemaError(f"unknown type {self.name!r}")
        if (self.name == "FixedStr") != (self.width is not None) or (self.width is not None and self.width <= 0):
            raise SchemaError("FixedStr needs a width above 0, other types have none")

    @property
    def spark(self) -> T.DataType:
        return _SPARK[self.name]

    @property
    def numeric(self) -> bool:
        return self.name != "FixedStr"

    @property
    def row_bytes(self) -> int:
        """Bytes a value takes in a flat column."""
        return self.width or 8

    @property
    def metadata(self) -> dict:
        return {"dtype": self.name} | ({"width": self.width} if self.width else {})


F64, I64, TIMESTAMP = DType("F64"), DType("I64"), DType("Timestamp")


def fixed_str(width: int) -> DType:
    return DType("FixedStr", width)


@dataclass(frozen=True)
class ColumnDef:
    name: str
    dtype: DType

    def __post_init__(self):
        if not self.name:
            raise SchemaError("a column needs a name")
        if any(x in self.name for x in ("/", "\\", "..")):
            raise SchemaError(f"{self.name!r} cannot name a column file")
        if self.name.startswith("_"):
            raise SchemaError(f"{self.name!r}: names with a leading underscore are reserved")


@dataclass(frozen=True)
class TableSchema:
    name: str
    columns: tuple[ColumnDef, ...] = field(default_factory=tuple)

    def __init__(self, name: str, columns: Iterable[ColumnDef | tuple[str, DType]]):
        columns = tuple(c if isinstance(c, ColumnDef) else ColumnDef(*c) for c in columns)
        object.__setattr__(self, "name", name)
        object.__setattr__(self, "columns", columns)
        if not name:
            raise SchemaError("a table needs a name")
        if not columns:
            raise SchemaError("a table needs columns")
        seen: set[str] = set()
        for c in columns:
            if c.name in seen:
                raise SchemaError(f"duplicate column {c.name!r}")
            seen.add(c.name)
        times = [c.name for c in columns if c.dtype == TIMESTAMP]
        if len(times) != 1:
            raise SchemaError(f"exactly one Timestamp column is needed, found {times}")

    @property
    def names(self) -> list[str]:
        return [c.name for c in self.columns]

    @property
    def time_column(self) -> str:
        return next(c.name for c in self.columns if c.dtype == TIMESTAMP)

    def column(self, name: str) -> ColumnDef | None:
        return next((c for c in self.columns if c.name == name), None)

    def column_index(self, name: str) -> int | None:
        return self.names.index(name) if name in self.names else None

    def spark(self) -> T.StructType:
        """The Spark schema; nothing is nullable, and logical types are in the metadata."""
        return T.StructType([T.StructField(c.name, c.dtype.spark, False, c.dtype.metadata) for c in self.columns])

    def to_json(self) -> dict:
        return {"name": self.name, "columns": [{"name": c.name, **c.dtype.metadata} for c in self.columns]}

    @classmethod
    def from_json(cls, x: dict) -> TableSchema:
        return cls(x["name"], [(c["name"], DType(c["dtype"], c.get("width"))) for c in x["columns"]])

    def column_bytes(self, rows: int) -> dict[str, int]:
        """Flat size of each column."""
        return {c.name: rows * c.dtype.row_bytes for c in self.columns}
