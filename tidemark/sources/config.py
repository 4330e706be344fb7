"""TOML configuration: sections for devices and a table's limits and schema, checked when read.

The table's settings stand in `[db]` or, in short files, at the top.  Sections and
keys that are left out have their defaults.  Device sections are checked and kept
for tools that need them; Spark itself drives no devices.
"""

from __future__ import annotations

import copy
import json
import tomllib
from dataclasses import dataclass, field, fields

from ..errors import ConfigError, SchemaError
from ..schema import F64, TIMESTAMP, DType, TableSchema, fixed_str


#: Sections, their keys and defaults.
SECTIONS = {
    "reactor": {"poll_cores": [0, 1]},
    "bufpool": {"count": 512, "buf_size_mib": 2},
    "uring": {"sq_depth": 4096, "cq_depth": 8192, "sqpoll_idle_ms": 2},
    "spdk": {"devices": ["0000:01:00.0"], "queue_depth": 256, "io_size_mib": 128},
    "dpdk": {"pci_addr": "0000:02:00.0", "rx_queues": 1, "tx_queues": 1, "rss_key": "6d5a56da"},
}
#: What the keys of `[db]` are called here.
DB = {"path": "data_dir", "wal_size_mib": "log_size_mib", "segment_rows": "segment_rows", "compaction_threads": "compaction_parallelism", "schema": "schema"}
#: Keys that may be zero or empty.
_FREE = ("sqpoll_idle_ms", "devices", "rss_key")


def default_schema() -> TableSchema:
    return TableSchema("ticks", [("timestamp", TIMESTAMP), ("symbol", fixed_str(8)), ("price", F64), ("volume", F64)])


@dataclass
class Config:
    data_dir: str = "data"
    log_size_mib: int = 256
    segment_rows: int = 1_000_000
    compaction_parallelism: int = 2
    schema: TableSchema = field(default_factory=default_schema)
    sections: dict = field(default_factory=lambda: copy.deepcopy(SECTIONS))

    def __post_init__(self):
        if not self.data_dir:
            raise ConfigError("data_dir is empty")
        for k in ("log_size_mib", "segment_rows", "compaction_parallelism"):
            v = getattr(self, k)
            if isinstance(v, bool) or not isinstance(v, int) or v <= 0:
                raise ConfigError(f"{k} must be a whole number above 0, not {v!r}")
        self.sections = {name: _section(name, self.sections.get(name, {})) for name in SECTIONS}

    def open(self, spark):
        """The table that is described, sealed by `seal_when(segment_rows)`."""
        from .table import Table

        return Table.open(spark, self.data_dir, self.schema)


def _section(name: str, given: dict) -> dict:
    """A section with its defaults; keys are known, types as in the defaults, sizes above 0 and names not empty."""
    if not isinstance(given, dict):
        raise ConfigError(f"{name} must be a section")
    if unknown := set(given) - set(SECTIONS[name]):
        raise ConfigError(f"unknown keys {sorted(unknown)} in {name}")
    out = copy.deepcopy(SECTIONS[name]) | given
    for k, v in out.items():
        kind = type(SECTIONS[name][k])
        each = type(SECTIONS[name][k][0]) if kind is list else None
        if type(v) is not kind or each and any(type(e) is not each for e in v):
            raise ConfigError(f"{name}.{k} has another type than {SECTIONS[name][k]!r}")
        if any(e < 0 for e in ([v] if kind is int else v) if isinstance(e, int)) or not v and k not in _FREE:
            raise ConfigError(f"{name}.{k} must not be {v!r}")
    return out


def parse(text: str) -> Config:
    """A configuration from TOML; unknown keys are errors."""
    try:
        x = tomllib.loads(text)
    except tomllib.TOMLDecodeError as e:
        raise ConfigError(str(e)) from e
    sections = {k: x.pop(k) for k in SECTIONS if k in x}
    db = x.pop("db", {})
    if unknown := set(db) - set(DB):
        raise ConfigError(f"unknown keys {sorted(unknown)} in db")
    if twice := {DB[k] for k in db} & set(x):
        raise ConfigError(f"{sorted(twice)} are given twice")
    x |= {DB[k]: v for k, v in db.items()}
    known = {f.name for f in fields(Config)} - {"sections"}
    if unknown := set(x) - known:
        raise ConfigError(f"unknown keys {sorted(unknown)}")
    x["sections"] = sections
    if (s := x.pop("schema", None)) is not None:
        x["schema"] = _schema(s)
    return Config(**x)


def load(path: str) -> Config:
    with open(path, encoding="utf-8") as f:
        return parse(f.read())


def _schema(x: dict) -> TableSchema:
    if unknown := set(x) - {"name", "columns"}:
        raise ConfigError(f"unknown schema keys {sorted(unknown)}")
    columns = []
    for c in x.get("columns", []):
        if unknown := set(c) - {"name", "dtype"}:
            raise ConfigError(f"unknown column keys {sorted(unknown)}")
        d = c.get("dtype")
        try:
            if isinstance(d, dict):
                if set(d) != {"FixedStr"}:
                    raise ConfigError(f"unknown type {d!r}")
                d = fixed_str(d["FixedStr"])
            else:
                d = DType(d)
            columns.append((c.get("name", ""), d))
        except SchemaError as e:
            raise ConfigError(str(e)) from e
    try:
        return TableSchema(x.get("name", ""), columns)
    except SchemaError as e:
        raise ConfigError(str(e)) from e


def to_toml(c: Config) -> str:
    """The same configuration as TOML, in a fixed order."""
    quote = lambda s: '"' + s.replace("\\", "\\\\").replace('"', '\\"') + '"'
    lines = []
    for name, keys in c.sections.items():
        lines += [f"[{name}]", *[f"{k} = {json.dumps(v)}" for k, v in keys.items()], ""]
    lines += ["[db]", f"path = {quote(c.data_dir)}", *[f"{k} = {getattr(c, DB[k])}" for k in ("wal_size_mib", "segment_rows", "compaction_threads")], "", "[db.schema]", f"name = {quote(c.schema.name)}"]
    for d in c.schema.columns:
        kind = f"{{ FixedStr = {d.dtype.width} }}" if d.dtype.width else quote(d.dtype.name)
        lines += ["", "[[db.schema.columns]]", f"name = {quote(d.name)}", f"dtype = {kind}"]
    return "\n".join(lines) + "\n"
