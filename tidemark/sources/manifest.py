"""The manifest: which segments a table has, in order, and how much of its log they hold."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field

from ..schema import TableSchema
from .store import Store

FILE, VERSION = "manifest.json", 1


@dataclass
class SegmentRef:
    id: int
    path: str
    row_count: int
    min_ts: int | None = None
    max_ts: int | None = None

    def overlaps(self, start: int, end: int) -> bool:
        """Whether it may hold rows in [start, end)."""
        return start < end and self.min_ts is not None and self.max_ts >= start and self.min_ts < end


@dataclass
class Manifest:
    schema: dict
    version: int = VERSION
    log: str = "log"
    log_records_applied: int = 0
    next_segment_id: int = 1
    sealed_segments: list[SegmentRef] = field(default_factory=list)

    @classmethod
    def load(cls, store: Store, schema: TableSchema) -> Manifest:
        """The stored manifest, or an empty one."""
        if not store.exists(FILE):
            return cls(schema.to_json())
        x = json.loads(store.read_text(FILE))
        x["sealed_segments"] = [SegmentRef(**s) for s in x["sealed_segments"]]
        return cls(**x)

    def store(self, store: Store) -> None:
        store.replace_text(FILE, json.dumps(asdict(self), indent=1))

    def overlapping(self, start: int, end: int) -> list[SegmentRef]:
        return [s for s in self.sealed_segments if s.overlaps(start, end)]


def segment_dir(number: int) -> str:
    return f"segments/seg-{number:06d}"


def record_dir(number: int) -> str:
    return f"log/rec-{number:06d}"
