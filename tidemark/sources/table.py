"""Time-series tables: an append log, sealed segments and a manifest in one folder.

    log/rec-000000/       one Parquet folder an append, committed by rename
    segments/seg-000001/  one Parquet folder a sealed segment
    manifest.json         the truth: segments in order, and log records they hold

A table has one writer.  Rows appended are visible at once; `flush` seals those
not yet in a segment.  The log is never shortened: it is the full history.
Folders that the manifest does not list are ignored, so a driver that dies in
the middle leaves the table as it was.

Rows keep `_rec` and `_row`, their record and place, which ordered scans use.
"""

from __future__ import annotations

from collections.abc import Iterable

import pyarrow as pa
from pyspark.sql import DataFrame, Observation, SparkSession, functions as F, types as T
from pyspark.errors import PySparkException

from ..errors import BatchError, LogError, SchemaError, UnknownSegmentError
from ..operators.predicates import ColumnPredicate
from ..operators.scan import time_range
from ..schema import TableSchema
from .batch import check_columns, checked
from .manifest import Manifest, SegmentRef, record_dir, segment_dir
from .store import Store

_ORDER = [T.StructField("_rec", T.LongType()), T.StructField("_row", T.LongType())]


class Table:
    """Open or create with `Table.open`."""

    def __init__(self, spark: SparkSession, path: str, schema: TableSchema, manifest: Manifest, records: int):
        self.spark, self.path, self.schema, self.manifest, self.records = spark, path, schema, manifest, records
        self.store = Store(spark, path)
        self._stored = T.StructType(schema.spark().fields + _ORDER)
        whole = TableSchema.from_json(manifest.schema)
        #: What the files hold: all columns, of which `schema` may name a part.
        self._whole = T.StructType(whole.spark().fields + _ORDER)
        self.narrow = whole.names != schema.names

    @classmethod
    def open(cls, spark: SparkSession, path: str, schema: TableSchema) -> Table:
        """The table at path, made if there is none.

        A schema that names a part of the table's columns, with their types and its
        time column, reads just those; flush and compact keep all, append is refused.
        """
        store = Store(spark, path)
        for d in ("log", "segments"):
            store.make_dirs(d)
        manifest = Manifest.load(store, schema)
        known = {c["name"]: c for c in manifest.schema["columns"]}
        if any(known.get(c["name"]) != c for c in schema.to_json()["columns"]) or schema.time_column != TableSchema.from_json(manifest.schema).time_column:
            raise SchemaError(f"{path} was made with other columns: {manifest.schema['columns']}")
        manifest.store(store)
        for name in store.list("log"):
            if name.endswith(".tmp"):
                store.delete(f"log/{name}")
        done = [int(n[4:]) for n in store.list("log")]
        if done != list(range(len(done))):
            raise LogError(f"the log has gaps: records {done}")
        if len(done) < manifest.log_records_applied:
            raise LogError(f"{manifest.log_records_applied} records are sealed, {len(done)} are in the log")
        return cls(spark, path, schema, manifest, len(done))

    # --- state

    @property
    def row_count(self) -> int:
        """Rows that are not sealed yet."""
        return self._log(self.manifest.log_records_applied).count()

    @property
    def sealed_segment_count(self) -> int:
        return len(self.manifest.sealed_segments)

    # --- writing

    def append(self, df: DataFrame) -> int:
        """Add rows; returns their number. Nothing is written to the table unless all of them fit."""
        if self.narrow:
            raise SchemaError(f"{self.path} has more columns than {self.schema.names}; open it with all of them to append")
        check_columns(df, self.schema)
        name = record_dir(self.records)
        seen = Observation()
        rows = checked(df, self.schema).withColumns({"_rec": F.lit(self.records).cast("long"), "_row": F.monotonically_increasing_id()})
        try:
            rows.observe(seen, F.count("*").alias("n")).write.mode("overwrite").parquet(self.store.path(f"{name}.tmp"))
        except PySparkException as e:
            self.store.delete(f"{name}.tmp")
            if "USER_RAISED_EXCEPTION" in str(e) or "NOT_NULL" in str(e):
                raise BatchError(str(e).splitlines()[0]) from e
            raise
        self.store.rename(f"{name}.tmp", name)
        self.records += 1
        return seen.get["n"]

    def flush(self) -> SegmentRef | None:
        """Seal the rows that are in no segment yet; nothing happens if there are none."""
        made = self._seal(self._log(self.manifest.log_records_applied, self._whole))
        if made is None:
            return None
        self.manifest.sealed_segments.append(made)
        self.manifest.log_records_applied = self.records
        self.manifest.store(self.store)
        return made

    def seal_when(self, rows: int) -> SegmentRef | None:
        """Flush if so many rows, or more, are in no segment yet."""
        return self.flush() if self.row_count >= rows else None

    def _seal(self, rows: DataFrame) -> SegmentRef | None:
        """Write a segment and take the next id; the manifest is stored by the caller."""
        number, t = self.manifest.next_segment_id, f"`{self.schema.time_column}`"
        at = segment_dir(number)
        seen = Observation()
        rows.observe(seen, F.count("*").alias("n"), F.min(t).alias("lo"), F.max(t).alias("hi")).write.mode("overwrite").parquet(self.store.path(at))
        if not (got := seen.get)["n"]:
            self.store.delete(at)
            return None
        self.manifest.next_segment_id = number + 1
        return SegmentRef(number, at, got["n"], got["lo"], got["hi"])

    def compact(self, ids: Iterable[int]) -> SegmentRef | None:
        """Make one segment of several, in manifest order, in the place of the first.

        The manifest is committed before old folders go. Of segments that are not
        neighbours, later ones move up to the first one's place.
        """
        wanted = set(ids)
        if not wanted:
            return None
        if unknown := wanted - {s.id for s in self.manifest.sealed_segments}:
            raise UnknownSegmentError(f"unknown segment ids {sorted(unknown)}")
        old = [s for s in self.manifest.sealed_segments if s.id in wanted]
        rows = self._segments(old, stored=self._whole)
        records = sorted(rows.groupBy("_seg").agg(F.min("_rec"), F.max("_rec")).collect())
        if all(a[2] < b[1] for a, b in zip(records, records[1:])):
            rows = rows.drop("_seg")  # records rise from segment to segment: the order is in the rows as they are
        else:
            rows = rows.orderBy("_seg", "_rec", "_row").drop("_seg", "_rec", "_row")
            rows = rows.withColumns({"_rec": F.lit(0).cast("long"), "_row": F.monotonically_increasing_id()})
        made = self._seal(rows)
        self.manifest.sealed_segments = [made if s is old[0] else s for s in self.manifest.sealed_segments if s is old[0] or s.id not in wanted]
        self.manifest.store(self.store)
        for s in old:
            self.store.delete(s.path)
        return made

    # --- reading

    def _segments(self, refs: list[SegmentRef], ordered: bool = True, stored: T.StructType | None = None) -> DataFrame:
        """Stored rows of segments; ordered: with `_seg`, their place among refs."""
        stored = stored or self._stored
        if not refs:
            return self.spark.createDataFrame([], T.StructType([*stored.fields, T.StructField("_seg", T.IntegerType())]))
        df = self.spark.read.schema(stored).parquet(*[self.store.path(s.path) for s in refs])
        if not ordered:
            return df
        number = F.regexp_extract(F.col("_metadata.file_path"), r"/seg-([0-9]+)/[^/]*$", 1).cast("int")
        place = F.array_position(F.array(*[F.lit(s.id) for s in refs]), number).cast("int")
        return df.withColumn("_seg", place)

    def _log(self, first: int = 0, stored: T.StructType | None = None) -> DataFrame:
        stored = stored or self._stored
        paths = [self.store.path(record_dir(i)) for i in range(first, self.records)]
        return self.spark.read.schema(stored).parquet(*paths) if paths else self.spark.createDataFrame([], stored)

    def scan_time_range(self, start: int, end: int, ordered: bool = False) -> DataFrame:
        """Rows in [start, end): only segments that may hold some are read.

        ordered: in the order of segments, then of the log, as written.
        """
        return self._scan(start, end, None, ordered)

    def scan_where(self, start: int, end: int, predicate: ColumnPredicate, ordered: bool = False) -> DataFrame:
        """Rows in [start, end) that fulfil the predicate."""
        return self._scan(start, end, predicate, ordered)

    def _scan(self, start: int, end: int, predicate: ColumnPredicate | None, ordered: bool) -> DataFrame:
        condition = predicate.compile(self.schema) if predicate else None
        sealed = self._segments(self.manifest.overlapping(start, end), ordered)
        active = self._log(self.manifest.log_records_applied)
        if ordered:
            active = active.withColumn("_seg", F.lit((1 << 31) - 1))
        else:
            sealed, active = sealed.select(*self.schema.names), active.select(*self.schema.names)
        t = self.schema.time_column
        out = sealed.unionByName(active)
        out = out.where(time_range(out, t, start, end))
        if condition is not None:
            out = out.where(condition)
        return out.orderBy("_seg", "_rec", "_row").select(*self.schema.names) if ordered else out

    def recover_records(self) -> DataFrame:
        """All log records ever written, sealed or not: `_rec`, rows and files."""
        return self._log().groupBy("_rec").agg(F.count("*").alias("rows"))

    def recover_payloads(self, first: int = 0, most: int = 4096) -> DataFrame:
        """Log records as bytes: `_rec`, `_part` (payloads of one record, in their order), rows, payload.

        A record is as many payloads as it needs to have at most `most` rows in each,
        so that no task holds a whole record; see `raw.decode_payload` for the bytes.
        """
        from . import raw

        schema = T.StructType([T.StructField("_rec", T.LongType()), T.StructField("_part", T.LongType()), T.StructField("rows", T.LongType()), T.StructField("payload", T.BinaryType())])

        def run(batches):
            for x in batches:
                rec, row = x.column("_rec").to_pylist(), x.column("_row").to_pylist()
                a = 0
                while a < x.num_rows:
                    b = a + 1
                    while b < min(x.num_rows, a + most) and rec[b] == rec[a]:
                        b += 1
                    columns = {c: x.column(c).slice(a, b - a).to_pylist() for c in self_schema.names}
                    yield pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in ((rec[a], pa.int64()), (row[a], pa.int64()), (b - a, pa.int64()), (raw.encode_payload(self_schema, columns), pa.binary()))], schema.names)
                    a = b

        self_schema = self.schema
        return self._log(first).mapInArrow(run, schema)

    def recover_batches(self, first: int = 0, ordered: bool = False) -> DataFrame:
        """Rows of the log from record `first` on, with `_rec`."""
        df = self._log(first)
        return (df.orderBy("_rec", "_row") if ordered else df).drop("_row")

    def wal_tail(self) -> DataFrame:
        """Rows of the log that no segment holds yet."""
        return self.recover_batches(self.manifest.log_records_applied)

    def manifest_rows(self) -> DataFrame:
        """The manifest's segments as a DataFrame: place, segment_id, path, row_count, min_ts, max_ts."""
        rows = [(i, s.id, s.path, s.row_count, s.min_ts, s.max_ts) for i, s in enumerate(self.manifest.sealed_segments)]
        return self.spark.createDataFrame(rows, "place long, segment_id long, path string, row_count long, min_ts long, max_ts long")
