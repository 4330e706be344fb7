"""Document fingerprints: one-permutation MinHash with optimal densification.

Each distinct 5-word shingle is hashed once; its leading bits choose one of
`BINS` bins and the smallest hash of a bin stands for it.  An empty bin copies
a full one found by its own sequence of hashed probes (the same for every
document), and the low `LOW_BITS` bits of each bin are packed.  The share of
equal bins overstates likeness by chance hits of those few bits, which is taken
off: (equal - 2**-b) / (1 - 2**-b).

Cases: a null or empty text, or one without words, has no shingle; all its bins
hold 0, so two such texts have likeness 1.  Fewer than five words are one
shingle.  Equal texts have equal fingerprints, and texts of any length take one
value a bin.  An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _runtime, _text

BINS, LOW_BITS = 512, 4
_NONE = np.uint64(_text.MASK)
_TRIES = 256
_BIN_BITS = BINS.bit_length() - 1
#: The bin that bin j looks at in its i-th probe.
_PROBES = (_text.mix(np.arange(BINS * _TRIES, dtype=np.uint64) + np.uint64(7)) % np.uint64(BINS)).astype(np.int64).reshape(_TRIES, BINS)


def fingerprints(texts: pa.Array) -> np.ndarray:
    """Packed fingerprints, BINS * LOW_BITS / 8 bytes a row."""
    buf, off = _text.utf8(texts)
    values, counts = _text.distinct_sorted(*_text.shingles(*_text.words(buf, off)))
    n = len(counts)
    out = np.zeros((n, BINS * LOW_BITS // 8), np.uint8)
    at = np.concatenate([[0], np.cumsum(counts)])
    for a in range(0, n, 256):
        b = min(n, a + 256)
        v = values[at[a] : at[b]]
        cell = np.repeat(np.arange(b - a), counts[a:b]) * BINS + (v >> np.uint64(64 - _BIN_BITS)).astype(np.int64)
        first = np.ones(len(v), bool)
        first[1:] = cell[1:] != cell[:-1]  # values rise within a row: the first of a bin is its least
        low = np.zeros((b - a) * BINS, np.uint8)
        full = np.zeros((b - a) * BINS, bool)
        low[cell[first]] = (v[first] & np.uint64((1 << LOW_BITS) - 1)).astype(np.uint8)
        full[cell[first]] = True
        low = _densify(low, full, counts[a:b] > 0).reshape(b - a, BINS)
        out[a:b] = low[:, 0::2] << 4 | low[:, 1::2]
    return out


def _densify(low: np.ndarray, full: np.ndarray, some: np.ndarray) -> np.ndarray:
    todo = np.flatnonzero(~full & np.repeat(some, BINS))
    row, own = todo // BINS * BINS, todo % BINS
    out = low.copy()
    for i in range(_TRIES):
        if not len(row):
            return out
        source = row + _PROBES[i, own]
        ok = full[source]
        out[row[ok] + own[ok]] = low[source[ok]]
        row, own = row[~ok], own[~ok]
    for step in range(1, BINS):  # after so many misses: the next full bin
        if not len(row):
            break
        source = row + (own + step) % BINS
        ok = full[source]
        out[row[ok] + own[ok]] = low[source[ok]]
        row, own = row[~ok], own[~ok]
    return out


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated Jaccard similarity of packed fingerprints, row by row."""
    x = a ^ b
    equal = ((x >> 4 == 0).sum(1) + (x & 15 == 0).sum(1)) / BINS
    chance = 2.0**-LOW_BITS
    return np.clip((equal - chance) / (1 - chance), 0, 1)


def fingerprint_column(df: DataFrame, text: str = "text", out: str = "fingerprint") -> DataFrame:
    """df with the packed fingerprint of its text column as binary."""
    _runtime.tune(df.sparkSession)
    schema = T.StructType([f for f in df.schema.fields if f.name != out] + [T.StructField(out, T.BinaryType())])
    names = [f.name for f in schema.fields[:-1]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            made = pa.array([r.tobytes() for r in fingerprints(x.column(text))], pa.binary())
            yield pa.RecordBatch.from_arrays([*[x.column(c) for c in names], made], [*names, out])

    return df.transform(_runtime.mapped, run, schema)


_EDITED = _runtime.schema("doc_id long, n_chars long, edited_sha256 binary, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double")


def _edited(ids: list, texts: list[str], following: list[str]) -> pa.RecordBatch:
    """Result rows of documents and the documents after them."""
    n = [len(t) for t in texts]
    edited = [t[: k - k // 3] + f[: k // 3] for t, k, f in zip(texts, n, following)]
    own, new, after = (fingerprints(pa.array(x, pa.large_string())) for x in (texts, edited, following))
    raw = lambda p: pa.array([r.tobytes() for r in p], pa.binary())
    shas = pa.array([hashlib.sha256(t.encode()).digest() for t in edited], pa.binary())
    return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), shas, raw(own), raw(new), pa.array(likeness(own, new)), pa.array(likeness(own, after))], _EDITED.names)


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts, of their edited texts and the likeness of both and of the next document.

    A text's last third gives way to as much of the next document by descending
    doc_id (null ids last, ties by text hash; after the last comes the first).
    Texts are range-partitioned once by that order and streamed; only the first
    and last row of each partition wait for a second, tiny step.
    """
    spark = docs.sparkSession
    _runtime.tune(spark)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    n = _runtime.partitions(rows)
    rows = rows.repartitionByRange(n, F.col("doc_id").desc_nulls_last(), F.xxhash64("text")).sortWithinPartitions(F.col("doc_id").desc_nulls_last(), F.xxhash64("text"))
    schema = T.StructType(_EDITED.fields + [T.StructField("_part", T.IntegerType()), T.StructField("_edge", T.StringType()), T.StructField("_text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, waiting = TaskContext.get().partitionId(), None

        def edge(kind, doc_id, text):
            cols = {"doc_id": pa.array([doc_id], pa.int64()), "_part": pa.array([part], pa.int32()), "_edge": pa.array([kind]), "_text": pa.array([text])}
            return pa.RecordBatch.from_arrays([cols.get(f.name, pa.nulls(1, pa.int64() if f.name == "n_chars" else pa.float64() if f.name.startswith("near") else pa.string() if f.name.startswith("_") else pa.binary())) for f in schema.fields], schema.names)

        for x in batches:
            ids, texts = x.column("doc_id").to_pylist(), x.column("text").to_pylist()
            if not ids:
                continue
            if waiting is None:
                yield edge("head", ids[0], texts[0])
            else:
                ids.insert(0, waiting[0])
                texts.insert(0, waiting[1])
            waiting = ids.pop(), texts[-1]
            if ids:
                made = _edited(ids, texts[:-1], texts[1:])
                k = len(ids)
                yield pa.RecordBatch.from_arrays([*made.columns, pa.array([part] * k, pa.int32()), pa.nulls(k, pa.string()), pa.nulls(k, pa.string())], schema.names)
        if waiting is not None:
            yield edge("tail", *waiting)

    made = _runtime.table(rows.transform(_runtime.mapped, run, schema), f"{_runtime.run_dir(spark, 'edits')}/rows")
    edges = made.where(F.col("_edge").isNotNull()).select("_part", "_edge", "doc_id", "_text")
    parts = sorted(r[0] for r in edges.where("_edge = 'tail'").select("_part").collect())  # one number a partition
    after = spark.createDataFrame(list(zip(parts, parts[1:] + parts[:1])), "_part int, _next int")
    heads = edges.where("_edge = 'head'").select(F.col("_part").alias("_next"), F.col("_text").alias("_following"))
    pairs = edges.where("_edge = 'tail'").join(after, "_part").join(heads, "_next").select("doc_id", "_text", "_following")

    def last(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            if x.num_rows:
                yield _edited(*(c.to_pylist() for c in x.columns))

    out = made.where(F.col("_edge").isNull()).select(*_EDITED.names).unionByName(pairs.transform(_runtime.mapped, last, _EDITED))
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")})
