"""Language ID by nearest centroids of TF-IDF n-gram vectors.

Letters (A-Z lower-cased, other ASCII signs as spaces) give byte n-grams of two
and three, hashed to CELLS cells.  A vector is log(1 + count) x idf, of length
one.  Each language has up to CLUSTERS centroids (spherical k-means), so that
its different kinds of text each have one, and a text takes the language of the
nearest by cosine.  A text further from it than nearly all of that centroid's
own members is marked as rejected.

idf counts every training row.  Centroids are fitted on at most SAMPLE rows a
language, those with the smallest id hashes, of one id the least text; the centroids' size is bounded by
MAX_LANGUAGES.

Cases: null texts and texts without a letter are `und` with score 0, as is
everything if there is nothing to learn from; rows with a null lang or id teach
nothing, nor does a language whose sample has no letter; texts are read whole; repeated rows get the same answer; an empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from . import _runtime, _text

CELLS, CLUSTERS, SAMPLE, MAX_LANGUAGES = 8192, 4, 384, 1000
_HALF = np.uint32(CELLS // 2)
_SIGN = np.array([32 if b < 128 and not chr(b).isalpha() else b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint32)
_ROWS = 48


def _cells(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The cell of each n-gram of the rows, a space added on both sides, and the row of each."""
    n, size = len(off) - 1, np.diff(off)
    row = np.repeat(np.arange(n, dtype=np.int32), size + 2)
    x = np.full(len(row), 32, np.uint32)
    x[np.arange(len(buf)) + 2 * np.repeat(np.arange(n), size) + 1] = _SIGN[buf]
    two, three, ok2, ok3 = _hashed(x, row[1:] == row[:-1])
    return np.concatenate([two[ok2], three[ok3]]).astype(np.int64), np.concatenate([row[:-1][ok2], row[:-2][ok3]]).astype(np.int64)


def _hashed(x: np.ndarray, same: np.ndarray) -> tuple[np.ndarray, ...]:
    """Cells of all bigrams and trigrams of signs, and which of them count; same: whether a sign's next is of its row."""
    two = (x[:-1] * np.uint32(0x9E3779B1) ^ x[1:] * np.uint32(0x85EBCA77)) * np.uint32(0xC2B2AE3D)
    space = x == 32
    ok2 = same & ~(space[1:] & space[:-1])
    ok3 = same[1:] & same[:-1] & ~(space[1:-1] & (space[2:] | space[:-2]))
    three = (two[:-1] ^ x[2:] * np.uint32(0x27D4EB2F)) * np.uint32(0x165667B1)
    shift = np.uint32(34 - CELLS.bit_length())  # to CELLS / 2
    return two >> shift, (three >> shift) + _HALF, ok2, ok3


def counts(texts: pa.Array) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, counts of up to _ROWS rows x CELLS): never more than one such block at a time."""
    buf, off = _text.utf8(texts)
    a = 0
    while a < len(texts):
        b = a + 1
        while b < len(texts) and b - a < _ROWS and off[b + 1] - off[a] <= _text.BLOCK:
            b += 1
        total = np.zeros((b - a) * CELLS, np.float32)
        if b - a == 1:  # one text, perhaps a very long one: by pieces, each n-gram where it ends
            signs = np.concatenate([[32], _SIGN[buf[off[a] : off[b]]], [32]]).astype(np.uint8)
            for p in range(0, len(signs), _text.BLOCK):
                x = signs[max(0, p - 2) : p + _text.BLOCK].astype(np.uint32)
                two, three, ok2, ok3 = _hashed(x, np.ones(len(x) - 1, bool))
                ok2[:1] &= p == 0  # else it ended in the piece before
                total += np.bincount(np.concatenate([two[ok2], three[ok3]]).astype(np.int64), minlength=CELLS)
        else:
            cells, rows = _cells(buf[off[a] : off[b]], off[a : b + 1] - off[a])
            total += np.bincount(rows * CELLS + cells, minlength=len(total))
        yield a, total.reshape(b - a, CELLS)
        a = b


def _unit(tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = np.log1p(tf, out=tf)
    v *= idf
    norm = np.sqrt(np.einsum("ij,ij->i", v, v))
    v /= np.maximum(norm, 1e-12)[:, None]
    return v


def _has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """Rows that hold each cell, and all rows; tasks send one sum each."""
    schema = _runtime.schema("cell int, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, n = np.zeros(CELLS, np.int64), 0
        for x in batches:
            for _, c in counts(x.column(0)):
                seen += (c > 0).sum(0)
                n += len(c)
        at = np.append(np.flatnonzero(seen), CELLS).astype(np.int32)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(np.append(seen, n)[at])], schema.names)

    out = np.zeros(CELLS + 1, np.int64)
    for r in texts.transform(_runtime.mapped, run, schema).groupBy("cell").agg(F.sum("n").alias("n")).collect():  # at most CELLS + 1 rows
        out[r["cell"]] = r["n"]
    return out[:CELLS], int(out[CELLS])


def _cluster(v: np.ndarray) -> list[tuple[np.ndarray, float]]:
    """Spherical k-means, started from rows far apart; centroids with the cosine that nearly all members exceed."""
    k = min(CLUSTERS, len(v))
    centre = [v.mean(0)]
    centre[0] = centre[0] / max(1e-12, float(np.linalg.norm(centre[0])))
    while len(centre) < k:
        near = (v @ np.array(centre).T).max(1)
        centre.append(v[int(near.argmin())])
    c = np.array(centre)
    for _ in range(12):
        own = (v @ c.T).argmax(1)
        new = np.array([v[own == j].mean(0) if (own == j).any() else c[j] for j in range(k)])
        new /= np.maximum(np.linalg.norm(new, axis=1), 1e-12)[:, None]
        if np.allclose(new, c, atol=1e-6):
            break
        c = new
    cos = v @ c.T
    own = cos.argmax(1)
    return [(c[j], float(np.quantile(cos[own == j, j], 0.01)) * 0.9) for j in range(k) if (own == j).any()]


class Centroids:
    def __init__(self, idf: np.ndarray, langs: list[str], vectors: np.ndarray, radius: np.ndarray):
        self.idf, self.langs, self.vectors, self.radius = idf, langs, vectors, radius


def fit(docs: DataFrame, train: Column) -> Centroids:
    """Learn from the rows of docs (doc_id, text, lang) where train holds."""
    spark = docs.sparkSession
    _runtime.tune(spark)
    rows = docs.where(train & F.col("text").isNotNull() & F.col("lang").isNotNull()).select("lang", "text", F.xxhash64("doc_id").alias("h"))
    seen, n = document_frequencies(rows.select("text"))
    idf = (np.log((1 + n) / (1 + seen)) + 1).astype(np.float32)
    ranked = rows.select("lang", "h").withColumn("r", F.row_number().over(Window.partitionBy("lang").orderBy("h"))).where(F.col("r") <= SAMPLE)
    limits = {r["lang"]: r["h"] for r in ranked.groupBy("lang").agg(F.max("h").alias("h")).limit(MAX_LANGUAGES + 1).collect()}
    if len(limits) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    if not limits:
        return Centroids(idf, [], np.zeros((0, CELLS), np.float32), np.zeros(0))
    sample = rows.join(F.broadcast(spark.createDataFrame(list(limits.items()), "lang string, top long")), "lang").where("h <= top")
    sample = sample.groupBy("lang", "h").agg(F.min("text").alias("text"))  # at most SAMPLE a language, however often a doc_id is repeated
    known = spark.sparkContext.broadcast(idf)

    schema = _runtime.schema("lang string, vector binary, radius double")

    def learn(rows: pa.Table) -> pa.Table:
        texts = sorted(t for t in rows.column("text").to_pylist() if _has_letter(t))
        made = _cluster(np.concatenate([_unit(c, known.value) for _, c in counts(pa.array(texts, pa.large_string()))])) if texts else []
        lang = rows.column("lang")[0].as_py()
        columns = [[lang] * len(made), [c.astype(np.float32).tobytes() for c, _ in made], [r for _, r in made]]
        return pa.table([pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.binary(), pa.float64()))], names=schema.names)

    found = sample.groupBy("lang").applyInArrow(learn, schema).orderBy("lang", "vector").collect()
    vectors = np.array([np.frombuffer(r["vector"], np.float32) for r in found]).reshape(-1, CELLS)
    return Centroids(idf, [r["lang"] for r in found], vectors, np.array([r["radius"] for r in found]))


def predict(docs: DataFrame, model: Centroids) -> DataFrame:
    """docs with lang_pred, score (cosine) and rejected; reads nothing but text."""
    spark = docs.sparkSession
    _runtime.tune(spark)
    known = spark.sparkContext.broadcast(model)
    new = {"lang_pred": T.StringType(), "score": T.DoubleType(), "rejected": T.BooleanType()}
    kept = [f for f in docs.schema.fields if f.name not in new]
    schema = T.StructType(kept + [T.StructField(k, v) for k, v in new.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = known.value
        for x in batches:
            texts = x.column("text")
            letters = np.fromiter((_has_letter(t) for t in texts.to_pylist()), bool, len(texts))
            best, score = np.zeros(len(texts), np.int64), np.zeros(len(texts))
            if m.langs:
                for a, c in counts(texts):
                    cos = _unit(c, m.idf) @ m.vectors.T
                    best[a : a + len(c)] = cos.argmax(1)
                    score[a : a + len(c)] = cos.max(1)
            else:
                letters[:] = False
            score = np.where(letters, np.clip(score, 0, 1), 0)
            names = [m.langs[i] if ok else "und" for i, ok in zip(best.tolist(), letters.tolist())]
            far = ~letters | (score < (m.radius[best] if m.langs else 0))
            yield pa.RecordBatch.from_arrays([*[x.column(f.name) for f in kept], pa.array(names, pa.string()), pa.array(score), pa.array(far)], schema.names)

    return docs.transform(_runtime.mapped, run, schema)
