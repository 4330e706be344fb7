"""LM scoring with an Elias-Fano n-gram trie.

Level 1 holds the words' 64-bit hashes; level n holds, below each node of level
n - 1, the 32-bit codes of the words that followed it at least LEAST times.  A
level is cut into shards by a hash of (node, code), so that a frequent word's
successors are spread.  A node's number is its place in its shard times the number
of shards plus its shard, so that numbers lie close together.  In a shard the nodes are an Elias-Fano sequence, where
each one's successors begin is another (monotone pointers), and a word is found
by successor search among the codes of its context only.  Probabilities and
back-off weights are one byte each.  Shards are written by the tasks that count
them to the shared folder and memory-mapped by all.

p(w | context) = a(context, w) + g(context) p(w | shorter context), with
a = (count - DISCOUNT) / count(context) for the n-grams kept and g the rest, and
p(w) = (c + 0.5) / (N + 0.5 (V + 1)).  Counts come from all training documents,
in packed blocks that each batch has summed; each level is one pass, which keeps
n-grams whose shorter forms were kept.

Cases: a null text is an empty one, that is an end alone; a null doc_id trains
and is not held out; unknown words have c = 0; texts are read whole; repeated
rows train as often as they come; with no training rows all counts are 0; an
empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T

from . import _runtime, _text, elias_fano as ef

ORDER, LEAST, DISCOUNT = 3, 1, 0.75
#: Bytes of text that are scored at once.
BLOCK = 3 << 20
END = np.uint64(_text.mix_int(77))
_SCALE = 255 / 8.0
_U32 = np.uint64(32)


def _quantised(p: np.ndarray) -> np.ndarray:
    """One byte for a probability: 0 is 1, 255 is 10**-8 or less."""
    return np.clip(np.round(-np.log10(np.maximum(p, 1e-9)) * _SCALE), 0, 255).astype(np.uint8)


_VALUE = 10.0 ** (-np.arange(256) / _SCALE)


def _tokens(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Token hashes, an end after each row's words, and tokens per row."""
    buf, off = _text.utf8(texts)
    h, counts = _text.words(buf, off)
    n = counts + 1
    ends = np.cumsum(n) - 1
    out = np.full(int(n.sum()), END, np.uint64)
    keep = np.ones(len(out), bool)
    keep[ends] = False
    out[keep] = h
    return out, n


def _shard(node: np.ndarray, code: np.ndarray, shards: int) -> np.ndarray:
    return (_text.mix(node * np.uint64(0x9E3779B97F4A7C15) + code) >> np.uint64(16)) % np.uint64(shards)


def _codes(h: np.ndarray) -> np.ndarray:
    return h >> _U32


class Trie:
    """The levels written so far, opened shard by shard when needed."""

    def __init__(self, path: str, shards: int, levels: int):
        self.path, self.shards, self.levels = path, shards, levels
        self._open: dict[str, list] = {}

    def _file(self, name: str) -> list:
        if name not in self._open:
            self._open[name] = ef.load(_runtime.map_file(f"{self.path}/{name}"))
        return self._open[name]

    def _each(self, shard: np.ndarray):
        shard = _small(shard)  # narrow numbers are sorted by radix
        order = np.argsort(shard, kind="stable")
        cut = np.searchsorted(shard[order], np.arange(self.shards + 1))
        for k in range(self.shards):
            if cut[k + 1] > cut[k]:
                yield k, order[cut[k] : cut[k + 1]]

    def words(self, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node (or -1) and count of each distinct word hash."""
        node, count = np.full(len(h), -1, np.int64), np.zeros(len(h), np.int64)
        for k, rows in self._each((_shard(h, np.uint64(0), self.shards)).astype(np.int64)):
            *words, counts = self._file(f"1-{k}")
            if not len(counts):
                continue
            rows = rows[np.argsort(h[rows])]
            at = ef.Sequence(*words).find(h[rows])
            hit = at >= 0
            node[rows[hit]] = at[hit] * self.shards + k
            count[rows[hit]] = counts[at[hit]]
        return node, count

    def find(self, level: int, node: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Node of the n-gram that code makes of a node of the level above, or -1, and its a as a byte."""
        out, a = np.full(len(node), -1, np.int64), np.zeros(len(node), np.uint8)
        some = np.flatnonzero(node >= 0)
        u = node[some].astype(np.uint64)
        for k, part in self._each(_shard(u, code[some], self.shards).astype(np.int64)):
            x = self._file(f"{level}-{k}")
            codes, share = x[8], x[9]
            if not len(codes):
                continue
            rows = some[part]
            rows = rows[np.argsort(node[rows])]
            own = node[rows]
            new = np.append(True, own[1:] != own[:-1])  # each node is looked for once
            at = ef.Sequence(*x[:4]).find(own[new].astype(np.uint64))
            pointers, known = ef.Sequence(*x[4:8]), at >= 0
            start, end = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
            start[known], end[known] = pointers.get(at[known]), pointers.get(at[known] + 1)
            own = np.cumsum(new) - 1
            hit = known[own]
            rows, own = rows[hit], own[hit]
            if not len(rows):
                continue
            start, end = start[own], end[own]
            wanted = code[rows].astype(np.uint32)
            place = ef.successor(lambda i: codes[i], start, end, wanted)
            hit = place < end
            hit[hit] = codes[place[hit]] == wanted[hit]
            out[rows[hit]] = place[hit] * self.shards + k
            a[rows[hit]] = share[place[hit]]
        return out, a

    def counts(self, level: int, shard: int) -> np.ndarray:
        """How often each node's n-gram occurs; level 1 keeps that beside its words."""
        return self._file("1-%d" % shard)[-1] if level == 1 else self._file(f"c{level}-{shard}")[0]

    def array(self, name: str, node: np.ndarray) -> np.ndarray:
        """Values of a per-node array (`g1`, `c2` and so on) at nodes."""
        out = np.zeros(len(node), np.int64)
        place = node // self.shards
        for k, rows in self._each(node - place * self.shards):
            values = self.counts(1, k) if name == "c1" else self._file(f"{name}-{k}")[0]
            out[rows] = values[place[rows]]
        return out


_MAPPED: dict[str, Trie] = {}


def _trie(path: str, shards: int, levels: int) -> Trie:
    """The trie of this worker process, its files mapped once."""
    t = _MAPPED.get(path)
    if t is None or t.levels != levels:
        _MAPPED.clear()
        t = _MAPPED[path] = Trie(path, shards, levels)
    return t


class _Batch:
    """The tokens of a batch and what the trie knows of them."""

    def __init__(self, texts: pa.Array, trie: Trie | None):
        self.h, self.n = _tokens(texts)
        self.last = np.cumsum(self.n) - 1
        first = np.zeros(len(self.h), bool)
        first[self.last - self.n + 1] = True
        self.first = first
        self.trie = trie
        self.own, self.words = pd.factorize(self.h)
        if trie is not None:
            node, count = trie.words(self.words)
            self.count = count[self.own]
            self.nodes = {1: node[self.own]}
            #: Of each level, the tokens looked up, which of the distinct n-grams is theirs, and their nodes.
            self.distinct = {1: (slice(None), self.own, node)}

    def extend(self, level: int) -> tuple[np.ndarray, np.ndarray]:
        """Node of the n-gram of this level that ends at each token, or -1, and its a; the same n-gram is looked up once."""
        above = np.full(len(self.h), -1, np.int64)
        above[1:] = self.nodes[level - 1][:-1]
        above[self.first] = -1
        if level > 2:  # its later words must make a kept n-gram as well
            above[self.nodes[level - 1] < 0] = -1
        node, a = np.full(len(self.h), -1, np.int64), np.zeros(len(self.h), np.uint8)
        self.above = above
        rows = np.flatnonzero(above >= 0)
        key = _text.mix(above[rows].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93) + self.h[rows])
        own, found = pd.factorize(key)
        if len(found):
            where = np.empty(len(found), np.int64)
            where[own[::-1]] = np.arange(len(own))[::-1]
            got, share = self.trie.find(level, above[rows[where]], _codes(self.h[rows[where]]))
            node[rows], a[rows] = got[own], share[own]
            self.distinct[level] = rows, own, got
        self.nodes[level] = node
        return node, a

    def left(self, level: int) -> np.ndarray:
        """What the n-gram of this level that ends before each token leaves to the shorter context; 1 if there is none."""
        out = np.ones(len(self.h) + 1)
        if level in self.distinct:
            rows, own, node = self.distinct[level]
            g = np.ones(len(node))
            g[node >= 0] = _VALUE[self.trie.array(f"g{level}", node[node >= 0])]
            out[1:][rows] = g[own]
        out = out[:-1]
        out[self.first] = 1.0
        return out


def _small(counts: np.ndarray) -> np.ndarray:
    top = int(counts.max()) if len(counts) else 0
    return counts.astype(np.uint8 if top < 256 else np.uint16 if top < 65536 else np.uint32 if top < 1 << 32 else np.uint64)


def _pack(node: np.ndarray, code: np.ndarray | None, counts: np.ndarray) -> bytes:
    """Sorted (node, code) with counts; a node is written once for all its codes."""
    if code is None:
        return ef.save([node, _small(counts)])
    begin = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
    heads = node[begin]
    # a node is the step from the one before
    return ef.save([heads[:1], _small(np.diff(heads, prepend=heads[:1])), _small(np.diff(np.append(begin, len(node)))), code.astype(np.uint32), _small(counts)])


def _unpack(blob: bytes):
    x = ef.load(np.frombuffer(blob, np.uint8))
    if len(x) == 2:
        return x[0], np.zeros(len(x[0]), np.uint32), x[1].astype(np.uint32)
    return np.repeat(x[0] + np.cumsum(x[1], dtype=np.uint64), x[2]), x[3], x[4].astype(np.uint32)


def _summed(node: np.ndarray, code: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct (node, code) with their sums."""
    order = np.lexsort((code, node))
    node, code, counts = node[order], code[order], counts[order]
    begin = np.flatnonzero(np.append(True, (node[1:] != node[:-1]) | (code[1:] != code[:-1]))) if len(node) else np.zeros(0, np.int64)
    return node[begin], code[begin], np.add.reduceat(counts, begin, dtype=np.int64) if len(begin) else counts.astype(np.int64)


def _counted(train: DataFrame, level: int, path: str, shards: int) -> DataFrame:
    """shard, block: the n-grams of a level, summed by batch. train: a text column."""
    schema = _runtime.schema("shard int, block binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(path, shards, level - 1) if level > 1 else None
        for x in batches:
            if not x.num_rows:
                continue
            b = _Batch(x.column("text"), trie)
            if level == 1:
                node, code, counts = b.words, np.zeros(len(b.words), np.uint64), np.bincount(b.own)
                shard = _shard(node, code, shards)
            else:
                for k in range(2, level):
                    b.extend(k)
                above = np.full(len(b.h), -1, np.int64)
                above[1:] = b.nodes[level - 1][:-1]
                above[b.first] = -1
                if level > 2:
                    above[b.nodes[level - 1] < 0] = -1
                rows = np.flatnonzero(above >= 0)
                node, code = above[rows].astype(np.uint64), _codes(b.h[rows])
                own, found = pd.factorize(_text.mix(node * np.uint64(0xD6E8FEB86659FD93) + code))
                counts = np.bincount(own, minlength=len(found))
                where = np.empty(len(found), np.int64)
                where[own[::-1]] = np.arange(len(own))[::-1]
                node, code = node[where], code[where]
                shard = _shard(node, code, shards)
            order = np.argsort(node)
            order = order[np.argsort(_small(shard[order]), kind="stable")]
            cut = np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))
            rows = []
            for k in range(shards):
                part = order[cut[k] : cut[k + 1]]
                if len(part):
                    rows.append((k, _pack(node[part], None if level == 1 else code[part], counts[part])))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema.names)

    return train.transform(_runtime.mapped, run, schema)


def _written(blocks: DataFrame, level: int, path: str, shards: int, top: bool) -> DataFrame:
    """Write a level's shards. Returns shard, n (kept), total, and what contexts gave away, by their shard."""
    schema = _runtime.schema("shard int, n long, total long, above int, given binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: dict[int, list] = {}
        for x in batches:
            for k, blob in zip(x.column("shard").to_pylist(), x.column("block").to_pylist()):
                parts.setdefault(k, []).append(_unpack(blob))
        for k in sorted(parts):
            node, code, counts = _summed(*(np.concatenate([p[i] for p in parts[k]]) for i in range(3)))
            parts[k] = []
            total, out = int(counts.sum()), []
            if level == 1:
                _runtime.put_file(f"{path}/1-{k}", ef.save([*ef.build(node, _text.MASK), _small(counts)]))
            else:
                keep = counts >= LEAST
                node, code, counts = node[keep], code[keep], counts[keep]
                begin = np.flatnonzero(np.append(True, node[1:] != node[:-1])) if len(node) else np.zeros(0, np.int64)
                heads = node[begin]
                trie = _trie(path, shards, level - 1)
                context = np.repeat(trie.array(f"c{level - 1}", heads.astype(np.int64)), np.diff(np.append(begin, len(node))))
                share = (counts - DISCOUNT) / np.maximum(context, counts)
                arrays = [*ef.build(heads, int(heads[-1]) if len(heads) else 0), *ef.build(np.append(begin, len(node)), len(node)), code.astype(np.uint32), _quantised(share)]
                _runtime.put_file(f"{path}/{level}-{k}", ef.save(arrays))
                if not top:  # only longer n-grams ask for the counts
                    _runtime.put_file(f"{path}/c{level}-{k}", ef.save([_small(counts)]))
                given = np.add.reduceat(share, begin) if len(begin) else np.zeros(0)
                place = (heads // np.uint64(shards)).astype(np.int64)
                for j, rows in trie._each(heads.astype(np.int64) - place * shards):
                    out.append((j, ef.save([place[rows].astype(np.uint32), np.round(np.minimum(given[rows], 1.0) * 65535).astype(np.uint16)])))
            rows = out or [(None, None)]
            first = [1] + [0] * (len(rows) - 1)
            yield pa.RecordBatch.from_arrays([pa.array([k] * len(rows), pa.int32()), pa.array([len(node) * f for f in first], pa.int64()), pa.array([total * f for f in first], pa.int64()), pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], schema.names)

    return blocks.repartition(shards, "shard").transform(_runtime.mapped, run, schema)


def _weights(given: DataFrame, level: int, path: str, shards: int) -> None:
    """Write g, what each node of a level leaves to the shorter context, from what its successors took."""
    schema = _runtime.schema("above int")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken: dict[int, np.ndarray] = {}
        for x in batches:
            for k, blob in zip(x.column("above").to_pylist(), x.column("given").to_pylist()):
                if k not in taken:
                    taken[k] = np.zeros(len(_trie(path, shards, level).counts(level, k)))
                if blob is not None:
                    at, share = ef.load(np.frombuffer(blob, np.uint8))
                    np.add.at(taken[k], at.astype(np.int64), share / 65535)
        for k, t in taken.items():
            _runtime.put_file(f"{path}/g{level}-{k}", ef.save([_quantised(np.clip(1 - t, 1e-8, 1))]))
        yield pa.RecordBatch.from_arrays([pa.array(list(taken), pa.int32())], schema.names)

    every = given.sparkSession.range(shards).select(F.col("id").cast("int").alias("above"), F.lit(None).cast("binary").alias("given"))
    rows = given.where("above is not null").select("above", "given").unionByName(every)
    rows.repartition(shards, "above").transform(_runtime.mapped, run, schema).write.format("noop").mode("overwrite").save()


class Model:
    def __init__(self, path: str, shards: int, tokens: int, words: int, levels: int):
        self.path, self.shards, self.tokens, self.words, self.levels = path, shards, tokens, words, levels


def train(docs: DataFrame, order: int = ORDER) -> Model:
    """Count and write all levels from the text column of docs."""
    spark = docs.sparkSession
    _runtime.tune(spark)
    path = _runtime.run_dir(spark, "trie")
    shards = _runtime.partitions(docs, 4)
    tokens = words = 0
    for level in range(1, order + 1):
        at = f"{path}-made/{level}"
        spare = spark.range(shards).select(F.col("id").cast("int").alias("shard"), F.lit(_pack(*_empty(level))).alias("block"))
        blocks = _counted(docs.select("text"), level, path, shards).unionByName(spare)  # so that every shard is written
        made = _runtime.table(_written(blocks, level, path, shards, level == order), at)
        del blocks
        _runtime.tidy(spark)
        if level == 1:
            s = made.agg(F.sum("total").alias("t"), F.sum("n").alias("n")).first()
            tokens, words = s["t"] or 0, s["n"] or 0
        else:
            _weights(made, level - 1, path, shards)
        _runtime.drop(at)
    for name in [f"c{level}-{k}" for level in range(2, order) for k in range(shards)]:
        _runtime.drop(f"{path}/{name}")
    _runtime.drop(f"{path}-made")
    return Model(path, shards, int(tokens), int(words), order)


def _empty(level: int):
    none = np.zeros(0, np.uint64)
    return none, None if level == 1 else none, np.zeros(0, np.int64)


def score(docs: DataFrame, model: Model) -> DataFrame:
    """docs (without text) with n_tokens, n_known, base_score and score (log10)."""
    new = [T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()), T.StructField("base_score", T.DoubleType()), T.StructField("score", T.DoubleType())]
    kept = [f for f in docs.schema.fields if f.name not in {"text", *[n.name for n in new]}]
    schema = T.StructType(kept + new)
    path, shards, levels, tokens, words = model.path, model.shards, model.levels, model.tokens, model.words

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trie = _trie(path, shards, levels)
        for x in batches:
            if not x.num_rows:
                continue
            parts = [scored(_Batch(part, trie), trie) for part in _text.row_blocks(x.column("text"), BLOCK)]
            yield pa.RecordBatch.from_arrays([*(x.column(f.name) for f in kept), *(pa.array(np.concatenate(c)) for c in zip(*parts))], schema.names)

    def scored(b: _Batch, trie: Trie) -> tuple:
        p = (b.count + 0.5) / (tokens + 0.5 * (words + 1))
        at = np.cumsum(b.n) - b.n
        base = np.add.reduceat(np.log10(p), at)
        known = np.add.reduceat((b.count > 0).astype(np.int64), at)
        for level in range(2, levels + 1):
            _, a = b.extend(level)
            hit = b.nodes[level] >= 0
            p = b.left(level - 1) * p
            p[hit] += _VALUE[a[hit]]
        return b.n, known, base, np.add.reduceat(np.log10(np.minimum(p, 1.0)), at)

    return docs.transform(_runtime.mapped, run, schema)


def held_out(doc_id: Column, folds: int = 5, one: int = 1) -> Column:
    """Whether a document is kept from training."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % folds == one, F.lit(False))
