"""MinHash near-dedup by bottom-k sketches of one hash function.

A document's set is that of its distinct 5-word shingles; documents whose sets
have a Jaccard similarity of `percent` or more are linked, and linked documents
form groups.

1. Sketch: the K least shingle hashes.  Equal sets (a 128-bit sum over the
   whole set) are one node from here on, so copies never meet in pairs.
2. Inverted lists of retained values.  A linked pair shares at least `shared`
   of its retained values, so it shares one among the first
   (retained - shared + 1) in any common order; only these are filed.  The order
   is by frequency, rarest first, counted over all documents in packed blocks:
   values of common lines and passages are hardly ever filed, and values that
   one node alone retains make no list.
3. Each list proposes its members against one pivot, the member with the most
   widely shared values; lists of up to SMALL members propose all their pairs.
   Candidates are linear in the list.
4. The union sketch (the K least of both) estimates similarity; what falls below
   shared / K goes.  Exact Jaccard on full sets confirms the rest.
5. Where the members of a pivot's longer lists are in more than one group still, they
   meet in blocks, each two blocks in one task that compares all their sets: every
   pair that shares a filed value is linked, compared or redundant.

For sets of up to K - 1 shingles in the union step 2 is exact; for larger ones a
pair at the threshold shares fewer than `shared` of K (176 at 85 percent, 160 at
80) with a probability below RARE.

Cases: texts without words have no set, are linked with nothing and keep their
own id; fewer than five words are one shingle; a null doc_id never names a group
that has another; repeated rows are copies; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache
from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _runtime, _text
from .components import components

K, RARE = 256, 4e-11
#: Lists of up to so many members propose all their pairs at once.
SMALL = 8
#: Members of a pivot that meet in one block.
BLOCK = 192
FILTER_BITS = 22
_SKETCH = "doc_id long, n_shingles long, node binary, batch long, nodes binary, sizes binary, values binary"


def _nodes(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """128 bits of each row's set, as n x 2 numbers; zero for an empty set."""
    out = np.zeros((len(counts), 2), np.uint64)
    some = counts > 0
    if some.any():
        at = np.concatenate([[0], np.cumsum(counts)])[:-1][some]
        out[some, 0] = np.add.reduceat(_text.mix(values ^ np.uint64(0x5BD1E995)), at)
        out[some, 1] = np.add.reduceat(_text.mix(values + np.uint64(0x9E3779B9)), at)
    return out


def _sets(texts: pa.Array):
    buf, off = _text.utf8(texts)
    values, counts = _text.distinct_sorted(*_text.shingles(*_text.words(buf, off)))
    return values, counts, _nodes(values, counts)


def sketches(docs: DataFrame) -> DataFrame:
    """A row a document (doc_id, n_shingles, node) and a row a batch (batch, nodes, sizes, values).

    The latter packs the set size and the retained values of each node that the
    task had not met before.
    """
    _runtime.tune(docs.sparkSession)
    schema = _runtime.schema(_SKETCH)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        seen: set[bytes] = set()
        for number, x in enumerate(batches):
            values, counts, nodes = _sets(x.column("text"))
            keys = [k.tobytes() for k in nodes]
            lead = np.zeros(len(counts), bool)
            for i in np.flatnonzero(counts > 0).tolist():
                if keys[i] not in seen:
                    seen.add(keys[i])
                    lead[i] = True
            node = pa.array([k if c else None for k, c in zip(keys, counts.tolist())], pa.binary())
            n = len(counts)
            rest = [pa.nulls(n, f) for f in (pa.int64(), pa.binary(), pa.binary(), pa.binary())]
            yield pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(counts, pa.int64()), node, *rest], schema.names)
            if lead.any():
                take = np.where(lead, np.minimum(counts, K), 0)
                at = np.concatenate([[0], np.cumsum(counts)])[:-1]
                step = np.arange(int(take.sum())) - np.repeat(np.cumsum(take) - take, take)
                kept = values[np.repeat(at, take) + step]
                own = [TaskContext.get().partitionId() << 32 | number, nodes[lead].tobytes(), counts[lead].astype(np.int64).tobytes(), kept.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), *[pa.array([v], pa.int64() if i == 0 else pa.binary()) for i, v in enumerate(own)]], schema.names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").transform(_runtime.mapped, run, schema)


def _distinct_values(values: bytes, shards: int):
    """A batch's distinct values in order of shard, with their numbers and where each shard begins."""
    v, n = np.unique(np.frombuffer(values, np.uint64), return_counts=True)
    shard = (v >> np.uint64(20)) % np.uint64(shards)
    order = np.argsort(shard, kind="stable")
    return v[order], n[order], np.searchsorted(shard[order], np.arange(shards + 1, dtype=np.uint64))


def _frequencies(packed: DataFrame, shards: int) -> DataFrame:
    """batch, shard, counts: in how many nodes each distinct value of a batch is retained, up to 65535.

    Values travel in one block a batch and shard, already summed in their batch;
    the answers go back in the same order.
    """
    ask = _runtime.schema("batch long, shard int, values binary, counts binary")
    answer = _runtime.schema("batch long, shard int, counts binary")

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for batch, values in zip(x.column("batch").to_pylist(), x.column("values").to_pylist()):
                v, n, at = _distinct_values(values, shards)
                rows = [(batch, k, v[at[k] : at[k + 1]].tobytes(), n[at[k] : at[k + 1]].astype(np.uint32).tobytes()) for k in range(shards) if at[k + 1] > at[k]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.int64(), pa.int32(), pa.binary(), pa.binary()))], ask.names)

    def reply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [r for x in batches for r in zip(*(c.to_pylist() for c in x.columns))]
        if not rows:
            return
        v = np.concatenate([np.frombuffer(r[2], np.uint64) for r in rows])
        n = np.concatenate([np.frombuffer(r[3], np.uint32) for r in rows])
        _, own = np.unique(v, return_inverse=True)
        total = np.minimum(np.bincount(own, n), 65535).astype(np.uint16)[own]
        at = np.concatenate([[0], np.cumsum([len(r[2]) // 8 for r in rows])]).tolist()
        made = [total[a:b].tobytes() for a, b in zip(at[:-1], at[1:])]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows]), pa.array([r[1] for r in rows], pa.int32()), pa.array(made, pa.binary())], answer.names)

    return packed.select("batch", "values").transform(_runtime.mapped, send, ask).repartition(shards, "shard").transform(_runtime.mapped, reply, answer)


@cache
def _shared(percent: int) -> int:
    """How many of K retained values a pair at the threshold shares but with a probability below RARE."""
    p, below, s = percent / 100, 0.0, 0
    while s < K and (below := below + comb(K, s) * p**s * (1 - p) ** (K - s)) < RARE:
        s += 1
    return s


def _needed(n: int, percent: int) -> int:
    """How many retained values a set of n shares with any set it is linked with."""
    exact = -(-n * percent // 100)
    return exact if n * 100 <= (K - 1) * percent else min(_shared(percent), exact)


def _lists(packed: DataFrame, percent: int) -> DataFrame:
    """The filed values that several nodes share: v, node, n, pop (how widely a node's values are shared)."""
    shards = _runtime.partitions(packed)
    schema = _runtime.schema("v long, node binary, n long, pop long")
    answers = _frequencies(packed, shards).groupBy("batch").agg(F.collect_list(F.struct("shard", "counts")).alias("answers"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            for nodes, sizes, values, parts in zip(*(x.column(c).to_pylist() for c in ("nodes", "sizes", "values", "answers"))):
                yield _filed(nodes, np.frombuffer(sizes, np.int64), values, parts)

    def _filed(nodes: bytes, sizes: np.ndarray, raw: bytes, parts: list) -> pa.RecordBatch:
        asked, _, _ = _distinct_values(raw, shards)
        often = np.concatenate([np.frombuffer(p["counts"], np.uint16) for p in sorted(parts, key=lambda p: p["shard"])]).astype(np.int64)
        order = np.argsort(asked)
        values = np.frombuffer(raw, np.uint64)
        seen = often[order][np.searchsorted(asked[order], values)]
        at = np.concatenate([[0], np.cumsum(np.minimum(sizes, K))]).tolist()
        kept, rows, pop = [], [], np.zeros(len(sizes), np.int64)
        for i, (a, b) in enumerate(zip(at[:-1], at[1:])):
            own = seen[a:b]
            pop[i] = own.sum()
            first = np.argsort(own, kind="stable")[: (b - a) - _needed(int(sizes[i]), percent) + 1]
            first = first[own[first] > 1]  # a value of one node makes no list
            kept.append(values[a:b][first])
            rows.append(np.full(len(first), i))
        rows = np.concatenate(rows)
        names = pa.array([nodes[16 * i : 16 * i + 16] for i in range(len(sizes))], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(kept).view(np.int64)), names.take(pa.array(rows)), pa.array(sizes[rows]), pa.array(pop[rows])], schema.names)

    return packed.select("batch", "nodes", "sizes", "values").join(answers, "batch").transform(_runtime.mapped, run, schema)


def _near(a, b, percent: int):
    """Rows whose sizes allow the similarity."""
    return (F.least(a, b) * 100 >= F.greatest(a, b) * percent)


def _wanted(nodes: DataFrame) -> np.ndarray:
    """A bitmap of 2**FILTER_BITS bits that holds the nodes: its size is fixed."""
    ids = nodes.select(F.pmod(F.crc32("node"), F.lit(1 << FILTER_BITS)).alias("x")).distinct()
    bits = np.zeros(1 << FILTER_BITS, bool)
    bits[np.array(ids.toPandas()["x"], np.int64)] = True
    return np.packbits(bits)


def _has(bits: np.ndarray, keys: list) -> np.ndarray:
    import zlib

    at = np.array([zlib.crc32(k) if k is not None else 0 for k in keys], np.int64) & ((1 << FILTER_BITS) - 1)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8) & 1).astype(bool) & np.array([k is not None for k in keys], bool)


def _pool(docs: DataFrame, nodes: DataFrame) -> DataFrame:
    """node, sketch, whole: the sets of (at least) the given nodes, read from docs once."""
    bits = docs.sparkSession.sparkContext.broadcast(_wanted(nodes))
    schema = _runtime.schema("node binary, sketch binary, whole binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: set[bytes] = set()
        for x in batches:
            values, counts, nodes = _sets(x.column("text"))
            keys = [k.tobytes() if c else None for k, c in zip(nodes, counts.tolist())]
            at = np.concatenate([[0], np.cumsum(counts)]).tolist()
            out = []
            for i in np.flatnonzero(_has(bits.value, keys)).tolist():
                if keys[i] not in done:
                    done.add(keys[i])
                    v = values[at[i] : at[i + 1]]
                    out.append((keys[i], v[:K].tobytes(), v.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in out], pa.binary()) for j in range(3)], schema.names)

    return docs.select("text").transform(_runtime.mapped, run, schema).dropDuplicates(["node"])


def _payload(pool: DataFrame, pairs: DataFrame, column: str) -> DataFrame:
    """node, payload of (at least) the nodes of pairs."""
    bits = pool.sparkSession.sparkContext.broadcast(_wanted(pairs.select(F.explode(F.array("a", "b")).alias("node"))))
    schema = _runtime.schema("node binary, payload binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            ok = pa.array(_has(bits.value, x.column("node").to_pylist()))
            yield pa.RecordBatch.from_arrays([c.filter(ok) for c in x.columns], schema.names)

    return pool.select("node", F.col(column).alias("payload")).transform(_runtime.mapped, run, schema)


def _estimate(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    """Whether the union sketch leaves the similarity possible."""
    if len(x) < K and len(y) < K:
        return True  # both whole: the exact step decides
    union = np.union1d(x, y)[:K]
    both = np.intersect1d(np.intersect1d(x, y, True), union, True)
    return len(both) * K >= _shared(percent) * len(union)


def _exact(x: np.ndarray, y: np.ndarray, percent: int) -> bool:
    both = len(np.intersect1d(x, y, True))
    return 100 * both >= percent * (len(x) + len(y) - both)


def _passing(pairs: DataFrame, sets: DataFrame, test, percent: int) -> DataFrame:
    """Pairs (a, b) whose payloads pass the test."""
    schema = _runtime.schema("a binary, b binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            one, two = x.column("one"), x.column("two")
            ok = [test(np.frombuffer(one[i].as_buffer(), np.uint64), np.frombuffer(two[i].as_buffer(), np.uint64), percent) for i in range(x.num_rows)]
            rows = pa.array(np.flatnonzero(np.array(ok, bool)))
            yield pa.RecordBatch.from_arrays([x.column("a").take(rows), x.column("b").take(rows)], schema.names)

    one = sets.select(F.col("node").alias("a"), F.col("payload").alias("one"))
    two = sets.select(F.col("node").alias("b"), F.col("payload").alias("two"))
    return pairs.join(one, "a").join(two, "b").select("a", "b", "one", "two").transform(_runtime.mapped, run, schema)


def _verified(pairs: DataFrame, pool: DataFrame, percent: int, path: str) -> DataFrame:
    likely = _runtime.table(_passing(pairs, _payload(pool, pairs, "sketch"), _estimate, percent), f"{path}/likely")
    return _runtime.table(_passing(likely, _payload(pool, likely, "whole"), _exact, percent), f"{path}/links")


def grouped(docs: DataFrame, percent: int = 85) -> tuple[DataFrame, DataFrame, str]:
    """doc_id, n_shingles, node of each document; node, comp of all nodes with a link; the folder of both."""
    run = _runtime.run_dir(docs.sparkSession, "near")
    made = _runtime.table(sketches(docs), f"{run}/sketches")
    rows = _runtime.table(made.where("batch is null").select("doc_id", "n_shingles", "node"), f"{run}/rows")
    lists = _runtime.table(_lists(made.where("batch is not null"), percent), f"{run}/work/lists")
    _runtime.drop(f"{run}/sketches")
    _runtime.tidy(docs.sparkSession)
    groups = _runtime.table(links(lists, docs, percent, f"{run}/work"), f"{run}/groups")
    _runtime.drop(f"{run}/work")
    _runtime.tidy(docs.sparkSession)
    return rows, groups, run


def classes(docs: DataFrame, percent: int = 85) -> DataFrame:
    """One row a document: doc_id, n_shingles, component_id (least doc_id of its group)."""
    return _labelled(*grouped(docs, percent)[:2])


def links(lists: DataFrame, docs: DataFrame, percent: int, run: str) -> DataFrame:
    """node, comp of all nodes with a link. lists: v, node, n, pop."""
    best = F.max(F.struct("pop", F.col("node").alias("b"), F.col("n").alias("m")))
    shared = lists.groupBy("v").agg(F.min("node").alias("_lo"), F.max("node").alias("_hi"), F.count("*").alias("c"), best.alias("p")).where("_lo <> _hi")
    members = lists.join(shared.select("v", "c", "p"), "v")
    members = _runtime.table(members.select("v", "node", "n", "pop", "c", F.col("p.b").alias("b"), F.col("p.m").alias("m")), f"{run}/members")
    pool = _runtime.table(_pool(docs, members.select("node")), f"{run}/pool")
    star = members.where((F.col("node") != F.col("b")) & _near(F.col("n"), F.col("m"), percent)).select("node", "b")
    small = members.where(F.col("c").between(3, SMALL)).select("v", "node", "n")
    other = small.select("v", F.col("node").alias("b"), F.col("n").alias("m"))
    every = small.join(other, "v").where((F.col("node") > F.col("b")) & _near(F.col("n"), F.col("m"), percent)).select("node", "b")
    pairs = _runtime.table(star.unionByName(every).select(F.greatest("node", "b").alias("a"), F.least("node", "b").alias("b")).distinct(), f"{run}/pairs-0")
    found = _verified(pairs, pool, percent, f"{run}/r0")
    groups = _runtime.table(components(found, f"{run}/c0"), f"{run}/groups-0")
    more = _runtime.table(_in_blocks(members, groups, pool, percent), f"{run}/blocks")
    if not more.head(1):
        return groups
    return _runtime.table(components(found.unionByName(more), f"{run}/c1"), f"{run}/groups-1")


def _in_blocks(members: DataFrame, groups: DataFrame, pool: DataFrame, percent: int) -> DataFrame:
    """Links a, b among the members of one pivot's lists, where those are in several groups still.

    Members are dealt into blocks of about BLOCK by hash, and each two blocks meet
    in one task, which compares all their sets and returns at most one link a
    member: so many rows a member as its pivot has blocks, and no pairs.
    """
    members = members.where(F.col("c") > SMALL)  # of shorter lists all pairs have met
    own = members.select("node", "b").unionByName(members.select(F.col("b").alias("node"), "b")).distinct()
    now = own.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    mixed = now.groupBy("b").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.count("*").alias("c")).where("lo <> hi AND c > 2")
    blocks = F.ceil(F.col("c") / BLOCK).cast("int")
    open_ = now.join(mixed.select("b", blocks.alias("k")), "b").join(pool.select("node", "whole"), "node")
    at = F.pmod(F.xxhash64("node"), F.col("k")).cast("int")
    dealt = open_.withColumn("at", at).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("k") - 1)))
    dealt = dealt.select("b", F.least("at", "other").alias("i"), F.greatest("at", "other").alias("j"), "node", "comp", "whole")
    n = _runtime.partitions(members)
    schema = _runtime.schema("a binary, b binary")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, nodes, comps, sets, out = None, [], [], [], []
        for x in batches:
            for k, node, comp, whole in zip(zip(*(x.column(c).to_pylist() for c in "bij")), *(x.column(c).to_pylist() for c in ("node", "comp", "whole"))):
                if k != key:
                    out += _compared(nodes, comps, sets, percent)
                    key, nodes, comps, sets = k, [], [], []
                nodes.append(node)
                comps.append(comp)
                sets.append(np.frombuffer(whole, np.uint64))
        out += _compared(nodes, comps, sets, percent)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], pa.binary()) for i in range(2)], schema.names)

    return dealt.repartition(n, "b", "i", "j").sortWithinPartitions("b", "i", "j").transform(_runtime.mapped, run, schema)


def _compared(nodes: list[bytes], comps: list[bytes], sets: list[np.ndarray], percent: int) -> list[tuple[bytes, bytes]]:
    """Links that join groups among some sets, as a forest, from the sizes of all intersections."""
    m = len(nodes)
    if len(set(comps)) < 2:
        return []
    size = np.array([len(s) for s in sets])
    values, own = np.unique(np.concatenate(sets), return_inverse=True)
    often = np.bincount(own) > 1
    name = np.cumsum(often) - 1
    keep = often[own]
    row, column = np.repeat(np.arange(m), size)[keep], name[own[keep]]
    both = np.zeros((m, m), np.float32)
    for a in range(0, int(often.sum()), 4096):
        some = (column >= a) & (column < a + 4096)
        x = np.zeros((m, 4096), np.float32)
        x[row[some], column[some] - a] = 1
        both += x @ x.T
    first: dict[bytes, int] = {}
    top = [first.setdefault(c, i) for i, c in enumerate(comps)]

    def find(i: int) -> int:
        while top[i] != i:
            top[i] = top[top[i]]
            i = top[i]
        return i

    out = []
    for i, j in zip(*np.nonzero(np.triu(100 * both >= percent * (size[:, None] + size - both), 1))):
        p, q = find(int(i)), find(int(j))
        if p != q:
            top[max(p, q)] = min(p, q)
            out.append((nodes[i], nodes[j]))
    return out


def _labelled(rows: DataFrame, groups: DataFrame) -> DataFrame:
    """Each document with the least doc_id of its group."""
    ids = rows.where("node is not null").groupBy("node").agg(F.min("doc_id").alias("least")).join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    tops = ids.groupBy("comp").agg(F.min("least").alias("component_id"))
    labels = ids.join(tops, "comp").select("node", "component_id")
    out = rows.select("doc_id", "n_shingles", "node").join(labels, "node", "left")
    return out.select("doc_id", "n_shingles", F.coalesce("component_id", "doc_id").alias("component_id"))


def noded(docs: DataFrame) -> DataFrame:
    """docs with `_node`, the node of each text (null without words)."""
    _runtime.tune(docs.sparkSession)
    kept = [f for f in docs.schema.fields if f.name != "_node"]
    schema = T.StructType([*kept, T.StructField("_node", T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            _, counts, nodes = _sets(x.column("text"))
            made = pa.array([k.tobytes() if c else None for k, c in zip(nodes, counts.tolist())], pa.binary())
            yield pa.RecordBatch.from_arrays([*[x.column(f.name) for f in kept], made], schema.names)

    return docs.transform(_runtime.mapped, run, schema)


def deduped(docs: DataFrame, percent: int = 85) -> DataFrame:
    """docs without those that have a linked document of a lesser doc_id; texts without words stay.

    Of repeated rows one stays: documents of one group and one id with the least
    node, and of equal rows the first.
    """
    rows, groups, run = grouped(docs, percent)
    own = rows.where("node is not null").groupBy("node").agg(F.min(F.struct(F.col("doc_id").isNull().alias("x"), "doc_id")).alias("first"), F.count("*").alias("c"))
    own = own.join(groups, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    stay = own.groupBy("comp").agg(F.min(F.struct("first", "node")).alias("s")).select(F.col("s.node").alias("_n"), F.col("s.first.doc_id").alias("_d"))
    stay = _runtime.table(stay, f"{run}/stay")
    named = noded(docs)
    left = named.join(stay, (F.col("_node") == F.col("_n")) & F.col("doc_id").cast("long").eqNullSafe(F.col("_d")), "left_semi")
    twice = rows.join(stay, (F.col("node") == F.col("_n")) & F.col("doc_id").eqNullSafe(F.col("_d")), "left_semi").groupBy("node", "doc_id").count().where("count > 1")
    if twice.head(1):
        left = left.dropDuplicates(["_node"])
    return left.unionByName(named.where("_node is null")).drop("_node")
