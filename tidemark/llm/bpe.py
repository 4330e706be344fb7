"""BPE encoding and decoding with a minimal acyclic transducer as its lexicon.

The corpus' most frequent pretokens and their ids are compiled into the minimal
acyclic automaton of those words.  Its arcs carry how many words come before
them, so the sum along a path is a word's index into the id outputs.  The file
is written once to the shared folder and memory-mapped by every task.  A batch
is cut into pretokens, each distinct one walks the automaton (all in lock step),
and those it does not hold are merged exactly by rank.  The lexicon saves work;
the ids are those of the merges whatever it holds.

Cases: a null text is an empty one, which has no ids; the strings of added
tokens in a text become those tokens; texts and pretokens may have any length;
repeated rows are encoded alike; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from . import _runtime, _text

#: Words in the lexicon, and the longest of them in bytes.
LEXICON, LONGEST = 1 << 16, 48
#: Bytes of words and counts that a task holds before it sends them on.
PENDING = 16 << 20
_NONE = np.int64(1) << 40


def _byte_symbols() -> list[str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable
    Latin-1 stands for itself, the others follow from U+0100."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = {b: chr(256 + i) for i, b in enumerate(b for b in range(256) if b not in own)}
    return [rest.get(b, chr(b)) for b in range(256)]


class Merges:
    """The rules of a byte-level BPE file: merge ranks, token bytes, added tokens."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab = spec["model"]["vocab"]
        self.added = {x["content"].encode(): x["id"] for x in spec["added_tokens"]}
        byte_of = {c: b for b, c in enumerate(_byte_symbols())}
        self.token_bytes: list[bytes] = [b""] * (1 + max([*vocab.values(), *self.added.values()]))
        for t, i in vocab.items():
            self.token_bytes[i] = bytes(byte_of[c] for c in t)
        for t, i in self.added.items():
            self.token_bytes[i] = t
        self.byte_ids = np.array([vocab[c] for c in _byte_symbols()], np.int64)
        rules = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in spec["model"]["merges"]]
        keys = np.array([vocab[a] << 32 | vocab[b] for a, b in rules], np.int64)
        order = np.argsort(keys)
        self.keys, self.ranks = keys[order], np.arange(len(keys), dtype=np.int64)[order]
        self.made = np.array([vocab[a + b] for a, b in rules], np.int64)[order]
        self._rules: dict = {}

    def look_up(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Index of the rule for each pair, or -1."""
        key = left << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where((self.keys[at] == key) & (right >= 0) & (left >= 0), at, -1)

    def encode_words(self, words: Sequence[bytes]) -> list[np.ndarray]:
        """Ids of each pretoken, by exact merges."""
        out: list = [None] * len(words)
        size = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(size, kind="stable")
        a = 0
        while a < len(order):
            n = int(size[order[a]])
            if n > 64:
                for i in order[a:].tolist():
                    out[i] = self._by_heap(words[i])
                break
            b = a + int(np.searchsorted(size[order[a:]], max(n, min(64, n + 2)), "right"))
            b = min(b, a + 200_000 // max(1, n))
            self._together(words, order[a:b], int(size[order[b - 1]]), out)
            a = b
        return out

    def _together(self, words, rows: np.ndarray, width: int, out: list) -> None:
        """Merge many words of similar length at once: in each turn, every word's leftmost best pair."""
        if not width:
            for i in rows.tolist():
                out[i] = np.zeros(0, np.int64)
            return
        raw = np.frombuffer(b"".join(words[i].ljust(width, b"\0") for i in rows.tolist()), np.uint8).reshape(len(rows), width)
        size = np.array([len(words[i]) for i in rows.tolist()])
        ids = np.full((len(rows), width + 1), -1, np.int64)
        ids[:, :width] = np.where(np.arange(width) < size[:, None], self.byte_ids[raw], -1)
        rank = np.full((len(rows), width), _NONE)
        rule = self.look_up(ids[:, :-1], ids[:, 1:])
        rank[rule >= 0] = self.ranks[rule[rule >= 0]]
        live = np.arange(len(rows))
        cols = np.arange(width + 1)
        while len(live):
            at = rank.argmin(1)
            best = rank[np.arange(len(live)), at]
            go = best < _NONE
            if not go.all():
                for j in np.flatnonzero(~go).tolist():
                    out[rows[live[j]]] = ids[j][ids[j] >= 0]
                ids, rank, live, at = ids[go], rank[go], live[go], at[go]
                if not len(live):
                    break
            r = np.arange(len(live))
            made = self.made[self.look_up(ids[r, at], ids[r, at + 1])]
            after = cols[None, :] > at[:, None]
            nxt = np.concatenate([ids[:, 1:], np.full((len(live), 1), -1)], 1)
            ids = np.where(after, nxt, ids)
            ids[r, at] = made
            shifted = np.concatenate([rank[:, 1:], np.full((len(live), 1), _NONE)], 1)
            rank = np.where(after[:, :-1], shifted, rank)
            for k, ok in ((at, np.ones(len(live), bool)), (at - 1, at > 0)):
                rr, kk = r[ok], k[ok]
                rule = self.look_up(ids[rr, kk], ids[rr, kk + 1])
                rank[rr, kk] = np.where(rule >= 0, self.ranks[rule], _NONE)

    def _by_heap(self, word: bytes) -> np.ndarray:
        """One long word: pairs in a heap by rank and place, neighbours in a list."""
        ids = self.byte_ids[np.frombuffer(word, np.uint8)].tolist()
        n = len(ids)
        left, right = list(range(-1, n - 1)), [*range(1, n), -1]
        if not self._rules:  # long words are rare: made when the first one comes
            self._rules.update(zip(self.keys.tolist(), zip(self.ranks.tolist(), self.made.tolist())))
        rules = self._rules
        heap = [(rules[k][0], i, k) for i in range(n - 1) if (k := ids[i] << 32 | ids[i + 1]) in rules]
        heapq.heapify(heap)
        while heap:
            _, i, k = heapq.heappop(heap)
            j = right[i]
            if ids[i] < 0 or j < 0 or ids[i] << 32 | ids[j] != k:
                continue
            ids[i], ids[j] = rules[k][1], -1
            right[i] = right[j]
            if right[j] >= 0:
                left[right[j]] = i
            for a, b in ((left[i], i), (i, right[i])):
                if a >= 0 and b >= 0 and (k := ids[a] << 32 | ids[b]) in rules:
                    heapq.heappush(heap, (rules[k][0], a, k))
        return np.array([x for x in ids if x >= 0], np.int64)


# --- pretokens -----------------------------------------------------------------

_OTHER, _LETTER, _NUMBER, _SPACE = range(4)
#: White space beyond ASCII, and what may follow an apostrophe as one pretoken.
SPACES = (0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000)
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")
_kinds: list[np.ndarray] = []


def _kind_table() -> np.ndarray:
    if not _kinds:
        table = np.zeros(0x110000, np.uint8)
        for c in range(0x110000):
            major = unicodedata.category(chr(c))[0]
            if major in "LN":
                table[c] = _LETTER if major == "L" else _NUMBER
        table[[*range(9, 14), 32, *SPACES]] = _SPACE
        _kinds.append(table)
    return _kinds[0]


def _code_points(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Start byte and value of each code point of valid UTF-8."""
    at = np.flatnonzero((buf & 0xC0) != 0x80)
    lead = buf[at].astype(np.int32)
    cp = lead.copy()
    for least, extra, mask in ((0xC0, 1, 31), (0xE0, 2, 15), (0xF0, 3, 7)):
        some = np.flatnonzero(lead >= least) if extra == 1 else np.flatnonzero((lead >= least))
        if len(some):
            v = lead[some] & mask
            for j in range(1, extra + 1):
                v = v << 6 | buf[np.minimum(at[some] + j, len(buf) - 1)] & 63
            cp[some] = v
    return at, cp


def pretokens(buf: np.ndarray, off: np.ndarray, added: Sequence[bytes] = ()) -> tuple[np.ndarray, np.ndarray]:
    """Start byte of each pretoken of the rows of buf, and pretokens per row.

    The rule, as one pattern: an apostrophe with one of ENDINGS; else a run of
    letters, of numbers or of other signs, each with one space before it if
    there is one; else white space, all but its last character if text follows.
    """
    if not len(buf):
        return np.zeros(0, np.int64), np.zeros(len(off) - 1, np.int64)
    at, cp = _code_points(buf)
    kind = _kind_table()[cp]
    bounds, inner = off[:-1][off[1:] > off[:-1]], []
    raw = buf.tobytes() if added else b""
    for t in added:
        p = raw.find(t)
        while p >= 0:
            row = int(np.searchsorted(off, p, "right")) - 1
            if p + len(t) <= off[row + 1]:
                inner.append((p, p + len(t)))
                p = raw.find(t, p + len(t))
            else:
                p = raw.find(t, p + 1)
    if inner:
        edges = np.array([x for s in inner for x in s], np.int64)
        bounds = np.unique(np.concatenate([bounds, edges[edges < len(buf)]]))
    n = len(at)
    first = np.zeros(n + 1, bool)
    first[np.searchsorted(at, bounds)] = True
    first[n] = True
    start = first.copy()
    start[1:n] |= kind[1:] != kind[:-1]
    # the last sign of white space before text stands alone, or joins the text if it is a space
    last = np.flatnonzero((kind == _SPACE) & start[1:] & ~first[1:])
    start[last] = True
    start[last[cp[last] == 32] + 1] = False
    quote = np.flatnonzero((cp == 39) & start[:n])
    quote = quote[(quote + 1 < n)]
    quote = quote[start[quote + 1] & ~first[quote + 1] & (kind[np.minimum(quote + 1, n - 1)] == _LETTER)]
    for q in quote.tolist():
        for e in ENDINGS:
            stop = q + 1 + len(e)
            if stop <= n and not first[q + 1 : stop].any() and "".join(map(chr, cp[q + 1 : stop])) == e:
                start[q + 1] = False
                start[stop] = True
                break
    for a, b in inner:
        a, b = np.searchsorted(at, (a, b))
        start[a + 1 : b] = False
    starts = at[np.flatnonzero(start[:n])]
    return starts, np.diff(np.searchsorted(starts, off))


def _hashes(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    ends = np.append(starts[1:], len(buf))
    out, a = np.empty(len(starts), np.uint64), 0
    while a < len(starts):
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + _text.BLOCK, "right")))
        out[a:b] = _text.span_hashes(buf, starts[a:b], ends[a:b])
        a = b
    return out


def _distinct(buf: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, list[bytes]]:
    """For each pretoken the number of its word, and the distinct words."""
    codes, found = pd.factorize(_hashes(buf, starts))
    where = np.empty(len(found), np.int64)
    where[codes[::-1]] = np.arange(len(codes))[::-1]
    ends = np.append(starts[1:], len(buf))
    raw = buf.tobytes()
    return codes, [raw[s:e] for s, e in zip(starts[where].tolist(), ends[where].tolist())]


# --- the lexicon ---------------------------------------------------------------


def compile_lexicon(words: Sequence[bytes], ids: Sequence[np.ndarray]) -> bytes:
    """The minimal acyclic automaton of words with their ids, as one file.

    Words are added in order; a state is frozen when no later word can change it,
    and equal frozen states (same finality and arcs) become one.
    """
    order = sorted(range(len(words)), key=words.__getitem__)
    finals, arcs, counts, known = [], [], [], {}

    def freeze(state) -> int:
        key = (state[0], tuple(state[1]))
        if (i := known.get(key)) is None:
            i = known[key] = len(finals)
            finals.append(state[0])
            arcs.append(key[1])
            counts.append(state[0] + sum(counts[t] for _, t in key[1]))
        return i

    path, previous = [[False, []]], b""
    for k in order:
        w = words[k]
        same = 0
        while same < min(len(w), len(previous)) and w[same] == previous[same]:
            same += 1
        for j in range(len(previous), same, -1):
            done = freeze(path.pop())
            path[-1][1].append((previous[j - 1], done))
        path += [[False, []] for _ in range(len(w) - same)]
        path[-1][0] = True
        previous = w
    for j in range(len(previous), 0, -1):
        done = freeze(path.pop())
        path[-1][1].append((previous[j - 1], done))
    root = freeze(path[0])
    rows = []
    for s, out in enumerate(arcs):
        before = int(finals[s])
        for byte, t in out:
            rows.append((s << 8 | byte, t, before))
            before += counts[t]
    rows.sort()
    table = np.array(rows or [(0, 0, 0)], np.int64)
    lengths = np.array([len(ids[k]) for k in order], np.int64)
    at = np.concatenate([[0], np.cumsum(lengths)])
    flat = np.concatenate([ids[k] for k in order] or [np.zeros(0, np.int64)])
    head = np.array([len(rows), len(finals), root, len(order), len(flat)], np.int64)
    return b"".join([head.tobytes(), table[: len(rows), 0].tobytes(), table[: len(rows), 1].astype(np.int32).tobytes(), table[: len(rows), 2].astype(np.int32).tobytes(), at.astype(np.int32).tobytes(), flat.astype(np.int32).tobytes(), np.array(finals, np.uint8).tobytes()])


class Lexicon:
    """A compiled lexicon over the bytes of its (memory-mapped) file."""

    def __init__(self, data: np.ndarray):
        arcs, states, self.root, words, ids = np.frombuffer(data[:40].tobytes(), np.int64).tolist()
        at = 40

        def take(n, kind):
            nonlocal at
            size = n * np.dtype(kind).itemsize
            at += size
            return data[at - size : at].view(kind)

        self.keys, self.to, self.before = take(arcs, np.int64), take(arcs, np.int32), take(arcs, np.int32)
        self.at, self.ids, self.final = take(words + 1, np.int32), take(ids, np.int32), take(states, np.uint8)

    def find(self, words: Sequence[bytes]) -> np.ndarray:
        """Index of each word, or -1: all words step through the automaton together."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        out = np.full(len(words), -1, np.int64)
        if not len(self.keys):
            return out
        rows = np.flatnonzero((size > 0) & (size <= LONGEST))
        raw = np.frombuffer(b"".join([words[i] for i in rows.tolist()]), np.uint8)
        size = size[rows]
        begin = np.concatenate([[0], np.cumsum(size)])[:-1] if len(rows) else size
        state, index, step = np.full(len(rows), self.root, np.int64), np.zeros(len(rows), np.int64), 0
        while len(rows):
            key = state << 8 | raw[begin + step]
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            ok = self.keys[at] == key
            rows, size, begin, at = rows[ok], size[ok], begin[ok], at[ok]
            state, index = self.to[at].astype(np.int64), index[ok] + self.before[at]
            step += 1
            end = size == step
            hit = end & (self.final[state] == 1)
            out[rows[hit]] = index[hit]
            rows, size, begin, state, index = (x[~end] for x in (rows, size, begin, state, index))
        return out


def word_counts(docs: DataFrame, added: Sequence[bytes]) -> DataFrame:
    """word (bytes), n: all pretokens of all texts with how often they occur."""
    _runtime.tune(docs.sparkSession)
    schema = _runtime.schema("word binary, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}

        size = 0

        def flush():
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.binary()), pa.array(list(seen.values()), pa.int64())], schema.names)
            seen.clear()
            return made

        for part in (p for x in batches for p in _text.row_blocks(x.column("text"))):
            buf, off = _text.utf8(part)
            starts, _ = pretokens(buf, off, added)
            if len(starts):
                codes, words = _distinct(buf, starts)
                for w, n in zip(words, np.bincount(codes).tolist()):
                    if w not in seen:
                        size += len(w) + 100
                    seen[w] = seen.get(w, 0) + n
            if size > PENDING:
                yield flush()
                size = 0
        yield flush()

    return docs.select("text").transform(_runtime.mapped, run, schema).groupBy("word").agg(F.sum("n").alias("n"))


def build_lexicon(docs: DataFrame, merges: Merges, size: int = LEXICON) -> str:
    """Compile at most `size` of the most frequent words of docs; returns the file's path in the shared folder.

    How many words have which frequency (in sixteenths of a power of two: some
    hundred numbers) tells from what frequency on all words fit, so nothing is sorted.
    """
    run = _runtime.run_dir(docs.sparkSession, "lexicon")
    counts = word_counts(docs, list(merges.added)).where(F.octet_length("word") <= LONGEST)
    counts = _runtime.table(counts.withColumn("level", F.floor(F.log2("n") * 16)), f"{run}/counts")
    least, total = None, 0
    for level, n in sorted(counts.groupBy("level").count().collect(), reverse=True):
        total += n
        if total > size:
            break
        least = level
    words = [bytes(r[0]) for r in counts.where(F.col("level") >= least).select("word").collect()] if least is not None else []
    words = [w for w in words if w not in merges.added]
    path = f"{run}/words.fst"
    _runtime.put_file(path, compile_lexicon(words, merges.encode_words(words)))
    _runtime.drop(f"{run}/counts")
    return path


class Encoder:
    """Encodes the rows of Arrow string columns."""

    def __init__(self, merges: Merges, lexicon: Lexicon):
        self.merges, self.lexicon = merges, lexicon

    def __call__(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and ids per row; worked out for about a megabyte of text at a time."""
        parts = [self._block(x) for x in _text.row_blocks(column)] or [(np.zeros(0, np.int32), np.zeros(0, np.int64))]
        return tuple(np.concatenate(p) for p in zip(*parts))

    def _block(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        buf, off = _text.utf8(column)
        starts, per_row = pretokens(buf, off, list(self.merges.added))
        if not len(starts):
            return np.zeros(0, np.int32), np.zeros(len(per_row), np.int64)
        codes, words = _distinct(buf, starts)
        index = self.lexicon.find(words)
        miss = np.flatnonzero(index < 0).tolist()
        added = self.merges.added
        new = self.merges.encode_words([words[i] for i in miss])
        for j, i in enumerate(miss):
            if words[i] in added:
                new[j] = np.array([added[words[i]]], np.int64)
        extra = np.fromiter(map(len, new), np.int64, len(new))
        ids = np.concatenate([np.asarray(self.lexicon.ids), *new]).astype(np.int32)
        base, length = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        known = index >= 0
        base[known] = self.lexicon.at[index[known]]
        length[known] = self.lexicon.at[index[known] + 1] - base[known]
        base[miss] = len(self.lexicon.ids) + np.concatenate([[0], np.cumsum(extra)])[:-1]
        length[miss] = extra
        n = length[codes]
        ends = np.cumsum(n)
        flat = ids[np.repeat(base[codes] - (ends - n), n) + np.arange(int(ends[-1]))]
        at = np.concatenate([[0], np.cumsum(per_row)])
        upto = np.concatenate([[0], ends])
        return flat, upto[at[1:]] - upto[at[:-1]]


def _with_ids(docs: DataFrame, path: str, lexicon: str | None, schema, make) -> DataFrame:
    """Run make(batch, encoder, ids, ids per row) over docs; the rules are broadcast (a few MB, as the vocabulary is fixed)."""
    spark = docs.sparkSession
    _runtime.tune(spark)
    merges = Merges(path)
    lexicon = lexicon or build_lexicon(docs, merges)
    rules = spark.sparkContext.broadcast(merges)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(rules.value, Lexicon(_runtime.map_file(lexicon)))
        for x in batches:
            if x.num_rows:
                yield make(x, encoder, *encoder(x.column("text")))

    return docs.transform(_runtime.mapped, run, schema)


def encode(docs: DataFrame, path: str, lexicon: str | None = None) -> DataFrame:
    """docs with n_tokens and ids (array<int>); path: the tokenizer's file."""
    kept = [f for f in docs.schema.fields if f.name not in ("n_tokens", "ids")]
    schema = T.StructType([*kept, T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.ArrayType(T.IntegerType()))])

    def make(x, encoder, flat, per_row):
        at = pa.array(np.concatenate([[0], np.cumsum(per_row)]), pa.int32())
        return pa.RecordBatch.from_arrays([*[x.column(f.name) for f in kept], pa.array(per_row), pa.ListArray.from_arrays(at, pa.array(flat))], schema.names)

    return _with_ids(docs, path, lexicon, schema, make)


def decode(ids: Sequence[int], token_bytes: Sequence[bytes]) -> str:
    """The text of ids, added tokens included."""
    return b"".join(map(token_bytes.__getitem__, ids)).decode("utf-8", "replace")


def digests(docs: DataFrame, path: str, lexicon: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every text: what an encoding and its decoding give."""
    schema = _runtime.schema("doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")

    def make(x, encoder, flat, per_row):
        names = [str(i) for i in range(len(encoder.merges.token_bytes))]
        at = np.concatenate([[0], np.cumsum(per_row)]).tolist()
        coded, decoded = [], []
        for a, b in zip(at[:-1], at[1:]):
            ids = flat[a:b].tolist()
            coded.append(hashlib.sha256(",".join(map(names.__getitem__, ids)).encode()).hexdigest())
            decoded.append(hashlib.sha256(decode(ids, encoder.merges.token_bytes).encode()).hexdigest())
        return pa.RecordBatch.from_arrays([x.column("doc_id"), pa.array(per_row), pa.array(coded), pa.array(decoded)], schema.names)

    return _with_ids(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), path, lexicon, schema, make)
