import math
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from brute import words
from pyspark.sql import functions as F

from tidemark.llm import elias_fano as ef, lm_trie


@pytest.mark.parametrize("n,top", [(0, 10), (1, 5), (1000, 1 << 20), (5000, (1 << 64) - 1), (3000, 3000), (100, 5_000_000)])
def test_elias_fano(n, top):
    r = np.random.default_rng(n)
    v = np.unique(r.integers(0, top, n, dtype=np.uint64, endpoint=True))
    s = ef.Sequence(*ef.load(np.frombuffer(ef.save(ef.build(v, top)), np.uint8)))
    assert (s.get(np.arange(len(v))) == v).all()
    q = np.concatenate([v, r.integers(0, top, 300, dtype=np.uint64, endpoint=True)])
    place = dict(zip(v.tolist(), range(len(v))))
    assert s.find(q).tolist() == [place.get(x, -1) for x in q.tolist()]


def test_repeated_values():
    v = np.array([0, 0, 3, 3, 7])
    assert ef.Sequence(*ef.build(v, 7)).get(np.arange(5)).tolist() == v.tolist()


def model(texts, train):
    tok = {d: [*words(t), None] for d, t in texts.items()}
    c = [Counter(tuple(tok[d][i : i + n]) for d in train for i in range(len(tok[d]) - n + 1)) for n in (1, 2, 3)]
    total, kinds, cut = sum(c[0].values()), len(c[0]), lm_trie.DISCOUNT
    kept = [c[0], *[{g: n for g, n in x.items() if n >= lm_trie.LEAST} for x in c[1:]]]
    given = defaultdict(float)
    for n in (1, 2):
        for g, k in kept[n].items():
            given[g[:-1]] += (k - cut) / c[n - 1][g[:-1]]
    out = {}
    for d, w in tok.items():
        base = score = 0.0
        for i in range(len(w)):
            p = (c[0][tuple(w[i : i + 1])] + 0.5) / (total + 0.5 * (kinds + 1))
            base += math.log10(p)
            for n in (1, 2):
                context = tuple(w[max(0, i - n) : i])
                if len(context) == n and context in kept[n - 1]:
                    k = kept[n].get((*context, w[i]))
                    p = (1 - given[context]) * p + ((k - cut) / c[n - 1][context] if k else 0)
            score += math.log10(p)
        out[d] = (len(w), sum(c[0][(x,)] > 0 for x in w), base, score)
    return total, out


def run(spark, texts):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    df = df.withColumn("held_out", lm_trie.held_out(F.col("doc_id")))
    m = lm_trie.train(df.where(~F.col("held_out")))
    return m, {r["doc_id"]: r for r in lm_trie.score(df, m).collect()}


def test_scores_match_plain_counts(spark):
    r = random.Random(1)
    texts = {i: " ".join(r.choice("The cat a Dog sat on mat ran of X".split()) for _ in range(r.randrange(0, 60))) for i in range(80)}
    texts |= {100: None, 101: "", 102: " \n", 103: "unseen words here", 104: "cat " * 3000}
    train = [d for d in texts if zlib.crc32(str(d).encode()) % 5 != 1]
    total, want = model(texts, train)
    m, got = run(spark, texts)
    assert m.tokens == total and len(got) == len(texts)
    for d, (n, known, base, score) in want.items():
        assert (got[d]["n_tokens"], got[d]["n_known"]) == (n, known)
        assert got[d]["base_score"] == pytest.approx(base, abs=1e-6 * n + 1e-9)
        assert abs(got[d]["score"] - score) <= 0.04 * n  # one byte a probability
        assert got[d]["held_out"] == (d not in train)


def test_nothing_to_learn_from(spark):
    held = [i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1][:2]
    m, got = run(spark, {i: "a b" for i in held})
    assert m.tokens == 0 and all(x["n_known"] == 0 for x in got.values())
    m, got = run(spark, {})
    assert got == {}


def test_what_occurs_once_is_kept(spark):
    held = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 5 == 1)
    trained = next(i for i in range(40) if zlib.crc32(str(i).encode()) % 5 != 1)
    _, got = run(spark, {trained: "alpha beta gamma delta", held: "alpha beta gamma"})
    # 5 tokens of 5 kinds: a bigram seen once has (1 - DISCOUNT) / 1 and DISCOUNT of the word's own, a trigram likewise
    p1 = 1.5 / 8
    p2 = 0.25 + 0.75 * p1
    p3 = 0.25 + 0.75 * p2
    end = 0.75 * 0.75 * p1
    assert got[held]["score"] == pytest.approx(math.log10(p1 * p2 * p3 * end), abs=0.06)
