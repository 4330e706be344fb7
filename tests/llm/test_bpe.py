import random

import numpy as np
import public_tokenizers as P
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from tidemark.llm import _text, bpe

PATH = P.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def merges():
    return bpe.Merges(PATH)


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def texts():
    r = random.Random(3)
    signs = ["a", "B", "the", " ", "  ", "\n", "\t", "'", "'s", "'ll", "'re", "''", "7", "42", "½", "é", "ñandú", "字", "🙂", " ", "　", "́", "!!", "$", "-", "<|endoftext|>", "<|endof", "\r\n", "ǅ", "Ⅷ"]
    out = [None, "", " ", "\n\n", "a  ", "  a", "x'sable 'tis 're'd", "'", "'s", " 's", "<|endoftext|>", "a <|endoftext|> b", " <|endoftext|>", "y" * 3000, "ab" * 100]
    return out + ["".join(r.choice(signs) for _ in range(r.randrange(1, 40))) for _ in range(3000)]


def test_equals_library(merges, library):
    some = sorted({w for t in texts() if t for w in t.encode().split(b" ")})[::3]
    words = [w for w in some if w and w not in merges.added]
    lexicon = bpe.Lexicon(np.frombuffer(bpe.compile_lexicon(words, merges.encode_words(words)), np.uint8))
    assert (lexicon.find(words) >= 0).tolist() == [len(w) <= bpe.LONGEST for w in words]
    flat, n = bpe.Encoder(merges, lexicon)(pa.array(texts()))
    at = np.concatenate([[0], np.cumsum(n)]).tolist()
    want = library.encode_batch([t or "" for t in texts()], add_special_tokens=False)
    for t, a, b, w in zip(texts(), at[:-1], at[1:], want):
        ids = flat[a:b].tolist()
        assert ids == w.ids, repr(t)
        assert bpe.decode(ids, merges.token_bytes) == library.decode(ids, skip_special_tokens=False) == (t or "")


def test_every_code_point(merges, library):
    for a in range(0, 0x110000, 0x1000):
        t = [f"a{chr(c)}{chr(c)} 1{chr(c)} ." for c in range(a, a + 0x1000) if not 0xD800 <= c < 0xE000]
        flat, n = bpe.Encoder(merges, bpe.Lexicon(np.frombuffer(bpe.compile_lexicon([], []), np.uint8)))(pa.array(t)) if t else ([], [])
        want = library.encode_batch(t, add_special_tokens=False) if t else []
        assert list(n) == [len(w.ids) for w in want], hex(a)


def test_automaton_is_minimal_and_exact(merges):
    words = [w.encode() for w in ("tap", "taps", "top", "tops", "stop", "stops")]
    data = np.frombuffer(bpe.compile_lexicon(words, [np.array([i]) for i in range(len(words))]), np.uint8)
    lex = bpe.Lexicon(data)
    assert [int(lex.ids[lex.at[i]]) for i in lex.find(words)] == list(range(len(words)))
    assert lex.find([b"ta", b"tapsx", b"", b"stap"]).tolist() == [-1] * 4
    assert len(lex.final) == 7  # root, t, s, st, one for ta = to = sto, and two shared ends


def test_spark_round_trip(spark, library):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts()[:200])], "doc_id long, text string, n_tokens string").repartition(3)
    rows = bpe.encode(df, PATH).collect()
    assert {r["doc_id"]: r["ids"] for r in rows} == {i: library.encode(t or "", add_special_tokens=False).ids for i, t in enumerate(texts()[:200])}
    assert bpe.encode(df.limit(0), PATH).count() == 0
    assert bpe.digests(df, PATH).count() == 200
