"""What every operator and stage gives for nulls, empty and repeated rows, empty tables and columns with clashing names."""

import hashlib

import pytest
from brute import groups, words
from pyspark.sql import functions as F

import corpus_pipeline as pipeline
from tidemark.llm import audio, bpe, fingerprints, lang_id, lm_trie, near_dedup, pareto_mix, passages, quality, url_filters

SF = "/root/testdata/sf0.001"
LONG = " ".join(f"w{i}" for i in range(120))
ROWS = [
    (1, "a", "en", LONG),
    (1, "a", "en", LONG),  # a repeated row
    (2, "a", "en", LONG),  # a copy
    (2, None, None, "another text with the id of a copy"),
    (3, "b", "de", None),
    (4, "b", None, ""),
    (5, None, "xx", " \t\n"),
    (None, "c", "en", LONG),
    (None, None, None, None),
    (6, "c", "fr", "one two"),
]
CLASH = ("size", "taken", "target", "copies", "score", "keep", "perplexity", "media", "chunks", "n_tokens", "ids", "lang_pred", "fingerprint", "host", "path", "rule", "verdict", "component_id", "n_shingles", "node", "v", "a", "b", "c", "batch")


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, source string, lang string, text string")
    return df.withColumns({c: F.lit("clash") for c in CLASH}).repartition(4).cache()


def by(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=str)


def test_near_dedup(spark, docs):
    got = near_dedup.classes(docs)
    want, n = groups({i: r[3] for i, r in enumerate(ROWS)})
    assert got.count() == len(ROWS) and sorted(r["n_shingles"] for r in got.collect()) == sorted(n.values())
    assert {r["component_id"] for r in got.where("n_shingles = 116").collect()} == {1}
    left = near_dedup.deduped(docs, 80)
    assert left.columns == docs.columns
    assert by(left, "doc_id", "text") == sorted([(1, LONG), (2, ROWS[3][3]), (3, None), (4, ""), (5, " \t\n"), (None, None), (6, "one two")], key=str)


def test_passages(spark, docs):
    left = passages.deduped(docs)
    assert left.columns == docs.columns
    assert {r["c"] for r in left.collect()} == {"clash"} and [r["doc_id"] for r in left.where(F.col("text") == LONG).collect()].count(1) >= 1
    texts = {r["doc_id"]: r["text"] for r in left.collect() if r["text"] and words(r["text"])}
    assert texts[6] == "one two" and passages.deduped(docs.limit(0)).count() == 0
    assert {r["doc_id"] for r in passages.repeated(docs).collect()} >= {2}


def test_mix(spark, docs):
    out = pareto_mix.copies(docs, pareto_mix.plan(docs))
    assert out.count() == len(ROWS) and {r["size"] for r in out.collect()} == {len(words(r[3])) for r in ROWS}
    empty = docs.limit(0)
    assert pareto_mix.copies(empty, pareto_mix.plan(empty)).count() == 0


def test_quality(spark, docs):
    labels = spark.createDataFrame([(1, 1, 0), (2, 1, 0), (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    out = quality.score(docs, quality.fit(docs, labels))
    assert out.count() == len(ROWS)
    assert all(r["keep"] for r in out.where("text IS NULL OR text = ''").collect())
    none = quality.score(docs, quality.fit(docs, labels.limit(0)))
    assert none.where("keep").count() == len(ROWS) and quality.score(docs.limit(0), quality.fit(docs, labels)).count() == 0


def test_language_model(spark, docs):
    df = docs.withColumn("held_out", lm_trie.held_out(F.col("doc_id")))
    out = lm_trie.score(df, lm_trie.train(df.where(~F.col("held_out"))))
    assert sorted(r["n_tokens"] for r in out.collect()) == sorted(len(words(r[3])) + 1 for r in ROWS)
    same = {(r["n_known"], r["base_score"], r["score"]) for r in out.where("n_tokens = 121").collect()}
    assert len(same) == 1  # equal texts, equal scores


def test_languages(spark, docs):
    out = lang_id.predict(docs, lang_id.fit(docs, F.lit(True)))
    assert out.count() == len(ROWS)
    assert {r["lang_pred"] for r in out.where("text IS NULL OR trim(text) = ''").collect()} == {"und"}
    blank = docs.where("text IS NOT NULL AND trim(text) = ''").withColumn("lang", F.lit("en"))  # a language without a letter
    assert {r["lang_pred"] for r in lang_id.predict(docs, lang_id.fit(blank, F.lit(True))).collect()} == {"und"}
    assert lang_id.predict(docs.limit(0), lang_id.fit(docs, F.lit(True))).count() == 0


def test_fingerprints(spark, docs):
    out = fingerprints.with_edits(docs)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert out.count() == len(ROWS) and sorted(r["n_chars"] for r in out.collect()) == sorted(len(r[3] or "") for r in ROWS)
    assert len({r["fingerprint"] for r in out.where(F.col("n_chars") == len(LONG)).collect()}) == 1
    assert sha("") in {r["edited_sha256"] for r in out.where("n_chars = 0").collect()}
    assert fingerprints.with_edits(docs.limit(0)).count() == 0


def test_media(spark, docs):
    out = audio.digests(docs)
    assert out.count() == len(ROWS) and len({r["feature"] for r in out.where("n_bytes = 0").collect()}) == 1
    full = audio.features(audio.with_media(docs))
    assert full.count() == len(ROWS) and set(docs.columns) <= set(full.columns)


def test_encoding(spark, docs):
    out = bpe.digests(docs, pipeline.TOKENIZER)
    assert out.count() == len(ROWS) and by(out.where("n_tokens = 0"), "doc_id") == [(3,), (4,), (None,)]
    assert {r["decoded_sha256"] for r in out.where("doc_id = 1").collect()} == {hashlib.sha256(LONG.encode()).hexdigest()}
    assert bpe.digests(docs.limit(0), pipeline.TOKENIZER).count() == 0


def test_urls(spark):
    rules = [url_filters.host_rule("block", "com"), url_filters.word_rule("block", "ads", "track")]
    rows = [(1, "http://A.com/x?y"), (1, "http://A.com/x?y"), (2, None), (3, ""), (4, "com"), (5, "x://ads-track.org"), (6, "http://" + "a" * 100_000 + ".com/")]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumns({c: F.lit("clash") for c in CLASH if c != "score"})
    out = url_filters.judge(df, "url", rules)
    assert [r["verdict"] for r in sorted(out.collect(), key=lambda r: r["page_id"])] == ["block", "block", "allow", "allow", "allow", "block", "block"]
    assert url_filters.judge(df.limit(0), "url", rules).count() == 0


@pytest.mark.parametrize("name", [n for n, _ in pipeline.STAGES])
def test_stages(spark, docs, tmp_path, name):
    spark.createDataFrame([(1, 1, 0), (2, 1, 0)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    stage = dict(pipeline.STAGES)[name]
    for df in (docs, docs.limit(0)):
        out = stage(spark, df, str(tmp_path))
        assert name == "bpe" or out.columns == docs.columns
        assert (out.count() > 0) == (df is docs)
