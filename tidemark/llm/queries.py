"""The registered queries of this folder and, where SQL can express them, their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import audio, bpe, fingerprints, lang_id, lm_trie, near_dedup, pareto_mix, passages, quality, url_filters


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_pareto_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "source", "text")
    return pareto_mix.copies(docs, pareto_mix.plan(docs)).select("doc_id", "size", "source_size", "target", "taken", "copies")


def op2_compact_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.repeated(_documents(spark, sf_dir))


def op3_kneser_ney(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return quality.score(docs.select("doc_id", "lang", "text"), model).drop("text").withColumnRenamed("keep", "kept")


def op4_ef_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", lm_trie.held_out(F.col("doc_id")).alias("held_out"), "text")
    model = lm_trie.train(docs.where(~F.col("held_out")))
    out = lm_trie.score(docs, model)
    return out.withColumn("train_tokens", F.lit(model.tokens).cast("long"))


def op5_bottom_k_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_dedup.classes(_documents(spark, sf_dir).select("doc_id", "text"))
    return out.withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True)))


def op6_audio_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audio.digests(_documents(spark, sf_dir))


def op7_bpe_transducer(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe.digests(_documents(spark, sf_dir), public_tokenizers.path("byte_bpe_50k.json"))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir)
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    model = lang_id.fit(docs.select("doc_id", "text", "lang"), fold != 1)
    out = lang_id.predict(docs.select("doc_id", "text"), model)
    return out.select("doc_id", F.coalesce(fold == 1, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.with_edits(_documents(spark, sf_dir))


URL_RULES = [
    url_filters.host_rule("allow", "org"),
    url_filters.host_rule("block", "example.org", "/es/"),
    url_filters.host_rule("block", "example.org", "/en/1"),
    url_filters.host_rule("allow", "com", "/fr/"),
    url_filters.host_rule("block", "com", "/de/"),
]
#: What the method judges beyond those rules: hosts that name unwanted trades.
URL_WORDS = [("ads", "track"), ("spam", "farm"), ("casino", "win"), ("adult", "x"), ("cheap", "pills"), ("free", "bets")]


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url")
    rules = URL_RULES + [url_filters.word_rule("block", *w) for w in URL_WORDS]
    out = url_filters.judge(pages, "url", rules)
    named = F.col("rule").isin([r.name for r in URL_RULES])
    return out.select("page_id", "host", "path", F.when(named, F.col("rule")).alias("rule"), "verdict", F.when(~named, F.col("rule")).alias("pattern"))


_WORDS_SQL = "\n".join(f"WHEN regexp_matches(host, '(^|[^a-z0-9]){'[-.]'.join(w)}([^a-z0-9]|$)') THEN '{'-'.join(w)}'" for w in sorted(URL_WORDS, key=lambda w: (-len("-".join(w)), "-".join(w))))
OP10_SQL = f"""
WITH u AS (SELECT page_id, url, strpos(url, '://') AS p FROM pages),
h AS (SELECT page_id,
  CASE WHEN p > 0 THEN translate(regexp_extract(substr(url, p + 3), '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') ELSE '' END AS host,
  CASE WHEN p > 0 THEN regexp_extract(substr(url, p + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END AS path FROM u),
r AS (SELECT *, CASE
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
  WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
  WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
  WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule FROM h),
m AS (SELECT *, CASE WHEN rule IS NULL THEN CASE {_WORDS_SQL} END END AS pattern FROM r)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow' WHEN rule IS NOT NULL OR pattern IS NOT NULL THEN 'block' ELSE 'allow' END AS verdict, pattern FROM m
"""

#: All shingles, all pairs that share one, and what can be reached over links.
OP5_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
l AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
k AS (SELECT a, b FROM l JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
r(a, b) AS (SELECT doc_id, doc_id FROM documents UNION SELECT r.a, k.b FROM r JOIN k ON r.b = k.a),
m AS (SELECT a, min(b) AS component_id FROM r GROUP BY 1)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.component_id, d.doc_id = m.component_id AS kept
FROM documents d JOIN m ON m.a = d.doc_id LEFT JOIN n ON n.doc_id = d.doc_id
"""

QUERIES = {f.__name__: f for f in (op1_pareto_mix, op2_compact_windows, op3_kneser_ney, op4_ef_trie, op5_bottom_k_dedup, op6_audio_features, op7_bpe_transducer, op8_language_id, op9_fingerprints, op10_url_filters)}
ORACLE_SQL = {"op5_bottom_k_dedup": OP5_SQL, "op10_url_filters": OP10_SQL}
