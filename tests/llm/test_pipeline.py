import random

from brute import groups, words
from tokenizers import Tokenizer

import corpus_pipeline as pipeline
from tidemark.llm import near_dedup

SF = "/root/testdata/sf0.001"


def test_stages_do_what_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == columns, name
        rows = out.collect()
        docs = spark.createDataFrame(rows, out.schema).repartition(3)
        kept.append({r["doc_id"]: r for r in rows})
        if name != "mix":
            assert len(rows) == len(kept[-1])
        last = rows
    quality, near, cut, _ = kept
    start = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    labels = {r["doc_id"]: r for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    clean = [d for d, r in labels.items() if r["quality"] == 1 and r["toxic"] == 0 and d in start]
    assert len([d for d in clean if d in quality]) >= 0.97 * len(clean)
    junk = [d for d, r in labels.items() if r["quality"] == 0 and d in start]
    assert len([d for d in junk if d in quality]) <= 0.5 * len(junk)  # few documents teach little
    assert all(r == start[d] for d, r in quality.items())
    component, _ = groups({d: r["text"] for d, r in quality.items()}, percent=80)  # the similarity of the stage
    assert set(near) == set(component.values())
    first = {}
    for d in sorted(cut):
        w = words(cut[d]["text"])
        for i in range(len(w) - 49):
            assert first.setdefault(tuple(w[i : i + 50]), d) == d
    assert set(cut) <= set(near)
    assert all(cut[d]["text"] == near[d]["text"] or len(words(cut[d]["text"])) < len(words(near[d]["text"])) for d in cut)
    total = sum(len(words(r["text"])) for r in cut.values())
    assert abs(sum(len(words(r["text"])) for r in last) - total) < 0.1 * total + 500
    encoded = pipeline.STAGES[-1][1](spark, docs, SF).collect()
    library, text = Tokenizer.from_file(pipeline.TOKENIZER), {r["doc_id"]: r["text"] for r in last}
    assert len(encoded) == len(last)
    for r in encoded[:60]:
        assert r["ids"] == library.encode(text[r["doc_id"]] or "", add_special_tokens=False).ids and r["n_tokens"] == len(r["ids"])


def test_run_writes_all_stages(spark):
    assert pipeline.run(spark, SF).columns == ["doc_id", "source", "lang", "n_tokens", "ids"]


def test_near_stage_links_at_80_percent(spark):
    r = random.Random(12)
    word = lambda: "w%d" % r.randrange(50000)
    texts = {}
    for i, n in enumerate([120, 200, 200, 400, 900, 2000]):
        body = [word() for _ in range(n)]
        copy = list(body)
        for at in range(12, n - 8, 50):
            copy[at] = "changed%d" % at
        texts[2 * i], texts[2 * i + 1] = " ".join(body), " ".join(copy)
    texts |= {100 + i: " ".join(word() for _ in range(150)) for i in range(20)}
    want, _ = groups(texts, percent=80)
    assert len(set(want.values())) < len(set(groups(texts)[0].values()))
    stage = dict(pipeline.STAGES)["near_dedup"]
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert {x["doc_id"] for x in stage(spark, df, SF).collect()} == set(want.values())
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want, _ = groups({x["doc_id"]: x["text"] for x in docs.collect()}, percent=80)
    assert {x["doc_id"] for x in stage(spark, docs, SF).collect()} == set(want.values())


def test_sketch_bound_follows_the_threshold():
    assert [near_dedup._shared(p) for p in (80, 85)] == [160, 176]
    assert near_dedup._needed(2000, 80) == 160 and near_dedup._needed(100, 80) == 80
