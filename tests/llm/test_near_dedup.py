import random

import pytest
from brute import groups

from tidemark.llm import near_dedup


def run(spark, texts, percent=85):
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    rows = near_dedup.classes(df, percent).collect()
    assert len(rows) == len(texts)
    return {r["doc_id"]: r["component_id"] for r in rows}, {r["doc_id"]: r["n_shingles"] for r in rows}


@pytest.mark.parametrize("percent", [50, 70, 85])
def test_groups_match_all_pairs(spark, percent):
    r = random.Random(5)
    word = lambda: "w%d" % r.randrange(4000)
    texts, line = {}, " ".join(word() for _ in range(40))
    for base in range(12):
        body = [word() for _ in range(r.choice([6, 30, 90, 130, 400]))]
        for _ in range(r.choice([1, 2, 12])):
            copy = list(body)
            for _ in range(r.randrange(0, 1 + len(copy) * (100 - percent) // 900)):
                copy[r.randrange(len(copy))] = word()
            texts[len(texts) * 3 + 1] = " ".join(copy)
    for _ in range(25):  # one line in many different texts
        texts[len(texts) * 3 + 1] = line + " " + " ".join(word() for _ in range(r.choice([3, 8, 40])))
    texts |= {1000: None, 1001: "", 1002: " \n ", 1003: "one two", 1004: "One  TWO", 1005: "Two one", 1006: "y" * 5000}
    want, n = groups(texts, percent)
    got, sizes = run(spark, texts, percent)
    assert sizes == n and got == want


def test_empty_table_and_null_ids(spark):
    assert near_dedup.classes(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    df = spark.createDataFrame([(None, "a b c d e f"), (7, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted(((r["doc_id"], r["component_id"]) for r in near_dedup.classes(df).collect()), key=str) == [(7, 7), (None, 7), (None, None)]
