import hashlib
import random
import zlib
from types import SimpleNamespace

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from brute import WORD, shingle_set
from pyspark.sql import functions as F

from tidemark.llm import _runtime, audio, components, fingerprints, lang_id, pareto_mix, queries, url_filters


# --- mixing ---------------------------------------------------------------------


def targets(sizes, weights=(5, 2, 1), most=3.0):
    """Water filling by its definition: share by weight, stop full sources, share the excess again."""
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    w = {s: weights[i % 3] for i, s in enumerate(names)}
    out, open_, left = dict.fromkeys(names, 0.0), set(names), float(sum(sizes.values()))
    while left > 1e-9 and open_:
        unit = left / sum(w[s] for s in open_)
        left = 0.0
        for s in list(open_):
            out[s] += unit * w[s]
            if out[s] >= most * sizes[s]:
                left += out[s] - most * sizes[s]
                out[s] = most * sizes[s]
                open_.discard(s)
    return out


def test_mix(spark):
    r = random.Random(3)
    rows = [(i, r.choice(["a", "b", "B", "é", None, "z"]) if i % 3 else "hot", " ".join(["x"] * r.choice([0, 1, 5, 20, 60]))) for i in range(3000)]
    rows += [(9000, "tiny", "one two"), (9001, "void", None), (None, "a", "x y"), (5, rows[5][1], rows[5][2])]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").withColumn("size", F.lit("clash"))
    got = pareto_mix.copies(df, pareto_mix.plan(df)).collect()
    again = pareto_mix.copies(df.repartition(5), pareto_mix.plan(df.repartition(5))).collect()
    assert sorted(map(str, got)) == sorted(map(str, again)) and len(got) == len(rows)
    sizes, taken = {}, {}
    for d in got:
        assert d["size"] == len(WORD.findall(d["text"] or "")) and d["taken"] == d["copies"] * d["size"] <= 3 * d["size"]
        sizes[d["source"]] = sizes.get(d["source"], 0) + d["size"]
        taken[d["source"]] = taken.get(d["source"], 0) + d["taken"]
    want = targets(sizes)
    for d in got:
        assert d["source_size"] == sizes[d["source"]] and d["target"] == pytest.approx(want[d["source"]])
    for s, t in want.items():
        assert abs(taken[s] - t) <= 60, (s, taken[s], t)  # to within one document
    mixed = pareto_mix.mixed(df)
    assert mixed.columns == df.columns and mixed.count() == sum(d["copies"] for d in got)
    assert pareto_mix.mixed(df.limit(0)).count() == 0


def test_longer_documents_have_better_odds(spark):
    df = spark.createDataFrame([(i, "s" if i % 2 else "t", "x " * (1 if i % 4 < 2 else 100)) for i in range(4000)], "doc_id long, source string, text string")
    n = {r["size"]: r["n"] for r in pareto_mix.copies(df, pareto_mix.plan(df)).where("source = 't'").groupBy("size").agg(F.avg("copies").alias("n")).collect()}
    assert n[100] > 2 * n[1]


# --- fingerprints ---------------------------------------------------------------


def test_likeness_is_jaccard():
    r = random.Random(6)
    word = lambda: "w%d" % r.randrange(3000)
    one = [[word() for _ in range(r.choice([8, 60, 900]))] for _ in range(300)]
    two = [w[: int(len(w) * r.random())] + [word() for _ in range(len(w) // 4)] for w in one]
    texts = [" ".join(w) for w in one + two]
    p = fingerprints.fingerprints(pa.array(texts))
    got = fingerprints.likeness(p[:300], p[300:])
    sets = [shingle_set(t) for t in texts]
    want = np.array([len(a & b) / max(1, len(a | b)) for a, b in zip(sets[:300], sets[300:])])
    assert np.abs(got - want).mean() < 0.04 and abs((got - want).mean()) < 0.015
    same = fingerprints.fingerprints(pa.array([None, "", " ", "a b", "A  B", "a b c"]))
    assert (same[0] == same[1]).all() and (same[3] == same[4]).all() and fingerprints.likeness(same[3:4], same[5:6])[0] < 0.5


def test_edits(spark):
    r = random.Random(2)
    texts = {i: "".join(r.choice("ab é\n") for _ in range(r.randrange(0, 50))) for i in range(40)} | {50: None, 51: "", 52: "long " * 5000}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(4)
    got = {x["doc_id"]: x for x in fingerprints.with_edits(df).collect()}
    order = sorted(texts, reverse=True)
    for i, d in enumerate(order):
        t, n = texts[d] or "", texts[order[(i + 1) % len(order)]] or ""
        k = len(t) // 3
        edited = t[: len(t) - k] + n[:k]
        assert got[d]["n_chars"] == len(t) and got[d]["edited_sha256"] == hashlib.sha256(edited.encode()).hexdigest()
        assert got[d]["edited_fingerprint"] == fingerprints.fingerprints(pa.array([edited]))[0].tobytes().hex()
    assert len(got) == len(texts) and fingerprints.with_edits(df.limit(0)).count() == 0
    assert fingerprints.with_edits(df.where("doc_id = 52")).first()["near_next"] == 1.0
    extra = fingerprints.fingerprint_column(df.withColumn("fingerprint", F.lit("clash")))
    assert extra.count() == len(texts) and extra.schema["fingerprint"].dataType.simpleString() == "binary"


# --- audio ----------------------------------------------------------------------


def test_media_round_trip(spark):
    texts = {1: None, 2: "", 3: "hé" * 100, 4: "x" * 576, 5: "y" * 200_000, 6: "hé" * 100}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").withColumn("media", F.lit("clash"))
    got = {r["doc_id"]: r for r in audio.digests(df).collect()}
    for d, t in texts.items():
        raw = (t or "").encode()
        p = raw + b"\xff" * (-len(raw) % 576 or (0 if raw else 576))
        assert (got[d]["n_bytes"], got[d]["payload_bytes"], got[d]["payload_sha256"], got[d]["tail_crc32"]) == (len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-32:]))
        assert got[d]["media_bytes"] == len(p) + 44
    assert got[3]["feature"] == got[6]["feature"] != got[4]["feature"] and got[1]["media_sha256"] == got[2]["media_sha256"]
    full = audio.features(audio.with_media(df)).orderBy("doc_id").toArrow()
    t = audio.tensors(full["chunks"])
    assert t.type.shape == [audio.FRAMES, audio.MELS] and t.to_numpy_ndarray().shape[1:] == (16, 24)
    assert audio.digests(df.limit(0)).count() == 0
    chunks, spans, found = audio.analyse(audio.payload(texts[3])[0])
    row = [r for r in full.to_pylist() if r["doc_id"] == 3][0]
    assert np.array_equal(np.array(row["chunks"], np.float32).reshape(chunks.shape), chunks)
    assert [(s["start"], s["end"]) for s in row["chunk_spans"]] == spans and [(s["start"], s["end"]) for s in row["segments"]] == found
    assert got[3]["feature"] == audio.feature_text(chunks, spans, found)


def test_features_by_their_definition():
    """Every step of a sound's features again, sample by sample."""
    rng = np.random.default_rng(8)
    raw = bytes(rng.integers(0, 256, 576 * 9, dtype=np.uint8))
    x = (np.frombuffer(raw, np.uint8).astype(float) - 128) / 128
    up, down = audio.UP, audio.DOWN
    wide, half = max(up, down), 8 * max(up, down)
    window = np.hanning(2 * half + 3)[1:-1]
    h = np.sinc((np.arange(2 * half + 1) - half) / wide) * window
    h *= up / h.sum()
    zeros = np.zeros(len(x) * up)
    zeros[::up] = x
    low = np.convolve(zeros, h)[half : half + len(zeros)][::down]
    assert len(low) == -(-len(x) * up // down) and np.abs(low - audio.resample(x.astype(np.float32))).max() < 1e-4
    rate = audio.RATE * up / down
    mel = lambda f: 2595 * np.log10(1 + f / 700)
    hz = 700 * (10 ** (np.linspace(mel(40), mel(rate / 2), audio.MELS + 2) / 2595) - 1)
    frames = [low[a : a + audio.FRAME] for a in range(0, len(low) - audio.FRAME + 1, audio.HOP)]
    want, energy = [], []
    for f in frames:
        power = np.abs(np.fft.rfft(f * np.hanning(audio.FRAME))) ** 2
        bins = np.arange(len(power)) * rate / audio.FRAME
        want.append([np.log10(sum(p * max(0, min((b - hz[m]) / (hz[m + 1] - hz[m]), (hz[m + 2] - b) / (hz[m + 2] - hz[m + 1]))) for p, b in zip(power, bins)) + 1e-6) for m in range(audio.MELS)])
        energy.append(10 * np.log10(power.mean() + 1e-9))
    chunks, spans, found = audio.analyse(raw)
    assert np.abs(chunks.reshape(-1, audio.MELS)[: len(want)] - np.array(want)).max() < 1e-2
    step, middle, on, segs = audio.HOP / rate, np.median(energy), False, []
    for i, e in enumerate(energy):
        if not on and e > middle + audio.UPPER_DB:
            on, first = True, i
        elif on and e < middle + audio.LOWER_DB:
            on = False
            segs.append((first * step, i * step))
    segs += [(first * step, len(energy) * step)] if on else []
    assert found == pytest.approx(segs) and spans[0] == (0, pytest.approx(min(audio.FRAMES, len(energy)) * step))


def test_resampling_keeps_a_tone():
    t = np.arange(16000) / 16000
    for up, down in ((1, 2), (2, 3), (3, 2)):
        y = audio.resample(np.sin(2 * np.pi * 440 * t).astype(np.float32), up, down)
        want = np.sin(2 * np.pi * 440 * np.arange(len(y)) / (16000 * up / down))
        assert len(y) == -(-16000 * up // down) and np.abs(y - want)[100:-100].max() < 0.02


def test_mel_bands_and_segments():
    t = np.arange(8000) / 8000
    mels, _ = audio.log_mel(np.sin(2 * np.pi * 1000 * t).astype(np.float32), 8000.0)
    hz = 700 * (10 ** (np.linspace(2595 * np.log10(1 + 40 / 700), 2595 * np.log10(1 + 4000 / 700), audio.MELS + 2) / 2595) - 1)
    assert abs(hz[1 + int(mels.mean(0).argmax())] - 1000) < 150
    e = np.array([0, 2, 0.5, 0.2, -2, 0.5, 3, 3], float)
    assert audio.segments(e, 1.0, -1.0) == [(1, 4), (6, 8)] and audio.segments(e[:1], 1, -1) == []


# --- languages ------------------------------------------------------------------


def test_languages(spark):
    r = random.Random(1)
    bits = {"en": ["the", "th", "ing", "and", "er"], "de": ["sch", "ein", "und", "ü", "ge"], "fr": ["é", "eau", "les", "que", "ou"]}
    text = lambda k: " ".join("".join(r.choice(bits[k]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 60)))
    rows = [(i, text(k), k) for i in range(600) for k in [r.choice(list(bits))]]
    rows += [(1000, None, "en"), (1001, "", "en"), (1002, "12 !?", "de"), (1003, text("de") * 3000, None), (None, text("fr"), "fr"), (1, rows[1][1], rows[1][2])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    fold = F.crc32(F.col("doc_id").cast("string")) % 3
    got = lang_id.predict(df, lang_id.fit(df, fold != 1)).collect()
    assert len(got) == len(rows)
    held = [x for x in got if x["doc_id"] is not None and x["doc_id"] < 1000 and zlib.crc32(str(x["doc_id"]).encode()) % 3 == 1]
    assert np.mean([x["lang"] == x["lang_pred"] for x in held]) > 0.98
    by = {x["doc_id"]: x for x in got}
    assert [by[i]["lang_pred"] for i in (1000, 1001, 1002, 1003)] == ["und", "und", "und", "de"]
    assert all(0 <= x["score"] <= 1 for x in got)
    far = lang_id.predict(spark.createDataFrame([("zzkq xxvw " * 9,)], "text string"), lang_id.fit(df, fold != 1)).first()
    assert far["rejected"] and far["lang_pred"] in bits
    none = lang_id.fit(df.limit(0), fold != 1)
    assert {x["lang_pred"] for x in lang_id.predict(df.limit(5), none).collect()} == {"und"}


def plain_counts(text):
    """Cells of a text's n-grams, one after another."""
    s = [32, *(int(lang_id._SIGN[b]) for b in (text or "").encode()), 32]
    out, m, shift = np.zeros(lang_id.CELLS), 0xFFFFFFFF, 34 - lang_id.CELLS.bit_length()
    two = lambda a, b: (a * 0x9E3779B1 & m ^ b * 0x85EBCA77 & m) * 0xC2B2AE3D & m
    for a, b in zip(s, s[1:]):
        out[two(a, b) >> shift] += (a, b) != (32, 32)
    for a, b, c in zip(s, s[1:], s[2:]):
        out[((two(a, b) ^ c * 0x27D4EB2F & m) * 0x165667B1 & m) >> shift | lang_id.CELLS // 2] += b != 32 or (a != 32 and c != 32)
    return out


def test_prediction_is_the_nearest_centroid(spark):
    r = random.Random(9)
    texts = [(i, None if i == 7 else " ".join("".join(r.choice(p) for _ in range(4)) for _ in range(r.randrange(0, 40))), k) for i in range(90) for k, p in [r.choice([("a", "abcdé"), ("b", "cdefg"), ("c", "fghi ")])]]
    df = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(3)
    model = lang_id.fit(df, F.col("doc_id") % 3 != 1)
    train = [(t, k) for i, t, k in texts if i % 3 != 1 and t is not None]
    seen = sum((plain_counts(t) > 0).astype(int) for t, _ in train)
    assert model.idf == pytest.approx(np.log((1 + len(train)) / (1 + seen)) + 1, rel=1e-5)
    assert {k: min(4, sum(l == k for _, l in train)) >= model.langs.count(k) > 0 for k in "abc"} == dict.fromkeys("abc", True)
    for x in lang_id.predict(df.drop("lang"), model).collect():
        v = np.log1p(plain_counts(x["text"])) * model.idf
        cos = model.vectors @ (v / max(1e-12, np.linalg.norm(v)))
        if not (x["text"] or "").strip():
            assert (x["lang_pred"], x["score"], x["rejected"]) == ("und", 0.0, True)
        else:
            assert x["score"] == pytest.approx(cos.max(), abs=1e-5) and x["lang_pred"] in {k for k, c in zip(model.langs, cos) if c > cos.max() - 1e-5}


def test_cutting_a_long_text_changes_nothing(monkeypatch):
    texts = ["déf, abc! " * 50, "x", None, "  a  " * 90]
    whole = [next(lang_id.counts(pa.array([t], pa.string())))[1][0] for t in texts]
    monkeypatch.setattr(lang_id._text, "BLOCK", 16)
    for t, w in zip(texts, whole):
        assert (next(lang_id.counts(pa.array([t], pa.string())))[1][0] == w).all() and (plain_counts(t) == w).all()


def test_long_texts_count_like_short_ones():
    t = "abc déf " * 200_000
    whole = next(lang_id.counts(pa.array([t])))[1]
    short = next(lang_id.counts(pa.array(["abc déf " * 1000])))[1]
    cos = float((whole[0] * short[0]).sum() / np.linalg.norm(whole[0]) / np.linalg.norm(short[0]))
    assert cos > 0.9999


# --- urls -----------------------------------------------------------------------

URLS = [
    None, "", "example.org/es/", "http://example.org/es/1", "https://EXAMPLE.org/en/12?x=/fr/", "http://a.b.example.org/en/1", "http://xexample.org/es/2", "http://org/", "http://org", "http://a.com/fr/",
    "http://a.com/de/x#y", "http://com/de/", "http://acom/de/", "x://h.com?/de/", "http://h.com#/de/", "://spam-farm.net/", "http://spamfarm.net/", "http://my.cheap-pills.example.com/fr/1", "http://free-bets.example.net/q",
    "http://A.ORG/EN/1", "http://a.org/x://b.com/de/", "http://ads.track.com/", "http://u.net/a\nb", "http://example.org/en/1" + "9" * 5000,
]


def test_url_rules_match_sql(spark, tmp_path):
    rows = [(i, u, "x") for i, u in enumerate(URLS * 2)]
    spark.createDataFrame(rows, "page_id long, url string, host string").write.parquet(f"{tmp_path}/pages.parquet")
    got = queries.op10_url_filters(spark, str(tmp_path))
    c = duckdb.connect()
    c.sql(f"CREATE VIEW pages AS SELECT * FROM '{tmp_path}/pages.parquet/*.parquet'")
    want = c.sql(queries.OP10_SQL).fetchall()
    assert sorted(map(tuple, got.collect()), key=str) == sorted(want, key=str) and len(want) == len(rows)
    df, rules = spark.read.parquet(f"{tmp_path}/pages.parquet"), queries.URL_RULES + [url_filters.word_rule("block", *w) for w in queries.URL_WORDS]
    inline, joined = (sorted(map(str, url_filters.judge(df, "url", rules, max_rules=m).select("page_id", "host", "path", "rule", "verdict").collect())) for m in (99, 0))
    assert inline == joined
    assert url_filters.judge(df.limit(0), "url", rules).count() == 0 and url_filters.judge(df, "url", []).where("verdict = 'allow'").count() == len(rows)
    assert "Python" not in got._jdf.queryExecution().toString()


def test_thousands_of_rules(spark):
    r = random.Random(8)
    names = ["%s%d" % (r.choice("abcdefgh"), i) for i in range(900)]
    rules = sorted({url_filters.host_rule(r.choice(["allow", "block"]), f"{r.choice(names)}.{r.choice(['com', 'net'])}", r.choice(["/", "/x/", f"/{r.choice(names)}/"])).name: 0 for _ in range(2600)})
    rules = [url_filters.host_rule("block" if i % 2 else "allow", *n.split("/", 1)[:1], "/" + n.split("/", 1)[1]) for i, n in enumerate(rules)]
    urls = [f"http://{r.choice(['', 'www.', 'y-'])}{r.choice(names)}.{r.choice(['com', 'net', 'org'])}/{r.choice(['', 'x/1', r.choice(names) + '/', 'q'])}" for _ in range(1500)]
    df = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "page_id long, url string")
    got = {x["page_id"]: (x["rule"], x["verdict"]) for x in url_filters.judge(df, "url", rules).collect()}
    assert len(rules) > url_filters.MAX_RULES
    hit = 0
    for i, u in enumerate(urls):
        host, path = u[7:].split("/", 1)
        fits = [x for x in rules for h, p in [x.name.split("/", 1)] if (host == h or host.endswith("." + h)) and path.startswith(p)]
        best = min(fits, key=lambda x: (-x.rank, x.name), default=None)
        hit += best is not None
        assert got[i] == ((best.name, best.verdict) if best else (None, "allow")), u
    assert hit > 300
    few = url_filters.judge(df.limit(200), "url", rules[:400], max_rules=400), url_filters.judge(df.limit(200), "url", rules[:400], max_rules=0)
    one, two = (sorted(map(str, x.select("page_id", "rule", "verdict").collect())) for x in few)
    assert one == two


def test_rules_are_filed_under_their_rarest_token(spark):
    rules = [url_filters.host_rule("block", "example.org", "/es/")]
    df = spark.createDataFrame([(["example", "org"],), (["org", "es"],), (["org", "es", "example"],), (["es"],)], "_tokens array<string>")
    assert url_filters.rarest_tokens(df, rules)[rules[0]] == "example"


# --- shared folder --------------------------------------------------------------


def test_no_local_folder_on_a_cluster():
    session = SimpleNamespace(conf={}, sparkContext=SimpleNamespace(master="yarn", getConf=dict))
    with pytest.raises(ValueError):
        _runtime.shared_root(session)
    session.conf["spark.checkpoint.dir"] = "hdfs://x/y/"
    assert _runtime.shared_root(session) == "hdfs://x/y"


# --- components -----------------------------------------------------------------


def test_files_of_a_store_are_mapped(tmp_path, monkeypatch):
    monkeypatch.setattr(_runtime, "is_local", lambda path: False)
    for name, data in (("a", bytes(range(256)) * 40_000), ("b", b"")):
        _runtime.put_file(f"file://{tmp_path}/x/{name}", data)
        got = _runtime.map_file(f"file://{tmp_path}/x/{name}")
        assert got.tobytes() == data and (isinstance(got.base, np.memmap) or not data)


def test_components(spark, tmp_path):
    r = random.Random(7)
    edges = [(i, i + 1) for i in range(100, 160)] + [(r.randrange(60), r.randrange(60)) for _ in range(40)] + [(200, 200 + i) for i in range(1, 50)] + [(300, 300)]
    parent = {x: x for e in edges for x in e}

    def top(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        x, y = sorted((top(a), top(b)))
        parent[y] = x
    got = {x["node"]: x["comp"] for x in components.components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path)).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: top(x) for x in linked}
    assert components.components(spark.createDataFrame([], "a long, b long"), f"{tmp_path}/e").count() == 0
