"""Queries against their SQL, and results against direct computation."""

import os

import duckdb
import numpy as np
import pytest
import zstandard
from pyspark.sql import functions as F

import corpus_pipeline
from plinth.llm import bpe, chat, media, ngrams, packing, queries, suffixes, toxicity, urls

SF = "/root/testdata/sf0.001"
needs_tables = pytest.mark.skipif(not os.path.isdir(SF), reason="needs the driver's tables")


@needs_tables
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    duck = duckdb.connect()
    for t in ("documents", "conversations", "pages"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    cursor = duck.execute(queries.ORACLE_SQL[name])
    columns = [c[0] for c in cursor.description]
    df = queries.QUERIES[name](spark, SF)
    assert sorted(columns) == sorted(df.columns)
    assert sorted(map(repr, map(tuple, df.select(*columns).collect()))) == sorted(map(repr, cursor.fetchall()))


@needs_tables
def test_pipeline_runs_on_the_tables(spark):
    got = corpus_pipeline.run(spark, SF).collect()
    ids = {r.doc_id for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id").collect()}
    assert 0 < len(got) == len({r.doc_id for r in got}) and {r.doc_id for r in got} <= ids


def test_suffix_dedup_reads_one_text_of_a_repeated_id(spark):
    a, b = "x" * 30 + "common " * 20, "y" * 30 + "common " * 20
    rows = [(1, b), (1, a), (2, a), (2, a)]
    got = [(r.doc_id, bytes(r.kept)) for r in suffixes.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got)[0] == (1, b"x" * 30 + b"common ") and len(got) == 2 and sorted(got)[1][1] == b""


def test_pairs_just_under_the_threshold_stay_apart(spark):
    """A large group of near copies, most of them apart from most others, with every link kept."""
    rng = np.random.default_rng(7)
    base = [f"b{i}" for i in range(120)]
    rows = []
    for i in range(240):
        w = list(base)
        for p in rng.integers(0, 120, rng.integers(3, 7)):
            w[p] = f"e{rng.integers(0, 40)}"
        rows.append((i, " ".join(w)))
    vocabulary, sets = {}, []
    for _, x in rows:
        w = x.split()
        sets.append({vocabulary.setdefault(tuple(w[j : j + 5]), len(vocabulary)) for j in range(len(w) - 4)})
    held = np.zeros((240, len(vocabulary)), np.float32)
    for i, s in enumerate(sets):
        held[i, list(s)] = 1
    both, n = held @ held.T, held.sum(1)
    links = 100 * both >= 75 * (n[:, None] + n[None] - both)
    root = np.arange(240)
    while True:
        least = np.array([root[links[i]].min() for i in range(240)])
        if (least == root).all():
            break
        root = least
    got = {r.doc_id: r.component_id for r in ngrams.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == dict(enumerate(root.tolist())) and len(set(root.tolist())) > 20


def test_windows_are_compressed_as_they_stand():
    scorer = toxicity.Scorer(b"one two three four", b"one two idiot scum").open()
    texts = [b"one two idiot four five six seven eight nine TEN scum", b"", b"three", b" \n "]
    of, saved = scorer.savings(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)]))
    parts = [(0, b"one two idiot four five six seven eight "), (0, b" nine ten scum"), (2, b"three")]
    want = [len(scorer.by[0].compress(x)) - len(scorer.by[1].compress(x)) for _, x in parts]
    assert of.tolist() == [i for i, _ in parts] and saved.tolist() == want


def test_trained_dictionaries_hold_what_sets_texts_apart():
    rng = np.random.default_rng(8)
    words = [f"{a}{b}{c}" for a in "bdfgkmnp" for b in ("ana", "ere", "olo", "ita") for c in ("ti", "mo", "lan", "ver")]
    text = lambda extra: " ".join([*rng.choice(words, 30), *extra, *rng.choice(words, 30)]).encode()
    toxic, ordinary = [text([str(rng.choice(["grumblefoot", "snotwhistle"]))]) for _ in range(300)], [text([]) for _ in range(600)]
    plain, nasty = toxicity.contents(toxic, ordinary)
    assert b"grumblefoot" in nasty and b"snotwhistle" in nasty and b"grumblefoot" not in plain
    assert toxicity.trained([b"too few"]) == b"too few"
    assert isinstance(zstandard.ZstdCompressionDict(nasty), zstandard.ZstdCompressionDict)


def test_frequencies_equal_the_direct_sum():
    rng = np.random.default_rng(9)
    samples = rng.integers(0, 256, (32, 32))
    low = np.array([[sum(samples[y, x] * np.cos(np.pi * (2 * y + 1) * u / 64) * np.cos(np.pi * (2 * x + 1) * v / 64) for y in range(32) for x in range(32)) for v in range(8)] for u in range(8)]).round(6).ravel()
    assert media.low_frequencies(samples) == np.packbits(low > np.median(low[1:])).tobytes()


def test_windows_keep_to_the_budget(spark):
    rows = [(1, 0, "system", "s " * 20)] + [(1, i, "user" if i % 2 else "assistant", "w " * (5 * i % 37)) for i in range(1, 60)] + [(2, 0, "user", "x " * 900), (2, 1, "assistant", None), (None, None, None, None)]
    w = chat.windows(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumn("window", F.lit("mine"))).collect()
    assert all(r.tokens <= chat.BUDGET or r.n_new == 1 for r in w) and sum(r.n_new for r in w) == len(rows)
    assert any(r.tokens > 900 for r in w) and max(r.tokens for r in w if r.conv_id == 1) <= chat.BUDGET


def test_packing_of_ties_and_null_keys(spark):
    rows = [(None, "a b")] * 3 + [(1, "a b")] * 4 + [(1, "a")] * 2
    got = packing.pack(spark.createDataFrame(rows, "doc_id long, text string").withColumn("bucket", F.lit("mine")), buckets=2, budget=4).collect()
    assert len(got) == 9 and len({(r.bucket, r.batch, r.slot) for r in got}) == 9
    assert all(r.n_tokens <= r.pad_to and (r.slot + 1) * r.pad_to <= 4 for r in got)


def test_clashing_names_empty_tables_and_repeated_rows(spark):
    docs = spark.createDataFrame([(1, "a toxic text"), (1, "a toxic text"), (2, None)], "doc_id long, text string")
    for c in ("_text", "_lot", "n", "ids", "score", "media", "payload", "hash", "toxic", "n_tokens", "host", "path"):
        docs = docs.withColumn(c, F.lit("mine"))
    assert len({bytes(r.media) for r in media.media_columns(docs).collect()}) == 2
    assert [r.score for r in toxicity.scores(docs, None).collect()] == [0.0] * 3
    scorer = toxicity.Scorer(b"ordinary words", b"toxic words", (0.0, 1.0, 0.0, 0.0))
    assert len({r.score for r in toxicity.scores(docs, scorer).where("doc_id = 1").collect()}) == 1
    public = pytest.importorskip("public_tokenizers")
    encoded = bpe.encode(docs, public.path("byte_bpe_50k.json")).collect()
    assert len(encoded) == 3 and len({r.ids for r in encoded}) == 2
    none = spark.createDataFrame([], "page_id long, url string")
    assert urls.judge(none, spark.createDataFrame([("a.b/c",)], "listed_url string"), []).count() == 0
