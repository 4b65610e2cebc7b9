"""Nulls, empty and long texts, ties, repeated rows, empty tables and clashing names, for every operator."""

import hashlib
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from plinth.llm import bpe, lines, media, ngrams, packing, quality, suffixes, toxicity, urls

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
LONG = " ".join(f"word{i * 7919 % 100003}" for i in range(60_000))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(1, None, "en", "a", 0), (2, "", None, None, None), (3, LONG, "en", "a", 1), (4, "x y", "en", None, 1), (5, LONG + " tail", "en", "a", 1), (6, "x y", "en", "a", 1), (7, " \n\t ", "fr", "b", 1), (None, "no id at all", "en", "a", 1), (8, "é漢😀 " * 80, "fr", "b", 1)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


def extra(df):
    """With columns named like ones that operators use."""
    for c in ("host", "line", "lines", "row", "features", "n", "token", "fragment", "u", "v", "rep", "size", "key", "bucket", "spans", "kept", "b_host", "measure"):
        df = df.withColumn(c, F.lit("mine"))
    return df


def test_stages_keep_columns_and_clashing_names(odd, empty):
    for stage in (quality.filter_documents, lines.drop_boilerplate, ngrams.one_of_each, suffixes.drop_repeats):
        clash = extra(odd)
        got = stage(clash)
        assert got.columns == clash.columns and got.schema["text"].dataType.simpleString() == "string"
        assert all(r["host"] == "mine" for r in got.collect())
        assert stage(empty).count() == 0


def test_quality_of_odd_texts(odd, empty):
    f = {r.doc_id: r.f for r in odd.where("doc_id IS NOT NULL").select("doc_id", quality.features("text").alias("f")).collect()}
    assert tuple(f[1]) == tuple(f[2]) == tuple(f[7]) == (0, 0, 0, 0, 0)
    assert f[4].n_words == 2 and f[8].word_chars == 240 and f[8].n_repeat_words == 80
    assert quality.text_features("a b c\na b c\n\n#x") == (7, 8, 1, 1, 6)
    kept = {r.doc_id for r in quality.filter_documents(odd).collect()}
    assert kept == {3, 5}


def test_jaccard_of_odd_texts(odd, empty):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in ngrams.jaccard_components(odd).collect()}
    assert got[1] == (0, 1) and got[2] == (0, 2) and got[7] == (0, 7)
    assert got[4] == (1, 4) and got[6] == (1, 4) and got[5][1] == 3 and None not in got
    assert ngrams.jaccard_components(empty).count() == 0


def test_jaccard_threshold_is_exact(spark):
    words = [f"w{i}" for i in range(1000)]
    rows = [(i, t) for i, t in enumerate([" ".join(words[:104]), " ".join(words[:104]).upper(), " ".join(words[:80] + ["z"] * 1 + words[81:104]), " ".join(words[16:120]), " ".join(words[15:119]), " ".join(words[14:118])], start=10)]
    got = {r.doc_id: r.component_id for r in ngrams.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {}
    for i, text in rows:
        w = text.lower().split()
        sets[i] = {tuple(w[j : j + 5]) for j in range(len(w) - 4)}
    root = {i: i for i in sets}
    for _ in sets:
        for a in sets:
            for b in sets:
                if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                    root[a] = root[b] = min(root[a], root[b])
    assert got == root


def test_jaccard_of_a_large_group_of_near_copies(spark):
    base = [f"b{i}" for i in range(150)]
    rows = []
    for i in range(400):
        w = list(base)
        for j in range(i % 7):
            w[(i * 37 + j * 53) % 150] = f"e{i}x{j}"
        rows.append((i, " ".join(w)))
    got = {r.doc_id: r.component_id for r in ngrams.jaccard_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: frozenset(tuple(x.split()[j : j + 5]) for j in range(146)) for i, x in rows}
    root = dict(zip(sets, sets, strict=True))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    assert got == {i: find(i) for i in sets}


def brute_cut(rows):
    seen, out = set(), {}
    for i, raw in sorted(rows):
        gone = bytearray(len(raw))
        for j in range(len(raw) - 99):
            if raw[j : j + 100] in seen:
                gone[j : j + 100] = b"\1" * 100
            seen.add(raw[j : j + 100])
        out[i] = bytes(x for x, g in zip(raw, gone, strict=True) if not g)
    return out


@pytest.mark.parametrize("most", [4096, 2])
def test_suffix_dedup_equals_brute_force(spark, most):
    rng = np.random.default_rng(4)
    pool = ["".join(rng.choice(list("abcdé \n"), 130)) for _ in range(6)]
    texts = ["".join(pool[k] if rng.random() < 0.8 else "".join(rng.choice(list("xyz "), 90)) for k in rng.integers(0, 6, rng.integers(1, 7))) for _ in range(40)]
    texts += ["ab" * 400, "\0" * 300, "abcde " * 90, texts[0], ""]
    rows = list(enumerate(texts))
    got = {r.doc_id: bytes(r.kept) for r in suffixes.cut_repeats(spark.createDataFrame(rows, "doc_id long, text string"), most=most).collect()}
    assert got == brute_cut([(i, t.encode()) for i, t in rows])


def test_suffix_dedup_of_odd_texts(odd, empty):
    got = {r.doc_id: r for r in suffixes.cut_repeats(odd).collect()}
    assert got[1].n_bytes == 0 and bytes(got[2].kept) == b"" and bytes(got[4].kept) == b"x y"
    assert bytes(got[5].kept) == b" tail" and None not in got
    assert suffixes.cut_repeats(empty).count() == 0
    assert suffixes.kept_text("aé漢b".encode(), [{"start": 2, "size": 3}]) == "aé漢b"
    assert suffixes.kept_text("aé漢b".encode(), [{"start": 1, "size": 5}]) == "ab"


def test_lines(spark):
    rows = [(i, "menu\n" + f"own {i}\n\n", "h") for i in range(20)] + [(20, None, "h"), (21, "menu", "g"), (22, "", None)]
    got = {r.doc_id: r for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), counts=("a", "b")).collect()}
    assert got[3].text == "own 3\n\n" and (got[3].a, got[3].b) == (4, 1)
    assert got[20].text is None and got[21].text == "menu" and got[22].text == ""


def test_media(odd, empty):
    for text in ("", None, "a", "x" * 64, LONG):
        payload, n = media.payload_of(text)
        png, back, size, low = media.stored(text)
        assert back == payload and size == n and len(low) == 8 and len(payload) % 64 == 0
    kinds = np.array([0, 1, 2, 3, 4, 4, 3], np.uint8)
    rows = np.random.default_rng(1).integers(0, 256, (7, 64)).astype(np.uint8)
    want, above = np.zeros((7, 64), int), np.zeros(64, int)
    for y in range(7):
        for x in range(64):
            a, b, c = (want[y, x - 1] if x else 0), above[x], (above[x - 1] if x else 0)
            want[y, x] = (int(rows[y, x]) + [0, a, b, (a + b) // 2, media._paeth(a, b, c)][kinds[y]]) % 256
        above = want[y]
    assert (media.unfilter(kinds, rows) == want).all()
    png = media.stored("some text")[0]
    for broken in (png[:-1], png[:40] + b"\x00" + png[41:], b"x" + png[1:]):
        with pytest.raises(ValueError):
            media.decode(broken)
    assert media.digests(odd).count() == 9 and media.media_columns(empty).count() == 0
    ids = [r.doc_id for r in media.digests(odd.select(F.lit((1 << 60) + 1).alias("doc_id"), "text")).collect()]
    assert set(ids) == {(1 << 60) + 1}


def test_urls(spark):
    rules = [("allow", "org", "/"), ("block", "example.org", "/es/")]
    pages = spark.createDataFrame([(1, None), (2, "no scheme"), (3, "http://A.Example.ORG/es/x"), (4, "http://b.org"), (5, "https://www.bad.com/p/?utm_source=x"), (6, "http://bad.com/q"), (6, "http://bad.com/q"), (7, "x://notexample.org/es/")], "page_id long, url string").withColumn("block", F.lit(1)).withColumn("host", F.lit("mine"))
    listed = spark.createDataFrame([("bad.com/p",)] + [(f"h{i}.com/",) for i in range(500)], "listed_url string")
    got = [(r.page_id, r.host, r.rule, r.verdict) for r in urls.judge(pages, listed, rules).orderBy("page_id").collect()]
    assert got == [(1, "", None, "allow"), (2, "", None, "allow"), (3, "a.example.org", "example.org/es/", "block"), (4, "b.org", None, "allow"), (5, "www.bad.com", None, "block"), (6, "bad.com", None, "allow"), (6, "bad.com", None, "allow"), (7, "notexample.org", "org/", "allow")]
    assert urls.judge(pages, listed.limit(0), rules).where("verdict = 'block'").count() == 1


def test_bpe_equals_the_library(spark, odd, empty):
    public = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer

    path = public.path("byte_bpe_50k.json")
    known = Tokenizer.from_file(path)
    codec = bpe.Codec(open(path, encoding="utf-8").read())
    rng = np.random.default_rng(2)
    parts = ["a", "b", " ", "  ", "\n", "\x1c", "\x85", "\xa0", "'s", "'ll", "1", "²", "é", "漢", "<|endoftext|>", "<|end", "😀", "\u200b", "$%", "ab" * 60, "\0", "ß"]
    for text in ["".join(rng.choice(parts, rng.integers(0, 14))) for _ in range(500)] + ["ab" * 3000 + "q" * 2000, LONG]:
        ids = codec.encode(text)
        assert ids == known.encode(text, add_special_tokens=False).ids
        assert codec.decode(ids) == known.decode(ids, skip_special_tokens=False)
    encoded = bpe.encode(odd, path)
    back = {r.doc_id: r.text for r in bpe.decode(encoded, path).collect()}
    assert back[1] == "" and back[3] == LONG and back[8] == "é漢😀 " * 80
    assert bpe.digests(empty, path).count() == 0


def brute_bounds(bins, k):
    best = None
    from itertools import combinations

    n = len(bins)
    for m in range(1, min(k, n) + 1):
        for cut in combinations(range(n - 1), m - 1):
            ends, at, pad = [*cut, n - 1], 0, 0
            for e in ends:
                pad += sum(bins[e][0] * r - t for _, r, t in bins[at : e + 1])
                at = e + 1
            if best is None or pad < best:
                best = pad
    return best


def test_packing(odd, empty):
    rng = np.random.default_rng(5)
    for _ in range(20):
        lengths = np.unique(rng.integers(0, 100, 8))
        bins = np.array([(x, r, x * r) for x, r in zip(lengths, rng.integers(1, 9, len(lengths)), strict=True)])
        tops = packing.bounds(bins, 3)
        pad = sum(min(t for t in tops if t >= x) * r - tok for x, r, tok in bins)
        assert pad == brute_bounds([tuple(map(int, b)) for b in bins], 3) and len(tops) <= 3
    got = packing.pack(odd, buckets=2, budget=10).collect()
    assert len(got) == 9 and all(r.n_tokens <= r.pad_to for r in got)
    assert len({(r.bucket, r.batch, r.slot) for r in got}) == 9
    for r in got:
        assert r.slot < max(1, 10 // max(1, r.pad_to))
    assert packing.pack(empty).count() == 0


def test_toxicity(spark, odd, empty):
    rng = np.random.default_rng(6)
    words = [f"{a}{b}{c}" for a in "bdfgk" for b in ("ana", "ere", "olo") for c in ("ti", "mo", "lan")]
    rows = []
    for i in range(400):
        w = list(rng.choice(words, 60))
        if i % 4 == 0:
            for p in rng.integers(0, 60, 4):
                w[p] = str(rng.choice(["grumblefoot", "snotwhistle", "dungbeetle"]))
        rows.append((i, " ".join(w), int(i % 4 == 0)))
    df = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    held = lambda i: zlib.crc32(str(i).encode()) % 3 == 1
    scorer = toxicity.fit(df.select("doc_id", "text"), df.where(F.crc32(F.col("doc_id").cast("string")) % 3 != 1).select("doc_id", "toxic"))
    got = {r.doc_id: r.score for r in toxicity.scores(df, scorer).collect()}
    right = [(got[i] >= 0.7) == bool(y) for i, _, y in rows if held(i)]
    assert np.mean(right) > 0.95
    assert all(0 <= r.score <= 1 for r in toxicity.scores(odd, scorer).collect())
    assert toxicity.scores(empty, scorer).count() == 0
    assert {r.score for r in toxicity.scores(odd, toxicity.fit(odd, df.limit(0).select("doc_id", "toxic"))).collect()} == {0.0}


def test_digest_of_the_media_payload(spark):
    r = media.digests(spark.createDataFrame([(1, "abc")], "doc_id long, text string")).first()
    padded = b"abc" + bytes(61)
    assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (3, 64, hashlib.sha256(padded).hexdigest(), zlib.crc32(padded))
