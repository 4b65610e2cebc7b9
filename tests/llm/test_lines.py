"""Line dedup and the pipeline against brute force."""

import random
import re
from collections import Counter, defaultdict

import corpus_pipeline
from plinth.llm import lines

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def brute(rows, ratio=lines.RATIO, min_pages=lines.MIN_PAGES):
    """doc_id -> text without the lines on over a ``ratio`` of its host's distinct texts."""
    pages, counts = defaultdict(set), defaultdict(Counter)
    for _, text, host in rows:
        pages[host].add(text)
    for host, texts in pages.items():
        for text in texts:
            counts[host].update({x for x in (text or "").split("\n") if re.search(r"[^ \t\n\v\f\r]", x)})
    gone = {h: {x for x, n in c.items() if n >= min_pages and n > ratio * len(pages[h])} for h, c in counts.items()}
    return {i: text if text is None else "\n".join(x for x in text.split("\n") if x not in gone[host]) for i, text, host in rows}


def prose(rng, n_lines):
    return "\n".join(" ".join(f"w{rng.randrange(10**6)}" for _ in range(12)) for _ in range(n_lines))


def test_copies_of_a_page_count_once(spark):
    rng = random.Random(1)
    copy = prose(rng, 6)
    rows = [(i, f"menu of h{i % 2}\n{prose(rng, 5)}", f"h{i % 2}") for i in range(60)]
    rows += [(100 + i, copy, f"h{i % 2}") for i in range(30)] + [(200 + i, f"menu of h0\n{copy}", "h0") for i in range(30)] + [(300, None, "h0"), (301, None, "h0")]
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string"), min_pages=10).collect()}
    want = brute(rows, min_pages=10)
    assert got == want and want[100] == want[101] == copy and want[0] == rows[0][1].split("\n", 1)[1]
    assert got[100] == copy and "menu" not in got[200]


def test_pipeline_keeps_one_of_many_copies(spark, tmp_path):
    """A third of all rows are copies of one page: the one with the least id goes to packing with its whole text."""
    rng = random.Random(2)
    rows = [(i, f"menu of h{i % 3}\n{prose(rng, 8)}", "en", f"h{i % 3}", 0) for i in range(80)]
    copy = prose(rng, 8)
    rows += [(1000 + i, copy, "en", f"h{i % 3}", 0) for i in range(40)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    texts = {}
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = corpus_pipeline.materialize(stage(spark, docs, str(tmp_path)))
        texts[name] = {r.doc_id: r.text for r in docs.collect()}
    want = brute([(i, text, source) for i, text, _, source, _ in rows])
    assert texts["line_dedup"] == want and want[1000] == copy
    one = {i: t for i, t in want.items() if i <= 1000}
    assert texts["near_duplicates"] == texts["suffix_dedup"] == one
    assert sorted(r.doc_id for r in corpus_pipeline.run(spark, str(tmp_path)).collect()) == sorted(one)


def test_small_hosts_lose_lines_by_the_ratio_alone(spark):
    rng = random.Random(3)
    rows = []
    for h, n in enumerate((1, 2, 5, 9, 39, 41, 60, 150)):  # a menu on all pages, a line on three, one on two, own lines
        rows += [(1000 * h + i, f"menu\n{'three' if i < 3 else 'x'}{h}\n{'two' if i < 2 else i}{h}\n{prose(rng, 2)}", f"h{h}") for i in range(n)]
    got = {r.doc_id: r.text for r in lines.drop_boilerplate(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert got == brute(rows, min_pages=2)
    assert got[0].startswith("menu") and not any("menu" in t for i, t in got.items() if i)
    assert "two4" not in got[4000] and "two5" in got[5000] and "three5" not in got[5000] and "three6" in got[6000]
