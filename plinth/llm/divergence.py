"""Source divergence audit: how far the sources of a language differ in their terms, and in which.

Terms are integers: each language's kept terms are sorted in UTF-8 order and cut into chunks; in a chunk a term's id is
its place in the sorted array (``searchsorted``), a group's counts are one dense vector (``bincount`` of the ids), and
ties fall to the smaller id. Groups are compared vector by vector, chunk by chunk, and the values are summed.

1. Tasks count the terms of their texts per group and hand on each count once (``_counts``).
2. Dealt by (language, term), counts are summed, and terms of too few documents go.
3. The kept terms, ranged by (language, term), become chunks (``_chunks``); their sums give each group's total.
4. Each chunk, with its language's list of sources and totals, gives pair values and its best terms (``_compared``).

The vocabulary never meets in a task: a chunk is bounded in terms and in cells. The list of a language's sources has to
fit in a row, as the result has a row for each two of them.

Arithmetic is exact in 64-bit integers for totals up to 9 * 10^15. Defined results: null text, language and source are
the empty string; a group without terms, and a language without kept terms, still has its pairs (of value 0 in the
latter); each row is a document, repeated rows too; very long texts count whole; equal values rank by the item's UTF-8
bytes; an empty table gives an empty result; other columns, whatever their names, aren't read.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import join_few, materialize

LEAST_DOCUMENTS = 10
#: Ranks of the terms that a group has more often than its language.
TOP_TERMS = 10
SCALE_STEPS, SCALE_BASE = 3, 1000  # their power is the scale, 10^9
#: Terms and cells of a chunk at most (one term more in cells).
CHUNK_TERMS, CHUNK_CELLS = 4096, 1 << 20
#: Texts that are Python objects at once; counts that a task holds; bytes of a text that are split at once.
STEP, FLUSH, PIECE = 128, 500_000, 1 << 20
#: A-Z become small, small letters and bytes of other characters stay, all else separates.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.binary()), ("n", pa.int64()), ("docs", pa.int64())])
_CHUNKS = pa.schema([("lang", pa.string()), ("terms", pa.list_(pa.binary())), ("sources", pa.list_(pa.string())), ("totals", pa.list_(pa.int64())), ("counts", pa.binary())])
_FOUND = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.binary()), ("value", pa.int64())])


def _words(text: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, a piece of it at a time."""
    letters, start = text.translate(_LETTERS), 0
    while start < len(letters):
        end = letters.find(b" ", start + PIECE)
        end = len(letters) if end < 0 else end
        yield letters[start:end].split()
        start = end


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Occurrences and documents of each (language, source, term) of a task's texts; a null term stands for the group."""

    def flush() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in held.items():
            k = len(n) + 1
            columns = [pa.repeat(pa.scalar(lang, pa.string()), k), pa.repeat(pa.scalar(source, pa.string()), k), pa.array([*n, None], pa.binary()), pa.array([*n.values(), 0], pa.int64()), pa.array([*map(docs.__getitem__, n), 0], pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, schema=_COUNTS)
        held.clear()

    held: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    for batch in batches:
        for at in range(0, batch.num_rows, STEP):
            lang, source, text = batch.slice(at, STEP).columns
            for group, x in zip(zip(lang.to_pylist(), source.to_pylist(), strict=True), pc.cast(text, pa.binary()).to_pylist(), strict=True):
                n, docs = held.setdefault(group, (Counter(), Counter()))
                seen = set()
                for words in _words(x):
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
            if sum(len(n) for n, _ in held.values()) > FLUSH:
                yield from flush()
    yield from flush()


def _chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chunks of counts (lang, term, source, n) that come sorted by (lang, term), terms of one language each."""

    def chunk() -> pa.RecordBatch:
        names = sorted(set(source))
        kept = np.array([t for i, t in enumerate(term) if not i or t != term[i - 1]], dtype=object)
        ids = np.searchsorted(kept, np.array(term, dtype=object))
        code = {name: i for i, name in enumerate(names)}
        flat = np.array([code[s] for s in source], np.int64) * len(kept) + ids
        # sums of one row each, so below 2^53 they are exact
        dense = np.bincount(flat, np.array(n, np.float64), len(names) * len(kept)).astype(np.int64).reshape(len(names), len(kept))
        row = [[lang], [list(kept)], [names], [dense.sum(1).tolist()], [dense.tobytes()]]
        return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(row, _CHUNKS.types, strict=True)], schema=_CHUNKS)

    lang, term, source, n, terms, groups = None, [], [], [], 0, set()
    for batch in batches:
        for of, t, s, k in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            new = not term or t != term[-1] or of != lang
            if term and new and (of != lang or terms >= CHUNK_TERMS or terms * len(groups) >= CHUNK_CELLS):
                yield chunk()
                term, source, n, terms, groups = [], [], [], 0, set()
            lang, terms = of, terms + new
            groups.add(s)
            term.append(t)
            source.append(s)
            n.append(k)
    if term:
        yield chunk()


def scaled(count: np.ndarray, total: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 * count / total) for 0 < count <= total, without a product over 64 bits: digits of a long division."""
    out, rest = np.divmod(count, total)
    for _ in range(SCALE_STEPS):
        digit, rest = np.divmod(rest * SCALE_BASE, total)
        out = out * SCALE_BASE + digit
    return out + 1


def divergence(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """floor((p - q)^2 / (p + q)); the square stays under 2^63."""
    return (p - q) ** 2 // (p + q)


def _compared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of each chunk with its language's sources, totals and number of terms: a value per two sources, and its best terms per source."""
    for batch in batches:
        for row in batch.to_pylist():
            names, sums, terms = row["all_sources"], np.array(row["all_totals"], np.int64), row["terms"]
            here = np.searchsorted(np.array(names, dtype=object), np.array(row["sources"], dtype=object)) if terms else []
            dense = np.frombuffer(row["counts"], np.int64).reshape(len(row["sources"]), len(terms))
            add = 2 * row["n_terms"]
            pairs = np.zeros((len(names), len(names)), np.int64)
            best = []
            step = max(1, CHUNK_CELLS // len(names))
            for at in range(0, len(terms), step):
                some = np.zeros((len(names), min(step, len(terms) - at)), np.int64)
                some[here] = dense[:, at : at + step]
                p = scaled(some + 2, (sums + add)[:, None])
                for i in range(len(names) - 1):
                    pairs[i, i + 1 :] += divergence(p[i + 1 :], p[i]).sum(1)
                q = scaled(some.sum(0) + 2, int(sums.sum()) + add)
                for i in here:
                    over = np.flatnonzero((some[i] > 0) & (p[i] > q))
                    value = divergence(p[i, over], q[over])
                    first = np.argsort(-value, kind="stable")[:TOP_TERMS]  # ids are in UTF-8 order, so ties fall to the smaller
                    best += [("term", row["lang"], names[i], terms[at + t], int(v)) for t, v in zip(over[first], value[first], strict=True)]
            for i in range(len(names) - 1):
                others = len(names) - 1 - i
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar("pair"), others), pa.repeat(pa.scalar(row["lang"]), others), pa.repeat(pa.scalar(names[i]), others), pa.array([x.encode() for x in names[i + 1 :]], pa.binary()), pa.array(pairs[i, i + 1 :])], schema=_FOUND)
            if best:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*best, strict=True), _FOUND.types, strict=True)], schema=_FOUND)


def audit(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source", least: int = LEAST_DOCUMENTS) -> DataFrame:
    """(lang, source, part, item, value, rank): each source against the others of its language, and its outstanding terms."""
    texts = docs.select(*[F.coalesce(docs[x].cast("string"), F.lit("")).alias(n) for x, n in ((lang, "lang"), (source, "source"), (text, "text"))])
    counted = texts.mapInArrow(_counts, "lang string, source string, term binary, n long, docs long")
    summed = counted.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    often = summed.withColumn("all", F.sum("docs").over(Window.partitionBy("lang", "term"))).where((F.col("all") >= least) | F.col("term").isNull())
    kept = materialize(often.select("lang", "term", "source", "n"))
    sorted_ = kept.where("term IS NOT NULL").repartitionByRange("lang", "term").sortWithinPartitions("lang", "term", "source")
    chunks = materialize(sorted_.mapInArrow(_chunks, "lang string, terms array<binary>, sources array<string>, totals array<long>, counts binary"))
    totals = chunks.select("lang", F.explode(F.arrays_zip("sources", "totals")).alias("x")).select("lang", F.col("x.sources").alias("source"), F.col("x.totals").alias("n"))
    groups = kept.where("term IS NULL").select("lang", "source", F.lit(0).cast("long").alias("n")).unionByName(totals).groupBy("lang", "source").agg(F.sum("n").alias("n"))
    lists = groups.groupBy("lang").agg(F.sort_array(F.collect_list(F.struct("source", "n"))).alias("all"), F.count("*").alias("n_sources"))
    sizes = chunks.groupBy("lang").agg(F.sum(F.size("terms")).alias("n_terms"))
    lists = materialize(lists.join(sizes, "lang", "left").select("lang", F.col("all.source").alias("all_sources"), F.col("all.n").alias("all_totals"), F.coalesce("n_terms", F.lit(0).cast("long")).alias("n_terms"), "n_sources"))
    n_groups = lists.agg(F.coalesce(F.sum("n_sources"), F.lit(0))).first()[0]
    known = join_few(chunks, lists.drop("n_sources"), "lang", "terms", size=n_groups)
    bare = lists.where("n_terms = 0").drop("n_sources").withColumns({"terms": F.array().cast("array<binary>"), "sources": F.array().cast("array<string>"), "counts": F.lit(b"")})
    columns = ["lang", "terms", "sources", "counts", "all_sources", "all_totals", "n_terms"]
    found = known.select(*columns).unionByName(bare.select(*columns)).mapInArrow(_compared, "part string, lang string, source string, item binary, value long")
    found = materialize(found)
    half = found.where("part = 'pair'").groupBy("lang", "source", F.col("item").cast("string").alias("item")).agg(F.sum("value").alias("value"))
    pairs = half.select("lang", "source", "item", "value").union(half.select("lang", "item", "source", "value"))
    by_value = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    pairs = pairs.select("lang", "source", F.lit("pair").alias("part"), "item", "value", F.row_number().over(by_value).alias("rank"))
    best = found.where("part = 'term'").select("lang", "source", "part", F.col("item").cast("string").alias("item"), "value")
    return pairs.unionByName(best.withColumn("rank", F.row_number().over(by_value)).where(F.col("rank") <= TOP_TERMS))
