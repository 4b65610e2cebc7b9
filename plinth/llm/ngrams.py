"""N-gram Jaccard join by vertical partitioning: which documents share enough word shingles, as components.

The global order of the shingles is that of their 56-bit hashes, and equal ranges of it are the fragments. No task ever
holds more than one fragment of a set:

1. Each fragment counts, per document, its shingles that another document has as well; the sums per document tell who
   can have a partner at all, for a partner at a Jaccard similarity t holds a t share of either set.
2. Those documents are classed by equal sets. Of each class, one representative goes on; its rarest (1 - t) share of
   shingles, by their counts among representatives, are its postings. Two sets at similarity t share a posting.
3. Candidate pairs are counted fragment by fragment (each fragment's overlap by itself) and summed per pair; the sums
   decide exactly.

Postings with many members would give all their pairs. Components need only some: each member is tested against a
hub of its postings, and what links merges. Members that are still apart are compared by what they differ in from a
common reference: undecided pairs share some of that, so its rarest part gives new, small postings. Only of these are
pairs listed, once few enough meet (or a further turn doesn't halve them), so no link between components is lost,
whatever the size of a posting.

Defined results: null and empty texts have the empty set, link with nothing and are components of their own; a text of
fewer words than the shingle width has one shingle, the whole sequence; very long texts count whole, in more
fragments; a similarity of just the percentage links; rows without an id give no row; rows that repeat an id count as
one document, that of the least text; an empty table gives an empty result; other columns, whatever their names, pass
``one_of_each`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from plinth.llm.common import BROADCAST_ROWS, byte_size, join_few, materialize, one_per_id, text_chunks
from plinth.llm.components import components
from plinth.sources.shared import discard

WIDTH = 5
#: Similarity, in hundredths.
PERCENT = 75
#: Bytes of text for each fragment of the first count; shingles of one set in a fragment while pairs are counted.
FRAGMENT_BYTES = 8 << 20
FRAGMENT_TOKENS = 1 << 15
CHUNK_BYTES = 1 << 18
FLUSH = 400_000
HASH_BITS = 56
#: Pairs of one set that are counted in one place.
LOT_PAIRS = 512
#: Meetings of two members in postings of what they differ in, for each row of the first postings, up to which their
#: pairs are listed; few of them are pairs.
MEETINGS = 2
#: Words of 64 bits that sum up what a member differs in.
MASKS = 4
#: Rows of a partition of small tables.
PART_ROWS = 100_000
#: A row of pairs, or of hubs, counts as so many of those that ``BROADCAST_ROWS`` bounds: the driver holds what it sends.
WIDE = 4
#: Of a member of a posting of differences: the reference, f, how many of its tokens may be shared, the place of this one
#: among them, the masks.
_FILTER = ["ref", "f", "s", "i", *[f"m{i}" for i in range(MASKS)]]

U = np.uint64
_rng = np.random.default_rng(20240501)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BASE, _WORD_BASE, _MIX = U(0x9E3779B97F4A7C15), U(0xD6E8FEB86659FD93), U(0xFF51AFD7ED558CCD)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False
_powers: list[np.ndarray] = []


def _power_tables(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse, for texts of up to n bytes."""
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        _powers[:] = [np.concatenate([np.ones(1, U), np.cumprod(np.full(size, x, U), dtype=U)]) for x in (_BASE, _INVERSE)]
    return _powers


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mix of 64-bit values."""
    x = x ^ (x >> U(33))
    x *= _MIX
    return x ^ (x >> U(29))


def shingles(raw: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """(text index, hash) of the distinct shingles of each of up to 256 texts, sorted by both."""
    n, none = len(raw), (np.zeros(0, np.int64), np.zeros(0, U))
    if not n:
        return none
    letters = _LOWER[raw]
    is_word = _IS_WORD[raw]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = is_word[:-1], is_word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    if not len(starts):
        return none
    power, inverse = _power_tables(n)
    sums = np.zeros(n + 1, U)
    np.cumsum(_LETTER[letters] * power[:n], out=sums[1:])
    words = mix((sums[ends] - sums[starts]) * inverse[starts])
    text = np.searchsorted(offsets, starts, "right") - 1
    hashes, owners = [], []
    if len(words) >= width:
        last = len(words) - width + 1
        h = words[:last].copy()
        for i in range(1, width):
            h *= _WORD_BASE
            h += words[i : last + i]
        whole = text[:last] == text[width - 1 :]
        hashes.append(h[whole])
        owners.append(text[:last][whole])
    count = np.bincount(text, minlength=len(offsets) - 1)
    first = np.cumsum(count) - count
    for k in range(1, width):  # texts of k words only
        few = np.flatnonzero(count == k)
        if len(few):
            h = np.full(len(few), U(k))
            for i in range(k):
                h = h * _WORD_BASE + words[first[few] + i]
            hashes.append(h)
            owners.append(few)
    keys = (np.concatenate(owners).astype(U) << U(HASH_BITS)) | (mix(np.concatenate(hashes)) >> U(64 - HASH_BITS))
    keys.sort()
    keys = keys[np.concatenate([[True], keys[1:] != keys[:-1]])]
    return (keys >> U(HASH_BITS)).astype(np.int64), keys & U((1 << HASH_BITS) - 1)


def sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, text index, hash) of chunks of texts."""
    for batch in batches:
        for ids, raw, offsets in text_chunks(batch.column(0), batch.column(1), CHUNK_BYTES):
            yield (ids, *shingles(raw, offsets, width))


def set_facts(n_texts: int, owner: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Per text its set's size and two 64-bit sums, by which equal sets are known; zeros for an empty set."""
    n = np.bincount(owner, minlength=n_texts)
    facts = np.zeros((n_texts, 3), np.int64)
    facts[:, 0] = n
    if len(h):
        full = np.flatnonzero(n)
        at = (np.cumsum(n) - n)[full]
        for k, salt in ((1, U(0x2545F4914F6CDD1D)), (2, U(0x8CB92BA72F3D8DD7))):
            facts[full, k] = np.add.reduceat(mix(h * salt + U(k)), at).view(np.int64)
    return facts


FIRST = pa.schema([("fragment", pa.int32()), ("docs", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary()), ("sets", pa.binary())])


def _fragments(bits: int, width: int):
    """Task of the first count's map side: rows of one fragment each, with 32 bits of each hash, and of set facts."""

    def flush(ids: list, text: list, token: list, facts_of: list) -> Iterator[pa.RecordBatch]:
        docs, owner, h = np.concatenate(ids), np.concatenate(text), np.concatenate(token)
        fragment = (h >> U(HASH_BITS - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        low = ((h >> U(HASH_BITS - bits - 32)) & U(0xFFFFFFFF)).astype(np.uint32)
        order = np.argsort(fragment, kind="stable")
        fragment, owner, low = fragment[order], owner[order], low[order]
        cuts = np.flatnonzero(np.concatenate([[True], fragment[1:] != fragment[:-1]])) if len(fragment) else np.zeros(0, int)
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(fragment)] if len(cuts) else [], strict=True):
            own = owner[a:b]
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            rows.append((int(fragment[a]), docs[own[edge]].tobytes(), np.diff([*edge, b - a]).astype(np.uint32).tobytes(), low[a:b].tobytes(), None))
        facts = np.concatenate(facts_of)
        lot = (facts[0, 0] if len(facts) else 0) % (1 << bits)
        rows.append((int(lot), docs.tobytes(), None, None, facts.tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), FIRST.types, strict=True)], schema=FIRST)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, text, token, facts_of, held, docs = [], [], [], [], 0, 0
        for some, owner, h in sets(batches, width):
            facts = set_facts(len(some), owner, h)
            ids.append(some.astype(np.int64))
            text.append(owner + docs)
            token.append(h)
            facts_of.append(facts)
            held, docs = held + len(h), docs + len(some)
            if held >= FLUSH:
                yield from flush(ids, text, token, facts_of)
                ids, text, token, facts_of, held, docs = [], [], [], [], 0, 0
        if docs:
            yield from flush(ids, text, token, facts_of)

    return work


FACTS = "doc_id long, n long, set1 long, set2 long, shared long"
FACTS_ARROW = pa.schema([(x.split()[0], pa.int64()) for x in FACTS.split(", ")])


def _shared(rows: pa.Table) -> pa.Table:
    """Reduce side of the first count, for one fragment: per document, its shingles that stand in more than one set."""
    out = []
    docs, counts, tokens = [], [], []
    for d, c, t, s in zip(*(rows.column(x).to_pylist() for x in ("docs", "counts", "tokens", "sets")), strict=True):
        ids = np.frombuffer(d, np.int64)
        if s is not None:
            facts = np.frombuffer(s, np.int64).reshape(-1, 3)
            out.append(pa.Table.from_arrays([pa.array(ids), *(pa.array(facts[:, i]) for i in range(3)), pa.nulls(len(ids), pa.int64())], schema=FACTS_ARROW))
        else:
            docs.append(ids)
            counts.append(np.frombuffer(c, np.uint32))
            tokens.append(np.frombuffer(t, np.uint32))
    if docs:
        ids = np.concatenate(docs)
        keys = (np.concatenate(tokens).astype(U) << U(32)) | np.repeat(np.arange(len(ids), dtype=U), np.concatenate(counts))
        keys.sort()
        same = (keys[1:] >> U(32)) == (keys[:-1] >> U(32))
        often = np.zeros(len(keys), bool)
        often[1:] |= same
        often[:-1] |= same
        n = np.bincount((keys[often] & U(0xFFFFFFFF)).astype(np.int64), minlength=len(ids))
        some = np.flatnonzero(n)
        out.append(pa.Table.from_arrays([pa.array(ids[some]), *[pa.nulls(len(some), pa.int64())] * 3, pa.array(n[some])], schema=FACTS_ARROW))
    return pa.concat_tables(out)


def _segments(width: int, bits: int):
    """Task that gives each set as rows of pair fragments: (doc_id, n, fragment, tokens)."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, owner, h in sets(batches, width):
            if not len(h):
                continue
            n = np.bincount(owner, minlength=len(ids))
            part = (owner << bits) | (h >> U(HASH_BITS - bits)).astype(np.int64)  # sorted, as (owner, hash) are
            at = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
            own = part[at] >> bits
            lists = pa.ListArray.from_arrays(pa.array([*at, len(h)], pa.int32()), pa.array(h.astype(np.int64)))
            yield pa.RecordBatch.from_arrays([pa.array(ids[own].astype(np.int64)), pa.array(n[own]), pa.array((part[at] & ((1 << bits) - 1)).astype(np.int32)), lists], names=["doc_id", "n", "fragment", "tokens"])

    return work


def _near(a: Column, b: Column, percent: int) -> Column:
    """Whether sets of these sizes can be so similar."""
    return 100 * F.least(a, b) >= percent * F.greatest(a, b)


def _of(segments: DataFrame, pairs: DataFrame, key: str) -> DataFrame:
    """The segments of the sets in a column of ``pairs``, so that no others move."""
    ids = pairs.select(F.col(key).alias("doc_id")).distinct()
    return segments.join(F.broadcast(ids) if ids.count() <= BROADCAST_ROWS else ids, "doc_id", "left_semi")


def _in_lots(pairs: DataFrame) -> DataFrame:
    """``pairs`` (materialised) with ``lots``, one for each ``LOT_PAIRS`` pairs of set b, and ``lot``, the pair's."""
    lots = materialize(pairs.groupBy("b").agg(F.ceil(F.count("*") / LOT_PAIRS).cast("int").alias("lots")))
    return join_few(pairs, lots, "b", "a").withColumn("lot", F.pmod(F.xxhash64("a"), F.col("lots")).cast("int"))


def _with_counterpart(sides: DataFrame, pairs: DataFrame, segments: DataFrame, how: str) -> DataFrame:
    """``sides`` (b, lot, fragment and more) with ``its``, the tokens of set b in the fragment; ``pairs`` come from ``_in_lots``.

    A hub or reference stands in as many pairs as its posting has members; its tokens go to each of its lots.
    """
    where = pairs.select("b", "lots").distinct().select(F.col("b").alias("doc_id"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("lot"))
    its = _of(segments, pairs, "b").join(where, "doc_id").select(F.col("doc_id").alias("b"), "lot", "fragment", F.col("tokens").alias("its"))
    return sides.join(its, ["b", "lot", "fragment"], how)


def overlaps(pairs: DataFrame, segments: DataFrame) -> DataFrame:
    """(a, b, n_a, n_b, k) of pairs (a, b, n_b): the shingles that both sets hold, counted per fragment and summed."""
    pairs = materialize(_in_lots(materialize(pairs)))
    own = _of(segments, pairs, "a").select(F.col("doc_id").alias("a"), F.col("n").alias("n_a"), "fragment", F.col("tokens").alias("own"))
    sides = own.join(F.broadcast(pairs) if WIDE * pairs.count() <= BROADCAST_ROWS else pairs, "a")
    partial = _with_counterpart(sides, pairs, segments, "inner").select("a", "b", "n_a", "n_b", F.size(F.array_intersect("own", "its")).alias("k"))
    return partial.groupBy("a", "b", "n_a", "n_b").agg(F.sum("k").alias("k"))


def _links(counted: DataFrame, percent: int) -> DataFrame:
    """The pairs whose Jaccard similarity reaches the percentage, as edges (u, v)."""
    return counted.where(100 * F.col("k") >= percent * (F.col("n_a") + F.col("n_b") - F.col("k"))).select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))


def _pairs(met: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b, n_b) of members that met, if their sizes, and what they can differ in alike, let them be similar."""
    # a bit that one set's tokens have and the other's lack stands for a token at least that isn't shared
    own = lambda x, y: F.col(f"{x}_s") - reduce(Column.__add__, [F.bit_count(F.col(f"{x}_m{i}").bitwiseAND(F.bitwise_not(f"{y}_m{i}"))) for i in range(MASKS)])
    # tokens before the first one that both have aren't shared; a pair that links passes there, wherever else it meets
    left = F.least(F.col("a_s") - F.col("a_i"), F.col("b_s") - F.col("b_i")) + 1
    alike = 2 * (100 + percent) * F.least(own("a", "b"), own("b", "a"), left) >= F.col("a_f") + F.col("b_f")
    met = met.where(_near(F.col("a_n"), F.col("b_n"), percent) & F.coalesce(alike, F.lit(True)))
    return met.select("a", "b", F.col("b_n").alias("n_b")).distinct()


def _small(df: DataFrame, rows: int) -> DataFrame:
    """``df``, of about so many rows at most, written in few files."""
    return materialize(df.coalesce(rows // PART_ROWS + 1))


def _open(postings: DataFrame, stars: DataFrame, rows: int) -> tuple[DataFrame, int, int]:
    """The postings whose members stand in several components, with ``root`` and the ``main`` one; their rows; their pairs at most.

    Of a reference's postings with the same members, known by two 64-bit sums, the first one in the order of its tokens
    stays: the others give the same pairs.
    """
    at = postings.join(stars.select(F.col("u").alias("doc_id"), F.col("v").alias("root")), "doc_id", "left").withColumn("root", F.coalesce("root", "doc_id"))
    # sums over (token, root) come first and keep large postings apart
    alike = [F.bit_xor(F.xxhash64("doc_id", "ref", F.lit(i))).alias(f"x{i}") for i in range(2)]
    sums = at.groupBy("token", "root").agg(F.count("*").alias("c"), F.sum("i").alias("i"), *alike)
    sums = sums.groupBy("token").agg(F.max_by("root", F.struct("c", "root")).alias("main"), F.sum("c").alias("m"), F.max("c").alias("top"), F.coalesce(F.sum("i"), F.lit(0)).alias("i"), F.bit_xor("x0").alias("x0"), F.bit_xor("x1").alias("x1")).where("top < m")
    sums = sums.groupBy("m", "x0", "x1").agg(F.min_by("token", "i").alias("token"), *[F.min(c).alias(c) for c in ("main", "top")])
    sums = _small(sums, rows)
    open_ = _small(join_few(at, sums.select("token", "main"), "token", "doc_id"), rows)
    left, work = sums.agg(F.coalesce(F.sum("m"), F.lit(0)), F.coalesce(F.sum(F.col("m") * (F.col("m") - F.col("top"))), F.lit(0))).first()
    return open_, left, work


def _by_differences(open_: DataFrame, segments: DataFrame, stars: DataFrame, percent: int, fragments: int, rows: int) -> tuple[DataFrame, DataFrame]:
    """(postings, stars): all pairs of ``open_`` that may still link, as members of new postings.

    Each posting takes a reference P from its main component. Members x and y link if 2 (100 + t) |Dx & Dy| >= f(x) + f(y),
    where D is what a set differs in from P, d its size, n the set's and f = (100 + t) d - (100 - t) n. The right side is
    over 0 once x isn't linked with P, and of an undecided pair one member isn't. So such pairs share what they differ
    in, and meet in the rarest part of it: size of D - need + 1 of its tokens.
    """
    refs = open_.where("root = main").groupBy("token").agg(F.min(F.struct(F.xxhash64("doc_id"), "doc_id")).alias("r"))
    refs = _small(refs.select("token", F.col("r.doc_id").alias("b")), rows)
    compared = _small(join_few(open_.select("token", F.col("doc_id").alias("a"), "n"), refs, "token", "a").where("a <> b").select("a", "n", "b").distinct(), rows)
    compared = _small(_in_lots(compared), rows)
    pairs = compared.select("*", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))).alias("fragment"))
    own = _of(segments, compared, "a").select(F.col("doc_id").alias("a"), "fragment", F.col("tokens").alias("own"))
    none = F.array().cast("array<long>")
    sides = _with_counterpart(pairs.join(own, ["a", "fragment"], "left"), compared, segments, "left").withColumns({"own": F.coalesce("own", none), "its": F.coalesce("its", none)})
    differ = materialize(sides.select(F.col("b").alias("ref"), F.col("a").alias("doc_id"), "n", F.size("its").alias("m"), F.concat(F.array_except("own", "its"), F.array_except("its", "own")).alias("tokens")))
    sums = differ.groupBy("ref", "doc_id", "n").agg(F.sum("m").alias("m"), F.sum(F.size("tokens")).cast("long").alias("d"))
    linked = sums.where((100 + percent) * F.col("d") <= (100 - percent) * (F.col("n") + F.col("m"))).select(F.greatest("ref", "doc_id").alias("u"), F.least("ref", "doc_id").alias("v"))
    stars = components(stars.unionByName(linked))
    roots = lambda key, name: stars.select(F.col("u").alias(key), F.col("v").alias(name))
    members = sums.join(roots("doc_id", "root"), "doc_id", "left").join(roots("ref", "main"), "ref", "left")
    members = members.select("ref", "doc_id", "n", ((100 + percent) * F.col("d") - (100 - percent) * F.col("n")).alias("f"), (F.coalesce("root", "doc_id") != F.coalesce("main", "ref")).alias("apart"))
    listed = _small(members, rows)
    least = _small(listed.groupBy("ref").agg(F.min("f").alias("f_all"), F.min(F.when(F.col("apart"), F.col("f"))).alias("f_apart")).where("f_apart IS NOT NULL"), rows)
    members = join_few(listed, least, "ref", "doc_id")
    need = F.ceil((F.col("f") + F.when(F.col("apart"), F.col("f_all")).otherwise(F.col("f_apart"))) / (2 * (100 + percent)))
    members = members.select("ref", "doc_id", "n", "f", "apart", F.greatest(need, F.lit(1)).alias("need"))
    tokens = materialize(differ.select("ref", "doc_id", F.explode("tokens").alias("token")).join(members, ["ref", "doc_id"]))
    often = tokens.groupBy("ref", "token").agg(F.count("*").alias("df"), F.max("apart").alias("any")).where("df > 1 AND any").select("ref", "token", "df")
    own = Window.partitionBy("ref", "doc_id")
    bits = [F.bit_or(F.expr(f"CASE WHEN (token >> 6) % {MASKS} = {i} THEN shiftleft(1L, CAST(token & 63 AS INT)) ELSE 0L END")).over(own).alias(f"m{i}") for i in range(MASKS)]
    ranked = tokens.join(often, ["ref", "token"]).select("ref", "doc_id", "n", "f", "need", "token", F.count("*").over(own).alias("s"), *bits, F.row_number().over(own.orderBy("df", "token")).cast("long").alias("i"))
    postings = materialize(ranked.where("i <= s - need + 1").select(F.xxhash64("ref", "token").alias("token"), "doc_id", "n", *_FILTER))
    for step in (refs, compared, differ, listed, least, tokens):
        discard(step)
    return postings, stars


def _link_components(postings: DataFrame, segments: DataFrame, percent: int, fragments: int, meetings: int = MEETINGS) -> DataFrame:
    """(u, v) as ``components`` gives them, of all links between the members of postings (token, doc_id, n).

    Members meet a hub of each posting, and those that are left go to postings of what they differ in, at every size
    and again while these still give many meetings and a turn halves them. Then their pairs are listed.
    """
    stars = postings.select(F.col("doc_id").alias("u"), F.col("doc_id").alias("v")).limit(0)
    postings = postings.withColumns({c: F.lit(None).cast("long") for c in _FILTER})
    side = lambda x: [F.col(c).alias(f"{x}_{c}") for c in ("n", *_FILTER, "root")]
    rows, turn, floor = postings.count(), 0, None
    while True:
        open_, left, work = _open(postings, stars, rows)
        if not left:
            return stars
        a = open_.select("token", F.col("doc_id").alias("a"), *side("a"), "main")
        if floor is not None and (work <= rows * meetings or 2 * work >= floor):  # every pair of members in different components
            b = open_.where("root <> main").select("token", F.col("doc_id").alias("b"), *side("b"))
            met = a.join(b, "token").where((F.col("a_root") == F.col("main")) | (F.col("a_root") < F.col("b_root")))
            return components(stars.unionByName(_links(overlaps(_pairs(met, percent), segments), percent)))
        if turn % 2 == 0:
            # each member with a hub, the same for postings that share their members
            lot = F.xxhash64("doc_id", F.pmod("token", F.lit(2)), F.lit(turn))
            hubs = open_.groupBy("token").agg(F.min(F.struct(lot, "doc_id", "n", *_FILTER, "root")).alias("h"))
            hubs = _small(hubs.select("token", "h.*").select("token", F.col("doc_id").alias("b"), *side("b")), left)
            met = _small(join_few(a, hubs, "token", "a", size=WIDE * hubs.count()).where("a <> b"), left)
            stars = components(stars.unionByName(_links(overlaps(_pairs(met.where("a_root <> b_root"), percent), segments), percent)))
            postings = met.select("token", F.col("a").alias("doc_id"), *[F.col(f"a_{c}").alias(c) for c in ("n", *_FILTER)])
            discard(hubs)
        else:
            postings, stars = _by_differences(open_, segments, stars, percent, fragments, left)
            floor = work
        discard(open_)
        turn += 1


def _sets_of(texts: DataFrame, reps: DataFrame, n_reps: int, longest: int, width: int) -> tuple[DataFrame, int]:
    """The sets of the documents ``reps`` (doc_id) in pair fragments, and the number of these."""
    chosen = texts.join(F.broadcast(reps) if n_reps <= BROADCAST_ROWS else reps, "doc_id", "left_semi")
    bits = max(2, int(np.ceil(np.log2(max(1, longest / FRAGMENT_TOKENS)))))
    return materialize(chosen.mapInArrow(_segments(width, bits), "doc_id long, n long, fragment int, tokens array<long>")), 1 << bits


def linked(texts: DataFrame, postings: DataFrame, percent: int, width: int, meetings: int = MEETINGS) -> DataFrame:
    """(u, v) as ``components`` gives them, of all links between texts (doc_id, text) that share a posting (token, doc_id, n).

    ``postings`` is materialised; links are decided on full sets. ``meetings``: as ``MEETINGS``.
    """
    members = materialize(postings.select("doc_id", "n").distinct())
    n_members, longest = members.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    segments, fragments = _sets_of(texts, members.select("doc_id"), n_members, longest, width)
    return _link_components(postings, segments, percent, fragments, meetings)


def jaccard_components(docs: DataFrame, key: str = "doc_id", text: str = "text", percent: int = PERCENT, width: int = WIDTH) -> DataFrame:
    """(doc_id, n_shingles, component_id) per document; the component's id is its least document id."""
    texts = docs.select(docs[key].cast("long").alias("doc_id"), docs[text].alias("text")).where("doc_id IS NOT NULL")
    texts = one_per_id(texts, "doc_id", "text")
    bits = max(6, int(np.ceil(np.log2(max(1, byte_size(texts, "text") / FRAGMENT_BYTES)))))
    schema = "fragment int, docs binary, counts binary, tokens binary, sets binary"
    counted = texts.mapInArrow(_fragments(bits, width), schema).groupBy("fragment").applyInArrow(_shared, FACTS)
    facts = materialize(counted.groupBy("doc_id").agg(*[F.max(x).alias(x) for x in ("n", "set1", "set2")], F.sum("shared").alias("shared")))
    linked = facts.where((F.col("n") > 0) & (100 * F.col("shared") >= percent * F.col("n")))
    classes = materialize(linked.groupBy("set1", "set2", "n").agg(F.min("doc_id").alias("rep"), F.count("*").alias("size")))
    reps = classes.select(F.col("rep").alias("doc_id"))
    n_reps, longest = classes.agg(F.count("*"), F.coalesce(F.max("n"), F.lit(0))).first()
    segments, fragments = _sets_of(texts, reps, n_reps, longest, width)
    tokens = segments.select("doc_id", "n", F.explode("tokens").alias("token"))
    often = tokens.groupBy("token").agg(F.count("*").alias("df")).where("df > 1")
    least = F.ceil(F.col("n") * percent / 100)  # shingles that a partner must share
    own = Window.partitionBy("doc_id")
    ranked = tokens.join(often, "token").select("doc_id", "n", "token", F.count("*").over(own).alias("s"), F.row_number().over(own.orderBy("df", "token")).alias("i"))
    postings = materialize(ranked.where(F.col("i") <= F.col("s") - least + 1).select("token", "doc_id", "n"))
    stars = _link_components(postings, segments, percent, fragments)
    roots = classes.join(stars.withColumnRenamed("u", "rep"), "rep", "left").select(F.col("set1").alias("c1"), F.col("set2").alias("c2"), F.col("n").alias("cn"), F.coalesce("v", "rep").alias("root"))
    same = (F.col("set1") == F.col("c1")) & (F.col("set2") == F.col("c2")) & (F.col("n") == F.col("cn"))
    return facts.join(roots, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def one_of_each(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` whose id is the least of its component (and rows without an id), one of each id, all columns."""
    docs = one_per_id(docs, key, text)
    found = jaccard_components(docs, key, text)
    gone = found.where("component_id <> doc_id").select(F.col("doc_id").alias("_plinth_gone"))
    return docs.join(gone, docs[key].cast("long") == F.col("_plinth_gone"), "left_anti")
