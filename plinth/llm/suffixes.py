"""Suffix-array dedup: cut every byte of a long passage that also starts earlier in the corpus.

Any text of ``LENGTH`` bytes has one anchor: the leftmost of its ``ANCHOR``-byte substrings with the least hash. Equal
texts have equal anchors at equal offsets, so the corpus splits by anchor without losing a match:

1. A scan cuts each document into blocks: neighbouring windows of LENGTH bytes with one anchor. Only hashes leave it,
   in ranges of the anchors' hashes.
2. Per range, blocks that stand alone go. Equal blocks become one entry, the first, before any bytes move, or else a
   group of copies would meet in one task; later copies are cut whole. Entries that share an anchor and bytes beside it
   may hold equal windows.
3. The entries' bytes are gathered by anchor. A run-length index of each gathered text streams matching statistics and
   marks the windows that start earlier as well. An anchor with too many entries for one index is split by what its
   windows hold: windows whose anchor lies nearer to their front, or to their back, are equal only if their common
   bytes are, so each half of the offsets gives smaller groups, again until every group fits.
4. The marked windows of a document unite into spans, and what is left is joined up.

Defined results: null texts count as empty and keep nothing; texts under LENGTH bytes stay whole; very long texts are
scanned in overlapping pieces, whole; of equal places in equal documents the one with the smaller id is the first; rows
without an id give no row; rows that repeat an id are one document, that of the least text; an empty table gives an
empty result; other columns, whatever their names, pass ``drop_repeats`` unchanged.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import BROADCAST_ROWS, byte_size, join_few, materialize, one_per_id, text_chunks
from plinth.llm.run_index import RunIndex

LENGTH, ANCHOR = 100, 32
SPAN = LENGTH - ANCHOR + 1
#: Every window holds so many bytes on one side of its anchor at least.
SIDE = (LENGTH - ANCHOR) // 2
#: Entries of a group that one index takes; larger groups are split.
MOST = 2048
CHUNK_BYTES, PIECE_BYTES, FLUSH = 1 << 18, 1 << 20, 200_000
RANGE_BYTES = 8 << 20
INDEX_BYTES = 512 << 10
MARK = 6

U = np.uint64
_rng = np.random.default_rng(20240502)
_LETTER = _rng.integers(1, 1 << 63, 256, dtype=np.uint64) | U(1)
_BASE, _MIX = U(0xC2B2AE3D27D4EB4F), U(0x9FB21C651E98DF25)
_INVERSE = U(pow(int(_BASE), -1, 1 << 64))
_powers: list[np.ndarray] = []

BLOCK = np.dtype([("h", "<u8"), ("v", "<u8"), ("start", "<u4"), ("left", "<u2"), ("right", "<u2"), ("size", "u1"), ("offset", "u1")])


def _power_tables(n: int) -> list[np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        size = max(n, 2 * CHUNK_BYTES)
        _powers[:] = [np.concatenate([np.ones(1, U), np.cumprod(np.full(size, x, U), dtype=U)]) for x in (_BASE, _INVERSE)]
    return _powers


def _mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> U(31))
    x *= _MIX
    return x ^ (x >> U(28))


def blocks(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, BLOCK rows) of the blocks in texts that stand one after the other; ``start`` counts in the text."""
    n = len(raw)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, BLOCK)
    power, inverse = _power_tables(n + 1)
    sums = np.zeros(n + 1, U)
    np.cumsum(_LETTER[raw] * power[:n], out=sums[1:])
    of = lambda a, b: _mix((sums[b] - sums[a]) * inverse[a])
    h = _mix((sums[ANCHOR:] - sums[:-ANCHOR]) * inverse[: n - ANCHOR + 1])
    least = (h & ~U(0xFFFFFF)) | np.arange(len(h), dtype=U)  # by hash, then by place
    size = 1
    while 2 * size <= SPAN:
        least = np.minimum(least[:-size], least[size:])
        size *= 2
    if size < SPAN:
        least = np.minimum(least[: len(h) - SPAN + 1], least[SPAN - size :][: len(h) - SPAN + 1])
    place = (least & U(0xFFFFFF)).astype(np.int64)  # of the anchor of the window at each position
    whole = np.ones(len(place), bool)
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        whole[max(a, b - LENGTH + 1) : b] = False
    at = np.flatnonzero(whole)
    if not len(at):
        return np.zeros(0, np.int64), np.zeros(0, BLOCK)
    p = place[at]
    new = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1] + 1) | (p[1:] != p[:-1])]))
    first, last, p = at[new], at[np.append(new[1:], len(at)) - 1], p[new]
    end = last + LENGTH
    out = np.zeros(len(first), BLOCK)
    text = np.searchsorted(offsets, first, "right") - 1
    out["h"], out["v"] = h[p], of(first, end)
    out["start"], out["size"], out["offset"] = first - offsets[text], end - first, p - first
    a = np.flatnonzero(p - first >= SIDE)
    out["left"][a] = (of(p[a] - SIDE, p[a]) >> U(48)).astype(np.uint16) | np.uint16(1)
    b = np.flatnonzero(end - p >= ANCHOR + SIDE)
    out["right"][b] = (of(p[b] + ANCHOR, p[b] + ANCHOR + SIDE) >> U(48)).astype(np.uint16) | np.uint16(1)
    return text, out


def _pieces(ids: np.ndarray, raw: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """``blocks`` of a chunk, a very long text in overlapping pieces so that memory stays bounded."""
    if len(raw) <= PIECE_BYTES:
        yield blocks(raw, offsets)
        return
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):  # such a chunk has one text
        for at in range(a, max(a + 1, b - LENGTH + 1), PIECE_BYTES):
            text, found = blocks(raw[at : min(b, at + PIECE_BYTES + LENGTH - 1)], np.array([0, min(b, at + PIECE_BYTES + LENGTH - 1) - at]))
            found["start"] += np.uint32(at - a)
            yield text, found


def _scan(bits: int):
    """Map side: the blocks of all texts, packed by range of anchor hashes."""

    def flush(ids: list, text: list, found: list) -> Iterator[pa.RecordBatch]:
        docs, owner, block = np.concatenate(ids), np.concatenate(text), np.concatenate(found)
        # anchors are least hashes, so their upper bits are mostly zeros; mixed again, they spread
        part = (_mix(block["h"] * _BASE) >> U(64 - bits)).astype(np.uint16 if bits <= 16 else np.uint32)
        order = np.argsort(part, kind="stable")
        part, owner, block = part[order], owner[order], block[order]
        cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]])) if len(part) else np.zeros(0, int)
        rows = []
        for a, b in zip(cuts, [*cuts[1:], len(part)] if len(part) else [], strict=True):
            own = owner[a:b]
            edge = np.flatnonzero(np.concatenate([[True], own[1:] != own[:-1]]))
            rows.append((int(part[a]), docs[own[edge]].tobytes(), np.diff([*edge, b - a]).astype(np.uint32).tobytes(), block[a:b].tobytes()))
        if rows:
            p, d, c, x = zip(*rows, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(p, pa.int32()), pa.array(d, pa.binary()), pa.array(c, pa.binary()), pa.array(x, pa.binary())], names=["part", "docs", "counts", "blocks"])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, text, found, held, docs = [], [], [], 0, 0
        for batch in batches:
            for some, raw, offsets in text_chunks(batch.column(0), batch.column(1), CHUNK_BYTES):
                ids.append(some.astype(np.int64))
                for t, x in _pieces(some, raw, offsets):
                    text.append(t + docs)
                    found.append(x)
                    held += len(x)
                docs += len(some)
                if held >= FLUSH:
                    yield from flush(ids, text, found)
                    ids, text, found, held, docs = [], [], [], 0, 0
        if held:
            yield from flush(ids, text, found)

    return work


FOUND = "doc_id long, start long, size int, h long, offset int, asks boolean"


def _compare(rows: pa.Table) -> pa.Table:
    """Reduce side, for one range: blocks to cut (asks false), and blocks whose windows an index has to compare."""
    get = lambda name, kind: np.concatenate([np.frombuffer(x.as_buffer(), kind) for x in rows.column(name)])
    docs = np.repeat(get("docs", np.int64), get("counts", np.uint32))
    block = get("blocks", BLOCK)
    h = block["h"].copy()
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    often = np.zeros(len(h), bool)
    often[1:] |= same
    often[:-1] |= same
    keep = order[often]
    docs, block = docs[keep], block[keep]
    order = np.lexsort((block["start"], docs, block["v"], block["h"]))
    docs, block = docs[order], block[order]
    differ = lambda *names: np.concatenate([[True], np.any([block[x][1:] != block[x][:-1] for x in names], axis=0)]) if len(block) else np.zeros(0, bool)
    first = differ("h", "v")
    moved = np.concatenate([[True], (docs[1:] != docs[:-1]) | (block["start"][1:] != block["start"][:-1])]) if len(block) else first
    again = np.flatnonzero(~first & moved)
    ones = np.flatnonzero(first)
    group = np.cumsum(differ("h"))[ones]
    asks = np.zeros(len(ones), bool)
    for side in ("left", "right"):
        key = (group.astype(np.int64) << 16) | block[side][ones]
        _, where, n = np.unique(key, return_inverse=True, return_counts=True)
        asks |= (n[where] > 1) & (block[side][ones] > 0)
    ask = ones[asks]
    at = np.concatenate([again, ask])
    b = block[at]
    return pa.table([docs[at], b["start"].astype(np.int64), b["size"].astype(np.int32), b["h"].astype(U).view(np.int64), b["offset"].astype(np.int32), np.arange(len(at)) >= len(again)], names=["doc_id", "start", "size", "h", "offset", "asks"])


SPANS = "doc_id long, start long, size int"


def _index(rows: pa.Table) -> pa.Table:
    """Windows of the gathered blocks that start earlier too, as spans; blocks in the order of their places."""
    docs, start = rows.column("doc_id").to_numpy(), rows.column("start").to_numpy()
    order = np.lexsort((start, docs))
    docs, start = docs[order], start[order]
    texts = [rows.column("bytes")[int(i)].as_py() for i in order]
    parts = []
    for k, x in enumerate(texts):  # each block ends with a number of its own between marks that no UTF-8 has
        parts += [x, bytes((0xFF, *(1 + k // 100**d % 100 for d in (3, 2, 1, 0)), 0xFF))]
    text = np.frombuffer(b"".join(parts), np.uint8)
    size = np.array([len(x) for x in texts])
    base = np.cumsum(size + MARK) - size - MARK
    repeated = RunIndex(text, int(size.max()) + 8).repeated(LENGTH)
    own = np.repeat(np.arange(len(texts)), size + MARK)
    within = np.arange(len(text)) - base[own]
    marked = np.flatnonzero(repeated & (within <= size[own] - LENGTH))
    if not len(marked):
        return pa.table([pa.array([], pa.int64()), pa.array([], pa.int64()), pa.array([], pa.int32())], names=["doc_id", "start", "size"])
    new = np.flatnonzero(np.concatenate([[True], (marked[1:] != marked[:-1] + 1) | (own[marked[1:]] != own[marked[:-1]])]))
    a, z = marked[new], marked[np.append(new[1:], len(marked)) - 1]
    return pa.table([docs[own[a]], start[own[a]] + within[a], (z - a + LENGTH).astype(np.int32)], names=["doc_id", "start", "size"])


def _fetch(texts: DataFrame, asked: DataFrame) -> DataFrame:
    """``asked`` blocks with their bytes."""
    lists = asked.groupBy("doc_id").agg(F.collect_list(F.struct("start", "size", "h", "offset")).alias("asked"))
    raw = F.encode("text", "UTF-8")
    cut = F.transform("asked", lambda x: F.struct(x["start"].alias("start"), x["h"].alias("g"), x["offset"].alias("offset"), F.substring(F.col("raw"), (x["start"] + 1).cast("int"), x["size"]).alias("bytes")))
    found = _only(texts, lists.select("doc_id")).join(lists, "doc_id").withColumn("raw", raw)
    return found.select("doc_id", F.explode(cut).alias("x")).select("doc_id", "x.*")


def _only(texts: DataFrame, ids: DataFrame, how: str = "left_semi") -> DataFrame:
    """The texts with (or without) one of the ids, which are broadcast if they are few."""
    few = ids.count() <= BROADCAST_ROWS
    return texts.join(F.broadcast(ids) if few else ids, "doc_id", how)


def _halves(blocks_: DataFrame) -> DataFrame:
    """Blocks (g, low, high, doc_id, start, offset, bytes) as their windows of either half of the anchor offsets.

    A window's anchor offset is between ``low`` and ``high``. All windows of a half hold the bytes from its low offset
    before the anchor to what its high offset leaves behind it, so equal windows have one such hash.
    """
    half = F.explode(F.array(F.lit(0), F.lit(1))).alias("half")
    mid = F.floor((F.col("low") + F.col("high")) / 2).cast("int")
    halves = blocks_.withColumn("mid", mid).select("*", half).withColumns({"low": F.when(F.col("half") == 0, F.col("low")).otherwise(F.col("mid") + 1), "high": F.when(F.col("half") == 0, F.col("mid")).otherwise(F.col("high"))})
    first = F.greatest(F.col("low"), F.col("offset") - F.octet_length("bytes") + LENGTH)  # least and greatest offset of the block's own windows
    last = F.least("high", "offset")
    own = halves.withColumns({"first": first, "last": last}).where("first <= last")
    own = own.select("g", "low", "high", "doc_id", (F.col("start") + F.col("offset") - F.col("last")).alias("start"), F.col("last").alias("offset"), F.substring("bytes", F.col("offset") - F.col("last") + 1, F.col("last") - F.col("first") + LENGTH).alias("bytes"))
    common = F.substring("bytes", F.col("offset") - F.col("low") + 1, LENGTH - F.col("high") + F.col("low"))
    return own.withColumn("g", F.xxhash64("g", "low", common))


def _indexed(blocks_: DataFrame, most: int) -> DataFrame:
    """Spans of the windows in blocks (g, doc_id, start, offset, bytes) that start earlier in a block of the same ``g``."""
    parts = max(64, blocks_.agg(F.coalesce(F.sum(F.octet_length("bytes")), F.lit(0))).first()[0] // INDEX_BYTES)
    groups = blocks_.withColumns({"low": F.lit(0), "high": F.lit(SPAN - 1)})
    spans = []
    while True:
        per = groups.groupBy("g").agg(F.count("*").alias("c"))
        large = materialize(per.where(F.col("c") > most).select("g", F.lit(True).alias("large")))
        sized = join_few(groups, large, "g", "doc_id", "left") if large.count() else groups.withColumn("large", F.lit(None).cast("boolean"))
        small = sized.where("large IS NULL").select(F.pmod(F.xxhash64("g"), F.lit(parts)).alias("part"), "doc_id", "start", "bytes")
        spans.append(small.groupBy("part").applyInArrow(_index, SPANS))
        if not large.count():
            return reduce(DataFrame.unionByName, spans)
        halves = materialize(_halves(sized.where("large")))
        place = F.struct("doc_id", "start")
        entries = materialize(halves.groupBy("g", "low", "high", "offset", "bytes").agg(F.min(place).alias("first")))
        later = halves.join(entries.select("g", "bytes", "first"), ["g", "bytes"]).where(place != F.col("first"))
        spans.append(later.select("doc_id", "start", F.octet_length("bytes").alias("size")))
        shared = materialize(entries.groupBy("g").agg(F.count("*").alias("c")).where("c > 1").select("g"))
        groups = join_few(entries.select("g", "low", "high", "offset", "bytes", "first.*"), shared, "g", "doc_id")


def repeated_spans(texts: DataFrame, most: int = MOST) -> DataFrame:
    """(doc_id, start, size): overlapping spans of bytes to cut, from texts (doc_id, text)."""
    bits = max(6, int(np.ceil(np.log2(max(1, byte_size(texts, "text") / RANGE_BYTES)))))
    packed = texts.mapInArrow(_scan(bits), "part int, docs binary, counts binary, blocks binary")
    found = materialize(packed.groupBy("part").applyInArrow(_compare, FOUND))
    entries = materialize(_fetch(texts, found.where("asks")))
    return found.where("NOT asks").select("doc_id", "start", "size").unionByName(_indexed(entries, most))


def unite(spans: list[dict], size: int) -> list[list[int]]:
    """Overlapping and touching spans (start, size) as maximal [start, end] within ``size`` bytes, in order."""
    out: list[list[int]] = []
    for x in sorted(spans, key=lambda x: x["start"]):
        a, b = x["start"], min(x["start"] + x["size"], size)
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        elif a < b:
            out.append([a, b])
    return out


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        for at in range(0, batch.num_rows, 256):
            part = batch.slice(at, 256)
            sizes, spans, kept = [], [], []
            for raw, lists in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                united = unite(lists, len(raw))
                sizes.append(len(raw))
                spans.append([{"start": a, "end": b} for a, b in united])
                kept.append(b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in united)], [*(a for a, _ in united), len(raw)], strict=True)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


KEPT = "doc_id long, n_bytes long, spans array<struct<start:long,end:long>>, kept binary"


def cut_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text", most: int = MOST) -> DataFrame:
    """(doc_id, n_bytes, spans, kept): each document's size, the spans cut from it and the bytes that stay."""
    texts = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    texts = one_per_id(texts, "doc_id", "text")
    spans = materialize(repeated_spans(texts, most).groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("spans")))
    ids = spans.select("doc_id")
    raw = F.encode("text", "UTF-8")
    whole = _only(texts, ids, "left_anti").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), F.array().cast("array<struct<start:long,end:long>>").alias("spans"), raw.alias("kept"))
    cut = _only(texts, ids).join(spans, "doc_id").select("doc_id", raw.alias("raw"), "spans").mapInArrow(_cut, KEPT)
    return whole.unionByName(cut)


def drop_repeats(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with what ``cut_repeats`` cuts out of ``text``, and all other columns as they were.

    A text stays text: where a span ends within a character of several bytes, the whole character stays. Texts without
    spans (nulls and rows without an id among them) stay as they are.
    """
    docs = one_per_id(docs, key, text)
    texts = docs.select(docs[key].cast("long").alias("doc_id"), F.coalesce(docs[text], F.lit("")).alias("text")).where("doc_id IS NOT NULL")
    spans = materialize(repeated_spans(texts).groupBy("doc_id").agg(F.collect_list(F.struct("start", "size")).alias("spans")))
    few = spans.count() <= BROADCAST_ROWS
    ids = spans.select(F.col("doc_id").alias("_plinth_id"))
    ids = F.broadcast(ids) if few else ids
    on = docs[key].cast("long") == F.col("_plinth_id")
    names = docs.columns
    found = docs.join(ids, on, "left_semi").join(spans.select(F.col("doc_id").alias("_plinth_id"), F.col("spans").alias("_plinth_spans")), on)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = names.index(text)
        for batch in batches:
            for first in range(0, batch.num_rows, 256):
                part = batch.slice(first, 256)
                texts = [kept_text(x.encode(), s) for x, s in zip(part.column(at).to_pylist(), part.column(len(names)).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if i == at else part.column(i) for i in range(len(names))], names=names)

    return docs.join(ids, on, "left_anti").unionByName(found.select(*[docs[c] for c in names], "_plinth_spans").mapInArrow(cut, docs.schema))


def kept_text(raw: bytes, spans: list[dict]) -> str:
    """What spans leave of a UTF-8 text; a character that a span doesn't cover whole stays."""
    united = unite(spans, len(raw))
    for x in united:
        while x[0] < x[1] and raw[x[0]] & 0xC0 == 0x80:  # begins within a character
            x[0] += 1
        while x[1] < len(raw) and x[0] < x[1] and raw[x[1]] & 0xC0 == 0x80:  # ends within one
            x[1] -= 1
    return b"".join(raw[a:b] for a, b in zip([0, *(b for _, b in united)], [*(a for a, _ in united), len(raw)], strict=True)).decode()
