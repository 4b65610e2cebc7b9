"""Helpers that several operators share: materialised steps, bounded text chunks and word splitting."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plinth.sources.shared import materialize

__all__ = ["materialize"]

#: Words are runs of anything but these six white-space characters.
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
WHITE_SPACE = " \t\n\v\f\r"
#: Texts of a chunk at most.
CHUNK_TEXTS = 256
#: Rows of one or two numbers are broadcast up to this count (some 10 MB); more of them are joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Lots of a hot key.
SALT = 16


def join_few(rows: DataFrame, few: DataFrame, key: str, spread: str, how: str = "inner", size: int | None = None) -> DataFrame:
    """``rows`` with the columns of ``few`` (materialised, one row a ``key``), hot keys not in one task.

    ``few`` is broadcast up to ``BROADCAST_ROWS`` rows (or a ``size`` in such rows, where its own are longer); beyond it
    goes to ``SALT`` lots, and rows to one by ``spread``.
    """
    if (few.count() if size is None else size) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(few), key, how)
    lot = F.pmod(F.xxhash64(spread), F.lit(SALT)).cast("int")
    copies = few.withColumn("_lot", F.explode(F.sequence(F.lit(0), F.lit(SALT - 1))))
    return rows.withColumn("_lot", lot).join(copies, [key, "_lot"], how).drop("_lot")


def one_per_id(docs: DataFrame, key: str, text: str) -> DataFrame:
    """``docs`` with one row of each repeated id, that of the least text (nulls last); rows without an id all stay.

    Only ids are counted at first; texts move only where ids repeat.
    """
    ids = docs.select(docs[key].cast("long").alias("_plinth_id"))
    repeated = materialize(ids.where("_plinth_id IS NOT NULL").groupBy("_plinth_id").count().where("count > 1").select("_plinth_id"))
    n = repeated.count()
    if not n:
        return docs
    repeated = F.broadcast(repeated) if n <= BROADCAST_ROWS else repeated
    at = docs[key].cast("long") == F.col("_plinth_id")
    rows = docs.join(repeated, at, "left_semi").select(docs[key].cast("long").alias("_plinth_id"), F.struct(*[docs[c] for c in docs.columns]).alias("_plinth_row"))
    least = F.struct(F.col(f"_plinth_row.`{text}`").isNull(), F.col(f"_plinth_row.`{text}`"), F.to_json("_plinth_row"))
    rows = rows.groupBy("_plinth_id").agg(F.min_by("_plinth_row", least).alias("_plinth_row"))
    return docs.join(repeated, at, "left_anti").unionByName(rows.select(*[F.col(f"_plinth_row.`{c}`").alias(c) for c in docs.columns]))


def byte_size(df: DataFrame, column: str) -> int:
    """UTF-8 bytes in a text column, over all rows."""
    return df.agg(F.coalesce(F.sum(F.octet_length(column)), F.lit(0))).first()[0]


def text_chunks(ids: pa.Array, texts: pa.Array, max_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Cut one Arrow batch into chunks of whole texts with about ``max_bytes`` bytes each.

    Yields (ids, text bytes as one uint8 array, offsets of the texts in it). A text over ``max_bytes`` makes a chunk
    of its own; null texts count as empty.
    """
    if len(texts) > CHUNK_TEXTS:
        for at in range(0, len(texts), CHUNK_TEXTS):
            yield from text_chunks(ids.slice(at, CHUNK_TEXTS), texts.slice(at, CHUNK_TEXTS), max_bytes)
        return
    data = pc.cast(pc.fill_null(texts, ""), pa.large_binary())
    offsets = np.frombuffer(data.buffers()[1], np.int64)[data.offset : data.offset + len(data) + 1]
    raw = np.frombuffer(data.buffers()[2], np.uint8) if data.buffers()[2] is not None else np.zeros(0, np.uint8)
    ids = ids.to_numpy(zero_copy_only=False)
    first = 0
    while first < len(data):
        last = max(first + 1, int(np.searchsorted(offsets, offsets[first] + max_bytes, "right")) - 1)
        last = min(last, len(data))
        yield ids[first:last], raw[offsets[first] : offsets[last]], offsets[first : last + 1] - offsets[first]
        first = last


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z only."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


PA_TYPES = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "double": pa.float64(), "boolean": pa.bool_()}


def map_texts(docs: DataFrame, keys: list[str], text: str, columns: dict[str, str], prepare: Callable[[], Callable[[str | None], tuple]], step: int = 256) -> DataFrame:
    """``keys`` and, for each text, the ``columns`` (name -> type) that a function of the text returns.

    ``prepare`` runs once per task and returns that function. Keys stay Arrow arrays, so long ids and nulls pass
    unharmed; ``step`` texts at a time are Python objects.
    """
    arrow = [(n, PA_TYPES[t]) for n, t in columns.items()]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = prepare()
        for batch in batches:
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                rows = [of(x) for x in part.column(len(keys)).to_pylist()]
                made = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays(part.columns[: len(keys)] + [pa.array(v, t) for v, (_, t) in zip(made, arrow, strict=True)], names=[*keys, *columns])

    kinds = dict(docs.dtypes)
    schema = ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), *(f"`{n}` {t}" for n, t in columns.items())])
    return docs.select(*[docs[k] for k in keys], docs[text].alias("_plinth_text")).mapInArrow(work, schema)
