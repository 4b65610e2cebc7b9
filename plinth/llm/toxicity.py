"""Toxicity by compression distance: which of two trained zstandard dictionaries shortens a text's windows more.

zstandard's trainer makes one dictionary from toxic and one from ordinary labelled texts, of one size. As samples it gets
the stretches of each text whose every ``GRAM`` bytes are strange to all other texts, of as many texts of either kind: trained on whole texts,
both would hold what the kinds have in common, and windows would differ by chance. What they do have in common, the
commonest ordinary words, begins both dictionaries alike. A window of eight words is compressed with both; sums of what
the toxic one saves are measured. A logistic curve over these, fitted on labelled texts that the dictionaries of a fold
haven't seen, calibrates the score, so 0.7 means that seven in ten such texts are labelled toxic.

The fit reads a bounded sample: at most ``TOXIC`` and ``ORDINARY`` labelled texts of up to ``LONGEST`` bytes, by the
hash of their ids. Scores cover all of every text.

Defined results: null and empty texts have no windows and get the curve's score for no saving; very long texts are
scored whole, by all of their windows; repeated rows get the same score; an empty table has no scores; without labelled
texts of both kinds every score is 0; labels whose value is null are left out, and of an id with both labels the toxic
one counts; a score of just 0.7 predicts 1; only the key and the text are read, whatever other columns are called.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plinth.llm.common import text_chunks

TOXIC, ORDINARY, LONGEST = 1000, 2000, 32 << 10
WINDOW, SLACK, FOLDS = 8, 3, 3
#: Common words at the front of both dictionaries, bytes of a strange stretch, and bytes of a trained dictionary with
#: the trainer's segment and match sizes.
HEAD_WORDS, GRAM, TRAINED, SEGMENT, MATCH = 1500, 5, 4096, 16, 6
CHUNK_BYTES = 1 << 18
_IS_WORD = np.ones(256, bool)
_IS_WORD[[9, 10, 11, 12, 13, 32]] = False


def windows(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text index, (offset, length) with the bytes around) of the windows in texts that stand one after the other."""
    n = len(raw)
    is_word = _IS_WORD[raw]
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:], after[:-1] = is_word[:-1], is_word[1:]
    inner = offsets[(offsets > 0) & (offsets < n)]
    before[inner], after[inner - 1] = False, False
    starts, ends = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    text = np.searchsorted(offsets, starts, "right") - 1
    count = np.bincount(text, minlength=len(offsets) - 1)
    place = np.arange(len(starts)) - np.repeat(np.cumsum(count) - count, count)
    first = np.flatnonzero(place % WINDOW == 0)
    last = np.minimum(first + WINDOW, (np.cumsum(count))[text[first]]) - 1
    of = text[first]
    a, b = np.maximum(starts[first] - 1, offsets[of]), np.minimum(ends[last] + 1, offsets[of + 1])
    return of, np.stack([a, b - a], 1).astype(np.uint64)


class Scorer:
    """The two dictionaries' contents and the curve."""

    def __init__(self, ordinary: bytes, toxic: bytes, curve: tuple[float, ...] = (0.0, 0.0, 0.0, 0.0)):
        self.contents, self.curve = (ordinary, toxic), curve

    def open(self) -> Scorer:
        way = zstandard.ZstdCompressionParameters(window_log=15, chain_log=13, hash_log=13, search_log=4, min_match=MATCH, target_length=32, strategy=zstandard.STRATEGY_LAZY, write_content_size=False, write_checksum=False, write_dict_id=False, format=zstandard.FORMAT_ZSTD1_MAGICLESS)
        self.by = [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(x, dict_type=zstandard.DICT_TYPE_RAWCONTENT), compression_params=way) for x in self.contents]
        return self

    def savings(self, raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(text index, bytes) of each window: how much shorter the toxic dictionary makes it than the ordinary one."""
        of, parts = windows(raw, offsets) if len(raw) else (np.zeros(0, int), np.zeros((0, 2), np.uint64))
        if not len(of):
            return of, np.zeros(0)
        buffer = zstandard.BufferWithSegments(raw.tobytes().lower(), parts.tobytes())
        ordinary, toxic = (np.fromiter(map(len, x.multi_compress_to_buffer(buffer)), np.int64, len(of)) for x in self.by)
        return of, (ordinary - toxic).astype(np.float64)

    def measures(self, raw: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Per text: the mean saving of its windows, the logarithm of the mean beyond the slack, and the greatest one."""
        out = np.zeros((len(offsets) - 1, 3))
        of, saved = self.savings(raw, offsets)
        n = np.maximum(np.bincount(of, minlength=len(out)), 1)
        out[:, 0] = np.bincount(of, saved, len(out)) / n
        out[:, 1] = np.log(np.bincount(of, np.maximum(saved - SLACK, 0), len(out)) / n + 0.01) - np.log(0.01)
        if len(of):
            edge = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            out[of[edge], 2] = np.maximum.reduceat(saved, edge)
        return out

    def score(self, measured: np.ndarray) -> np.ndarray:
        a, *weights = self.curve
        return 1 / (1 + np.exp(-np.clip(a + measured @ np.array(weights), -30, 30)))


def _grams(text: bytes) -> tuple[bytes, np.ndarray]:
    """A text with its words one space apart, and its runs of GRAM bytes, as numbers."""
    text = b" " + b" ".join(text.lower().split()) + b" "
    raw, n = np.frombuffer(text, np.uint8).astype(np.int64), max(len(text) - GRAM + 1, 0)
    return text, sum((raw[i : i + n] << 8 * i for i in range(GRAM)), np.zeros(n, np.int64))


def _known(*groups: list[bytes]) -> np.ndarray:
    """All grams of the texts, in order."""
    return np.unique(np.concatenate([_grams(x)[1] for texts in groups for x in texts] or [np.zeros(0, np.int64)]))


def strange(text: bytes, known: np.ndarray) -> list[bytes]:
    """The stretches of a text whose every GRAM bytes in a row are unknown."""
    text, grams = _grams(text)
    new = np.flatnonzero(known[np.minimum(np.searchsorted(known, grams), len(known) - 1)] != grams) if len(known) else np.arange(len(grams))
    if not len(new):
        return []
    edge = np.flatnonzero(np.diff(new) > 1) + 1
    return [text[part[0] : part[-1] + GRAM] for part in np.split(new, edge)]


def trained(samples: list[bytes], size: int = TRAINED) -> bytes:
    """The trainer's dictionary of samples; of fewer than it takes, a smaller one, and at last the samples themselves."""
    while size >= 256:
        try:
            return zstandard.train_dictionary(size, samples, k=SEGMENT, d=MATCH).as_bytes()
        except zstandard.ZstdError:
            size //= 2
    return b"".join(samples)[-TRAINED:]


def contents(toxic: list[bytes], ordinary: list[bytes]) -> tuple[bytes, bytes]:
    """The contents of the ordinary and of the toxic dictionary, from sample texts."""
    few = min(len(toxic), max(len(ordinary) // 2, 1))
    groups = [toxic, ordinary[:few], ordinary[few:]]  # of either kind as many texts, each against all others
    samples = []
    for own, others in ((groups[0], groups[1:]), (groups[1], groups[::2])):
        known = _known(*others)
        samples.append([s for x in own for s in strange(x, known) if len(s) >= 8])
    words = Counter(w for x in ordinary for w in set(x.lower().split()))
    head = b" ".join(w for w, _ in sorted(words.items(), key=lambda x: (-x[1], x[0]))[:HEAD_WORDS])
    made = [trained(x) for x in samples]
    size = min(map(len, made)) or max(map(len, made))  # one size, from the end, where the best segments stand
    return head + made[1][-size:], head + made[0][-size:]


def curve(measured: np.ndarray, label: np.ndarray) -> tuple[float, ...]:
    """Logistic regression by Newton's steps, with a little ridge."""
    x = np.column_stack([np.ones(len(label)), measured])
    k = x.shape[1]
    w, ridge = np.zeros(k), np.diag([1e-6, *[1e-2] * (k - 1)])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve(x.T @ (x * (p * (1 - p))[:, None]) + ridge + 1e-9 * np.eye(k), x.T @ (p - label) + ridge @ w)
        w = w - np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return tuple(float(v) for v in w)


def fit(docs: DataFrame, labels: DataFrame) -> Scorer | None:
    """A scorer from texts (doc_id, text) and labels (doc_id, toxic); None without texts of both kinds.

    The sample is drawn from the labels alone, so its ids are few by the bounds and their texts come by a broadcast.
    """
    rated = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("toxic").alias("toxic")).withColumn("_lot", F.xxhash64("doc_id"))
    drawn = rated.where("toxic = 1").orderBy("_lot", "doc_id").limit(TOXIC).unionByName(rated.where("toxic = 0").orderBy("_lot", "doc_id").limit(ORDINARY))
    texts = docs.where(F.octet_length("text") <= LONGEST).join(F.broadcast(drawn), "doc_id").select("_lot", "doc_id", "toxic", F.encode("text", "UTF-8").alias("raw")).collect()
    texts.sort(key=lambda r: (r["_lot"], r.doc_id, bytes(r.raw)))
    sample = [[r for r in texts if r.toxic == k] for k in (1, 0)]
    toxic, ordinary = ([bytes(r.raw) for r in rows] for rows in sample)
    if not toxic or not ordinary:
        return None
    measured, label = [], []
    for fold in range(FOLDS):  # each text is measured by dictionaries that haven't seen it
        seen = [[x for i, x in enumerate(texts) if i % FOLDS != fold] or texts for texts in (toxic, ordinary)]
        unseen = [texts[fold::FOLDS] for texts in (toxic, ordinary)]
        texts = unseen[0] + unseen[1]
        measured.append(Scorer(*contents(*seen)).open().measures(np.frombuffer(b"".join(texts), np.uint8), np.cumsum([0, *map(len, texts)])))
        label += [1.0] * len(unseen[0]) + [0.0] * len(unseen[1])
    return Scorer(*contents(toxic, ordinary), curve(np.concatenate(measured), np.array(label)))


def scores(docs: DataFrame, scorer: Scorer | None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, score) of every row."""
    kind = dict(docs.dtypes)[key]
    if scorer is None:
        return docs.select(docs[key], F.lit(0.0).alias("score"))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ready = Scorer(*scorer.contents, scorer.curve).open()
        for batch in batches:
            at = 0
            for ids, raw, offsets in text_chunks(batch.column(0), batch.column(1), CHUNK_BYTES):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(ids)), pa.array(ready.score(ready.measures(raw, offsets)))], names=[key, "score"])
                at += len(ids)

    return docs.select(docs[key], docs[text].alias("_text")).mapInArrow(work, f"`{key}` {kind}, score double")
