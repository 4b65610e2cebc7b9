"""Byte-level BPE encoding and decoding from a public tokenizer file (JSON with a ``BPE`` model).

Text is cut at the file's special tokens, then into words by the byte-level pattern. A short word keeps one contiguous
array of part boundaries and one of the ranks of adjacent parts: the least rank is found by a scan, its inner boundary
is deleted, and the two neighbouring ranks are refreshed. A long word (a run of letters without end, say) would make
the scans quadratic, so its ranks wait in a heap instead; both give the merges in the same order. Words repeat, so a
task keeps the ids of recent ones.

Defined results: a null or empty text has no ids; very long texts and words are encoded whole; of equal ranks the
leftmost merges first; repeated rows give equal results, an empty table none; ids that aren't in the vocabulary raise
``KeyError``; bytes that aren't UTF-8 decode to U+FFFD; only the key and the text are read.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Callable
from itertools import chain

import regex
from pyspark.sql import DataFrame

from plinth.llm.common import map_texts

SPACE = r"\t-\r\x20\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: The byte-level word pattern, a fixed value of this kind of tokenizer.
WORDS = rf"'s|'t|'re|'ve|'m|'ll|'d| ?\p{{L}}+| ?\p{{N}}+| ?[^{SPACE}\p{{L}}\p{{N}}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+"
SHORT = 96
#: Words whose ids a task keeps at hand; when they are so many, they become the older store and a new one begins.
REMEMBERED = 400_000
NONE = 1 << 30


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in such files: itself if printable, else one from U+0100 on, in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class Codec:
    """Encoder and decoder of one tokenizer file's contents."""

    def __init__(self, contents: str):
        spec = json.loads(contents)
        byte_of = byte_letters()
        raw = lambda token: bytes(byte_of[c] for c in token)
        special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.ids = {raw(t): i for t, i in spec["model"]["vocab"].items() if t not in special}
        pairs = [m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"]]
        self.ranks = {(raw(a), raw(b)): i for i, (a, b) in enumerate(pairs)}
        self.special = special
        self.bytes = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in special.items()}
        self.text = {i: str(i) for i in self.bytes}
        self.cut = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(special, key=len, reverse=True)) + ")") if special else None
        self.words = regex.compile(WORDS)
        self.known: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}

    def short_word(self, word: bytes) -> tuple[int, ...]:
        rank = self.ranks.get
        bounds = list(range(len(word) + 1))
        between = lambda i: rank((word[bounds[i] : bounds[i + 1]], word[bounds[i + 1] : bounds[i + 2]]), NONE)
        ranks = [between(i) for i in range(len(word) - 1)]
        while ranks and (least := min(ranks)) < NONE:
            i = ranks.index(least)
            del bounds[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = between(i)
            if i:
                ranks[i - 1] = between(i - 1)
        return tuple(self.ids[word[a:b]] for a, b in zip(bounds, bounds[1:], strict=False))

    def long_word(self, word: bytes) -> tuple[int, ...]:
        n = len(word)
        end, before = list(range(1, n + 1)), list(range(-1, n - 1))  # of the part that starts at an index

        def offer(i: int) -> None:
            j = end[i]
            if j < n and (r := self.ranks.get((word[i:j], word[j : end[j]]))) is not None:
                heapq.heappush(heap, (r, i, j, end[j]))

        heap: list[tuple[int, int, int, int]] = []
        for i in range(n):
            offer(i)
        while heap:
            _, i, j, k = heapq.heappop(heap)
            if end[i] != j or end[j] != k:
                continue  # a part of this pair has been merged meanwhile
            end[i], end[j] = k, 0
            if k < n:
                before[k] = i
            offer(i)
            if i:
                offer(before[i])
        out, i = [], 0
        while i < n:
            out.append(self.ids[word[i : end[i]]])
            i = end[i]
        return tuple(out)

    def word(self, word: str) -> tuple[int, ...]:
        raw = word.encode()
        if len(raw) > SHORT:
            return self.long_word(raw)
        got = self.older.get(word) or self.short_word(raw)
        self.known[word] = got
        return got

    def encode(self, text: str | None) -> list[int]:
        if len(self.known) >= REMEMBERED:
            self.known, self.older = {}, self.known
        known, out = self.known, []
        for part in self.cut.split(text or "") if self.cut else [text or ""]:
            if part in self.special:
                out.append([self.special[part]])
            elif part:
                words = self.words.findall(part)
                found = list(map(known.get, words))
                if None in found:
                    found = [self.known.get(w) or self.word(w) if x is None else x for x, w in zip(found, words, strict=True)]
                out += found
        return list(chain.from_iterable(out))

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.bytes.__getitem__, ids)).decode("utf-8", "replace")


def _codec(docs: DataFrame, path: str) -> Callable[[], Codec]:
    """Reads the file here, on the driver, and ships its contents (a vocabulary, of fixed size) to each executor once."""
    with open(path, encoding="utf-8") as f:
        contents = docs.sparkSession.sparkContext.broadcast(f.read())
    return lambda: Codec(contents.value)


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(key, n_tokens, ids): the ids of each text as comma-separated decimals."""
    load = _codec(docs, path)

    def prepare() -> Callable[[str | None], tuple]:
        codec = load()
        return lambda x: (len(ids := codec.encode(x)), ",".join(map(codec.text.__getitem__, ids)))

    return map_texts(docs, [key], text, {"n_tokens": "long", "ids": "string"}, prepare)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """(key, text) from the comma-separated ids that ``encode`` gives."""
    load = _codec(encoded, path)

    def prepare() -> Callable[[str | None], tuple]:
        codec = load()
        return lambda x: (codec.decode([int(i) for i in x.split(",")] if x else []),)

    return map_texts(encoded, [key], ids, {"text": "string"}, prepare)


def digests(docs: DataFrame, path: str) -> DataFrame:
    """Digests of the ids and of the text that decodes from them, without moving either."""
    load = _codec(docs, path)

    def prepare() -> Callable[[str | None], tuple]:
        codec = load()

        def of(x: str | None) -> tuple:
            ids = codec.encode(x)
            listed = ",".join(map(codec.text.__getitem__, ids))
            return len(ids), hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(codec.decode(ids).encode()).hexdigest()

        return of

    return map_texts(docs, ["doc_id"], "text", {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string"}, prepare)
