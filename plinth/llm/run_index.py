"""A run-length index of a text: the runs of its Burrows-Wheeler transform with the suffix array sampled at run ends.

In a repetitive text the transform has few runs. Let phi(i) be the suffix just before suffix i in suffix order, and
l(i) how many bytes they share. Where i's row doesn't begin a run, phi(i) = phi(i - 1) + 1 and l(i) = l(i - 1) - 1, so
the samples at run heads (a position, its phi from the end of the run before, and its l) give both for every position
in one pass over the text.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def _words(text: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one big-endian number; zeros follow the end."""
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    out = np.zeros(len(text), U)
    for k in range(8):
        out = (out << U(8)) | padded[k : k + len(text)].astype(U)
    return out


def suffix_array(text: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order, by doubling the compared length from eight bytes on."""
    n, size, keys = len(text), 8, words
    while True:
        order = np.argsort(keys, kind="stable")
        ranked = keys[order]
        rank = np.zeros(n, np.int64)
        rank[order[1:]] = np.cumsum(ranked[1:] != ranked[:-1])
        if rank[order[-1]] == n - 1 or size >= n:
            return order
        after = np.zeros(n, np.int64)
        after[: n - size] = rank[size:] + 1
        keys = (rank.astype(U) << U(32)) | after.astype(U)
        size *= 2


class RunIndex:
    """Samples ``at`` (positions, rising), ``phi`` and ``common`` (shared bytes, exact up to ``longest``)."""

    def __init__(self, text: np.ndarray, longest: int):
        words = _words(text)
        sa = suffix_array(text, words)
        last = text[sa - 1]  # the transform; the first suffix wraps round
        # at the text's first suffix and just after it, a wrapped byte would only seem to go on a run
        heads = np.flatnonzero(np.concatenate([[True], (last[1:] != last[:-1]) | (sa[:-1] == 0)]) | (sa == 0))
        self.runs, self.size = len(heads), len(text)
        order = np.argsort(sa[heads])
        heads = heads[order]
        self.at, self.phi = sa[heads], np.where(heads > 0, sa[heads - 1], -1)
        self.common = self._common(text, words, longest)

    def _common(self, text: np.ndarray, words: np.ndarray, longest: int) -> np.ndarray:
        n, out = len(text), np.zeros(len(self.at), np.int64)
        live = np.flatnonzero(self.phi >= 0)
        for source, step in ((words, 8), (text, 1)):
            here = live
            while len(here):
                a, b = self.at[here] + out[here], self.phi[here] + out[here]
                inside = (np.maximum(a, b) + step <= n) & (out[here] < longest)
                same = inside & (source[np.where(inside, a, 0)] == source[np.where(inside, b, 0)])
                here = here[same]
                out[here] += step
        return out

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """(phi, l) of every position, streamed from the samples."""
        runs = np.diff(np.append(self.at, self.size))
        passed = np.arange(self.size) - np.repeat(self.at, runs)
        return np.repeat(self.phi, runs) + passed, np.repeat(self.common, runs) - passed

    def repeated(self, length: int) -> np.ndarray:
        """Whether the ``length`` bytes from each position on also start at a lower position."""
        phi, common = self.statistics()
        linked = common >= length
        root = np.where(linked, phi, np.arange(self.size))
        while True:  # chains of links are stretches of the suffix order; jump to their heads
            further = root[root]
            if np.array_equal(further, root):
                break
            root = further
        out = np.zeros(self.size, bool)
        members = np.flatnonzero(linked)
        if len(members):
            members = np.union1d(members, root[members])
            order = members[np.argsort(root[members], kind="stable")]  # by class, then position
            roots = root[order]
            out[order[1:]] = roots[1:] == roots[:-1]
        return out
