"""Periodic runs of words: a longest-previous-factor table, its blocks, and all maximal repetitions.

Texts are taken many at a time, as one array of word numbers that differ between texts.
Prefix doubling gives the suffix array and, as it keeps its ranks, the common extension of any
two places in a few steps. Neighbours in the suffix array with smaller places, found by pointer
jumping, give the longest previous factor of each place, and following those the Lempel-Ziv blocks.
A repetition that meets a block's edge is found there by extending to both sides, once for
each period that may; one inside a block is copied from where the block occurred before,
out of buckets by start, left to right.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelume.llm.names import Held

#: Words of texts taken together; a longer text is taken alone.
WORDS = 1 << 17
LEAST, POWER = 6, 4
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Suffixes:
    """Suffix array of texts in one array; ``ends`` has each place's end of text, ``begins`` its begin."""

    def __init__(self, words: np.ndarray, sizes: np.ndarray):
        n, upto = len(words), np.cumsum(sizes)
        self.begins, self.ends = np.repeat(upto - sizes, sizes), np.repeat(upto, sizes)
        _, first = np.unique(np.repeat(np.arange(len(sizes)), sizes) * (int(words.max(initial=0)) + 1) + words, return_inverse=True)
        counts = np.bincount(first, minlength=1)
        #: ranks[k][i] names the 2^k words from i on: equal only if they are.
        self.ranks = [(np.cumsum(counts) - counts)[first]]
        self.order = np.argsort(first, kind="stable")
        rank, step = self.ranks[0], 1
        at = np.flatnonzero((counts > 1)[first[self.order]])  # places in the order that are not settled
        while len(at):
            i = self.order[at]
            far = i + step
            # of equal words only one can stand at its text's end
            ahead = np.where(far < self.ends[i], rank[np.minimum(far, n - 1)], -1)
            o = np.lexsort((ahead, rank[i]))
            i, ahead, group = i[o], ahead[o], rank[i[o]]
            self.order[at] = i
            fresh = np.r_[True, (group[1:] != group[:-1]) | (ahead[1:] != ahead[:-1])]
            start = np.flatnonzero(fresh)
            size = np.diff(np.r_[start, len(i)])
            rank = rank.copy()
            rank[i] = np.repeat(at[start], size)
            self.ranks.append(rank)
            at = at[np.repeat(size > 1, size)]
            step *= 2

    def right(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that the suffixes at ``i`` and ``j``, places of one text, have in common."""
        out, n = np.zeros(len(i), np.int64), len(self.begins)
        end = self.ends[i]
        for k in reversed(range(len(self.ranks))):
            a, b = i + out, j + out
            same = (np.maximum(a, b) + (1 << k) <= end) & (self.ranks[k][np.minimum(a, n - 1)] == self.ranks[k][np.minimum(b, n - 1)])
            out += same.astype(np.int64) << k
        return out

    def left(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Words that what ends before ``i`` and before ``j`` has in common."""
        out = np.zeros(len(i), np.int64)
        begin = self.begins[np.minimum(i, len(self.begins) - 1)]
        for k in reversed(range(len(self.ranks))):
            a, b = i - out - (1 << k), j - out - (1 << k)
            same = (np.minimum(a, b) >= begin) & (self.ranks[k][np.maximum(a, 0)] == self.ranks[k][np.maximum(b, 0)])
            out += same.astype(np.int64) << k
        return out

    def previous_factors(self) -> tuple[np.ndarray, np.ndarray]:
        """``length, source``: of each place the longest stretch that also starts earlier, and where; 0 and itself if none does."""
        n, sa = len(self.order), self.order
        lcp = np.zeros(n + 1, np.int64)
        if n:
            near = np.flatnonzero(self.ranks[0][sa[1:]] == self.ranks[0][sa[:-1]]) + 1
            lcp[near] = self.right(sa[near - 1], sa[near])
        best, source = np.zeros(n, np.int64), sa.copy()
        for step, common in ((-1, lcp[:n].copy()), (1, lcp[1:].copy())):
            to = np.arange(n) + step
            todo = np.flatnonzero(common)
            todo = todo[sa[to[todo]] > sa[todo]]
            while len(todo):
                # all between a place and what it points at are larger, so what that points at is next
                via = to[todo]
                common[todo], to[todo] = np.minimum(common[todo], common[via]), to[via]
                todo = todo[common[todo] > 0]
                todo = todo[sa[to[todo]] > sa[todo]]
            more = common > best
            best[more], source[more] = common[more], sa[to[more]]
        length, where = np.empty(n, np.int64), np.empty(n, np.int64)
        length[sa], where[sa] = best, source
        return length, where


def blocks_of(length: np.ndarray) -> np.ndarray:
    """Starts of the Lempel-Ziv blocks: each is its longest previous factor, or one new word."""
    after, out, at = (np.arange(len(length)) + np.maximum(length, 1)).tolist(), [], 0
    while at < len(after):
        out.append(at)
        at = after[at]
    return np.array(out, np.int64)


def _spread(many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """``which, k``: each place as often as ``many`` says, numbered from one."""
    which = np.repeat(np.arange(len(many)), many)
    return which, np.arange(len(which)) - np.repeat(np.cumsum(many) - many, many) + 1


def at_edges(s: Suffixes, words: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``start, end, period`` of the maximal repetitions that meet an edge between blocks, each once with its least period."""
    n = len(words)
    size = np.diff(np.r_[starts, n])
    before = np.r_[0, size[:-1]]
    begin = s.begins[starts]
    before[starts == begin] = 0
    out = []
    # a repetition has a whole period behind the edge, within the block, or one before it, within two blocks before and as far as the block is long
    for many, side in ((size, 1), (np.minimum(2 * before + size, starts - begin), -1)):
        which, p = _spread(many)
        j = starts[which]
        i, j = (j, j + p) if side > 0 else (j - p, j)
        end = s.ends[starts[which]]
        same = (j < end) & (words[i] == words[np.minimum(j, n - 1)])
        inner = i > begin[which]
        same |= inner & (words[np.maximum(i, 1) - 1] == words[j - 1])
        k = np.flatnonzero(same)
        i, j, p = i[k], j[k], p[k]
        # an edge at the text's end extends to the left only
        open_ = j < end[k]
        r = np.zeros(len(k), np.int64)
        r[open_] = s.right(i[open_], j[open_])
        left = s.left(i, j)
        good = left + r >= p
        out.append(((i - left)[good], (j + r)[good], p[good]))
    edges = np.unique(s.ends)
    last = np.searchsorted(starts, edges) - 1  # each text's end is an edge too, behind its last block
    which, p = _spread(np.minimum(2 * size[last], edges - s.begins[starts[last]]))
    j = edges[which]
    i = j - p
    k = np.flatnonzero((i > s.begins[i]) & (words[np.maximum(i, 1) - 1] == words[j - 1]))
    i, j, p = i[k], j[k], p[k]
    left = s.left(i, j)
    good = left >= p
    out.append(((i - left)[good], j[good], p[good]))
    a, b, p = (np.concatenate(x) for x in zip(*out))
    order = np.lexsort((p, b, a))
    a, b, p = a[order], b[order], p[order]
    least = np.r_[True, (a[1:] != a[:-1]) | (b[1:] != b[:-1])] if len(a) else np.zeros(0, bool)
    return a[least], b[least], p[least]


def with_copies(found: tuple[np.ndarray, np.ndarray, np.ndarray], starts: np.ndarray, length: np.ndarray, source: np.ndarray) -> list[tuple[int, int, int]]:
    """All maximal repetitions ``(start, end, period)``: those found, and those strictly inside a block, from where it occurred before."""
    runs = list(zip(*(x.tolist() for x in found)))
    if not runs:
        return []
    bucket: dict[int, set] = {}
    for a, b, p in runs:
        bucket.setdefault(a, set()).add((b, p))
    keys = sorted(bucket)
    wide = starts[length[starts] >= 4]  # two words and one to either side
    for s, m, q in zip(wide.tolist(), length[wide].tolist(), source[wide].tolist()):
        shift = s - q
        inside = keys[bisect_right(keys, q) : bisect_left(keys, q + m)]
        while inside:
            more = []
            for a in inside:
                for b, p in list(bucket[a]):
                    if b < q + m:
                        if a + shift not in bucket:
                            insort(keys, a + shift)
                            bucket[a + shift] = set()
                            if q < a + shift < q + m:  # a block that overlaps its source copies its own copies
                                more.append(a + shift)
                        elif (b + shift, p) not in bucket[a + shift] and q < a + shift < q + m and a + shift not in more:
                            more.append(a + shift)
                        bucket[a + shift].add((b + shift, p))
            inside = sorted(more)
    return [(a, b, p) for a in keys for b, p in sorted(bucket[a])]


def all_runs(words: np.ndarray, sizes: np.ndarray) -> list[tuple[int, int, int]]:
    """``(start, end, period)`` of every maximal repetition, twice its least period long at least, by places in ``words``."""
    if not len(words):
        return []
    s = Suffixes(words, sizes)
    length, source = s.previous_factors()
    starts = blocks_of(length)
    return with_copies(at_edges(s, words, starts), starts, length, source)


def with_runs(docs: DataFrame, text_col: str = "text", least: int = LEAST, power: int = POWER, words: int = WORDS) -> DataFrame:
    """``docs`` with ``n_words``, ``runs`` and ``collapsed``.

    Words are what ASCII white space separates. A run is a stretch of words, numbered from 0, with smallest period q, maximal, and
    max(``least``, ``power`` * q) words long at least, ``power`` being 2 or more; ``runs`` has them by start, then period. ``collapsed``
    has the words joined by one space, without those that stand in a run behind its first q words. Null and
    empty texts have no words, no runs and an empty ``collapsed``. A text of any length is taken whole. Equal rows have equal results; an
    empty table gives no rows. Other columns are kept, whatever their names; columns of the results' names are replaced.
    """
    if power < 2:
        raise ValueError("power must be 2 or more")
    held = Held(docs, replaced=("n_words", "runs", "collapsed"))
    at = held.columns().index(held.at(text_col))

    def result(texts: list[list[bytes]]) -> list[pa.Array]:
        sizes = np.array([len(t) for t in texts], np.int64)
        flat = pa.array([w for t in texts for w in t], pa.large_binary()).dictionary_encode().indices.to_numpy().astype(np.int64)
        upto = np.cumsum(sizes)
        per: dict[int, list] = {}
        wanted = [(a, b, p) for a, b, p in all_runs(flat, sizes) if b - a >= max(least, power * p)]
        for (a, b, p), d in zip(wanted, np.searchsorted(upto, [r[0] for r in wanted], "right").tolist()):
            per.setdefault(d, []).append((a - int(upto[d] - sizes[d]), b - a, p))
        runs, kept = [], []
        for d, t in enumerate(texts):
            mine = sorted(per.get(d, ()), key=lambda r: (r[0], r[2]))
            runs.append([{"start": a, "length": n, "period": p} for a, n, p in mine])
            if mine:
                gone = bytearray(len(t))
                for a, n, p in mine:
                    gone[a + p : a + n] = b"\1" * (n - p)
                t = [w for w, g in zip(t, gone) if not g]
            kept.append(b" ".join(t))
        return [pa.array(sizes), pa.array(runs, _RUNS), pa.array(kept, pa.binary())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, first, n = [], 0, 0
            for k, x in enumerate(batch.column(at)):
                texts.append((x.as_buffer().to_pybytes() if x.is_valid else b"").split())
                n += len(texts[-1])
                if n >= words or k == batch.num_rows - 1:
                    rows = batch.slice(first, k + 1 - first)
                    yield pa.RecordBatch.from_arrays([*rows.columns, *result(texts)], names=[*batch.schema.names, "n_words", "runs", "kept"])
                    texts, first, n = [], k + 1, 0

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in held.df.schema)
    out = held.df.mapInArrow(run, f"{fields}, n_words long, runs array<struct<start:long,length:long,period:long>>, kept binary")
    return held.back(out.withColumn("collapsed", F.decode("kept", "UTF-8")), {"n_words": "n_words", "runs": "runs", "collapsed": "collapsed"})
