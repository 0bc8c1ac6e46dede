"""Removal of repeated long strings by a logarithmic family of suffix arrays.

A byte goes if a string of ``WIDTH`` bytes that covers it also starts in a document of
a smaller id. Texts are packed into blocks; every block gets a sparse suffix array: of
each ``WIDTH`` bytes the suffix at the position whose next ``DEPTH`` bytes hash lowest,
leftmost on ties, so equal strings sample equal suffixes, and about one position in
fourteen is sampled. The array is in lexicographic order of those ``DEPTH`` bytes, which is
as far as a sampled suffix is sure to lie inside the string.

Arrays are dealt over shards by hash. A shard's task takes them batch by batch, merge-scans
each batch against the levels of its index, pushes it, and merges levels of like size, so
there are logarithmically many. Suffixes that only one document has are done with, nine in ten.
Round the others the strings themselves are compared: a segment of text holds all strings that
sample the suffix, and the smallest id of each string decides.

What a hot suffix costs: a block sends each suffix once, and each segment once, with its
smallest id. A suffix that very many documents have, with different text beside it, has its
segments cut into single strings, dealt by the strings' own hash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelume.llm.scratch import Scratch, new_path

WIDTH, DEPTH = 50, 24
#: Bytes of text in a block, and of text for each shard of the index.
BLOCK, SHARD = 4 << 20, 12 << 20
#: Suffixes in a batch at least, and documents with a suffix from which on its segments are cut up.
BATCH, HOT = 1 << 17, 1 << 14
_WORDS = DEPTH // 8
_M = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3)]
_SCHEMA = "shard int, block long, n int, b binary"


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(29))


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on as a number in the order of the bytes; ``buf`` ends in seven bytes of padding."""
    return np.ndarray((len(buf) - 7,), ">u8", buf, strides=(1,))


def _padded(data: bytes) -> np.ndarray:
    return np.frombuffer(data + bytes(64), np.uint8)


def sampled(buf: np.ndarray, ends: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """``at, first, many, doc``: sampled suffixes, and the run of ``width``-byte strings that sample each.

    ``buf`` is padded text, ``ends`` where its documents end. The strings of a run start at
    ``first`` to ``first + many - 1``. Texts are taken in pieces that overlap by a string.
    """
    out, span, piece = [], width - DEPTH + 1, 1 << 16
    size = int(ends[-1]) if len(ends) else 0
    words = _words(buf)
    for lo in range(0, max(0, size - width + 1), piece):
        n = min(piece, size - width + 1 - lo)  # strings that start here
        w = words[lo : lo + n + span + DEPTH].astype(np.uint64)
        h = w[: n + span - 1] * _M[0]
        for j in range(1, _WORDS):
            h = (h ^ (h >> np.uint64(31))) + w[8 * j : 8 * j + n + span - 1] * _M[j]
        h = (_mix(h) >> np.uint64(32) << np.uint64(32)) | np.arange(n + span - 1, dtype=np.uint64)
        step = 1
        while 2 * step <= span:
            h = np.minimum(h[:-step], h[step:])
            step *= 2
        if step < span:
            h = np.minimum(h[: -(span - step)], h[span - step :])
        out.append((h & np.uint64(0xFFFFFFFF)).astype(np.int64) + lo)
    if not out:
        return (np.zeros(0, np.int64),) * 4
    at = np.concatenate(out)
    doc = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))[: len(at)]
    inside = np.arange(len(at)) + width <= ends[doc]
    fresh = np.r_[True, (at[1:] != at[:-1]) | (doc[1:] != doc[:-1])] & inside
    first = np.flatnonzero(fresh)
    upto = np.r_[first[1:], len(at)]
    many = np.minimum(upto, ends[doc[first]] - width + 1) - first
    return at[first], first, many, doc[first]


def keys_at(buf: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The first ``DEPTH`` bytes of suffixes as rows of numbers that sort like the bytes."""
    words = _words(buf)
    return np.stack([words[at + 8 * j].astype(np.uint64) for j in range(_WORDS)], 1)


def _order(keys: np.ndarray) -> np.ndarray:
    return np.lexsort(keys.T[::-1])


def _fresh(keys: np.ndarray) -> np.ndarray:
    """Where sorted keys begin anew."""
    return np.r_[True, (keys[1:] != keys[:-1]).any(1)] if len(keys) else np.zeros(0, bool)


def suffix_array(buf: np.ndarray, at: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``keys, many, which``: a block's suffixes in order, each once, the documents that have it, and the place of each of ``at`` among them."""
    keys = keys_at(buf, at)
    order = _order(keys)
    keys = keys[order]
    fresh = _fresh(keys)
    place = np.cumsum(fresh) - 1
    which = np.empty(len(at), np.int64)
    which[order] = place
    d = doc[order]  # the sort is stable and ``at`` ascends, so documents do within a suffix
    many = np.bincount(place, np.r_[True, d[1:] != d[:-1]] | fresh, len(np.flatnonzero(fresh))) if len(at) else np.zeros(0)
    return keys[fresh], many.astype(np.int64), which


class Levels:
    """Sorted arrays of suffixes, each under half the size of the one before; every suffix has a slot."""

    def __init__(self):
        self.levels: list[tuple[np.ndarray, np.ndarray]] = []
        self.slots = 0

    @staticmethod
    def scan(level: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``place, found``: where each of the sorted ``keys`` belongs in the sorted ``level``, and whether it is there."""
        lo = np.searchsorted(level[:, 0], keys[:, 0], "left")
        hi = np.searchsorted(level[:, 0], keys[:, 0], "right")
        some = np.flatnonzero(hi > lo)
        found = np.zeros(len(keys), bool)
        a, b, k = lo[some], hi[some], keys[some]
        while True:
            open_ = np.flatnonzero(a < b)
            if not len(open_):
                break
            mid = (a[open_] + b[open_]) >> 1
            low = np.zeros(len(open_), bool)
            same = np.ones(len(open_), bool)
            for j in range(1, keys.shape[1]):
                x, y = level[mid, j], k[open_, j]
                low |= same & (x < y)
                same &= x == y
            a[open_] = np.where(low, mid + 1, a[open_])
            b[open_] = np.where(low, b[open_], mid)
        lo[some] = a
        inside = np.flatnonzero(lo < hi)
        found[inside] = (level[lo[inside]] == keys[inside]).all(1)
        return lo, found

    @staticmethod
    def merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Two levels without common suffixes as one."""
        at = Levels.scan(a[0], b[0])[0] + np.arange(len(b[0]))
        old = np.ones(len(a[0]) + len(b[0]), bool)
        old[at] = False
        keys, slots = np.empty((len(old), a[0].shape[1]), np.uint64), np.empty(len(old), np.int64)
        keys[at], slots[at], keys[old], slots[old] = b[0], b[1], a[0], a[1]
        return keys, slots

    def add(self, keys: np.ndarray) -> np.ndarray:
        """Slots of the sorted, distinct ``keys``, those of them that are new as a new level."""
        slots = np.full(len(keys), -1)
        todo = np.arange(len(keys))
        for level, known in self.levels:
            place, found = self.scan(level, keys[todo])
            slots[todo[found]] = known[place[found]]
            todo = todo[~found]
        slots[todo] = np.arange(self.slots, self.slots + len(todo))
        self.slots += len(todo)
        if len(todo):
            self.levels.append((keys[todo], slots[todo]))
        while len(self.levels) > 1 and len(self.levels[-2][0]) < 2 * len(self.levels[-1][0]):
            self.levels.append(self.merge(self.levels.pop(-2), self.levels.pop()))
        return slots


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays byte plane by byte plane, compressed: sorted numbers share their high bytes."""
    planes = [np.frombuffer(a.tobytes(), np.uint8).reshape(len(a), -1).T.tobytes() if len(a) else b"" for a in arrays]
    return zstandard.ZstdCompressor(level=1).compress(b"".join(planes))


def _unpack(data: bytes, n: int, *kinds: str) -> list[np.ndarray]:
    raw, out, at = zstandard.ZstdDecompressor().decompress(data), [], 0
    for kind in kinds:
        size = np.dtype(kind).itemsize * n
        planes = np.frombuffer(raw, np.uint8, size, at).reshape(-1, n).T
        out.append(np.frombuffer(planes.tobytes(), kind))
        at += size
    return out


def blocks(docs: DataFrame, id_col: str, text_col: str, size: int = BLOCK) -> DataFrame:
    """``block, n_bytes, ids, ends, data``: documents packed into blocks of about ``size`` bytes; a text is never cut."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def flush():
            data = b"".join(texts)
            row = [[hash_(data)], [len(data)], [ids], [np.cumsum([len(t) for t in texts]).tolist()], [data]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, (pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()))], names=["block", "n_bytes", "ids", "ends", "data"])

        def hash_(data):
            return xxhash.xxh64_intdigest(data, len(ids)) >> 1 ^ xxhash.xxh64_intdigest(repr(ids).encode()) >> 1

        ids, texts, held = [], [], 0
        for b in batches:
            for i, t in zip(b.column(0).to_pylist(), b.column(1)):
                ids.append(i)
                texts.append(t.as_py() or b"")
                held += len(texts[-1])
                if held >= size or len(ids) >= 1 << 16:
                    yield flush()
                    ids, texts, held = [], [], 0
        if ids:
            yield flush()

    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("binary").alias("t"))
    packed = rows.mapInArrow(run, "block long, n_bytes long, ids array<long>, ends array<long>, data binary")
    # two blocks of the same rows would share an id that is of their content alone
    return packed.withColumn("block", F.col("block").bitwiseXOR(F.monotonically_increasing_id()))


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Rows one at a time: a batch may hold many blocks."""
    for batch in batches:
        for k in range(batch.num_rows):
            yield batch.slice(k, 1).to_pylist()[0]


def _opened(row: dict, width: int) -> tuple[bytes, np.ndarray, list, np.ndarray, tuple[np.ndarray, ...]]:
    data, ends = row["data"] or b"", np.array(row["ends"] or [], np.int64)
    buf = _padded(data)
    found = sampled(buf, ends, width)
    if None in row["ids"]:
        known = np.array([i is not None for i in row["ids"]])
        found = tuple(x[known[found[3]]] for x in found)
    return data, buf, row["ids"], ends, found


def _arrays(table: DataFrame, shards: int, width: int) -> DataFrame:
    """``shard, block, n, b``: each block's suffix array, dealt over shards, with how many of its documents have each suffix."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            _, buf, _, _, (at, _, _, doc) = _opened(row, width)
            keys, many, _ = suffix_array(buf, at, doc)
            home = _home(keys, shards)
            rows = []
            for s in np.unique(home):
                k = home == s
                rows.append((int(s), row["block"], int(k.sum()), _pack(*keys[k].T, np.minimum(many[k], 255).astype(np.uint8))))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["shard", "block", "n", "b"])

    return table.select("block", "ids", "ends", "data").mapInArrow(run, _SCHEMA)


def _home(keys: np.ndarray, shards: int) -> np.ndarray:
    h = keys[:, 0] * _M[3]
    for j in range(1, keys.shape[1]):
        h = _mix(h) + keys[:, j] * _M[3 + j]
    return (_mix(h) % np.uint64(shards)).astype(np.int64)


def _by_shard(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, Iterator[tuple]]]:
    """Rows of each shard in turn, of batches that are sorted by shard."""
    rows = (tuple(c[k].as_py() for c in b.columns) for b in batches for k in range(b.num_rows))
    yield from groupby(rows, key=lambda r: r[0])


def _index(arrays: DataFrame, shards: int, hot: int) -> DataFrame:
    """``shard, block, n, b``: for each row of ``arrays`` what its suffixes are: of one document 0, of several 1, of very many 2."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, rows in _by_shard(batches):
            index, seen, held = Levels(), [], []
            counts = np.zeros(0, np.int64)

            def push():
                nonlocal counts
                keys = np.concatenate([k for _, k, _ in held])
                many = np.concatenate([m for _, _, m in held])
                order = _order(keys)
                fresh = _fresh(keys[order])
                slots = np.empty(len(keys), np.int64)
                slots[order] = index.add(keys[order][fresh])[np.cumsum(fresh) - 1]
                counts = np.concatenate([counts, np.zeros(index.slots - len(counts), np.int64)])
                counts += np.bincount(slots, many, len(counts)).astype(np.int64)
                at = 0
                for block, k, _ in held:
                    seen.append((block, slots[at : at + len(k)].astype(np.int32)))
                    at += len(k)
                held.clear()

            waiting = 0
            for _, block, n, b in rows:
                *words, many = _unpack(b, n, *["u8"] * _WORDS, "u1")
                held.append((block, np.stack(words, 1), many))
                waiting += n
                if waiting >= BATCH:
                    push()
                    waiting = 0
            if held:
                push()
            del index
            for block, slots in seen:
                c = counts[slots]
                b = _pack(((c > 1).astype(np.uint8) + (c > hot)).astype(np.uint8))
                yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((shard, block, len(slots), b), (pa.int32(), pa.int64(), pa.int32(), pa.binary()))], names=["shard", "block", "n", "b"])

    return arrays.repartitionById(shards, "shard").sortWithinPartitions("shard", "block").mapInArrow(run, _SCHEMA)


def _segments(table: DataFrame, shards: int, width: int) -> DataFrame:
    """``shard, block, n, b, text``: round suffixes of several documents, text that holds all strings which sample them.

    A segment goes out once a block, with the smallest id that has it; where larger ids have
    it, all its strings are repeats: that is the row of shard -1.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, buf, ids, _, (at, first, many, doc) = _opened(row, width)
            if not len(at):
                continue
            keys, _, which = suffix_array(buf, at, doc)
            home, verdict = _home(keys, shards), np.zeros(len(keys), np.uint8)
            for s in row["said"] or []:
                verdict[home == s["shard"]] = _unpack(s["b"], s["n"], "u1")[0]
            kind = verdict[which]
            cold, hot = kind == 1, kind == 2
            copies = many[hot]
            one = np.repeat(first[hot], copies) + (np.arange(copies.sum()) - np.repeat(np.cumsum(copies) - copies, copies))
            start = np.concatenate([first[cold], one])
            count = np.concatenate([many[cold], np.ones(len(one), np.int64)])
            place = np.concatenate([home[which[cold]], np.full(len(one), -1)])
            owner = np.concatenate([doc[cold], np.repeat(doc[hot], copies)])
            least: dict[bytes, int] = {}
            texts = [data[a : a + m + width - 1] for a, m in zip(start.tolist(), count.tolist())]
            owners = [ids[d] for d in owner.tolist()]
            for t, i in zip(texts, owners):
                if i < least.setdefault(t, i):
                    least[t] = i
            own = np.array([least[t] == i for t, i in zip(texts, owners)], bool)
            where = [p if p >= 0 else xxhash.xxh64_intdigest(t) % shards for p, t in zip(place.tolist(), texts)]
            where = np.where(own, where, -1) if len(where) else np.zeros(0, np.int64)
            # equal and like texts next to each other
            rank = {t: k for k, t in enumerate(sorted(least))}
            ranks = np.array([rank[t] for t in texts], np.int64)
            owner_ids = np.array(owners, np.int64)
            rows = []
            for s in np.unique(where):
                k = np.flatnonzero(where == s)
                k = k[np.argsort(ranks[k], kind="stable")]
                body = b"" if s < 0 else zstandard.ZstdCompressor(level=1).compress(b"".join([texts[j] for j in k]))
                rows.append((int(s), row["block"], len(k), _pack(start[k].astype(np.int64), count[k].astype(np.uint8), owner_ids[k]), body))
            if rows:
                types = (pa.int32(), pa.int64(), pa.int32(), pa.binary(), pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows), types)], names=["shard", "block", "n", "b", "text"])

    return table.mapInArrow(run, _SCHEMA + ", text binary")


def _fingerprints(buf: np.ndarray, at: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of the ``width``-byte strings at ``at``."""
    words, piece = _words(buf), 1 << 14
    a, b = np.empty(len(at), np.uint64), np.empty(len(at), np.uint64)
    for lo in range(0, len(at), piece):  # what a cache holds at a time
        some, x, y = at[lo : lo + piece], np.uint64(0), np.uint64(0)
        for k, j in enumerate([*range(0, width - 8, 8), width - 8]):
            w = _mix(words[some + j].astype(np.uint64) * _M[k % 7])
            x, y = x * _M[4] + w, y * _M[5] + (w ^ (w >> np.uint64(31)))
        a[lo : lo + piece], b[lo : lo + piece] = _mix(x), y
    return a, b


def _least(h: np.ndarray, g: np.ndarray, owner: np.ndarray) -> np.ndarray:
    """The smallest owner of each fingerprint, in place of each."""
    order = np.argsort(h)
    if (g[order[1:]] != g[order[:-1]])[h[order[1:]] == h[order[:-1]]].any():  # equal halves of different prints
        order = np.lexsort((g, h))
    x, y = h[order], g[order]
    start = np.flatnonzero(np.r_[True, (x[1:] != x[:-1]) | (y[1:] != y[:-1])])
    out = np.empty_like(owner)
    out[order] = np.repeat(np.minimum.reduceat(owner[order], start), np.diff(np.r_[start, len(owner)]))
    return out


def _repeats(segments: DataFrame, shards: int, width: int) -> DataFrame:
    """``block, n, b``: starts of the strings of segments that a smaller id has."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _by_shard(batches):
            parts, body, size, place = [], [], 0, []
            for k, (_, block, n, b, text) in enumerate(rows):
                start, count, owner = _unpack(b, n, "i8", "u1", "i8")
                many = count.astype(np.int64)
                into = size + np.cumsum(many + width - 1) - (many + width - 1)
                within = np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)
                place.append(np.repeat(into, many) + within)
                parts.append((block, np.repeat(start, many) + within, np.repeat(owner, many)))
                body.append(zstandard.ZstdDecompressor().decompress(text))
                size += len(body[-1])
            buf = _padded(b"".join(body))
            del body
            h, g = _fingerprints(buf, np.concatenate(place), width)
            del place
            owner = np.concatenate([p[2] for p in parts])
            again = owner > _least(h, g, owner)
            at = 0
            for block, start, _ in parts:
                hit = np.sort(start[again[at : at + len(start)]])
                at += len(start)
                if len(hit):
                    cut = np.flatnonzero(np.r_[True, hit[1:] != hit[:-1] + 1])
                    n = np.diff(np.r_[cut, len(hit)])
                    yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip((block, len(cut), _pack(hit[cut], n)), (pa.int64(), pa.int32(), pa.binary()))], names=["block", "n", "b"])

    dealt = segments.where("shard >= 0").repartitionById(shards, "shard").sortWithinPartitions("shard", "block")
    return dealt.mapInArrow(run, "block long, n int, b binary")


def _cut(table: DataFrame, width: int, schema: str, result) -> DataFrame:
    """``result(id, text, spans)`` as rows, for each document of ``table(ids, ends, data, own, said)``; spans of what goes, from and to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for row in _rows(batches):
            data, rows, from_ = row["data"] or b"", [], 0
            hit = np.zeros(len(data) + 1, np.int32)
            for s in row["own"] or []:
                start, count, _ = _unpack(s["b"], s["n"], "i8", "u1", "i8")
                np.add.at(hit, start, 1)
                np.add.at(hit, start + count + (width - 1), -1)
            for s in row["said"] or []:
                start, count = _unpack(s["b"], s["n"], "i8", "i8")
                np.add.at(hit, start, 1)
                np.add.at(hit, start + count + (width - 1), -1)
            gone = np.cumsum(hit)[:-1] > 0
            for i, end in zip(row["ids"], row["ends"]):
                edge = np.flatnonzero(np.diff(gone[from_:end].astype(np.int8), prepend=0, append=0))
                rows.append(result(i, data[from_:end], edge.reshape(-1, 2).tolist()))
                from_ = end
            yield pa.RecordBatch.from_pylist(rows, schema)

    spark_schema = ", ".join(f"{f.name} {'binary' if f.type == pa.binary() else 'string' if f.type == pa.string() else 'long'}" for f in schema)
    return table.mapInArrow(run, spark_schema)


def _digest(i, text: bytes, spans: list) -> dict:
    kept, at = [], 0
    for a, b in spans:
        kept.append(text[at:a])
        at = b
    kept.append(text[at:])
    removed = sum(b - a for a, b in spans)
    return {"doc_id": i, "n_bytes": len(text), "n_removed": removed, "n_spans": len(spans), "kept_sha256": hashlib.sha256(b"".join(kept)).hexdigest()}


_DIGEST = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_removed", pa.int64()), ("n_spans", pa.int64()), ("kept_sha256", pa.string())])


def _kept(i, text: bytes, spans: list) -> dict:
    out, at = [], 0
    for a, b in spans:
        out.append(text[at:a])
        at = b
    return {"doc_id": i, "kept": b"".join([*out, text[at:]])}


_KEPT = pa.schema([("doc_id", pa.int64()), ("kept", pa.binary())])


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WIDTH, digests: bool = False, block: int = BLOCK, shard: int = SHARD, hot: int = HOT) -> DataFrame:
    """``doc_id, kept``: each text without the bytes that a ``width``-byte string of a smaller id covers, as UTF-8 bytes.

    With ``digests`` ``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` in its place. ``width`` is ``DEPTH`` + 1 to 255.
    One row per row of ``docs``. Null texts are empty; rows without an id take no part and keep their text whole, and of
    rows that share an id none is smaller. A text of any length is compared whole, in a block of its own. An empty table
    gives no rows; other columns are not read.
    """
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    if not DEPTH < width < 256:
        raise ValueError(f"width must be {DEPTH + 1} to 255")
    # texts stay where they were written: what is said of a block comes to its bucket
    name = f"blocks_{new_path(spark, 'x')[-12:]}"
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    blocks(docs, id_col, text_col, block).write.bucketBy(buckets, "block").option("path", new_path(spark, name)).option("compression", "zstd").option("parquet.block.size", 8 << 20).saveAsTable(name)
    table = spark.table(name)
    total = table.agg(F.sum("n_bytes")).first()[0] or 0
    shards = max(1, -(-total // shard))
    said = _index(_arrays(table, shards, width), shards, hot)
    said = said.groupBy("block").agg(F.collect_list(F.struct("shard", "n", "b")).alias("said"))
    said = scratch.table(said, "said")
    segments = scratch.table(_segments(table.join(said.hint("shuffle_hash"), "block").select("block", "ids", "ends", "data", "said"), shards, width), "segments")
    scratch.drop("said")
    own = segments.where("shard < 0").select("block", F.struct("n", "b").alias("own"), F.lit(None).cast("struct<n:int,b:binary>").alias("other"))
    other = _repeats(segments, shards, width).select("block", F.lit(None).cast("struct<n:int,b:binary>").alias("own"), F.struct("n", "b").alias("other"))
    spans = own.union(other).groupBy("block").agg(F.collect_list("own").alias("own"), F.collect_list("other").alias("said"))
    spans = scratch.table(spans, "spans")
    scratch.drop("segments")
    found = table.join(spans.hint("shuffle_hash"), "block", "left").select("ids", "ends", "data", "own", "said")
    return _cut(found, width, _DIGEST if digests else _KEPT, _digest if digests else _kept)
