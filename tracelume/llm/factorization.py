"""Quality classifier: a factorisation machine over hashed words, structure and metadata.

Features of a text are its words, hashed into ``BUCKETS`` and scaled to unit length,
and indicator bins of structure statistics and of its length as recorded. A pairwise
interaction is the product of two features' low-rank factors; their sum over all
pairs is half of (the sum squared, less the squares' sum) per factor, so a text is
scored in time linear in its features.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tracelume.llm.text import crc32_text

BUCKETS, RANK, EPOCHS, BATCH, RATE, DECAY = 1 << 14, 4, 6, 128, 0.08, 1e-5
#: Labelled documents that the model is fitted on at most: those whose id hashes lowest.
SAMPLE = 10_000
#: Score from which a document is predicted to be of label 1.
CUT = 0.7
_BINS, _STATS = 16, 10
SIZE = BUCKETS + _BINS * _STATS
_SYMBOLS, _DIGITS = b"#*$%&|<>", b"0123456789"
_UPPER = bytes(range(65, 91))
_MEMO = 400_000


class _Buckets(dict):
    def __missing__(self, word: bytes) -> int:
        out = xxhash.xxh64_intdigest(word) % BUCKETS
        if len(word) <= 64:
            if len(self) >= _MEMO:
                self.clear()
            self[word] = out
        return out


def features(data: bytes | None, n_chars: int | None, buckets: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Places and values of a text's features."""
    data = data or b""
    words = data.lower().split()
    n = len(words)
    codes = np.fromiter(map(buckets.__getitem__, words), np.int64, n)
    at, counts = np.unique(codes, return_counts=True)
    value = np.sqrt(counts)
    value = value / max(1e-9, np.sqrt(counts.sum()))
    size, d = max(1, len(data)), max(1, n)
    lines = [x for x in data.split(b"\n") if x.strip()]
    less = lambda drop: len(data) - len(data.translate(None, drop))
    share = lambda x: min(_BINS - 1, int(np.sqrt(max(0.0, min(1.0, x))) * _BINS))
    log = lambda x: min(_BINS - 1, int(np.log2(1 + max(0, x))))
    pairs = len(np.unique(codes[1:] * BUCKETS + codes[:-1])) if n > 1 else 0
    bins = [
        log(n),
        0 if n_chars is None else min(_BINS - 1, 1 + int(np.log2(1 + max(0, n_chars)) / 1.5)),
        share(less(_SYMBOLS) / size * 4),
        share(less(_DIGITS) / size),
        share(less(_UPPER) / size),
        share(float((codes[1:] == codes[:-1]).sum()) / d),
        share(len(at) / d),
        share(pairs / d),
        share(1 - len(set(lines)) / max(1, len(lines))),
        min(_BINS - 1, int(len(data) / d)),
    ]
    place = BUCKETS + np.arange(_STATS) * _BINS + np.array(bins)
    return np.concatenate([at, place]), np.concatenate([value, np.full(_STATS, 0.5)])


def _sums(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    return np.add.reduceat(values, starts, axis=0)


class Machine:
    def __init__(self, prior: float = 0.5):
        rng = np.random.default_rng(7)
        self.b = float(np.log(prior / (1 - prior)))
        self.w = np.zeros(SIZE, np.float32)
        self.v = (rng.standard_normal((SIZE, RANK)) * 0.05).astype(np.float32)

    def margins(self, at: np.ndarray, x: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        vx = self.v[at] * x[:, None]
        s = _sums(vx, starts)
        return self.b + _sums(self.w[at] * x, starts) + 0.5 * (s * s - _sums(vx * vx, starts)).sum(1), s

    def fit(self, rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> Machine:
        """Logistic loss by AdaGrad over shuffled batches, in an order fixed by the rows' order."""
        rng = np.random.default_rng(11)
        gw, gv, gb = np.full(SIZE, 1e-6), np.full((SIZE, RANK), 1e-6), 1e-6
        for _ in range(EPOCHS):
            order = rng.permutation(len(rows))
            for k in range(0, len(order), BATCH):
                pick = order[k : k + BATCH]
                n = np.array([len(rows[i][0]) for i in pick])
                starts = np.cumsum(n) - n
                at, x = np.concatenate([rows[i][0] for i in pick]), np.concatenate([rows[i][1] for i in pick])
                z, s = self.margins(at, x, starts)
                e = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[pick]) / len(pick)
                each = np.repeat(e, n) * x
                dw = np.bincount(at, each, SIZE)
                near = each[:, None] * (np.repeat(s, n, axis=0) - self.v[at] * x[:, None])
                dv = np.stack([np.bincount(at, near[:, f], SIZE) for f in range(RANK)], 1)
                dw += DECAY * self.w
                dv += DECAY * self.v
                db = e.sum()
                gw += dw * dw
                gv += dv * dv
                gb += db * db
                self.w -= (RATE * dw / np.sqrt(gw)).astype(np.float32)
                self.v -= (RATE * dv / np.sqrt(gv)).astype(np.float32)
                self.b -= RATE * db / np.sqrt(gb)
        return self


def _featured(batch: pa.RecordBatch, buckets: dict[bytes, int], step: int = 256) -> Iterator[tuple[pa.RecordBatch, list[tuple[np.ndarray, np.ndarray]]]]:
    """Pieces of a batch and their features; columns b and n_chars are the last two."""
    for k in range(0, batch.num_rows, step):
        piece = batch.slice(k, step)
        yield piece, [features(t.as_py(), c, buckets) for t, c in zip(piece.column(piece.num_columns - 2), piece.column(piece.num_columns - 1).to_pylist())]


def fit(docs: DataFrame, labels: DataFrame, id_col: str, label_col: str, sample: int = SAMPLE) -> Machine:
    """``docs``: id, b, n_chars. Labels of one id that disagree count by their majority, ties as 1; null labels are left out."""
    label = (F.avg(F.col(label_col).cast("double")) >= 0.5).cast("int").alias("y")
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).cast("long").alias("id")).agg(label)
    chosen = known.orderBy(F.xxhash64("id"), "id").limit(sample)  # bounded by ``sample``: what is broadcast here
    rows = docs.join(F.broadcast(chosen), "id").select("id", "y", "b", "n_chars")

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            for piece, f in _featured(batch, buckets):
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), pa.array([a.tolist() for a, _ in f], pa.list_(pa.int32())), pa.array([x.tolist() for _, x in f], pa.list_(pa.float32()))],
                    names=["id", "y", "at", "x"],
                )

    def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, y, ids = [], [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            y += b.column(1).to_pylist()
            rows += [(a.values.to_numpy().astype(np.int64), x.values.to_numpy()) for a, x in zip(b.column(2), b.column(3))]
        order = sorted(range(len(ids)), key=lambda i: (ids[i], len(rows[i][0]), rows[i][0].tobytes()))  # whatever way the rows came
        if rows:
            labels = np.array([y[i] for i in order], np.float64)
            machine = Machine((labels.sum() + 1) / (len(labels) + 2)).fit([rows[i] for i in order], labels)
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(machine)])], names=["model"])

    found = rows.mapInArrow(featured, "id long, y int, at array<int>, x array<float>").repartition(1).mapInArrow(learn, "model binary").collect()
    return pickle.loads(found[0].model) if found else Machine()


def scored(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars", label_col: str = "quality", folds: int = 4, fold: int = 2, sample: int = SAMPLE) -> DataFrame:
    """A row per document: doc_id, held_out, score, predicted.

    Learns only from labelled documents that are not held out, ``sample`` of them at
    most. A null or empty text has its statistics only, a null ``chars_col`` a bin of its
    own. Without labels scores are near a half. Rows with null ids are scored and never
    learned from. Repeated rows are each scored; an empty table gives an empty result.
    """
    held_out = crc32_text(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold
    rows = docs.select(F.col(id_col).cast("long").alias("id"), held_out.alias("held_out"), F.col(text_col).cast("binary").alias("b"), F.col(chars_col).cast("long").alias("n_chars"))
    train = labels.where(~(crc32_text(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold))
    machine = docs.sparkSession.sparkContext.broadcast(fit(rows, train, id_col, label_col, sample))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = _Buckets()
        for batch in batches:
            for piece, f in _featured(batch, buckets):
                n = np.array([len(a) for a, _ in f])
                z, _ = machine.value.margins(np.concatenate([a for a, _ in f]), np.concatenate([x for _, x in f]), np.cumsum(n) - n)
                p = 1 / (1 + np.exp(-np.clip(z.astype(np.float64), -30, 30)))
                yield pa.RecordBatch.from_arrays([piece.column(0), piece.column(1), pa.array(p), pa.array((p >= CUT).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return rows.mapInArrow(run, "doc_id long, held_out boolean, score double, predicted int")
