"""Brown class-based bigram model: exchange clustering, transitions, emissions.

All tokens of the training documents are counted. Of the ``HEAD`` most frequent words each
is a unit; all others are units by hash, ``SLOTS`` of them, as a table of any vocabulary
must fit an executor. Documents are encoded once to units and all passes read those.

Clustering has two parts. The ``CLUSTERED`` most frequent words are assigned to classes by
exchange: each in turn moves to the class that most raises the likelihood of the class
bigrams, over several sweeps. Every other unit is then moved once by the same measure, in a
distributed pass: how often it stands before and behind each class is counted over the
whole corpus, and it joins the class that makes these neighbours likeliest. So every word
has a class that its contexts chose, and one without any known neighbour, or never seen, has
the class of the unmet. Class bigrams of all tokens are then counted with these classes.

The probability of a token is that of its class after the class before it, times that of
the word in its class; both are smoothed, and each class keeps room for one unseen word.
The counts of words outside the head, unbounded in number, stay in a distributed table.
They enter a document's score as a sum over its words, so a join by word and a sum by
document give it without moving texts.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tracelume.llm.scratch import Scratch
from tracelume.llm.text import crc32_text

HEAD, CLUSTERED, CLASSES, SWEEPS, SLOTS = 131_072, 1_500, 48, 4, 1 << 20
#: Least count of a head word: what is hardly seen shares a unit.
SEEN = 3
#: Weight of the classes' own frequencies in each row of transitions.
PRIOR = 8.0
_FLUSH = 400_000
_DOCS = 256


def word_key(word: bytes) -> int:
    """Positive 63-bit key: XXH64 less a bit."""
    return xxhash.xxh64_intdigest(word) >> 1


def split(data: bytes | None) -> list[bytes]:
    return (data or b"").lower().split()


def held_out(id_col: str, folds: int = 5, fold: int = 1) -> Column:
    """Whether crc32 of the id as text leaves ``fold``; a null id counts as empty text."""
    return crc32_text(F.coalesce(F.col(id_col).cast("string"), F.lit(""))) % folds == fold


def count_words(train: DataFrame) -> DataFrame:
    """``key, c`` over the binary column ``b``, combined in each task before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[bytes] = Counter()

        def flush() -> pa.RecordBatch:
            keys = np.fromiter(map(word_key, held), np.int64, len(held))
            out = pa.RecordBatch.from_arrays([pa.array(keys), pa.array(np.fromiter(held.values(), np.int64, len(held)))], names=["key", "c"])
            held.clear()
            return out

        for b in batches:
            for x in b.column(0):
                held.update(split(x.as_py()))
                if len(held) >= _FLUSH:
                    yield flush()
        yield flush()

    return train.select("b").mapInArrow(run, "key long, c long").groupBy("key").agg(F.sum("c").alias("c"))


@dataclass
class Model:
    """Units are head words by place, ascending by key, then the end, then slots."""

    keys: np.ndarray  # of the head
    counts: np.ndarray
    ranks: np.ndarray  # frequency rank of each head word
    end_count: int  # training documents
    total: int  # N
    distinct: int  # V
    clustered: int  # the most frequent words, which are exchanged
    slots: int
    classes: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int16))  # of each unit
    transition: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))  # log10
    class_norm: np.ndarray = field(default_factory=lambda: np.zeros(0))  # log10 of each class's emission divisor

    @property
    def end(self) -> int:
        return len(self.keys)

    @property
    def units(self) -> int:
        return self.end + 1 + self.slots

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return self.end + 1 + (keys & (self.slots - 1))

    def unit(self, keys: np.ndarray) -> np.ndarray:
        """Unit of each key."""
        if not self.end:
            return self.slot(keys)
        at = np.minimum(np.searchsorted(self.keys, keys), self.end - 1)
        return np.where(self.keys[at] == keys, at, self.slot(keys))


class _Codes(dict):
    """A head word's place, or minus the key less one."""

    def __init__(self, keys: np.ndarray):
        super().__init__()
        self.place = dict(zip(keys.tolist(), range(len(keys))))

    def __missing__(self, word: bytes) -> int:
        key = word_key(word)
        code = self.place.get(key, -key - 1)
        if len(word) <= 64:
            if len(self) >= _FLUSH:
                self.clear()
            self[word] = code
        return code


def encoded(rows: DataFrame, held) -> DataFrame:
    """``doc_id, held_out, units, tail``: units of all tokens of ``rows(doc_id, held_out, b)``, the end last, and keys of those outside the head."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        codes = _Codes(m.keys)
        for b in batches:
            for at in range(0, b.num_rows, _DOCS):
                piece = b.slice(at, _DOCS)
                words = [split(x.as_py()) for x in piece.column(2)]
                n = np.array(list(map(len, words)), np.int64)
                flat = np.fromiter((c for w in words for c in map(codes.__getitem__, w)), np.int64, n.sum())
                out = flat < 0
                tail = -flat[out] - 1
                flat[out] = m.slot(tail)
                ends = np.cumsum(n + 1)
                units = np.full(ends[-1], m.end, np.int32)
                keep = np.ones(len(units), bool)
                keep[ends - 1] = False
                units[keep] = flat
                stops = np.concatenate([[0], np.cumsum(out)])[np.concatenate([[0], np.cumsum(n)])]
                lists = [(np.concatenate([[0], ends]), units), (stops, tail)]
                yield pa.RecordBatch.from_arrays(
                    [piece.column(0), piece.column(1), *[pa.ListArray.from_arrays(pa.array(o.astype(np.int32)), pa.array(v)) for o, v in lists]], names=["doc_id", "held_out", "units", "tail"]
                )

    return rows.select("doc_id", "held_out", "b").mapInArrow(run, "doc_id long, held_out boolean, units array<int>, tail array<long>")


def _tokens(column: pa.ListArray, end: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All units of a batch, the unit before each (a text begins after an end), and where each text begins."""
    at = column.offsets.to_numpy()
    units = column.values.to_numpy(zero_copy_only=False)[at[0] : at[-1]]
    before = np.empty_like(units)
    before[1:] = units[:-1]
    starts = (at[:-1] - at[0]).astype(np.int64)
    before[starts] = end
    return units, before, starts


def count_pairs(texts: DataFrame, held, of: str, size: int) -> DataFrame:
    """``pair, c``: bigrams of ``units`` by the symbols that the array ``of`` of the model gives, as first * size + second, or none where one is -1; at most size squared rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        symbols = getattr(m, of).astype(np.int64)
        sums = np.zeros(size * size, np.int64)
        for b in batches:
            units, before, _ = _tokens(b.column(0), m.end)
            x, y = symbols[before], symbols[units]
            pair, n = np.unique((x * size + y)[(x >= 0) & (y >= 0)], return_counts=True)
            sums[pair] += n
        some = np.flatnonzero(sums)
        for at in range(0, len(some), 1 << 17):
            k = some[at : at + (1 << 17)]
            yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(sums[k])], names=["pair", "c"])

    return texts.select("units").mapInArrow(run, "pair long, c long").groupBy("pair").agg(F.sum("c").alias("c"))


def _square(pairs: DataFrame, size: int) -> np.ndarray:
    """A table of at most ``size`` squared rows as a matrix."""
    found, out = pairs.toArrow(), np.zeros(size * size)
    out[found["pair"].to_numpy()] = found["c"].to_numpy()
    return out.reshape(size, size)


def _xlogx(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300))


def exchange(bigrams: np.ndarray, movable: int, classes: int, sweeps: int = SWEEPS) -> np.ndarray:
    """Class of each symbol. The first ``movable`` are exchanged over ``classes``; each other keeps a class of its own."""
    size = len(bigrams)
    k = min(classes, movable) if movable else 0
    of = np.concatenate([np.arange(movable) % max(k, 1), k + np.arange(size - movable)]).astype(np.int64)
    n = k + size - movable
    g = np.zeros((n, n))
    np.add.at(g, (of[:, None], of[None, :]), bigrams)
    for _ in range(sweeps):
        moved = 0
        for w in range(movable):
            right = np.bincount(of, bigrams[w], n)
            left = np.bincount(of, bigrams[:, w], n)
            own, a = bigrams[w, w], of[w]
            g[a] -= right
            g[:, a] -= left
            g[a, a] += own
            right[a] -= own
            left[a] -= own
            rows, cols = g[:k], g[:, :k].T
            gain = (_xlogx(rows + right) - _xlogx(rows)).sum(1) + (_xlogx(cols + left) - _xlogx(cols)).sum(1)
            i = np.arange(k)
            d = g[i, i]
            gain -= _xlogx(d + right[:k]) + _xlogx(d + left[:k]) - 2 * _xlogx(d)
            gain += _xlogx(d + right[:k] + left[:k] + own) - _xlogx(d)
            r, c = g.sum(1)[:k], g.sum(0)[:k]
            gain -= _xlogx(r + right.sum() + own) - _xlogx(r) + _xlogx(c + left.sum() + own) - _xlogx(c)
            b = int(np.argmax(gain))
            b = a if gain[b] <= gain[a] + 1e-9 else b
            g[b] += right
            g[:, b] += left
            g[b, b] += own
            of[w] = b
            moved += b != a
        if not moved:
            break
    return of


def smoothed(g: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Probabilities of a class after another, and the classes' own, from counts of class bigrams."""
    prior = (g.sum(0) + 1) / (g.sum() + len(g))
    return (g + PRIOR * prior) / (g.sum(1, keepdims=True) + PRIOR), prior


def assigned(texts: DataFrame, held, core: np.ndarray, g: np.ndarray, movable: int) -> DataFrame:
    """``unit, class`` of every unit with a neighbour of known class (``core`` of each unit, -1 unknown): of the first ``movable`` classes the one that makes its neighbours likeliest.

    What is gathered grows with the corpus up to each unit's two rows of classes; it is dealt by unit.
    """
    size = len(g)
    after, prior = smoothed(g)
    # of a class: what standing behind, and before, each other class is worth
    worth = np.concatenate([np.log(after / prior), np.log(after / prior).T])[:, :movable]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m, of = held.value
        of = of.astype(np.int64)
        for b in batches:
            units, before, starts = _tokens(b.column(0), m.end)
            here, left = of[units], of[before]
            right = np.full(len(units), -1, np.int64)
            right[:-1] = here[1:]
            right[starts[1:] - 1] = -1
            unknown = here < 0
            a, c = unknown & (left >= 0), unknown & (right >= 0)
            u = units.astype(np.int64) * (2 * size)
            pair, n = np.unique(np.concatenate([u[a] + left[a], u[c] + size + right[c]]), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array((pair // (2 * size)).astype(np.int32)), pa.array((pair % (2 * size)).astype(np.int32)), pa.array(n.astype(np.int64))], names=["unit", "side", "c"])

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held_rows: dict[int, int] = {}
        sums = np.zeros((1024, 2 * size))
        for b in batches:
            unit, side, c = (x.to_numpy() for x in b.columns)
            some, at = np.unique(unit, return_inverse=True)
            places = np.array([held_rows.setdefault(u, len(held_rows)) for u in some.tolist()], np.int64)
            while len(held_rows) > len(sums):
                sums = np.concatenate([sums, np.zeros_like(sums)])
            np.add.at(sums, (places[at], side), c)
        n = len(held_rows)
        for at in range(0, n, 1 << 14):
            best = (sums[at : min(n, at + (1 << 14))] @ worth).argmax(1)
            yield pa.RecordBatch.from_arrays([pa.array(list(held_rows)[at : at + len(best)], pa.int32()), pa.array(best.astype(np.int32))], names=["unit", "class"])

    pairs = texts.select("units").mapInArrow(count, "unit int, side int, c long")
    return pairs.repartition("unit").mapInArrow(choose, "unit int, class int")


def _class_sizes(counts: DataFrame, held, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Tokens and distinct words of each class, without the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        for b in batches:
            k = m.classes[m.unit(b.column(0).to_numpy())]
            tokens, kinds = np.bincount(k, b.column(1).to_numpy(), n), np.bincount(k, minlength=n)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(n)), pa.array(tokens.astype(np.int64)), pa.array(kinds)], names=["k", "tokens", "kinds"])

    found = counts.select("key", "c").mapInArrow(run, "k long, tokens long, kinds long").groupBy("k").agg(F.sum("tokens").alias("tokens"), F.sum("kinds").alias("kinds")).collect()  # a row per class
    sizes = np.zeros((2, n))
    for r in found:
        sizes[:, r.k] = r.tokens, r.kinds
    return sizes[0], sizes[1]


def fit(scratch: Scratch, rows: DataFrame, head: int = HEAD, clustered: int = CLUSTERED, classes: int = CLASSES, slots: int = SLOTS) -> tuple[Model, DataFrame, DataFrame]:
    """The model, the table ``key, c`` of all words of the training ``rows(doc_id, held_out, b)``, and all rows as :func:`encoded`. ``slots`` is a power of two."""
    spark = rows.sparkSession
    send = spark.sparkContext.broadcast
    train = rows.where("not held_out")
    counts = scratch.table(count_words(train), "counts")
    end = train.count()
    top = counts.where(F.col("c") >= SEEN).orderBy(F.desc("c"), "key").limit(head).toArrow()  # bounded by ``head``; in columns, as rows of Python take several times that
    n, v = counts.agg(F.sum("c"), F.count("*")).first()
    order = np.argsort(top["key"].to_numpy(), kind="stable")
    keys, c = top["key"].to_numpy()[order], top["c"].to_numpy()[order]
    model = Model(keys, c, order, end, (n or 0) + end, v + (end > 0), min(clustered, len(keys)), slots)
    texts = scratch.table(encoded(rows, send(model)), "encoded")
    learn = texts.where("not held_out")
    # exchange of the most frequent words, beside the end
    m = model.clustered
    core = np.full(model.units, -1, np.int32)
    core[: model.end] = np.where(model.ranks < m, model.ranks, -1)
    core[model.end] = m
    model.classes = core
    of = exchange(_square(count_pairs(learn, send(model), "classes", m + 1), m + 1), m, classes)
    model.classes = np.where(core >= 0, of[core], -1).astype(np.int16)
    k = int(of[m])
    if k:  # every other unit by its neighbours
        g = _square(count_pairs(learn, send(model), "classes", k + 1), k + 1)
        found = assigned(learn, send((model, model.classes)), model.classes, g, k).toArrow()  # bounded by the units
        model.classes = model.classes.copy()
        model.classes[found["unit"].to_numpy()] = found["class"].to_numpy().astype(np.int16)
    model.classes[model.classes < 0] = k + 1
    g = _square(count_pairs(learn, send(model), "classes", k + 2), k + 2)
    model.transition = np.log10(smoothed(g)[0])
    tokens, kinds = _class_sizes(counts, send(model), k + 2)
    tokens[k] += end
    kinds[k] += 1
    model.class_norm = np.log10(tokens + 0.5 * (kinds + 1))
    return model, counts, texts


def scored(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", folds: int = 5, fold: int = 1, **sizes: int) -> DataFrame:
    """A row per document: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity.

    Words are lower-cased (A-Z) and split at ASCII white space, and an end follows; a
    null or empty text is its end alone. Scores are log10 probabilities of the text, the
    base of its tokens one by one; perplexity is that of the text by the model, per token. Ties
    of frequency are ordered by the word's key. Learns from documents that are not held out; with
    none, all tokens are unseen. Words and texts of any length are read whole. Null ids
    train. Repeated rows count and score each time. An empty table gives an empty result. Other columns are not
    read, whatever their names.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("binary").alias("b"), held_out(id_col, folds, fold).alias("held_out"))
    model, counts, texts = fit(scratch, rows, **sizes)
    held = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = held.value
        # of each unit: log10 of its count, none for slots, whose words are joined
        known = np.zeros(m.units)
        known[: m.end + 1] = np.log10(np.concatenate([m.counts, [m.end_count]]) + 0.5)
        base_norm = np.log10(m.total + 0.5 * (m.distinct + 1))
        classes = m.classes.astype(np.int64)
        for b in batches:
            units, before, starts = _tokens(b.column(2), m.end)
            k = classes[units]
            move = m.transition[classes[before], k] - m.class_norm[k]
            count = known[units]
            tails = np.add.reduceat((units > m.end).astype(np.int64), starts)
            lengths = np.diff(np.append(starts, len(units)))
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(1),
                    pa.array(lengths.astype(np.int64)),
                    pa.array((lengths - 1 - tails + int(m.end_count > 0)).astype(np.int64)),
                    pa.array(np.add.reduceat(count, starts) - lengths * base_norm),
                    pa.array(np.add.reduceat(count + move, starts)),
                    b.column(3),
                ],
                names=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score", "tail"],
            )

    schema = "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, tail array<long>"
    parts = texts.select("doc_id", "held_out", "units", "tail").mapInArrow(run, schema)
    parts = scratch.table(parts.withColumn("row", F.monotonically_increasing_id()), "parts")
    words = parts.select("row", F.explode("tail").alias("key"))
    logs = words.join(counts, "key", "left").select("row", F.log10(F.coalesce("c", F.lit(0)) + 0.5).alias("log"), F.col("c").isNotNull().cast("long").alias("known"))
    sums = scratch.table(logs.groupBy("row").agg(F.sum("log").alias("log"), F.sum("known").alias("known")), "sums")
    out = parts.drop("tail").join(sums, "row", "left")
    log = F.coalesce("log", F.lit(0.0))
    score = F.col("score") + log
    return out.select(
        "doc_id",
        "held_out",
        "n_tokens",
        (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + log).alias("base_score"),
        score.alias("score"),
        F.pow(F.lit(10.0), -score / F.col("n_tokens")).alias("perplexity"),
    )


def perplexity(scores: DataFrame) -> DataFrame:
    """``held_out, n_tokens, perplexity, base_perplexity`` over all documents of :func:`scored`, learned from and held out."""
    sums = scores.groupBy("held_out").agg(F.sum("n_tokens").alias("n_tokens"), F.sum("score").alias("s"), F.sum("base_score").alias("b"))
    of = lambda c: F.pow(F.lit(10.0), -F.col(c) / F.col("n_tokens"))
    return sums.select("held_out", "n_tokens", of("s").alias("perplexity"), of("b").alias("base_perplexity"))
