"""Quality rules with robust multivariate outlier rejection, JVM-side throughout.

Each text gives counts, the counts a vector of transformed statistics. For every
language and source a minimum-covariance-determinant estimate is fitted over all of its
distinct texts that pass the base rules. From three starts, concentration steps take the
mean and covariance of the ``ALPHA`` share of texts nearest by Mahalanobis distance, until
the determinant falls no further; of the starts the least determinant stays. It is made
consistent for normal data, and reweighted: mean and covariance of all within the 0.975
quantile of chi-squared, made consistent again. Documents beyond the quantile ``CUT`` of
chi-squared are rejected.

A group's estimate is drawn towards its language's, and that towards the whole corpus',
with the weight of ``PRIOR`` texts: a small group follows its language, and no size is a
switch. A group that is degenerate, whose least covariance has no volume (fewer texts
than dimensions, or three quarters on one line), has no weight of its own. The corpus, which has no
parent, counts even so: an axis on which its texts are alike is taken to be known to one count.

Means, covariances and distance quantiles are aggregates that combine before the shuffle,
so a hot group costs no task more. Cholesky factors are unrolled column expressions.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracelume.llm.names import Held
from tracelume.llm.scratch import Scratch
from tracelume.llm.text import let, words

WINDOW = 8
MIN_WORDS, MAX_REPEAT_PERCENT = 20, 30
#: Share of a group that an estimate rests on, share of normal data within the cut-off, and texts that a parent's estimate counts for.
ALPHA, CUT, PRIOR = 0.75, 1 - 1e-6, 100
VECTOR = ("v_word_len", "v_short", "v_diversity", "v_marks", "v_capitals")
#: Characters of a short word. What shares count from: as much text of these rates, so that short texts spread no wider than long ones.
SHORT, WORDS_BEFORE = 3, 200
WORD_LEN, SHORT_SHARE, MARKS, CAPITALS = 5.0, 0.4, 1 / 30, 1 / 60
#: Least gain of a step in the determinant's logarithm; least scale that is not rounding.
GAIN, ROUNDING = 1e-4, 1e-6
#: What one character, word or mark more moves each axis by, in that stretch: no axis is known better, and so none has a smaller spread beside the others.
UNITS = (1 / (WORD_LEN * WORDS_BEFORE), 1 / (SHORT_SHARE * WORDS_BEFORE), 1 / (WORDS_BEFORE * math.log(WORDS_BEFORE)), 1 / (MARKS * WORD_LEN * WORDS_BEFORE), 1 / (CAPITALS * WORD_LEN * WORDS_BEFORE))
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_D = len(VECTOR)
_CELLS = [(i, j) for j in range(_D) for i in range(j, _D)]
#: Distances are counted in so many steps for each doubling.
_GRAIN = 32


def chi2_cdf(x: float, k: int) -> float:
    """Share of chi-squared with ``k`` degrees of freedom below ``x``: the series of the lower incomplete gamma function."""
    if x <= 0:
        return 0.0
    a, x = k / 2, x / 2
    total = term = 1 / a
    while term > 1e-17 * total:
        a += 1
        term *= x / a
        total += term
    return total * math.exp(-x + k / 2 * math.log(x) - math.lgamma(k / 2))


def chi2_quantile(p: float, k: int) -> float:
    lo, hi = 0.0, 1000.0
    for _ in range(100):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if chi2_cdf(mid, k) < p else (lo, mid)
    return hi


def consistency(share: float) -> float:
    """What the covariance of the nearest ``share`` of normal data falls short by."""
    return share / chi2_cdf(chi2_quantile(share, _D), _D + 2)


def _turned(x: Column, k: int) -> Column:
    return F.shiftleft(x, k).bitwiseOR(F.shiftrightunsigned(x, 64 - k))


def _doubled(h: Column, k: int) -> Column:
    """Hashes of runs of 2k words from those of k: each with the one k further on."""
    n = F.greatest(F.size(h) - k, F.lit(0))
    return F.zip_with(F.slice(h, 1, n), F.slice(h, k + 1, n), lambda x, y: x.bitwiseXOR(_turned(y, k)))


def _again(h: Column) -> Column:
    return F.size(h) - F.size(F.array_distinct(h))


def _covered(h: Column) -> Column:
    """Words under windows whose hash stands in ``h`` twice or more."""
    pairs = F.array_sort(F.transform(h, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))

    def spread(s: Column) -> Column:
        last = F.size(s) - 1
        same = lambda x, k: (k >= 0) & (k <= last) & (F.get(s, k)["h"] == x["h"])
        hit = F.array_sort(F.transform(F.filter(s, lambda x, k: same(x, k - 1) | same(x, k + 1)), lambda x: x["i"]))
        zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(-WINDOW).alias("p"))
        return F.aggregate(hit, zero, lambda a, p: F.struct((a["n"] + F.least(F.lit(WINDOW), p - a["p"])).alias("n"), p.alias("p")), lambda a: a["n"])

    return let(pairs, spread)


def _repeated_words(h: Column) -> Column:
    """Words, of which ``h`` has the hashes, inside 8-word windows found twice or more.

    Two equal windows have seven equal pairs and five equal runs of four, so most texts
    are done with their pairs.
    """
    none = F.lit(0).cast("long")
    eights = lambda f: let(_doubled(f, 4), lambda e: F.when(_again(e) == 0, none).otherwise(_covered(e)))
    fours = lambda t: let(_doubled(t, 2), lambda f: F.when(_again(f) < WINDOW - 3, none).otherwise(eights(f)))
    return let(_doubled(h, 1), lambda t: F.when(_again(t) < WINDOW - 1, none).otherwise(fours(t)))


def _statistics(text: Column) -> Column:
    """All counts of a text in one struct; null and empty texts have no words, and all their counts are zero."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    hashed = lambda w: F.transform(w, lambda x: F.xxhash64(x))
    of_hashes = lambda h: F.struct(F.size(F.array_distinct(h)).cast("long").alias("n_distinct"), _repeated_words(h).alias("n_repeat_words"))
    short = lambda w: F.size(F.filter(w, lambda x: F.length(x) <= SHORT)).cast("long")
    of_words = lambda w: F.struct(F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), short(w).alias("n_short"), let(hashed(w), of_hashes).alias("r"))
    lines = F.filter(F.split(text, "\n", -1), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    of_lines = lambda x: F.struct(F.size(x).cast("long").alias("n_lines"), _again(x).cast("long").alias("n_dup_lines"))
    return F.struct(
        let(words(text), of_words).alias("w"), let(lines, of_lines).alias("l"), F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"),
        F.regexp_count(text, F.lit(r"[!-/:-@\[-`{-~]")).cast("long").alias("n_marks"), F.regexp_count(text, F.lit("[A-Z]")).cast("long").alias("n_capitals")
    )


def _columns(q: str) -> dict[str, Column]:
    """Counts, base_failed and vector from the struct ``q``.

    Every axis varies by itself from text to text: logarithms of the mean word length, and of the shares of short words, of ASCII
    punctuation (symbols among it) and of capitals, each counted from a stretch of typical prose; and distinct words as a power of
    all, which shows lines and words that repeat.
    """
    f = {c: F.col(f"{q}.{p}") for c, p in zip(COUNTS, ("w.n_words", "w.word_chars", "n_symbols", "l.n_dup_lines", "w.r.n_repeat_words"))}
    n, chars, r = f["n_words"], f["word_chars"], f["n_repeat_words"]
    k, chars_before = float(WORDS_BEFORE), WORD_LEN * WORDS_BEFORE
    share = lambda c, rate: F.log((F.col(f"{q}.{c}") + rate * chars_before) / (chars + chars_before))
    vector = (
        F.log((chars + chars_before) / (n + k)),
        F.log((F.col(f"{q}.w.n_short") + SHORT_SHARE * k) / (n + k)),
        F.log(F.col(f"{q}.w.r.n_distinct") + 1.0) / F.log(n + 2.0),
        share("n_marks", MARKS),
        share("n_capitals", CAPITALS),
    )
    return f | {"base_failed": (n < MIN_WORDS) | (100 * r > MAX_REPEAT_PERCENT * n)} | dict(zip(VECTOR, vector))


def with_statistics(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words and base_failed as ``q_*`` columns, which replace columns of those names.

    Null and empty texts have no words: all counts are zero and base_failed is true.
    """
    names = {f"q_{c}": c for c in (*COUNTS, "base_failed")}
    held = Held(docs, tuple(names))
    q = held.df.withColumn("q", _statistics(F.col(held.at(text_col))))
    return held.back(q.withColumns({c: v for c, v in _columns("q").items() if c in names.values()}), names)


# Expressions of the estimates are SQL text: of the same meaning as columns, but without a call into the JVM for each operator.
_MEAN, _COV, _LOW = [f"m_{i}" for i in range(_D)], [f"c_{i}{j}" for i, j in _CELLS], [f"l_{i}{j}" for i, j in _CELLS]
_FROM = [f"x_{i}" for i in range(_D)]
#: The vector from the mean.
_CENTRED = [f"{v} - {m} AS {x}" for v, m, x in zip(VECTOR, _MEAN, _FROM)]


def _factored(df: DataFrame, units: tuple[float, ...] = UNITS) -> DataFrame:
    """``df`` with the lower factor l_ij of c_ij, its pivots ``units`` at least, and ``ld``, the determinant's logarithm; a column names those before it."""
    less = lambda i, j: " - ".join([f"c_{i}{j}", *[f"l_{i}{k} * l_{j}{k}" for k in range(j)]])
    low = [f"sqrt(greatest({less(i, j)}, {max(units[i] ** 2, 1e-30)!r}D)) AS l_{i}{j}" if i == j else f"({less(i, j)}) / l_{j}{j} AS l_{i}{j}" for i, j in _CELLS]
    return df.selectExpr("*", *low, f"2 * ({' + '.join(f'ln(l_{i}{i})' for i in range(_D))}) AS ld")


def _measured(df: DataFrame, *keep: str) -> DataFrame:
    """Columns ``keep``, x_i and ``d2``, the squared Mahalanobis distance of x_i.

    Forward substitution with a column for each of its values: as one expression it would
    double with every dimension.
    """
    z = [f"({' - '.join([x, *[f'l_{i}{k} * z_{k}' for k in range(i)]])}) / l_{i}{i} AS z_{i}" for i, x in enumerate(_FROM)]
    df = df.selectExpr(*keep, *_CENTRED, *_LOW)
    return df.selectExpr(*keep, *_FROM, *z, f"{' + '.join(f'z_{i} * z_{i}' for i in range(_D))} AS d2").select(*keep, *_FROM, "d2")


def _sums(rows: DataFrame, *keys: str) -> DataFrame:
    """Number, sums and products of x_i. Plain sums are a fraction of the code of covariances, and near a mean they lose no digits."""
    sums = [f"sum({x}) AS s_{i}" for i, x in enumerate(_FROM)] + [f"sum(x_{i} * x_{j}) AS q_{i}{j}" for i, j in _CELLS]
    return rows.groupBy(*keys).agg(*[F.expr(x) for x in ("count(*) AS n", *sums)])


def _moments(scale: float = 1.0) -> list[str]:
    """New m_i and c_ij from the sums about old m_i."""
    return [f"m_{i} + s_{i} / n AS m_{i}" for i in range(_D)] + [f"(q_{i}{j} / n - s_{i} / n * s_{j} / n) * {scale!r}D AS c_{i}{j}" for i, j in _CELLS]


def _starts(scratch: Scratch, rows: DataFrame, units: tuple[float, ...]) -> DataFrame:
    """``g, s, ...``: medians with central spreads; mean and covariance; medians with the covariance of directions."""
    aggs = [F.percentile_approx(v, [0.16, 0.5, 0.84], 200).alias(f"p_{i}") for i, v in enumerate(VECTOR)]
    spread = [F.greatest((F.col(f"p_{i}")[2] - F.col(f"p_{i}")[0]) / 2, F.lit(ROUNDING)).alias(f"d_{i}") for i in range(_D)]
    middle = rows.groupBy("g").agg(*aggs).select("g", *[F.col(f"p_{i}")[1].alias(m) for i, m in enumerate(_MEAN)], *spread)
    middle = scratch.table(middle, "middle")
    x = rows.join(middle, "g").selectExpr("g", *_CENTRED, *[f"d_{i}" for i in range(_D)])
    z = x.selectExpr("g", *[f"x_{i} / d_{i} AS z_{i}" for i in range(_D)])
    long = f"greatest({' + '.join(f'z_{i} * z_{i}' for i in range(_D))}, 1e-12D) AS long"
    signs = z.selectExpr("*", long).groupBy("g").agg(*[F.expr(f"avg(z_{i} * z_{j} / long) AS a_{i}{j}") for i, j in _CELLS])
    first = [f"{f'd_{i} * d_{j}' if i == j else '0D'} AS c_{i}{j}" for i, j in _CELLS]
    third = [f"a_{i}{j} * d_{i} * d_{j} * {_D} AS c_{i}{j}" for i, j in _CELLS]
    about, signs = scratch.table(_sums(x, "g"), "about"), scratch.table(signs, "signs")
    ways = [middle.selectExpr("g", "0 AS s", *_MEAN, *first), middle.join(about, "g").selectExpr("g", "1 AS s", *_moments()), middle.join(signs, "g").selectExpr("g", "2 AS s", *_MEAN, *third)]
    return _factored(ways[0].union(ways[1]).union(ways[2]), units).withColumns({"ld": F.lit(math.inf), "done": F.lit(False)})


def _nearest(near: DataFrame, share: float) -> DataFrame:
    """``g, s`` and the sums of the ``share`` of a group that is nearest, to a step of the logarithmic grain; what lies in the last step stays in whole.

    Sums are taken for each step, in one pass, and then over the steps within.
    """
    step = F.floor(F.log2(F.col("d2") + 1e-9) * _GRAIN).cast("int")
    steps = _sums(near.withColumn("step", step), "g", "s", "step")
    group = Window.partitionBy("g", "s")
    before = F.coalesce(F.sum("n").over(group.orderBy("step").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    within = steps.withColumns({"before": before, "all": F.sum("n").over(group)}).where(F.col("before") < share * F.col("all"))
    sums = [c for c in steps.columns if c not in ("g", "s", "step")]
    return within.groupBy("g", "s").agg(*[F.sum(c).alias(c) for c in sums])


def concentrated(scratch: Scratch, rows: DataFrame, alpha: float = ALPHA, units: tuple[float, ...] = UNITS) -> DataFrame:
    """``g, n, m_i, c_ij, l_ij, ld`` of each group of the written table ``rows(g, VECTOR)``: the subset of least determinant.

    A step is one pass over the rows of groups that have not ended. One that does not lower the determinant by ``GAIN`` ends its
    start, and what it had before stays, so steps end by themselves; what has ended takes no further part.
    """
    params = scratch.table(_starts(scratch, rows, units), "params")
    while True:
        live = params.where("not done").select("g", "s", *_MEAN, *_LOW)
        sums = _nearest(_measured(rows.join(live, "g"), "g", "s"), alpha)
        fresh = _factored(params.select("g", "s", *_MEAN).join(sums, ["g", "s"]).selectExpr("g", "s", *_moments()), units)
        state = (*_MEAN, *_COV, *_LOW, "ld")
        both = params.join(fresh.selectExpr("g", "s", f"struct({', '.join(state)}) AS f"), ["g", "s"], "left").selectExpr("*", f"coalesce(f.ld < ld - {GAIN!r}D, false) AS better")
        moved = both.selectExpr("g", "s", *[f"if(better, f.{c}, {c}) AS {c}" for c in state], "done or not better AS done")
        params = scratch.table(moved, "params")
        if params.where("not done").isEmpty():
            break
    best = F.min_by(F.struct(*_MEAN, *_COV, *_LOW, "ld"), F.struct("ld", "s")).alias("b")
    out = scratch.table(params.groupBy("g").agg(best).select("g", "b.*"), "raw")
    scratch.drop("params", "middle", "about", "signs")
    return out


def estimates(scratch: Scratch, rows: DataFrame, alpha: float = ALPHA, units: tuple[float, ...] = UNITS) -> DataFrame:
    """``g, n, own, m_i, c_ij``: consistent, reweighted estimates of each group of ``rows(g, VECTOR)``; ``own`` is false where degenerate."""
    raw = concentrated(scratch, rows, alpha, units)
    scale = consistency(alpha)
    wide = raw.select("g", *_MEAN, *[(F.col(c) * math.sqrt(scale)).alias(c) for c in _LOW])
    near = _measured(rows.join(wide, "g"), "g").where(f"d2 <= {chi2_quantile(0.975, _D)!r}D")
    sums = scratch.table(_sums(near, "g"), "sums")
    moved = raw.select("g", *_MEAN).join(sums, "g").selectExpr("g", *_moments(consistency(0.975)))
    # judged by the covariance as it is, without the axes' units
    bare = _factored(raw.select("g", *_COV), (0.0,) * _D).select("g", (F.least(*[F.col(f"l_{i}{i}") for i in range(_D)]) <= ROUNDING).alias("flat"))
    sizes = rows.groupBy("g").agg(F.count("*").alias("n"))
    out = scratch.table(bare.select("g", (~F.col("flat")).alias("own")).join(sizes, "g").join(moved, "g", "left").withColumn("own", F.col("own") & F.col("m_0").isNotNull()), "estimates")
    scratch.drop("raw", "sums")
    return out


def _levels(lang: Column, source: Column) -> list[Column]:
    """Keys of the corpus, of a language, and of a language and source; null is a value like others."""
    named = lambda *c: F.xxhash64(F.lit(len(c)), *[x for v in c for x in (v.isNull(), F.coalesce(v.cast("string"), F.lit("")))])
    return [named(), named(lang), named(lang, source)]


def fitted(scratch: Scratch, sound: DataFrame, prior: float = PRIOR, alpha: float = ALPHA) -> DataFrame:
    """``g, n_group, m_i, l_ij`` of each language and source of ``sound(g0, g1, g2, VECTOR)``: estimates drawn towards their parents'. Groups with nothing to estimate from have no row."""
    rows = scratch.table(sound.distinct(), "sound")
    levels = rows.select(F.explode(F.array("g0", "g1", "g2")).alias("g"), *VECTOR)
    found = estimates(scratch, levels, alpha)
    tree = rows.select("g0", "g1", "g2").distinct()
    for k in range(3):
        counts = F.col("own") if k else F.col("own") | (F.col("n") > _D)
        e = found.select(F.col("g").alias(f"g{k}"), F.when(counts, F.struct("n", *_MEAN, *_COV)).alias(f"e{k}"), F.col("n").alias(f"n{k}"))
        tree = tree.join(e, f"g{k}")

    def drawn(k: int, c: str) -> Column:
        """The estimate of level k: its own, by its texts, with its parent's, by ``prior``."""
        if k == 0:
            return F.col(f"e0.{c}")
        own, up, n = F.col(f"e{k}.{c}"), drawn(k - 1, c), F.col(f"e{k}.n")
        return F.coalesce((n * own + prior * up) / (n + prior), own, up)

    out = tree.select(F.col("g2").alias("g"), F.col("n2").alias("n_group"), *[drawn(2, c).alias(c) for c in (*_MEAN, *_COV)]).where("m_0 is not null")
    out = scratch.table(_factored(out).select("g", "n_group", *_MEAN, *_LOW), "fitted")
    scratch.drop("sound", "estimates")
    return out


def judged(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", cut: float = CUT, carry: list[str] | None = None, prior: float = PRIOR, alpha: float = ALPHA
) -> DataFrame:
    """``docs`` (or its columns ``carry``) with the ``q_*`` counts, q_distance and q_kept.

    Estimates are fitted on the distinct texts of a language and source that pass the base
    rules, so a group of copies counts once. Null languages and sources are groups like
    others. A document is kept if it passes the base rules and its squared distance is
    within the quantile ``cut`` of chi-squared; with nothing to estimate from, q_distance is
    null and it is kept if it passes the base rules. Ties at a concentration cut all stay
    in. Rows of equal text, language and source fare alike, however often they stand there.
    A text of any length is read whole. An empty table gives an empty result. Other columns
    come back as they are, whatever their names; those named like a result are replaced.
    """
    names = {f"q_{c}": c for c in (*COUNTS, "base_failed", "distance", "kept")}
    held, scratch = Held(docs, tuple(names)), Scratch(docs.sparkSession)
    lang, source = F.col(held.at(lang_col)), F.col(held.at(source_col))
    stats = held.df.select(*held.columns(carry), *[g.alias(f"g{k}") for k, g in enumerate(_levels(lang, source))], _statistics(F.col(held.at(text_col))).alias("q"))
    stats = scratch.table(stats.withColumns(_columns("q")).drop("q"), "quality")
    params = fitted(scratch, stats.where("not base_failed").select("g0", "g1", "g2", *VECTOR), prior, alpha)
    out = _measured(stats.join(params.withColumnRenamed("g", "g2"), "g2", "left"), *[c for c in stats.columns if c not in VECTOR]).withColumnRenamed("d2", "distance")
    within = F.coalesce(F.col("distance") <= chi2_quantile(cut, _D), F.lit(True))
    return held.back(out.withColumn("kept", ~F.col("base_failed") & within), names, carry)
