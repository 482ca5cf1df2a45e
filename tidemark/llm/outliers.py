"""Robust multivariate outliers among document statistics, per language and source.

Four transformed statistics describe a document: the logarithm of its mean word length, and
the square roots of its symbols, repeated lines and repeated words per word. For each
(language, source) the minimum-covariance-determinant estimate of their centre and scatter is
fitted by concentration steps over all documents: distances under the present estimate, then
mean and covariance of the nearest three quarters. A step is one aggregation, as the moments
are summed by group and distance class and the classes up to the one where three quarters are
reached are added up; equal distances so stay together and no order of rows matters. Two
starts are followed (median and MAD; all rows) and the one of the smaller determinant is
kept, made consistent with the normal distribution and reweighted once. A document is
rejected beyond a squared Mahalanobis distance that one in a thousand normal ones exceeds.

Most documents have no symbol and no repeat at all, and a scatter of nought would reject every
other one. Word lengths and symbols have a floor of variance (``FLOORS``). Repeats have the
sampling error of their own count in the document: the root of a count of Poisson events of
``u`` words each (``REPEAT_UNITS``) has a variance of ``u / 4``, the root of its share of ``n``
words one of ``u / 4n``. So few repeats in a short document are no outliers, the same share in
a long one is.

Only DataFrame functions are used; sets of a text's word windows are arrays of its row.

Defined results: a null, empty or blank text has no words and fails; texts shorter than a
window repeat nothing; null languages and sources are groups like others; the groups of a
language with fewer than ``LEAST_ROWS`` fitted rows are one group, which is judged by an estimate
over the documents of all languages, however many, if it is still smaller; repeated rows are
judged alike; an empty table gives none; other columns are kept by ``judge``, those named like a
statistic are replaced.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import boxed, read_table, unboxed, words
from tidemark.llm.registry import query
from tidemark.session import cut_lineage

SYMBOLS = "[#*$%&|<>]"
LEAST_WORDS = 50
#: Words of the windows that count as repeated.
REPEAT_WORDS = 3
#: Share of a group's documents that an estimate is concentrated on.
CORE = 0.75
STEPS = 4
LEAST_ROWS = 50
#: Standard deviations that are added to every scatter, by statistic; repeats have a document's own.
FLOORS = (0.05, 0.05, 0.0, 0.0)
#: Counted by an event of the last two statistics: a line, and the words of a window seen twice.
REPEAT_UNITS = (1, 2 * REPEAT_WORDS)
#: Share of normal documents beyond the last distance that is kept.
REJECTED = 1e-3
#: Distance classes per unit of the logarithm.
CLASSES = 64

_DIM = len(FLOORS)
_PAIRS = [(i, j) for i in range(_DIM) for j in range(i + 1)]
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_GROUP = ["_lang", "_source"]
#: Language or source of what is pooled.
_POOL = "\0"


def chi2_cdf(x: float, dof: int) -> float:
    """Chi-squared distribution for an even number of degrees."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return low


def consistency(share: float) -> float:
    """Factor for the scatter of the nearest ``share`` of normal rows."""
    return share / chi2_cdf(chi2_quantile(share, _DIM), _DIM + 2)


def text_statistics(docs: DataFrame) -> DataFrame:
    """``_row`` (all columns) with the five counts of whole texts and ``base_failed``."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    kept = ["_row"]
    d = docs.select(boxed(docs), text.alias("_text"), words(text).alias("_w"))
    lines = F.filter(F.split("_text", "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    n = F.size("_w")
    window = lambda i: F.xxhash64(*[F.get("_w", i + k) for k in range(REPEAT_WORDS)])
    d = d.select(
        *kept,
        n.cast("long").alias("n_words"),
        F.length(F.array_join("_w", "")).cast("long").alias("word_chars"),
        F.regexp_count("_text", F.lit(SYMBOLS)).cast("long").alias("n_symbols"),
        lines.alias("_lines"),
        F.when(n >= REPEAT_WORDS, F.transform(F.sequence(F.lit(0), n - REPEAT_WORDS), window)).otherwise(F.array().cast("array<long>")).alias("_h"),
    )
    repeats = F.size(F.array_distinct("_h")) < F.size("_h")
    d = d.select(
        *kept, "n_words", "word_chars", "n_symbols",
        (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long").alias("n_dup_lines"),
        # Windows with their places in the order of their hashes, so that equal ones are neighbours.
        F.when(repeats, F.sort_array(F.transform("_h", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))).alias("_s"),
    )
    twin = lambda s, j: F.get("_s", j - 1)["h"].eqNullSafe(s["h"]) | F.get("_s", j + 1)["h"].eqNullSafe(s["h"])
    at = F.transform(F.filter("_s", twin), lambda s: s["i"])
    d = d.select(*kept, *STATISTICS[:4], F.sort_array(at).alias("_p"))
    # A window covers its words up to the next repeated window's first.
    covered = F.transform("_p", lambda p, j: F.least(F.lit(REPEAT_WORDS), F.coalesce(F.get("_p", j + 1) - p, F.lit(REPEAT_WORDS))))
    total = F.aggregate(covered, F.lit(0).cast("long"), lambda a, x: a + x)
    d = d.select(*kept, *STATISTICS[:4], F.coalesce(total, F.lit(0)).cast("long").alias("n_repeat_words"))
    failed = (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return d.withColumn("base_failed", failed)


def vector() -> list[Column]:
    n = F.col("n_words")
    per_word = lambda c: F.sqrt(F.col(c) / n)
    return [F.log(F.col("word_chars") / n), per_word("n_symbols"), per_word("n_dup_lines"), per_word("n_repeat_words")]


def _errors() -> list[Column]:
    """Variances of the last two statistics by the sampling of a document of ``1 / r`` words."""
    return [F.lit(u / 4) * F.col("r") for u in REPEAT_UNITS]


def _estimate(moments: DataFrame, keys: Sequence[str], factor: float) -> DataFrame:
    """Centre, scatter and log determinant from n, sums ``s_i``, ``sr`` and products ``p_ij``.

    The scatter is given as the rows ``l_ij`` of its Cholesky factor for the first two statistics,
    and what they leave of the last two (``v22``, ``v32``, ``v33``), to which errors are added.
    """
    mean = [F.round(F.col(f"s{i}") / F.col("n"), 10).alias(f"m{i}") for i in range(_DIM)]
    d = moments.select(*keys, *mean, (F.col("sr") / F.col("n")).alias("r"), "n", *[f"p{i}{j}" for i, j in _PAIRS])
    cov = []
    for i, j in _PAIRS:
        c = factor * (F.col(f"p{i}{j}") / F.col("n") - F.col(f"m{i}") * F.col(f"m{j}"))
        if i == j:
            c = F.greatest(c, F.lit(0.0)) + FLOORS[i] ** 2
        cov.append(F.round(c, 10).alias(f"c{i}{j}"))
    means = [f"m{i}" for i in range(_DIM)]
    d = d.select(*keys, *means, "r", *cov)
    d = d.withColumn("l00", F.sqrt("c00"))
    d = d.withColumns({f"l{i}0": F.col(f"c{i}0") / F.col("l00") for i in (1, 2, 3)})
    d = d.withColumn("l11", F.sqrt(F.greatest(F.col("c11") - F.col("l10") * F.col("l10"), F.lit(FLOORS[1] ** 2 / 4))))
    d = d.withColumns({f"l{i}1": (F.col(f"c{i}1") - F.col(f"l{i}0") * F.col("l10")) / F.col("l11") for i in (2, 3)})
    left = lambda i, j: F.col(f"c{i}{j}") - F.col(f"l{i}0") * F.col(f"l{j}0") - F.col(f"l{i}1") * F.col(f"l{j}1")
    d = d.withColumns({"v22": F.greatest(left(2, 2), F.lit(0.0)), "v33": F.greatest(left(3, 3), F.lit(0.0))})
    most = F.sqrt(F.col("v22") * F.col("v33"))
    d = d.withColumn("v32", F.greatest(-most, F.least(most, left(3, 2))))
    e2, e3 = _errors()
    rest = (F.col("v22") + e2) * (F.col("v33") + e3) - F.col("v32") * F.col("v32")
    det = F.log("l00") + F.log("l11") + 0.5 * F.log(rest)
    return d.select(*keys, *means, *_SCATTER, det.alias("det"))


_SCATTER = ["l00", "l10", "l11", "l20", "l21", "l30", "l31", "v22", "v32", "v33"]


def _distance() -> Column:
    """Squared Mahalanobis distance under the joined estimate and the row's sampling errors."""
    y = [F.col(f"x{i}") - F.col(f"m{i}") for i in range(_DIM)]
    z0 = y[0] / F.col("l00")
    z1 = (y[1] - F.col("l10") * z0) / F.col("l11")
    r2, r3 = (y[i] - F.col(f"l{i}0") * z0 - F.col(f"l{i}1") * z1 for i in (2, 3))
    e2, e3 = _errors()
    a, b, c = F.col("v22") + e2, F.col("v33") + e3, F.col("v32")
    return z0 * z0 + z1 * z1 + (b * r2 * r2 - 2 * c * r2 * r3 + a * r3 * r3) / (a * b - c * c)


def _moments() -> list[Column]:
    x = [F.col(f"x{i}") for i in range(_DIM)]
    return [F.count(F.lit(1)).alias("n"), F.sum("r").alias("sr"), *[F.sum(x[i]).alias(f"s{i}") for i in range(_DIM)], *[F.sum(x[i] * x[j]).alias(f"p{i}{j}") for i, j in _PAIRS]]


_MOMENT_NAMES = ["n", "sr", *[f"s{i}" for i in range(_DIM)], *[f"p{i}{j}" for i, j in _PAIRS]]


def _join(rows: DataFrame, estimates: DataFrame, how: str = "inner") -> DataFrame:
    renamed = estimates.withColumnsRenamed({k: f"e{k}" for k in _GROUP})
    same = [F.col(k).eqNullSafe(F.col(f"e{k}")) for k in _GROUP]
    return rows.join(renamed, same, how).drop(*[f"e{k}" for k in _GROUP])


def fit(table: DataFrame) -> DataFrame:
    """Estimates (centre, scatter) by group, from a table with ``x0..`` and ``r``."""
    rows = table.where("not base_failed").select(*_GROUP, "r", *[f"x{i}" for i in range(_DIM)])
    # The rows without a language of their own are judged among all.
    alone = F.col("_lang").eqNullSafe(_POOL) & F.col("_source").eqNullSafe(_POOL)
    if not rows.where(alone).isEmpty():
        rows = rows.where(~alone).unionByName(rows.withColumns({k: F.lit(_POOL) for k in _GROUP}))
    every = rows.groupBy(*_GROUP).agg(*_moments(), *[F.percentile_approx(f"x{i}", 0.5, 10000).alias(f"q{i}") for i in range(_DIM)])
    every = cut_lineage(every)
    away = _join(rows, every.select(*_GROUP, *[f"q{i}" for i in range(_DIM)])).groupBy(*_GROUP).agg(
        F.avg("r").alias("sr"), *[F.first(f"q{i}").alias(f"q{i}") for i in range(_DIM)],
        *[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"q{i}")), 0.5, 10000).alias(f"d{i}") for i in range(_DIM)],
    )
    # As moments of one row: centre q, scatter (1.4826 MAD)^2.
    robust = away.select(
        *_GROUP, F.lit(0).alias("start"), F.lit(1).cast("long").alias("n"), "sr", *[F.col(f"q{i}").alias(f"s{i}") for i in range(_DIM)],
        *[(F.col(f"q{i}") * F.col(f"q{j}") + ((1.4826 * F.col(f"d{i}")) ** 2 if i == j else 0.0)).alias(f"p{i}{j}") for i, j in _PAIRS],
    )
    classical = every.select(*_GROUP, F.lit(1).alias("start"), *_MOMENT_NAMES)
    keys = [*_GROUP, "start"]
    now = cut_lineage(_estimate(robust.unionByName(classical), keys, 1.0))
    for _ in range(STEPS):
        apart = F.floor(CLASSES * F.log1p(_distance())).alias("class")
        classes = _join(rows, now).select(*keys, apart, "r", *[f"x{i}" for i in range(_DIM)]).groupBy(*keys, "class").agg(*_moments())
        # One row per group, start and class: a bounded number whatever the number of documents.
        of = Window.partitionBy(*keys)
        reached = F.sum("n").over(of.orderBy("class")) - F.col("n")
        core = classes.select("*", reached.alias("before"), F.sum("n").over(of).alias("all")).where(F.col("before") < F.ceil(CORE * F.col("all")))
        now = cut_lineage(_estimate(core.groupBy(*keys).agg(*[F.sum(c).alias(c) for c in _MOMENT_NAMES]), keys, consistency(CORE)))
    best = now.groupBy(*_GROUP).agg(F.min_by(F.struct("*"), F.struct("det", "start")).alias("b"))
    raw = best.select(*_GROUP, *[F.col(f"b.{c}").alias(c) for c in now.columns if c not in (*_GROUP, "start", "det")])
    near = _join(rows, raw).where(_distance() <= chi2_quantile(0.975, _DIM))
    return cut_lineage(_estimate(near.groupBy(*_GROUP).agg(*_moments()), _GROUP, consistency(0.975)).drop("det"))


def _pool_small(table: DataFrame, key: str) -> DataFrame:
    """The table, with the pool as ``key`` of the groups that have fewer than ``LEAST_ROWS`` fitted rows."""
    sizes = table.where("not base_failed").groupBy(*_GROUP).agg(F.count(F.lit(1)).alias("_fitted"))
    small = F.coalesce("_fitted", F.lit(0)) < LEAST_ROWS
    # Written, so that its size is known: the table, with its texts, isn't shuffled for a few groups.
    return _join(table, cut_lineage(sizes), "left").withColumn(key, F.when(small, F.lit(_POOL)).otherwise(F.col(key))).drop("_fitted")


def judge(docs: DataFrame, carried: Sequence[str] | None = None) -> DataFrame:
    """``carried`` columns (all) with the statistics, ``base_failed``, ``distance`` and ``kept``."""
    results = (*STATISTICS, "base_failed", "distance", "kept")
    names = list(docs.columns if carried is None else carried)
    counted = text_statistics(docs)
    group = [F.col(f"_row.{c}").cast("string").alias(f"_{c}") for c in ("lang", "source")]
    row = F.struct(*[F.col(f"_row.`{c}`").alias(c) for c in names]).alias("_row")
    counted = counted.select(
        row, *STATISTICS, "base_failed", *group, F.when(~F.col("base_failed"), 1 / F.col("n_words")).alias("r"), *[F.when(~F.col("base_failed"), x).alias(f"x{i}") for i, x in enumerate(vector())]
    )
    table = cut_lineage(counted)
    # Documents of a small group are fitted together with those of the language's other small groups,
    # and those of a small pool with all.
    table = _pool_small(_pool_small(table, "_source"), "_lang")
    judged = _join(table, fit(table), "left")
    apart = F.when(~F.col("base_failed"), _distance())
    fine = ~F.col("base_failed") & (F.coalesce(apart, F.lit(0.0)) <= chi2_quantile(1 - REJECTED, _DIM))
    return judged.select(*unboxed(names, results), *STATISTICS, "base_failed", apart.alias("distance"), fine.alias("kept"))


@query("op5_outliers")
def op5_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    return judge(docs.select("doc_id", "lang", "source", "text"), carried=["doc_id"])
