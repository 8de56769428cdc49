"""Quality rules: word statistics of whole texts, fixed base limits, and robust multivariate
outliers by the minimum covariance determinant (MCD) per language and source.

The five statistics of a document are turned into a vector (logarithms and square roots of
rates).  For every (language, source), every language and all documents together, concentration steps look for
the share ``COVERAGE`` of the documents with the smallest covariance determinant: each step measures
Mahalanobis distances with the last mean and covariance, keeps the nearest documents and sums
their moments anew.  They set out from four starts (``STARTS``): the plain moments, which a cluster of bad
documents can hold captive, and three around the medians, scaled by the median absolute deviations, which up
to a quarter of bad documents hardly moves: without correlations, with those of spatial signs, and with
those of tanh scores.  Steps go on until no start's determinant falls any more; the smallest one
of a group is its fit.

A step is one aggregation of counts and moments by (group, start, distance bucket), summed map-side first, so
the size or skew of a group does not matter; the running count over at most ``BUCKETS`` rows of a
group tells which buckets are inside.  Medians come from counts by cells of 1 / ``CELLS``.

A document is judged by the fit of its (language, source) if that has ``MIN_GROUP`` fitted documents, else
by that of its language if that has as many, else by that of all documents.  Documents further than
``CUTOFF``, the chi-square quantile ``INLIERS``, are rejected.

Defined cases: null or empty text has no words and fails the base rules; null language or source
is a group of its own; every document that passes the base rules is judged, however small its group or
the table; constant statistics get a variance floor; repeated rows count as often as they stand; extra
columns are carried along; an empty table gives no rows.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from fleetbook.llm.common import stored

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
MIN_WORDS = 50
COVERAGE = 0.75
STARTS = ("moments", "medians", "signs", "tanh")
#: A start has settled when its log determinant falls by no more than this in a step.
SETTLED = 0.05
#: Steps end here at the latest, as distance buckets can keep a start going back and forth.
MAX_STEPS = 30
MIN_GROUP = 60
CELLS = 256
BUCKETS = 512
DIM = 5
#: Added to each statistic's standard deviation (squares) against singular covariances, small
#: beside what statistics that vary have; the scale of those that are constant in a group.
FLOOR = (0.2, 0.01, 0.03, 0.03, 0.05)
#: Share of a normal sample that is nearer than the cutoff.
INLIERS = 0.999
SPACES = " \t\n\x0b\x0c\r"
SYMBOLS = "#*$%&|<>"


def text_stats(text: str | None) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    if not text:
        return 0, 0, 0, 0, 0
    words = text.encode("utf-8").split()      # bytes split at the six ASCII spaces only
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    return (len(words), len(text) - sum(map(text.count, SPACES)), sum(map(text.count, SYMBOLS)),
            len(lines) - len(set(lines)), repeated_words(words))


def repeated_words(words: list) -> int:
    """Words that stand in a 3-word window found at least twice."""
    windows = list(zip(words, words[1:], words[2:]))
    if len(set(windows)) == len(windows):
        return 0
    seen = Counter(windows)
    inside = np.zeros(len(words), dtype=bool)
    at = np.fromiter((seen[w] > 1 for w in windows), dtype=bool, count=len(windows))
    inside[:-2] |= at
    inside[1:-1] |= at
    inside[2:] |= at
    return int(inside.sum())


def with_stats(docs: DataFrame, keep: list[str]) -> DataFrame:
    """Columns ``keep`` of ``docs`` plus qs_<statistic> of the whole text."""
    src = docs.select(*[F.col(f"`{c}`") for c in keep], F.col("text").alias(max(keep, key=len) + "_text"))   # a name none of them has
    schema = T.StructType(list(docs.select(*[F.col(f"`{c}`") for c in keep]).schema.fields)
                          + [T.StructField(f"qs_{s}", T.LongType()) for s in STATS])

    def run(batches):
        for batch in batches:
            values = np.array([text_stats(t) for t in batch.column(len(keep)).to_pylist()], dtype=np.int64).reshape(-1, DIM)
            cols = batch.columns[:len(keep)] + [pa.array(values[:, i]) for i in range(DIM)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *(f"qs_{s}" for s in STATS)])

    return src.mapInArrow(run, schema)


def base_failed():
    return (F.col("qs_n_words") < MIN_WORDS) | (100 * F.col("qs_n_repeat_words") > 50 * F.col("qs_n_words"))


def _vector() -> list:
    """The transformed statistics x1..x5."""
    n = F.greatest(F.col("qs_n_words"), F.lit(1)).cast("double")
    return [F.log(n), F.log(F.greatest(F.col("qs_word_chars"), F.lit(1)) / n),
            F.sqrt(F.col("qs_n_symbols") / n), F.sqrt(F.col("qs_n_dup_lines") / n),
            F.sqrt(F.col("qs_n_repeat_words") / n)]


X = [f"qs_x{i}" for i in range(1, DIM + 1)]
PAIRS = [(i, j) for i in range(DIM) for j in range(i, DIM)]
GROUP = ("level", "lang", "source")
FIT_SCHEMA = "level int, lang string, source string, start int, n double, mean array<double>, inv array<double>, logdet double, fell double"


def _distance():
    """Squared Mahalanobis distance from the joined ``qs_mean`` and ``qs_inv``."""
    terms = [f"{1 if i == j else 2} * qs_inv[{i * DIM + j}] * ({X[i]} - qs_mean[{i}]) * ({X[j]} - qs_mean[{j}])" for i, j in PAIRS]
    return F.expr(f"greatest({' + '.join(terms)}, 0.0D)")


def _by_group(rows: DataFrame, table: DataFrame) -> DataFrame:
    """``rows`` with the columns of the small ``table`` of their group."""
    side = table.select(*[F.col(c).alias(f"f_{c}") for c in GROUP], *[c for c in table.columns if c not in GROUP])
    on = (F.col("level") == F.col("f_level")) & F.col("lang").eqNullSafe(F.col("f_lang")) \
        & F.col("source").eqNullSafe(F.col("f_source"))
    return rows.join(side, on).drop(*[f"f_{c}" for c in GROUP])


def gamma_cdf(a: float, x: float) -> float:
    """Regularised lower incomplete gamma function by its series."""
    term = total = 1.0 / a
    k = a
    while term > 1e-16 * total:
        k += 1
        term *= x / k
        total += term
    return total * math.exp(-x + a * math.log(x) - math.lgamma(a))


def chi_square(share: float) -> float:
    """Quantile of the chi-square distribution with DIM degrees of freedom."""
    low, high = 1e-9, 200.0
    while high - low > 1e-10:
        mid = (low + high) / 2
        low, high = (mid, high) if gamma_cdf(DIM / 2, mid / 2) < share else (low, mid)
    return low


def consistency(share: float) -> float:
    """Factor by which the covariance of the nearest ``share`` of a normal sample falls short."""
    return 1.0 if share >= 1 else share / gamma_cdf(DIM / 2 + 1, chi_square(share) / 2)


#: Largest squared Mahalanobis distance of a kept document.
CUTOFF = chi_square(INLIERS)


def _matrices(rows: pd.DataFrame, name: str) -> np.ndarray:
    """The symmetric matrices of the columns ``name``ij, divided by the counts."""
    out = np.zeros((len(rows), DIM, DIM))
    for i, j in PAIRS:
        out[:, i, j] = out[:, j, i] = rows[f"{name}{i}{j}"] / rows["cnt"]
    return out


def _moments(rows: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and covariance of each row of sums."""
    mean = np.stack([rows[f"s{i}"] / rows["cnt"] for i in range(DIM)], axis=1).astype(float)
    return mean, _matrices(rows, "p") - mean[:, :, None] * mean[:, None, :]


def _fits(rows: pd.DataFrame, start, n, mean: np.ndarray, cov: np.ndarray, last) -> pd.DataFrame:
    """Rows of FIT_SCHEMA; the floors are added to ``cov``."""
    cov = cov + np.diag(np.square(FLOOR))
    logdet = np.linalg.slogdet(cov)[1]
    return rows[list(GROUP)].assign(start=start, n=n, mean=list(mean), inv=list(np.linalg.inv(cov).reshape(-1, DIM * DIM)),
                                    logdet=logdet, fell=last - logdet)


def _medians(cells: pd.DataFrame) -> pd.DataFrame:
    """Median and scale of each statistic of a group from its counts by cell."""
    mid, scale = [0.0] * DIM, list(FLOOR)
    for k, part in cells.groupby("stat"):
        at = (part["cell"].to_numpy() + 0.5) / CELLS
        count = part["cnt"].to_numpy()

        def middle(values):
            order = np.argsort(values, kind="stable")
            return float(values[order][np.searchsorted(np.cumsum(count[order]), count.sum() / 2)])
        mid[k] = middle(at)
        scale[k] = max(1.4826 * middle(np.abs(at - mid[k])), FLOOR[k])
    key = cells.iloc[0]
    return pd.DataFrame([{**{c: key[c] for c in GROUP}, "mid": mid, "scale": scale}])


def _starts(batches):
    """The four starts of each group (row) from its moments, medians, sign and tanh products."""
    for rows in batches:
        if len(rows):
            mid = np.array(rows["mid"].tolist())
            scale = np.array(rows["scale"].tolist())
            square = scale[:, :, None] * scale[:, None, :]
            fits = [_moments(rows), (mid, square * np.eye(DIM)), (mid, DIM * square * _matrices(rows, "u")), (mid, square * _matrices(rows, "t"))]
            for k, fit in enumerate(fits):
                yield _fits(rows, k, rows["cnt"], *fit, np.inf)


def _steps(batches):
    """The fit of each start (row) from the moments of its nearest documents."""
    for rows in batches:
        if len(rows):
            mean, cov = _moments(rows)
            yield _fits(rows, rows["start"], rows["total"], mean, cov * consistency(COVERAGE), rows["last"])


def concentrate(rows: DataFrame, fit: DataFrame) -> DataFrame:
    """One step of every start: the moments of the nearest COVERAGE of its group."""
    seen = _by_group(rows, fit.select(*GROUP, "start", "logdet", F.col("mean").alias("qs_mean"), F.col("inv").alias("qs_inv")))
    seen = seen.withColumn("bucket", F.least(F.floor(F.log1p(_distance()) * 32), F.lit(BUCKETS - 1)).cast("int"))
    sums = seen.groupBy(*GROUP, "start", "bucket").agg(
        F.count("*").alias("cnt"), F.max("logdet").alias("last"), *map(F.expr, SUMS), *_products("p", X))
    of_start = Window.partitionBy(*GROUP, "start")           # at most BUCKETS rows
    sums = sums.withColumn("total", F.sum("cnt").over(of_start)) \
        .withColumn("before", F.sum("cnt").over(of_start.orderBy("bucket")) - F.col("cnt")).filter(F.col("before") < COVERAGE * F.col("total"))
    names = [f"s{i}" for i in range(DIM)] + [f"p{i}{j}" for i, j in PAIRS]
    inside = sums.groupBy(*GROUP, "start").agg(F.sum("cnt").alias("cnt"), F.max("total").alias("total"), F.max("last").alias("last"),
                                               *[F.expr(f"sum({c}) as {c}") for c in names])
    return inside.mapInPandas(_steps, FIT_SCHEMA)


def _levels(rows: DataFrame, *columns: str) -> DataFrame:
    """``rows`` once for each of their three groups: (lang, source), (lang) and all."""
    none = F.lit(None).cast("string")
    groups = F.array(*[F.struct(F.lit(k).alias("level"), lang.alias("lang"), source.alias("source")) for k, (lang, source) in
                       enumerate([(F.col("lang"), F.col("source")), (F.col("lang"), none), (none, none)])])
    return rows.withColumn("at", F.explode(groups)).select("at.*", *columns)


def _products(name: str, values: list[str]) -> list:
    return [F.expr(f"sum({values[i]} * {values[j]}) as {name}{i}{j}") for i, j in PAIRS]


SUMS = [f"sum({x}) as s{i}" for i, x in enumerate(X)]


def first_fits(rows: DataFrame) -> DataFrame:
    """The starts of every group."""
    cells = F.explode(F.array(*[F.struct(F.lit(k).alias("stat"), F.floor(F.col(x) * CELLS).alias("cell")) for k, x in enumerate(X)]))
    counts = rows.withColumn("c", cells).groupBy("lang", "source", "c.stat", "c.cell").agg(F.count("*").alias("cnt"))
    counts = _levels(counts, "stat", "cell", "cnt").groupBy(*GROUP, "stat", "cell").agg(F.sum("cnt").alias("cnt"))
    middle = stored(counts.groupBy(*GROUP).applyInPandas(
        _medians, "level int, lang string, source string, mid array<double>, scale array<double>"), "mcd-medians")
    seen = _by_group(_levels(rows, *X), middle)
    z = [f"z{i}" for i in range(DIM)]
    seen = seen.selectExpr("*", *[f"({x} - mid[{i}]) / scale[{i}] as z{i}" for i, x in enumerate(X)])
    seen = seen.selectExpr("*", f"greatest(sqrt({' + '.join(f'{c} * {c}' for c in z)}), 1e-12D) as length")
    sums = seen.groupBy(*GROUP, "mid", "scale").agg(
        F.count("*").alias("cnt"), *map(F.expr, SUMS), *_products("p", X),
        *_products("u", [f"({c} / length)" for c in z]), *_products("t", [f"tanh({c})" for c in z]))
    return stored(sums.mapInPandas(_starts, FIT_SCHEMA), "mcd")


def fit_mcd(stats: DataFrame) -> DataFrame:
    """The fit (n, mean, inv, logdet, start) of every (lang, source), level 0, every lang, level 1,
    and all documents, level 2."""
    rows = stats.filter(~base_failed()).select("lang", "source", *[x.alias(n) for x, n in zip(_vector(), X)])
    fit = first_fits(rows)
    wide = _levels(rows, *X)
    for _ in range(MAX_STEPS):
        fit = stored(concentrate(wide, fit), "mcd")
        used = fit.filter((F.col("n") >= MIN_GROUP) | (F.col("level") == 2))
        fell = used.agg(F.max("fell")).first()[0]
        if fell is None or fell <= SETTLED:
            break
    best = F.min_by(F.struct("n", "mean", "inv", "logdet", "start"), F.struct("logdet", "start"))
    return stored(fit.groupBy(*GROUP).agg(best.alias("best")).select(*GROUP, "best.*"), "mcd-best")


def judge(stats: DataFrame, fit: DataFrame) -> DataFrame:
    """``stats`` with qs_base_failed, qs_distance (null where no document of the group passes the
    base rules) and qs_kept."""
    whole = fit.filter("level = 2").first()        # one row, of fixed size
    large = F.col("n") >= MIN_GROUP
    lang = fit.filter((F.col("level") == 1) & large).select(F.col("lang").alias("w_lang"), F.col("mean").alias("w_mean"), F.col("inv").alias("w_inv"))
    own = fit.filter("level = 0").join(lang, F.col("lang").eqNullSafe(F.col("w_lang")), "left")
    pick = lambda c: F.coalesce(F.when(large, F.col(c)), F.col(f"w_{c}"), F.lit(whole and whole[c]).cast("array<double>"))
    own = own.select(F.col("lang").alias("qs_o_lang"), F.col("source").alias("qs_o_source"), pick("mean").alias("qs_mean"), pick("inv").alias("qs_inv"))
    cols = [F.col(f"`{c}`") for c in stats.columns]
    rows = stats.join(own, F.col("lang").eqNullSafe(F.col("qs_o_lang")) & F.col("source").eqNullSafe(F.col("qs_o_source")), "left")
    rows = rows.select(*cols, "qs_mean", "qs_inv", *[x.alias(n) for x, n in zip(_vector(), X)])
    out = rows.select(*cols, base_failed().alias("qs_base_failed"), _distance().alias("qs_distance"))
    return out.withColumn("qs_kept", ~F.col("qs_base_failed") & ~F.coalesce(F.col("qs_distance") > CUTOFF, F.lit(False)))
