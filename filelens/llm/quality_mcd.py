"""Quality rules by robust multivariate outliers.

Every text gets base statistics from its whole bytes. Texts that pass the
base rules become vectors of transformed statistics; per (language, source)
the minimum covariance determinant (MCD) gives a centre and a scatter that
junk does not move, and a text is rejected when its robust Mahalanobis
distance is beyond the cut-off.

A text's statistics are rates over its words, and short texts show them less
exactly. Its distance is therefore taken in the group's scatter S plus the
sampling noise N / n of a text of n words, where N is diagonal (:data:`NOISE`).
With the generalised eigenvectors of S and N (W'NW = 1, W'SW = L) the distance
is a plain sum, (W'(x - c))_k^2 / (L_k + 1 / n), for every length of text.

The MCD is computed by distributed C-steps until the determinants settle (a
step that does not lower a group's determinant is undone): the groups' h-quantile of the distances and the moments of the rows inside it are
plain aggregates with map-side partial sums, so a hot group is no larger a
task than any other.
Groups under ``min_group`` rows use their language's estimate, and then that
of the whole corpus, so that no row goes without one.

Defined cases: a null or white-space text has no words and fails the base
rules; null language or source is a group of its own; tied, repeated and
extra rows and columns are kept as they are; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filelens.operators.common import materialized

from . import textops as X
from .common import col, fresh

# Base rules
MIN_WORDS = 10
MAX_REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = "[#*$%&|<>]"

# MCD
SUPPORT = 0.75       # share of a group inside the covered half
MOST_STEPS = 12      # C-steps after the median/MAD start, unless it settles before
SETTLED = 0.01       # least gain in a group's log determinant for which they go on
MIN_GROUP = 200      # rows an estimate needs
CUTOFF = 25.0        # squared distance; a Gaussian row exceeds it once in 20,000
# Variance of a feature in a text of one word (of n words: that over n). Word
# lengths within a text have a squared coefficient of variation of some 0.35.
# The square root of a count's rate has the variance m / 4n if the count comes
# in lots of m: symbols and lines in pairs, repeated words in passages of 50.
NOISE = (0.35, 0.5, 0.5, 12.5)
GUARD = 0.01         # spread that texts of a group have at least: only against singular scatters
DIM = len(NOISE)
_KEYS = [(i, j) for i in range(DIM) for j in range(i, DIM)]

STATS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
_STATS_TYPE = T.StructType([T.StructField(s, T.LongType()) for s in STATS])

_IS_SYMBOL = np.zeros(256, bool)
_IS_SYMBOL[[ord(c) for c in SYMBOLS[1:-1]]] = True


def _slice_stats(buf: np.ndarray, offs: np.ndarray) -> list[np.ndarray]:
    n = len(offs) - 1
    starts, ends = X.word_spans(buf, offs)
    rows = X.rows_of(starts, offs)
    n_words = np.bincount(rows, minlength=n)
    # a code point is a byte that does not continue another
    chars = X.per_row(((buf & 0xC0) != 0x80) & ~X._SPACE[buf], offs)
    symbols = X.per_row(_IS_SYMBOL[buf], offs)

    ls, le = X.line_spans(buf, offs)
    with_word = np.searchsorted(starts, le) > np.searchsorted(starts, ls)
    ls, le = ls[with_word], le[with_word]
    line_rows = X.rows_of(ls, offs)
    keys = X.keyed(X.span_hashes(buf, ls, le), line_rows)
    _, first = np.unique(keys, return_index=True)
    dup_lines = np.bincount(line_rows, minlength=n) - np.bincount(line_rows[first], minlength=n)

    at, grams = X.ngram_hashes(X.span_hashes(buf, starts, ends), rows, WINDOW)
    keys = X.keyed(grams, rows[at])
    _, which, counts = np.unique(keys, return_inverse=True, return_counts=True)
    repeated = at[counts[which] > 1]
    covered = np.zeros(len(starts), bool)
    for k in range(WINDOW):
        covered[repeated + k] = True
    repeat_words = np.bincount(rows[covered], minlength=n)
    return [n_words, chars, symbols, dup_lines, repeat_words]


@F.arrow_udf(_STATS_TYPE)
def text_stats(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    for texts in batches:
        parts = [_slice_stats(buf, offs) for _, _, buf, offs in X.text_slices(texts)]
        cols = [np.concatenate(c) for c in zip(*parts)] if parts else [np.zeros(0, np.int64)] * len(STATS)
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in cols], STATS)


def _words(s: str):
    return F.greatest(col(s)["n_words"], F.lit(1)).cast("double")


def _features(s: str) -> list:
    """Transformed statistics of the struct column ``s``: log word length and
    square roots of rates (which evens out the spread of small rates)."""
    n = _words(s)
    lines = F.sqrt(col(s)["n_dup_lines"] / n)
    return [F.log(F.greatest(col(s)["word_chars"], F.lit(1)) / n), F.sqrt(col(s)["n_symbols"] / n),
            lines, F.sqrt(col(s)["n_repeat_words"] / n)]


def base_failed(s: str):
    return (col(s)["n_words"] < MIN_WORDS) | (100 * col(s)["n_repeat_words"] > MAX_REPEAT_PERCENT * col(s)["n_words"])


def _distance(x: list, words, centre, axes, spread):
    """Squared Mahalanobis distance in the scatter plus the noise of a text of
    ``words`` words, as plain arithmetic on columns."""
    d = [xi - centre[i] for i, xi in enumerate(x)]
    total = F.lit(0.0)
    for k in range(DIM):
        along = sum((d[i] * axes[i * DIM + k] for i in range(1, DIM)), d[0] * axes[k])
        total = total + along * along / (spread[k] + 1 / words)
    return total


def _consistency(share: float) -> float:
    """Factor that makes the scatter of the inner ``share`` of a Gaussian
    estimate the whole scatter (DIM = 4 has closed chi-square tails)."""
    lo, hi = 0.0, 200.0
    for _ in range(100):  # chi2_4 distribution function: 1 - e^{-q/2} (1 + q/2)
        q = (lo + hi) / 2
        lo, hi = (q, hi) if 1 - np.exp(-q / 2) * (1 + q / 2) < share else (lo, q)
    inner = 1 - np.exp(-q / 2) * (1 + q / 2 + q * q / 8)  # chi2_6 at q
    return share / inner


def _axes(scatter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """W and L with W'NW = 1 and W'SW = L."""
    root = np.sqrt(NOISE)
    spread, turned = np.linalg.eigh(scatter / np.outer(root, root))
    return turned / root[:, None], np.maximum(spread, 0.0)


def _solve(batches):
    """Rows of moments -> centre, axes and spreads along them, log determinant."""
    factor = _consistency(SUPPORT)
    for b in batches:
        m = np.stack([b.column(f"m{i}").to_numpy(False) for i in range(DIM)], 1) if b.num_rows else np.zeros((0, DIM))
        p = [b.column(f"p{k}").to_numpy(False) for k in range(len(_KEYS))]
        axes, spreads, logs = [], [], []
        for r in range(len(m)):
            s = np.zeros((DIM, DIM))
            for k, (i, j) in enumerate(_KEYS):
                s[i, j] = s[j, i] = (p[k][r] - m[r, i] * m[r, j]) * factor
            s[np.diag_indices(DIM)] = np.maximum(np.diag(s), 0) + GUARD ** 2
            w, spread = _axes(s)
            axes.append(w.ravel())
            spreads.append(spread)
            logs.append(float(np.log(np.maximum(spread, 1e-12)).sum()))
        doubles = pa.list_(pa.float64())
        yield pa.RecordBatch.from_arrays(
            [b.column("g"), b.column("n"), pa.array(list(m), doubles), pa.array(axes, doubles), pa.array(spreads, doubles),
             pa.array(logs, pa.float64())], ["g", "n", "centre", "axes", "spread", "log_det"])


_MODEL = "g string, n bigint, centre array<double>, axes array<double>, spread array<double>, log_det double"


def _moments(rows: DataFrame) -> DataFrame:
    """n, means and second moments per group ``g`` (partial sums map-side)."""
    x = [f"x{i}" for i in range(DIM)]
    aggs = [F.count(F.lit(1)).alias("n")] + [F.avg(c).alias(f"m{i}") for i, c in enumerate(x)] \
        + [F.avg(F.col(x[i]) * F.col(x[j])).alias(f"p{k}") for k, (i, j) in enumerate(_KEYS)]
    return rows.groupBy("g").agg(*aggs).mapInArrow(_solve, _MODEL)


def _lower(step: DataFrame, model: DataFrame) -> DataFrame:
    """Per group the estimate of the lower determinant, and the ``gain``."""
    cols = ["n", "centre", "axes", "spread", "log_det"]
    was = model.select("g", F.struct(*cols).alias("was"))
    worse = F.col("was.log_det") <= F.col("now.log_det")
    best = F.when(worse, F.col("was")).otherwise(F.col("now"))
    return step.select("g", F.struct(*cols).alias("now")).join(was, "g").select(
        "g", *[best[c].alias(c) for c in cols],
        F.greatest(F.col("was.log_det") - F.col("now.log_det"), F.lit(0.0)).alias("gain"))


def _group_name(*parts) -> F.Column:
    """One text per group at a level; nulls differ from any text."""
    return F.to_json(F.array(*[p.cast("string") for p in parts])) if parts else F.lit("[]")


def fit(vectors: DataFrame, support: float = SUPPORT, most_steps: int = MOST_STEPS,
        min_group: int = MIN_GROUP) -> DataFrame:
    """MCD estimates (g, n, centre, axes, spread, log_det, gain) at all three levels
    from rows of (g0, g1, g2, words, x0..x3): the row's names at source,
    language and corpus level.

    Start: per-feature medians and median absolute deviations, then C-steps
    until no group's determinant falls any more (or ``most_steps``).
    """
    x = [F.col(f"x{i}") for i in range(DIM)]
    flat = vectors.select(F.explode(F.array("g0", "g1", "g2")).alias("g"), "words", *x)
    sizes = flat.groupBy("g").agg(F.count(F.lit(1)).alias("size")).where(F.col("size") >= min_group)
    med = flat.groupBy("g").agg(*[F.percentile_approx(c, 0.5, 1000).alias(f"c{i}") for i, c in enumerate(x)])
    med = materialized(med.join(sizes, "g"), "mcd-start")
    dev = flat.join(med, "g")
    spread = dev.groupBy("g").agg(*[
        F.percentile_approx(F.abs(c - F.col(f"c{i}")), 0.5, 1000).alias(f"s{i}") for i, c in enumerate(x)])
    start = med.join(spread, "g").select(
        "g", F.col("size").alias("n"), F.array(*[F.col(f"c{i}") for i in range(DIM)]).alias("centre"),
        F.array(*[F.lit(v) for v in np.diag(1 / np.sqrt(NOISE)).ravel().tolist()]).alias("axes"),
        F.array(*[(F.pow(1.4826 * F.col(f"s{i}"), 2) + GUARD ** 2) / NOISE[i] for i in range(DIM)]).alias("spread"),
        F.lit(None).cast("double").alias("log_det"))
    model = materialized(start, "mcd-model")
    for step in range(most_steps):
        near = flat.join(model.select("g", "centre", "axes", "spread"), "g").select(
            "g", *x, _distance(x, F.col("words"), F.col("centre"), F.col("axes"), F.col("spread")).alias("d"))
        limit = materialized(near.groupBy("g").agg(F.percentile_approx("d", support, 1000).alias("limit")), "mcd-limit")
        model = materialized(_lower(_moments(near.join(limit, "g").where("d <= limit")), model), "mcd-model")
        # one number; the start has no determinant
        if step and (model.agg(F.max("gain")).first()[0] or 0.0) <= SETTLED:
            break
    return model


def score(rows: DataFrame, s: str, model: DataFrame, cutoff: float = CUTOFF, distance: str = "mcd_distance",
          kept: str = "mcd_kept") -> DataFrame:
    """Adds the columns ``distance`` (null where base rules fail) and ``kept``,
    from the finest level of the model that has the row's group."""
    lang, source = (F.col(c) for c in ("lang", "source"))
    # every row with statistics is of the corpus
    names = [_group_name(lang, source), _group_name(lang), F.when(col(s).isNotNull(), _group_name())]
    out, parts = rows, []
    for name in names:
        group, part = fresh("mcd_group", out), fresh("mcd_part", out)
        out = out.join(model.select(F.col("g").alias(group), F.struct("centre", "axes", "spread").alias(part)),
                       name == F.col(group), "left").drop(group)
        parts.append(part)
    best = fresh("mcd_best", out)
    out = out.withColumn(best, F.coalesce(*parts)).drop(*parts)
    d = F.when(~base_failed(s), _distance(_features(s), _words(s), *(F.col(f"{best}.{c}") for c in ("centre", "axes", "spread"))))
    return out.withColumn(distance, d) \
        .withColumn(kept, ~base_failed(s) & (F.coalesce(F.col(distance), F.lit(0.0)) <= cutoff)).drop(best)


def judge(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """Per row of ``docs`` (text, lang, source and any other columns): struct
    ``stats``, ``base_failed``, ``mcd_distance`` and ``kept``; columns of these
    names give way and the text is dropped. The statistics are computed once
    and written (narrow rows)."""
    own = ("text", "stats", "mcd_distance", "base_failed", "kept")
    keep = [c for c in docs.columns if c.lower() not in own]
    rows = materialized(docs.select(*[col(c) for c in keep], text_stats(col("text")).alias("stats")), "quality-stats")
    scored = score(rows, "stats", fit(_vectors(rows, "stats")), cutoff, kept="kept")
    return scored.withColumn("base_failed", base_failed("stats"))


def _vectors(rows: DataFrame, s: str) -> DataFrame:
    lang, source = F.col("lang"), F.col("source")
    return rows.where(~base_failed(s)).select(
        _group_name(lang, source).alias("g0"), _group_name(lang).alias("g1"), _group_name().alias("g2"), _words(s).alias("words"),
        *[f.alias(f"x{i}") for i, f in enumerate(_features(s))])


def keep_good(docs: DataFrame, cutoff: float = CUTOFF) -> DataFrame:
    """The rows of ``docs`` that :func:`judge` keeps, with all their columns.
    Only the small table of group estimates meets the texts."""
    s = fresh("quality_stats", docs)
    rows = materialized(docs.select("lang", "source", text_stats(col("text")).alias("stats")), "quality-stats")
    model = fit(_vectors(rows, "stats"))
    rated = docs.withColumn(s, text_stats(col("text")))
    distance = fresh("mcd_distance", rated)
    kept = fresh("mcd_kept", rated)
    out = score(rated, s, model, cutoff, distance, kept)
    return out.where(F.col(kept)).select(*[col(c) for c in docs.columns])
