"""Quality rules: base statistics of a text, and robust multivariate outliers per language and source."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import materialize, spare
from .textkit import WordHashes, shingles, utf8

STATS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
VERDICT = ("distance", "base_failed", "kept")
DIMS = ("x_length", "x_word", "x_symbols", "x_lines", "x_repeats")
#: Standard deviation, in each dimension, that even a group of identical texts is given.
LEAST_SD = (0.5, 0.35, 0.5, 0.4, 0.1)
SHARE = 0.5  #: of each key's rows that fit; a group of copies may hold a third of them, and the rest holds outliers too
PRIOR_WORDS, PRIOR_CHARS = 50, 275  #: added to each text, so that short ones don't scatter more
P = len(DIMS)
LEAST_ROWS = 5 * P  #: of a key that gets an estimate of its own
STARTS = 3  #: small subsets that a key's estimate begins at, besides its medians
BROADCAST_ROWS = 20_000  #: of a counted table, some 4 MB of estimates
PAIRS = [(i, j) for i in range(P) for j in range(i, P)]
SPACE = bytes([9, 10, 11, 12, 13, 32])


def text_stats(text: str | None, cache: WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text (null: none)."""
    b = utf8(text)
    words = b.split()
    n = len(words)
    letters = b.translate(None, SPACE)
    chars = len(letters) - int(np.count_nonzero((np.frombuffer(letters, np.uint8) & 0xC0) == 0x80))
    symbols = len(letters) - len(letters.translate(None, b"#*$%&|<>"))
    lines = [x for x in b.split(b"\n") if x and not x.isspace()]
    repeated = 0
    if n > 8:
        h = shingles(cache.of(words), 8)
        order = np.argsort(h, kind="stable")
        same = h[order][1:] == h[order][:-1]
        if same.any():
            twice = np.zeros(len(h), bool)
            twice[order[1:][same]] = True
            twice[order[:-1][same]] = True
            edge = np.zeros(n + 1, np.int64)
            at = np.flatnonzero(twice)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + 8, -1)
            repeated = int(np.count_nonzero(np.cumsum(edge)[:n]))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated


def with_stats(docs: DataFrame, keep: list[str], text_col: str = "text") -> DataFrame:
    """Columns ``keep`` of ``docs`` and the five statistics, which replace columns of their names. Null
    and empty texts have none of anything; repeated rows each get theirs; an empty table stays empty."""
    keep = [c for c in keep if c.lower() not in STATS]
    inner = spare("text", [*keep, *STATS])
    source = docs.select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text_col}`").cast("string").alias(inner))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in source.schema if f.name != inner] + [f"{c} long" for c in STATS])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = WordHashes()
        for batch in batches:
            rows = [text_stats(t.as_py(), cache) for t in batch.column(inner)]
            numbers = np.array(rows, np.int64).reshape(-1, len(STATS))
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in keep] + [pa.array(numbers[:, i]) for i in range(len(STATS))], [*keep, *STATS])

    return source.mapInArrow(run, schema)


def _vectors(df: DataFrame, lang_col: str, source_col: str) -> DataFrame:
    """Adds the transformed statistics and the keys of the row's group, its language and all rows."""
    words = F.col("n_words") + PRIOR_WORDS
    rate = lambda c: F.log1p(100 * F.col(c) / words)
    lang, source = (F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("")) for c in (lang_col, source_col))
    return df.withColumns(
        {
            "x_length": F.log(words),
            "x_word": (F.col("word_chars") + PRIOR_CHARS) / words,
            "x_symbols": rate("n_symbols"),
            "x_lines": rate("n_dup_lines"),
            "x_repeats": F.col("n_repeat_words") / words,
            "_keys": F.array(F.concat(F.lit("s\t"), lang, F.lit("\t"), source), F.concat(F.lit("l\t"), lang), F.lit("g")),
        }
    )


def _chi2_cdf(x: float, k: int) -> float:
    """P(chi-squared with k degrees of freedom <= x), by the series of the incomplete gamma function."""
    a, z = k / 2, x / 2
    if z <= 0:
        return 0.0
    term = total = 1 / a
    n = a
    while term > total * 1e-16:
        n += 1
        term *= z / n
        total += term
    return min(1.0, total * math.exp(a * math.log(z) - z - math.lgamma(a)))


def _chi2_quantile(p: float, k: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if _chi2_cdf(mid, k) < p else (low, mid)
    return high


def _medians(values: DataFrame, by: list[str], value: str) -> DataFrame:
    """Lower median of ``value`` in steps of 1/500 in each group, from its histogram."""
    bins = values.groupBy(*by, F.floor(F.col(value) * 500).alias("bin")).count()
    w = Window.partitionBy(*by)
    bins = bins.withColumns({"_n": F.sum("count").over(w), "_c": F.sum("count").over(w.orderBy("bin"))})
    return bins.filter("2 * _c >= _n").groupBy(*by).agg(((F.min("bin") + F.lit(0.5)) / 500).alias("median"))


def _fits(df: DataFrame, factor: float) -> DataFrame:
    """(key, start, n, sums, cross sums) -> (key, start, logarithm of the determinant, centre, inverse) of
    the floored covariance."""
    floor = np.diag(np.square(LEAST_SD))
    names = ["key", "start", "det", *(f"m{i}" for i in range(P)), *(f"q{i}{j}" for i, j in PAIRS)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            n = batch.column("n").to_numpy().astype(float)
            s = np.stack([batch.column(f"s{i}").to_numpy() for i in range(P)], 1) / n[:, None]
            cov = np.empty((len(n), P, P))
            for i, j in PAIRS:
                cov[:, i, j] = cov[:, j, i] = batch.column(f"c{i}{j}").to_numpy() / n - s[:, i] * s[:, j]
            cov = cov * factor + floor
            inv, det = np.linalg.inv(cov), np.round(np.linalg.slogdet(cov)[1], 9)  # equal subsets stay equal in any order of adding
            yield pa.RecordBatch.from_arrays([batch.column("key"), batch.column("start"), pa.array(det), *(pa.array(s[:, i]) for i in range(P)), *(pa.array(inv[:, i, j]) for i, j in PAIRS)], names)

    return df.mapInArrow(run, ", ".join(["key string", "start int", *(f"{c} double" for c in names[2:])]))


def _moments(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key", "start").agg(
        F.count("*").alias("n"),
        *(F.sum(c).alias(f"s{i}") for i, c in enumerate(DIMS)),
        *(F.sum(F.col(DIMS[i]) * F.col(DIMS[j])).alias(f"c{i}{j}") for i, j in PAIRS),
    )


def _distance() -> Column:
    """Squared Mahalanobis distance of a row from the centre joined to it."""
    d = [F.col(c) - F.col(f"m{i}") for i, c in enumerate(DIMS)]
    total = F.lit(0.0)
    for i, j in PAIRS:
        total = total + d[i] * d[j] * F.col(f"q{i}{j}") * (1 if i == j else 2)
    return total


def _needed(vectors: DataFrame, least_rows: int) -> DataFrame:
    """Keys with rows enough for an estimate that some row is judged by: each large language and source,
    a language with a smaller source in it, and all rows if a language is small."""
    groups = vectors.groupBy(*(F.col("_keys")[i].alias(f"k{i}") for i in range(3))).agg(F.count("*").alias("n"))
    langs = groups.groupBy("k1", "k2").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    whole = langs.groupBy("k2").agg(F.sum("n").alias("n"), F.min("n").alias("least"))
    own = groups.filter(F.col("n") >= least_rows).select(F.col("k0").alias("key"))
    langs = langs.filter((F.col("n") >= least_rows) & (F.col("least") < least_rows)).select("k1")
    return own.unionByName(langs.toDF("key")).unionByName(whole.filter((F.col("n") >= 20) & (F.col("least") < least_rows)).select(F.col("k2").alias("key")))


def _sized(small: DataFrame, rows: int) -> DataFrame:
    """A table of keys or estimates with at most ``rows`` counted rows: broadcast if that is short, else
    merged, where Spark splits partitions of hot keys."""
    return F.broadcast(small) if rows <= BROADCAST_ROWS else small.hint("merge")


def _medians_start(rows: DataFrame) -> DataFrame:
    """Start 0: medians, and median deviations without covariances."""
    long = rows.select("key", F.posexplode(F.array(*DIMS)).alias("dim", "x"))
    centre = materialize(_medians(long, ["key", "dim"], "x"), "medians")
    far = long.join(centre, ["key", "dim"]).select("key", "dim", F.abs(F.col("x") - F.col("median")).alias("x"))
    scale = _medians(far, ["key", "dim"], "x").select("key", "dim", (F.col("median") * 1.4826).alias("scale"))
    return centre.join(scale, ["key", "dim"]).groupBy("key").agg(
        F.lit(0).alias("start"),
        F.lit(0.0).alias("det"),
        *(F.max(F.when(F.col("dim") == i, F.col("median"))).alias(f"m{i}") for i in range(P)),
        *(
            F.max(F.when(F.col("dim") == i, 1 / (F.col("scale") ** 2 + LEAST_SD[i] ** 2)) if i == j else F.lit(0.0)).alias(f"q{i}{j}")
            for i, j in PAIRS
        ),
    )


def _elemental_starts(rows: DataFrame, starts: int) -> DataFrame:
    """Starts 1 to ``starts``: mean and covariance of one row more than there are dimensions, those of
    smallest seeded hash. The hash is of the row's values, so copies of a text count once here."""
    picks = [(s, i) for s in range(1, starts + 1) for i in range(P + 1)]
    value = lambda s, i: F.struct(F.xxhash64(F.lit(s), F.lit(i), *DIMS).alias("h"), F.lit(s).alias("start"), *DIMS)
    picked = rows.groupBy("key").agg(*(F.min(value(s, i)).alias(f"p{s}_{i}") for s, i in picks))
    picked = picked.select("key", F.explode(F.array(*(f"p{s}_{i}" for s, i in picks))).alias("p")).select("key", "p.start", *(f"p.{c}" for c in DIMS))
    return _fits(_moments(picked), 1.0)


def fit_outliers(
    stats: DataFrame, lang_col: str = "lang", source_col: str = "source", share: float = SHARE, steps: int = 6, least_rows: int = LEAST_ROWS, starts: int = STARTS
) -> DataFrame:
    """Minimum-covariance-determinant estimates ``(key, m*, q*)`` of each language and source, and, for
    rows of smaller ones, of their language or of all rows; a key has at least ``least_rows`` rows
    (all rows: at least 20).

    Each key begins at its medians and at ``starts`` small subsets of its rows. A concentration step
    keeps the ``share`` of a key's rows with the smallest distances and estimates anew. After two
    steps from every start, the one with the smallest determinant goes on; the last step is
    reweighted at the 97.5 % quantile. Every step is a few sums per key over all rows, so a source
    of any size is no burden for one task; the share is cut on a histogram of distances. Covariances
    have the floor ``LEAST_SD`` (a regularised determinant, as many texts agree in a statistic). The
    estimate holds while less than 1 - ``share`` of a key's rows are contaminated.
    """
    vectors = stats.select(*STATS, F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{source_col}`").alias("_source"))
    vectors = _vectors(vectors, "_lang", "_source").select("_keys", *DIMS)
    needed = materialize(_needed(vectors, least_rows), "keys")
    n_keys = needed.count()
    rows = materialize(vectors.select(F.explode("_keys").alias("key"), *DIMS).join(_sized(needed, n_keys), "key"), "vectors")
    n_fits = n_keys * (1 + starts)
    factor = share / _chi2_cdf(_chi2_quantile(share, P), P + 2)
    w = Window.partitionBy("key", "start")

    def concentrate(fits: DataFrame) -> DataFrame:
        near = rows.join(_sized(fits, n_fits), "key").select("key", "start", *DIMS, F.floor(F.log1p(_distance()) * 200).alias("bin"))
        bins = near.groupBy("key", "start", "bin").count()
        bins = bins.withColumns({"_n": F.sum("count").over(w), "_c": F.sum("count").over(w.orderBy("bin"))})
        cut = bins.filter(F.col("_c") >= share * F.col("_n")).groupBy("key", "start").agg(F.min("bin").alias("cut"))
        cut = _sized(cut, n_fits)
        return materialize(_fits(_moments(near.join(cut, ["key", "start"]).filter("bin <= cut")), factor), "fits")

    fits = _medians_start(rows)
    if starts:
        fits = fits.unionByName(_elemental_starts(rows, starts))
    fits = materialize(fits, "fits")
    for _ in range(min(2, steps)):
        fits = concentrate(fits)
    rest = [c for c in fits.columns if c not in ("key", "det", "start")]
    fits = materialize(fits.groupBy("key").agg(F.min(F.struct("det", "start", *rest)).alias("r")).select("key", "r.*"), "fits")
    for _ in range(steps - 2):
        fits = concentrate(fits)
    inner = rows.join(_sized(fits, n_keys), "key").filter(_distance() <= _chi2_quantile(0.975, P)).select("key", "start", *DIMS)
    reweighted = 0.975 / _chi2_cdf(_chi2_quantile(0.975, P), P + 2)
    return materialize(_fits(_moments(inner), reweighted).drop("start", "det"), "fits")


def judge(stats: DataFrame, fits: DataFrame, quantile: float = 1 - 1e-5, lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """Adds ``distance``, ``base_failed`` and ``kept`` to rows with statistics.

    base_failed: fewer than 20 words, or over 30 % of them in repeated 8-word windows. The distance is
    from the estimate of the row's language and source, else its language, else all rows; none: 0.
    kept: not base_failed, and the squared distance is within the chi-squared ``quantile``.
    """
    cut = _chi2_quantile(quantile, P)
    # The given columns travel as one, so that none can be taken for one of those below.
    whole = F.struct(*(F.col(f"`{c}`") for c in stats.columns)).alias("_row")
    rows = stats.select(whole, *STATS, F.col(f"`{lang_col}`").alias("_lang"), F.col(f"`{source_col}`").alias("_source"))
    rows = _vectors(rows, "_lang", "_source")
    names = [c for c in fits.columns if c != "key"]
    n_fits = fits.count()
    for level, kind in enumerate("slg"):
        part = fits.filter(F.col("key").startswith(kind)).select(F.col("key").alias(f"_k{level}"), *(F.col(c).alias(f"{c}_{level}") for c in names))
        rows = rows.join(_sized(part, n_fits), F.col("_keys")[level] == F.col(f"_k{level}"), "left")
    pick = lambda c: F.when(F.col("_k0").isNotNull(), F.col(f"{c}_0")).when(F.col("_k1").isNotNull(), F.col(f"{c}_1")).otherwise(F.col(f"{c}_2"))
    rows = rows.select("_row", *STATS, *DIMS, *(pick(c).alias(c) for c in names))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    distance = F.coalesce(_distance(), F.lit(0.0))
    given = [F.col("_row")[c].alias(c) for c in stats.columns if c.lower() not in VERDICT]
    return rows.select(*given, distance.alias("distance"), failed.alias("base_failed"), (~failed & (distance <= cut)).alias("kept"))


def with_quality(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """``docs`` with statistics, distance, base_failed and kept (see ``fit_outliers`` and ``judge``).

    The statistics are computed twice, once to fit and once beside the rows, so that texts are shuffled
    only where estimates are too many to be broadcast. Null text: no words, so base_failed. Null
    language or source: a group of its own. An empty table gives an empty result; repeated rows each
    count and each get a result. Columns of ``docs`` named like those that are added, in any case, are
    replaced; all others stay.
    """
    plain = docs.select(*(F.col(f"`{c}`") for c in docs.columns if c.lower() not in (*STATS, *VERDICT)))
    fits = fit_outliers(materialize(with_stats(plain, [lang_col, source_col], text_col), "stats"), lang_col, source_col, SHARE)
    return judge(with_stats(plain, plain.columns, text_col), fits, lang_col=lang_col, source_col=source_col)
