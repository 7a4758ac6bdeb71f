"""Quality rules: robust multivariate outliers, in DataFrame functions only.

Each text gets a vector of statistics, transformed towards symmetry.  For each
language and source the minimum-covariance-determinant estimate is searched from
several starts (medians with median absolute deviations, spatial signs, plain
moments): take the half of the rows with the smallest Mahalanobis distances,
estimate mean and covariance from it, and repeat until the determinant falls no
more; the start that ends at the smallest determinant wins.  After a consistency
correction and one reweighting step, rows whose squared robust distance exceeds the
cut-off are rejected; so are texts that fail the base rules.

Where a language and source have fewer than ``MIN_ROWS`` rows that pass the base rules,
the estimate of the whole language stands in, and where the language has too few,
that of the whole table, so every row that passes the base rules has a distance.  A
fixed smallest spread (``RIDGE``) is added to every covariance, as in the regularised
form of the estimator, so none is singular.

Each step is one aggregation by group and start, of sums that partial aggregation
reduces before any shuffle, and of a percentile sketch; rows of a hot group never
meet in one task.  Group estimates are broadcast to the rows up to ``SMALL`` groups, which are
counted first; beyond, both sides are joined by a shuffle, in which Spark splits skewed
partitions.  The driver sees one count a step.

Defined results: null, empty and blank texts have zeros, fail the base rules and have
no distance; null language or source is a group of its own; repeated rows count
each; very long texts are read whole; an empty table gives an empty result; of input
columns called like a statistic or a verdict, ``judged`` leaves out the input's,
``kept_rows`` returns all as they are.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Space, let, words_column

#: Rows below which a group has no estimate of its own.
MIN_ROWS = 30
#: Concentration steps at most; they end once the log determinant of every start falls by less than ``SETTLED``.
STEPS, SETTLED = 30, 1e-3
#: Coordinates of a vector.
DIM = 5
#: Smallest spread of a coordinate, in its own unit: a group without any variation must not reject small deviations.
RIDGE = (0.8, 0.15, 0.3, 1.0, 0.6)
#: Lines added to a text's lines before the share of repeated ones is taken: one of three says less than ten of thirty.
FEW_LINES = 6
#: Chi-square shares: of the half, of the reweighting step, of the cut-off.
HALF, REWEIGHT, CUT = 0.5, 0.975, 0.99999
#: Relative accuracy of the distance quantile.
ACCURACY = 1000
#: Groups whose estimates are broadcast (three starts of 25 numbers each).
SMALL = 20_000
SYMBOLS = "#*$%&|<>"
WINDOW = 8
STATISTICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
_COORDS = tuple(f"x{i}" for i in range(DIM))
_PAIRS = tuple((i, j) for i in range(DIM) for j in range(i + 1))


def chi_share(x: float, dim: int) -> float:
    """P(chi-square with ``dim`` degrees of freedom <= x)."""
    a, t = dim / 2, x / 2
    total, term, n = 1 / a, 1 / a, a
    while term > 1e-17 * total:
        n += 1
        term *= t / n
        total += term
    return total * math.exp(a * math.log(t) - t - math.lgamma(a))


def chi_quantile(share: float, dim: int) -> float:
    low, high = 1e-9, 200.0
    for _ in range(100):
        mid = (low + high) / 2
        low, high = (mid, high) if chi_share(mid, dim) < share else (low, mid)
    return high


CHI_HALF, CHI_REWEIGHT, CHI_CUT = (chi_quantile(s, DIM) for s in (HALF, REWEIGHT, CUT))
#: What makes the covariance of the central part of a normal sample that of the whole.
FACTOR_HALF, FACTOR_REWEIGHT = (s / chi_share(q, DIM + 2) for s, q in ((HALF, CHI_HALF), (REWEIGHT, CHI_REWEIGHT)))


def _repeat_words(words: Column) -> Column:
    """Words inside any WINDOW-word window that stands twice or more in the text."""
    count = F.size(words)

    def covered(hashes: Column) -> Column:
        pairs = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def repeated(s: Column) -> Column:
            last = F.size(s) - 1
            same = F.filter(s, lambda x, i: ((i > 0) & (F.get(s, i - 1)["h"] == x["h"])) | ((i < last) & (F.get(s, i + 1)["h"] == x["h"])))
            return F.array_sort(F.transform(same, lambda x: x["i"]))

        def length(p: Column) -> Column:
            return F.aggregate(p, F.struct(F.lit(0).alias("n"), F.lit(-WINDOW).alias("last")), lambda a, x: F.struct((a["n"] + F.least(F.lit(WINDOW), x - a["last"])).alias("n"), x.alias("last")), lambda a: a["n"].cast("long"))

        return let(pairs, lambda s: let(repeated(s), length))

    hashes = F.transform(F.sequence(F.lit(1), count - (WINDOW - 1)), lambda i: F.xxhash64(F.slice(words, i, WINDOW)))
    per_text = let(hashes, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h)))
    return F.when(count > WINDOW, per_text).otherwise(F.lit(0).cast("long"))


def statistics(docs: DataFrame) -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed (and _n_lines, lines with a word)."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    with_word = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    # the words are bound once per row, and so split once
    whole = let(words_column(text), lambda w: F.struct(F.size(w).cast("long").alias("n_words"), _repeat_words(w).alias("n_repeat_words")))
    out = docs.withColumn("_s", whole).withColumn("word_chars", F.length(F.regexp_replace(text, r"[\x20\x09-\x0D]+", "")).cast("long"))
    out = out.withColumn("n_symbols", (F.length(text) - F.length(F.translate(text, SYMBOLS, ""))).cast("long"))
    lines = let(with_word, lambda x: F.struct(F.size(x).cast("long").alias("n"), (F.size(x) - F.size(F.array_distinct(x))).cast("long").alias("dup")))
    out = out.withColumn("_lines", lines).withColumn("n_dup_lines", F.col("_lines.dup")).withColumn("_n_lines", F.col("_lines.n")).drop("_lines")
    out = out.withColumn("n_words", F.col("_s.n_words")).withColumn("n_repeat_words", F.col("_s.n_repeat_words")).drop("_s")
    return out.withColumn("base_failed", (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words")))


def _vector(rows: DataFrame) -> DataFrame:
    """The transformed statistics x0..x4."""
    n = F.greatest("n_words", F.lit(1)).cast("double")
    return rows.withColumns({
        "x0": F.log1p(F.col("n_words").cast("double")),
        "x1": F.log(F.greatest(F.col("word_chars"), F.lit(1)).cast("double") / n),
        "x2": F.log1p(100.0 * F.col("n_symbols") / F.greatest("word_chars", F.lit(1))),
        "x3": F.log1p(100.0 * F.col("n_repeat_words") / n),
        "x4": F.log1p(100.0 * F.col("n_dup_lines") / (F.col("_n_lines") + FEW_LINES)),
    })


def _factored(params: DataFrame) -> DataFrame:
    """``params`` (centres m*, covariances c*) with the Cholesky factor l* and the log determinant ``ld``."""
    for i, j in _PAIRS:
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"l{j}{k}"), range(j), F.col(f"c{i}{j}"))
        params = params.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit(1e-12))) if i == j else rest / F.col(f"l{j}{j}"))
    return params.withColumn("ld", sum(2 * F.log(f"l{i}{i}") for i in range(DIM)))


_PARAMS = ("key", "start", *[f"m{i}" for i in range(DIM)], *[f"l{i}{j}" for i, j in _PAIRS], "ld")


def _distance(rows: DataFrame) -> DataFrame:
    """``rows`` (with x*, m*, l*) and the squared distance d2."""
    for i in range(DIM):  # forward substitution
        rest = reduce(lambda a, k: a - F.col(f"l{i}{k}") * F.col(f"z{k}"), range(i), F.col(f"x{i}") - F.col(f"m{i}"))
        rows = rows.withColumn(f"z{i}", rest / F.col(f"l{i}{i}"))
    return rows.withColumn("d2", sum(F.col(f"z{i}") * F.col(f"z{i}") for i in range(DIM)))


def _estimate(rows: DataFrame, scale: float) -> DataFrame:
    """Mean and covariance (times ``scale``, plus ridge) by key and start, from sums of what is left after the median b*."""
    u = [F.col(f"x{i}") - F.col(f"b{i}") for i in range(DIM)]
    sums = rows.groupBy("key", "start").agg(*[F.avg(u[i]).alias(f"s{i}") for i in range(DIM)], *[F.avg(u[i] * u[j]).alias(f"s{i}{j}") for i, j in _PAIRS], *[F.first(f"b{i}").alias(f"b{i}") for i in range(DIM)])
    for i in range(DIM):
        sums = sums.withColumn(f"m{i}", F.col(f"b{i}") + F.col(f"s{i}"))
    for i, j in _PAIRS:
        sums = sums.withColumn(f"c{i}{j}", scale * (F.col(f"s{i}{j}") - F.col(f"s{i}") * F.col(f"s{j}")) + (RIDGE[i] ** 2 if i == j else 0.0))
    return _factored(sums).select(*_PARAMS)


def _sent(df: DataFrame, few: bool) -> DataFrame:
    return F.broadcast(df) if few else df


def kept_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` that are kept, with its columns, whatever they are called."""
    out = _judged(spark, docs, tuple(docs.columns)).filter("kept")
    return out.select(*[F.col(f"_row.`{c}`").alias(c) for c in docs.columns])


def judged(spark: SparkSession, docs: DataFrame, columns: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The ``columns`` of ``docs`` with the statistics, base_failed, kept and d2 (null if the base rules fail).

    A column that is called as one of these is left out.
    """
    own = (*STATISTICS, "base_failed", "kept", "d2")
    out = _judged(spark, docs, tuple(c for c in columns if c not in own))
    return out.select("_row.*", *[F.col(c) for c in own])


def _groups(spark: SparkSession, good: DataFrame, space: Space) -> DataFrame:
    """g, key (whose estimate its rows are held against), keys (the estimates its rows take part in): one row a language and source."""
    sizes = space.save(good.groupBy("g", "lang").agg(F.count("*").alias("n")))
    langs = sizes.groupBy("lang").agg(F.sum("n").alias("n_lang"), F.min("n").alias("least"))
    few = not langs.filter(F.col("n_lang") < MIN_ROWS).isEmpty()  # some language needs the whole table's estimate
    named = langs.select(F.col("lang").alias("_l"), "n_lang", "least")
    out = sizes.join(named, F.col("lang").eqNullSafe(F.col("_l")))
    own, lang, whole = F.concat(F.lit("0"), "g"), F.concat(F.lit("1"), F.coalesce(F.concat(F.lit("="), "lang"), F.lit(""))), F.lit("2")
    enough, lang_enough = F.col("n") >= MIN_ROWS, F.col("n_lang") >= MIN_ROWS
    keys = F.array(F.when(enough, own), F.when(lang_enough & (F.col("least") < MIN_ROWS), lang), F.when(F.lit(few), whole))
    return space.save(out.select("g", F.when(enough, own).when(lang_enough, lang).otherwise(whole).alias("key"), F.array_compact(keys).alias("keys")))


def _starts(members: DataFrame, middle: DataFrame, few: bool) -> DataFrame:
    """First estimates of each key: medians and deviations, spatial signs about the median, plain moments."""
    off = members.join(_sent(middle, few), "key")
    spread = off.groupBy("key").agg(*[F.percentile_approx(F.abs(F.col(f"x{i}") - F.col(f"b{i}")), 0.5, ACCURACY).alias(f"a{i}") for i in range(DIM)])
    scales = spread.select("key", *[F.sqrt(F.pow(1.4826 * F.col(f"a{i}"), 2) + RIDGE[i] ** 2).alias(f"s{i}") for i in range(DIM)])
    rows = off.join(_sent(scales, few), "key")
    unit = [(F.col(f"x{i}") - F.col(f"b{i}")) / F.col(f"s{i}") for i in range(DIM)]
    norm = F.greatest(F.sqrt(sum(u * u for u in unit)), F.lit(1e-9))
    rows = rows.withColumn("_norm", norm)
    sign = [u / F.col("_norm") for u in unit]
    signs = rows.groupBy("key").agg(*[F.avg(sign[i] * sign[j]).alias(f"w{i}{j}") for i, j in _PAIRS], *[F.first(f"b{i}").alias(f"m{i}") for i in range(DIM)], *[F.first(f"s{i}").alias(f"s{i}") for i in range(DIM)])
    medians = signs.select("key", F.lit("median").alias("start"), *[f"m{i}" for i in range(DIM)], *[(F.pow(f"s{i}", 2) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i, j in _PAIRS])
    spatial = signs.select("key", F.lit("sign").alias("start"), *[f"m{i}" for i in range(DIM)], *[(DIM * F.col(f"w{i}{j}") * F.col(f"s{i}") * F.col(f"s{j}") + (RIDGE[i] ** 2 if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS])
    moments = _estimate(off.withColumn("start", F.lit("moments")), 1.0)
    return _factored(medians.unionByName(spatial)).select(*_PARAMS).unionByName(moments).withColumn("ld", F.lit(float("inf")))


def _halves(members: DataFrame, params: DataFrame, few: bool) -> DataFrame:
    """Members of each key and start with their distance d2 and its median q."""
    far = _distance(members.join(_sent(params, few), "key"))
    return far.join(_sent(far.groupBy("key", "start").agg(F.percentile_approx("d2", 0.5, ACCURACY).alias("q")), few), ["key", "start"])


def _judged(spark: SparkSession, docs: DataFrame, columns: tuple[str, ...]) -> DataFrame:
    """The columns in a struct ``_row``, and what was found."""
    space = Space(spark, "rules")
    named = docs.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("_row"), F.col("lang").cast("string"), F.to_json(F.struct(F.col("lang").cast("string"), F.col("source").cast("string"))).alias("g"), F.col("text").cast("string"))
    rows = space.save(_vector(statistics(named)).drop("text", "_n_lines"))  # texts are read and split once
    good = rows.filter(~F.col("base_failed"))
    groups = _groups(spark, good, space)
    few = groups.count() <= SMALL
    members = good.join(_sent(groups.select("g", F.explode("keys").alias("key")), few), "g").select("key", *_COORDS)
    middle = space.save(members.groupBy("key").agg(*[F.percentile_approx(f"x{i}", 0.5, ACCURACY).alias(f"b{i}") for i in range(DIM)]))
    members = space.save(members.join(_sent(middle, few), "key"))

    bare = members.drop(*[f"b{i}" for i in range(DIM)])
    params = space.save(_starts(bare, middle, few))
    ends = []
    for _ in range(STEPS):
        new = _estimate(_halves(members, params, few).filter("d2 <= q"), FACTOR_HALF)
        old = params.select("key", "start", F.col("ld").alias("_old"))
        new = space.save(new.join(old, ["key", "start"]).withColumn("_open", F.col("_old") - F.col("ld") > SETTLED).drop("_old"))
        ends.append(new.filter(~F.col("_open")).drop("_open"))
        params = new.filter("_open").drop("_open")
        if params.isEmpty():
            break
    else:
        ends.append(params)
    ended = reduce(DataFrame.unionByName, ends)
    # the smallest determinant; of equal ones the first start by name
    best = ended.groupBy("key").agg(F.min_by(F.struct(*[c for c in _PARAMS if c != "key"]), F.struct("ld", "start")).alias("b")).select("key", "b.*")
    # reweighting: all rows within the quantile, after a median distance above its chi-square value is scaled to it
    near = _halves(members, best, few).filter(F.col("d2") * CHI_HALF / F.greatest("q", F.lit(CHI_HALF)) <= CHI_REWEIGHT)
    final = space.save(_estimate(near, FACTOR_REWEIGHT).drop("start", "ld"))
    space.drop(members, middle)
    out = _distance(rows.join(_sent(groups.select("g", "key"), few), "g", "left").join(_sent(final, few), "key", "left"))
    out = out.withColumn("d2", F.when(~F.col("base_failed"), F.col("d2")))
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("d2") <= CHI_CUT))
