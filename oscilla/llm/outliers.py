"""Quality rules as robust multivariate outliers, in DataFrame functions only.

Statistics.  Words are maximal runs outside 0x20 and 0x09-0x0D.  Per text: words, their code
points, symbols ``#*$%&|<>``, lines equal to an earlier line, and words inside 3-word windows that
occur twice or more.  Windows are compared by 64-bit hashes within one text.

Method.  Four transformed statistics are modelled per language and source by the
minimum-covariance-determinant estimate: the mean and covariance of those three quarters of the
rows whose covariance has the least determinant.  They are the log of the mean word length, and for
symbols per word, repeated lines per line and repeats per six words (a repeat is two windows of
three words at least) the roots that make a count's error the same at every rate (arcsine for
shares, with 3/8 added to the count).  The search is deterministic: from three starts (medians
with the least scales, medians with quartile scales, the spatial sign covariance) concentration
steps take the nearest three quarters of the rows again and again, each chain until its determinant
stops falling; the chain with the least determinant wins, and one step of reweighting over the rows
within the 0.975 quantile gives the final mean and covariance.  A step is one pass: distances fall
into fine logarithmic bins, moments are summed per group and bin (combined before the shuffle), and
a running sum over a group's bins finds the nearest three quarters.  No group is sorted or gathered,
so a source with a third of all rows costs no more than others, and equal distances stay together.
Covariances are scaled to be consistent for normal data.  To the diagonal comes the group's own
sampling error: the mean, over its rows, of the variance that each statistic has because a text is
finite (1 / word characters, 1 / 4 words, 1 / (4 lines + 2), 1 / (4 words / 6 + 2)).  So a
statistic that is constant in a group stays invertible and is judged by what chance allows at these
lengths; no scale is set from outside.  Rows with a squared Mahalanobis distance beyond the 0.9999
quantile are rejected.

Small groups.  Groups with fewer than ``LEAST`` rows, too few for four dimensions, are pooled by
language, and pools that are still smaller with each other.  What is left then is estimated however
few its rows: with the sampling error on the diagonal a single row has a covariance too, and a
distance of 0.

Defined results.  Null, empty and blank texts: all statistics 0, base_failed (fewer than 50 words),
distance null, not kept.  Null language or source: a group of its own.  Repeated rows and ids:
each row is judged.  Very long texts: whole.  Empty table: empty result.  Extra columns are not
read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from oscilla.llm import common

FEATURES, ERRORS = ("x1", "x2", "x3", "x4"), ("v1", "v2", "v3", "v4")
#: Words of the least repeat.
REPEAT = 6
#: Share of rows a concentration step keeps, and the factor that makes its covariance consistent in 4 dimensions: 0.75 / P(chi2_6 <= q), q the 0.75 quantile of chi2_4.
SHARE, CONSISTENT = 0.75, 1.486
#: Reweighting: the 0.975 quantile of chi-squared with 4 degrees of freedom, and 0.975 / P(chi2_6 <= that quantile).
WEIGHED, WEIGHED_CONSISTENT = 11.143, 1.0645
#: The 0.9999 quantile of chi-squared with 4 degrees of freedom.
CUTOFF = 23.51
#: A determinant falls if it falls by this part at least.
FALL = 1e-4
LEAST, MIN_WORDS = 10, 50
#: Groups whose estimates (about 200 bytes each) may be broadcast.
BROADCAST_GROUPS = common.BROADCAST_BYTES // 200
_BLANK = "[\\\\x20\\\\x09-\\\\x0D]+"
_PAIRS = [(i, j) for i in range(4) for j in range(i, 4)]


def statistics(docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """doc_id, lang, source, n_words, word_chars, n_symbols, n_lines, n_dup_lines, n_repeat_words, base_failed."""
    rows = docs.select(
        F.col(f"`{key}`").cast("long").alias("doc_id"),
        F.coalesce(F.col(f"`{text}`").cast("string"), F.lit("")).alias("text"),
        F.col(f"`{lang}`").cast("string").alias("lang"),
        F.col(f"`{source}`").cast("string").alias("source"),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        F.expr(f"array_remove(split(text, '{_BLANK}'), '')").alias("words"),
        F.expr("filter(split(text, '\\n'), x -> x rlike '[^\\\\x20\\\\x09-\\\\x0D]')").alias("lines"),
        (F.length("text") - F.length(F.regexp_replace("text", "[#*$%&|<>]", ""))).cast("long").alias("n_symbols"),
    )
    rows = rows.select(
        "doc_id",
        "lang",
        "source",
        "n_symbols",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.array_join("words", "")).cast("long").alias("word_chars"),
        F.size("lines").cast("long").alias("n_lines"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        F.expr("CASE WHEN size(words) > 2 THEN transform(sequence(0, size(words) - 3), i -> xxhash64(words[i], words[i + 1], words[i + 2])) ELSE array() END").alias("windows"),
    )
    # only texts in which some window repeats are sorted
    rows = rows.withColumn("found", F.expr("CASE WHEN size(array_distinct(windows)) < size(windows) THEN array_sort(transform(windows, (x, i) -> struct(x, i))) END"))
    again = "filter(found, (x, k) -> coalesce(x.x = get(found, k - 1).x, false) OR coalesce(x.x = get(found, k + 1).x, false))"
    rows = rows.withColumn("at", F.expr(f"array_sort(transform({again}, x -> x.i))")).drop("windows", "found")
    covered = "aggregate(transform(at, (p, k) -> least(3, coalesce(get(at, k + 1) - p, 3))), 0L, (a, b) -> a + b)"
    rows = rows.withColumn("n_repeat_words", F.expr(f"coalesce({covered}, 0L)")).drop("at")
    return rows.withColumn("base_failed", (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")))


def transformed(stats: DataFrame) -> DataFrame:
    """The statistics with x1 to x4, their sampling variances v1 to v4 and the name ``g`` of the row's language and source; x and v null where the base failed."""
    n = F.col("n_words").cast("double")
    name = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c)), F.lit("-"))
    lines, repeats, places = F.greatest(F.col("n_lines"), F.lit(1)), F.col("n_repeat_words") / REPEAT, n / REPEAT
    share = lambda k, m: F.asin(F.sqrt(F.least((k + 0.375) / (m + 0.75), F.lit(1.0))))
    values = (F.log(F.col("word_chars") / n), F.sqrt((F.col("n_symbols") + 0.375) / n), share(F.col("n_dup_lines"), lines), share(repeats, places))
    errors = (1 / F.col("word_chars"), 1 / (4 * n), 1 / (4 * lines + 2), 1 / (4 * places + 2))
    out = stats.select("*", name("lang").alias("g_lang"), F.concat(name("lang"), F.lit("\u001f"), name("source")).alias("g_full"))
    return out.select("*", *(F.when(~F.col("base_failed"), v).alias(x) for x, v in zip((*FEATURES, *ERRORS), (*values, *errors), strict=True)))


def _inverse(est: DataFrame, *keys: str) -> DataFrame:
    """Means m_i and covariances c_ij become means, the inverse p_ij and the determinant, by Cholesky factors in plain columns."""
    for i in range(4):
        for j in range(i + 1):
            rest: Column = F.col(f"c{j}{i}")
            for k in range(j):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"l{j}{k}")
            est = est.withColumn(f"l{i}{j}", F.sqrt(rest) if i == j else rest / F.col(f"l{j}{j}"))
    for i in range(4):  # inverse of the triangle
        for j in range(i + 1):
            if i == j:
                est = est.withColumn(f"w{i}{j}", 1 / F.col(f"l{i}{i}"))
                continue
            rest = F.lit(0.0)
            for k in range(j, i):
                rest = rest - F.col(f"l{i}{k}") * F.col(f"w{k}{j}")
            est = est.withColumn(f"w{i}{j}", rest / F.col(f"l{i}{i}"))
    inv = []
    for i, j in _PAIRS:
        total: Column = F.lit(0.0)
        for k in range(j, 4):
            total = total + F.col(f"w{k}{i}") * F.col(f"w{k}{j}")
        inv.append(total.alias(f"p{i}{j}"))
    root = F.col("l00") * F.col("l11") * F.col("l22") * F.col("l33")
    return est.select(*(keys or ("g",)), *(f"m{i}" for i in range(4)), *inv, (root * root).alias("det"))


def _distance() -> Column:
    dev = [F.col(x) - F.col(f"m{i}") for i, x in enumerate(FEATURES)]
    total: Column = F.lit(0.0)
    for i, j in _PAIRS:
        total = total + dev[i] * dev[j] * F.col(f"p{i}{j}") * (1.0 if i == j else 2.0)
    return F.greatest(total, F.lit(0.0))


def _running(binned: DataFrame, by: list[str]) -> DataFrame:
    """Adds the rows in bins before each one, and in all, of each group."""
    w, whole = Window.partitionBy(*by).orderBy("bin"), Window.partitionBy(*by)
    return binned.withColumn("before", F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).withColumn("all", F.sum("n").over(whole))


_REGULAR = [f"r{i}" for i in range(4)]
_SUMS, _MEANS, _INVERSE = [f"s{i}" for i in range(4)] + [f"q{i}{j}" for i, j in _PAIRS], [f"m{i}" for i in range(4)], [f"p{i}{j}" for i, j in _PAIRS]


def _moments() -> list[Column]:
    """Sums about the group's present centre, so that squares do not cancel."""
    dev = [F.col(x) - F.col(m) for x, m in zip(FEATURES, _MEANS, strict=True)]
    return [F.sum(dev[i]).alias(f"s{i}") for i in range(4)] + [F.sum(dev[i] * dev[j]).alias(f"q{i}{j}") for i, j in _PAIRS]


def _estimate(sums: DataFrame, consistent: float, *keys: str) -> DataFrame:
    """Means, inverse covariances and determinants from sums about m_i; r_i comes to the diagonal and stays."""
    shift = [F.col(f"s{i}") / F.col("n") for i in range(4)]
    cov = [((F.col(f"q{i}{j}") / F.col("n") - shift[i] * shift[j]) * consistent + (F.col(f"r{i}") if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    keys = (*keys, *_REGULAR)
    return _inverse(sums.select(*keys, *((F.col(m) + shift[i]).alias(m) for i, m in enumerate(_MEANS)), *cov), *keys)


def starts(fit: DataFrame, small: bool) -> DataFrame:
    """g, s (number of the start), means, inverse covariances and sampling variances to begin with; det is infinite."""
    held = (lambda e: F.broadcast(e)) if small else (lambda e: e)
    # coordinate-wise quartiles, to a bin of 0.005
    each = fit.select("g", F.posexplode(F.array(*(F.floor(F.col(x) * 200) for x in FEATURES))).alias("f", "bin")).groupBy("g", "f", "bin").agg(F.count("*").alias("n"))
    at = [F.max(F.when(F.col("before") < F.col("all") * q, F.col("bin"))).alias(f"b{k}") for k, q in enumerate((0.25, 0.5, 0.75))]
    mid = _running(each, ["g", "f"]).groupBy("g", "f").agg(*at)
    regular = fit.groupBy("g").agg(*(F.avg(v).alias(r) for v, r in zip(ERRORS, _REGULAR, strict=True)))
    spread = lambda i: F.greatest(F.sqrt(F.max(f"r{i}")), F.max(F.when(F.col("f") == i, F.col("b2") - F.col("b0"))) / (200 * 1.349))
    mid = mid.join(regular, "g").groupBy("g").agg(*(F.max(r).alias(r) for r in _REGULAR), *(F.max(F.when(F.col("f") == i, (F.col("b1") + 0.5) / 200)).alias(f"m{i}") for i in range(4)), *(spread(i).alias(f"d{i}") for i in range(4)))
    mid = common.materialize(mid, "quartiles")
    plain = [(1 / F.col(f"r{i}") if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i, j in _PAIRS]
    scaled = [(1 / (F.col(f"d{i}") * F.col(f"d{i}")) if i == j else F.lit(0.0)).alias(f"p{i}{j}") for i, j in _PAIRS]
    z = [(F.col(x) - F.col(f"m{i}")) / F.col(f"d{i}") for i, x in enumerate(FEATURES)]
    norm = z[0] * z[0] + z[1] * z[1] + z[2] * z[2] + z[3] * z[3]
    signs = fit.join(held(mid), "g").groupBy("g").agg(*(F.avg(F.when(norm > 0, z[i] * z[j] / norm).otherwise(0.0)).alias(f"u{i}{j}") for i, j in _PAIRS))
    cov = [(4 * F.col(f"u{i}{j}") * F.col(f"d{i}") * F.col(f"d{j}") + (F.col(f"r{i}") if i == j else 0.0)).alias(f"c{i}{j}") for i, j in _PAIRS]
    third = _inverse(mid.join(signs, "g").select("g", *_REGULAR, *_MEANS, *cov), "g", *_REGULAR).select("g", F.lit(3).alias("s"), *_MEANS, *_INVERSE, *_REGULAR)
    both = (mid.select("g", F.lit(k).alias("s"), *_MEANS, *p, *_REGULAR) for k, p in ((1, plain), (2, scaled)))
    return next(both).unionByName(next(both)).unionByName(third).withColumn("det", F.lit(float("inf")))


def estimates(fit: DataFrame, small: bool = False) -> DataFrame:
    """g, means and inverse covariances of the groups of ``fit`` (g, x1..x4 and v1..v4 without nulls)."""
    held = (lambda e: F.broadcast(e)) if small else (lambda e: e)
    est, fell = common.materialize(starts(fit, small), "starts"), True
    while fell:  # determinants only fall, so this ends
        near = fit.join(held(est.drop("det", "fell")), "g").withColumn("bin", F.floor(F.log(_distance() + 1e-6) * 64))
        binned = near.groupBy("g", "s", "bin").agg(F.count("*").alias("n"), *_moments(), *(F.first(m).alias(m) for m in (*_MEANS, *_REGULAR)))
        kept = _running(binned, ["g", "s"]).where(F.col("before") < F.ceil(F.col("all") * SHARE))
        got = _estimate(kept.groupBy("g", "s").agg(F.sum("n").alias("n"), *(F.sum(c).alias(c) for c in _SUMS), *(F.first(m).alias(m) for m in (*_MEANS, *_REGULAR))), CONSISTENT, "g", "s")
        got = got.select("g", "s", *(F.col(c).alias(f"new_{c}") for c in (*_MEANS, *_INVERSE, "det")))
        lower = F.col("new_det") < F.col("det") * (1 - FALL)
        step = est.drop("fell").join(got, ["g", "s"]).select("g", "s", *_REGULAR, *(F.when(lower, F.col(f"new_{c}")).otherwise(F.col(c)).alias(c) for c in (*_MEANS, *_INVERSE, "det")), lower.alias("fell"))
        seen = Observation()
        before, est = est, common.materialize(step.observe(seen, F.max("fell").alias("fell")).coalesce(1), "estimates")
        common.forget(before)
        fell = bool(seen.get["fell"])
    best = est.groupBy("g").agg(F.min(F.struct("det", "s", *_MEANS, *_INVERSE, *_REGULAR)).alias("best")).select("g", *(F.col(f"best.{c}").alias(c) for c in (*_MEANS, *_INVERSE, *_REGULAR)))
    near = fit.join(held(best), "g").where(_distance() <= WEIGHED)
    return _estimate(near.groupBy("g").agg(F.count("*").alias("n"), *_moments(), *(F.first(m).alias(m) for m in (*_MEANS, *_REGULAR))), WEIGHED_CONSISTENT, "g")


def robust_outliers(docs: DataFrame, cutoff: float = CUTOFF, least: int = LEAST, **columns: str) -> DataFrame:
    """doc_id, the statistics, base_failed, distance2 and kept."""
    rows = common.materialize(transformed(statistics(common.spread(docs), **columns)), "statistics")
    sizes = common.materialize(rows.where("NOT base_failed").groupBy("g_full", "g_lang").agg(F.count("*").alias("size")), "groups")
    few = F.col("size") < least
    pools = sizes.where(few).groupBy("g_lang").agg(F.sum("size").alias("pool"))
    pooled = F.when(F.col("pool") >= least, F.concat("g_lang", F.lit("\u001f*"))).otherwise("*")
    names = sizes.join(pools, "g_lang", "left").select("g_full", F.when(few, pooled).otherwise(F.col("g_full")).alias("g"))
    names = common.materialize(names, "names")
    small = sizes.count() <= BROADCAST_GROUPS
    held = (lambda e: F.broadcast(e)) if small else (lambda e: e)
    fit = common.materialize(rows.where("NOT base_failed").select("g_full", *FEATURES, *ERRORS).join(held(names), "g_full").select("g", *FEATURES, *ERRORS), "features")
    est = common.materialize(estimates(fit, small), "estimates")
    for done in (sizes, fit):
        common.forget(done)
    out = rows.join(held(names), "g_full", "left").join(held(est), "g", "left").withColumn("distance2", _distance_or_null())
    kept = ~F.col("base_failed") & (F.col("distance2") <= cutoff)
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "distance2", F.coalesce(kept, F.lit(False)).alias("kept"))


def _distance_or_null() -> Column:
    return F.when(~F.col("base_failed"), _distance())
