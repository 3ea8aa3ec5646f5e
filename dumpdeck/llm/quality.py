"""Quality rules: robust multivariate outliers of text statistics, per language and source.

Each text gives word and line counts (``measure``) and from them a vector of log ratios (``vector``).
Per (language, source) a minimum covariance determinant estimate is made with C-steps: the share
``core`` of rows nearest to the current centre gives the next mean and covariance, distances are
taken anew, and so on. A text is rejected if its squared Mahalanobis distance exceeds ``cutoff``.

All of it is DataFrame aggregation: a group's core is chosen by an approximate quantile of its
distances, and means and covariances are sums, both combined on the map side, so a group may hold any
share of the rows. Covariances are regularised: they are shrunk to the pooled covariance with the
weight of ``prior`` rows and get ``floor`` squared added to each variance, so that a statistic which is
constant in the core (no symbols at all, say) doesn't make any deviation infinitely far.

Edge cases: null texts are empty and have no words; base-failed rows are neither used for estimates
nor kept. Null languages and sources are groups of their own. Very long texts are measured whole. An
empty table gives an empty result. Repeated rows are judged alike. Helper columns start with ``_q_``.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpdeck.llm.common import SPACE, cut, whole, words

FEATURES = ("_q_length", "_q_symbols", "_q_marks", "_q_capitals", "_q_lines", "_q_repeats")
P = len(FEATURES)
CORE, STEPS, PRIOR, FLOOR, CUTOFF = 0.75, 3, 50.0, 0.25, 45.0


def _at(array: str | Column, i: Column) -> Column:
    return F.get(array, i)


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words, from whole texts.

    Words in repeated 3-word windows: window hashes are packed with their positions into one long per
    window (positions in the low bits, as many as the text needs), sorted as plain longs, and equal
    neighbours are candidates. Of these the whole 64-bit hashes are sorted and compared.
    """
    t = whole(text)
    df = docs.withColumn("_q_words", words(text)).withColumn("_q_n", F.size("_q_words"))
    hashes = F.transform("_q_words", lambda w: F.xxhash64(w))
    bits = F.ceil(F.log2(F.col("_q_n") + 2)).cast("int")
    df = df.withColumn("_q_hash", hashes).withColumn("_q_bits", bits)
    low = F.pow(F.lit(2.0), F.col("_q_bits")).cast("long") - 1

    def window(i: Column) -> Column:
        return F.xxhash64(_at("_q_hash", i), _at("_q_hash", i + 1), _at("_q_hash", i + 2))

    def packed(i: Column) -> Column:
        return window(i).bitwiseAND(F.bitwise_not(F.col("_q_low"))).bitwiseOR(i.cast("long"))

    df = df.withColumn("_q_low", low)
    windows = F.when(
        F.col("_q_n") >= 3, F.sort_array(F.transform(F.sequence(F.lit(0), F.col("_q_n") - 3), packed))
    ).otherwise(F.array().cast("array<bigint>"))
    df = df.withColumn("_q_sorted", windows)

    def alike(a: Column, b: Column) -> Column:
        return F.coalesce(a.bitwiseXOR(b).bitwiseAND(F.bitwise_not(F.col("_q_low"))) == 0, F.lit(False))

    twice = F.filter(
        "_q_sorted",
        lambda x, i: alike(x, F.when(i > 0, _at("_q_sorted", i - 1))) | alike(x, _at("_q_sorted", i + 1)),
    )

    def hashed(x: Column) -> Column:
        start = x.bitwiseAND(F.col("_q_low"))
        return F.struct(window(start.cast("int")).alias("h"), start.alias("start"))

    df = df.withColumn("_q_pairs", F.sort_array(F.transform(twice, hashed)))

    def met(x: Column, i: Column) -> Column:
        before, after = F.when(i > 0, _at("_q_pairs", i - 1)["h"]), _at("_q_pairs", i + 1)["h"]
        return x["h"].eqNullSafe(before) | x["h"].eqNullSafe(after)

    starts = F.sort_array(F.transform(F.filter("_q_pairs", met), lambda x: x["start"]))
    df = df.withColumn("_q_starts", starts)
    covered = F.aggregate(
        F.transform(
            "_q_starts",
            lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(_at("_q_starts", i + 1) - x, F.lit(3).cast("long"))),
        ),
        F.lit(0).cast("long"),
        lambda a, x: a + x,
    )
    lines = F.filter(F.split(t, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    return (
        df.withColumn("_q_lines_all", lines)
        .withColumn("n_words", F.col("_q_n").cast("long"))
        .withColumn("word_chars", F.length(F.regexp_replace(t, f"{SPACE}+", "")).cast("long"))
        .withColumn("n_symbols", F.length(F.regexp_replace(t, r"[^#*$%&|<>]+", "")).cast("long"))
        .withColumn(
            "n_dup_lines", (F.size("_q_lines_all") - F.size(F.array_distinct("_q_lines_all"))).cast("long")
        )
        .withColumn("_q_n_lines", F.size("_q_lines_all"))
        .withColumn("n_repeat_words", covered)
        .withColumn("_q_n_marks", F.length(F.regexp_replace(t, r"[^!-/:-@\[-`{-~]+", "")))
        .withColumn("_q_n_capitals", F.length(F.regexp_replace(t, r"[^A-Z]+", "")))
        .drop("_q_words", "_q_n", "_q_hash", "_q_bits", "_q_low", "_q_sorted", "_q_pairs", "_q_starts", "_q_lines_all")
    )


def base_failed() -> Column:
    return (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))


def vector() -> dict[str, Column]:
    """Log ratios, each damped by 20 words so that short texts don't stray."""
    n = F.col("n_words") + 20

    def share(column: str, of: Column = n) -> Column:
        return F.log1p(10 * F.col(column) / of)

    return {
        "_q_length": 3 * F.log((F.col("word_chars") + 100.0) / n),
        "_q_symbols": share("n_symbols"),
        "_q_marks": share("_q_n_marks"),
        "_q_capitals": share("_q_n_capitals"),
        "_q_lines": share("n_dup_lines", F.col("_q_n_lines") + 5),
        "_q_repeats": share("n_repeat_words"),
    }


def _pairs():
    return [(i, j) for i in range(P) for j in range(i + 1)]


def _moments(rows: DataFrame, *keys: str) -> DataFrame:
    sums = [F.sum(f).alias(f"_q_m{i}") for i, f in enumerate(FEATURES)]
    sums += [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"_q_s{i}_{j}") for i, j in _pairs()]
    return rows.groupBy(*keys).agg(F.count("*").cast("double").alias("_q_k"), *sums)


def _estimate(rows: DataFrame, prior: float, floor: float, scale: float) -> DataFrame:
    """Per group: mean and Cholesky factor of the regularised covariance of ``rows``, scaled by ``scale``."""
    df = cut(_moments(rows, "_q_group"))
    sums = [c for c in df.columns if c != "_q_group"]
    pool = df.agg(*(F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in sums)).first()
    n = max(pool["_q_k"], 1.0)
    mean = [pool[f"_q_m{i}"] / n for i in range(P)]
    cov = {(i, j): pool[f"_q_s{i}_{j}"] / n - mean[i] * mean[j] for i, j in _pairs()}
    few = min(prior, 5.0)
    k = F.col("_q_k")
    columns = {f"_q_u{i}": (F.col(f"_q_m{i}") + few * mean[i]) / (k + few) for i in range(P)}
    for i, j in _pairs():
        own = F.col(f"_q_s{i}_{j}") - F.col(f"_q_m{i}") * F.col(f"_q_m{j}") / k
        ridge = floor**2 if i == j else 0.0
        columns[f"_q_c{i}_{j}"] = scale * (own + prior * cov[i, j]) / (k + prior) + ridge
    df = df.withColumns(columns)
    for j in range(P):  # Cholesky, a column of the factor at a time
        left = {
            i: sum((-F.col(f"_q_f{i}_{m}") * F.col(f"_q_f{j}_{m}") for m in range(j)), F.col(f"_q_c{i}_{j}"))
            for i in range(j, P)
        }
        df = df.withColumn(f"_q_f{j}_{j}", F.sqrt(F.greatest(left[j], F.lit(1e-9))))
        if j + 1 < P:
            df = df.withColumns({f"_q_f{i}_{j}": left[i] / F.col(f"_q_f{j}_{j}") for i in range(j + 1, P)})
    keep = [f"_q_u{i}" for i in range(P)] + [f"_q_f{i}_{j}" for i, j in _pairs()]
    return cut(df.select("_q_group", *keep))


def _distance(rows: DataFrame, estimate: DataFrame) -> DataFrame:
    """``rows`` with the squared distance ``_q_d`` from their group's centre."""
    df = rows.join(estimate, "_q_group")
    for i in range(P):
        rest = F.col(FEATURES[i]) - F.col(f"_q_u{i}")
        for j in range(i):
            rest = rest - F.col(f"_q_f{i}_{j}") * F.col(f"_q_z{j}")
        df = df.withColumn(f"_q_z{i}", rest / F.col(f"_q_f{i}_{i}"))
    total = sum((F.col(f"_q_z{i}") ** 2 for i in range(1, P)), F.col("_q_z0") ** 2)
    return df.select(*rows.columns, total.alias("_q_d"))


def _nearest(rows: DataFrame, core: float) -> DataFrame:
    """The share ``core`` of each group's rows with the least ``_q_d``."""
    limit = rows.groupBy("_q_group").agg(F.percentile_approx("_q_d", core, 1000).alias("_q_limit"))
    return rows.join(limit, "_q_group").filter("_q_d <= _q_limit").drop("_q_limit")


def _consistency(core: float) -> float:
    """What scales the covariance of the nearest ``core`` of a normal sample to that of all of it."""

    def below(x: float, dof: int) -> float:
        return 1 - math.exp(-x / 2) * sum((x / 2) ** i / math.factorial(i) for i in range(dof // 2))

    lo, hi = 0.0, 200.0
    for _ in range(80):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if below(mid, P) < core else (lo, mid)
    return core / below(lo, P + 2)


def fit(rows: DataFrame, core: float = CORE, steps: int = STEPS, prior: float = PRIOR, floor: float = FLOOR) -> DataFrame:
    """The estimate per ``_q_group`` for rows with ``FEATURES``, ready for ``_distance``."""
    spread = rows.groupBy("_q_group").agg(
        *(F.percentile_approx(f, [0.25, 0.5, 0.75], 1000).alias(f"{f}_p") for f in FEATURES)
    )
    scale = [F.greatest((F.get(f"{f}_p", F.lit(2)) - F.get(f"{f}_p", F.lit(0))) / 1.349, F.lit(floor)) for f in FEATURES]
    start = rows.join(cut(spread), "_q_group")
    total = F.lit(0.0)
    for f, s in zip(FEATURES, scale, strict=True):
        total = total + ((F.col(f) - F.get(f"{f}_p", F.lit(1))) / s) ** 2
    near = _nearest(start.select(*rows.columns, total.alias("_q_d")), core)
    for _ in range(steps):
        estimate = _estimate(near, prior, floor, _consistency(core))
        near = _nearest(_distance(rows, estimate), core)
    return _estimate(near, prior, floor, _consistency(core))


def group_key() -> Column:
    lang, source = F.col("lang"), F.col("source")
    return F.xxhash64(lang.isNull(), lang, source.isNull(), source)


def judge(docs: DataFrame, cutoff: float = CUTOFF, **how) -> DataFrame:
    """doc_id with the counts, base_failed, distance (squared; null if base-failed) and kept, per row."""
    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    narrow = (
        measure(docs.select("doc_id", "lang", "source", "text"))
        .withColumns(vector())
        .select(
            "doc_id", group_key().alias("_q_group"), F.xxhash64("doc_id", "text", "lang", "source").alias("_q_row"),
            *counts, base_failed().alias("base_failed"), *FEATURES,
        )
    )
    narrow = cut(narrow)
    good = narrow.filter(~F.col("base_failed"))
    judged = _distance(good, fit(good, **how)).withColumnRenamed("_q_d", "distance")
    bad = narrow.filter("base_failed").withColumn("distance", F.lit(None).cast("double"))
    kept = F.coalesce(F.col("distance") <= cutoff, F.lit(False))
    return judged.unionByName(bad).select("doc_id", "_q_row", *counts, "base_failed", "distance", kept.alias("kept"))


def keep_good(docs: DataFrame, cutoff: float = CUTOFF, **how) -> DataFrame:
    """The rows of ``docs`` that pass, with their columns as they were."""
    verdict = judge(docs, cutoff, **how).filter(~F.col("kept")).select("_q_row").distinct()
    keyed = docs.withColumn("_q_row", F.xxhash64("doc_id", "text", "lang", "source"))
    return keyed.join(verdict, "_q_row", "left_anti").select(*docs.columns)
