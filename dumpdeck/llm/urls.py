"""URL filters: host and path rules, and gradient-boosted trees on lexical features for all other URLs.

Rules are (host, path prefix, verdict); a rule fits its host and all subdomains if the URL's path starts
with the rule's path, and the longest wins. URLs that no rule fits are judged by boosted trees over
length, depth, digit ratio, entropy, parameter counts and suffix statistics (smoothed shares of bad rows
per host suffix over all labelled rows), trained on labelled URLs.

Only the trees are fitted to a sample: at most ``sample`` distinct (URL, label) pairs of least hash by
count, half of each kind where there are enough, weighted by count. A training row's suffix statistics
leave out the tenth of the labelled URLs that its own is in. Scoring covers every row and stays in the JVM.
Suffix statistics have one row per suffix and are joined, not broadcast by hand.

Edge cases: null URLs and URLs without ``://`` have an empty host and path; no rule fits them and the
trees judge them by their features. Without labelled rows of both kinds every such URL is allowed. Repeated
rows are judged alike. An empty table gives an empty result. Helper columns start with ``_u_``.
"""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dumpdeck.llm.common import cut

#: Fixed values of the query: block or allow a host suffix, below a path.
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SAMPLE, TREES, DEPTH, BLOCK_AT = 20_000, 10, 3, 0.5
SMOOTH, FOLDS = 20.0, 10
SUFFIXES = {"_u_top": "_u_suffix", "_u_site": "_u_domain"}
CAPITALS, SMALL = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "_u_length", "_u_host_length", "_u_path_length", "_u_labels", "_u_depth", "_u_digits", "_u_host_digits",
    "_u_hyphens", "_u_params", "_u_query_length", "_u_entropy", "_u_secure", "_u_suffix", "_u_domain",
)


def parts(url: str | Column = "url") -> tuple[Column, Column]:
    """Host and path of a URL."""
    u = F.coalesce(F.col(url) if isinstance(url, str) else url, F.lit(""))
    host = F.translate(F.regexp_extract(u, r"^(?s).*?://([^/?#]*)", 1), CAPITALS, SMALL)
    path = F.regexp_extract(u, r"^(?s).*?://[^/?#]*([^?#]*)", 1)
    return host, path


def rule_for(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The rule that fits, as text, and its verdict; both null where none does."""
    text = verdict = F.lit(None).cast("string")
    for name, prefix, what in sorted(rules, key=lambda r: len(r[0] + r[1])):
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(prefix)
        text = F.when(fits, name + prefix).otherwise(text)
        verdict = F.when(fits, what).otherwise(verdict)
    return text, verdict


def _suffix(host: Column, labels: int) -> Column:
    return F.substring_index(host, ".", -labels)


def lexical(urls: DataFrame) -> DataFrame:
    """``urls`` with host, path and the lexical features, but for suffix statistics."""
    host, path = parts()
    df = urls.withColumn("host", host).withColumn("path", path)
    url = F.coalesce("url", F.lit(""))
    query = F.regexp_extract(url, r"(?s)\?([^#]*)", 1)
    chars = F.when(F.length(url) > 0, F.split(url, "")).otherwise(F.array().cast("array<string>"))
    sizes = F.transform(F.array_distinct(chars), lambda c: F.length(url) - F.length(F.replace(url, c, F.lit(""))))
    n = F.greatest(F.length(url), F.lit(1))
    entropy = F.aggregate(sizes, F.lit(0.0), lambda a, k: a - k / n * F.coalesce(F.log2(k / n), F.lit(0.0)))

    def digits(c: Column) -> Column:
        return F.regexp_count(c, F.lit("[0-9]")) / F.greatest(F.length(c), F.lit(1))

    number = {
        "_u_length": F.length(url),
        "_u_host_length": F.length("host"),
        "_u_path_length": F.length("path"),
        "_u_labels": F.regexp_count("host", F.lit("[.]")),
        "_u_depth": F.regexp_count("path", F.lit("/[^/]+")),
        "_u_digits": digits(url),
        "_u_host_digits": digits(F.col("host")),
        "_u_hyphens": F.regexp_count("host", F.lit("-")),
        "_u_params": F.regexp_count(query, F.lit("[^&]+")),
        "_u_query_length": F.length(query),
        "_u_entropy": entropy,
        "_u_secure": url.startswith("https").cast("int"),
    }
    df = df.withColumns({k: v.cast("double") for k, v in number.items()})
    return df.withColumns({"_u_top": _suffix(F.col("host"), 1), "_u_site": _suffix(F.col("host"), 3)})


def suffix_counts(labelled: DataFrame) -> dict[str, DataFrame]:
    """Labelled rows and bad ones among them per host suffix and fold; ``labelled`` has ``_u_n`` rows in each."""
    sums = F.sum("_u_n").alias("_u_all"), F.sum(F.col("bad") * F.col("_u_n")).alias("_u_bad")
    return {s: cut(labelled.groupBy(s, "_u_fold").agg(*sums)) for s in SUFFIXES}


def _share(bad: Column, n: Column, prior: float) -> Column:
    return (bad + SMOOTH * prior) / (n + SMOOTH)


def suffix_statistics(counts: dict[str, DataFrame], prior: float) -> tuple[DataFrame, DataFrame, float]:
    """Smoothed share of bad rows per last label and per last three labels of the host, and over all."""
    share = _share(F.sum("_u_bad"), F.sum("_u_all"), prior)
    return *(cut(counts[s].groupBy(s).agg(share.alias(name))) for s, name in SUFFIXES.items()), prior


def with_statistics(urls: DataFrame, statistics) -> DataFrame:
    tops, sites, prior = statistics
    df = urls.join(tops, "_u_top", "left").join(sites, "_u_site", "left")
    return df.fillna(prior, ["_u_suffix", "_u_domain"])


def with_outer_statistics(rows: DataFrame, counts: dict[str, DataFrame], prior: float) -> DataFrame:
    """Training rows with the shares over all labelled rows but those of their own fold, so never their own label."""
    for s, name in SUFFIXES.items():
        whole = counts[s].groupBy(s).agg(F.sum("_u_all").alias("_u_all_of"), F.sum("_u_bad").alias("_u_bad_of"))
        rows = rows.join(counts[s], [s, "_u_fold"]).join(whole, s)
        share = _share(F.col("_u_bad_of") - F.col("_u_bad"), F.col("_u_all_of") - F.col("_u_all"), prior)
        rows = rows.withColumn(name, share).drop("_u_all", "_u_bad", "_u_all_of", "_u_bad_of")
    return rows


def draw(labelled: DataFrame, size: int) -> DataFrame:
    """At most ``size`` rows with ``_u_weight``: those of least hash by count, so frequent rows come first.

    A row left out is made up for by the weight of those drawn: each weighs its count, at least the count
    above which a row would be drawn for sure (priority sampling).
    """
    hashed = (F.pmod(F.xxhash64("url"), F.lit(2**52)) + 1) / F.lit(float(2**52))
    ranked = labelled.withColumn("_u_rank", hashed / F.col("_u_n"))
    drawn = cut(ranked.orderBy("_u_rank", "url").limit(size + 1))
    n, last = drawn.agg(F.count("*"), F.max("_u_rank")).first()
    count = F.col("_u_n").cast("double")
    if n <= size:
        return drawn.withColumn("_u_weight", count)
    return drawn.filter(F.col("_u_rank") < last).withColumn("_u_weight", F.greatest(count, F.lit(1 / last)))


def train(labelled: DataFrame, sample: int = SAMPLE, trees: int = TREES, depth: int = DEPTH):
    """The fitted model and its statistics from rows (url, bad 0/1), or None without rows of both kinds."""
    rows = labelled.filter("bad IS NOT NULL").groupBy("url", "bad").agg(F.count("*").alias("_u_n"))
    host = parts()[0]
    fold = F.pmod(F.xxhash64("url", F.lit("fold")), F.lit(FOLDS))
    rows = cut(rows.withColumns({"_u_top": _suffix(host, 1), "_u_site": _suffix(host, 3), "_u_fold": fold}))
    kinds = {r.bad: r for r in rows.groupBy("bad").agg(F.count("*").alias("urls"), F.sum("_u_n").alias("n")).collect()}
    if len(kinds) < 2:
        return None
    prior = kinds[1].n / (kinds[0].n + kinds[1].n)
    # Half of the sample for each kind, more where the other kind has less.
    size = {k: max(sample - sample // 2, sample - kinds[1 - k].urls) for k in kinds}
    drawn = draw(rows.filter("bad = 0"), size[0]).unionByName(draw(rows.filter("bad = 1"), size[1]))
    counts = suffix_counts(rows)
    drawn = with_outer_statistics(cut(lexical(drawn)), counts, prior).select(*FEATURES, "_u_weight", F.col("bad").cast("double").alias("label"))
    trees_ = GBTClassifier(
        featuresCol="_u_vector", labelCol="label", weightCol="_u_weight", maxIter=trees, maxDepth=depth, maxBins=32,
        seed=7, predictionCol="_u_prediction",
    )
    trees_ = trees_.setRawPredictionCol("_u_raw").setProbabilityCol("_u_probability")
    stages = [VectorAssembler(inputCols=list(FEATURES), outputCol="_u_vector"), trees_]
    return Pipeline(stages=stages).fit(drawn), suffix_statistics(counts, prior)


def filter_urls(urls: DataFrame, labelled: DataFrame, rules=RULES, block_at: float = BLOCK_AT, **how) -> DataFrame:
    """``urls`` with host, path, rule, bad_probability (null without a model) and verdict, which replace columns
    of these names."""
    model = train(labelled, **how)
    df = lexical(urls)
    if model is None:
        df = df.withColumn("bad_probability", F.lit(None).cast("double"))
    else:
        fitted, statistics = model
        df = fitted.transform(with_statistics(df, statistics))
        df = df.withColumn("bad_probability", F.get(vector_to_array("_u_probability"), F.lit(1)))
    rule, verdict = rule_for(F.col("host"), F.col("path"), rules)
    own = F.when(F.coalesce("bad_probability", F.lit(0.0)) > block_at, "block").otherwise("allow")
    df = df.withColumns({"rule": rule, "verdict": F.coalesce(verdict, own)})
    added = ["host", "path", "rule", "bad_probability", "verdict"]
    return df.select(*(c for c in urls.columns if c not in added), *added)


def labelled_pages(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """URLs of pages whose document has labels: the number in the path is the document's id.

    A URL is bad if its document is toxic or of low quality.
    """
    number = F.try_to_number(F.regexp_extract(parts()[1], r"/(\d{1,18})(?:\.html)?/?$", 1), F.lit("9" * 18)).cast("long")
    bad = ((F.col("quality") == 0) | (F.col("toxic") == 1)).cast("int")
    known = pages.filter("url IS NOT NULL").select("url", number.alias("doc_id"))
    return known.join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("url", "bad")
