"""URL filter: rules on hosts and paths first, gradient-boosted trees for the rest.

The trees see lexical features only (lengths, depth, digit ratio, entropy, parameters and
statistics of the host's suffix) and learn from URLs with a known verdict. All columns are built
from SQL functions; the trees are Spark ML's.

Defined cases: a null URL or one without ``://`` has an empty host and path and is judged by the
trees; with labelled URLs of one verdict only, the rest gets that verdict, with none ``allow``.
Of equally long rules that fit, the first in alphabetical order wins. Repeated rows are judged alike.
"""

from __future__ import annotations

import string
from collections.abc import Sequence

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from revlens.session import broadcast_if_bounded, materialise

# The trees are fitted on at most so many different labelled URLs, chosen by a hash of the URL;
# suffix statistics count all different labelled URLs.
FIT_ROWS = 20_000
# Of these places the rarer verdict gets at least one in so many, as far as it has URLs.
RARER_SHARE = 100

FEATURES = (
    "url_length", "host_length", "path_length", "host_labels", "depth", "digit_ratio", "host_digit_ratio",
    "entropy", "parameters", "query_length", "has_fragment", "hyphens", "secure", "extension_length",
    "suffix_share", "suffix_rate",
)


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end; A-Z in lower case."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1)).otherwise("")
    return F.translate(F.coalesce(rest, F.lit("")), string.ascii_uppercase, string.ascii_lowercase)


def path_of(url: Column) -> Column:
    """After the host up to ``?``, ``#`` or the end."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)).otherwise("")
    return F.coalesce(rest, F.lit(""))


def match_rules(host: Column, path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Struct (rule, verdict) of the longest rule that fits, else null.

    A rule is ``host/path``; it fits its host and all subdomains where the path starts with its own.
    """
    fits = []
    for verdict, rule in sorted(rules, key=lambda item: (-len(item[1]), item[1])):
        rule_host, slash, rule_path = rule.partition("/")
        on_host = (host == rule_host) | host.endswith("." + rule_host)
        answer = F.struct(F.lit(rule).alias("rule"), F.lit(verdict).alias("verdict"))
        fits.append(F.when(on_host & path.startswith(slash + rule_path), answer))
    return F.coalesce(*fits) if fits else F.lit(None).cast("struct<rule:string,verdict:string>")


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Bits of entropy of a text's characters."""
    size = F.char_length(text)
    sizes = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda mark: (size - F.char_length(F.replace(text, mark, F.lit("")))) / size,
    )
    bits = F.aggregate(sizes, F.lit(0.0), lambda total, part: total - F.when(part > 0, part * F.log2(part)).otherwise(0.0))
    return F.when(size > 0, bits).otherwise(0.0)


def suffix_of(host: Column) -> Column:
    return F.substring_index(host, ".", -1)


def with_features(urls: DataFrame, url: str, suffixes: DataFrame) -> DataFrame:
    """Adds the columns of FEATURES. ``suffixes``, a stored table, has ``_suffix, _share, _rate`` of known suffixes."""
    urls = urls.withColumn("_suffix", suffix_of(F.col("host"))).join(broadcast_if_bounded(suffixes), "_suffix", "left")
    text = F.coalesce(F.col(url), F.lit(""))
    host, path = F.col("host"), F.col("path")
    query = F.regexp_extract(text, r"(?s)\?([^#]*)", 1)
    ratio = lambda part, whole: F.when(whole > 0, part / whole).otherwise(0.0)
    return urls.withColumns({
        "url_length": F.char_length(text).cast("double"),
        "host_length": F.char_length(host).cast("double"),
        "path_length": F.char_length(path).cast("double"),
        "host_labels": _count(host, r"\.") + 1,
        "depth": _count(path, "/"),
        "digit_ratio": ratio(_count(text, "[0-9]"), F.char_length(text)),
        "host_digit_ratio": ratio(_count(host, "[0-9]"), F.char_length(host)),
        "entropy": _entropy(text),
        "parameters": _count(query, "[^&]+"),
        "query_length": F.char_length(query).cast("double"),
        "has_fragment": F.contains(text, F.lit("#")).cast("double"),
        "hyphens": _count(text, "-"),
        "secure": text.startswith("https:").cast("double"),
        "extension_length": F.char_length(F.regexp_extract(path, r"\.([^./]*)$", 1)).cast("double"),
        "suffix_share": F.coalesce("_share", F.lit(0.0)),
        "suffix_rate": F.coalesce("_rate", F.lit(0.5)),
    }).drop("_suffix", "_share", "_rate")


class UrlModel:
    """Boosted trees over lexical features, or one verdict where there is nothing to learn."""

    def __init__(self, suffixes, trees, constant: str | None) -> None:
        self.suffixes, self.trees, self.constant = suffixes, trees, constant

    def judge(self, urls: DataFrame, url: str) -> DataFrame:
        """Adds ``predicted`` (allow or block) to rows with columns ``host`` and ``path``."""
        if self.trees is None:
            return urls.withColumn("predicted", F.lit(self.constant))
        kept = [F.col(name) for name in urls.columns]
        marked = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(
            with_features(urls.select(F.struct(*kept).alias("_row"), F.col(url).alias("_url"), "host", "path"),
                          "_url", self.suffixes))
        return self.trees.transform(marked).select(
            "_row.*", F.when(F.col("_prediction") > 0.5, "block").otherwise("allow").alias("predicted"))


def suffix_statistics(known: DataFrame) -> DataFrame:
    """Different URLs, blocked ones, share and rate of every suffix; ``known``: ``host, _label, _hash``."""
    different = known.select(suffix_of(F.col("host")).alias("_suffix"), "_label", "_hash").distinct()
    counts = different.groupBy("_suffix").agg(F.count("*").alias("_n"), F.sum("_label").alias("_blocked"))
    total = counts.agg(F.sum("_n").alias("_total"))
    return counts.crossJoin(F.broadcast(total)).select(
        "_suffix", "_n", "_blocked", (F.log1p("_n") / F.log1p("_total")).alias("_share"),
        ((F.col("_blocked") + 1) / (F.col("_n") + 2)).alias("_rate"))


def _sample(known: DataFrame, sizes: dict[float, int], rows: int) -> DataFrame:
    """At most ``rows`` different URLs, of each label those with the least hashes."""
    total, rarer = sum(sizes.values()), min(sizes, key=sizes.get)
    places = {rarer: min(sizes[rarer], max(rows * sizes[rarer] // total, rows // RARER_SHARE, 1))}
    places[1 - rarer] = max(rows - places[rarer], 1)
    # Thinned by hash first, to more than what is taken, so that what is shuffled doesn't grow with the table.
    few = [(F.col("_label") == label) & (F.col("_hash") <= min(2**63 - 1, int(2**64 * (4 * places[label] + 100) / sizes[label]) - 2**63))
           for label in sizes]
    thinned = materialise(known.filter(few[0] | few[1]).distinct(), "url-thinned")
    taken = [thinned.filter(F.col("_label") == label).orderBy("_hash", "_url").limit(places[label]) for label in sizes]
    return materialise(taken[0].union(taken[1]), "url-sample")


def fit(labelled: DataFrame, url: str, verdict: str, rows: int = FIT_ROWS, rounds: int = 20, depth: int = 4) -> UrlModel:
    """Fits the trees on at most ``rows`` different labelled URLs with columns ``host``, ``path``."""
    known = labelled.filter(F.col(verdict).isin("allow", "block")).select(
        F.col(url).alias("_url"), "host", "path", (F.col(verdict) == "block").cast("double").alias("_label"), F.xxhash64(url).alias("_hash"))
    statistics = materialise(suffix_statistics(known), "url-suffixes")
    suffixes = statistics.select("_suffix", "_share", "_rate")
    total, blocked = statistics.agg(F.coalesce(F.sum("_n"), F.lit(0)), F.coalesce(F.sum("_blocked"), F.lit(0.0))).first()
    sizes = {0.0: total - int(blocked), 1.0: int(blocked)}
    if not all(sizes.values()):
        return UrlModel(suffixes, None, "block" if blocked else "allow")
    ready = VectorAssembler(inputCols=list(FEATURES), outputCol="_features").transform(
        with_features(_sample(known, sizes, rows), "_url", suffixes)).select("_features", "_label").coalesce(2)
    trees = GBTClassifier(featuresCol="_features", labelCol="_label", predictionCol="_prediction",
                          maxIter=rounds, maxDepth=depth, maxBins=64, seed=7).fit(ready)
    return UrlModel(suffixes, trees, None)


def filter_urls(pages: DataFrame, rules: Sequence[tuple[str, str]], key: str = "page_id", url: str = "url") -> DataFrame:
    """Key, host, path, fitting rule and verdict of every row. The trees learn from the
    verdicts that the rules give."""
    parts = pages.select(F.col(key), F.col(url).alias("_raw_url"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    ruled = parts.withColumn("_fit", match_rules(F.col("host"), F.col("path"), rules))
    model = fit(ruled.withColumn("_verdict", F.col("_fit.verdict")), "_raw_url", "_verdict")
    return model.judge(ruled, "_raw_url").select(
        key, "host", "path", F.col("_fit.rule").alias("rule"),
        F.coalesce(F.col("_fit.verdict"), F.col("predicted")).alias("verdict"),
        F.when(F.col("_fit").isNull(), "trees").otherwise("rule").alias("judged_by"))
