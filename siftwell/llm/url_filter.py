"""URL filter: rules first, boosted trees on lexical features for the rest."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftwell.llm.columns import LOWER, UPPER, free_name, only
from siftwell.session import stage

ALLOW, BLOCK = "allow", "block"

#: Labelled URLs that the trees are fitted on at most: those with the smallest hashes.
TRAINING_ROWS = 20_000
#: Suffixes are counted in so many hash buckets, so their statistics have a fixed size.
SUFFIX_BUCKETS = 1024
TREES, DEPTH = 20, 4
_SMOOTHING = 10.0


class UrlRule(NamedTuple):
    verdict: str
    host: str
    path: str

    @property
    def text(self) -> str:
        return self.host + self.path


#: Fixed values of the contract.
RULES = [
    UrlRule(ALLOW, "org", "/"),
    UrlRule(BLOCK, "example.org", "/es/"),
    UrlRule(BLOCK, "example.org", "/en/1"),
    UrlRule(ALLOW, "com", "/fr/"),
    UrlRule(BLOCK, "com", "/de/"),
]


def split_url(url: Column) -> tuple[Column, Column]:
    """(host, path); both empty for null and for what has no ``://``."""
    rest = F.when(F.contains(url, F.lit("://")), F.regexp_replace(url, r"(?s)^.*?://", "")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)
    return host, path


def matching_rule(host: Column, path: Column, rules: list[UrlRule] = RULES) -> Column:
    """struct<text, verdict> of the longest rule that fits, or null. The rules are a stated list of the caller."""
    found = F.lit(None).cast("struct<text: string, verdict: string>")
    for rule in sorted(rules, key=lambda r: len(r.text)):  # the longest is asked first
        fits = ((host == rule.host) | F.endswith(host, F.lit("." + rule.host))) & F.startswith(path, F.lit(rule.path))
        found = F.when(fits, F.struct(F.lit(rule.text).alias("text"), F.lit(rule.verdict).alias("verdict"))).otherwise(found)
    return found


FEATURES = [
    "length", "host_length", "path_length", "depth", "labels", "digits", "digit_ratio", "other_ratio", "entropy",
    "host_entropy", "parameters", "query_length", "has_fragment", "hyphens", "longest_part", "extension", "secure",
]


def _entropy(text: str) -> float:
    n = len(text)
    return -sum(c / n * math.log2(c / n) for c in Counter(text).values()) if n else 0.0


def lexical(url: str | None, host: str, path: str) -> list[float]:
    """The features of one address, in the order of ``FEATURES``."""
    url = url or ""
    head, _, fragment = url.partition("#")
    query = head.partition("?")[2]
    parts = [p for p in path.split("/") if p]
    digits = sum(c.isdigit() for c in url)
    letters = sum(c.isalpha() for c in url)
    n = max(1, len(url))
    return [
        len(url), len(host), len(path), len(parts), host.count(".") + 1 if host else 0, digits, digits / n,
        1 - (digits + letters) / n, _entropy(url), _entropy(host), sum(bool(p) for p in query.split("&")), len(query),
        bool(fragment), host.count("-") + path.count("-"), max(map(len, parts), default=0),
        "." in parts[-1] if parts else False, url.startswith("https:"),
    ]


def _lexical_column(url: Column, host: Column, path: Column) -> Column:
    @F.pandas_udf("array<double>")
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for urls, hosts, paths in batches:
            yield pd.Series([np.array(lexical(*x), dtype=float) for x in zip(urls, hosts, paths)], dtype=object)

    return run(url, host, path)


def _suffix(host: Column) -> Column:
    """The bucket of the last two labels of the host, and of the last one."""
    bucket = lambda n: F.pmod(F.xxhash64(F.substring_index(host, ".", -n)), F.lit(SUFFIX_BUCKETS)).cast("int")
    return F.array(bucket(1), bucket(2))


class UrlFilter(NamedTuple):
    model: GBTClassificationModel | None  # none if the labelled addresses are all of one kind
    only_label: float
    shares: list[float]  # smoothed share of blocked addresses by suffix bucket
    sizes: list[float]  # log of the number of addresses by suffix bucket

    def features(self, url: Column, host: Column, path: Column) -> Column:
        at = lambda values, n: F.element_at(F.array(*map(F.lit, values)), F.element_at(_suffix(host), n) + 1)
        stats = F.array(at(self.shares, 1), at(self.sizes, 1), at(self.shares, 2), at(self.sizes, 2))
        return array_to_vector(F.concat(_lexical_column(url, host, path), stats))


def _prepared(urls: DataFrame, url: str) -> DataFrame:
    """(url, host, path, rule)"""
    host, path = split_url(F.col("url"))
    split = only(urls, url=url).select("url", host.alias("host"), path.alias("path"))
    return split.withColumn("rule", matching_rule(F.col("host"), F.col("path")))


def train_url_filter(urls: DataFrame, url: str = "url", seed: int = 7) -> UrlFilter:
    """Boosted trees fitted on the addresses that a rule labels.

    Suffix statistics are counted over all addresses (all labelled ones for the shares). The trees are fitted on a
    bounded sample, the ``TRAINING_ROWS`` labelled addresses with the smallest hashes.
    """
    rows = _prepared(urls, url)
    blocked = F.when(F.col("rule.verdict") == BLOCK, 1.0).when(F.col("rule.verdict") == ALLOW, 0.0)
    rows = rows.withColumn("label", blocked)
    counted = (
        rows.select(F.explode(_suffix(F.col("host"))).alias("bucket"), "label")
        .groupBy("bucket")
        .agg(F.count("*").alias("n"), F.count("label").alias("known"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("blocked"))
        .collect()  # at most SUFFIX_BUCKETS rows
    )
    known = sum(r.known for r in counted)
    prior = sum(r.blocked for r in counted) / known if known else 0.5
    shares, sizes = [prior] * SUFFIX_BUCKETS, [0.0] * SUFFIX_BUCKETS
    for r in counted:
        shares[r.bucket] = (r.blocked + _SMOOTHING * prior) / (r.known + _SMOOTHING)
        sizes[r.bucket] = math.log1p(r.n)
    untrained = UrlFilter(None, float(prior >= 0.5), shares, sizes)
    sample = rows.where("label IS NOT NULL").select("url", "host", "path", "label")
    sample = sample.orderBy(F.xxhash64("url"), "url").limit(TRAINING_ROWS)
    vector = untrained.features(F.col("url"), F.col("host"), F.col("path"))
    sample = stage(sample.select(vector.alias("features"), "label"), "labelled_urls")
    if sample.select("label").distinct().count() < 2:
        return untrained
    trees = GBTClassifier(
        featuresCol="features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, stepSize=0.2, seed=seed,
        checkpointInterval=-1, minInstancesPerNode=5,
    )
    return UrlFilter(trees.fit(sample), 0.0, shares, sizes)


def judge_urls(pages: DataFrame, url: str = "url", filter_: UrlFilter | None = None) -> DataFrame:
    """``pages`` with ``host``, ``path``, ``rule`` (null if none fits), ``verdict`` and ``block_score``.

    The verdict is that of the longest rule that fits; where none fits, it is ``block`` if the trees find blocking more
    likely than not. The score is theirs in any case. A null address, or one without ``://``, has an empty host and
    path and is judged by the trees. Columns of these names are replaced; repeated rows are judged alike, and an empty
    table gives an empty one. Scoring runs in the tasks that read the rows: nothing is shuffled.
    """
    learned = train_url_filter(pages, url) if filter_ is None else filter_
    pages = pages.drop(*(c for c in ("host", "path", "rule", "verdict", "block_score") if c != url))
    host, path = split_url(F.col(url))
    vector, found = free_name(pages, "url_features"), free_name(pages, "url_rule")
    split = pages.withColumns({"host": host, "path": path})
    split = split.withColumn(found, matching_rule(F.col("host"), F.col("path")))
    if learned.model is None:
        scored = split.withColumn("block_score", F.lit(learned.only_label))
    else:
        made = {c: free_name(split, c) for c in ("url_raw", "url_probability", "url_prediction")}
        model = learned.model.copy().setFeaturesCol(vector)
        model = model.setRawPredictionCol(made["url_raw"]).setProbabilityCol(made["url_probability"])
        model = model.setPredictionCol(made["url_prediction"])
        scored = model.transform(split.withColumn(vector, learned.features(F.col(url), F.col("host"), F.col("path"))))
        scored = scored.withColumn("block_score", vector_to_array(made["url_probability"])[1]).drop(vector, *made.values())
    likely = F.when(F.col("block_score") > 0.5, BLOCK).otherwise(ALLOW)
    return scored.withColumns(
        {"rule": F.col(found)["text"], "verdict": F.coalesce(F.col(found)["verdict"], likely)}
    ).drop(found)
