"""URL filter: host and path rules, then gradient-boosted trees on lexical features.

Native throughout: features, gradients, histograms and scores are DataFrame
expressions. The labelled URLs are those that a rule decides (or any frame with
url and blocked); all of them are used, gathered to one row per distinct vector
of binned features. Each level of a tree is one aggregate over those rows, whose
result has at most nodes * features * bins rows. A tree is a nested CASE.

Features, each in at most 16 bins: URL length, path depth, digit ratio, entropy of
the host's characters, number of parameters, hyphens and labels of the host, and
the share of blocked URLs under the host's last label (1024 hashed suffixes, so
the statistics table that is broadcast has at most 1024 rows).

Nulls and odd cases: a null URL or one without ``://`` has an empty host and path
and is judged by its features; repeated rows are judged each; without labels, or
with one kind only, that kind (or allow) is the verdict where no rule fits. Empty
tables give no rows. Extra columns are ignored.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import written

BINS = 16
SUFFIXES = 1024
FEATURES = ["length", "depth", "digits", "entropy", "params", "hyphens", "labels", "suffix"]


def host_of(url: Column) -> Column:
    """After the first ``://`` up to ``/``, ``?``, ``#`` or the end, A-Z lower-cased."""
    return F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    text = F.coalesce(url, F.lit(""))
    at = F.instr(text, "://")
    return F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """(rule text, verdict) of the longest rule (host, path, verdict) that fits, else nulls."""
    text = verdict = None
    for rule_host, rule_path, say in sorted(rules, key=lambda r: -len(r[0] + r[1])):
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(rule_path)
        text = (F if text is None else text).when(fits, F.lit(rule_host + rule_path))
        verdict = (F if verdict is None else verdict).when(fits, F.lit(say))
    none = F.lit(None).cast("string")
    return (none, none) if text is None else (text, verdict)


def _bin(value: Column, width: float) -> Column:
    return F.least(F.floor(value / width), F.lit(BINS - 1)).cast("int")


def features(urls: DataFrame) -> DataFrame:
    """Adds the binned features, but for the suffix, and the suffix bucket to rows with url, host, path."""
    url, host = F.coalesce("url", F.lit("")), F.col("host")
    count = lambda text, chars: F.length(text) - F.length(F.translate(text, chars, ""))
    size = F.greatest(F.length(host), F.lit(1))
    each = F.array_distinct(F.split(host, ""))
    share = lambda ch: (F.length(host) - F.length(F.replace(host, ch, F.lit("")))) / size
    entropy = F.aggregate(F.filter(each, lambda ch: ch != ""), F.lit(0.0), lambda total, ch: total - share(ch) * F.log2(share(ch)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return urls.withColumns({
        "length": _bin(F.length(url), 8), "depth": _bin(count(F.col("path"), "/"), 1), "digits": _bin(count(url, "0123456789") / F.greatest(F.length(url), F.lit(1)), 0.04),
        "entropy": _bin(entropy, 0.3), "params": _bin(F.when(query == "", 0).otherwise(count(query, "&") + 1), 1), "hyphens": _bin(count(host, "-"), 1), "labels": _bin(count(host, "."), 1),
        "bucket": (F.crc32(F.substring_index(host, ".", -1)) % SUFFIXES).cast("int"),
    })


@dataclass
class Forest:
    base: float = 0.0
    #: each tree: (feature, bin, left, right), where bin values up to ``bin`` go left, or a leaf's number
    trees: list = field(default_factory=list)

    def margin(self) -> Column:
        total = F.lit(self.base)
        for tree in self.trees:
            total = total + _walk(tree, F.lit)
        return total


def _walk(tree, leaf) -> Column:
    if not isinstance(tree, tuple):
        return leaf(tree)
    feature, at, left, right = tree
    return F.when(F.col(FEATURES[feature]) <= at, _walk(left, leaf)).otherwise(_walk(right, leaf))


def suffix_table(labelled: DataFrame) -> DataFrame:
    """At most SUFFIXES rows: bucket -> bin of the smoothed share of blocked URLs."""
    return labelled.groupBy("bucket").agg(_bin((F.sum("blocked") + 1) / (F.count("*") + 2), 1 / BINS).alias("suffix"))


def with_suffix(rows: DataFrame, suffixes: DataFrame) -> DataFrame:
    return rows.join(F.broadcast(suffixes), "bucket", "left").withColumn("suffix", F.coalesce("suffix", F.lit(BINS // 2)))


def fit(labelled: DataFrame, rounds: int = 8, depth: int = 2, rate: float = 0.5, ridge: float = 1.0) -> Forest:
    """Boosted trees on rows with the binned features and blocked (0 or 1)."""
    cells = written(labelled.groupBy(*FEATURES, "blocked").agg(F.count("*").cast("double").alias("n")), "cells")
    first = cells.agg(F.sum(F.col("n") * F.col("blocked")).alias("yes"), F.sum("n").alias("n")).first()
    if not first["n"]:
        return Forest(base=-math.inf)
    if first["yes"] in (0, first["n"]):
        return Forest(base=math.inf if first["yes"] else -math.inf)
    forest = Forest(base=math.log(first["yes"] / (first["n"] - first["yes"])))
    bins = F.explode(F.array(*[F.struct(F.lit(i).alias("f"), F.col(c).alias("b")) for i, c in enumerate(FEATURES)]))
    for _ in range(rounds):
        p = 1 / (1 + F.exp(-forest.margin()))
        state = cells.select(*FEATURES, "n", ((F.col("blocked") - p) * F.col("n")).alias("g"), (p * (1 - p) * F.col("n")).alias("h"))
        splits: dict[int, tuple | None] = {}
        leaves: dict[int, float] = {}
        frontier = [1]
        for level in range(depth + 1):
            node = _walk(_grown(1, splits, dict.fromkeys(range(1, 2 ** (depth + 2)))), F.lit)
            rows = state.withColumn("node", node).withColumn("at", bins).groupBy("node", "at.f", "at.b").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()
            following = []
            for k in frontier:
                mine = [r for r in rows if r["node"] == k]
                g, h = sum(r["g"] for r in mine if r["f"] == 0), sum(r["h"] for r in mine if r["f"] == 0)
                leaves[k] = rate * g / (h + ridge)
                best = (1e-6, None)
                for f in range(len(FEATURES)) if level < depth else ():
                    left_g = left_h = 0.0
                    for r in sorted((r for r in mine if r["f"] == f), key=lambda r: r["b"])[:-1]:
                        left_g, left_h = left_g + r["g"], left_h + r["h"]
                        gain = left_g**2 / (left_h + ridge) + (g - left_g) ** 2 / (h - left_h + ridge) - g**2 / (h + ridge)
                        if gain > best[0] + 1e-9:
                            best = (gain, (f, r["b"]))
                if best[1]:
                    splits[k] = best[1]
                    following += [2 * k, 2 * k + 1]
            frontier = following
            if not frontier:
                break
        forest.trees.append(_grown(1, splits, leaves))
    return forest


def _grown(k: int, splits: dict, leaves: dict):
    """The tree below node k; a leaf is its value, or its number where values aren't known."""
    if k in splits:
        return (*splits[k], _grown(2 * k, splits, leaves), _grown(2 * k + 1, splits, leaves))
    return k if leaves.get(k) is None else leaves[k]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], labelled: DataFrame | None = None, rounds: int = 8, depth: int = 2) -> DataFrame:
    """Per row: page_id, host, path, rule, verdict, score (probability of block).

    labelled: url and blocked (0/1); by default the URLs that a rule decides.
    """
    url = F.col("url").cast("string")
    rows = pages.select(F.col("page_id"), url.alias("url")).withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url")))
    rule, say = rule_of(F.col("host"), F.col("path"), rules)
    rows = features(rows.withColumn("rule", rule).withColumn("said", say))
    if labelled is None:
        known = rows.where("said is not null").withColumn("blocked", (F.col("said") == "block").cast("int"))
    else:
        known = features(labelled.select(url.alias("url"), F.col("blocked").cast("int").alias("blocked")).where("blocked is not null").withColumn("host", host_of(F.col("url"))).withColumn("path", path_of(F.col("url"))))
    suffixes = written(suffix_table(known), "suffixes")
    forest = fit(with_suffix(known, suffixes), rounds, depth)
    score = 1 / (1 + F.exp(-forest.margin()))
    return with_suffix(rows, suffixes).withColumn("score", score).select("page_id", "host", "path", "rule", F.coalesce("said", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score")
