"""URL filters: rules by host and path, and gradient-boosted trees on lexical features for the urls without a rule.

The trees learn from labelled urls, those that a rule judges, at most `SAMPLE_ROWS` of them; they are fitted on the
driver and written out as one arithmetic expression, so that scoring all urls is a projection. Features: length,
depth, digit ratio, entropy, counts of parameters, labels and hyphens, and statistics of the host's suffix. Those are
counted over sites (hosts), not over urls, and a training url's are counted without its own site: a suffix that few
sites have labelled says nothing of others, so there the shape of a url decides.

Cases: a null url, or one without `://`, has an empty host and path and fits no rule; the trees judge it by the
features of an empty string. With no labelled url the method allows. Ties of score (0) are allowed. Repeated rows get
repeated results; an empty table gives an empty table.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import common

# The contract's rules, as (action, host and path).
RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Labelled urls that the trees learn from, at most.
SAMPLE_ROWS = 4000
TREES, DEPTH, RATE, BINS, LEAST_ROWS, PENALTY = 20, 3, 0.3, 16, 5, 1.0
#: Sites that a suffix has at least for its statistics, and how many sites' weight the share over all has in them.
LEAST_SITES, PRIOR_SITES = 3, 2.0
FEATURES = ("length", "depth", "digit_ratio", "entropy", "parameters", "labels", "hyphens", "suffix_score", "suffix_share")


def _after_scheme(url: str = "url") -> Column:
    at = F.locate("://", F.coalesce(F.col(url).cast("string"), F.lit("")))
    return F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url))).otherwise("")


def with_parts(pages: DataFrame) -> DataFrame:
    """page_id, url (null as empty), host, path, query, and hashes of the host's suffix and of the host, the site."""
    return (
        pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("url").cast("string"), F.lit("")).alias("url"))
        .withColumn("rest", _after_scheme())
        .select(
            "page_id",
            "url",
            F.translate(F.regexp_extract("rest", r"^[^/?#]*", 0), _UPPER, _LOWER).alias("host"),
            F.regexp_extract("rest", r"^[^/?#]*([^?#]*)", 1).alias("path"),
            F.regexp_extract("rest", r"^[^?#]*\?([^#]*)", 1).alias("query"),
        )
        .withColumns({"suffix": F.xxhash64(F.substring_index("host", ".", -1)), "site": F.xxhash64("host")})
    )


def rule_of(rules=RULES) -> Column:
    """The longest rule that fits host and path, else null."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        host, _, path = rule.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit("/" + path))
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def _action(rules=RULES) -> Column:
    out = F.lit(None).cast("string")
    for action, rule in rules:
        out = F.when(F.col("rule") == rule, F.lit(action)).otherwise(out)
    return out


def _count(column: str, text: str) -> Column:
    return ((F.length(column) - F.length(F.replace(F.col(column), F.lit(text), F.lit("")))) / len(text)).cast("double")


def lexical_features() -> dict[str, Column]:
    n = F.greatest(F.length("url"), F.lit(1)).cast("double")
    each = F.transform(F.array_distinct(F.split("url", "")), lambda c: (F.length("url") - F.length(F.replace(F.col("url"), c, F.lit("")))) / n)
    entropy = F.aggregate(each, F.lit(0.0), lambda total, p: total - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return {
        "length": F.length("url").cast("double"),
        "depth": _count("path", "/"),
        "digit_ratio": F.length(F.regexp_replace("url", "[^0-9]", "")) / n,
        "entropy": entropy,
        "parameters": F.when(F.col("query") == "", 0.0).otherwise(_count("query", "&") + 1),
        "labels": F.when(F.col("host") == "", 0.0).otherwise(_count("host", ".") + 1),
        "hyphens": _count("host", "-"),
    }


@dataclass
class Trees:
    """A base score, trees as nested tuples (feature, threshold, left, right) or leaves, statistics by suffix."""

    base: float
    trees: list
    suffixes: dict[int, tuple[float, float]]
    other: tuple[float, float]

    def score(self) -> Column:
        """Log-odds of blocking; the trees' features must be columns."""
        def branch(node) -> Column:
            if isinstance(node, float):
                return F.lit(node)
            feature, threshold, low, high = node
            return F.when(F.col(FEATURES[feature]) <= threshold, branch(low)).otherwise(branch(high))

        out = F.lit(self.base)
        for tree in self.trees:
            out = out + branch(tree)
        return out

    def with_features(self, parts: DataFrame) -> DataFrame:
        known = F.create_map(*[x for s, (score, share) in sorted(self.suffixes.items()) for x in (F.lit(s).cast("long"), F.struct(F.lit(score).alias("score"), F.lit(share).alias("share")))]) if self.suffixes else None
        found = known[F.col("suffix")] if known is not None else None

        def statistic(name: str, other: float) -> Column:
            return F.coalesce(found[name], F.lit(other)) if found is not None else F.lit(other)

        return parts.withColumns(lexical_features() | {"suffix_score": statistic("score", self.other[0]), "suffix_share": statistic("share", self.other[1])})


def _tree(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, rows: np.ndarray, depth: int):
    """A regression tree on binned thresholds, by the gain of second-order boosting."""
    g, h = gradient[rows].sum(), hessian[rows].sum()
    best = (1e-9, None)
    if depth and len(rows) >= 2 * LEAST_ROWS:
        for f in range(x.shape[1]):
            values = x[rows, f]
            for cut in np.unique(np.quantile(values, np.arange(1, BINS) / BINS, method="lower")):
                low = values <= cut
                n = int(low.sum())
                if n < LEAST_ROWS or len(rows) - n < LEAST_ROWS:
                    continue
                gl, hl = gradient[rows[low]].sum(), hessian[rows[low]].sum()
                gain = gl * gl / (hl + PENALTY) + (g - gl) ** 2 / (h - hl + PENALTY) - g * g / (h + PENALTY)
                if gain > best[0]:
                    best = (gain, (f, float(cut), low))
    if best[1] is None:
        return float(-RATE * g / (h + PENALTY))
    f, cut, low = best[1]
    return (f, cut, _tree(x, gradient, hessian, rows[low], depth - 1), _tree(x, gradient, hessian, rows[~low], depth - 1))


def _value(node, x: np.ndarray) -> np.ndarray:
    if isinstance(node, float):
        return np.full(len(x), node)
    return np.where(x[:, node[0]] <= node[1], _value(node[2], x), _value(node[3], x))


class _Suffixes:
    """Share of blocked urls and share of all sites, by suffix, each site counting once."""

    def __init__(self, suffixes: list[int], sites: list[int], blocked: np.ndarray):
        self.by: dict[int, dict[int, list[float]]] = {}
        for suffix, site, b in zip(suffixes, sites, blocked):
            own = self.by.setdefault(suffix, {}).setdefault(site, [0.0, 0])
            own[0] += float(b)
            own[1] += 1
        self.sites = max(1, sum(map(len, self.by.values())))
        self.prior = (float(np.sum(blocked)) + 1) / (len(blocked) + 2)
        self.other = (self.prior, 0.0)

    def of(self, suffix: int, less: int | None = None) -> tuple[float, float]:
        """Statistics of a suffix, without one of its sites if that is given."""
        shares = [k / n for site, (k, n) in self.by.get(suffix, {}).items() if site != less]
        if len(shares) < LEAST_SITES:
            return self.other
        return (sum(shares) + PRIOR_SITES * self.prior) / (len(shares) + PRIOR_SITES), len(shares) / self.sites


def boosted(features: np.ndarray, suffixes: list[int], sites: list[int], blocked: np.ndarray) -> Trees:
    """Fit trees to labelled rows: `features` are the lexical ones; the suffix's are added from the rows of other sites."""
    known = _Suffixes(suffixes, sites, blocked)
    if len(blocked) == 0:
        return Trees(-1.0, [], {}, known.other)
    base = math.log(known.prior / (1 - known.prior))
    x = np.column_stack([features, np.array([known.of(*own) for own in zip(suffixes, sites)], float)])
    score, trees = np.full(len(x), base), []
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-score))
        tree = _tree(x, p - blocked, p * (1 - p), np.arange(len(x)), DEPTH)
        trees.append(tree)
        score += _value(tree, x)
    return Trees(float(base), trees, {s: known.of(s) for s in known.by if known.of(s) != known.other}, known.other)


def training_rows(pages: DataFrame, rules=RULES) -> tuple[np.ndarray, list[int], list[int], np.ndarray]:
    """Lexical features, suffixes, sites and labels of urls that a rule judges, those with the lowest hashes."""
    names = [f for f in FEATURES if not f.startswith("suffix")]
    labelled = with_parts(pages).withColumn("rule", rule_of(rules)).where(F.col("rule").isNotNull())
    sample = common.hashed_sample(labelled, ["url", "page_id"], SAMPLE_ROWS).withColumns(lexical_features())
    rows = sample.select(*names, "suffix", "site", (_action(rules) == "block").alias("blocked")).collect()
    x = np.array([[r[n] for n in names] for r in rows], float).reshape(len(rows), len(names))
    return x, [r.suffix for r in rows], [r.site for r in rows], np.array([r.blocked for r in rows], float)


def fitted(pages: DataFrame, rules=RULES) -> Trees:
    """Trees from labelled urls: their features and labels alone come to the driver."""
    return boosted(*training_rows(pages, rules))


def judged(pages: DataFrame, rules=RULES, trees: Trees | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict (allow or block), score (the trees' log-odds of blocking) of every url."""
    trees = trees or fitted(pages, rules)
    scored = trees.with_features(with_parts(pages)).withColumn("rule", rule_of(rules)).withColumn("score", trees.score())
    method = F.when(F.col("score") > 0, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce(_action(rules), method).alias("verdict"), "score")
