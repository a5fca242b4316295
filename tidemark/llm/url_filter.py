"""URL filters: domain and path rules, and boosted trees on lexical features for the rest."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.llm.text import let
from tidemark.runtime import materialize

ASCII_UPPER, ASCII_LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """Fits `host` and its subdomains where the path starts with `path`."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def rule(verdict: str, text: str) -> Rule:
    host, slash, path = text.partition("/")
    return Rule(verdict, host, slash + path)


def parts(url: Column) -> Column:
    """struct(host, path, query, fragment): plain splitting, no decoding.

    The host stands after the first :// up to /, ?, # or the end, A-Z lower-cased; the path then
    up to ?, # or the end. Null, or no ://: all empty.
    """
    url = F.coalesce(url, F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))

    def split(r: Column) -> Column:
        host = F.regexp_extract(r, r"^([^/?#]*)", 1)
        return F.struct(
            F.translate(host, ASCII_UPPER, ASCII_LOWER).alias("host"),
            F.regexp_extract(r, r"^[^/?#]*([^?#]*)", 1).alias("path"),
            F.regexp_extract(r, r"^[^?#]*\?([^#]*)", 1).alias("query"),
            F.regexp_extract(r, r"(?s)^[^#]*#(.*)$", 1).alias("fragment"),
        )

    return let(rest, split)


def matching_rule(host: Column, path: Column, rules: Sequence[Rule]) -> Column:
    """The longest rule that fits, as its number in rules; null if none does. Ties: the first."""
    out = F.lit(None).cast("int")
    for r in sorted(rules, key=lambda r: len(r.name)):
        fits = ((host == r.host) | F.endswith(host, F.lit("." + r.host))) & F.startswith(path, F.lit(r.path))
        out = F.when(fits, F.lit(rules.index(r))).otherwise(out)
    return out


def suffix(host: Column) -> Column:
    """The last two labels of a host: what its statistics are gathered by."""
    return F.regexp_extract(host, r"([^.]+(?:\.[^.]+)?)$", 1)


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern))


def _entropy(text: Column) -> Column:
    """Bits a character, from the sorted characters' run lengths."""

    def runs(s: Column) -> Column:
        n = F.size(s).cast("double")
        each = F.transform(F.array_distinct(s), lambda c: F.size(F.filter(s, lambda x: x == c)) / n)
        return F.aggregate(each, F.lit(0.0), lambda acc, p: acc - p * F.log2(p))

    return F.coalesce(let(F.filter(F.split(text, ""), lambda x: x != ""), runs), F.lit(0.0))


FOLDS = 5  # of hosts: a labelled url's shares come from the hosts of the other folds
BASE = (
    "url_length", "host_length", "path_length", "query_length", "host_depth", "path_depth", "host_digit_ratio", "path_digit_ratio",
    "host_entropy", "path_entropy", "n_params", "n_hyphens", "longest_label", "suffix_share", "suffix_hosts",
)
SHARES = ("tld_block_share", "suffix_block_share", "section_block_share")
FEATURES = (*BASE, *SHARES)


def suffix_statistics(urls: DataFrame, url_col: str = "url") -> DataFrame:
    """(suffix, suffix_share, suffix_hosts): share of all urls, and log of distinct hosts."""
    rows = urls.select(parts(F.col(f"`{url_col}`")).alias("p")).select(F.col("p.host").alias("host"))
    hosts = rows.groupBy("host").agg(F.count(F.lit(1)).alias("n")).withColumn("suffix", suffix(F.col("host")))
    by = hosts.groupBy("suffix").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("hosts"))
    total = by.agg(F.sum("n").alias("total"))
    return by.join(F.broadcast(total)).select("suffix", (F.col("n") / F.col("total")).alias("suffix_share"), F.log1p("hosts").alias("suffix_hosts"))


def lexical(host: Column, path: Column, query: Column) -> dict[str, Column]:
    length = lambda c: F.length(c).cast("double")
    ratio = lambda c: F.coalesce(F.try_divide(_count(c, "[0-9]"), F.length(c)), F.lit(0.0)).cast("double")
    return {
        "url_length": length(host) + length(path) + length(query),
        "host_length": length(host),
        "path_length": length(path),
        "query_length": length(query),
        "host_depth": _count(host, r"\.").cast("double"),
        "path_depth": _count(path, "/").cast("double"),
        "host_digit_ratio": ratio(host),
        "path_digit_ratio": ratio(path),
        "host_entropy": _entropy(host),
        "path_entropy": _entropy(path),
        "n_params": F.when(query == "", F.lit(0.0)).otherwise(_count(query, "&").cast("double") + 1),
        "n_hyphens": _count(host, "-").cast("double"),
        "longest_label": F.coalesce(F.array_max(F.transform(F.split(host, r"\."), lambda x: F.length(x))).cast("double"), F.lit(0.0)),
    }


def featured(urls: DataFrame, url_col: str = "url", statistics: DataFrame | None = None) -> DataFrame:
    """urls with _host, _path and _features (BASE in order, as struct of doubles).

    The statistics join is by suffix; equal suffixes are one row there, and Spark may split the
    urls of a hot suffix.
    """
    statistics = suffix_statistics(urls, url_col) if statistics is None else statistics
    rows = urls.withColumn("_p", parts(F.col(f"`{url_col}`"))).withColumn("_suffix", suffix(F.col("_p.host")))
    named = statistics.select(*[F.col(c).alias(f"_of_{c}") for c in ("suffix", "suffix_share", "suffix_hosts")])
    joined = rows.join(named, F.col("_suffix") == F.col("_of_suffix"), "left")
    columns = lexical(F.col("_p.host"), F.col("_p.path"), F.col("_p.query"))
    for name in ("suffix_share", "suffix_hosts"):
        columns[name] = F.coalesce(F.col(f"_of_{name}"), F.lit(0.0))
    features = F.struct(*[columns[n].alias(n) for n in BASE])
    return joined.select(*[F.col(f"`{c}`") for c in urls.columns], F.col("_p.host").alias("_host"), F.col("_p.path").alias("_path"), features.alias("_features"))


def _fold(host: Column) -> Column:
    return F.pmod(F.xxhash64(host), F.lit(FOLDS)).cast("int")


def _keys(host: Column, path: Column) -> Column:
    """What label shares are gathered by: the last label with a dot, the suffix, and the suffix with
    the first part of the path."""
    return F.array(F.concat(F.lit("."), F.regexp_extract(host, r"([^.]*)$", 1)), suffix(host), F.concat(suffix(host), F.lit("/"), F.regexp_extract(path, r"^/([^/]*)", 1)))


def label_shares(labelled: DataFrame) -> DataFrame:
    """(key, n, y, folds): urls and those to block of each suffix, last label and section, in all
    and by fold of hosts. labelled: _host, _path, label."""
    each = labelled.filter("label is not null").select(F.explode(_keys(F.col("_host"), F.col("_path"))).alias("key"), _fold(F.col("_host")).alias("fold"), F.col("label").cast("long").alias("y"))
    by = each.groupBy("key", "fold").agg(F.count(F.lit(1)).alias("n"), F.sum("y").alias("y"))
    fold = F.struct("fold", F.struct("n", "y").alias("of"))
    return by.groupBy("key").agg(F.sum("n").alias("n"), F.sum("y").alias("y"), F.map_from_entries(F.collect_list(fold)).alias("folds"))


def with_label_shares(rows: DataFrame, shares: DataFrame, own: bool) -> DataFrame:
    """rows of featured() with all FEATURES. A share of blocked urls is smoothed by two urls of the
    share before it, the first by one of either label: what is unknown is judged by what it
    belongs to. own: rows with a label are among those counted, so they leave out what their own fold
    says; their host's own verdict never tells on them."""
    at = F.when(F.col("label").isNotNull(), _fold(F.col("_host"))) if own else F.lit(None).cast("int")
    out, found = rows.withColumn("_keys", _keys(F.col("_host"), F.col("_path"))), [F.lit(0.5)]
    for k in range(len(SHARES)):
        named = shares.select(F.col("key").alias(f"_key{k}"), F.struct("n", "y", "folds").alias(f"_of{k}"))
        out = out.join(named, F.col("_keys")[k] == F.col(f"_key{k}"), "left")
        mine = F.try_element_at(F.col(f"_of{k}.folds"), at)
        left = lambda c: F.coalesce(F.col(f"_of{k}.{c}"), F.lit(0)) - F.coalesce(mine[c], F.lit(0))  # noqa: B023, E731
        found.append((left("y") + 2.0 * found[-1]) / (left("n") + 2.0))
    features = F.struct(*[F.col(f"_features.{n}").alias(n) for n in BASE], *(c.alias(n) for n, c in zip(SHARES, found[1:], strict=True)))
    return out.withColumn("_features", features).select(*rows.columns)


@dataclass
class Trees:
    """Gradient-boosted regression trees for log-loss; score() is one Spark expression."""

    base: float
    trees: list = field(default_factory=list)

    def score(self, features: Column) -> Column:
        """Probability of label 1, by nested conditions over the feature struct."""

        def branch(node) -> Column:
            if not isinstance(node, tuple):
                return F.lit(float(node))
            k, cut, low, high = node
            return F.when(features[FEATURES[k]] <= cut, branch(low)).otherwise(branch(high))

        margin = F.lit(float(self.base))
        for tree in self.trees:
            margin = margin + branch(tree)
        return 1.0 / (1.0 + F.exp(-margin))

    def predict(self, x: np.ndarray) -> np.ndarray:
        def walk(node, rows: np.ndarray, out: np.ndarray) -> None:
            if not isinstance(node, tuple):
                out[rows] += node
                return
            k, cut, low, high = node
            left = x[rows, k] <= cut
            walk(low, rows[left], out)
            walk(high, rows[~left], out)

        margin = np.full(len(x), self.base)
        for tree in self.trees:
            walk(tree, np.arange(len(x)), margin)
        return 1 / (1 + np.exp(-margin))


def fit(x: np.ndarray, y: np.ndarray, n: np.ndarray | None = None, rounds: int = 40, depth: int = 4, rate: float = 0.2, bins: int = 32, smooth: float = 1.0, least: int = 5) -> Trees:
    """Trees for features x and labels y (0 or 1), by second-order boosting over binned features.

    n: how many rows each stands for (None: one); bins are over distinct rows. One label only,
    or no row: no tree, and the score is the smoothed share of label 1.
    """
    n = np.ones(len(y)) if n is None else np.asarray(n, float)
    share = (float((n * y).sum()) + 0.5) / (n.sum() + 1.0)
    model = Trees(float(np.log(share / (1 - share))))
    if n.sum() < 2 * least or y.min() == y.max():
        return model
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, bins + 1)[1:-1])) for k in range(x.shape[1])]
    binned = np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(cuts)], axis=1)
    margin = np.full(len(y), model.base)

    def grow(rows: np.ndarray, g: np.ndarray, h: np.ndarray, left: int):
        leaf = -rate * g[rows].sum() / (h[rows].sum() + smooth)
        if not left or n[rows].sum() < 2 * least:
            return leaf
        whole, best = g[rows].sum() ** 2 / (h[rows].sum() + smooth), (1e-6, None, None)
        for k, c in enumerate(cuts):
            if not len(c):
                continue
            at = binned[rows, k]
            sums = [np.cumsum(np.bincount(at, w, len(c) + 1))[:-1] for w in (g[rows], h[rows], n[rows])]
            gl, hl, nl = sums
            gr, hr, nr = g[rows].sum() - gl, h[rows].sum() - hl, n[rows].sum() - nl
            gain = np.where((nl >= least) & (nr >= least), gl**2 / (hl + smooth) + gr**2 / (hr + smooth) - whole, 0)
            if gain.max() > best[0]:
                best = (float(gain.max()), k, int(gain.argmax()))
        _, k, b = best
        if k is None:
            return leaf
        low = binned[rows, k] <= b
        return (k, float(cuts[k][b]), grow(rows[low], g, h, left - 1), grow(rows[~low], g, h, left - 1))

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        tree = grow(np.arange(len(y)), n * (p - y), n * p * (1 - p), depth)
        model.trees.append(tree)
        margin += np.log(1 / (1 / Trees(0.0, [tree]).predict(x) - 1))
    return model


def train(labelled: DataFrame, max_rows: int = 10_000) -> Trees:
    """Trees from rows of (_features, label), from at most max_rows different ones.

    Equal rows are one that weighs as many, so a hot one takes one place. The rows taken are the
    first by hash of their features and label, so any partitioning gives the same model; that
    bound is what the driver holds.
    """
    each = labelled.filter("label is not null").groupBy("_features", F.col("label").cast("double").alias("label")).agg(F.count(F.lit(1)).alias("_n"))
    rows = each.select("_features.*", "label", "_n", F.xxhash64("_features", "label").alias("_o")).orderBy("_o", *FEATURES).limit(max_rows).toPandas()
    return fit(rows[list(FEATURES)].to_numpy(np.float64), rows["label"].to_numpy(np.float64), rows["_n"].to_numpy(np.float64))


def held_out(urls: DataFrame, rules: Sequence[Rule], url_col: str = "url", threshold: float = 0.5) -> DataFrame:
    """(n, accuracy, blocked) of the trees on a fifth of the hosts that rules decide, having learnt
    from the other four; blocked is the share of urls without a rule that they block."""
    rows = materialize(_ruled(urls.select(F.col(f"`{url_col}`").alias("url")), rules, "url"), "url-features")
    fold = _fold(F.col("_host")) == 0
    rows = materialize(with_label_shares(rows, label_shares(rows.filter(~fold)), own=True), "url-shares")
    model = train(rows.filter(~fold).select("_features", "label"))
    judged = rows.select("label", fold.alias("fold"), (model.score(F.col("_features")) >= threshold).cast("int").alias("p"))
    tested = F.col("fold") & F.col("label").isNotNull()
    return judged.agg(F.count_if(tested).alias("n"), F.avg(F.when(tested, (F.col("p") == F.col("label")).cast("int"))).alias("accuracy"), F.avg(F.when(F.col("label").isNull(), F.col("p"))).alias("blocked"))


def _ruled(urls: DataFrame, rules: Sequence[Rule], url_col: str, statistics: DataFrame | None = None) -> DataFrame:
    """featured(urls) with _rule, the number of the rule that decides, and label, its verdict."""
    block = [i for i, r in enumerate(rules) if r.verdict == "block"]
    rows = featured(urls, url_col, statistics).withColumn("_rule", matching_rule(F.col("_host"), F.col("_path"), list(rules)))
    return rows.withColumn("label", F.when(F.col("_rule").isNotNull(), F.col("_rule").isin(*block).cast("int")))


def judge(urls: DataFrame, labelled: DataFrame | None = None, rules: Sequence[Rule] = (), url_col: str = "url", threshold: float = 0.5, max_rows: int = 10_000) -> DataFrame:
    """urls with host, path, rule, score and verdict ('allow' or 'block').

    labelled: rows of (url, label), label 1 for block; without it, urls that a rule decides are
    the labelled ones. The longest fitting rule decides; for the rest, the trees: block if the
    score reaches the threshold. Suffix statistics cover all urls, and the shares of labels by suffix
    all labelled ones, which see those of other hosts only; the trees see at most max_rows labelled
    rows. Null urls, and urls without ://, have an empty host and path and are
    judged by the trees like any other. Rows that repeat are judged alike; columns of urls that
    share a result's name are replaced. Empty table: no rows. The urls' columns are written once
    with their features, so pass those that are wanted, not whole pages.
    """
    clash = {"host", "path", "rule", "score", "verdict"} - {url_col}
    urls = urls.drop(*[c for c in urls.columns if c in clash])
    columns = urls.columns
    urls = urls.withColumnsRenamed({"label": "_label"})
    statistics = materialize(suffix_statistics(urls, url_col), "suffixes")
    rows = materialize(_ruled(urls, rules, url_col, statistics), "url-features")
    number = F.col("_rule")
    taught = rows if labelled is None else featured(labelled.select(F.col("url"), F.col("label")), "url", statistics)
    shares = materialize(label_shares(taught), "label-shares")
    model = train(with_label_shares(taught, shares, own=True).select("_features", "label"), max_rows)
    rows = with_label_shares(rows, shares, own=labelled is None)
    names, verdicts = (F.array(*[F.lit(v) for v in x]) if x else F.array().cast("array<string>") for x in ([r.name for r in rules], [r.verdict for r in rules]))
    score = model.score(F.col("_features"))
    verdict = F.coalesce(F.get(verdicts, number), F.when(score >= threshold, F.lit("block")).otherwise(F.lit("allow")))
    kept = [F.col("_label" if c == "label" else f"`{c}`").alias(c) for c in columns]
    return rows.select(*kept, F.col("_host").alias("host"), F.col("_path").alias("path"), F.get(names, number).alias("rule"), score.alias("score"), verdict.alias("verdict"))
