"""URL verdicts from rules and from gradient-boosted trees on lexical features.

A rule names a host and the start of a path; it fits that host and all below it,
and the longest fitting rule decides. Other urls are judged by trees that were
trained on labelled urls. The trees see how a url is written, no word list: its
lengths, depth, digits, hyphens, the entropy of its host, its parameters, and how
often labelled urls under the same host suffixes were blocked.

The block rate and the suffixes' rates are counted over all labelled rows; for a url that
the trees learn from, without its own rows, which would tell its label. The trees
take a bounded sample of distinct urls, ``SAMPLE_ROWS``, half of each label as far as
there are, those with the smallest hash; they weigh as their label does in all labelled
rows, a url as often as it is there. With labels of
one kind only that kind is the verdict everywhere, and without any label ``allow``.

A null url, or one without ``://``, has an empty host and path; it fits no rule
and is judged by its features. Repeated rows are judged alike. Extra columns are
ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyforge.llm.common import written

ALLOW, BLOCK = "allow", "block"
SAMPLE_ROWS = 8192
TREES = 16
DEPTH = 4
# Weight of the overall block rate in the rate of a suffix.
PRIOR_ROWS = 20.0

# Rules of the production query.
RULES = ((BLOCK, "net/"), (ALLOW, "example.net/en/"), (BLOCK, "example.com/de/"), (ALLOW, "org/fr/"))

# Words in hosts by which urls are labelled for training.
BLOCK_WORDS = ("ads", "adult", "bets", "casino", "pills", "porn", "spam", "track", "viagra")

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _after_scheme(url: Column) -> Column:
    """What follows the first ``://``, empty without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))


def host_and_path(url: Column) -> tuple[Column, Column]:
    rest = F.coalesce(_after_scheme(url), F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), _UPPER, _LOWER)
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules: Sequence[tuple[str, str]] = RULES) -> Column:
    """The longest rule that fits, null if none does."""
    found = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda r: len(r[1])):
        rule_host, slash, rule_path = rule.partition("/")
        fits = ((host == rule_host) | host.endswith("." + rule_host)) & path.startswith(
            slash + rule_path
        )
        found = F.when(fits, F.lit(rule)).otherwise(found)
    return found


def parsed(urls: DataFrame) -> DataFrame:
    """The table with ``host`` and ``path`` in place of any columns of these names."""
    host, path = host_and_path(F.col("url"))
    return urls.withColumns({"host": host, "path": path})


def _count(text: Column, pattern: str) -> Column:
    return F.regexp_count(text, F.lit(pattern)).cast("double")


def _entropy(text: Column) -> Column:
    """Shannon entropy of a text's characters, in bits; 0 for an empty one."""
    n = F.greatest(F.length(text), F.lit(1)).cast("double")
    letters = F.array_distinct(F.split(text, ""))

    def term(letter: Column) -> Column:
        share = F.length(text) - F.length(F.replace(text, letter, F.lit("")))
        share = share / n
        return F.when(share > 0, -share * F.log2(share)).otherwise(F.lit(0.0))

    return F.when(F.length(text) == 0, F.lit(0.0)).otherwise(
        F.aggregate(F.transform(letters, term), F.lit(0.0), lambda a, b: a + b)
    )


def lexical_features() -> dict[str, Column]:
    """Features by name, of a table with ``url``, ``host`` and ``path``."""
    url = F.coalesce(F.col("url"), F.lit(""))
    host, path = F.col("host"), F.col("path")
    length = F.greatest(F.length(url), F.lit(1)).cast("double")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    longest = F.array_max(F.transform(F.split(host, r"\."), lambda part: F.length(part)))
    return {
        "f_length": F.length(url).cast("double"),
        "f_host_length": F.length(host).cast("double"),
        "f_path_length": F.length(path).cast("double"),
        "f_depth": _count(path, "/[^/]"),
        "f_host_labels": _count(host, r"[^.]+"),
        "f_longest_label": F.coalesce(longest, F.lit(0)).cast("double"),
        "f_digit_ratio": _count(url, "[0-9]") / length,
        "f_host_digits": _count(host, "[0-9]"),
        "f_host_hyphens": _count(host, "-"),
        "f_path_hyphens": _count(path, "[-_]"),
        "f_host_entropy": _entropy(host),
        "f_parameters": _count(query, "[^&]+"),
        "f_fragment": url.contains("#").cast("double"),
        "f_secure": url.startswith("https://").cast("double"),
        "f_escapes": _count(url, "%[0-9A-Fa-f]{2}"),
    }


SUFFIX_LABELS = (1, 2)


def _suffix(labels: int) -> Column:
    parts = F.split("host", r"\.")
    return F.array_join(
        F.slice(parts, F.greatest(F.size(parts) - labels + 1, F.lit(1)), labels), "."
    )


@dataclass
class UrlModel:
    """Trees and suffix statistics, or one verdict where there was nothing to tell apart."""

    trees: GBTClassificationModel | None
    suffixes: list[DataFrame]
    base_rate: float


def _with_features(
    urls: DataFrame,
    suffixes: list[DataFrame],
    base_rate: float,
    own_blocked: Column | float = 0.0,
    own_rows: Column | float = 0.0,
) -> DataFrame:
    """``urls`` with the vector ``_features``.

    ``own_blocked`` and ``own_rows`` are left out of the suffixes' counts.

    Suffix tables grow with the labelled hosts and are joined by shuffle, unless the
    session finds them small; urls go there once a host, so that a hot one costs a row
    per task.
    """
    features = lexical_features()
    wide = urls.withColumns(features)
    names = list(features)
    hosts = urls.select("host").distinct()
    rates = {}
    for labels, counts in zip(SUFFIX_LABELS, suffixes):
        blocked, rows = f"_blocked_{labels}", f"_rows_{labels}"
        counts = counts.withColumnsRenamed({"_blocked": blocked, "_rows": rows})
        hosts = (
            hosts.withColumn("_suffix", _suffix(labels))
            .join(counts, "_suffix", "left")
            .fillna(0.0, [blocked, rows])
            .drop("_suffix")
        )
        seen = F.greatest(F.col(rows) - own_rows, F.lit(0.0))
        rates[f"f_suffix_rate_{labels}"] = (
            F.greatest(F.col(blocked) - own_blocked, F.lit(0.0)) + PRIOR_ROWS * base_rate
        ) / (seen + PRIOR_ROWS)
        rates[f"f_suffix_seen_{labels}"] = F.log1p(seen)
    # Written, so that the join shuffles both sides and splits a hot host.
    wide = wide.join(written(hosts, "url_host_counts"), "host", "left").withColumns(rates)
    names += list(rates)
    assembled = VectorAssembler(inputCols=names, outputCol="_features").transform(wide)
    return assembled.drop(*names, *(c for c in wide.columns if c[:6] in ("_block", "_rows_")))


def word_labels(urls: DataFrame, words: Sequence[str] = BLOCK_WORDS) -> DataFrame:
    """``url, label``: 1 where a part of the host is one of the words, else 0."""
    parts = F.split(host_and_path(F.col("url"))[0], "[.-]")
    bad = F.arrays_overlap(parts, F.array(*map(F.lit, words)))
    return urls.filter("url is not null").select("url", bad.cast("int").alias("label"))


def fit(labelled: DataFrame, sample_rows: int = SAMPLE_ROWS) -> UrlModel:
    """Train on ``url`` and ``label`` (1 to block, 0 to allow; null rows are left out)."""
    usable = labelled.select("url", F.col("label").cast("double").alias("label")).filter(
        "url is not null and label is not null"
    )
    by_label = {row["label"]: row["count"] for row in usable.groupBy("label").count().collect()}
    if len(by_label) < 2:
        return UrlModel(None, [], max(by_label, default=0.0))
    n_rows = sum(by_label.values())
    base_rate = by_label[1.0] / n_rows
    hosts = parsed(usable).groupBy("host").agg(
        F.sum("label").alias("blocked"), F.count("*").alias("n")
    )
    hosts = written(hosts, "url_hosts")
    suffixes = [
        hosts.groupBy(_suffix(labels).alias("_suffix")).agg(
            F.sum("blocked").alias("_blocked"), F.sum("n").cast("double").alias("_rows")
        )
        for labels in SUFFIX_LABELS
    ]
    suffixes = [written(s, "url_suffixes") for s in suffixes]
    # Copies of a url with one label are one row of their number.
    distinct = usable.groupBy("url", "label").agg(F.count("*").cast("double").alias("copies"))
    halves = [
        distinct.filter(F.col("label") == label)
        .orderBy(F.xxhash64("url"), "url")
        .limit(sample_rows // 2)
        for label in (0.0, 1.0)
    ]
    sample = written(parsed(halves[0].union(halves[1])), "url_sample")
    sampled = {r["label"]: r["n"] for r in sample.groupBy("label").agg(F.sum("copies").alias("n")).collect()}
    # Rows of each label weigh as much as in all labelled rows.
    weights = {label: by_label[label] / n_rows / (n / sum(sampled.values())) for label, n in sampled.items()}
    weight = F.col("copies") * F.when(F.col("label") == 1.0, weights[1.0]).otherwise(weights[0.0])
    sample = sample.withColumn("_weight", weight)
    trees = GBTClassifier(
        featuresCol="_features",
        labelCol="label",
        weightCol="_weight",
        maxIter=TREES,
        maxDepth=DEPTH,
        checkpointInterval=-1,
        seed=1,
    ).fit(
        _with_features(
            sample, suffixes, base_rate, F.col("copies") * F.col("label"), F.col("copies")
        )
    )
    return UrlModel(trees, suffixes, base_rate)


def judge(pages: DataFrame, model: UrlModel, rules: Sequence[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, block_score`` of every page's url."""
    urls = parsed(pages.select("page_id", "url"))
    if model.trees is None:
        scored = urls.withColumn("block_score", F.lit(float(model.base_rate)))
    else:
        trees = model.trees.setPredictionCol("_label").setProbabilityCol("_odds")
        scored = trees.setRawPredictionCol("_raw").transform(
            _with_features(urls, model.suffixes, model.base_rate)
        )
        scored = scored.withColumn("block_score", vector_to_array("_odds")[1])
    rule = rule_of(F.col("host"), F.col("path"), rules)
    own = F.when(F.col("block_score") >= 0.5, F.lit(BLOCK)).otherwise(F.lit(ALLOW))
    by_rule = F.lit(None).cast("string")
    for verdict, name in rules:
        by_rule = F.when(F.col("rule") == name, F.lit(verdict)).otherwise(by_rule)
    return scored.withColumn("rule", rule).select(
        "page_id", "host", "path", "rule", F.coalesce(by_rule, own).alias("verdict"), "block_score"
    )
