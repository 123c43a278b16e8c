"""Verdicts on URLs: allow and block rules, and boosted trees where no rule fits.

The trees learn from the URLs that rules decide, on lexical features only. All of
it runs on DataFrame functions and Spark's own tree learner.
"""

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from siftrank.llm.tables import in_share
from siftrank.session import written

# Parts of the sample, by host, whose labels do not tell about themselves.
FOLDS = 4

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FEATURES = (
    "url_length",
    "host_length",
    "host_labels",
    "depth",
    "digit_share",
    "letter_share",
    "entropy",
    "n_parameters",
    "has_fragment",
    "longest_part",
    "suffix_rate",
)


def url_host(url: Column) -> Column:
    return F.translate(F.regexp_extract(url, "://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    return F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def fitting_rule(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict, null if none does.

    A rule is a verdict and a host with a path, ``("block", "net/es/")``.
    """
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for decision, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        name, slash, rest = text.partition("/")
        fits = ((host == name) | F.endswith(host, F.lit("." + name))) & F.startswith(
            path, F.lit(slash + rest)
        )
        rule = F.when(fits, F.lit(text)).otherwise(rule)
        verdict = F.when(fits, F.lit(decision)).otherwise(verdict)
    return rule, verdict


def _entropy(text: Column) -> Column:
    """Bits per character."""
    n = F.length(text)
    parts = F.transform(
        F.array_distinct(F.split(text, "")),
        lambda c: F.when(c != "", (n - F.length(F.replace(text, c, F.lit("")))) / n),
    )
    bits = F.aggregate(
        F.filter(parts, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p)
    )
    return F.when(n > 0, bits).otherwise(0.0)


def _share(text: Column, pattern: str) -> Column:
    n = F.length(text)
    return F.when(n > 0, F.regexp_count(text, F.lit(pattern)) / n).otherwise(0.0)


def lexical_features(urls: DataFrame) -> DataFrame:
    """``urls`` (url, host, path, ...) with the features but for the suffix's rate."""
    url = F.coalesce("url", F.lit(""))
    parts = F.split(F.concat(F.col("host"), F.col("path")), r"[./_-]")
    return urls.select(
        "*",
        F.length(url).cast("double").alias("url_length"),
        F.length("host").cast("double").alias("host_length"),
        F.regexp_count("host", F.lit(r"[^.]+")).cast("double").alias("host_labels"),
        F.regexp_count("path", F.lit(r"[^/]+")).cast("double").alias("depth"),
        _share(url, "[0-9]").alias("digit_share"),
        _share(url, "[A-Za-z]").alias("letter_share"),
        _entropy(url).alias("entropy"),
        F.regexp_count(F.regexp_extract(url, r"\?([^#]*)", 1), F.lit("[^&;]+"))
        .cast("double")
        .alias("n_parameters"),
        F.contains(url, F.lit("#")).cast("double").alias("has_fragment"),
        F.array_max(F.transform(parts, lambda p: F.length(p))).cast("double").alias("longest_part"),
        F.regexp_extract("host", r"([^.]*)$", 1).alias("suffix"),
    )


def _sample(decided: DataFrame, sample_rows: int) -> DataFrame:
    """At most ``sample_rows`` distinct URLs, those of the least hashes, with ``label``.

    A URL counts once, however often it stands there. Few more than are wanted leave
    the scan; which ones does not depend on how the table is split.
    """
    number = F.xxhash64("url")
    distinct = decided.agg(F.approx_count_distinct("url", 0.02)).first()[0]
    # twice the share, because the number of distinct URLs is an estimate
    share = 2 * sample_rows / max(1, distinct)
    few = decided.where(in_share(F.col("url"), share)).select("url", "host", "path", "given")
    few = few.dropDuplicates(["url"]).orderBy(number, "url").limit(sample_rows)
    return lexical_features(few.repartition(FOLDS)).withColumns(
        {
            "label": (F.col("given") == "block").cast("double"),
            "fold": F.pmod(F.xxhash64("host"), F.lit(FOLDS)),
        }
    )


def _suffix_rates(sample: DataFrame, rate: float) -> tuple[DataFrame, DataFrame]:
    """How often URLs of a suffix are blocked: in all, and in the hosts' other folds.

    The trees learn from the latter, so a URL's own label is not among its features.
    """

    def share(blocked: Column, n: Column) -> Column:
        return ((blocked + rate) / (n + 1)).alias("suffix_rate")

    parts = sample.groupBy("suffix", "fold").agg(F.sum("label").alias("b"), F.count("*").alias("n"))
    whole = parts.groupBy("suffix").agg(F.sum("b").alias("all_b"), F.sum("n").alias("all_n"))
    others = parts.join(whole, "suffix").select(
        "suffix", "fold", share(F.col("all_b") - F.col("b"), F.col("all_n") - F.col("n"))
    )
    return whole.select("suffix", share(F.col("all_b"), F.col("all_n"))), others


def judged_urls(
    pages: DataFrame,
    rules: list[tuple[str, str]],
    sample_rows: int = 20_000,
    trees: int = 12,
    depth: int = 3,
    id_col: str = "page_id",
    url_col: str = "url",
) -> DataFrame:
    """``(id_col, host, path, rule, verdict, block_probability)``, a row per row of ``pages``.

    The verdict is that of the longest rule that fits; where none does, ``block``
    if the trees find blocking likelier than not. They are fitted on a sample of
    ``sample_rows`` distinct URLs that rules decide, taken by hash; where these show
    fewer than two verdicts, everything else is allowed.

    Null URLs and those without ``://`` have an empty host and path, which no rule
    fits; the trees judge them too. Rows are judged one by one, so repeated ones
    and null ids do not matter; an empty table gives an empty result. Other columns
    are ignored.
    """
    url = F.col(url_col).cast("string")
    rows = pages.select(
        F.col(id_col).alias("id"),
        url.alias("url"),
        F.coalesce(url_host(url), F.lit("")).alias("host"),
        F.coalesce(url_path(url), F.lit("")).alias("path"),
    )
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    rows = rows.select("*", rule.alias("rule"), verdict.alias("given"))
    sample = written(_sample(rows.where("given IS NOT NULL"), sample_rows), "urls")
    totals = sample.agg(F.count("*").alias("n"), F.sum("label").alias("blocked")).first()
    judged = lexical_features(rows)
    if totals.n and 0 < totals.blocked < totals.n:
        rate = totals.blocked / totals.n
        rates, rates_of_others = _suffix_rates(sample, rate)
        vector = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
        training = vector.transform(sample.join(rates_of_others, ["suffix", "fold"]))
        learner = GBTClassifier(maxIter=trees, maxDepth=depth, seed=1, maxBins=32)
        model = learner.fit(training.select("features", "label"))
        # at most as many suffixes as the sample has rows
        known = F.coalesce("suffix_rate", F.lit(rate)).alias("suffix_rate")
        judged = judged.join(F.broadcast(rates), "suffix", "left").withColumn("suffix_rate", known)
        judged = model.transform(vector.transform(judged))
        probability = F.element_at(vector_to_array("probability"), 2)
    else:
        probability = F.lit(0.0)
    judged = judged.withColumn("block_probability", probability)
    chosen = F.when(F.col("block_probability") > 0.5, F.lit("block")).otherwise(F.lit("allow"))
    return judged.select(
        F.col("id").alias(id_col),
        "host",
        "path",
        "rule",
        F.coalesce("given", chosen).alias("verdict"),
        "block_probability",
    )

