"""URL verdicts: host and path rules, and gradient-boosted trees on lexical features for what no rule decides.

DataFrame functions and Spark ML only; no Python runs on executors and rows are never shuffled: the rules are a
CASE expression, and what training learned is either a model or a table bounded by ``sample`` rows.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, materialize, read


@dataclass(frozen=True)
class Rule:
    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


RULES = (
    Rule("allow", "com", "/"),
    Rule("block", "example.com", "/en/"),
    Rule("allow", "www.example.com", "/en/"),
    Rule("block", "net", "/es/"),
    Rule("block", "net", "/fr/"),
)
FEATURES = ["u_length", "u_host_length", "u_depth", "u_digit_ratio", "u_entropy", "u_parameters", "u_hyphens", "u_labels", "u_suffix_rate", "u_domain_rate"]


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for a null url or one without '://'."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(u_url, instr(u_url, '://') + 3)"))
    host = F.coalesce(ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 1)), F.lit(""))
    path = F.coalesce(F.regexp_extract(rest, r"^([^/?#]*)([^?#]*)", 2), F.lit(""))
    return host, path


def matched(rules: tuple[Rule, ...], value) -> Column:
    """value(rule) of the longest rule that fits u_host and u_path, else null."""
    found = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), r.name)):
        host = (F.col("u_host") == rule.host) | F.col("u_host").endswith("." + rule.host)
        found = F.when(host & F.col("u_path").startswith(rule.path), F.lit(value(rule))).otherwise(found)
    return found


def lexical(df: DataFrame) -> DataFrame:
    """Adds the features that need one url alone, and the two suffixes of its host."""
    url = F.coalesce(F.col("u_url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1)).cast("double")
    share = lambda c: (F.length(url) - F.length(F.replace(url, c, F.lit("")))) / n
    letters = F.array_distinct(F.filter(F.split(url, ""), lambda c: c != ""))
    entropy = F.aggregate(letters, F.lit(0.0), lambda acc, c: acc - share(c) * F.log2(share(c)))
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    return df.select(
        "*",
        F.length(url).cast("double").alias("u_length"),
        F.length("u_host").cast("double").alias("u_host_length"),
        F.size(F.filter(F.split("u_path", "/"), lambda s: s != "")).cast("double").alias("u_depth"),
        (F.length(F.regexp_replace(url, r"[^0-9]", "")) / n).alias("u_digit_ratio"),
        entropy.alias("u_entropy"),
        F.size(F.filter(F.split(query, "&"), lambda s: s != "")).cast("double").alias("u_parameters"),
        (F.length(url) - F.length(F.replace(url, F.lit("-"), F.lit("")))).cast("double").alias("u_hyphens"),
        F.size(F.split("u_host", r"\.")).cast("double").alias("u_labels"),
        F.element_at(F.split("u_host", r"\."), -1).alias("u_suffix"),
        F.regexp_extract("u_host", r"([^.]*\.[^.]*)$", 1).alias("u_domain"),
    )


PRIOR = 5.0  # urls that a suffix's rate counts as half blocked beside its own


def tallies(sample: DataFrame, key: str) -> DataFrame:
    """Blocked and all sampled urls of each suffix; at most a row for each sampled url."""
    return sample.groupBy(key).agg(F.sum("u_label").alias(key + "_blocked"), F.count("*").alias(key + "_all"))


def with_rates(df: DataFrame, tables: dict[str, DataFrame], learning: bool) -> DataFrame:
    """Adds the smoothed share of blocked urls of both suffixes; for rows that are learned from, of the other rows, or
    a suffix that occurs once would give its own label away."""
    for key, table in tables.items():
        df = df.join(F.broadcast(table), key, "left")  # bounded by the sample
        blocked, every = (F.coalesce(F.col(key + c), F.lit(0.0)) for c in ("_blocked", "_all"))
        own, one = (F.col("u_label"), 1) if learning else (F.lit(0.0), 0)
        df = df.withColumn(key + "_rate", (blocked - own + PRIOR / 2) / (every - one + PRIOR))
    return df


def judge(pages: DataFrame, rules: tuple[Rule, ...] = RULES, sample: int = 20_000, trees: int = 20, depth: int = 4, threshold: float = 0.5) -> DataFrame:
    """page_id, host, path, rule, verdict and p_block for every row of pages(page_id, url).

    Urls that a rule decides are the labelled ones; the trees learn from ``sample`` of them (the bound), taken by
    hash. With fewer than two verdicts among them, the more frequent verdict (allow, if there is none) is used.
    A null url has empty host and path and gets the method's verdict; repeated rows are judged alike.
    """
    spark = pages.sparkSession
    base = pages.select("page_id", F.col("url").alias("u_url"))
    host, path = host_and_path(F.col("u_url"))
    base = base.select("*", host.alias("u_host"), path.alias("u_path"))
    base = base.select("*", matched(rules, lambda r: r.name).alias("rule"), matched(rules, lambda r: r.verdict).alias("u_ruled"))
    rows = lexical(base)

    labelled = rows.where(F.col("rule").isNotNull()).withColumn("u_label", (F.col("u_ruled") == "block").cast("double"))
    picked = materialize(labelled.orderBy(F.xxhash64("u_url"), "u_url").limit(sample).coalesce(1))
    n, blocked = picked.agg(F.count("*"), F.coalesce(F.sum("u_label"), F.lit(0.0))).first()
    if 0 < blocked < n:
        tables = {key: materialize(tallies(picked, key).coalesce(1)) for key in ("u_suffix", "u_domain")}
        vectors = VectorAssembler(inputCols=FEATURES, outputCol="u_features")
        weight = F.when(F.col("u_label") == 1, n / (2 * blocked)).otherwise(n / (2 * (n - blocked)))
        fit = GBTClassifier(labelCol="u_label", featuresCol="u_features", weightCol="u_weight", maxIter=trees, maxDepth=depth, stepSize=0.2, maxBins=32, seed=7)
        model = fit.fit(vectors.transform(with_rates(picked.withColumn("u_weight", weight), tables, True)))
        model.setRawPredictionCol("u_raw").setProbabilityCol("u_probability").setPredictionCol("u_prediction")
        scored = model.transform(vectors.transform(with_rates(rows, tables, False))).withColumn("p_block", vector_to_array("u_probability")[1])
    else:
        scored = rows.withColumn("p_block", F.lit(1.0 if n and blocked == n else 0.0))
    verdict = F.coalesce("u_ruled", F.when(F.col("p_block") >= threshold, "block").otherwise("allow"))
    return scored.select("page_id", F.col("u_host").alias("host"), F.col("u_path").alias("path"), "rule", verdict.alias("verdict"), "p_block")


def op10_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(read(spark, sf_dir, "pages"))
