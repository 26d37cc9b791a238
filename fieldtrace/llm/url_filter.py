"""URL filter: rules on hosts and paths first, gradient-boosted trees on lexical features for the URLs no rule fits.

The labelled URLs are those that a rule decides. Features are column functions of the URL: lengths, depth, digit ratio,
character entropy, parameter counts, labels of the host, and how often URLs of the same domain suffix are blocked among
all labelled ones. The trees are Spark ML's; they are fitted on about ``most_training`` distinct labelled URLs at most, chosen
by hash and weighted by their rows, and every URL is judged.

Defined cases: a null url or one without ``://`` has an empty host and path, fits no rule and is judged by the trees; where
the labelled URLs have one verdict only, all others get it, and without any labelled URL they are allowed; repeated rows get
equal results; an empty table gives an empty result; extra columns are passed on, and those named like an output are
replaced.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtrace.llm.common import join_small, let, lower_ascii, query, stage
from fieldtrace.session import configure

RULES = (("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/"))
#: Labelled URLs that the trees are fitted on, about.
TRAINING = 20_000
TREES, DEPTH = 20, 4


def with_parts(pages: DataFrame, url_col: str = "url") -> DataFrame:
    """``pages`` with host and path."""
    url = F.coalesce(F.col(url_col), F.lit(""))
    rest = F.substring(url, F.locate("://", url) + 3, F.length(url))
    known = F.contains(url, F.lit("://"))
    return pages.withColumns({
        "host": F.when(known, lower_ascii(F.regexp_extract(rest, r"^[^/?#]*", 0))).otherwise(""),
        "path": F.when(known, F.regexp_extract(rest, r"(?s)^[^/?#]*([^?#]*)", 1)).otherwise("")})


def with_rules(parts: DataFrame, rules=RULES) -> DataFrame:
    """``rule`` and ``rule_verdict``: the longest rule whose host is the URL's or a parent of it and whose path starts the URL's."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for what, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):  # later ones are longer and win
        host, slash, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit(slash + path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(what)).otherwise(verdict)
    return parts.withColumns({"rule": rule, "rule_verdict": verdict})


def _count(text: Column, what: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


def _entropy(text: Column) -> Column:
    def sum_up(t):
        n = F.length(t).cast("double")
        shares = F.transform(F.array_distinct(F.split(t, "")), lambda c: (F.length(t) - F.length(F.replace(t, c, F.lit("")))) / n)
        return F.aggregate(shares, F.lit(0.0), lambda a, p: a - F.when(p > 0, p * F.log2(p)).otherwise(0.0))
    return F.when(F.length(text) > 0, let(text, sum_up)).otherwise(0.0)


def with_features(parts: DataFrame, url_col: str = "url") -> tuple[DataFrame, list[str]]:
    url = F.coalesce(F.col(url_col), F.lit(""))
    asked = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.length(url) - F.length(F.regexp_replace(url, "[0-9]", ""))
    features = {
        "length": F.length(url), "host_length": F.length("host"), "path_length": F.length("path"), "depth": _count(F.col("path"), "/"),
        "digit_ratio": digits / F.greatest(F.length(url), F.lit(1)), "entropy": _entropy(url),
        "parameters": F.when(F.length(asked) > 0, _count(asked, "&") + 1).otherwise(0), "values": _count(asked, "="),
        "labels": F.when(F.length("host") > 0, _count(F.col("host"), ".") + 1).otherwise(0), "hyphens": _count(F.col("host"), "-"),
        "fragment": F.contains(url, F.lit("#")).cast("int"), "secure": F.startswith(F.lower(url), F.lit("https:")).cast("int"),
        "escapes": _count(url, "%"),
    }
    added = parts.withColumns({f"__f_{k}": v.cast("double") for k, v in features.items()})
    added = added.withColumn("__suffix", F.substring_index("host", ".", -1)).withColumn("__domain", F.substring_index("host", ".", -2))
    return added, [f"__f_{k}" for k in features]


def _suffix_share(labelled: DataFrame, level: str, share: float) -> DataFrame:
    """Share of blocked URLs of a suffix, drawn towards the overall share."""
    return labelled.groupBy(level).agg(((F.sum("label") + 5 * share) / (F.count(F.lit(1)) + 5)).alias(f"__share{level}"))


def url_filter(pages: DataFrame, url_col: str = "url", rules=RULES, most_training: int = TRAINING) -> DataFrame:
    """``pages`` with host, path, rule and verdict."""
    configure(pages.sparkSession)
    judged, names = with_features(with_rules(with_parts(pages.drop("host", "path", "rule", "rule_verdict", "verdict", "label"), url_col), rules), url_col)
    labelled = judged.where("rule_verdict is not null").withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
    n, blocked = labelled.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if blocked in (0.0, float(n)):
        return _finish(judged, pages, F.lit("block" if n and blocked else "allow"))
    part = min(1.0, most_training / labelled.agg(F.count_distinct(F.xxhash64(url_col))).first()[0])
    sample = labelled.where(F.pmod(F.xxhash64(F.col(url_col), F.lit("sample")), F.lit(1 << 20)) < int(part * (1 << 20)))
    sample = sample.groupBy(url_col).agg(*[F.first(c).alias(c) for c in (*names, "__suffix", "__domain", "label")], F.count(F.lit(1)).cast("double").alias("__rows"))
    shares = {level: stage(_suffix_share(labelled, level, blocked / n), "shares") for level in ("__suffix", "__domain")}

    def known(df):
        for level, table in shares.items():
            df = join_small(df, table, level, "left").withColumn(f"__share{level}", F.coalesce(f"__share{level}", F.lit(blocked / n)))
        return df

    to_vector = VectorAssembler(inputCols=[*names, "__share__suffix", "__share__domain"], outputCol="__features")
    trees = GBTClassifier(featuresCol="__features", labelCol="label", weightCol="__rows", predictionCol="__blocked", maxIter=TREES, maxDepth=DEPTH,
                          stepSize=0.2, seed=7).setRawPredictionCol("__raw").setProbabilityCol("__odds")
    model = trees.fit(to_vector.transform(known(sample)))
    return _finish(model.transform(to_vector.transform(known(judged))), pages, F.when(F.col("__blocked") == 1, "block").otherwise("allow"))


def _finish(df: DataFrame, pages: DataFrame, otherwise: Column) -> DataFrame:
    out = df.withColumn("verdict", F.coalesce("rule_verdict", otherwise))
    return out.select(*[c for c in pages.columns if c not in ("host", "path", "rule", "verdict", "rule_verdict", "label")], "host", "path", "rule", "verdict")


@query("op4_url_filter")
def op4_url_filter(spark, folder):
    pages = spark.read.parquet(f"{folder}/pages.parquet").select("page_id", "url")
    return url_filter(pages).drop("url")
