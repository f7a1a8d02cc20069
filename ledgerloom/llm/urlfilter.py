"""URL verdicts: host and path rules first, else logistic regression on hashed character n-grams.

The classifier learns from a small labelled URL table. ``seed_urls`` is the one of the registered query: hosts of
two words, of which unwanted ones have a word of a trade that fills the web with copies. The rules play no part in it.
"""

from __future__ import annotations

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import ascii_lower

#: The most labelled URLs that the classifier is fitted on.
MAX_LABELLED = 20_000
#: Buckets of the hashed n-grams, and their lengths.
BUCKETS, GRAMS = 1 << 14, (3, 4)
#: (rule, verdict): the part before the first / is a host suffix, the rest starts the path.
RULES = (("com/", "allow"), ("example.com/en/", "block"), ("www.example.com/en/", "allow"), ("net/es/", "block"), ("net/fr/", "block"))


#: Words of the labelled hosts: the trades to block, and ordinary sites.
UNWANTED = (
    "casino", "poker", "jackpot", "betting", "slots", "lottery", "win", "bonus", "pills", "viagra", "cialis", "pharmacy", "diet", "slim", "cheap", "replica",
    "loan", "payday", "credit", "crypto", "forex", "escort", "dating", "adult", "xxx", "warez", "torrent", "crack", "free-gift", "prize",
)
ORDINARY = (
    "news", "daily", "times", "herald", "city", "museum", "library", "school", "college", "science", "history", "garden", "kitchen", "recipes", "travel", "mountain",
    "river", "music", "theatre", "cinema", "sport", "cycling", "weather", "health", "clinic", "law", "council", "archive", "journal", "review", "forum", "wiki",
    "docs", "software", "maps", "photo", "design", "craft", "books", "letters", "parish", "farm", "market", "house", "family", "children", "nature", "animal",
)


def seed_urls(spark: SparkSession) -> DataFrame:
    """url and label (1 block, 0 allow): some 6,000 hosts of two words over the same prefixes, ends and paths for either
    label, so these tell nothing. Words without meaning stand for all that no list names."""
    made = [a + b + c for a in ("ba", "de", "fi", "go", "lu", "ma", "ne", "pi", "ro", "su", "th", "wh") for b in ("l", "nt", "r", "st") for c in ("er", "an", "on", "ing")]
    rows = [(a, b, 1.0) for i, a in enumerate(UNWANTED) for b in UNWANTED[i + 1 :]]
    rows += [pair for a in UNWANTED for i, b in enumerate(ORDINARY) for pair in [((a, b, 1.0), (b, a, 1.0))[i % 2]]]
    rows += [(a, b, 0.0) for i, a in enumerate(ORDINARY) for b in ORDINARY[i + 1 :]]
    rows += [(a, b, 0.0) for i, a in enumerate(made) for b in (*ORDINARY[i % 4 :: 8], *made[(i * 7) % 11 :: 13])]
    heads, ends, paths = ("", "www.", "blog.", "m."), ("com", "net", "org"), ("/en/{}", "/de/{}/", "/fr/{}?page=2", "/es/{}.html", "/")
    urls = [(f"http://{heads[i % 4]}{a}-{b}.example.{ends[i % 3]}{paths[i % 5].format(i * 7919 % 997)}", label) for i, (a, b, label) in enumerate(rows)]
    return spark.createDataFrame(urls, "url string, label double")


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Both empty for null or a url without ://; only A-Z of the host is lower-cased."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"^[^/?#]*(/[^?#]*)?", 1)
    return F.coalesce(ascii_lower(host), F.lit("")), F.coalesce(path, F.lit(""))


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits columns host and path, and its verdict; null where none fits."""
    rule = verdict = F.lit(None).cast("string")
    for text, says in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        host, _, path = text.partition("/")
        fits = ((F.col("host") == host) | F.endswith(F.col("host"), F.lit("." + host))) & F.startswith(F.col("path"), F.lit("/" + path))
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(says)).otherwise(verdict)
    return rule, verdict


def grams(host: Column, path: Column) -> Column:
    """The character n-grams of ^host/path$ as an array of strings."""
    text = F.concat(F.lit("^"), host, F.lit("|"), path, F.lit("$"))
    return F.concat(*(F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i, n=n: F.substr(text, i, F.lit(n))) for n in GRAMS))


def _hashed(df: DataFrame) -> DataFrame:
    return HashingTF(numFeatures=BUCKETS, binary=True, inputCol="grams", outputCol="features").transform(df.withColumn("grams", grams(F.col("host"), F.col("path"))))


def fit(labelled: DataFrame, max_labelled: int = MAX_LABELLED):
    """labelled: host, path, label (1.0 block, 0.0 allow). None if it lacks one of the two labels."""
    few = labelled.select("host", "path", "label").distinct().orderBy(F.xxhash64("host", "path"), "host", "path", "label").limit(max_labelled)
    few = _hashed(few).select("features", "label").coalesce(1).cache()
    try:
        if few.select("label").distinct().count() < 2:
            return None
        return LogisticRegression(maxIter=100, regParam=0.00001, standardization=False, threshold=0.5).fit(few)
    finally:
        few.unpersist()


def op4_url_filters(pages: DataFrame, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, then the method's own block_score for every url.

    labelled: url and label (1 block, 0 allow); without one, ``seed_urls``. Null urls and urls without :// have an empty host and
    path and are judged like others. Where nothing can be learned (no labels of both kinds), the
    method allows. Repeated rows are judged one by one; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    parted = pages.select("page_id", host.alias("host"), path.alias("path"))
    rule, verdict = rule_columns(rules)
    ruled = parted.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"))
    labelled = seed_urls(pages.sparkSession) if labelled is None else labelled
    known = labelled.select(host.alias("host"), path.alias("path"), F.col("label").cast("double").alias("label")).where("label IS NOT NULL")
    model = fit(known)
    if model is None:
        scored = ruled.withColumn("block_score", F.lit(0.0))
    else:
        scored = model.transform(_hashed(ruled)).withColumn("block_score", F.element_at(vector_to_array("probability"), 2))
    method = F.when(F.col("block_score") >= 0.5, "block").otherwise("allow")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("ruled", method).alias("verdict"), F.round("block_score", 6).cast(T.DoubleType()).alias("block_score"))
