"""Document state, corrections, learned rules and file debouncing as batch jobs; streams call these per micro-batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


# J02
def stable_files(observations: DataFrame, delay: int) -> DataFrame:
    """Runs of equal size per path that last at least ``delay`` seconds: path, size, since when, and when it counted as stable."""
    w = W.partitionBy("path").orderBy("ts", "event_id")
    new = F.when(F.col("size").eqNullSafe(F.lag("size").over(w)) & F.lag("ts").over(w).isNotNull(), 0).otherwise(1)
    runs = observations.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    out = runs.groupBy("path", "run", "size").agg(F.min("ts").alias("since"), F.max("ts").alias("until"))
    return out.where(F.unix_micros(F.col("until").cast("timestamp")) - F.unix_micros(F.col("since").cast("timestamp")) >= delay * 1_000_000)


# J03
def dedupe_by_hash(files: DataFrame, store: DataFrame) -> DataFrame:
    """The first file of each content that the store doesn't hold."""
    first = files.groupBy("file_hash").agg(F.min_by("path", F.struct("ts", "path")).alias("path"), F.min("ts").alias("ts"))
    return first.join(store, "file_hash", "left_anti")


# J05
def upsert_documents(events: DataFrame, state: DataFrame) -> DataFrame:
    """The latest event of each document replaces its state and clears corrections; the audit action tells new from known."""
    last = events.groupBy("document_id").agg(F.max_by(F.struct("payload", "ts"), F.struct("ts", "event_id")).alias("e"))
    out = state.join(last, "document_id", "full_outer")
    return out.select("document_id", F.coalesce("e.payload", "payload").alias("payload"), F.when(F.col("e").isNull(), F.col("corrected")).alias("corrected"), F.when(F.col("e").isNull(), "kept").when(F.col("payload").isNull(), "uploaded_and_processed").otherwise("re_processed").alias("action"))


# J06, L01
def field_diff(old: DataFrame, new: DataFrame, key: str, money: list[str], text: list[str]) -> DataFrame:
    """A row for each changed field: money by more than 0.001, text by inequality."""
    both = old.join(new.select(key, *(F.col(c).alias(f"n_{c}") for c in money + text)), key)
    row = lambda c, hit: F.when(hit, F.struct(F.lit(c).alias("field"), F.col(c).cast("string").alias("old_value"), F.col(f"n_{c}").cast("string").alias("new_value")))
    hits = [row(c, F.abs(F.coalesce(c, F.lit(0)) - F.coalesce(f"n_{c}", F.lit(0))) > F.expr("0.001BD")) for c in money]
    hits += [row(c, ~F.col(c).eqNullSafe(F.col(f"n_{c}"))) for c in text]
    return both.select(key, F.inline(F.array_compact(F.array(*hits))))


def feedback_rows(diffs: DataFrame) -> DataFrame:
    rule = F.when(F.col("field").isin("tax_base", "vat", "total"), "amount_position").when(F.col("field").endswith("eik"), "vendor_identity").otherwise("text_pattern")
    return diffs.withColumn("learned_rule_type", rule)


# J07
def approve(state: DataFrame, approvals: DataFrame) -> DataFrame:
    a = approvals.select("document_id").distinct().withColumn("approved", F.lit(True))
    return state.join(a, "document_id", "left").withColumn("status", F.when(F.col("approved"), "approved").otherwise(F.col("status"))).drop("approved")


# L02
def update_profiles(profiles: DataFrame, feedback: DataFrame) -> DataFrame:
    """Per EIK: the name only if there was none, the latest series, and the union of keywords."""
    f = feedback.groupBy("eik").agg(F.max_by("series", "ts").alias("f_series"), F.max_by("name", "ts").alias("f_name"), F.array_sort(F.collect_set("keyword")).alias("f_keywords"))
    out = profiles.join(f, "eik", "left")
    return out.select("eik", F.when(F.coalesce(F.trim("name"), F.lit("")) == "", F.col("f_name")).otherwise(F.col("name")).alias("name"), F.coalesce("f_series", "series").alias("series"), F.array_join(F.array_sort(F.array_union("keywords", F.coalesce("f_keywords", F.array().cast("array<string>")))), ",").alias("keywords"))


# L04
def edit_rules(rules: DataFrame, edits: DataFrame) -> DataFrame:
    """edits: keyword, priority, account, and op (set or remove)."""
    kept = rules.join(edits.select("keyword"), "keyword", "left_anti")
    return kept.unionByName(edits.where("op = 'set'").select(*kept.columns))
