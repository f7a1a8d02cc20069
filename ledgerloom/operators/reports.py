"""Reports: counts and sums over documents, tokens, feedback and logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .ledgers import number_operations

MONEY = "decimal(18,2)"


def _sum(c: str | Column) -> Column:
    return F.coalesce(F.sum(c), F.lit(0)).cast(MONEY)


# E01
def batch_summary(docs: DataFrame) -> DataFrame:
    """docs: ok, valid, n_lines."""
    rate = F.round(F.try_divide(F.count_if("valid").cast("decimal(18,0)") * 100, F.count("*").cast("decimal(18,0)")), 2).cast("decimal(5,2)")
    return docs.agg(F.count("*").alias("total"), F.count_if("ok").alias("ok"), F.count_if(~F.col("ok")).alias("failed"), F.count_if("valid").alias("valid"), F.count_if(~F.col("valid")).alias("invalid"), rate.alias("pass_rate"), F.coalesce(F.sum("n_lines"), F.lit(0)).alias("items"))


# E02
def totals_by_currency(docs: DataFrame) -> DataFrame:
    return docs.groupBy(F.coalesce("currency", F.lit("UNKNOWN")).alias("currency")).agg(F.count("*").alias("n"), _sum("tax_base").alias("tax_base"), _sum("vat").alias("vat"), _sum("total").alias("total"))


# E03
def supplier_totals(docs: DataFrame) -> DataFrame:
    """Per supplier the number of invoices, and its sums by currency as a map."""
    per = docs.groupBy("supplier_eik", F.coalesce("currency", F.lit("UNKNOWN")).alias("currency")).agg(F.count("*").alias("n"), _sum("total").alias("total"))
    return per.groupBy("supplier_eik").agg(F.sum("n").alias("n_invoices"), F.array_sort(F.collect_list(F.struct("currency", F.col("total").cast("string").alias("total")))).alias("by_currency"))


# E04
def issue_frequency(issues: DataFrame) -> DataFrame:
    return issues.groupBy("code", "severity").agg(F.count("*").alias("n"))


# E05
def doc_type_counts(docs: DataFrame) -> DataFrame:
    return docs.groupBy("doc_type").agg(F.count("*").alias("n"))


# E06
def extraction_coverage(docs: DataFrame) -> DataFrame:
    return docs.agg(F.count("*").alias("n"), *(F.count(c).alias(f"has_{c}") for c in ("supplier_eik", "first_item", "total", "currency")))


# E07
def supplier_listing(docs: DataFrame) -> DataFrame:
    listed = F.transform(F.array_sort(F.collect_list("invoice_id")), lambda x: x.cast("string"))
    return docs.groupBy(F.coalesce("supplier_eik", F.lit("Unknown")).alias("supplier")).agg(F.count("*").alias("n"), _sum("total").alias("total"), F.array_join(listed, ",").alias("invoices"))


# E08, E09
def profiles(ledger: DataFrame, key: str, seq: str, name: str, reason: str, amount: str, top: int = 5) -> DataFrame:
    """Per partner: count, turnover, most frequent name and reason (ties: first seen), the ``top`` reasons and first samples."""

    def ranked(c: str) -> DataFrame:
        per = ledger.groupBy(key, c).agg(F.count("*").alias("n"), F.min(seq).alias("first"))
        return per.withColumn("rank", F.row_number().over(W.partitionBy(key).orderBy(F.desc("n"), "first")))

    base = ledger.groupBy(key).agg(F.count("*").alias("n"), _sum(amount).alias("turnover"), F.count_if("is_credit_note").alias("n_credit_notes"))
    names = ranked(name).where("rank = 1").select(key, F.col(name).alias("top_name"))
    reasons = ranked(reason).where(F.col("rank") <= top).groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rank", reason))), lambda x: x[reason]), "|").alias("top_reasons"))
    samples = ledger.withColumn("at", F.row_number().over(W.partitionBy(key).orderBy(seq))).where("at <= 5").groupBy(key).agg(F.array_join(F.transform(F.array_sort(F.collect_list(seq)), lambda x: x.cast("string")), ",").alias("samples"))
    return base.join(names, key).join(reasons, key).join(samples, key)


# E19
def feedback_stats(feedback: DataFrame) -> DataFrame:
    """Per field the corrections and vendors; a row with a null field is the whole."""
    return feedback.rollup("field_name").agg(F.count("*").alias("n"), F.count_distinct("vendor").alias("n_vendors"), F.max("created_at").alias("newest"))


# E20
def correction_report(matched: DataFrame) -> DataFrame:
    """matched: seq, eik, account, reviewed_account, reason. Per partner the first correction and how many there are."""
    wrong = F.col("account") != F.col("reviewed_account")
    out = matched.groupBy("eik").agg(F.count("*").alias("compared"), F.count_if(~wrong).alias("exact"), F.count_if(wrong).alias("corrected"), F.min_by(F.when(wrong, F.col("reviewed_account")), F.when(wrong, F.col("seq"))).alias("learned_account"), F.min_by(F.when(wrong, F.col("reason")), F.when(wrong, F.col("seq"))).alias("r"))
    return out.withColumn("learned_reason", F.when(F.col("corrected") > 0, F.coalesce("r", F.lit("м-ли")))).drop("r")


# E21
def client_dossier(ops: DataFrame, top: int = 10) -> DataFrame:
    """Per client its suppliers by turnover, the ``top`` ones, with their accounts."""
    per = ops.groupBy("client", "supplier_eik").agg(F.count("*").alias("n"), _sum("total").alias("turnover"), F.array_join(F.array_sort(F.collect_set("account")), ",").alias("accounts"))
    rank = F.row_number().over(W.partitionBy("client").orderBy(F.desc("turnover"), "supplier_eik"))
    return per.withColumn("rank", rank).where(F.col("rank") <= top)


# E22
def transfer_batch_totals(docs: DataFrame, limit: int = 150) -> DataFrame:
    """Batches of ``limit`` valid documents each, in order of invoice_id."""
    placed = number_operations(docs.where("tax_base IS NOT NULL"), 0)
    return placed.groupBy(F.expr(f"kon_id div {limit}").alias("batch")).agg(F.count("*").alias("n"), _sum("tax_base").alias("tax_base"), _sum("vat").alias("vat"), _sum("total").alias("total"), F.array_join(F.transform(F.array_sort(F.collect_list("invoice_id")), lambda x: x.cast("string")), ",").alias("numbers"))


# E23, E24
def ocr_evidence(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("doc_id").agg(F.count("*").alias("n_tokens"), F.count_distinct("page").alias("n_pages"), F.sum("conf").alias("conf_sum"), F.count_if(F.col("conf") < 60).alias("n_low"))


def ocr_confidence(tokens: DataFrame) -> DataFrame:
    """Mean of the positive confidences as a fraction, and the share of those under 60, in two places."""
    pos, low = F.col("conf") > 0, F.col("conf").between(1, 59)
    n = F.count_if(pos).cast("decimal(18,0)")
    mean = F.try_divide(F.sum(F.when(pos, F.col("conf"))).cast("decimal(18,0)"), n * 100)
    return tokens.groupBy("doc_id").agg(F.coalesce(F.round(mean, 2), F.lit(0)).cast("decimal(5,2)").alias("confidence"), F.coalesce(F.round(F.try_divide(F.count_if(low).cast("decimal(18,0)"), n), 2), F.lit(0)).cast("decimal(5,2)").alias("low_ratio"))


# E25
#: Words of a page's heading and sums.
PAGE_WORDS = ("фактура", "invoice", "доставчик", "получател", "данъчна основа", "ддс", "общо")


def pass_score(tokens: DataFrame) -> DataFrame:
    """Score of each pass of a page (tokens without confidence don't count in the means); the best pass is marked. The weights.

    A page's text is its tokens in order of ``i``, with a blank between.
    """
    pos = F.col("conf") > 0
    text = F.lower(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " "))
    per = tokens.groupBy("doc_id", "page", "pass").agg(F.avg(F.when(pos, F.col("conf"))).alias("mean"), F.avg(F.when(pos, (F.col("conf") >= 80).cast("int"))).alias("share"), F.sum(F.length("text")).alias("chars"), text.alias("t"))
    points = lambda p, n: F.when(F.col("t").rlike(p), n).otherwise(0)
    bonus = points(r"[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}", 3) + points("[0-9]{3,}", 2) + points("|".join(PAGE_WORDS), 5)
    score = F.round(0.4 * F.col("mean") + 30 * F.col("share") + 0.2 * F.least(F.col("chars") / 10, F.lit(50)) + bonus, 4)
    per = per.select("doc_id", "page", "pass", F.when(F.col("mean").isNull(), 0.0).otherwise(score).alias("score"))
    w = W.partitionBy("doc_id", "page").orderBy(F.desc("score"), "pass")
    return per.withColumn("best", F.row_number().over(w) == 1)


# E29
def delivery_stats(logs: DataFrame) -> DataFrame:
    return logs.groupBy("target").agg(F.count("*").alias("deliveries"), F.count_if("success").alias("successes"), F.sum("attempts").alias("attempts"), F.max_by("event_id", F.struct("ts", "event_id")).alias("latest"))


# E30
def partner_sync_report(responses: DataFrame) -> DataFrame:
    what = F.when(F.col("code") == 200, "synced").when(F.col("code") == 404, "not_found").when(F.col("code") == 400, "invalid").otherwise("failed")
    return responses.groupBy(what.alias("outcome")).agg(F.count("*").alias("n"))


# F01
def sequence_gaps(numbers: DataFrame, group: str, key: str) -> DataFrame:
    """Of each group the numbers missing in 1..n (n: how many different ones it has) as runs from, to; and its n, min and max.

    A group without a gap has one row, with nulls for the run. No list of numbers is made, whatever n is.
    """
    all_, part = numbers.select(group, F.col(key).cast("long").alias("k")).distinct(), W.partitionBy(group)
    own = all_.groupBy(group).agg(F.count("*").alias("n"), F.min("k").alias("min"), F.max("k").alias("max"))
    ends = own.select(group, F.explode(F.array(F.lit(0).cast("long"), F.col("n") + 1)).alias("k"))
    inside = all_.join(own.select(group, "n"), group).where("k BETWEEN 1 AND n").select(group, "k").unionByName(ends)
    runs = inside.withColumn("next", F.lead("k").over(part.orderBy("k"))).where(F.col("next") > F.col("k") + 1)
    runs = runs.select(group, (F.col("k") + 1).alias("gap_from"), (F.col("next") - 1).alias("gap_to"), (F.col("next") - F.col("k") - 1).alias("n_missing"))
    return own.join(runs, group, "left")


# F02
def subdocuments(pages: DataFrame) -> DataFrame:
    """Runs of one category in page order; the run's confidence is its highest."""
    w = W.partitionBy("doc").orderBy("page")
    new = F.when(F.col("category").eqNullSafe(F.lag("category").over(w)) & F.lag("page").over(w).isNotNull(), 0).otherwise(1)
    runs = pages.withColumn("new", new).withColumn("run", F.sum("new").over(w))
    return runs.groupBy("doc", "run", "category").agg(F.min("page").alias("first_page"), F.max("page").alias("last_page"), F.max("confidence").alias("confidence"))


# F15, F16
def latest_feedback(feedback: DataFrame, per_vendor: int = 20) -> DataFrame:
    w = W.partitionBy("vendor").orderBy(F.desc("created_at"), F.desc("feedback_id"))
    return feedback.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= per_vendor)


def audit_history(audit: DataFrame) -> DataFrame:
    """Each entry with its place in its document's history and the action before it."""
    w = W.partitionBy("document_id").orderBy("ts", "event_id")
    return audit.select("document_id", "event_id", "action", F.row_number().over(w).alias("place"), F.lag("action").over(w).alias("previous"))


# F17, F18
def search_accounts(accounts: DataFrame, query: str, limit: int = 10) -> DataFrame:
    """Score by word: 100 the code, 50 starts the code, 30 in the name, 10 in the group; catalogue order on ties."""
    score = F.lit(0)
    for word in query.lower().split():
        score = score + F.when(F.col("code") == word, 100).when(F.startswith("code", F.lit(word)), 50).when(F.contains(F.lower("name"), F.lit(word)), 30).when(F.contains(F.lower("grp"), F.lit(word)), 10).otherwise(0)
    return accounts.withColumn("score", score).where("score > 0").orderBy(F.desc("score"), "seq").limit(limit)


def list_accounts(accounts: DataFrame, grp: str) -> DataFrame:
    return accounts.where(F.col("grp") == grp).select("code", F.format_string("%s - %s (%s)", "code", "name", "grp").alias("text"))
