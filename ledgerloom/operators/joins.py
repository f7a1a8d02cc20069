"""Joins with master data, registries and rules. Rule tables are broadcast only up to a checked size."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: A table of at most this many rows is broadcast; a larger one is joined by shuffle.
SMALL_ROWS = 200_000


def small(df: DataFrame, rows: int = SMALL_ROWS) -> DataFrame:
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


# A06
def pending_documents(files: DataFrame, store: DataFrame) -> DataFrame:
    return files.join(store, "file_hash", "left_anti")


# D01
def invoices_enriched(invoices: DataFrame, partners: DataFrame) -> DataFrame:
    """Per role the partner with the id, else the one with the EIK in BG: two equi joins each, never an OR join."""
    by_id = partners.select("partner_id", "legal_name", "legal_form")
    by_eik = partners.where("country_code = 'BG'").groupBy("eik").agg(F.min_by(F.struct("legal_name", "legal_form"), "partner_id").alias("p"))
    out = invoices
    for role in ("supplier", "recipient"):
        i = by_id.select(F.col("partner_id").alias(f"{role}_partner_id"), F.struct("legal_name", "legal_form").alias("i"))
        e = by_eik.select(F.col("eik").alias(f"{role}_eik"), F.col("p").alias("e"))
        out = out.join(i, f"{role}_partner_id", "left").join(e, f"{role}_eik", "left")
        p = F.coalesce("i", "e")
        out = out.withColumn(f"{role}_name", F.when(F.contains(p["legal_name"], p["legal_form"]), p["legal_name"]).otherwise(F.concat_ws(" ", p["legal_name"], p["legal_form"]))).drop("i", "e")
    return out


# D06
def vat_registered_on(invoices: DataFrame, registry: DataFrame) -> DataFrame:
    """An interval join by EIK: before, after, registered, or not in the registry."""
    out = invoices.join(registry.withColumnRenamed("eik", "supplier_eik"), "supplier_eik", "left")
    day = F.coalesce("date_tax_event", "date_issued")
    status = F.when(F.col("registered").isNull(), "NOT_REGISTERED").when(day < F.col("registered"), "BEFORE_REGISTRATION").when(day > F.col("deregistered"), "AFTER_DEREGISTRATION").otherwise("REGISTERED")
    return out.select("invoice_id", "supplier_eik", status.alias("vat_status"))


# D07
def resolve_contractors(ids: DataFrame, sources: list[DataFrame], now: Column, ttl_days: int) -> DataFrame:
    """sources: eik, status, seen in order of trust; the first fresh one wins, and what none knows is unverified."""
    every = None
    for rank, s in enumerate(sources):
        s = s.select("eik", "status", "seen", F.lit(rank).alias("rank"))
        every = s if every is None else every.unionByName(s)
    fresh = every.where(F.col("seen").isNull() | (F.datediff(now, "seen") <= ttl_days))
    best = fresh.groupBy("eik").agg(F.min(F.struct("rank", "status")).alias("b"))
    return ids.join(best, "eik", "left").select("eik", F.coalesce("b.status", F.lit("UNVERIFIED")).alias("status"), F.coalesce("b.rank", F.lit(-1)).alias("source"))


# D08, D09
def classify_line_items(items: DataFrame, keyword_rules: DataFrame, supplier_rules: DataFrame, default: str = "304") -> DataFrame:
    """Description rules by priority, then the supplier's rule, then the default. Rules are matched once per distinct description."""
    names = items.select("description").distinct()
    hit = names.join(small(keyword_rules, 10_000), F.contains("description", F.col("keyword")))
    best = hit.groupBy("description").agg(F.min(F.struct((-F.col("priority")).alias("p"), "seq", "account")).alias("k"))
    rules = supplier_rules.select("supplier_id", F.col("account").alias("supplier_account"))
    out = items.join(best, "description", "left").join(rules, "supplier_id", "left")
    return out.select("invoice_id", "line_no", "supplier_id", "description", F.coalesce("k.account", "supplier_account", F.lit(default)).alias("account"), F.when(F.col("k").isNotNull(), "description").when(F.col("supplier_account").isNotNull(), "supplier").otherwise("default").alias("tier"))


# D10
def lookup_accounts(df: DataFrame, accounts: DataFrame) -> DataFrame:
    """By the code without a slash, else by its first three digits."""
    acc = small(accounts.select(F.col("code").alias("k"), "name"))
    exact = F.replace(F.col("account"), F.lit("/"), F.lit(""))
    out = df.withColumn("e", exact).withColumn("p", F.left(exact, F.lit(3)))
    out = out.join(acc.withColumnsRenamed({"k": "e", "name": "n1"}), "e", "left").join(acc.withColumnsRenamed({"k": "p", "name": "n2"}), "p", "left")
    return out.withColumn("account_name", F.coalesce("n1", "n2")).drop("e", "p", "n1", "n2")


# D12
def match_reviewed(orig: DataFrame, reviewed: DataFrame) -> DataFrame:
    """Three tiers (EIK and total, number and total, date and total), totals within a cent; the first reviewed row of the best tier."""
    cents = lambda c: (F.col(c) * 100).cast("long")
    r = reviewed.select(F.col("seq").alias("r_seq"), F.col("eik").alias("r_eik"), F.col("number").alias("r_number"), F.col("day").alias("r_day"), cents("total").alias("cents"), F.col("account").alias("reviewed_account"))
    o = orig.withColumn("cents", cents("total"))
    pairs = None
    for tier, (a, b) in enumerate((("eik", "r_eik"), ("number", "r_number"), ("day", "r_day"))):
        p = o.join(r.withColumnRenamed(b, a), [a, "cents"]).select("seq", F.lit(tier).alias("tier"), "r_seq", "reviewed_account")
        pairs = p if pairs is None else pairs.unionByName(p)
    best = pairs.groupBy("seq").agg(F.min(F.struct("tier", "r_seq", "reviewed_account")).alias("b"))
    return orig.join(best, "seq", "left").select(*orig.columns, F.when(F.col("b").isNotNull(), F.element_at(F.array(F.lit("eik"), F.lit("number"), F.lit("day")), F.col("b.tier") + 1)).alias("tier"), F.col("b.r_seq").alias("reviewed_seq"), F.col("b.reviewed_account").alias("reviewed_account"))


# D16, G02
def accounts_not_in_chart(ledger: DataFrame, accounts: DataFrame) -> DataFrame:
    used = ledger.select("account").distinct()
    return used.where(~F.startswith("account", F.lit("453"))).join(accounts.select(F.col("code").alias("account")), "account", "left_anti")


def account_overlap(a: DataFrame, b: DataFrame) -> DataFrame:
    x, y = a.select("account").distinct(), b.select("account").distinct()
    return x.intersect(y).withColumn("side", F.lit("both")).unionByName(x.subtract(y).withColumn("side", F.lit("a"))).unionByName(y.subtract(x).withColumn("side", F.lit("b")))


# D15
def assign_columns(tokens: DataFrame, columns: DataFrame) -> DataFrame:
    """Each token to the column that holds its centre, else the one it overlaps most, else the nearest; joined in reading order."""
    mid = F.col("left") + F.col("width") / 2
    both = tokens.join(small(columns), "page_kind")
    over = F.least(F.col("left") + F.col("width"), F.col("x_right")) - F.greatest("left", "x_left")
    tier = F.when(mid.between(F.col("x_left"), F.col("x_right")), 0).when(over > 0, 1).otherwise(2)
    cost = F.when(tier == 1, -over).otherwise(F.abs(mid - (F.col("x_left") + F.col("x_right")) / 2))
    best = both.groupBy("doc_id", "page", "top", "i", "text").agg(F.min(F.struct(tier.alias("t"), cost.alias("c"), "semantic_type")).alias("b"))
    cell = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]), " ")
    return best.groupBy("doc_id", "page", "top", F.col("b.semantic_type").alias("semantic_type")).agg(cell.alias("cell"))


# G03, G04
def first_by_rank(df: DataFrame, key: str, rank: list[Column]) -> DataFrame:
    """One row per key, the first by ``rank``."""
    return df.withColumn("__r", F.row_number().over(W.partitionBy(key).orderBy(*rank))).where("__r = 1").drop("__r")


# K09, K10, K11
def upsert(new: DataFrame, base: DataFrame, keys: list[str], update: list[str]) -> DataFrame:
    """Rows of ``base`` with ``update`` columns taken from ``new`` where the key is there, and new rows added. Keys are unique in both."""
    n = new.select(*keys, *(F.col(c).alias(f"__{c}") for c in new.columns if c not in keys), F.lit(True).alias("__new"))
    b = base.withColumn("__old", F.lit(True))
    out = b.join(n, keys, "full_outer")
    pick = [F.when(F.col("__new").isNotNull() & ((F.col("__old").isNull()) | F.lit(c in update)), F.col(f"__{c}")).otherwise(F.col(c)).alias(c) if f"__{c}" in n.columns else F.col(c) for c in base.columns if c not in keys]
    return out.select(*keys, *pick)


def replace_children(items: DataFrame, base: DataFrame, key: str) -> DataFrame:
    return base.join(items.select(key).distinct(), key, "left_anti").unionByName(items)
