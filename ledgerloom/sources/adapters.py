"""The invoice tables, made from the test tables; each is a plain projection or one join and aggregate."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def eik_of(key):
    """Nine digits for a key; keys that end in 7 get a wrong check digit."""
    base = F.lpad((F.lit(10000000) + key).cast("string"), 8, "0")
    digit = S.check_digit9(base)
    return F.concat(base, F.when(key % 10 == 7, (digit + 1) % 10).otherwise(digit).cast("string"))


def invoice_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """invoice_id, line_no, supplier_id, description, quantity, unit_price, net, vat_rate, vat."""
    part = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("description"))
    li = table(spark, sf_dir, "lineitem").join(part, F.col("l_partkey") == F.col("p_partkey"))
    tax = F.col("l_tax").cast("decimal(4,2)")
    out = li.select(
        F.col("l_orderkey").alias("invoice_id"),
        F.col("l_linenumber").alias("line_no"),
        F.col("l_suppkey").alias("supplier_id"),
        "description",
        F.col("l_quantity").cast("decimal(18,3)").alias("quantity"),
        F.col("l_extendedprice").cast("decimal(18,2)").alias("list_price"),
        F.round(F.col("l_extendedprice").cast("decimal(18,2)") * (F.lit(1) - F.col("l_discount").cast("decimal(4,2)")), 2).cast("decimal(18,2)").alias("net"),
        F.when(tax == 0, 0).when(tax >= F.expr("0.06BD"), 9).otherwise(20).alias("vat_rate"),
    )
    return out.withColumn("vat", F.round(F.col("net") * F.col("vat_rate").cast("decimal(4,2)") * F.expr("0.01BD"), 2).cast("decimal(18,2)"))


def invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per order: parties, dates, period, currency, base, VAT, totals and flags."""
    lines = invoice_lines(spark, sf_dir)
    first = F.struct("line_no", "supplier_id", "description")  # line numbers may repeat
    sums = lines.groupBy("invoice_id").agg(
        F.sum("net").cast("decimal(18,2)").alias("tax_base"), F.sum("vat").cast("decimal(18,2)").alias("vat"), F.count("*").alias("n_lines"),
        F.min_by("supplier_id", first).alias("supplier_id"), F.min_by("description", first).alias("first_item"),
        F.sum(F.when(F.col("vat_rate") == 9, F.col("net")).otherwise(0)).cast("decimal(18,2)").alias("base_9"), F.sum(F.when(F.col("vat_rate") == 0, F.col("net")).otherwise(0)).cast("decimal(18,2)").alias("base_0"),
        F.max("vat_rate").alias("max_rate"), F.max(F.col("vat_rate") == 9).alias("has_9"),
    )
    o = table(spark, sf_dir, "orders").join(sums, F.col("o_orderkey") == F.col("invoice_id"), "left")
    key, issued = F.col("o_orderkey"), F.add_months(F.col("o_orderdate").cast("date"), 324)
    currency = F.when(key % 3 == 0, "EUR").when(key % 3 == 1, "BGN")
    return o.select(
        key.alias("invoice_id"), "supplier_id", F.col("o_custkey").alias("recipient_id"), issued.alias("date_issued"), F.add_months(issued, -(key % 15).cast("int")).alias("date_tax_event"),
        F.date_format(issued, "yyyyMM").alias("period"), "tax_base", "vat", (F.col("tax_base") + F.col("vat")).cast("decimal(18,2)").alias("total"), F.col("o_totalprice").cast("decimal(18,2)").alias("printed_total"),
        currency.alias("currency"), (F.col("o_orderstatus") == "P").alias("is_credit_note"), (F.col("o_custkey") % 5 == 0).alias("is_sale"),
        F.when(F.substring("o_orderpriority", 1, 1).isin("1", "2"), "CASH").otherwise("BANK").alias("payment_method"), "n_lines", "first_item", "base_9", "base_0", "max_rate", "has_9",
        eik_of(F.col("supplier_id")).alias("supplier_eik"), eik_of(F.col("o_custkey") + 5000000).alias("recipient_eik"),
    )


def vat_invoices(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the VAT books need: names, VAT numbers, texts, kinds, line rates, and foreign currencies with and without a total in leva."""
    key = F.col("invoice_id")
    supplier = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("supplier_id"), F.col("s_name").alias("supplier_name"), "s_nationkey")
    customer = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("recipient_id"), F.col("c_name").alias("recipient_name"))
    inv = invoices(spark, sf_dir).join(supplier, "supplier_id", "left").join(customer, "recipient_id", "left")
    country = F.when(F.col("s_nationkey") == 6, "FR").when(F.col("s_nationkey") == 7, "DE").when(F.col("s_nationkey") == 19, "RO").when(F.col("s_nationkey") == 23, "GB").otherwise("BG")
    return inv.select(
        "invoice_id", "period", "date_issued", "tax_base", "vat", "total", "is_credit_note", "is_sale", "supplier_eik", "recipient_eik", "supplier_name", "recipient_name", "payment_method",
        F.when(key % 53 == 0, "USD").otherwise(S.default_currency(F.col("currency"), F.col("date_issued"))).alias("currency"),
        F.when(key % 106 == 0, F.round(F.col("total") * F.expr("1.8BD"), 2)).when(key % 59 == 0, S.eur_to_bgn(F.col("total")) + F.expr("0.01BD")).cast("decimal(18,2)").alias("total_bgn"),
        F.concat(country, "supplier_eik").alias("supplier_vat"), F.concat("first_item", F.when(key % 10 == 3, " (ВОП)").when(key % 41 == 0, " reverse charge").otherwise("")).alias("note"),
        F.when(F.col("is_sale") & (key % 97 == 0), "FISCAL_MEMORY_REPORT").when(key % 89 == 0, "GOODS_RECEIPT").when(~F.col("is_sale") & (key % 83 == 0), "CUSTOMS_DECLARATION").otherwise("INVOICE").alias("doc_kind"),
        F.array_compact(F.array(F.col("max_rate"), F.when(F.col("has_9"), F.lit(9)))).alias("vat_rates"),
    )


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What validation reads: an invoice's header as it was read, faults included, and the sums of its own lines."""
    k = F.col("invoice_id")
    every = lambda n, odd, c: F.when(k % n == 0, odd).otherwise(c)
    known = ~((F.col("line_no") == 3) & (k % 8 == 0))  # a total that could not be read
    items = invoice_lines(spark, sf_dir).groupBy("invoice_id").agg(F.sum(F.when(known, F.col("net"))).cast("decimal(18,2)").alias("items_total"), F.count("*").alias("n_items"), F.count_if(known).alias("n_with_total"))
    inv = vat_invoices(spark, sf_dir).join(items, "invoice_id", "left")
    cur = F.col("currency")
    return inv.select(
        "invoice_id", "doc_kind", "is_credit_note", (k % 43 == 0).alias("is_debit_note"), every(71, F.col("supplier_eik"), every(73, F.lit(""), k.cast("string"))).alias("number"),
        F.when(k % 61 != 0, F.col("supplier_name")).alias("supplier_name"), every(67, F.lit("12345"), F.col("supplier_eik")).alias("supplier_eik"), "recipient_name", every(79, F.col("supplier_eik"), F.col("recipient_eik")).alias("recipient_eik"),
        "supplier_vat", F.when(k % 5 != 0, F.concat(F.lit("BG"), "recipient_eik")).alias("recipient_vat"), F.when(k % 4 == 0, F.concat(F.lit("R"), k)).alias("reference"),
        every(47, F.lit("31.12.2025"), every(59, F.lit("2026-02-30"), F.col("date_issued").cast("string"))).alias("date_issued"), F.add_months("date_issued", 1).cast("string").alias("date_tax_event"), F.when(k % 37 == 0, "2027-13-01").alias("due_date"),
        (F.col("tax_base") + F.when(k % 9 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("tax_base"), "vat", every(101, F.lit(0), F.col("total") + F.when(k % 6 == 0, F.expr("0.05BD")).otherwise(0)).cast("decimal(18,2)").alias("total"),
        "items_total", F.coalesce("n_items", F.lit(0)).alias("n_items"), F.coalesce("n_with_total", F.lit(0)).alias("n_with_total"), cur.alias("currency"), cur.alias("base_currency"), cur.alias("vat_currency"), every(29, F.lit("USD"), cur).alias("total_currency"),
        F.when(k % 3 == 0, F.array(F.lit("EUR"), F.lit("BGN"))).alias("found_currencies"), F.when(k % 7 == 0, F.col("total")).cast("decimal(18,2)").alias("total_eur"), F.when(k % 7 == 0, S.eur_to_bgn(F.col("total")) + F.when(k % 14 == 0, 1).otherwise(0)).cast("decimal(18,2)").alias("total_bgn"),
        ((k % 100) / 100.0).alias("confidence"), (k % 13 == 0).alias("has_discount"), (k % 17 == 0).alias("is_recap"),
        F.when(k % 4 == 0, "сто лева").when(k % 4 == 1, "сто евро").when(k % 4 == 3, "сто евро; равностойност сто лева").alias("amount_words"),
    )


def partners(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers and customers as master data; the partner_id of customers starts at 5,000,000."""
    s = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("partner_id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance"), F.col("s_nationkey").alias("nation_id"))
    c = table(spark, sf_dir, "customer").select((F.col("c_custkey") + 5000000).alias("partner_id"), F.col("c_name").alias("name"), F.col("c_acctbal").alias("balance"), F.col("c_nationkey").alias("nation_id"))
    form = F.element_at(F.array(*(F.lit(x) for x in ("ООД", "ЕООД", "АД", "ЕТ"))), (F.col("partner_id") % 4 + 1).cast("int"))
    return s.unionByName(c).select("partner_id", eik_of(F.col("partner_id")).alias("eik"), F.lit("BG").alias("country_code"), F.upper("name").alias("legal_name"), form.alias("legal_form"), F.array(F.replace("name", F.lit("#"), F.lit(""))).alias("aliases"), "nation_id", F.col("balance").cast("decimal(18,2)").alias("balance"))


def vat_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("s_suppkey")
    start = F.date_add(F.lit("2022-01-01").cast("date"), (key % 900).cast("int"))
    return table(spark, sf_dir, "supplier").select(eik_of(key).alias("eik"), start.alias("registered"), F.when(key % 4 == 0, F.date_add(start, 1200)).alias("deregistered"))


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of documents laid out on pages of 240 words."""
    d = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.array_remove(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), "")).alias("i", "text"))
    i = F.col("i")
    return d.select(
        "doc_id", "i", "text", F.expr("i div 240 + 1").cast("int").alias("page"), ((i % 12) * 180).alias("left"), (F.expr("(i % 240) div 12").cast("int") * 40 + i % 3).alias("top"),
        (F.length("text") * 12).alias("width"), F.lit(24).alias("height"), ((i.cast("long") * 37 + F.col("doc_id")) % 101).cast("int").alias("conf"),
    )


#: The same tables as DuckDB common table expressions.
_DIGIT = "(CASE WHEN ({w1}) % 11 < 10 THEN ({w1}) % 11 WHEN ({w2}) % 11 < 10 THEN ({w2}) % 11 ELSE 0 END)"


def duck_digit(base: str) -> str:
    w1 = " + ".join(f"{i + 1} * substr({base}, {i + 1}, 1)::INT" for i in range(8))
    w2 = " + ".join(f"{i + 3} * substr({base}, {i + 1}, 1)::INT" for i in range(8))
    return _DIGIT.format(w1=w1, w2=w2)


def duck_eik(key: str) -> str:
    base = f"lpad((10000000 + {key})::VARCHAR, 8, '0')"
    digit = duck_digit(base)
    return f"({base} || (CASE WHEN {key} % 10 = 7 THEN ({digit} + 1) % 10 ELSE {digit} END)::VARCHAR)"


DUCK_LINES = """
lines AS (SELECT *, round(net * vat_rate::DECIMAL(4,2) * 0.01::DECIMAL(3,2), 2)::DECIMAL(18,2) AS vat FROM (
  SELECT l_orderkey AS invoice_id, l_linenumber AS line_no, l_suppkey AS supplier_id, p_name AS description, l_quantity::DECIMAL(18,3) AS quantity, l_extendedprice::DECIMAL(18,2) AS list_price,
         round(l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(4,2)), 2)::DECIMAL(18,2) AS net,
         CASE WHEN l_tax::DECIMAL(4,2) = 0 THEN 0 WHEN l_tax::DECIMAL(4,2) >= 0.06 THEN 9 ELSE 20 END AS vat_rate
  FROM lineitem JOIN part ON l_partkey = p_partkey))"""
DUCK_INVOICES = DUCK_LINES + f""",
sums AS (SELECT invoice_id, sum(net)::DECIMAL(18,2) AS tax_base, sum(vat)::DECIMAL(18,2) AS vat, count(*) AS n_lines, arg_min(supplier_id, (line_no, supplier_id, description)) AS supplier_id, arg_min(description, (line_no, supplier_id, description)) AS first_item,
  sum(CASE WHEN vat_rate = 9 THEN net ELSE 0 END)::DECIMAL(18,2) AS base_9, sum(CASE WHEN vat_rate = 0 THEN net ELSE 0 END)::DECIMAL(18,2) AS base_0, max(vat_rate) AS max_rate, bool_or(vat_rate = 9) AS has_9 FROM lines GROUP BY invoice_id),
invoices AS (SELECT o_orderkey AS invoice_id, supplier_id, o_custkey AS recipient_id, (o_orderdate::DATE + INTERVAL 27 YEAR)::DATE AS date_issued,
  ((o_orderdate::DATE + INTERVAL 27 YEAR)::DATE - to_months((o_orderkey % 15)::INT))::DATE AS date_tax_event, strftime((o_orderdate::DATE + INTERVAL 27 YEAR)::DATE, '%Y%m') AS period,
  tax_base, vat, (tax_base + vat)::DECIMAL(18,2) AS total, o_totalprice::DECIMAL(18,2) AS printed_total, CASE o_orderkey % 3 WHEN 0 THEN 'EUR' WHEN 1 THEN 'BGN' END AS currency,
  o_orderstatus = 'P' AS is_credit_note, o_custkey % 5 = 0 AS is_sale, CASE WHEN o_orderpriority[1] IN ('1', '2') THEN 'CASH' ELSE 'BANK' END AS payment_method,
  n_lines, first_item, base_9, base_0, max_rate, has_9, {duck_eik('supplier_id')} AS supplier_eik, {duck_eik('(o_custkey + 5000000)')} AS recipient_eik
  FROM orders LEFT JOIN sums ON o_orderkey = invoice_id)"""
DUCK_VAT = DUCK_INVOICES + """,
vinv AS (SELECT invoice_id, period, date_issued, tax_base, vat, total, is_credit_note, is_sale, has_9, supplier_eik, recipient_eik, s_name AS supplier_name, c_name AS recipient_name, payment_method,
  CASE WHEN invoice_id % 53 = 0 THEN 'USD' WHEN currency IS NOT NULL THEN currency WHEN date_issued >= DATE '2026-01-01' THEN 'EUR' ELSE 'BGN' END AS currency,
  (CASE WHEN invoice_id % 106 = 0 THEN round(total * 1.8::DECIMAL(2,1), 2) WHEN invoice_id % 59 = 0 THEN round(total * 1.95583::DECIMAL(6,5), 2) + 0.01 END)::DECIMAL(18,2) AS total_bgn,
  (CASE s_nationkey WHEN 6 THEN 'FR' WHEN 7 THEN 'DE' WHEN 19 THEN 'RO' WHEN 23 THEN 'GB' ELSE 'BG' END) || supplier_eik AS supplier_vat,
  first_item || CASE WHEN invoice_id % 10 = 3 THEN ' (ВОП)' WHEN invoice_id % 41 = 0 THEN ' reverse charge' ELSE '' END AS note,
  CASE WHEN is_sale AND invoice_id % 97 = 0 THEN 'FISCAL_MEMORY_REPORT' WHEN invoice_id % 89 = 0 THEN 'GOODS_RECEIPT' WHEN NOT is_sale AND invoice_id % 83 = 0 THEN 'CUSTOMS_DECLARATION' ELSE 'INVOICE' END AS doc_kind
  FROM invoices LEFT JOIN supplier ON s_suppkey = supplier_id LEFT JOIN customer ON c_custkey = recipient_id)"""
DUCK_HEADERS = DUCK_VAT + """,
hi AS (SELECT invoice_id, sum(net) FILTER (NOT (line_no = 3 AND invoice_id % 8 = 0))::DECIMAL(18,2) AS items_total, count(*) AS n_items, count(*) FILTER (NOT (line_no = 3 AND invoice_id % 8 = 0)) AS n_with_total FROM lines GROUP BY 1),
hd AS (SELECT v.invoice_id, doc_kind, is_credit_note, v.invoice_id % 43 = 0 AS is_debit_note, CASE WHEN v.invoice_id % 71 = 0 THEN supplier_eik WHEN v.invoice_id % 73 = 0 THEN '' ELSE v.invoice_id::VARCHAR END AS number,
  CASE WHEN v.invoice_id % 61 <> 0 THEN supplier_name END AS supplier_name, CASE WHEN v.invoice_id % 67 = 0 THEN '12345' ELSE supplier_eik END AS supplier_eik, recipient_name, CASE WHEN v.invoice_id % 79 = 0 THEN supplier_eik ELSE recipient_eik END AS recipient_eik,
  supplier_vat, CASE WHEN v.invoice_id % 5 <> 0 THEN 'BG' || recipient_eik END AS recipient_vat, CASE WHEN v.invoice_id % 4 = 0 THEN 'R' || v.invoice_id END AS reference,
  CASE WHEN v.invoice_id % 47 = 0 THEN '31.12.2025' WHEN v.invoice_id % 59 = 0 THEN '2026-02-30' ELSE date_issued::VARCHAR END AS date_issued, (date_issued + INTERVAL 1 MONTH)::DATE::VARCHAR AS date_tax_event, CASE WHEN v.invoice_id % 37 = 0 THEN '2027-13-01' END AS due_date,
  (tax_base + CASE WHEN v.invoice_id % 9 = 0 THEN 1 ELSE 0 END)::DECIMAL(18,2) AS tax_base, vat, (CASE WHEN v.invoice_id % 101 = 0 THEN 0 ELSE total + CASE WHEN v.invoice_id % 6 = 0 THEN 0.05 ELSE 0 END END)::DECIMAL(18,2) AS total,
  items_total, coalesce(n_items, 0) AS n_items, coalesce(n_with_total, 0) AS n_with_total, currency, CASE WHEN v.invoice_id % 29 = 0 THEN 'USD' ELSE currency END AS total_currency, v.invoice_id % 3 = 0 AS both_found,
  CASE WHEN v.invoice_id % 7 = 0 THEN total END AS total_eur, CASE WHEN v.invoice_id % 7 = 0 THEN round(total * 1.95583::DECIMAL(6,5), 2) + CASE WHEN v.invoice_id % 14 = 0 THEN 1 ELSE 0 END END::DECIMAL(18,2) AS total_bgn,
  (v.invoice_id % 100) AS confidence, v.invoice_id % 13 = 0 AS has_discount, v.invoice_id % 17 = 0 AS is_recap, v.invoice_id % 4 AS wording FROM vinv v LEFT JOIN hi USING (invoice_id))"""
DUCK_PARTNERS = f"""
partners AS (SELECT partner_id, {duck_eik('partner_id')} AS eik, 'BG' AS country_code, upper(name) AS legal_name, (['ООД', 'ЕООД', 'АД', 'ЕТ'])[partner_id % 4 + 1] AS legal_form, [replace(name, '#', '')] AS aliases, nation_id, balance::DECIMAL(18,2) AS balance
  FROM (SELECT s_suppkey AS partner_id, s_name AS name, s_acctbal AS balance, s_nationkey AS nation_id FROM supplier UNION ALL SELECT c_custkey + 5000000, c_name, c_acctbal, c_nationkey FROM customer))"""
DUCK_REGISTRY = f"""
registry AS (SELECT {duck_eik('s_suppkey')} AS eik, (DATE '2022-01-01' + (s_suppkey % 900)::INT) AS registered, CASE WHEN s_suppkey % 4 = 0 THEN DATE '2022-01-01' + (s_suppkey % 900)::INT + 1200 END AS deregistered FROM supplier)"""
DUCK_TOKENS = """
tokens AS (SELECT doc_id, i, text, (i // 240 + 1)::INT AS page, (i % 12) * 180 AS "left", ((i % 240) // 12) * 40 + i % 3 AS top, length(text) * 12 AS width, 24 AS height, ((i::BIGINT * 37 + doc_id) % 101)::INT AS conf
  FROM (SELECT doc_id, unnest(ws) AS text, (generate_subscripts(ws, 1) - 1)::INT AS i FROM (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS ws FROM documents)))"""
