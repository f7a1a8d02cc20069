"""Report queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as R
from ..sources import adapters as A
from .registry import query

INV = f"WITH {A.DUCK_INVOICES}"
DOCS = INV + ", docs AS (SELECT *, n_lines IS NOT NULL AS ok, coalesce(abs(total - printed_total) <= 100000, false) AS valid, CASE WHEN is_credit_note THEN 'credit_note' WHEN n_lines IS NULL THEN 'empty' ELSE 'invoice' END AS doc_type FROM invoices)"


def docs(spark, d):
    inv = A.invoices(spark, d)
    kind = F.when(F.col("is_credit_note"), "credit_note").when(F.col("n_lines").isNull(), "empty").otherwise("invoice")
    return inv.withColumns({"ok": F.col("n_lines").isNotNull(), "valid": F.coalesce(F.abs(F.col("total") - F.col("printed_total")) <= 100000, F.lit(False)), "doc_type": kind})


@query("E01_batch_summary", DOCS + " SELECT count(*) AS total, count(*) FILTER (ok) AS ok, count(*) FILTER (NOT ok) AS failed, count(*) FILTER (valid) AS valid, count(*) FILTER (NOT valid) AS invalid, round(100.0 * count(*) FILTER (valid) / count(*), 2)::DECIMAL(5,2) AS pass_rate, sum(n_lines)::BIGINT AS items FROM docs")
def batch_summary(spark, d):
    return R.batch_summary(docs(spark, d))


@query("E02_totals_by_currency", DOCS + " SELECT coalesce(currency, 'UNKNOWN') AS currency, count(*) AS n, sum(tax_base)::DECIMAL(18,2) AS tax_base, sum(vat)::DECIMAL(18,2) AS vat, sum(total)::DECIMAL(18,2) AS total FROM docs GROUP BY 1")
def totals_by_currency(spark, d):
    return R.totals_by_currency(docs(spark, d))


@query("E03_supplier_totals", DOCS + ", g AS (SELECT supplier_eik, coalesce(currency, 'UNKNOWN') AS currency, count(*) AS n, coalesce(sum(total), 0)::DECIMAL(18,2)::VARCHAR AS total FROM docs GROUP BY 1, 2) SELECT supplier_eik, sum(n)::BIGINT AS n_invoices, string_agg(currency || '=' || total, ',' ORDER BY currency) AS by_currency FROM g GROUP BY 1")
def supplier_totals(spark, d):
    out = R.supplier_totals(docs(spark, d))
    return out.withColumn("by_currency", F.array_join(F.transform("by_currency", lambda x: F.concat(x["currency"], F.lit("="), x["total"])), ","))


@query("E05_doc_type_counts", DOCS + " SELECT doc_type, count(*) AS n FROM docs GROUP BY 1")
def doc_type_counts(spark, d):
    return R.doc_type_counts(docs(spark, d))


@query("E06_extraction_coverage", DOCS + " SELECT count(*) AS n, count(supplier_eik) AS has_supplier_eik, count(first_item) AS has_first_item, count(total) AS has_total, count(currency) AS has_currency FROM docs")
def extraction_coverage(spark, d):
    return R.extraction_coverage(docs(spark, d))


@query("E07_supplier_listing", DOCS + " SELECT coalesce(supplier_eik, 'Unknown') AS supplier, count(*) AS n, coalesce(sum(total), 0)::DECIMAL(18,2) AS total, string_agg(invoice_id::VARCHAR, ',' ORDER BY invoice_id) AS invoices FROM docs GROUP BY 1")
def supplier_listing(spark, d):
    return R.supplier_listing(docs(spark, d))


def _profiles(key):
    return DOCS + f""", l AS (SELECT * FROM docs WHERE tax_base IS NOT NULL AND {'NOT ' if key == 'supplier_eik' else ''}is_sale),
b AS (SELECT {key}, count(*) AS n, sum(tax_base)::DECIMAL(18,2) AS turnover, count(*) FILTER (is_credit_note) AS n_credit_notes FROM l GROUP BY 1),
nm AS (SELECT {key}, arg_min(period, rk) AS top_name FROM (SELECT {key}, period, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, min(invoice_id)) AS rk FROM l GROUP BY {key}, period) GROUP BY 1),
rs AS (SELECT {key}, string_agg(first_item, '|' ORDER BY rk) AS top_reasons FROM (SELECT {key}, first_item, row_number() OVER (PARTITION BY {key} ORDER BY count(*) DESC, min(invoice_id)) AS rk FROM l GROUP BY {key}, first_item) WHERE rk <= 5 GROUP BY 1),
sm AS (SELECT {key}, string_agg(invoice_id::VARCHAR, ',' ORDER BY invoice_id) AS samples FROM (SELECT {key}, invoice_id, row_number() OVER (PARTITION BY {key} ORDER BY invoice_id) AS rk FROM l) WHERE rk <= 5 GROUP BY 1)
SELECT * FROM b JOIN nm USING ({key}) JOIN rs USING ({key}) JOIN sm USING ({key})"""


@query("E08_purchase_profiles", _profiles("supplier_eik"))
def purchase_profiles(spark, d):
    return R.profiles(docs(spark, d).where("tax_base IS NOT NULL AND NOT is_sale"), "supplier_eik", "invoice_id", "period", "first_item", "tax_base")


@query("E09_sales_profiles", _profiles("recipient_eik"))
def sales_profiles(spark, d):
    return R.profiles(docs(spark, d).where("tax_base IS NOT NULL AND is_sale"), "recipient_eik", "invoice_id", "period", "first_item", "tax_base")


FEED = "WITH fb AS (SELECT event_id AS feedback_id, ts AS created_at, CASE WHEN user_id % 10 = 0 THEN NULL ELSE user_id END AS vendor, event_type AS field_name, value FROM events)"


def feedback(spark, d):
    e = A.table(spark, d, "events")
    return e.select(F.col("event_id").alias("feedback_id"), F.col("ts").alias("created_at"), F.when(F.col("user_id") % 10 != 0, F.col("user_id")).alias("vendor"), F.col("event_type").alias("field_name"), "value")


@query("E19_feedback_stats", FEED + " SELECT field_name, count(*) AS n, count(DISTINCT vendor) AS n_vendors, max(created_at) AS newest FROM fb GROUP BY ROLLUP (field_name)")
def feedback_stats(spark, d):
    return R.feedback_stats(feedback(spark, d))


@query("F15_latest_feedback", FEED + " SELECT *, row_number() OVER (PARTITION BY vendor ORDER BY created_at DESC, feedback_id DESC) AS rank FROM fb QUALIFY rank <= 20")
def latest_feedback(spark, d):
    return R.latest_feedback(feedback(spark, d))


@query("F16_audit_history", "SELECT user_id AS document_id, event_id, event_type AS action, row_number() OVER w AS place, lag(event_type) OVER w AS previous FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def audit_history(spark, d):
    return R.audit_history(A.table(spark, d, "events").select(F.col("user_id").alias("document_id"), "event_id", "ts", F.col("event_type").alias("action")))


@query("E21_client_dossier", DOCS + ", g AS (SELECT recipient_eik AS client, supplier_eik, count(*) AS n, coalesce(sum(total), 0)::DECIMAL(18,2) AS turnover, string_agg(DISTINCT payment_method, ',' ORDER BY payment_method) AS accounts FROM docs GROUP BY 1, 2) SELECT *, row_number() OVER (PARTITION BY client ORDER BY turnover DESC, supplier_eik NULLS FIRST) AS rank FROM g QUALIFY rank <= 10")
def client_dossier(spark, d):
    return R.client_dossier(docs(spark, d).withColumnsRenamed({"recipient_eik": "client", "payment_method": "account"}))


@query("E22_transfer_batch_totals", DOCS + ", b AS (SELECT (row_number() OVER (ORDER BY invoice_id) - 1) // 150 AS batch, * FROM docs WHERE tax_base IS NOT NULL) SELECT batch, count(*) AS n, sum(tax_base)::DECIMAL(18,2) AS tax_base, sum(vat)::DECIMAL(18,2) AS vat, sum(total)::DECIMAL(18,2) AS total, string_agg(invoice_id::VARCHAR, ',' ORDER BY invoice_id) AS numbers FROM b GROUP BY 1")
def transfer_batch_totals(spark, d):
    return R.transfer_batch_totals(docs(spark, d))


TOK = f"WITH {A.DUCK_TOKENS}"


@query("E23_ocr_evidence", TOK + " SELECT doc_id, count(*) AS n_tokens, count(DISTINCT page) AS n_pages, sum(conf)::BIGINT AS conf_sum, count(*) FILTER (conf < 60) AS n_low FROM tokens GROUP BY 1")
def ocr_evidence(spark, d):
    return R.ocr_evidence(A.tokens(spark, d))


_ROUND = "coalesce((({a}) * 100 * 2 + ({b})) // (2 * ({b})) * 0.01::DECIMAL(3,2), 0)::DECIMAL(5,2)"


@query("E24_ocr_confidence", TOK + f", g AS (SELECT doc_id, nullif(count(*) FILTER (conf > 0), 0) AS n, sum(conf) FILTER (conf > 0)::BIGINT AS s, count(*) FILTER (conf BETWEEN 1 AND 59) AS low FROM tokens GROUP BY 1) SELECT doc_id, {_ROUND.format(a='s', b='n * 100')} AS confidence, {_ROUND.format(a='low', b='n')} AS low_ratio FROM g")
def ocr_confidence(spark, d):
    return R.ocr_confidence(A.tokens(spark, d))


@query("E25_pass_score", TOK + """, two AS (SELECT *, 1 AS pass FROM tokens UNION ALL SELECT * REPLACE ((i * 53 % 101) AS conf), 2 FROM tokens),
g AS (SELECT doc_id, page, pass, avg(conf) FILTER (conf > 0) AS mean, avg((conf >= 80)::INT) FILTER (conf > 0) AS share, sum(length(text)) AS chars, lower(string_agg(text, ' ' ORDER BY i)) AS t FROM two GROUP BY ALL),
s AS (SELECT doc_id, page, pass, CASE WHEN mean IS NULL THEN 0 ELSE round(0.4::DOUBLE * mean + 30 * share + 0.2::DOUBLE * least(chars / 10, 50) + CASE WHEN regexp_matches(t, '[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}') THEN 3 ELSE 0 END + CASE WHEN regexp_matches(t, '[0-9]{3,}') THEN 2 ELSE 0 END
  + CASE WHEN regexp_matches(t, 'фактура|invoice|доставчик|получател|данъчна основа|ддс|общо') THEN 5 ELSE 0 END, 4) END AS score FROM g)
SELECT *, row_number() OVER (PARTITION BY doc_id, page ORDER BY score DESC, pass) = 1 AS best FROM s""")
def pass_score(spark, d):
    one = A.tokens(spark, d).withColumn("pass", F.lit(1))
    return R.pass_score(one.unionByName(one.withColumns({"pass": F.lit(2), "conf": F.col("i") * 53 % 101})))


@query("E29_delivery_stats", "SELECT event_type AS target, count(*) AS deliveries, count(*) FILTER (value < 50) AS successes, sum(1 + user_id % 3)::BIGINT AS attempts, arg_max(event_id, (ts, event_id)) AS latest FROM events GROUP BY 1")
def delivery_stats(spark, d):
    return R.delivery_stats(A.table(spark, d, "events").select(F.col("event_type").alias("target"), "event_id", "ts", F.coalesce(F.col("value") < 50, F.lit(False)).alias("success"), (F.col("user_id") % 3 + 1).alias("attempts")))


@query("E30_partner_sync_report", "SELECT CASE user_id % 4 WHEN 0 THEN 'synced' WHEN 1 THEN 'not_found' WHEN 2 THEN 'invalid' ELSE 'failed' END AS outcome, count(*) AS n FROM events GROUP BY 1")
def partner_sync_report(spark, d):
    code = F.element_at(F.array(F.lit(200), F.lit(404), F.lit(400), F.lit(500)), (F.col("user_id") % 4 + 1).cast("int"))
    return R.partner_sync_report(A.table(spark, d, "events").select(code.alias("code")))


@query("F01_sequence_gaps", """WITH a AS (SELECT DISTINCT l_orderkey, l_linenumber::BIGINT AS k FROM lineitem), o AS (SELECT l_orderkey, count(*) AS n, min(k) AS min, max(k) AS max FROM a GROUP BY 1),
m AS (SELECT l_orderkey, i FROM (SELECT l_orderkey, unnest(range(1, n + 1)) AS i FROM o) x WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.l_orderkey = x.l_orderkey AND a.k = x.i)),
r AS (SELECT l_orderkey, min(i) AS gap_from, max(i) AS gap_to, count(*) AS n_missing FROM (SELECT *, i - row_number() OVER (PARTITION BY l_orderkey ORDER BY i) AS run FROM m) GROUP BY l_orderkey, run)
SELECT o.*, gap_from, gap_to, n_missing FROM o LEFT JOIN r USING (l_orderkey)""")
def sequence_gaps(spark, d):
    return R.sequence_gaps(A.table(spark, d, "lineitem"), "l_orderkey", "l_linenumber")


@query("F02_subdocuments", "WITH p AS (SELECT conv_id AS doc, turn AS page, role AS category, length(text) AS confidence FROM conversations), n AS (SELECT *, CASE WHEN category IS NOT DISTINCT FROM lag(category) OVER w AND lag(page) OVER w IS NOT NULL THEN 0 ELSE 1 END AS new FROM p WINDOW w AS (PARTITION BY doc ORDER BY page)), r AS (SELECT *, sum(new) OVER (PARTITION BY doc ORDER BY page)::BIGINT AS run FROM n) SELECT doc, run, category, min(page) AS first_page, max(page) AS last_page, max(confidence)::INT AS confidence FROM r GROUP BY ALL")
def subdocuments(spark, d):
    return R.subdocuments(A.table(spark, d, "conversations").select(F.col("conv_id").alias("doc"), F.col("turn").alias("page"), F.col("role").alias("category"), F.length("text").alias("confidence")))


ACC = "WITH accounts AS (SELECT row_number() OVER (ORDER BY p_partkey) AS seq, (300 + p_partkey % 100)::VARCHAR AS code, p_name AS name, p_type AS grp FROM part)"


def accounts(spark, d):
    return A.table(spark, d, "part").select(F.col("p_partkey").alias("seq"), (F.col("p_partkey") % 100 + 300).cast("string").alias("code"), F.col("p_name").alias("name"), F.col("p_type").alias("grp"))


@query("F17_search_accounts", """WITH accounts AS (SELECT p_partkey AS seq, (300 + p_partkey % 100)::VARCHAR AS code, p_name AS name, p_type AS grp FROM part),
s AS (SELECT *, (CASE WHEN code = '304' THEN 100 WHEN starts_with(code, '304') THEN 50 WHEN contains(lower(name), '304') THEN 30 WHEN contains(lower(grp), '304') THEN 10 ELSE 0 END) + (CASE WHEN code = 'bolt' THEN 100 WHEN starts_with(code, 'bolt') THEN 50 WHEN contains(lower(name), 'bolt') THEN 30 WHEN contains(lower(grp), 'bolt') THEN 10 ELSE 0 END) AS score FROM accounts)
SELECT * FROM s WHERE score > 0 ORDER BY score DESC, seq LIMIT 10""")
def search_accounts(spark, d):
    return R.search_accounts(accounts(spark, d), "304 bolt")


@query("F18_list_accounts", "SELECT (300 + p_partkey % 100)::VARCHAR AS code, (300 + p_partkey % 100)::VARCHAR || ' - ' || p_name || ' (' || p_type || ')' AS text FROM part WHERE p_type = (SELECT min(p_type) FROM part)")
def list_accounts(spark, d):
    acc = accounts(spark, d)
    return R.list_accounts(acc, acc.agg(F.min("grp")).first()[0])
