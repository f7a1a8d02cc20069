"""Queries of master data, scalars over whole columns, and rules of other documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ledgers as L
from ..operators import masterdata as M
from ..operators import rules as R
from ..sources import adapters as A
from .q_ledgers import _ITEM_TEXT, _JOURNAL, _item_texts, journal_entries
from .registry import query

INV, TOK, PART = f"WITH {A.DUCK_INVOICES}", f"WITH {A.DUCK_TOKENS}", A.DUCK_PARTNERS.strip()


@query("B18_transliteration", "SELECT doc_id, translate(translate(lower(coalesce(text, '')), 'абвгдезийклмнопрстуфхъь', 'abvgdeziyklmnoprstufhay'), 'zz', 'zz') AS latin FROM (SELECT doc_id, translate(text, 'abvgdklmnoprstuf', 'абвгдклмнопрстуф') AS text FROM documents)")
def transliteration(spark, d):
    """Texts whose Latin letters were set in Cyrillic, and back."""
    t = F.translate("text", "abvgdklmnoprstuf", "абвгдклмнопрстуф")
    return A.table(spark, d, "documents").select("doc_id", S.translit_bg_en(F.lower(F.coalesce(t, F.lit("")))).alias("latin"))


@query("B24_stable_uuid", "SELECT s_suppkey, lower(left(h, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21, 12)) AS uuid FROM (SELECT s_suppkey, md5(s_name) AS h FROM supplier)")
def stable_uuid(spark, d):
    return A.table(spark, d, "supplier").select("s_suppkey", S.stable_uuid(F.upper(F.md5(F.col("s_name").cast("binary")))).alias("uuid"))


@query("B27_company_keywords", "SELECT s_suppkey, lower(trim(s_name)) || ' ltd,' || string_agg(w, ',' ORDER BY i) AS words FROM (SELECT s_suppkey, s_name, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT *, string_split(trim(regexp_replace(lower(s_name), '[^a-z0-9_]+', ' ', 'g')), ' ') AS ws FROM supplier)) WHERE length(w) >= 3 AND i <= 4 GROUP BY s_suppkey, s_name")
def company_keywords(spark, d):
    return A.table(spark, d, "supplier").select("s_suppkey", F.array_join(S.company_keywords(F.concat("s_name", F.lit(" LTD"))), ",").alias("words"))


@query("B31_repair_future_date", INV + """, x AS (SELECT invoice_id, date_issued AS day FROM invoices)
SELECT invoice_id, CASE WHEN day <= DATE '2025-08-31' THEN day WHEN month(day) IN (9, 10) AND day - DATE '2025-08-31' <= 30 THEN (day - to_months((month(day) - 8)::INT))::DATE WHEN year(day) % 10 = 9 THEN (day - INTERVAL 4 YEAR)::DATE ELSE day END AS day FROM x""")
def repair_future_date(spark, d):
    return A.invoices(spark, d).select("invoice_id", S.repair_future_date(F.col("date_issued"), F.lit("2025-08-31").cast("date")).alias("day"))


@query("C03_mail_auth_status", "SELECT event_id, CASE WHEN event_type = 'click' THEN 'pass' WHEN user_id % 3 = 0 THEN 'softfail' WHEN user_id % 3 = 1 THEN 'pass' ELSE 'none' END AS spf, CASE WHEN user_id % 3 = 0 THEN 'pass' ELSE 'none' END AS dkim FROM events")
def mail_auth_status(spark, d):
    header = F.when(F.col("user_id") % 3 == 0, "mx.example; SPF=SoftFail x; dkim = pass (2048)").when(F.col("user_id") % 3 == 1, "mx.example; spf=pass")
    df = A.table(spark, d, "events").select("event_id", F.when(F.col("event_type") == "click", " PASS ").alias("spf_flag"), F.lit(None).cast("string").alias("dkim_flag"), header.alias("auth_results"))
    return M.mail_auth_status(df).select("event_id", "spf", "dkim")


@query("D09_classify_invoices", INV + " SELECT invoice_id, CASE WHEN supplier_id % 7 = 0 THEN '609' WHEN contains(first_item, 'widget') THEN '304' ELSE '304' END AS account, CASE WHEN supplier_id % 7 = 0 THEN 'supplier' WHEN contains(first_item, 'widget') THEN 'item' ELSE 'default' END AS tier FROM invoices")
def classify_invoices(spark, d):
    rules = A.table(spark, d, "supplier").where("s_suppkey % 7 = 0").select(A.eik_of(F.col("s_suppkey")).alias("eik"), F.lit("609/2").alias("account"))
    df = A.invoices(spark, d).select("invoice_id", "supplier_eik", F.when(F.contains("first_item", F.lit("widget")), "304/1").alias("item_account"))
    return M.classify_invoices(df, rules).select("invoice_id", "account", "tier")


@query("D14_suppress_fragments", TOK + """, t AS (SELECT doc_id, page, i, text, "left", top, width, height FROM tokens UNION ALL SELECT doc_id, page, i + 1000000, left(text, 3), "left" + 2, top, 36, 24 FROM tokens WHERE i % 5 = 0)
SELECT t.doc_id, t.i, t.text FROM t WHERE NOT EXISTS (SELECT 1 FROM t b WHERE b.doc_id = t.doc_id AND b.page = t.page AND b.i <> t.i AND length(b.text) > length(t.text) AND contains(lower(b.text), lower(t.text))
  AND least(t."left" + t.width, b."left" + b.width) > greatest(t."left", b."left") AND least(t.top + t.height, b.top + b.height) > greatest(t.top, b.top)
  AND (least(t."left" + t.width, b."left" + b.width) - greatest(t."left", b."left")) * (least(t.top + t.height, b.top + b.height) - greatest(t.top, b.top)) >= 0.75 * least(t.width * t.height, b.width * b.height))""")
def suppress_fragments(spark, d):
    """Every fifth token was read once more, its first three letters alone."""
    t = A.tokens(spark, d).select("doc_id", "page", "i", "text", "left", "top", "width", "height")
    piece = t.where("i % 5 = 0").select("doc_id", "page", (F.col("i") + 1000000).alias("i"), F.left("text", F.lit(3)).alias("text"), (F.col("left") + 2).alias("left"), "top", F.lit(36).alias("width"), F.lit(24).alias("height"))
    return M.suppress_fragments(t.unionByName(piece)).select("doc_id", "i", "text")


_WORDS = [("bolt", 1, "BG11", "BOLTBGSF"), ("widget", 2, "BG22", "WIDGBGSF"), ("red", 3, "BG33", "REDDBGSF")]


@query("D20_bank_by_keyword", "WITH w AS (SELECT p_partkey, string_split(regexp_replace(lower(p_name), '[^a-z0-9_]+', ' ', 'g'), ' ') AS ws FROM part) SELECT p_partkey, CASE WHEN list_contains(ws, 'bolt') THEN 'BG11' WHEN list_contains(ws, 'widget') THEN 'BG22' ELSE 'BG33' END AS iban, CASE WHEN list_contains(ws, 'bolt') THEN 'BOLTBGSF' WHEN list_contains(ws, 'widget') THEN 'WIDGBGSF' ELSE 'REDDBGSF' END AS bic FROM w WHERE list_contains(ws, 'bolt') OR list_contains(ws, 'widget') OR list_contains(ws, 'red')")
def bank_by_keyword(spark, d):
    words = spark.createDataFrame(_WORDS, "word string, seq int, iban string, bic string")
    return M.by_keyword(A.table(spark, d, "part").select("p_partkey", F.col("p_name").alias("name")), words, "p_partkey")


@query("D21_find_profile", f"WITH {PART} SELECT partner_id AS id, CASE WHEN partner_id % 3 = 0 THEN partner_id % 1000000 WHEN partner_id < 5000000 THEN -1 ELSE NULL END AS profile, CASE WHEN partner_id % 3 = 0 THEN 'eik' WHEN partner_id < 5000000 THEN 'name' END AS tier FROM partners")
def find_profile(spark, d):
    """A third of the partners has a profile, half of these under an alternate EIK; all suppliers are known by a word of their name."""
    p = A.partners(spark, d)
    k = F.col("partner_id")
    prof = p.where("partner_id % 3 = 0").select((k % 1000000).alias("profile"), F.when(k % 2 == 0, F.col("eik")).otherwise("-").alias("eik"), F.when(k % 2 == 1, F.array("eik")).alias("other_eiks"))
    words = spark.createDataFrame([("supplier", 1, -1)], "word string, seq int, profile long")
    return M.find_profile(p.select(k.alias("id"), "eik", F.col("legal_name").alias("name")), prof, words)


@query("E26_store_stats", "SELECT count(*) AS entries, sum(octet_length(encode(coalesce(text, ''))))::BIGINT AS bytes FROM documents")
def store_stats(spark, d):
    return A.table(spark, d, "documents").agg(F.count("*").alias("entries"), F.coalesce(F.sum(F.octet_length(F.coalesce("text", F.lit("")))), F.lit(0)).cast("long").alias("bytes"))


@query("H10_check_bank", f"""WITH {PART}, t AS (SELECT partner_id AS invoice_id, CASE partner_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'DE' || lpad(partner_id::VARCHAR, 20, '0') ELSE 'BG' || lpad((partner_id % 97)::VARCHAR, 2, '0') || 'BPBI8170' || lpad(partner_id::VARCHAR, 10, '0') END AS iban, partner_id % 3 <> 0 AS bank FROM partners),
u AS (SELECT *, ('11251118' || '8170' || lpad(invoice_id::VARCHAR, 10, '0') || '1116' || substr(iban, 3, 2)) AS n FROM t WHERE invoice_id % 4 > 1)
SELECT invoice_id, 'INVALID_IBAN_FORMAT' AS code, 'error' AS severity FROM t WHERE invoice_id % 4 = 1 UNION ALL SELECT invoice_id, 'INVALID_IBAN_MOD97', 'error' FROM u WHERE n::HUGEINT % 97 <> 1 UNION ALL SELECT invoice_id, 'MISSING_IBAN_FOR_BANK_TRANSFER', 'warning' FROM t WHERE iban IS NULL AND bank""")
def check_bank(spark, d):
    k = F.col("partner_id")
    iban = F.when(k % 4 == 1, F.concat(F.lit("DE"), F.lpad(k.cast("string"), 20, "0"))).when(k % 4 > 1, F.concat(F.lit("BG"), F.lpad((k % 97).cast("string"), 2, "0"), F.lit("BPBI8170"), F.lpad(k.cast("string"), 10, "0")))
    return R.check_bank(A.partners(spark, d).select(k.alias("invoice_id"), iban.alias("iban"), F.when(k % 3 != 0, "BANK").otherwise("CASH").alias("payment_method")))


def _issue_sql(src, rules):
    return " UNION ALL ".join(f"SELECT invoice_id, '{c}' AS code, '{s}' AS severity FROM {src} WHERE {w}" for c, s, w in rules)


_BO = INV + ", bo AS (SELECT invoice_id, CASE invoice_id % 3 WHEN 0 THEN NULL WHEN 1 THEN 'BG13BPBI81701060091301' ELSE 'BG14BPBI81701060091301' END AS iban, CASE WHEN invoice_id % 5 = 0 THEN NULL ELSE supplier_eik END AS eik, supplier_id, CASE WHEN invoice_id % 7 = 0 THEN 0 ELSE total END AS amount, period FROM invoices) "


@query("H14_check_budget_orders", _BO + _issue_sql("bo", [("MISSING_NRA_IBAN", "error", "iban IS NULL"), ("INVALID_NRA_IBAN", "error", "invoice_id % 3 = 2"), ("MISSING_OBLIGATED_PERSON_EIK", "error", "eik IS NULL"), ("INVALID_OBLIGATED_PERSON_EIK", "error", "eik IS NOT NULL AND supplier_id % 10 = 7"), ("MISSING_TRANSFERRED_AMOUNT", "error", "coalesce(amount, 0) <= 0"), ("MISSING_PAYMENT_PERIOD", "warning", "invoice_id % 11 = 0"), ("MISSING_PAYMENT_PARAGRAPH", "warning", "invoice_id % 13 = 0")]))
def check_budget_orders(spark, d):
    k = F.col("invoice_id")
    df = A.invoices(spark, d).select(
        "invoice_id", F.when(k % 3 == 1, "BG13BPBI81701060091301").when(k % 3 == 2, "BG14BPBI81701060091301").alias("nra_iban"), F.when(k % 5 != 0, F.col("supplier_eik")).alias("obligated_eik"), F.when(k % 7 == 0, 0).otherwise(F.col("total")).cast(M.MONEY).alias("amount"),
        F.when(k % 11 != 0, F.col("period")).alias("period_from"), F.lit(" ").alias("period_to"), F.when(k % 13 != 0, "55-06").alias("paragraph"),
    )
    return R.issues(df, "invoice_id", M.budget_order_rules())


@query("H15_check_fiscal_reports", INV + " " + _issue_sql("invoices", [("MISSING_TURNOVER_TOTAL", "error", "coalesce(CASE WHEN invoice_id % 7 = 0 THEN 0 ELSE total END, 0) <= 0"), ("TURNOVER_RECONCILIATION_MISMATCH", "error", "tax_base <> 0 AND vat <> 0 AND invoice_id % 7 <> 0 AND invoice_id % 4 = 0"), ("MISSING_FISCAL_PERIOD", "warning", "invoice_id % 11 = 0")]))
def check_fiscal_reports(spark, d):
    k = F.col("invoice_id")
    turnover = F.when(k % 7 == 0, 0).otherwise(F.col("total") + F.when(k % 4 == 0, F.expr("0.11BD")).otherwise(F.expr("0.10BD"))).cast(M.MONEY)
    df = A.invoices(spark, d).select("invoice_id", turnover.alias("turnover"), "tax_base", "vat", F.lit(None).cast("string").alias("period_from"), F.when(k % 11 != 0, F.col("period")).alias("period_to"))
    return R.issues(df, "invoice_id", M.fiscal_report_rules())


@query("H16_check_goods_receipts", INV + " " + _issue_sql("invoices", [("MISSING_GOODS_RECEIPT_TOTAL", "warning", "coalesce(total, 0) <= 0"), ("MISSING_RECEIPT_NUMBER", "warning", "invoice_id % 9 = 0")]))
def check_goods_receipts(spark, d):
    return R.issues(A.invoices(spark, d).select("invoice_id", "total", F.when(F.col("invoice_id") % 9 != 0, F.col("invoice_id").cast("string")).alias("number")), "invoice_id", M.goods_receipt_rules())


@query("I10_infer_account", f"WITH {A.DUCK_INVOICES}, {_ITEM_TEXT} SELECT invoice_id, CASE WHEN is_sale THEN CASE WHEN contains(items, 'widget') THEN '703' WHEN supplier_id % 5 = 0 THEN '702' ELSE '701' END ELSE CASE WHEN contains(items, 'bolt') THEN '601' WHEN contains(items, 'gear') THEN '602' WHEN supplier_id % 5 = 0 THEN '304' ELSE '601' END END AS account, CASE WHEN is_sale THEN CASE WHEN contains(items, 'widget') THEN 's1' WHEN supplier_id % 5 = 0 THEN 's2' ELSE 'п-ба' END ELSE CASE WHEN contains(items, 'bolt') THEN 'b1' WHEN contains(items, 'gear') THEN 'b2' WHEN supplier_id % 5 = 0 THEN 'b3' ELSE 'м-ли' END END AS reason FROM invoices LEFT JOIN texts USING (invoice_id)")
def infer_account(spark, d):
    inv = A.invoices(spark, d).select("invoice_id", "is_sale", F.when(F.col("supplier_id") % 5 == 0, "Fifth Trade").alias("partner_name")).join(_item_texts(spark, d), "invoice_id", "left")
    sale, buy = ((("widget",), "703", "s1"), (("fifth",), "702", "s2")), ((("bolt",), "601", "b1"), (("gear",), "602", "b2"), (("fifth",), "304", "b3"))
    return M.infer_account(inv, sale, buy).select("invoice_id", "account", "reason")


_FIT = lambda p, w: f"(coalesce({p} > 0 AND {w} > 0 AND (abs(({p}) - ({w}) * 0.20) < ({w}) * 0.02 OR abs(({p}) - ({w}) * 0.09) < ({w}) * 0.02), false))"


@query("I21_repair_totals", INV + f""", q AS (SELECT invoice_id AS k, tax_base AS b, round(tax_base * 0.20::DECIMAL(3,2), 2)::DECIMAL(18,2) AS g FROM invoices),
x AS (SELECT k, (CASE k % 9 WHEN 1 THEN g WHEN 3 THEN b + 7 + b * 0.5 WHEN 5 THEN NULL WHEN 8 THEN b + g + 5 ELSE b END)::DECIMAL(18,2) AS b, (CASE k % 9 WHEN 1 THEN b WHEN 2 THEN g + round(b * 0.05::DECIMAL(3,2), 2) WHEN 6 THEN NULL ELSE g END)::DECIMAL(18,2) AS v, (CASE k % 9 WHEN 4 THEN b + g + b WHEN 7 THEN NULL ELSE b + g END)::DECIMAL(18,2) AS t, (CASE WHEN k % 4 = 0 THEN b + g END)::DECIMAL(18,2) AS w FROM q),
y AS (SELECT *, coalesce(w > 5, false) AND coalesce(abs(t - w) > 1, false) AND {_FIT('v', '(w - v)')} AS ov, coalesce(w > 5, false) AND t IS NULL AS nt FROM x),
y1 AS (SELECT k, CASE WHEN ov THEN w - v ELSE b END AS b, v, CASE WHEN ov OR nt THEN w ELSE t END AS t, CASE WHEN ov OR nt THEN 'words ' ELSE '' END AS r0 FROM y),
y2 AS (SELECT *, coalesce(t > 0 AND b > t, false) AS inv FROM y1),
y3 AS (SELECT k, CASE WHEN inv THEN (((t * 100)::BIGINT * 10 + 6) // 12 * 0.01)::DECIMAL(18,2) ELSE b END AS b, v, t, r0 || CASE WHEN inv THEN 'inverted ' ELSE '' END AS r0 FROM y2),
y4 AS (SELECT *, coalesce(b > 0 AND v > 0 AND b < v AND abs(b + v - t) <= 0.03 AND abs(b - v * 0.20) < v * 0.02, false) AS sw FROM y3),
y5 AS (SELECT k, CASE WHEN sw THEN v ELSE b END AS b, CASE WHEN sw THEN b ELSE v END AS v, t, r0 || CASE WHEN sw THEN 'swap ' ELSE '' END AS r0 FROM y4),
y6 AS (SELECT *, {_FIT('v', 'b')} AS p1, {_FIT('(t - b)', 'b')} AS p2, {_FIT('v', '(t - v)')} AS p3 FROM y5),
y7 AS (SELECT *, CASE WHEN b IS NOT NULL AND v IS NOT NULL AND t IS NOT NULL THEN CASE WHEN abs(b + v - t) <= 0.03 THEN 'ok' WHEN p1 AND NOT p2 AND NOT p3 THEN 'total' WHEN p2 AND NOT p3 THEN 'vat' WHEN p3 AND NOT p2 THEN 'base' WHEN b > 0 AND v > 0 AND (b + v) * 2 < t THEN 'total'
  WHEN t - v > 0 AND abs(b - (t - v)) > t * 0.5 THEN 'base' WHEN t - b > 0 AND abs(v - (t - b)) > t * 0.5 THEN 'vat' ELSE 'open' END WHEN t IS NOT NULL AND v IS NOT NULL THEN 'base' WHEN t IS NOT NULL AND b IS NOT NULL THEN CASE WHEN t >= b THEN 'vat' ELSE 'rate' END WHEN b IS NOT NULL AND v IS NOT NULL THEN 'total' ELSE 'open' END AS r FROM y6)
SELECT k AS invoice_id, CASE WHEN r = 'base' THEN t - v ELSE b END::DECIMAL(18,2) AS tax_base, CASE r WHEN 'vat' THEN greatest(t - b, 0) WHEN 'rate' THEN round(b * 0.20, 2) ELSE v END::DECIMAL(18,2) AS vat, CASE r WHEN 'total' THEN b + v WHEN 'rate' THEN b + round(b * 0.20, 2) ELSE t END::DECIMAL(18,2) AS total, r0 || r AS rule FROM y7""")
def repair_totals(spark, d):
    """All invoices, each ninth as it is, swapped, with one amount off or missing, or with a base above the total; every fourth with its total in words."""
    k, b = F.col("invoice_id"), F.col("tax_base")
    g = F.round(b * F.expr("0.20BD"), 2).cast(M.MONEY)
    at = lambda n, x, rest: F.when(k % 9 == n, x).otherwise(rest)
    none = F.lit(None).cast(M.MONEY)
    df = A.invoices(spark, d).select(
        "invoice_id", at(1, g, at(3, b + 7 + b * F.expr("0.5BD"), at(5, none, at(8, b + g + 5, b)))).cast(M.MONEY).alias("tax_base"),
        at(1, b, at(2, g + F.round(b * F.expr("0.05BD"), 2), at(6, none, g))).cast(M.MONEY).alias("vat"), at(4, b + g + b, at(7, none, b + g)).cast(M.MONEY).alias("total"), F.when(k % 4 == 0, b + g).cast(M.MONEY).alias("words"),
    )
    return L.repair_totals(df)


@query("K04_journal_lines", f"WITH j AS ({_JOURNAL}) SELECT invoice_id, line, doc_number || ';' || line || ';' || debit_account || ';' || credit_account || ';' || amount::VARCHAR || ';' || CASE WHEN is_storno THEN '1' ELSE '0' END AS text FROM j")
def journal_lines(spark, d):
    return M.journal_lines(journal_entries(spark, d))


@query("K04_sap_rows", f"WITH j AS ({_JOURNAL}), p AS (SELECT invoice_id, doc_number, is_storno, entry_base, entry_vat, entry_total, arg_min(debit_account, line) AS account FROM j GROUP BY ALL) SELECT invoice_id, doc_number, r AS row, CASE WHEN (r = 3) = is_storno THEN 'S' ELSE 'H' END AS indicator, CASE r WHEN 1 THEN account WHEN 2 THEN '4531' ELSE '401' END AS gl_account, abs(CASE r WHEN 1 THEN entry_base WHEN 2 THEN entry_vat ELSE entry_total END)::DECIMAL(18,2) AS amount FROM p, (VALUES (1), (2), (3)) v(r)")
def sap_rows(spark, d):
    return M.sap_rows(journal_entries(spark, d))


@query("K10_upsert_transactions", INV + ", n AS (SELECT * FROM invoices WHERE total IS NOT NULL) SELECT invoice_id::VARCHAR AS doc_number, supplier_eik AS partner_eik, CASE WHEN invoice_id % 2 = 0 THEN tax_base + 1 ELSE tax_base END::DECIMAL(18,2) AS tax_base, CASE WHEN invoice_id % 2 = 0 THEN vat + 1 ELSE vat END::DECIMAL(18,2) AS vat, CASE WHEN invoice_id % 2 = 0 THEN total + 2 ELSE total END::DECIMAL(18,2) AS total, CASE WHEN invoice_id % 6 <> 0 THEN 'old' ELSE 'new' END AS reason, CASE WHEN invoice_id % 6 <> 0 THEN 0 ELSE 2 END AS seq FROM n")
def upsert_transactions(spark, d):
    """Two new versions of every second operation; every sixth operation is unknown so far."""
    inv, k = A.invoices(spark, d).where("total IS NOT NULL"), F.col("invoice_id")
    ops = lambda df, plus, reason, seq: df.select(k.cast("string").alias("doc_number"), F.col("supplier_eik").alias("partner_eik"), *((F.col(c) + plus * n).cast(M.MONEY).alias(c) for c, n in (("tax_base", 1), ("vat", 1), ("total", 2))), F.lit(reason).alias("reason"), F.lit(seq).alias("seq"))
    new = inv.where("invoice_id % 2 = 0")
    return M.upsert_transactions(ops(new, 5, "newer", 1).unionByName(ops(new, 1, "new", 2)), ops(inv.where("invoice_id % 6 <> 0"), 0, "old", 0))


@query("L03_persist_learned_rules", f"WITH {PART} SELECT eik, CASE WHEN partner_id % 2 = 0 THEN '602' ELSE '304' END AS account, CASE WHEN partner_id % 2 = 0 THEN 'r2' ELSE 'base' END AS reason, CASE WHEN partner_id % 2 = 1 THEN 'kept' WHEN partner_id % 3 = 0 THEN 'overwritten' ELSE 'added' END AS change FROM partners")
def persist_learned_rules(spark, d):
    p, k = A.partners(spark, d), F.col("partner_id")
    rule = lambda account, reason, seq, eik: p.where("partner_id % 2 = 0").select(eik.alias("eik"), F.lit(account).alias("account"), F.lit(reason).alias("reason"), F.lit(seq).alias("seq"))
    rules = rule("601", "r1", 1, F.col("eik")).unionByName(rule("602", "r2", 2, F.col("eik"))).unionByName(rule("999", "short", 3, F.left("eik", F.lit(8))))
    return M.persist_learned_rules(rules, p.where((k % 3 == 0) | (k % 2 == 1)).select("eik", F.lit("304").alias("account"), F.lit("base").alias("reason")))
