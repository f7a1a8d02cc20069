"""Ledger queries over the invoice adapters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import ledgers as L
from ..sources import adapters as A
from .registry import query

RATE = "1.95583::DECIMAL(6,5)"
CUR = "CASE WHEN coalesce(currency, '') <> '' THEN upper(left(currency, 3)) WHEN date_issued >= DATE '2026-01-01' THEN 'EUR' ELSE 'BGN' END"
@query("I01_reconcile_amounts", f"""WITH {A.DUCK_INVOICES},
g AS (SELECT invoice_id, CASE WHEN invoice_id % 5 <> 1 THEN tax_base END AS tax_base, CASE WHEN invoice_id % 5 <> 2 THEN vat END AS vat, CASE WHEN invoice_id % 5 <> 3 THEN total END AS total, date_tax_event, date_issued FROM invoices)
SELECT invoice_id, CASE WHEN tax_base IS NULL AND vat IS NOT NULL AND total IS NOT NULL THEN (total - vat)::DECIMAL(18,2) ELSE tax_base END AS tax_base,
  CASE WHEN vat IS NULL AND tax_base IS NOT NULL AND total IS NOT NULL AND abs((total - tax_base) - round(tax_base * 0.20::DECIMAL(3,2), 2)) <= 0.02 THEN (total - tax_base)::DECIMAL(18,2) ELSE vat END AS vat,
  CASE WHEN total IS NULL AND tax_base IS NOT NULL AND vat IS NOT NULL THEN (tax_base + vat)::DECIMAL(18,2) ELSE total END AS total, coalesce(date_tax_event, date_issued) AS effective_date FROM g""")
def reconcile(spark, d):
    inv = A.invoices(spark, d)
    for i, c in ((1, "tax_base"), (2, "vat"), (3, "total")):
        inv = inv.withColumn(c, F.when(F.col("invoice_id") % 5 != i, F.col(c)))
    return L.reconcile_amounts(inv).select("invoice_id", "tax_base", "vat", "total", "effective_date")


_OPS = f"""WITH {A.DUCK_INVOICES},
m AS (SELECT *, CASE WHEN payment_method = 'CASH' THEN '501' WHEN is_sale THEN '411' ELSE '401' END AS acc, CASE WHEN is_credit_note THEN -1 ELSE 1 END AS sgn, CASE WHEN is_sale THEN 1 ELSE -1 END AS oth, CASE WHEN invoice_id % 103 = 0 THEN 0 ELSE tax_base END AS tb, CASE WHEN invoice_id % 103 = 0 THEN 0 ELSE vat END AS va, invoice_id % 103 = 0 AND is_sale AS none FROM invoices),
ops AS (
 SELECT invoice_id, period, is_sale, is_credit_note, 1 AS line, 'D' AS direction, CASE WHEN is_sale THEN acc ELSE '304' END AS account, (tb * sgn)::DECIMAL(18,2) AS amount FROM m WHERE tb > 0 OR none
 UNION ALL SELECT invoice_id, period, is_sale, is_credit_note, 1, 'K', CASE WHEN is_sale THEN '702' ELSE acc END, (tb * sgn * oth)::DECIMAL(18,2) FROM m WHERE tb > 0 OR none
 UNION ALL SELECT invoice_id, period, is_sale, is_credit_note, 2, 'D', CASE WHEN is_sale THEN acc ELSE '4531' END, (va * sgn)::DECIMAL(18,2) FROM m WHERE va > 0
 UNION ALL SELECT invoice_id, period, is_sale, is_credit_note, 2, 'K', CASE WHEN is_sale THEN '4532' ELSE acc END, (va * sgn * oth)::DECIMAL(18,2) FROM m WHERE va > 0)"""
_BAL = ", bal AS (SELECT invoice_id, coalesce(sum(abs(amount)) FILTER (direction = 'D'), 0)::DECIMAL(18,2) AS debit, coalesce(sum(abs(amount)) FILTER (direction = 'K'), 0)::DECIMAL(18,2) AS credit FROM ops2 GROUP BY 1)"
_DROP = ", ops2 AS (SELECT * FROM ops WHERE NOT (direction = 'K' AND invoice_id % 101 = 0))"


def _ops(spark, d):
    return L.to_operations(A.invoices(spark, d).withColumn("is_annulled", F.col("invoice_id") % 103 == 0))


def _broken(df, side):
    return df.where(~(side & (F.col("invoice_id") % 101 == 0)))


@query("I07_operations", _OPS + " SELECT * FROM ops")
def operations(spark, d):
    return _ops(spark, d)


_JOURNAL = f"""WITH {A.DUCK_VAT},
x AS (SELECT *, CASE WHEN is_credit_note AND doc_kind NOT IN ('FISCAL_MEMORY_REPORT', 'GOODS_RECEIPT') THEN -1 ELSE 1 END AS sg, abs(coalesce(tax_base, 0)) AS b0, abs(coalesce(vat, 0)) AS v0, abs(coalesce(CASE invoice_id % 5 WHEN 0 THEN 0 WHEN 1 THEN total + 0.01 WHEN 2 THEN total + 5 ELSE total END, 0))::DECIMAL(18,2) AS t0 FROM vinv),
y AS (SELECT *, sg * b0 AS b, sg * v0 AS v, sg * t0 AS t FROM x),
z AS (SELECT invoice_id, doc_kind, sg, CASE doc_kind WHEN 'GOODS_RECEIPT' THEN t WHEN 'FISCAL_MEMORY_REPORT' THEN CASE WHEN b = 0 AND v <> 0 AND t <> 0 THEN t - v ELSE b END
   ELSE CASE WHEN t = 0 AND b + v <> 0 THEN b WHEN b = 0 AND t <> 0 AND v = 0 THEN t WHEN abs(b + v - t) <= 0.02 THEN b WHEN v <> 0 THEN t - v ELSE t END END::DECIMAL(18,2) AS entry_base,
  CASE doc_kind WHEN 'GOODS_RECEIPT' THEN 0 ELSE v END::DECIMAL(18,2) AS entry_vat,
  CASE doc_kind WHEN 'GOODS_RECEIPT' THEN t WHEN 'FISCAL_MEMORY_REPORT' THEN CASE WHEN t <> 0 AND b = 0 AND v <> 0 THEN t ELSE b + v END ELSE CASE WHEN t = 0 AND b + v <> 0 THEN b + v WHEN abs(b + v - t) <= 0.02 THEN b + v ELSE t END END::DECIMAL(18,2) AS entry_total FROM y),
w AS (SELECT *, right('0000000000' || invoice_id::VARCHAR, 10) AS doc_number, entry_base + entry_vat = entry_total AS is_balanced, sg = -1 AS is_storno FROM z)
SELECT invoice_id, doc_number, entry_base, entry_vat, entry_total, is_balanced, is_storno, 1 AS line, CASE doc_kind WHEN 'FISCAL_MEMORY_REPORT' THEN '501' WHEN 'GOODS_RECEIPT' THEN '304' ELSE CASE WHEN invoice_id % 2 = 0 THEN '602' ELSE '304' END END AS debit_account, CASE doc_kind WHEN 'FISCAL_MEMORY_REPORT' THEN '702' ELSE '401' END AS credit_account, entry_base AS amount
  FROM w WHERE doc_kind IN ('FISCAL_MEMORY_REPORT', 'GOODS_RECEIPT') OR entry_base <> 0
UNION ALL SELECT invoice_id, doc_number, entry_base, entry_vat, entry_total, is_balanced, is_storno, 2, CASE doc_kind WHEN 'FISCAL_MEMORY_REPORT' THEN '501' ELSE '4531' END, CASE doc_kind WHEN 'FISCAL_MEMORY_REPORT' THEN '4532' ELSE '401' END, entry_vat
  FROM w WHERE doc_kind = 'FISCAL_MEMORY_REPORT' OR (doc_kind <> 'GOODS_RECEIPT' AND entry_vat <> 0)"""


@query("I06_journal_entries", _JOURNAL)
def journal_entries(spark, d):
    """Totals that are missing, off by a cent, or off by five."""
    k = F.col("invoice_id")
    total = F.when(k % 5 == 0, 0).when(k % 5 == 1, F.col("total") + F.expr("0.01BD")).when(k % 5 == 2, F.col("total") + 5).otherwise(F.col("total")).cast("decimal(18,2)")
    return L.to_journal_entries(A.vat_invoices(spark, d).withColumns({"total": total, "account": F.when(k % 2 == 0, "602").otherwise("304")}))


_ITEM_TEXT = "texts AS (SELECT invoice_id, string_agg(description, ' ' ORDER BY line_no, description) AS items FROM lines GROUP BY 1)"


def _item_texts(spark, d):
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "description"))), lambda x: x["description"]), " ")
    return A.invoice_lines(spark, d).groupBy("invoice_id").agg(listed.alias("items"))


@query("I08_expense_account", f"""WITH {A.DUCK_INVOICES}, {_ITEM_TEXT} SELECT invoice_id, CASE WHEN supplier_id % 7 = 0 THEN '609' WHEN contains(items, 'widget') THEN '602' WHEN contains(items, 'bolt') OR contains(items, 'gear') THEN '601' ELSE '304' END AS account,
  CASE WHEN supplier_id % 7 = 0 THEN 'known' WHEN contains(items, 'widget') THEN 'services' WHEN contains(items, 'bolt') OR contains(items, 'gear') THEN 'materials' ELSE 'стоки' END AS reason FROM invoices LEFT JOIN texts USING (invoice_id)""")
def expense_account(spark, d):
    known = A.table(spark, d, "supplier").where("s_suppkey % 7 = 0").select(A.eik_of(F.col("s_suppkey")).alias("eik"), F.lit("609").alias("account"), F.lit("known").alias("reason"))
    inv = A.invoices(spark, d).select("invoice_id", F.concat(F.lit("BG "), "supplier_eik").alias("supplier_eik")).join(_item_texts(spark, d), "invoice_id", "left")
    return L.expense_account(inv, known, ((("widget",), "602", "services"), (("bolt", "gear"), "601", "materials"))).select("invoice_id", "account", "reason")


@query("I09_service_or_goods", f"WITH {A.DUCK_INVOICES}, {_ITEM_TEXT} SELECT invoice_id, CASE WHEN contains(items, 'widget') OR supplier_id % 10 = 3 THEN '602' ELSE '304' END AS account FROM invoices LEFT JOIN texts USING (invoice_id)")
def service_or_goods(spark, d):
    inv = A.invoices(spark, d).select("invoice_id", F.when(F.col("supplier_id") % 10 == 3, "Cleaning Service 3").alias("supplier_name")).join(_item_texts(spark, d), "invoice_id", "left")
    return L.service_or_goods(inv, ("service", "widget")).select("invoice_id", "account")


@query("I11_direction", f"WITH {A.DUCK_INVOICES} SELECT invoice_id, CASE WHEN recipient_id % 5 = 0 THEN 'PURCHASE' WHEN supplier_id % 3 = 0 THEN 'SALE' ELSE 'PURCHASE' END AS direction FROM invoices")
def direction(spark, d):
    clients = A.table(spark, d, "customer").where("c_custkey % 5 = 0").select(A.eik_of(F.col("c_custkey") + 5000000).alias("eik"))
    clients = clients.unionByName(A.table(spark, d, "supplier").where("s_suppkey % 3 = 0").select(A.eik_of(F.col("s_suppkey")).alias("eik")))
    return L.direction(A.invoices(spark, d), clients).select("invoice_id", "direction")


@query("E11_operation_balance", _OPS + _DROP + _BAL + " SELECT *, debit = credit AS balanced FROM bal")
def operation_balance(spark, d):
    return L.operation_balance(_broken(_ops(spark, d), F.col("direction") == "K"))


@query("E18_journal_summary", _OPS + _DROP + _BAL + """, st AS (SELECT invoice_id, bool_or(is_credit_note) AS storno FROM ops2 GROUP BY 1)
SELECT count(*) AS n_documents, sum(debit)::DECIMAL(18,2) AS debit, sum(credit)::DECIMAL(18,2) AS credit, bool_and(debit = credit) AS all_balanced, count(*) FILTER (storno) AS n_storno FROM bal JOIN st USING (invoice_id)""")
def journal_summary(spark, d):
    return L.journal_summary(_broken(_ops(spark, d), F.col("direction") == "K"))


_TR = f"""WITH {A.DUCK_INVOICES},
n AS (SELECT *, 1000 + row_number() OVER (ORDER BY invoice_id) AS kon_id, CASE WHEN is_credit_note THEN -1 ELSE 1 END AS sgn, CASE WHEN is_sale THEN 1 ELSE -1 END AS oth FROM invoices WHERE tax_base IS NOT NULL),
tr AS (SELECT kon_id, invoice_id, is_sale, 1 AS kon, 2 AS is_kredit, CASE WHEN is_sale THEN '411' ELSE '304' END AS account, (tax_base * sgn)::DECIMAL(18,2) AS amount, false AS is_vat FROM n
 UNION ALL SELECT kon_id, invoice_id, is_sale, 1, 1, CASE WHEN is_sale THEN '702' ELSE '401' END, (tax_base * sgn * oth)::DECIMAL(18,2), false FROM n
 UNION ALL SELECT kon_id, invoice_id, is_sale, 2, 2, CASE WHEN is_sale THEN '411' ELSE '453' END, (vat * sgn)::DECIMAL(18,2), true FROM n WHERE vat <> 0
 UNION ALL SELECT kon_id, invoice_id, is_sale, 2, 1, CASE WHEN is_sale THEN '453' ELSE '401' END, (vat * sgn * oth)::DECIMAL(18,2), true FROM n WHERE vat <> 0),
tb AS (SELECT * FROM tr WHERE NOT (is_kredit = 1 AND invoice_id % 101 = 0))"""


def _transfer(spark, d):
    return L.transfer_rows(A.invoices(spark, d))


@query("I13_transfer_rows", _TR + " SELECT * FROM tr")
def transfer_rows(spark, d):
    return _transfer(spark, d)


@query("F13_number_operations", f"WITH {A.DUCK_INVOICES} SELECT invoice_id, 1000 + row_number() OVER (ORDER BY invoice_id) AS kon_id FROM invoices")
def number_operations(spark, d):
    return L.number_operations(A.invoices(spark, d).select("invoice_id"))


@query("E12_ledger_balance", _TR + """, g AS (SELECT kon_id, kon, coalesce(sum(amount) FILTER (is_kredit = 2), 0)::DECIMAL(18,2) AS debit, coalesce(sum(amount) FILTER (is_kredit = 1), 0)::DECIMAL(18,2) AS credit FROM tb GROUP BY ALL)
SELECT *, abs(debit + credit) < 0.01 OR abs(abs(debit) - abs(credit)) < 0.01 AS balanced FROM g""")
def ledger_balance(spark, d):
    return L.ledger_balance(_broken(_transfer(spark, d), F.col("is_kredit") == 1))


@query("E13_trial_balance", _TR + """, g AS (SELECT account, coalesce(sum(abs(amount)) FILTER (is_kredit = 2), 0)::DECIMAL(18,2) AS debit, coalesce(sum(abs(amount)) FILTER (is_kredit = 1), 0)::DECIMAL(18,2) AS credit FROM tb GROUP BY ALL)
SELECT *, (debit - credit)::DECIMAL(18,2) AS balance FROM g""")
def trial_balance(spark, d):
    return L.trial_balance(_broken(_transfer(spark, d), F.col("is_kredit") == 1))


@query("E14_operations_from_rows", _TR + """ SELECT kon_id, coalesce(sum(abs(amount)) FILTER (is_kredit = 2 AND NOT (is_vat OR starts_with(account, '453'))), 0)::DECIMAL(18,2) AS base,
  coalesce(sum(abs(amount)) FILTER (is_kredit = 2 AND (is_vat OR starts_with(account, '453'))), 0)::DECIMAL(18,2) AS vat,
  coalesce(sum(abs(amount)) FILTER (is_kredit = 1 AND account IN ('501', '401', '503')), sum(abs(amount)) FILTER (is_kredit = 2), 0)::DECIMAL(18,2) AS total, arg_min(account, kon * 10 + is_kredit) AS first_account FROM tb GROUP BY kon_id""")
def operations_from_rows(spark, d):
    return L.operations_from_rows(_broken(_transfer(spark, d), F.col("is_kredit") == 1))


_TP = f"""WITH {A.DUCK_INVOICES}, o AS (SELECT invoice_id, ((left(period, 4)::INT - year(date_tax_event)) * 12 + right(period, 2)::INT - month(date_tax_event) - CASE WHEN invoice_id % 50 = 0 THEN 20 ELSE 0 END)::INT AS month_offset FROM
  (SELECT *, CASE WHEN invoice_id % 50 = 0 THEN period ELSE period END AS p FROM invoices)),
tp AS (SELECT invoice_id, month_offset, CASE WHEN month_offset < 0 THEN 'future' WHEN month_offset = 0 THEN 'current' WHEN month_offset <= 12 THEN 'prior' ELSE 'expired' END AS status FROM o)"""


def _checked(spark, d):
    inv = A.invoices(spark, d)
    inv = inv.withColumn("date_tax_event", F.when(F.col("invoice_id") % 50 == 0, F.add_months("date_tax_event", 20)).otherwise(F.col("date_tax_event")))
    return L.tax_period_check(inv, F.col("period"))


@query("I14_tax_period_check", _TP + " SELECT *, CASE status WHEN 'future' THEN 0 WHEN 'expired' THEN 16 ELSE 10 END AS cell, CASE status WHEN 'future' THEN 'ERROR' WHEN 'expired' THEN 'WARNING' ELSE 'INFO' END AS severity FROM tp")
def tax_period_check(spark, d):
    return _checked(spark, d)


@query("E17_tax_period_summary", _TP + " SELECT count(*) AS n, count(*) FILTER (status = 'current') AS n_current, count(*) FILTER (status = 'prior') AS n_prior, count(*) FILTER (status = 'expired') AS n_expired, count(*) FILTER (status = 'future') AS n_future, count(*) FILTER (status = 'future') = 0 AS batch_valid FROM tp")
def tax_period_summary(spark, d):
    return L.tax_period_summary(_checked(spark, d))


@query("I15_service_item", f"WITH {A.DUCK_INVOICES} SELECT invoice_id, 'service' AS description, 1::DECIMAL(18,3) AS quantity, (((printed_total * 100)::BIGINT * 10 + 6) // 12 * 0.01::DECIMAL(3,2))::DECIMAL(18,2) AS net FROM invoices WHERE n_lines IS NULL")
def service_item(spark, d):
    return L.service_item(A.invoices(spark, d))


@query("I16_dual_totals", f"WITH {A.DUCK_INVOICES}, c AS (SELECT *, {CUR} AS cur FROM invoices) SELECT invoice_id, cur AS currency, CASE WHEN cur = 'EUR' THEN total ELSE round(total / 1.95583, 2)::DECIMAL(18,2) END AS total_eur, CASE WHEN cur = 'EUR' THEN round(total * {RATE}, 2)::DECIMAL(18,2) ELSE total END AS total_bgn FROM c")
def dual_totals(spark, d):
    return L.dual_totals(A.invoices(spark, d))


@query("I17_scale_integer_totals", f"""WITH {A.DUCK_INVOICES}, x AS (SELECT invoice_id, CASE WHEN invoice_id % 4 = 0 THEN (tax_base * 100)::DECIMAL(18,2) ELSE tax_base END AS tax_base, CASE WHEN invoice_id % 4 = 0 THEN (vat * 100)::DECIMAL(18,2) ELSE vat END AS vat,
  CASE WHEN invoice_id % 4 = 0 THEN (total * 100)::DECIMAL(18,2) ELSE total END AS total, tax_base AS items FROM invoices),
h AS (SELECT *, coalesce(tax_base % 1 = 0 AND abs(tax_base - items * 100) <= 5, false) AS scaled FROM x)
SELECT invoice_id, scaled, CASE WHEN scaled THEN round(tax_base * 0.01::DECIMAL(3,2), 2)::DECIMAL(18,2) ELSE tax_base END AS tax_base, CASE WHEN scaled THEN round(vat * 0.01::DECIMAL(3,2), 2)::DECIMAL(18,2) ELSE vat END AS vat, CASE WHEN scaled THEN round(total * 0.01::DECIMAL(3,2), 2)::DECIMAL(18,2) ELSE total END AS total FROM h""")
def scale_integer_totals(spark, d):
    inv = A.invoices(spark, d).select("invoice_id", *(F.when(F.col("invoice_id") % 4 == 0, F.col(c) * 100).otherwise(F.col(c)).cast("decimal(18,2)").alias(c) for c in ("tax_base", "vat", "total")))
    return L.scale_integer_totals(inv, A.invoice_lines(spark, d))


@query("E10_split_by_account", f"""WITH {A.DUCK_INVOICES}, a AS (SELECT l.*, i.tax_base + CASE WHEN l.invoice_id % 9 = 0 THEN 0.01 ELSE 0 END AS tb, CASE WHEN contains(l.description, 'widget') THEN '601' WHEN contains(l.description, 'bolt') THEN '602' ELSE '304' END AS account FROM lines l JOIN invoices i USING (invoice_id)),
g AS (SELECT invoice_id, account, vat_rate, sum(net)::DECIMAL(18,2) AS net, sum(vat)::DECIMAL(18,2) AS vat, count(*) AS n_items, first(tb) AS tb FROM a GROUP BY ALL),
ds AS (SELECT invoice_id, account, vat_rate, list_slice(list(description ORDER BY line_no, description), 1, 2) AS descriptions FROM (SELECT invoice_id, account, vat_rate, description, min(line_no) AS line_no FROM a GROUP BY ALL) GROUP BY ALL),
r AS (SELECT *, tb - sum(net) OVER (PARTITION BY invoice_id) AS rest, row_number() OVER (PARTITION BY invoice_id ORDER BY net DESC, account, vat_rate) AS rk FROM g)
SELECT invoice_id, account, vat_rate, (net + CASE WHEN rk = 1 THEN rest ELSE 0 END)::DECIMAL(18,2) AS net, vat, n_items, descriptions FROM r JOIN ds USING (invoice_id, account, vat_rate)""")
def split_by_account(spark, d):
    inv = A.invoices(spark, d).select("invoice_id", (F.col("tax_base") + F.when(F.col("invoice_id") % 9 == 0, F.expr("0.01BD")).otherwise(0)).cast("decimal(18,2)").alias("tax_base"))
    account = F.when(F.contains("description", F.lit("widget")), "601").when(F.contains("description", F.lit("bolt")), "602").otherwise("304")
    return L.split_by_account(A.invoice_lines(spark, d).join(inv, "invoice_id"), account)


@query("K07_operation_pairs", _OPS + _DROP + ", g AS (SELECT invoice_id, line, max(account) FILTER (direction = 'D') AS debit_account, max(account) FILTER (direction = 'K') AS credit_account, max(amount) FILTER (direction = 'D') AS amount FROM ops2 GROUP BY ALL) SELECT * FROM g WHERE debit_account IS NOT NULL AND credit_account IS NOT NULL")
def operation_pairs(spark, d):
    from ..operators.sinks import operation_pairs as pairs

    return pairs(_broken(_ops(spark, d), F.col("direction") == "K"))
