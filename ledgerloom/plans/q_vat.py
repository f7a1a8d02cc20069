"""Queries of the VAT books. The SQL is written from the statute's cells and the files' layouts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import vat as V
from ..sources import adapters as A
from .registry import query

RATE = "1.95583::DECIMAL(6,5)"
#: The filer of the registered queries.
COMPANY = {"ЕИК": "203456789", "ДДС_НОМЕР": "BG203456789", "ИМЕ": "Пример ООД", "АДРЕС": "ул. Първа 1", "ГРАД": "София", "ПК": "1000", "МОЛ": "И. Иванов"}


def _signed(total: str) -> str:
    """Amounts in leva. Another currency follows the total in leva if there is one: c * total_bgn / total, half up, in whole cents."""
    scaled = lambda c: f"(((2 * (abs({c}) * 100)::HUGEINT * (total_bgn * 100)::HUGEINT + (abs(total) * 100)::HUGEINT) // (2 * (abs(total) * 100)::HUGEINT)) * 0.01::DECIMAL(3,2))"
    amount = lambda c: f"CASE currency WHEN 'EUR' THEN round(abs(coalesce({c}, 0))::DECIMAL(18,2) * {RATE}, 2) WHEN 'BGN' THEN abs(coalesce({c}, 0)) ELSE CASE WHEN total_bgn > 0 AND total <> 0 THEN {scaled(c)} ELSE abs(coalesce({c}, 0)) END END"
    return f"""
sg AS (SELECT *, right('0000000000' || invoice_id::VARCHAR, 10) AS number, CASE WHEN is_credit_note THEN -1 ELSE 1 END AS sgn,
  (({total}) * CASE WHEN is_credit_note THEN -1 ELSE 1 END)::DECIMAL(18,2) AS t, (({amount('tax_base')}) * CASE WHEN is_credit_note THEN -1 ELSE 1 END)::DECIMAL(18,2) AS b,
  (({amount('vat')}) * CASE WHEN is_credit_note THEN -1 ELSE 1 END)::DECIMAL(18,2) AS v FROM vinv)"""


_T = f"CASE currency WHEN 'EUR' THEN {{eur}} WHEN 'BGN' THEN abs(coalesce(total, 0)) ELSE CASE WHEN total_bgn > 0 THEN total_bgn ELSE abs(coalesce(total, 0)) END END"
_EUR = f"round(abs(coalesce(total, 0))::DECIMAL(18,2) * {RATE}, 2)"
_CODE = "CASE WHEN is_credit_note THEN '03' ELSE CASE doc_kind WHEN 'CUSTOMS_DECLARATION' THEN '07' WHEN 'GOODS_RECEIPT' THEN '00' WHEN 'FISCAL_MEMORY_REPORT' THEN '81' ELSE '01' END END"
PURCHASES = _signed(_T.format(eur=f"CASE WHEN total_bgn > 0 THEN total_bgn ELSE {_EUR} END")).replace("sg AS", "sp AS") + f""",
pk AS (SELECT *, CASE WHEN v = 0 AND b <> 0 THEN 'none' WHEN coalesce(has_9, false) OR (abs(b) > 0.01 AND abs(v) * 100 BETWEEN abs(b) * 8 AND abs(b) * 10) THEN 'nine' ELSE 'full' END AS k FROM sp WHERE NOT is_sale AND doc_kind NOT IN ('FISCAL_MEMORY_REPORT', 'GOODS_RECEIPT')),
purchases AS (SELECT invoice_id, period, {_CODE} AS doc_type, number AS doc_number, date_issued AS doc_date, coalesce(supplier_eik, '999999999') AS contractor_id, coalesce(supplier_name, 'НЕИЗВЕСТЕН ДОСТАВЧИК') AS contractor_name,
  coalesce(note, 'Стоки / Услуги') AS description, t AS total_amount, (CASE WHEN k = 'full' THEN b ELSE 0 END)::DECIMAL(18,2) AS tax_base_20, (CASE WHEN k = 'full' THEN v ELSE 0 END)::DECIMAL(18,2) AS vat_20,
  (CASE WHEN k = 'nine' THEN b ELSE 0 END)::DECIMAL(18,2) AS tax_base_9, (CASE WHEN k = 'nine' THEN v ELSE 0 END)::DECIMAL(18,2) AS vat_9, 0::DECIMAL(18,2) AS tax_base_partial, 0::DECIMAL(18,2) AS vat_partial,
  (CASE WHEN k = 'none' THEN b ELSE 0 END)::DECIMAL(18,2) AS tax_base_no_credit, 0::DECIMAL(18,2) AS vat_special_art82 FROM pk)"""
SALES = _signed(_T.format(eur=_EUR)).replace("sg AS", "ss AS") + f""",
sk AS (SELECT *, doc_kind = 'FISCAL_MEMORY_REPORT' AS rep, CASE WHEN v = 0 AND b <> 0 THEN 'none' WHEN coalesce(has_9, false) THEN 'nine' ELSE 'full' END AS k FROM ss WHERE is_sale AND doc_kind <> 'GOODS_RECEIPT'),
sales AS (SELECT invoice_id, period, CASE WHEN rep THEN '81' ELSE {_CODE} END AS doc_type, number AS doc_number, date_issued AS doc_date, CASE WHEN rep THEN '999999999999999' ELSE coalesce(recipient_eik, '999999999') END AS contractor_id,
  CASE WHEN rep THEN 'ФИЗИЧЕСКИ ЛИЦА / СВОДЕН КАСОВ ОТЧЕТ' ELSE coalesce(recipient_name, 'НЕИЗВЕСТЕН КЛИЕНТ') END AS contractor_name, CASE WHEN rep THEN 'Отчет продажби по чл. 119 ЗДДС' ELSE coalesce(note, 'Стоки / Услуги') END AS description, t AS total_amount,
  (CASE WHEN k = 'full' THEN b ELSE 0 END)::DECIMAL(18,2) AS tax_base_20, (CASE WHEN k = 'full' THEN v ELSE 0 END)::DECIMAL(18,2) AS vat_20, 0::DECIMAL(18,2) AS tax_base_vop, 0::DECIMAL(18,2) AS vat_vop, 0::DECIMAL(18,2) AS tax_base_art82, 0::DECIMAL(18,2) AS vat_art82,
  (CASE WHEN k = 'nine' THEN b ELSE 0 END)::DECIMAL(18,2) AS tax_base_9, (CASE WHEN k = 'nine' THEN v ELSE 0 END)::DECIMAL(18,2) AS vat_9, 0::DECIMAL(18,2) AS tax_base_chapter3, 0::DECIMAL(18,2) AS tax_base_art69,
  (CASE WHEN k = 'none' THEN b ELSE 0 END)::DECIMAL(18,2) AS tax_base_exempt FROM sk)"""
FLAGS = """
flags AS (SELECT *, CASE WHEN left(supplier_vat, 2) <> 'BG' AND coalesce(vat, 0) = 0 THEN 'foreign' WHEN contains(note, '(ВОП)') OR contains(note, 'reverse charge') THEN 'clause' END AS reason FROM vinv)"""
PROTOCOLS = FLAGS + f""",
p0 AS (SELECT *, CASE currency WHEN 'EUR' THEN round(base0 * {RATE}, 2)::DECIMAL(18,2) ELSE base0 END AS base FROM (SELECT *, (CASE WHEN coalesce(tax_base, 0) <> 0 THEN tax_base ELSE coalesce(total, 0) END)::DECIMAL(18,2) AS base0 FROM flags WHERE NOT is_sale AND reason IS NOT NULL)),
protocols AS (SELECT invoice_id, period, lpad(row_number() OVER (PARTITION BY period ORDER BY invoice_id)::VARCHAR, 10, '0') AS protocol, date_issued AS protocol_date, coalesce(supplier_name, 'НЕИЗВЕСТЕН ДОСТАВЧИК') AS supplier_name,
  coalesce(supplier_vat, supplier_eik, 'EU999999999') AS supplier_vat, left(coalesce(supplier_vat, 'IE'), 2) AS country, right('0000000000' || invoice_id::VARCHAR, 10) AS original_number,
  CASE WHEN contains(note, 'ВОП') THEN 'VOP_GOODS' ELSE 'REVERSE_CHARGE_SERVICE' END AS kind, CASE WHEN contains(note, 'ВОП') THEN 'чл. 84 от ЗДДС (ВОП)' ELSE 'чл. 82, ал. 2, т. 3 от ЗДДС (доставка на услуги)' END AS ground,
  base, round(base * 0.20::DECIMAL(3,2), 2)::DECIMAL(18,2) AS vat, (base + round(base * 0.20::DECIMAL(3,2), 2))::DECIMAL(18,2) AS total, true AS full_credit FROM p0)"""
_PHEAD = "invoice_id, period, '09' AS doc_type, protocol AS doc_number, protocol_date AS doc_date, supplier_vat AS contractor_id, supplier_name AS contractor_name, 'Прот.117 ф-ра ' || original_number AS description, total AS total_amount"
PROTOCOL_ROWS = f"""
p_buy AS (SELECT {_PHEAD}, base AS tax_base_20, vat AS vat_20, 0::DECIMAL(18,2) AS tax_base_9, 0::DECIMAL(18,2) AS vat_9, 0::DECIMAL(18,2) AS tax_base_partial, 0::DECIMAL(18,2) AS vat_partial, 0::DECIMAL(18,2) AS tax_base_no_credit, vat AS vat_special_art82 FROM protocols),
p_sell AS (SELECT {_PHEAD}, 0::DECIMAL(18,2) AS tax_base_20, 0::DECIMAL(18,2) AS vat_20, (CASE WHEN kind = 'VOP_GOODS' THEN base ELSE 0 END)::DECIMAL(18,2) AS tax_base_vop, (CASE WHEN kind = 'VOP_GOODS' THEN vat ELSE 0 END)::DECIMAL(18,2) AS vat_vop,
  (CASE WHEN kind = 'VOP_GOODS' THEN 0 ELSE base END)::DECIMAL(18,2) AS tax_base_art82, (CASE WHEN kind = 'VOP_GOODS' THEN 0 ELSE vat END)::DECIMAL(18,2) AS vat_art82, 0::DECIMAL(18,2) AS tax_base_9, 0::DECIMAL(18,2) AS vat_9, 0::DECIMAL(18,2) AS tax_base_chapter3, 0::DECIMAL(18,2) AS tax_base_art69, 0::DECIMAL(18,2) AS tax_base_exempt FROM protocols)"""
BOOKS = f"WITH {A.DUCK_VAT}, {PURCHASES}, {SALES}, {PROTOCOLS}, {PROTOCOL_ROWS}, buys AS (SELECT * FROM purchases UNION ALL SELECT * FROM p_buy), sells AS (SELECT * FROM sales UNION ALL SELECT * FROM p_sell)"


def _return(buys: str = "buys", coefficient: str = "1.00", prior: str = "0") -> str:
    return f"""
s AS (SELECT period, sum(tax_base_20) AS c11, sum(vat_20) AS c12, sum(tax_base_vop) AS c13, sum(vat_vop) AS c14, sum(tax_base_art82) AS c15, sum(vat_art82) AS c16, sum(tax_base_9) AS c17, sum(vat_9) AS c18, sum(tax_base_chapter3) AS c19, sum(tax_base_exempt) AS c24, count(*) AS n_sales FROM sells GROUP BY period),
p AS (SELECT period, sum(tax_base_20 + tax_base_9) AS c31, sum(tax_base_partial) AS c32, sum(tax_base_no_credit) AS none, sum(vat_20 + vat_9) AS c40, sum(vat_partial) AS c41, count(*) AS n_purchases FROM {buys} GROUP BY period),
d0 AS (SELECT period, {', '.join(f"coalesce({c}, 0)::DECIMAL(18,2) AS {c}" for c in ('c11', 'c12', 'c13', 'c14', 'c15', 'c16', 'c17', 'c18', 'c19', 'c24', 'c31', 'c32', 'none', 'c40', 'c41'))}, coalesce(n_sales, 0)::BIGINT AS n_sales, coalesce(n_purchases, 0)::BIGINT AS n_purchases FROM s FULL JOIN p USING (period)),
d1 AS (SELECT *, (c11 + c13 + c15 + c17 + c19 + c24)::DECIMAL(18,2) AS c01, (c12 + c14 + c16 + c18)::DECIMAL(18,2) AS c20, (c31 + c32 + none)::DECIMAL(18,2) AS c30, {coefficient}::DECIMAL(4,2) AS c42, (c40 + round(c41 * {coefficient}::DECIMAL(4,2), 2))::DECIMAL(18,2) AS c43, {prior}::DECIMAL(18,2) AS c70 FROM d0),
d2 AS (SELECT *, greatest(c20 - c43, 0)::DECIMAL(18,2) AS c50, greatest(c43 - c20, 0)::DECIMAL(18,2) AS c60 FROM d1),
decl AS (SELECT period, c01, c11, c12, c13, c14, c15, c16, c17, c18, c19, c20, c24, c30, c31, c32, c40, c41, c42, c43, c50, c60, c70, greatest(c50 - c70, 0)::DECIMAL(18,2) AS c80, n_sales, n_purchases FROM d2)"""


def _split(spark, d):
    inv = A.vat_invoices(spark, d)
    return inv.where("NOT is_sale"), inv.where("is_sale")


def _books(spark, d):
    buys, sells = _split(spark, d)
    return V.ledger_union(V.to_purchase_ledger(buys), V.to_sales_ledger(sells), V.protocols_117(buys))


@query("I02_purchase_ledger", f"WITH {A.DUCK_VAT}, {PURCHASES} SELECT * FROM purchases")
def purchase_ledger(spark, d):
    return V.to_purchase_ledger(_split(spark, d)[0])


@query("I03_sales_ledger", f"WITH {A.DUCK_VAT}, {SALES} SELECT * FROM sales")
def sales_ledger(spark, d):
    return V.to_sales_ledger(_split(spark, d)[1])


@query("C10_reverse_charge", f"WITH {A.DUCK_VAT}, {FLAGS} SELECT invoice_id, reason IS NOT NULL AS reverse_charge, reason FROM flags")
def reverse_charge(spark, d):
    return V.reverse_charge_flag(A.vat_invoices(spark, d)).select("invoice_id", "reverse_charge", "reason")


@query("I04_protocols", f"WITH {A.DUCK_VAT}, {PROTOCOLS} SELECT * FROM protocols")
def protocols(spark, d):
    return V.protocols_117(_split(spark, d)[0])


@query("I05_protocol_rows", BOOKS + " SELECT * FROM p_buy")
def protocol_rows(spark, d):
    return V.protocol_purchase_rows(protocols(spark, d))


@query("I05_protocol_sales_rows", BOOKS + " SELECT * FROM p_sell")
def protocol_sales_rows(spark, d):
    return V.protocol_sales_rows(protocols(spark, d))


@query("I05_protocol_postings", f"WITH {A.DUCK_VAT}, {PROTOCOLS} SELECT invoice_id, period, protocol, 1 AS line, '602' AS debit_account, '401' AS credit_account, base AS amount FROM protocols UNION ALL SELECT invoice_id, period, protocol, 2, '4531', '4532', vat FROM protocols")
def protocol_postings(spark, d):
    return V.protocol_postings(protocols(spark, d))


@query("G01_purchases_with_protocols", BOOKS + " SELECT * FROM buys")
def purchases_with_protocols(spark, d):
    return _books(spark, d)[0]


@query("G01_sales_with_protocols", BOOKS + " SELECT * FROM sells")
def sales_with_protocols(spark, d):
    return _books(spark, d)[1]


_PART = """, buys2 AS (SELECT * REPLACE ((CASE WHEN part THEN 0 ELSE tax_base_20 END)::DECIMAL(18,2) AS tax_base_20, (CASE WHEN part THEN 0 ELSE vat_20 END)::DECIMAL(18,2) AS vat_20, (CASE WHEN part THEN tax_base_20 ELSE 0 END)::DECIMAL(18,2) AS tax_base_partial, (CASE WHEN part THEN vat_20 ELSE 0 END)::DECIMAL(18,2) AS vat_partial)
  FROM (SELECT *, invoice_id % 11 = 0 AS part FROM buys))"""


@query("E15_vat_return", BOOKS + _PART + "," + _return("buys2", "0.75", "250") + " SELECT * FROM decl")
def vat_return(spark, d):
    """A document in eleven has partial credit, at a coefficient of 0.75; 250.00 are left from before."""
    rows, bought = V.book_amounts(A.vat_invoices(spark, d)), F.col("book") == "purchase"
    part = bought & (F.col("invoice_id") % 11 == 0)
    cut = {c: F.when(part, 0).otherwise(F.col(c)).cast(V.MONEY) for c in ("tax_base_20", "vat_20")} | {p: F.when(part, F.col(c)).otherwise(F.col(p)).cast(V.MONEY) for p, c in (("tax_base_partial", "tax_base_20"), ("vat_partial", "vat_20"))}
    return V.return_of(rows.withColumns(cut), "0.75", "250.00")


@query("E16_vat_return_audit", BOOKS + "," + _return() + """,
off AS (SELECT period, c20, c40 + CASE WHEN period::INT % 5 = 0 THEN 1 ELSE 0 END AS c40, c43, c50 + CASE WHEN period::INT % 7 = 0 THEN 1 ELSE 0 END AS c50, c60, coalesce((SELECT sum(vat_20 + vat_vop + vat_art82 + vat_9) FROM sells WHERE sells.period = decl.period), 0) AS s, coalesce((SELECT sum(vat_20 + vat_9) FROM buys WHERE buys.period = decl.period), 0) AS p FROM decl),
c AS (SELECT period, 'SALES_VAT' AS "check", (s - c20)::DECIMAL(18,2) AS difference FROM off UNION ALL SELECT period, 'PURCHASE_VAT', (p - c40)::DECIMAL(18,2) FROM off UNION ALL SELECT period, 'RESULT', (c20 - c43 - c50 + c60)::DECIMAL(18,2) FROM off)
SELECT * FROM c WHERE abs(difference) > 0.02""")
def vat_return_audit(spark, d):
    """Some returns are filed with a wrong cell 40 or 50."""
    buys, sells = _books(spark, d)
    off = lambda c, n: (F.col(c) + F.when(F.col("period").cast("int") % n == 0, 1).otherwise(0)).cast(V.MONEY)
    return V.vat_return_audit(V.vat_return(buys, sells).withColumns({"c40": off("c40", 5), "c50": off("c50", 7)}), buys, sells)


def _line(amounts, fmt="fixed"):
    if fmt == "fixed":
        return "rpad(left(period, 4), 4, ' ') || lpad(doc_type, 2, ' ') || doc_number || rpad(doc_date::VARCHAR, 10, ' ') || rpad(left(contractor_id, 15), 15, ' ') || rpad(left(contractor_name, 50), 50, ' ') || rpad(left(description, 30), 30, ' ') || " + " || ".join(f"lpad({c}::VARCHAR, 15, ' ')" for c in amounts)
    q = (lambda c: f"'\"' || {c} || '\"'") if fmt == "csv" else (lambda c: c)
    sep = "chr(9)" if fmt == "tsv" else "';'"
    return f"concat_ws({sep}, period, doc_type, doc_number, doc_date::VARCHAR, contractor_id, {q('contractor_name')}, {q('description')}, {', '.join(f'{c}::VARCHAR' for c in amounts)})"


@query("K01_purchase_lines", BOOKS + f" SELECT invoice_id, {_line(V.PURCHASE_AMOUNTS)} AS line FROM buys")
def purchase_lines(spark, d):
    return _books(spark, d)[0].select("invoice_id", V.book_line(V.PURCHASE_AMOUNTS).alias("line"))


@query("K01_purchase_csv", BOOKS + f" SELECT invoice_id, {_line(V.PURCHASE_AMOUNTS, 'csv')} AS line FROM buys")
def purchase_csv(spark, d):
    return _books(spark, d)[0].select("invoice_id", V.book_line(V.PURCHASE_AMOUNTS, "csv").alias("line"))


@query("K02_sales_lines", BOOKS + f" SELECT invoice_id, {_line(V.SALES_AMOUNTS)} AS line FROM sells")
def sales_lines(spark, d):
    return _books(spark, d)[1].select("invoice_id", V.book_line(V.SALES_AMOUNTS).alias("line"))


@query("K02_sales_tsv", BOOKS + f" SELECT invoice_id, {_line(V.SALES_AMOUNTS, 'tsv')} AS line FROM sells")
def sales_tsv(spark, d):
    return _books(spark, d)[1].select("invoice_id", V.book_line(V.SALES_AMOUNTS, "tsv").alias("line"))


_HEAD = ", ".join(f"('[{k}]={v}', {i})" for i, (k, v) in enumerate(COMPANY.items(), 1))
_RETURN_LINES = f"""
rl AS (SELECT period, 0 AS seq, '[ПЕРИОД]=' || period AS line FROM decl UNION ALL SELECT period, i, t FROM decl, (VALUES {_HEAD}) h(t, i)
  UNION ALL {' UNION ALL '.join(f"SELECT period, {i + 8}, '[{c}]=' || c{c}::VARCHAR FROM decl" for i, c in enumerate(V.CELLS))})"""


@query("K03_vat_return_lines", BOOKS + "," + _return() + "," + _RETURN_LINES + " SELECT period, seq::INT AS seq, line FROM rl")
def vat_return_lines(spark, d):
    return V.return_lines(V.vat_return(*_books(spark, d)), COMPANY)


_ORDER = "row_number() OVER (PARTITION BY period ORDER BY doc_type = '09', doc_type, doc_number, invoice_id)::INT"


@query("K13_vat_package", BOOKS + "," + _return() + "," + _RETURN_LINES + f""" SELECT period, 'POKUPKI' AS file, {_ORDER} AS seq, {_line(V.PURCHASE_AMOUNTS)} AS line FROM buys
UNION ALL SELECT period, 'PRODAGBI', {_ORDER}, {_line(V.SALES_AMOUNTS)} FROM sells UNION ALL SELECT period, 'DEKLAR', (seq + 1)::INT, line FROM rl""")
def vat_package(spark, d):
    return V.vat_package(*_split(spark, d), COMPANY)
