"""Validation queries over invoice headers with faults."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import reports as P
from ..operators import rules as R
from ..sources import adapters as A
from .registry import query

HD = f"WITH {A.DUCK_HEADERS}"
AS_OF = "2026-12-31"


def _rows(rules: list[tuple[str, str | None, str, str]]) -> str:
    """code, field, severity, condition."""
    return " UNION ALL ".join(f"SELECT invoice_id, '{c}' AS code, {f"'{x}'" if x else 'NULL'} AS field, '{s}' AS severity FROM hd WHERE {w}" for c, x, s, w in rules)


_NO = lambda c: f"coalesce(trim({c}), '') = ''"
REQUIRED = _rows([
    *((code, None, "error", f"doc_kind <> 'PAYMENT_ORDER_NAP' AND {_NO(c)}") for code, c in (("MISSING_INVOICE_NUMBER", "number"), ("MISSING_DATE_ISSUED", "date_issued"), ("MISSING_SUPPLIER_NAME", "supplier_name"), ("MISSING_SUPPLIER_EIK", "supplier_eik"), ("MISSING_RECIPIENT_NAME", "recipient_name"))),
    ("MISSING_CORRECTED_INVOICE_REFERENCE", None, "warning", "(is_credit_note OR is_debit_note) AND reference IS NULL"),
])
IDENTIFIERS = _rows([
    ("PARTY_COLLISION_SAME_EIK", None, "error", "supplier_eik <> '' AND supplier_eik = recipient_eik"),
    *(row for r in R.ROLES for row in (
        ("INVALID_EIK_FORMAT", r, "warning", f"length(coalesce({r}_eik, '')) NOT IN (0, 9, 10, 13)"), ("INVALID_VAT_FORMAT", r, "warning", f"{r}_vat IS NOT NULL AND NOT regexp_matches({r}_vat, '^BG[0-9]{{9,13}}$')"),
        ("INVOICE_NUMBER_MATCHES_EIK", r, "error", f"number <> '' AND ltrim(number, '0') = ltrim({r}_eik, '0')"))),
])
_DAY = lambda c: f"regexp_matches({c}, '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$')"
DATES = _rows([
    *(row for c in ("date_issued", "date_tax_event", "due_date") for row in (("INVALID_DATE_FORMAT", c, "warning", f"NOT {_DAY(c)}"), ("INVALID_DATE", c, "error", f"{_DAY(c)} AND try_cast({c} AS DATE) IS NULL"))),
    *(("FUTURE_DATE", c, "error", f"{_DAY(c)} AND try_cast({c} AS DATE) > DATE '{AS_OF}'") for c in ("date_issued", "date_tax_event")),
])
_TOL = "CASE WHEN n_items > 15 AND (has_discount OR coalesce(currency = 'EUR', false) OR is_recap) THEN 0.03 ELSE 0.02 END"
_BLIND = lambda x, y: f"(CASE WHEN is_credit_note THEN least(abs({x} - {y}), abs(abs({x}) - abs({y}))) ELSE abs({x} - {y}) END)"
_BGN, _EUR = (lambda c: f"round({c} * 1.95583::DECIMAL(6,5), 2)"), (lambda c: f"round({c} / 1.95583, 2)::DECIMAL(18,2)")
_BE, _BB = f"CASE WHEN coalesce(currency = 'EUR', false) THEN tax_base ELSE {_EUR('tax_base')} END", f"CASE WHEN coalesce(currency = 'EUR', false) THEN {_BGN('tax_base')} ELSE tax_base END"
_DUAL = f"({_BLIND('items_total', 'tax_base')} <= {_TOL} OR abs({_EUR('items_total')} - tax_base) <= 0.5 OR abs({_BGN('items_total')} - tax_base) <= 0.5 OR abs(items_total - ({_BB})) <= 0.5 OR abs(items_total - ({_BE})) <= 0.5)"
_OFF = f"n_with_total > 0 AND NOT {_DUAL} AND NOT (n_with_total < n_items AND items_total <= greatest({_BE}, {_BB}) * 1.02)"
_MILD = "(n_with_total < n_items OR confidence < 70 OR is_recap)"
_SUM = "(CASE WHEN is_credit_note THEN least(abs(tax_base + vat - total), abs(abs(tax_base) + abs(vat) - abs(total)), abs(abs(tax_base + vat) - abs(total))) ELSE abs(tax_base + vat - total) END)"
TOTALS = _rows([
    ("LINE_ITEMS_TOTAL_MISMATCH", None, "warning", f"{_OFF} AND {_MILD}"), ("LINE_ITEMS_TOTAL_MISMATCH", None, "error", f"{_OFF} AND NOT {_MILD}"),
    ("VAT_CALCULATION_MISMATCH", None, "error", "tax_base <> 0 AND " + " AND ".join(f"{_BLIND(f'round(tax_base * {r}::DECIMAL(3,2), 2)', 'vat')} > {_TOL}" for r in ("0.20", "0.09", "0.00"))),
    ("TOTAL_SUM_MISMATCH", None, "error", f"{_SUM} > {_TOL}"), ("ZERO_TOTAL", None, "warning", "total = 0"),
])
_TE, _TB = "coalesce(total_eur, CASE WHEN total_currency = 'EUR' THEN total END)", "coalesce(total_bgn, CASE WHEN total_currency = 'BGN' THEN total END)"
CURRENCY = _rows([
    ("CURRENCY_MISMATCH", None, "warning", "currency <> total_currency"), ("DUAL_CURRENCY_DETECTED", None, "warning", "both_found"),
    ("CURRENCY_AFTER_DUAL_PERIOD", None, "warning", "currency = 'BGN' AND total_currency = 'BGN' AND try_cast(date_issued AS DATE) >= DATE '2026-08-08'"),
    ("CURRENCY_POST_EURO_BGN_DETECTED", None, "warning", "currency = 'BGN' AND total_currency = 'BGN' AND try_cast(date_issued AS DATE) >= DATE '2026-01-01' AND try_cast(date_issued AS DATE) < DATE '2026-08-08'"),
    ("DUAL_CURRENCY_PARITY_MISMATCH", None, "warning", f"abs({_TB} - {_BGN(_TE)}) > 0.02"),
])
WORDS = _rows([("AMOUNT_WORDS_CURRENCY_MISMATCH", None, "warning", "(total_currency = 'EUR' AND wording = 0) OR (total_currency = 'BGN' AND wording IN (1, 3))")])


def _all_rules():
    return [*R.required_rules(), *R.identifier_rules(), *R.date_rules(AS_OF), *R.total_rules(), *R.currency_rules(), *R.amount_word_rules()]


def _headers(spark, d):
    # dates that can't be read are no dates for the currency rules
    return A.headers(spark, d)


def _issue_query(name: str, sql: str, rules):
    @query(name, HD + " " + sql)
    def run(spark, d):
        return R.issue_rows(_headers(spark, d), rules())

    run.__name__ = name
    return run


check_required = _issue_query("H01_check_required", REQUIRED, R.required_rules)
check_identifiers = _issue_query("H02_check_identifiers", IDENTIFIERS, R.identifier_rules)
check_dates = _issue_query("H03_check_dates", DATES, lambda: R.date_rules(AS_OF))
check_totals = _issue_query("H05_check_totals", TOTALS, R.total_rules)
check_currency = _issue_query("H06_check_currency", CURRENCY, R.currency_rules)
check_amount_words = _issue_query("H07_check_amount_words", WORDS, R.amount_word_rules)

_ITEMS = f"""{HD}, it AS (SELECT l.invoice_id || '/' || line_no AS line_key, CASE WHEN line_no = 7 THEN ' ' WHEN l.invoice_id % 83 = 0 THEN 'N/A' ELSE description END AS description, CASE WHEN l.invoice_id % 31 = 0 THEN -quantity ELSE quantity END AS quantity,
  (CASE WHEN l.invoice_id % 3 = 0 THEN net ELSE net + CASE WHEN line_no = 2 THEN 0.03 ELSE 0 END END / 1 * CASE WHEN l.invoice_id % 31 = 0 THEN -1 ELSE 1 END)::DECIMAL(18,2) AS unit_price, net, l.vat_rate, is_credit_note, n_items, coalesce(currency = 'EUR', false) AS is_eur, CASE WHEN line_no = 5 THEN 1 END AS discount
  FROM lines l JOIN hd USING (invoice_id)), i2 AS (SELECT * REPLACE (CASE WHEN quantity < 0 THEN -1 ELSE 1 END::DECIMAL(18,3) AS quantity), round(CASE WHEN quantity < 0 THEN -1 ELSE 1 END * unit_price, 2) AS calc FROM it)"""
_CALC = "(CASE WHEN is_credit_note THEN least(abs(calc - net), abs(abs(calc) - abs(net))) ELSE abs(calc - net) END) > CASE WHEN n_items > 15 OR is_eur OR discount IS NOT NULL THEN 0.03 ELSE 0.02 END"
_ITEM_RULES = (("MISSING_DESCRIPTION", "lower(trim(description)) IN ('', 'n/a')"), ("LINE_ITEM_CALC_MISMATCH", _CALC), ("NEGATIVE_QUANTITY", "NOT is_credit_note AND quantity < 0"), ("NEGATIVE_PRICE", "NOT is_credit_note AND unit_price < 0"))


@query("H04_check_line_items", _ITEMS + " " + " UNION ALL ".join(f"SELECT line_key, '{c}' AS code, 'warning' AS severity FROM i2 WHERE {w}" for c, w in _ITEM_RULES))
def check_line_items(spark, d):
    """Lines of quantity 1 or -1, some with a price that is off by 0.03, some with no description."""
    k, n = F.col("invoice_id"), F.col("line_no")
    head = A.headers(spark, d).select("invoice_id", "is_credit_note", "n_items", F.coalesce(F.col("currency") == "EUR", F.lit(False)).alias("is_eur"))
    sign = F.when(k % 31 == 0, -1).otherwise(1)
    price = (F.col("net") + F.when((k % 3 != 0) & (n == 2), F.expr("0.03BD")).otherwise(0)) * sign
    li = A.invoice_lines(spark, d).join(head, "invoice_id").withColumns({
        "line_key": F.concat_ws("/", "invoice_id", "line_no"), "description": F.when(n == 7, " ").when(k % 83 == 0, "N/A").otherwise(F.col("description")), "quantity": sign.cast("decimal(18,3)"),
        "unit_price": price.cast("decimal(18,2)"), "discount": F.when(n == 5, 1),
    })
    return R.check_line_items(li)


_ALL = HD + f", iss AS ({' UNION ALL '.join((REQUIRED, IDENTIFIERS, DATES, TOTALS, CURRENCY, WORDS))})"
_VALID = _ALL + ", c AS (SELECT h.invoice_id, count(*) FILTER (severity = 'error') AS n_errors, count(*) FILTER (severity = 'warning') AS n_warnings FROM hd h LEFT JOIN iss USING (invoice_id) GROUP BY 1)"


@query("H17_validate_invoices", _VALID + " SELECT *, n_errors = 0 AS is_valid FROM c")
def validate_invoices(spark, d):
    return R.validate_invoices(_headers(spark, d), _all_rules())


@query("C15_document_status", _VALID + " SELECT invoice_id, CASE WHEN n_errors = 0 THEN 'completed' ELSE 'needs_review' END AS status, CASE WHEN n_errors > 0 THEN 'FLAGGED_FOR_REVIEW' WHEN n_warnings > 0 THEN 'PROCESSING' ELSE 'VALIDATED' END AS warehouse_status FROM c")
def document_status(spark, d):
    return R.document_status(validate_invoices(spark, d))


@query("E04_issue_frequency", _ALL + " SELECT code, severity, count(*) AS n FROM iss GROUP BY ALL")
def issue_frequency(spark, d):
    return P.issue_frequency(R.issue_rows(_headers(spark, d), _all_rules()))


_LEGAL = HD + """, q AS (SELECT invoice_id, coalesce(number, '') <> '' AS document_number, true AS date_issued, true AS date_tax_event,
  supplier_name IS NOT NULL AND (length(coalesce(supplier_eik, '')) >= 3 OR length(coalesce(supplier_vat, '')) >= 5) AS supplier_identity, recipient_name IS NOT NULL AND (length(coalesce(recipient_eik, '')) >= 3 OR length(coalesce(recipient_vat, '')) >= 5) AS recipient_identity,
  n_items > 0 AS goods_services_description, tax_base IS NOT NULL AS tax_base, vat IS NOT NULL AND (vat <> 0 OR invoice_id % 2 = 0) AS vat_rate_and_amount_or_grounds, invoice_id % 10 <> 0 AS compiler_or_mol, invoice_id % 12 <> 0 AS bank_requisites_valid FROM hd),
z AS (SELECT *, document_number AND supplier_identity AND recipient_identity AND goods_services_description AND tax_base AS core FROM q)
SELECT invoice_id, concat_ws(',', CASE WHEN document_number THEN 'document_number' END, 'date_issued', 'date_tax_event', CASE WHEN supplier_identity THEN 'supplier_identity' END, CASE WHEN recipient_identity THEN 'recipient_identity' END, CASE WHEN goods_services_description THEN 'goods_services_description' END,
  CASE WHEN tax_base THEN 'tax_base' END, CASE WHEN vat_rate_and_amount_or_grounds THEN 'vat_rate_and_amount_or_grounds' END, CASE WHEN compiler_or_mol THEN 'compiler_or_mol' END, CASE WHEN bank_requisites_valid THEN 'bank_requisites_valid' END) AS met,
  core AND compiler_or_mol AS zsch_compliant, core AND vat_rate_and_amount_or_grounds AS zdds_compliant, invoice_id % 3 <> 0 AND core AND vat_rate_and_amount_or_grounds AND bank_requisites_valid AS is_compliant FROM z"""


@query("H13_legal_checklist", _LEGAL)
def legal_checklist(spark, d):
    k = F.col("invoice_id")
    df = A.headers(spark, d).withColumns({"n_described": F.col("n_items"), "vat_rule_ok": F.coalesce((F.col("vat") != 0) | (F.col("vat").isNotNull() & (k % 2 == 0)), F.lit(False)), "signatory_ok": k % 10 != 0, "bank_ok": k % 12 != 0, "n_errors": F.when(k % 3 == 0, 1).otherwise(0)})
    met = F.array_join(F.transform(F.filter(F.map_entries("requisites"), lambda e: e["value"]), lambda e: e["key"]), ",")
    return R.legal_checklist(df).select("invoice_id", met.alias("met"), "zsch_compliant", "zdds_compliant", "is_compliant")
