"""Queries of values read from lines, over lines that are set from the orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import extraction as X
from ..sources import adapters as A
from .registry import query

#: Lines of a document by the remainder of its id: (divisor, remainder, text); {t} is the total.
CURRENCY_LINES = (
    (1, 0, "Фактура"), (5, 0, "Сума за плащане: {t} лв."), (5, 1, "Общо дължимо: {t} EUR"), (5, 2, "За плащане {t}"), (5, 3, "За плащане {t} € равностойност {t} лв"), (4, 1, "Ед. цена лв лв"),
    (4, 2, "Цена BGN"), (3, 1, "Стойност EUR"), (3, 2, "Стойност в евро, евро"), (7, 0, "Курс 1.95583"), (7, 1, "Равностойност в EUR"), (7, 2, "Сума в лева: {t}"), (7, 3, "1 EUR = 1.95583 лева"),
    (6, 0, "Словом: сто лева"), (6, 1, "Словом: сто евро и десет цента"), (6, 2, "Словом: сто евро. Сума в лв: {t}"), (11, 3, "32ЕЦ по сметка"), (13, 4, "120 BGR"),
)


def currency_lines(spark, d):
    k = F.col("doc_id")
    inv = A.invoices(spark, d).select(F.col("invoice_id").alias("doc_id"), F.coalesce(F.col("total").cast("string"), F.lit("")).alias("t"))
    rows = [F.when(k % n == r, F.struct(F.lit(i).alias("line"), F.replace(F.lit(text), F.lit("{t}"), F.col("t")).alias("text"))) for i, (n, r, text) in enumerate(CURRENCY_LINES)]
    return inv.select("doc_id", F.lit(1).alias("page"), F.inline(F.array_compact(F.array(*rows))))


_RE = lambda p: p.replace("<", "(^|[^\\p{L}\\p{N}_])").replace(">", "($|[^\\p{L}\\p{N}_])")
#: RE2 has no look-around, so a bound takes its character: texts have their blanks doubled and blanks at both ends.
_ANY = lambda t, ps: "(" + " OR ".join(f"regexp_matches({t}, '{_RE(p)}')" for p in ps) + ")"
_SUM = lambda t, ps: "(" + " + ".join(f"len(regexp_extract_all({t}, '{_RE(p)}'))" for p in ps) + ")"
_ONE = lambda b, e: f"CASE WHEN {b} AND NOT {e} THEN 'BGN' WHEN {e} AND NOT {b} THEN 'EUR' END"
_ROWS = ", ".join(f"({i}, {n}, {r}, '{t}')" for i, (n, r, t) in enumerate(CURRENCY_LINES))


@query("E27_currency_vote", f"""WITH {A.DUCK_INVOICES}, v(line, n, r, txt) AS (VALUES {_ROWS}),
l AS (SELECT invoice_id AS doc_id, line, ' ' || replace(lower(replace(txt, '{{t}}', coalesce(total::VARCHAR, ''))), ' ', '  ') || ' ' AS low FROM invoices JOIN v ON invoice_id % n = r),
s AS (SELECT doc_id, line, CASE WHEN contains(low, 'словом') THEN ' ' || regexp_replace(regexp_extract(low, 'словом[ :]*(.*)$', 1), '{_RE(X.ASIDE)}', ' ', 'g') || ' ' END AS words,
  CASE WHEN ({' OR '.join(f"contains(replace(low, '  ', ' '), '{t}')" for t in X.TOTAL_LABELS)}) AND NOT ({' OR '.join(f"contains(low, '{t}')" for t in X.INFORMATION_LABELS)}) THEN {_ONE(_ANY('low', X.BGN_ON_TOTAL), '(' + _ANY('low', X.EUR_ON_TOTAL) + " OR contains(low, '€'))")} END AS on_total,
  {_SUM('low', X.BGN_MENTIONS)} AS bgn, {_SUM('low', X.EUR_MENTIONS)} AS eur, {_SUM('low', (X.BGN_INFORMATION,))} AS bi, {_SUM('low', (X.EUR_INFORMATION,))} AS ei FROM l),
g AS (SELECT doc_id, arg_min(words, line) FILTER (words IS NOT NULL) AS words, arg_min(on_total, line) FILTER (on_total IS NOT NULL) AS on_total, greatest(sum(bgn) - sum(bi), 0) AS b, greatest(sum(eur) - sum(ei), 0) AS e FROM s GROUP BY 1),
o AS (SELECT doc_id, {_ONE('coalesce(' + _ANY('words', X.BGN_IN_WORDS) + ', false)', 'coalesce(' + _ANY('words', X.EUR_IN_WORDS) + ', false)')} AS said, on_total, CASE WHEN b > e THEN 'BGN' WHEN e > b THEN 'EUR' END AS counted FROM g)
SELECT invoice_id AS doc_id, coalesce(said, on_total, counted, CASE WHEN date_issued >= DATE '2026-01-01' THEN 'EUR' ELSE 'BGN' END) AS currency, CASE WHEN said IS NOT NULL THEN 'words' WHEN on_total IS NOT NULL THEN 'total' WHEN counted IS NOT NULL THEN 'mentions' ELSE 'date' END AS witness
FROM invoices LEFT JOIN o ON o.doc_id = invoice_id""")
def currency_vote(spark, d):
    dates = A.invoices(spark, d).select(F.col("invoice_id").alias("doc_id"), "date_issued")
    return X.currency_vote(currency_lines(spark, d), dates)


#: Texts of invoices by the remainder of their id by 19; those without a ground are the rest.
GROUND_TEXTS = (
    "Скрап съгласно чл. 163а, ал. 1", "Пшеница, чл.163 а от ЗДДС", "Чл. 163а", "чл.82, ал. 2 от ЗДДС", "Reverse charge applies", "ВОД към Германия", "Вътреобщностно придобиване", "Тристранна операция", "Износ за Сърбия",
    "Международен транспорт", "Лицето не е регистрирано по ЗДДС", "Освободена доставка", "Article 196", "Основание за неначисляване: друг текст", "Заводска доставка", "Обикновен текст",
)
_TEXTS = ", ".join(f"({i}, '{t}')" for i, t in enumerate(GROUND_TEXTS))
_GROUNDS = "CASE " + " ".join(f"WHEN {_ANY('low', ps)} THEN {i}" for i, (_, _, ps) in enumerate(X.VAT_GROUNDS)) + " END"
_NAMED = ", ".join(f"({i}, '{c}', '{a}')" for i, (c, a, _) in enumerate(X.VAT_GROUNDS))


@query("H11_check_vat_grounds", f"""WITH {A.DUCK_VAT}, tx(r, txt) AS (VALUES {_TEXTS}), gr(i, code, article) AS (VALUES {_NAMED}),
g0 AS (SELECT invoice_id, tax_base AS b, CASE WHEN invoice_id % 3 = 0 THEN 0 WHEN invoice_id % 5 = 0 THEN NULL ELSE vat END AS v, CASE WHEN invoice_id % 10 = 5 THEN tax_base ELSE total END AS t, CASE WHEN invoice_id % 7 = 1 THEN 0 WHEN invoice_id % 7 = 2 THEN 20 END AS rate, coalesce(txt, '') || ' ' || coalesce(note, '') AS txt, supplier_vat FROM vinv LEFT JOIN tx ON invoice_id % 19 = r),
g1 AS (SELECT *, coalesce(v = 0, false) OR coalesce(rate = 0, false) OR coalesce(b > 0 AND v IS NULL, false) AND NOT coalesce(t > b + 0.05, false) AND NOT coalesce(rate > 0, false) AS z, ' ' || replace(lower(txt), ' ', '  ') || ' ' AS low FROM g0),
g2 AS (SELECT *, CASE WHEN z THEN {_GROUNDS} END AS gi FROM g1), g3 AS (SELECT *, z AND gi IS NULL AND regexp_matches(upper(coalesce(supplier_vat, '')), '^\\p{{L}}{{2}}..') AND NOT starts_with(upper(supplier_vat), 'BG') AS fo FROM g2)
SELECT invoice_id, z AS is_zero, NOT (z AND gi IS NULL AND NOT fo) AS is_valid, CASE WHEN fo THEN '{X.FOREIGN_GROUND[0]}' ELSE code END AS code, CASE WHEN fo THEN '{X.FOREIGN_GROUND[1]}' ELSE article END AS article, CASE WHEN z AND gi IS NULL AND NOT fo THEN 'MISSING_VAT_EXEMPTION_REASON' END AS issue FROM g3 LEFT JOIN gr ON gr.i = gi""")
def check_vat_grounds(spark, d):
    """Every third invoice without VAT, every fifth where none was read, with and without grounds in their texts."""
    k, money = F.col("invoice_id"), "decimal(18,2)"
    text = F.get(F.array(*(F.lit(t) for t in GROUND_TEXTS)), (k % 19).cast("int"))
    df = A.vat_invoices(spark, d).select(
        "invoice_id", "tax_base", F.when(k % 3 == 0, 0).when(k % 5 == 0, None).otherwise(F.col("vat")).cast(money).alias("vat"), F.when(k % 10 == 5, F.col("tax_base")).otherwise(F.col("total")).cast(money).alias("total"),
        F.when(k % 7 == 1, 0).when(k % 7 == 2, 20).alias("rate"), F.concat(F.coalesce(text, F.lit("")), F.lit(" "), F.coalesce("note", F.lit(""))).alias("text"), "supplier_vat",
    )
    return X.check_vat_grounds(df)


_CODES = ("UBBS", "STSA", "UNCR", "FINV", "QQQQ")


def payment_tokens(spark, d):
    """Tokens of each invoice with its supplier's account: whole, in fours, with look-alike letters, with a wrong digit, none, or in two parts; with and without BIC and method."""
    k, s = F.col("invoice_id"), F.coalesce("supplier_id", F.lit(0))
    code = F.get(F.array(*(F.lit(c) for c in _CODES)), (s % 5).cast("int"))
    rest = F.lpad((s * 982451653 + 7).cast("string"), 14, "0")
    digits = F.array_join(F.transform(F.split(code, ""), lambda c: F.when(c == "", "").otherwise((F.ascii(c) - 55).cast("string"))), "")
    check = F.lpad((98 - F.concat(digits, rest, F.lit("111600")).cast("decimal(38,0)") % 97).cast("int").cast("string"), 2, "0")
    inv = A.invoices(spark, d).select("invoice_id", code.alias("code"), F.concat(F.lit("BG"), check, code, rest).alias("iban"))
    fours = F.transform(F.sequence(F.lit(0), F.lit(5)), lambda j: F.substr("iban", j * 4 + 1, F.lit(4)))
    wrong = F.concat(F.left("iban", F.lit(21)), ((F.right("iban", F.lit(1)).cast("int") + 1) % 10).cast("string"))
    alike = F.concat(F.lit("В6"), F.translate(F.substr("iban", F.lit(3)), "BCTH", "ВСТН"))
    account = F.when(k % 6 == 0, F.array("iban")).when(k % 6 == 1, fours).when(k % 6 == 2, F.array(alike)).when(k % 6 == 3, F.array(wrong)).when(k % 6 == 5, F.array(F.concat(F.left("iban", F.lit(10)), F.lit(".")), F.substr("iban", F.lit(11)))).otherwise(F.array())
    more = F.when(k % 4 == 0, F.array(F.lit("BIC:"), F.concat("code", F.lit("BGSF")))).otherwise(F.array())
    how = F.when(k % 3 == 0, F.array(F.lit("по"), F.lit("банков"), F.lit("път"))).when(k % 3 == 1, F.array(F.lit("в"), F.lit("брой"))).otherwise(F.array())
    words = F.concat(F.array(F.lit("Плащане:"), F.lit("Бенефициент"), F.lit("IBAN:")), account, F.array(F.lit("до"), F.lit("10"), F.lit("дни")), more, how)
    return inv.select(k.alias("doc_id"), F.lit(1).alias("page"), F.posexplode(words).alias("i", "text"))


_N97 = lambda c: f"(array_to_string(list_transform(string_split(substr({c}, 5) || left({c}, 4), ''), lambda x: CASE WHEN x BETWEEN '0' AND '9' THEN x ELSE (ascii(x) - 55)::VARCHAR END), '')::HUGEINT % 97)"
_RIGHT = "c0"
for _p, _r in X.MISREAD:
    _RIGHT = f"regexp_replace({_RIGHT}, '{_p}', '{_r}', 'g')"
_RIGHT = f"regexp_replace(regexp_replace(upper(translate({_RIGHT}, '{X.LOOK_ALIKES[0]}', '{X.LOOK_ALIKES[1]}')), '[^A-Z0-9]', '', 'g'), 'IBAN|TBAM|PBAM', '', 'g')"
_BANKS = ", ".join(f"('{k}', '{b}', '{n}')" for k, (b, n) in X.BANKS.items())


@query("M05_extract_payment", f"""WITH {A.DUCK_INVOICES}, bk(code, bank_bic, bank_name) AS (VALUES {_BANKS}),
q0 AS (SELECT invoice_id AS k, [{', '.join(f"'{c}'" for c in _CODES)}][coalesce(supplier_id, 0) % 5 + 1] AS code, lpad((coalesce(supplier_id, 0) * 982451653 + 7)::VARCHAR, 14, '0') AS rest FROM invoices),
q1 AS (SELECT k, code, 'BG' || lpad((98 - {_N97("('BG00' || code || rest)")})::VARCHAR, 2, '0') || code || rest AS iban FROM q0),
q2 AS (SELECT k, code, ['Плащане:', 'Бенефициент', 'IBAN:'] || CASE k % 6 WHEN 0 THEN [iban] WHEN 1 THEN [substr(iban, 1, 4), substr(iban, 5, 4), substr(iban, 9, 4), substr(iban, 13, 4), substr(iban, 17, 4), substr(iban, 21, 4)] WHEN 2 THEN ['В6' || translate(substr(iban, 3), 'BCTH', 'ВСТН')]
  WHEN 3 THEN [left(iban, 21) || ((right(iban, 1)::INT + 1) % 10)::VARCHAR] WHEN 5 THEN [left(iban, 10) || '.', substr(iban, 11)] ELSE []::VARCHAR[] END || ['до', '10', 'дни'] || CASE WHEN k % 4 = 0 THEN ['BIC:', code || 'BGSF'] ELSE []::VARCHAR[] END
  || CASE k % 3 WHEN 0 THEN ['по', 'банков', 'път'] WHEN 1 THEN ['в', 'брой'] ELSE []::VARCHAR[] END AS ws FROM q1),
r0 AS (SELECT k, ws, pos, unnest(range(1, 8)) AS n FROM (SELECT k, ws, unnest(range(1, len(ws) + 1)) AS pos FROM q2)),
r1 AS (SELECT k, pos, n, array_to_string(list_slice(ws, pos, pos + n - 1), '') AS c0 FROM r0 WHERE regexp_matches(upper(ws[pos]), '^[^A-ZА-Я0-9]*([BВ]|IBAN|TBAM|PBAM|ПВАМ|ТВАМ)')),
r2 AS (SELECT k, pos, n, {_RIGHT} AS c FROM r1),
r3 AS (SELECT k, pos, n, c, {_N97('c')} = 1 AS ok FROM r2 WHERE regexp_full_match(c, 'BG[0-9]{{2}}[A-Z]{{4}}[0-9]{{4}}[0-9A-Z]{{10}}')),
r4 AS (SELECT k, arg_min(c, (NOT ok)::INT * 1000000 + n * 10000 + pos) AS iban, bool_or(ok) AS ok FROM r3 GROUP BY k),
sb AS (SELECT k, upper(translate(array_to_string(ws, ' '), '{X.LOOK_ALIKES[0]}', '{X.LOOK_ALIKES[1]}')) AS up, lower(array_to_string(ws, ' ')) AS low FROM q2)
SELECT sb.k AS doc_id, iban, coalesce(ok, false) AS iban_valid, substr(iban, 5, 4) AS bank_code, coalesce(nullif(regexp_extract(up, '(^| )(BIC|SWIFT)[ ]*[:./-]?[ ]*([A-Z]{{6}}[A-Z0-9]{{2}}([A-Z0-9]{{3}})?)( |$)', 3), ''), bank_bic) AS bic, bank_name,
  CASE WHEN regexp_matches(low, 'банков *(път|превод)') THEN 'банков превод' WHEN regexp_matches(low, '(^| )в *брой') THEN 'в брой' END AS method FROM sb LEFT JOIN r4 ON r4.k = sb.k LEFT JOIN bk ON bk.code = substr(iban, 5, 4)""")
def extract_payment(spark, d):
    return X.extract_payment(payment_tokens(spark, d))
