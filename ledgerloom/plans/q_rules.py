"""Filter, rule, join, set and scalar queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import joins as J
from ..operators import rules as R
from ..sources import adapters as A
from .registry import query

INV = f"WITH {A.DUCK_INVOICES}"
_V9 = lambda e: f"substr({e}, 9, 1)::INT = {A.duck_digit(e)}"


def inv(spark, d):
    return A.invoices(spark, d)


@query("C01_search_documents", "WITH f AS (SELECT o_orderkey, o_orderstatus AS status, o_orderpriority, o_orderdate FROM orders WHERE o_orderstatus = 'O' AND (o_orderkey::VARCHAR ILIKE '%1-urg%' OR o_orderpriority ILIKE '%1-urg%')) SELECT *, (SELECT count(*) FROM f) AS n_found FROM f ORDER BY o_orderdate DESC, o_orderkey DESC, o_orderpriority DESC LIMIT 25 OFFSET 50")
def search_documents(spark, d):
    o = A.table(spark, d, "orders").select("o_orderkey", F.col("o_orderstatus").alias("status"), "o_orderpriority", "o_orderdate")
    return R.search_documents(o, "O", "1-urg", ["o_orderkey", "o_orderpriority"], "o_orderdate", 50, 25)


_MAIL = "WITH m AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'pass' WHEN 'error' THEN 'fail' WHEN 'view' THEN 'softfail' END AS spf, CASE WHEN user_id % 3 = 0 THEN 'pass' WHEN user_id % 3 = 1 THEN 'fail' END AS dkim, (value * 200)::BIGINT AS size_bytes, user_id % 2 = 0 AS is_inline, (['invoice.pdf', 'logo.png', 'scan.jpg', 'notes.txt', 'photo.jpeg'])[event_id % 5 + 1] AS filename FROM events)"


def mails(spark, d):
    e = A.table(spark, d, "events")
    names = F.array(*(F.lit(x) for x in ("invoice.pdf", "logo.png", "scan.jpg", "notes.txt", "photo.jpeg")))
    spf = F.when(F.col("event_type") == "click", "pass").when(F.col("event_type") == "error", "fail").when(F.col("event_type") == "view", "softfail")
    dkim = F.when(F.col("user_id") % 3 == 0, "pass").when(F.col("user_id") % 3 == 1, "fail")
    return e.select("event_id", spf.alias("spf"), dkim.alias("dkim"), F.round(F.col("value") * 200, 0).cast("long").alias("size_bytes"), (F.col("user_id") % 2 == 0).alias("is_inline"), F.element_at(names, (F.col("event_id") % 5 + 1).cast("int")).alias("filename"))


@query("C02_filter_attachments", _MAIL + " SELECT *, CASE WHEN size_bytes < 10240 THEN 'size_too_small' WHEN filename = 'notes.txt' THEN 'unsupported_type' WHEN filename = 'logo.png' AND size_bytes < 35840 THEN 'signature_logo' WHEN is_inline AND size_bytes < 51200 AND filename IN ('logo.png', 'scan.jpg', 'photo.jpeg') THEN 'signature_logo' ELSE 'accepted' END AS verdict FROM m")
def filter_attachments(spark, d):
    return R.filter_attachments(mails(spark, d))


@query("C04_mail_policy", _MAIL + " SELECT *, CASE WHEN spf = 'fail' THEN 'REJECTED_SPF_FAIL' WHEN coalesce(spf, '') <> 'pass' THEN 'REJECTED_SPF_MISSING_OR_FAIL' ELSE 'ACCEPTED' END AS policy FROM m")
def mail_policy(spark, d):
    return R.mail_policy(mails(spark, d))


@query("C04_mail_policy_lenient", _MAIL + " SELECT *, CASE WHEN spf = 'fail' THEN 'ACCEPTED_WITH_WARNING' WHEN spf = 'pass' OR dkim = 'pass' THEN 'ACCEPTED' ELSE 'ACCEPTED_NO_AUTH' END AS policy FROM m")
def mail_policy_lenient(spark, d):
    return R.mail_policy(mails(spark, d), require_spf=False, block_spf_fail=False)


TOK = f"WITH {A.DUCK_TOKENS}"


_BARE = "NOT regexp_matches(text, '[0-9a-zA-Zа-яА-Я]')"
_KINDS = "len(list_distinct(list_filter(string_split(lower(text), ''), lambda x: x <> '')))"
NOISE = f"""(trim(text) = '' OR regexp_matches(text, '^[-_=~+|—\\s]{{2,}}$') OR (length(text) >= 10 AND {_KINDS} <= 3 AND NOT regexp_matches(text, '^[0-9]{{10}}$'))
 OR (width > 12 * height AND height <= 6) OR (width * 100 < 8 * height AND width <= 6) OR ({_BARE} AND ((length(text) <= 2 AND (width <= 8 OR height <= 8)) OR conf < 30)))"""
_WORDS = "|".join(R.INVOICE_WORDS)
QUALITY = f"""(CASE WHEN {NOISE} THEN 0 ELSE conf - CASE WHEN {_BARE} THEN 50 ELSE 0 END + least(length(text), 12) * 1.5::DECIMAL(3,1) - CASE WHEN length(regexp_replace(text, '[^\\p{{L}}\\p{{N}}.,\\-/%()]', '', 'g')) * 10 < length(text) * 8 THEN 25 ELSE 0 END
 + CASE WHEN regexp_matches(lower(text), '{_WORDS}') THEN 30 ELSE 0 END + CASE WHEN regexp_matches(text, '^[0-9]{{1,2}}[./-][0-9]{{1,2}}[./-][0-9]{{2,4}}$|^[0-9]{{4}}[./-][0-9]{{1,2}}[./-][0-9]{{1,2}}$') THEN 25 ELSE 0 END
 + CASE WHEN regexp_matches(text, '(?i)^([0-9]{{9}}|[0-9]{{13}}|BG[0-9]{{9,13}})$') THEN 35 ELSE 0 END + CASE WHEN regexp_matches(text, '(?i)^BG[0-9]{{2}}[A-Z]{{4}}[0-9]{{14}}$') THEN 25 ELSE 0 END
 + CASE WHEN regexp_matches(text, '^[0-9]+[.,][0-9]{{2}}$') THEN 25 WHEN regexp_matches(text, '^[0-9]{{10}}$') THEN 35 WHEN regexp_matches(text, '^[0-9]{{1,5}}$') THEN 10 WHEN regexp_matches(text, '^[0-9]{{6,8}}$') THEN 10 WHEN regexp_matches(text, '^[0-9]{{14,}}$') THEN -20 ELSE 0 END
 - CASE WHEN regexp_matches(text, '^[„“"''`|]') THEN 10 ELSE 0 END - CASE WHEN regexp_matches(text, '[|`]$') THEN 10 ELSE 0 END - CASE WHEN length(text) > 10 AND {_KINDS} <= 3 THEN 50 ELSE 0 END END)::DECIMAL(10,1)"""


@query("C05_drop_noise_tokens", TOK + f" SELECT * FROM tokens WHERE NOT {NOISE}")
def drop_noise_tokens(spark, d):
    return R.drop_noise_tokens(A.tokens(spark, d))


@query("C07_token_quality", TOK + f" SELECT *, {QUALITY} AS quality FROM tokens")
def token_quality(spark, d):
    return R.token_quality(A.tokens(spark, d))


@query("C11_pending_partners", f"WITH {A.DUCK_PARTNERS} SELECT partner_id, eik, legal_name FROM partners WHERE partner_id % 3 <> 0")
def pending_partners(spark, d):
    return R.pending_partners(A.partners(spark, d).withColumn("registry_id", F.when(F.col("partner_id") % 3 == 0, F.col("partner_id"))))


@query("C14_anomaly_flags", INV + " SELECT invoice_id, abs(total - printed_total) > 0.02 AS math_discrepancy, supplier_eik IS NULL AS missing_supplier_eik, recipient_eik IS NULL AS missing_recipient_eik FROM invoices")
def anomaly_flags(spark, d):
    return R.anomaly_flags(inv(spark, d))


@query("E28_weighted_classify", """WITH t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents), n AS (SELECT doc_id, (length(t) - length(replace(t, 'tion', ''))) / 4 AS a, (length(t) - length(replace(t, 'the', ''))) / 3 AS b, (length(t) - length(replace(t, 'que', ''))) / 3 AS c, (length(t) - length(replace(t, 'ment', ''))) / 4 AS e FROM t),
s AS (SELECT doc_id, a * 5.0::DOUBLE + b * 1.5::DOUBLE AS x, c * 5.0::DOUBLE + e * 1.5::DOUBLE AS y FROM n), m AS (SELECT doc_id, greatest(x, y) AS score, CASE WHEN x >= y THEN 'english' ELSE 'romance' END AS cat FROM s)
SELECT doc_id, CASE WHEN score < 4 THEN 'unclassified' ELSE cat END AS category, score, round(least(score / (score + 5), 0.99), 4) AS confidence FROM m""")
def weighted_classify(spark, d):
    return R.weighted_classify(A.table(spark, d, "documents"), {"english": (["tion"], ["the"]), "romance": (["que"], ["ment"])})


PART = A.DUCK_PARTNERS.strip()


@query("A06_pending_documents", "SELECT o_orderkey, md5(o_orderkey::VARCHAR) AS file_hash FROM orders WHERE o_orderkey % 3 <> 0")
def pending_documents(spark, d):
    files = A.table(spark, d, "orders").select("o_orderkey", F.md5(F.col("o_orderkey").cast("string")).alias("file_hash"))
    return J.pending_documents(files, files.where("o_orderkey % 3 = 0").select("file_hash")).select("o_orderkey", "file_hash")


@query("D01_invoices_enriched", INV + f""", {PART}, ids AS (SELECT invoice_id, supplier_eik, recipient_eik, CASE WHEN invoice_id % 2 = 0 THEN supplier_id END AS sid, CASE WHEN invoice_id % 3 = 0 THEN recipient_id + 5000000 END AS rid FROM invoices),
be AS (SELECT eik, arg_min(legal_name, partner_id) AS legal_name, arg_min(legal_form, partner_id) AS legal_form FROM partners WHERE country_code = 'BG' GROUP BY eik)
SELECT invoice_id, coalesce(si.legal_name || ' ' || si.legal_form, se.legal_name || ' ' || se.legal_form, '') AS supplier_name, coalesce(ri.legal_name || ' ' || ri.legal_form, re.legal_name || ' ' || re.legal_form, '') AS recipient_name
FROM ids LEFT JOIN partners si ON si.partner_id = sid LEFT JOIN be se ON se.eik = supplier_eik LEFT JOIN partners ri ON ri.partner_id = rid LEFT JOIN be re ON re.eik = recipient_eik""")
def invoices_enriched(spark, d):
    df = inv(spark, d).withColumns({"supplier_partner_id": F.when(F.col("invoice_id") % 2 == 0, F.col("supplier_id")), "recipient_partner_id": F.when(F.col("invoice_id") % 3 == 0, F.col("recipient_id") + 5000000)})
    return J.invoices_enriched(df, A.partners(spark, d)).select("invoice_id", "supplier_name", "recipient_name")


@query("D06_vat_registered_on", INV + f", {A.DUCK_REGISTRY.strip()}, r AS (SELECT eik, registered, deregistered FROM registry) SELECT invoice_id, supplier_eik, CASE WHEN registered IS NULL THEN 'NOT_REGISTERED' WHEN coalesce(date_tax_event, date_issued) < registered THEN 'BEFORE_REGISTRATION' WHEN coalesce(date_tax_event, date_issued) > deregistered THEN 'AFTER_DEREGISTRATION' ELSE 'REGISTERED' END AS vat_status FROM invoices LEFT JOIN r ON r.eik = supplier_eik")
def vat_registered_on(spark, d):
    return J.vat_registered_on(inv(spark, d), A.vat_registry(spark, d))


@query("D07_resolve_contractors", f"""WITH {PART}, {A.DUCK_REGISTRY.strip()}, s AS (SELECT eik, 'OVERRIDE' AS status, NULL::DATE AS seen, 0 AS rank FROM partners WHERE partner_id % 10 = 1 UNION ALL SELECT eik, 'CACHED', DATE '2026-12-31' - (partner_id % 60)::INT, 1 FROM partners UNION ALL SELECT eik, 'REGISTERED', NULL, 2 FROM registry),
b AS (SELECT eik, arg_min(status, rank) AS status, min(rank) AS rank FROM s WHERE seen IS NULL OR DATE '2026-12-31' - seen <= 30 GROUP BY eik)
SELECT p.eik, coalesce(status, 'UNVERIFIED') AS status, coalesce(rank, -1) AS source FROM (SELECT DISTINCT eik FROM partners) p LEFT JOIN b USING (eik)""")
def resolve_contractors(spark, d):
    p, none = A.partners(spark, d), F.lit(None).cast("date")
    now = F.lit("2026-12-31").cast("date")
    one = p.where("partner_id % 10 = 1").select("eik", F.lit("OVERRIDE").alias("status"), none.alias("seen"))
    two = p.select("eik", F.lit("CACHED").alias("status"), F.date_sub(now, (F.col("partner_id") % 60).cast("int")).alias("seen"))
    three = A.vat_registry(spark, d).select("eik", F.lit("REGISTERED").alias("status"), none.alias("seen"))
    return J.resolve_contractors(p.select("eik").distinct(), [one, two, three], now, 30)


_RULES = "(VALUES ('widget', 5, 1, '601'), ('bolt', 9, 2, '602'), ('cold', 5, 3, '304/2'), ('red bolt', 9, 4, '603')) k(keyword, priority, seq, account)"
_CLASS = f"""WITH {A.DUCK_LINES}, cls AS (SELECT invoice_id, line_no, supplier_id, description, coalesce(account, CASE WHEN supplier_id % 7 = 0 THEN '610' END, '304') AS account, CASE WHEN account IS NOT NULL THEN 'description' WHEN supplier_id % 7 = 0 THEN 'supplier' ELSE 'default' END AS tier
FROM lines LEFT JOIN (SELECT description, arg_min(k.account, (-priority) * 100 + seq) AS account FROM (SELECT DISTINCT description FROM lines) JOIN {_RULES} ON contains(description, keyword) GROUP BY 1) USING (description))"""


def _classified(spark, d):
    rules = spark.createDataFrame([("widget", 5, 1, "601"), ("bolt", 9, 2, "602"), ("cold", 5, 3, "304/2"), ("red bolt", 9, 4, "603")], "keyword string, priority int, seq int, account string")
    suppliers = A.table(spark, d, "supplier").where("s_suppkey % 7 = 0").select(F.col("s_suppkey").alias("supplier_id"), F.lit("610").alias("account"))
    return J.classify_line_items(A.invoice_lines(spark, d), rules, suppliers)


@query("D08_classify_line_items", _CLASS + " SELECT * FROM cls")
def classify_line_items(spark, d):
    return _classified(spark, d)


_CHART = "chart AS (SELECT * FROM (VALUES ('601', 'materials'), ('3042', 'goods two'), ('304', 'goods'), ('602', 'services')) c(code, name))"


def _chart(spark):
    return spark.createDataFrame([("601", "materials"), ("3042", "goods two"), ("304", "goods"), ("602", "services")], "code string, name string")


@query("D10_lookup_accounts", _CLASS + f", {_CHART} SELECT invoice_id, line_no, description, account, coalesce(e.name, p.name) AS account_name FROM cls LEFT JOIN chart e ON e.code = replace(account, '/', '') LEFT JOIN chart p ON p.code = left(replace(account, '/', ''), 3)")
def lookup_accounts(spark, d):
    return J.lookup_accounts(_classified(spark, d).select("invoice_id", "line_no", "description", "account"), _chart(spark))


@query("D16_accounts_not_in_chart", _CLASS + f", {_CHART} SELECT DISTINCT account FROM cls WHERE NOT starts_with(account, '453') AND account NOT IN (SELECT code FROM chart)")
def accounts_not_in_chart(spark, d):
    return J.accounts_not_in_chart(_classified(spark, d), _chart(spark))


@query("G02_account_overlap", _CLASS + ", a AS (SELECT DISTINCT account FROM cls WHERE invoice_id % 2 = 0), b AS (SELECT DISTINCT account FROM cls WHERE tier <> 'supplier') SELECT account, CASE WHEN a.account IS NOT NULL AND b.account IS NOT NULL THEN 'both' WHEN b.account IS NULL THEN 'a' ELSE 'b' END AS side FROM a FULL JOIN b USING (account)")
def account_overlap(spark, d):
    c = _classified(spark, d)
    return J.account_overlap(c.where("invoice_id % 2 = 0"), c.where("tier <> 'supplier'"))


_REV = INV + """, o AS (SELECT invoice_id AS seq, supplier_eik AS eik, (invoice_id)::VARCHAR AS number, date_issued AS day, total, '304' AS account FROM invoices WHERE total IS NOT NULL),
r AS (SELECT seq AS r_seq, CASE WHEN seq % 11 = 0 THEN NULL ELSE eik END AS eik, CASE WHEN seq % 22 = 0 THEN NULL ELSE number END AS number, day, (total * 100)::BIGINT + CASE WHEN seq % 17 = 0 THEN 1 ELSE 0 END AS cents, CASE WHEN seq % 13 = 0 THEN '602' ELSE account END AS reviewed_account FROM o),
p AS (SELECT o.seq, 'eik' AS tier, r_seq, reviewed_account FROM o JOIN r ON r.eik = o.eik AND cents = (total * 100)::BIGINT UNION ALL SELECT o.seq, 'number', r_seq, reviewed_account FROM o JOIN r ON r.number = o.number AND cents = (total * 100)::BIGINT UNION ALL SELECT o.seq, 'day', r_seq, reviewed_account FROM o JOIN r ON r.day = o.day AND cents = (total * 100)::BIGINT),
b AS (SELECT seq, tier, r_seq, reviewed_account FROM p QUALIFY row_number() OVER (PARTITION BY seq ORDER BY CASE tier WHEN 'eik' THEN 0 WHEN 'number' THEN 1 ELSE 2 END, r_seq) = 1)
SELECT o.*, tier, r_seq AS reviewed_seq, reviewed_account FROM o LEFT JOIN b USING (seq)"""


@query("D12_match_reviewed", _REV)
def match_reviewed(spark, d):
    o = inv(spark, d).where("total IS NOT NULL").select(F.col("invoice_id").alias("seq"), F.col("supplier_eik").alias("eik"), F.col("invoice_id").cast("string").alias("number"), F.col("date_issued").alias("day"), "total", F.lit("304").alias("account"))
    s = F.col("seq")
    r = o.withColumns({"eik": F.when(s % 11 != 0, F.col("eik")), "number": F.when(s % 22 != 0, F.col("number")), "total": (F.col("total") + F.when(s % 17 == 0, F.expr("0.01BD")).otherwise(0)).cast("decimal(18,2)"), "account": F.when(s % 13 == 0, "602").otherwise(F.col("account"))})
    return J.match_reviewed(o, r)


_COLS = "(VALUES ('a', 0, 500), ('b', 480, 1100), ('c', 1300, 1900)) c(semantic_type, x_left, x_right)"


@query("G04_distinct_contractors", INV + " SELECT supplier_eik, date_tax_event, invoice_id FROM invoices QUALIFY row_number() OVER (PARTITION BY supplier_eik ORDER BY date_tax_event, invoice_id) = 1")
def distinct_contractors(spark, d):
    return J.first_by_rank(inv(spark, d).select("supplier_eik", "date_tax_event", "invoice_id"), "supplier_eik", [F.col("date_tax_event"), F.col("invoice_id")])


@query("K09_upsert_partners", f"WITH {PART}, base AS (SELECT country_code, eik, legal_name, 'old' AS updated FROM partners WHERE partner_id % 3 <> 0), new AS (SELECT country_code, eik, legal_name || ' X' AS legal_name, 'new' AS updated FROM partners WHERE partner_id % 2 = 0 OR partner_id % 3 = 0) SELECT country_code, eik, coalesce(new.legal_name, base.legal_name) AS legal_name, coalesce(new.updated, base.updated) AS updated FROM base FULL JOIN new USING (country_code, eik)")
def upsert_partners(spark, d):
    p = A.partners(spark, d)
    base = p.where("partner_id % 3 <> 0").select("country_code", "eik", "legal_name", F.lit("old").alias("updated"))
    new = p.where("partner_id % 2 = 0 OR partner_id % 3 = 0").select("country_code", "eik", F.concat("legal_name", F.lit(" X")).alias("legal_name"), F.lit("new").alias("updated"))
    return J.upsert(new, base, ["country_code", "eik"], ["legal_name", "updated"])


@query("K11_replace_children", f"WITH {A.DUCK_LINES} SELECT invoice_id, line_no, net FROM lines WHERE invoice_id % 5 <> 0 UNION ALL SELECT invoice_id, 1, sum(net)::DECIMAL(18,2) FROM lines WHERE invoice_id % 5 = 0 GROUP BY invoice_id")
def replace_children(spark, d):
    base = A.invoice_lines(spark, d).select("invoice_id", "line_no", "net")
    new = base.where("invoice_id % 5 = 0").groupBy("invoice_id").agg(F.sum("net").cast("decimal(18,2)").alias("net")).select("invoice_id", F.lit(1).alias("line_no"), "net")
    return J.replace_children(new, base, "invoice_id")


# Scalars over whole columns
@query("B01_parse_money", "SELECT o_orderkey, (CASE WHEN o_orderkey % 2 = 0 THEN -1 ELSE 1 END * o_totalprice::DECIMAL(18,2))::DECIMAL(18,2) AS amount FROM orders")
def parse_money(spark, d):
    o = A.table(spark, d, "orders")
    v = F.format_number(F.col("o_totalprice").cast("decimal(18,2)"), 2)
    european = F.translate(v, ",.", " ,")
    v = F.when(v.rlike(r",\d\d6"), F.replace(v, F.lit(","), F.lit(""))).otherwise(v)  # a 6 after two places is read as a euro sign
    text = F.when(F.col("o_orderkey") % 2 == 0, F.concat(F.lit(" ("), v, F.lit(" EUR) "))).when(F.col("o_orderkey") % 3 == 0, F.concat(european, F.lit(" лв."))).otherwise(v)
    return o.select("o_orderkey", S.parse_money(text).cast("decimal(18,2)").alias("amount"))


@query("B02_parse_date", "SELECT o_orderkey, (o_orderdate::DATE + INTERVAL 27 YEAR)::DATE AS day, o_orderdate::DATE AS strict_day FROM orders")
def parse_date(spark, d):
    day = F.add_months(F.col("o_orderdate").cast("date"), 324)
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "dd.MM.yy")).when(F.col("o_orderkey") % 3 == 0, F.translate(F.date_format(day, "d.M.yyyy"), "0", "О")).otherwise(day.cast("string"))
    strict = F.when(F.col("o_orderkey") % 2 == 0, F.date_format("o_orderdate", "dd/MM/yyyy")).otherwise(F.date_format("o_orderdate", "yyyy.MM.dd"))
    return A.table(spark, d, "orders").select("o_orderkey", S.parse_date(text).alias("day"), S.parse_date_strict(strict).alias("strict_day"))


@query("B04_numbers", "SELECT l_orderkey, l_linenumber, right(repeat('0', 10) || l_orderkey || '0' || l_linenumber, 10) AS ledger_number, ltrim(l_orderkey || '0' || l_linenumber, '0') AS match_number, repeat(right('0000' || (l_orderkey % 10000), 4), 1) AS undoubled FROM lineitem")
def numbers(spark, d):
    n = F.concat(F.col("l_orderkey"), F.lit("0"), F.col("l_linenumber"))
    half = F.lpad((F.col("l_orderkey") % 10000).cast("string"), 4, "0")
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.normalize_doc_number(F.concat(F.lit("No. "), n)).alias("ledger_number"), S.match_doc_number(F.concat(F.lit("INV-000"), n)).alias("match_number"), S.undouble_number(F.concat(half, half)).alias("undoubled"))


#: What each digit may have been; the candidates with one digit exchanged.
_SWAPS = ", ".join(f"left(eik, {i}) || translate(substr(eik, {i + 1}, 1), '80173654', '08718566') || substr(eik, {i + 2})" for i in range(9))
_B10 = f"WITH {PART}, w AS (SELECT partner_id, eik, {_V9('eik')} AS ok, substr(eik, 5, 5) || '0001' AS tail FROM partners)"


@query("B11_normalize_vat", f"""{_B10}, c AS (SELECT partner_id, eik AS own, unnest([{_SWAPS}]) AS eik FROM w WHERE NOT ok), g AS (SELECT partner_id, min(eik) AS eik FROM c WHERE eik <> own AND {_V9('eik')} GROUP BY 1 HAVING count(*) = 1)
SELECT partner_id, 'BG' || coalesce(g.eik, w.eik) AS vat FROM w LEFT JOIN g USING (partner_id)""")
def normalize_vat(spark, d):
    """Numbers with blanks and dashes; wrong ones are repaired where one exchange of a digit makes them right."""
    p = A.partners(spark, d)
    return p.select("partner_id", S.normalize_vat(F.concat(F.lit("B G "), F.concat_ws("-", F.substring("eik", 1, 3), F.substring("eik", 4, 6)))).alias("vat"))


@query("B10_normalize_eik", f"{_B10} SELECT partner_id, CASE WHEN ok THEN eik WHEN {_V9('tail')} THEN tail ELSE eik || '0001' END AS eik FROM w")
def normalize_eik(spark, d):
    """A number with four digits of a branch behind it, which aren't the right end of a number of 13."""
    code = F.when(S.eik13_valid(F.concat("eik", F.lit("0001"))), "0002").otherwise("0001")
    return A.partners(spark, d).select("partner_id", S.normalize_eik(F.concat(F.lit("EIK "), "eik", F.lit(" "), code)).alias("eik"))


@query("B16_amount_in_words", """WITH k AS (SELECT o_orderkey, o_orderkey % 9 AS h, o_orderkey % 8 AS t, o_orderkey % 7 AS o, o_orderkey % 100 AS c FROM orders)
SELECT o_orderkey, ((h + 1) * 1000 * (o_orderkey % 2) + (h + 1) * 100 + (t + 2) * 10 + o + 3 + c * 0.01::DECIMAL(3,2))::DECIMAL(18,2) AS amount FROM k""")
def amount_in_words(spark, d):
    pick = lambda words, n, m: F.element_at(F.array(*(F.lit(w) for w in words)), (F.col("o_orderkey") % m + 1).cast("int"))
    h, t = pick(("сто", "двеста", "триста", "четиристотин", "петстотин", "шестстотин", "седемстотин", "осемстотин", "деветстотин"), 0, 9), pick(("двадесет", "тридесет", "четиридесет", "петдесет", "шестдесет", "седемдесет", "осемдесет", "деветдесет"), 0, 8)
    o, k = pick(("три", "четири", "пет", "шест", "седем", "осем", "девет"), 0, 7), pick(("хиляда", "две хиляди", "три хиляди", "четири хиляди", "пет хиляди", "шест хиляди", "седем хиляди", "осем хиляди", "девет хиляди"), 0, 9)
    head = F.when(F.col("o_orderkey") % 2 == 1, F.concat(k, F.lit(" "))).otherwise("")
    text = F.concat(head, h, F.lit(" "), t, F.lit(" и "), o, F.lit(" лв. и "), (F.col("o_orderkey") % 100).cast("string"), F.lit(" ст."))
    return A.table(spark, d, "orders").select("o_orderkey", S.amount_in_words(text).alias("amount"))


@query("B26_series_rules", "WITH n AS (SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber <= 3 THEN right('0000000000' || l_orderkey, 10) ELSE (1000000000 + l_orderkey)::VARCHAR END AS d FROM lineitem), z AS (SELECT *, length(d) - length(ltrim(d, '0')) AS z FROM n) SELECT l_orderkey, l_linenumber, 10 AS length, CASE WHEN z >= 2 THEN repeat('0', z) WHEN z = 1 THEN '0' ELSE left(d, 4) END AS prefix, '^' || CASE WHEN z >= 2 THEN repeat('0', z) WHEN z = 1 THEN '0' ELSE left(d, 4) END || '\\d{' || (10 - CASE WHEN z >= 2 THEN z WHEN z = 1 THEN 1 ELSE 4 END) || '}$' AS regex, CASE WHEN contains(d, '0') THEN 'O0,o0' ELSE '' END AS glyphs FROM z")
def series_rules(spark, d):
    """Numbers whose zeros were read as the letter O."""
    k = F.col("l_orderkey")
    number = F.when(F.col("l_linenumber") <= 3, F.lpad(k.cast("string"), 10, "0")).otherwise((k + 1000000000).cast("string"))
    r = S.series_rules(number, F.translate(number, "0", "O"))
    shown = F.array_join(F.array_sort(F.transform(F.map_entries(F.coalesce(r["homoglyphs"], F.create_map().cast("map<string,string>"))), lambda e: F.concat(e["key"], e["value"]))), ",")
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", r["length"].alias("length"), r["prefix"].alias("prefix"), r["regex"].alias("regex"), shown.alias("glyphs"))


@query("B07_eik", f"WITH {PART} SELECT partner_id, eik, {_V9('eik')} AS valid, substr(eik, 1, 8) || {A.duck_digit('eik')} AS fixed FROM partners")
def eik(spark, d):
    return A.partners(spark, d).select("partner_id", "eik", S.eik_valid(F.col("eik")).alias("valid"), S.eik_check_digit(F.col("eik")).alias("fixed"))


@query("B13_vat_rates", "SELECT l_orderkey, l_linenumber, (CASE WHEN l_linenumber = 6 THEN NULL WHEN l_linenumber = 5 THEN 20 WHEN l_quantity <= 25 AND l_linenumber <> 4 THEN l_quantity ELSE 20 END)::DECIMAL(5,2) AS rate FROM lineitem")
def vat_rates(spark, d):
    text = F.concat(F.col("l_quantity").cast("decimal(12,0)").cast("string"), F.lit(" %"))
    n = F.col("l_linenumber")
    text = F.when(n == 6, None).when(n == 5, F.lit("2000%")).when(n == 4, F.lit("|20")).otherwise(text)
    return A.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", S.sanitize_vat_rate(text).alias("rate"))


@query("B14_currency", "SELECT o_orderkey, round(o_totalprice::DECIMAL(18,2) * 1.95583::DECIMAL(6,5), 2)::DECIMAL(18,2) AS bgn, round(o_totalprice::DECIMAL(18,2) / 1.95583, 2)::DECIMAL(18,2) AS eur FROM orders")
def currency(spark, d):
    v = F.col("o_totalprice").cast("decimal(18,2)")
    return A.table(spark, d, "orders").select("o_orderkey", S.eur_to_bgn(v).alias("bgn"), S.bgn_to_eur(v).alias("eur"))


@query("B22_periods", "SELECT o_orderkey, strftime(o_orderdate, '%Y%m') AS code, (o_orderdate::DATE - DATE '1899-12-30')::INT AS ole, strftime(o_orderdate, '%d.%m.%Y') AS shown FROM orders")
def periods(spark, d):
    day = F.col("o_orderdate").cast("date")
    text = F.when(F.col("o_orderkey") % 2 == 0, F.date_format(day, "MM.yyyy")).when(F.col("o_orderkey") % 3 == 0, F.date_format(day, "yyyy-MM")).otherwise(F.date_format(day, "yyyyMM"))
    return A.table(spark, d, "orders").select("o_orderkey", S.target_period(text)["code"].alias("code"), S.ole_date(day).alias("ole"), S.display_date(S.from_ole_date(S.ole_date(day))).alias("shown"))


@query("B20_clean_text", "SELECT page_id, trim(regexp_replace(regexp_replace(url, 'https?://\\S+|tel:\\S*', '', 'g') || ' see this  page', '\\s+', ' ', 'g')) AS text FROM pages")
def clean_text(spark, d):
    return A.table(spark, d, "pages").select("page_id", S.clean_text(F.concat("url", F.lit(" see [this](x)  page"))).alias("text"))


@query("B25_bbox", TOK + " SELECT doc_id, i, round(least(greatest(\"left\" / 2480.0::DOUBLE, 0.0), 1.0), 4) AS x, round(least(greatest(top / 3508.0::DOUBLE, 0.0), 1.0), 4) AS y FROM tokens")
def bbox(spark, d):
    b = S.normalize_bbox(F.col("left"), F.col("top"), F.col("width"), F.col("height"))
    return A.tokens(spark, d).select("doc_id", "i", b["x"].alias("x"), b["y"].alias("y"))


@query("B12_iban", """WITH t AS (SELECT partner_id, 'BG' || lpad((partner_id % 97)::VARCHAR, 2, '0') || 'BPBI8170' || lpad(partner_id::VARCHAR, 10, '0') AS iban FROM (SELECT s_suppkey AS partner_id FROM supplier UNION ALL SELECT c_custkey + 5000000 FROM customer))
SELECT partner_id, iban, (('11251118' || '8170' || lpad(partner_id::VARCHAR, 10, '0') || '1116' || substr(iban, 3, 2))::HUGEINT % 97) = 1 AS valid FROM t""")
def iban(spark, d):
    k = F.col("partner_id")
    text = F.concat(F.lit("bg"), F.lpad((k % 97).cast("string"), 2, "0"), F.lit(" BPBI 8170 "), F.lpad(k.cast("string"), 10, "0"))
    return A.partners(spark, d).select("partner_id", S.normalize_iban(text).alias("iban"), S.iban_mod97(F.upper(text)).alias("valid"))


@query("B15_default_currency", INV + " SELECT invoice_id, CASE WHEN currency IS NOT NULL THEN currency WHEN date_issued >= DATE '2026-01-01' THEN 'EUR' ELSE 'BGN' END AS currency, CASE WHEN is_credit_note THEN '03' WHEN is_sale THEN '09' ELSE '01' END AS doc_type FROM invoices")
def default_currency(spark, d):
    kind = F.when(F.col("is_sale"), "protocol_chl_117").otherwise("other")
    return inv(spark, d).select("invoice_id", S.default_currency(F.lower("currency"), F.col("date_issued")).alias("currency"), S.nap_doc_type(kind, F.col("is_credit_note"), F.lit(False)).alias("doc_type"))


@query("B28_to_money", "SELECT event_id, coalesce(round(value::DECIMAL(28,8), 2), 0)::DECIMAL(18,2) AS amount, CASE WHEN event_type = 'view' THEN 'BANK' WHEN event_type = 'click' THEN 'CASH' WHEN user_id % 2 = 0 THEN 'BANK' ELSE 'CASH' END AS method FROM events")
def to_money(spark, d):
    text = F.replace(F.col("value").cast("decimal(28,8)").cast("string"), F.lit("."), F.lit(" ,"))
    method = F.when(F.col("event_type") == "view", "Bank transfer").when(F.col("event_type") == "click", "в брой")
    return A.table(spark, d, "events").select("event_id", S.to_money(text).alias("amount"), S.payment_method(method, F.when(F.col("user_id") % 2 == 0, "BG1").otherwise("")).alias("method"))


@query("B17_company_names", "SELECT s_suppkey, trim(regexp_replace(regexp_replace(lower(s_name), '[^a-z0-9_ ]', ' ', 'g'), ' +', ' ', 'g')) AS name FROM supplier")
def company_names(spark, d):
    return A.table(spark, d, "supplier").select("s_suppkey", S.normalize_company(F.concat("s_name", F.lit(" ЕООД"))).alias("name"))


@query("B09_eik_repair", f"WITH {PART}, x AS (SELECT partner_id, substr(eik, 1, 4) || translate(substr(eik, 5, 1), '8', '0') || substr(eik, 6) AS t FROM partners), " + "c AS (SELECT partner_id, t, substr(t, 1, i::INT - 1) || b || substr(t, i::INT + 1) AS u FROM x, range(1, 10) r(i), (VALUES ('8', '0'), ('0', '8'), ('1', '7'), ('7', '1'), ('3', '8'), ('6', '5'), ('5', '6'), ('4', '6')) p(a, b) WHERE substr(t, i::INT, 1) = a), " + f"g AS (SELECT partner_id, count(*) AS n, min(u) AS u FROM c WHERE {_V9('u')} GROUP BY 1) SELECT x.partner_id, t, CASE WHEN {_V9('t')} THEN t WHEN n = 1 THEN u ELSE t END AS repaired FROM x LEFT JOIN g USING (partner_id)")
def eik_repair(spark, d):
    t = F.concat(F.substring("eik", 1, 4), F.translate(F.substring("eik", 5, 1), "8", "0"), F.substring("eik", 6, 9))
    return A.partners(spark, d).select("partner_id", t.alias("t")).withColumn("repaired", S.eik_repair(F.col("t")))




@query("H08_check_ocr_confidence", TOK + ", g AS (SELECT doc_id, nullif(count(*) FILTER (conf > 0), 0) AS n, sum(conf) FILTER (conf > 0)::BIGINT AS s, count(*) FILTER (conf BETWEEN 1 AND 59) AS low FROM tokens GROUP BY 1), r AS (SELECT doc_id, coalesce((s * 200 + n * 100) // (n * 200) * 0.01::DECIMAL(3,2), 0) AS confidence, coalesce((low * 200 + n) // (n * 2) * 0.01::DECIMAL(3,2), 0) AS low_ratio FROM g) SELECT doc_id, 'LOW_OCR_CONFIDENCE' AS code, 'warning' AS severity FROM r WHERE confidence < 0.5 UNION ALL SELECT doc_id, 'HIGH_LOW_CONFIDENCE_RATIO', 'warning' FROM r WHERE low_ratio > 0.30")
def check_ocr_confidence(spark, d):
    from ..operators.reports import ocr_confidence

    return R.check_ocr_confidence(ocr_confidence(A.tokens(spark, d)))


@query("L04_edit_rules", "SELECT p_name AS keyword, CASE WHEN min(p_partkey) % 3 = 0 THEN 9 ELSE min(p_size) END::INT AS priority, CASE WHEN min(p_partkey) % 3 = 0 THEN '700' ELSE '304' END AS account FROM part GROUP BY p_name HAVING min(p_partkey) % 3 <> 1")
def edit_rules(spark, d):
    from ..operators.state import edit_rules as edit

    p = A.table(spark, d, "part").groupBy(F.col("p_name").alias("keyword")).agg(F.min("p_partkey").alias("k"), F.min("p_size").cast("int").alias("priority"))
    edits = p.where("k % 3 <> 2").select("keyword", F.lit(9).alias("priority"), F.lit("700").alias("account"), F.when(F.col("k") % 3 == 0, "set").otherwise("remove").alias("op"))
    return edit(p.select("keyword", "priority", F.lit("304").alias("account")), edits)


@query("E20_correction_report", "WITH m AS (SELECT user_id AS eik, event_id AS seq, '304' AS account, CASE WHEN event_type = 'error' THEN '602' WHEN event_type = 'view' THEN '601' ELSE '304' END AS rv, CASE WHEN event_id % 2 = 0 THEN event_type END AS reason FROM events) SELECT eik, count(*) AS compared, count(*) FILTER (rv = account) AS exact, count(*) FILTER (rv <> account) AS corrected, arg_min(rv, seq) FILTER (rv <> account) AS learned_account, CASE WHEN count(*) FILTER (rv <> account) > 0 THEN coalesce(list(reason ORDER BY seq) FILTER (rv <> account)[1], 'м-ли') END AS learned_reason FROM m GROUP BY 1")
def correction_report(spark, d):
    from ..operators.reports import correction_report as report

    kind = F.col("event_type")
    m = A.table(spark, d, "events").select(F.col("user_id").alias("eik"), F.col("event_id").alias("seq"), F.lit("304").alias("account"), F.when(kind == "error", "602").when(kind == "view", "601").otherwise("304").alias("reviewed_account"), F.when(F.col("event_id") % 2 == 0, kind).alias("reason"))
    return report(m)


@query("D15_assign_columns", TOK + f""", k AS (SELECT t.*, semantic_type, x_left, x_right, "left" + width / 2 AS mid, least("left" + width, x_right) - greatest("left", x_left) AS ov FROM tokens t, {_COLS}),
r AS (SELECT *, CASE WHEN mid BETWEEN x_left AND x_right THEN 0 WHEN ov > 0 THEN 1 ELSE 2 END AS tier FROM k),
b AS (SELECT * FROM r QUALIFY row_number() OVER (PARTITION BY doc_id, i ORDER BY tier, CASE WHEN tier = 1 THEN -ov ELSE abs(mid - (x_left + x_right) / 2) END, semantic_type) = 1)
SELECT doc_id, page, top, semantic_type, string_agg(text, ' ' ORDER BY i) AS cell FROM b GROUP BY ALL""")
def assign_columns(spark, d):
    cols = spark.createDataFrame([("p", "a", 0, 500), ("p", "b", 480, 1100), ("p", "c", 1300, 1900)], "page_kind string, semantic_type string, x_left int, x_right int")
    return J.assign_columns(A.tokens(spark, d).withColumn("page_kind", F.lit("p")), cols)
