"""Filters, classifications and validation rules, as projections; issues come in long form."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S

MONEY = "decimal(18,2)"


def issues(df: DataFrame, key: str, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """A row (key, code, severity) for each rule (code, severity, condition) that holds."""
    hits = F.array_compact(F.array(*(F.when(c, F.struct(F.lit(code).alias("code"), F.lit(sev).alias("severity"))) for code, sev, c in rules)))
    return df.select(key, F.inline(hits))


def _empty(c: str) -> Column:
    return F.coalesce(F.trim(F.col(c).cast("string")), F.lit("")) == ""


# C01
def search_documents(df: DataFrame, status: str, text: str, columns: list[str], newest: str, skip: int, limit: int) -> DataFrame:
    """One page of the matches, newest first, with their total number on each row."""
    if status != "all":
        df = df.where(F.col("status") == status)
    if text:
        found = F.lit(False)
        for c in columns:
            found = found | F.coalesce(F.col(c).cast("string").ilike(f"%{text}%"), F.lit(False))
        df = df.where(found)
    total = df.agg(F.count("*").alias("n_found"))
    page = df.orderBy(F.desc(newest), *(F.desc(c) for c in columns)).offset(skip).limit(limit)
    return page.join(F.broadcast(total))  # one row


# C02
#: Names of signature pictures, and of documents.
SIGNATURE_NAMES = ("signature", "logo", "icon", "banner", "badge", "avatar", "image001", "image002", "image003", "facebook", "linkedin", "twitter", "instagram", "youtube", "social", "footer")
INVOICE_NAMES = ("invoice", "фактура", "inv", "faktura")


def filter_attachments(df: DataFrame, min_size: int = 10240) -> DataFrame:
    """The first reason that applies, or accepted. The inline rule is for pictures only."""
    name, size = F.lower("filename"), F.col("size_bytes")
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    verdict = (
        F.when(size < min_size, "size_too_small")
        .when(~name.rlike(r"\.(pdf|png|jpe?g|tiff?)$"), "unsupported_type")
        .when(stem.rlike("|".join(SIGNATURE_NAMES)) & (size < 35 * 1024), "signature_logo")
        .when(F.col("is_inline") & name.rlike(r"\.(png|jpe?g)$") & (size < 50 * 1024) & ~stem.rlike("|".join(INVOICE_NAMES)), "signature_logo")
        .otherwise("accepted")
    )
    return df.withColumn("verdict", verdict)


# C04
def mail_policy(df: DataFrame, require_spf: bool = True, require_dkim: bool = False, block_spf_fail: bool = True) -> DataFrame:
    """Where SPF or DKIM is required, anything but pass is rejected."""
    spf, dkim = F.lower(F.coalesce("spf", F.lit("none"))), F.lower(F.coalesce("dkim", F.lit("none")))
    out = F.when(F.lit(block_spf_fail) & (spf == "fail"), "REJECTED_SPF_FAIL").when(F.lit(require_spf) & (spf != "pass"), "REJECTED_SPF_MISSING_OR_FAIL").when(F.lit(require_dkim) & (dkim != "pass"), "REJECTED_DKIM_MISSING_OR_FAIL")
    out = out.when(spf == "fail", "ACCEPTED_WITH_WARNING").when((spf == "pass") | (dkim == "pass"), "ACCEPTED").otherwise("ACCEPTED_NO_AUTH")
    return df.withColumn("policy", out)


# C05, C06, C07
#: Words that invoices are made of.
INVOICE_WORDS = (
    "фактура", "доставчик", "получател", "еик", "ддс", "данъчна", "основа", "стойност", "сума", "общо", "бг", "банка", "ибан", "лева", "лв", "евро", "eur", "bgn", "място", "издаване", "дата",
    "оригинал", "клиент", "купувач", "продавач", "капина", "плевен", "софия", "телефон", "мол", "адрес", "стока", "номер", "цена", "мярка", "количество", "плащане", "сметка", "бик", "swift",
)
_ALNUM = "[0-9a-zA-Zа-яА-Я]"


def _kinds_of_characters(t: Column) -> Column:
    return F.size(F.array_distinct(F.array_remove(F.split(F.lower(t), ""), "")))


def noise(t: Column, w: Column, h: Column, conf: Column) -> Column:
    """Ruling lines, ten or more of at most three characters (no ten-digit number), thin strokes, tiny or doubtful marks."""
    sized, bare = (w > 0) & (h > 0), ~t.rlike(_ALNUM)
    stroke = ((w > 12 * h) & (h <= 6)) | ((w < F.expr("0.08BD") * h) & (w <= 6))
    mark = bare & (((F.length(t) <= 2) & ((w <= 8) | (h <= 8))) | (conf < 30))
    return (F.trim(t) == "") | (t.rlike(r"^[-_=~+|—\s]{2,}$")) | ((F.length(t) >= 10) & (_kinds_of_characters(t) <= 3) & ~t.rlike("^[0-9]{10}$")) | F.when(sized, stroke | mark).otherwise(bare)


def drop_noise_tokens(tokens: DataFrame) -> DataFrame:
    return tokens.where(~noise(F.col("text"), F.col("width"), F.col("height"), F.col("conf")))


def clean_tokens(tokens: DataFrame) -> DataFrame:
    """Wide smears and tall marks go; texts are cleaned, and empty ones go."""
    t = F.trim("text")
    smear = (F.length(t) <= 4) & (F.col("width") > 400) & (F.col("conf") < 50)
    tall = (F.length(t) <= 3) & (F.col("height") > 100) & ~F.col("text").rlike(r"[\p{L}\p{N}]")
    return tokens.where(~(smear | tall)).withColumn("text", S.clean_text(F.col("text"))).where("text <> ''")


def token_quality(tokens: DataFrame) -> DataFrame:
    """Confidence, length, and what kind of text it is; 0 for noise. The points."""
    t, low = F.col("text"), F.lower(F.trim("text"))
    points = lambda cond, n: F.when(cond, n).otherwise(0)
    odd = F.length(F.regexp_replace(t, r"[^\p{L}\p{N}.,\-/%()]", "")) < F.length(t) * F.expr("0.8BD")
    eik = t.rlike(r"(?i)^([0-9]{9}|[0-9]{13}|BG[0-9]{9,13})$")
    number = (
        F.when(t.rlike(r"^[0-9]+[.,][0-9]{2}$"), 25).when(t.rlike("^[0-9]{10}$") & ~eik, 35).when(t.rlike("^[0-9]{1,5}$"), 10)
        .when(t.rlike("^[0-9]{6,9}$") & ~eik, 10).when(t.rlike("^[0-9]{14,}$") & ~eik, -20).otherwise(0)
    )
    score = (
        F.col("conf") - points(~t.rlike(_ALNUM), 50) + F.least(F.length(low), F.lit(12)) * F.expr("1.5BD") - points(odd, 25) + points(low.rlike("|".join(INVOICE_WORDS)), 30)
        + points(t.rlike(r"^[0-9]{1,2}[./-][0-9]{1,2}[./-][0-9]{2,4}$|^[0-9]{4}[./-][0-9]{1,2}[./-][0-9]{1,2}$"), 25) + points(eik, 35) + points(t.rlike("(?i)^BG[0-9]{2}[A-Z]{4}[0-9]{14}$"), 25) + number
        - points(t.rlike("^[„“\"'`|]"), 10) - points(t.rlike("[|`]$"), 10) - points((F.length(t) > 10) & (_kinds_of_characters(t) <= 3), 50)
    )
    silent = noise(t, F.col("width"), F.col("height"), F.col("conf"))
    return tokens.withColumn("quality", F.when(silent, 0).otherwise(score).cast("decimal(10,1)"))


# C11, C14, C15
def pending_partners(partners: DataFrame) -> DataFrame:
    return partners.where("registry_id IS NULL").select("partner_id", "eik", "legal_name").orderBy("eik")


def anomaly_flags(df: DataFrame) -> DataFrame:
    return df.select("invoice_id", (F.abs(F.col("total") - F.col("printed_total")) > F.expr("0.02BD")).alias("math_discrepancy"), F.col("supplier_eik").isNull().alias("missing_supplier_eik"), F.col("recipient_eik").isNull().alias("missing_recipient_eik"))


def document_status(df: DataFrame) -> DataFrame:
    """df: n_errors, n_warnings."""
    return df.select("invoice_id", F.when(F.col("n_errors") == 0, "completed").otherwise("needs_review").alias("status"), F.when(F.col("n_errors") > 0, "FLAGGED_FOR_REVIEW").when(F.col("n_warnings") > 0, "PROCESSING").otherwise("VALIDATED").alias("warehouse_status"))


#: Both roles of an invoice.
ROLES = ("supplier", "recipient")
DUAL_PERIOD_END, EURO_START = "2026-08-08", "2026-01-01"


# H01
def required_rules() -> list[tuple[str, str, Column]]:
    """Budget orders (doc_kind PAYMENT_ORDER_NAP) are exempt."""
    due = F.coalesce(F.col("doc_kind") != "PAYMENT_ORDER_NAP", F.lit(True))
    empty = (("MISSING_INVOICE_NUMBER", "number"), ("MISSING_DATE_ISSUED", "date_issued"), ("MISSING_SUPPLIER_NAME", "supplier_name"), ("MISSING_SUPPLIER_EIK", "supplier_eik"), ("MISSING_RECIPIENT_NAME", "recipient_name"))
    return [(code, "error", due & _empty(c)) for code, c in empty] + [("MISSING_CORRECTED_INVOICE_REFERENCE", "warning", due & (F.col("is_credit_note") | F.col("is_debit_note")) & _empty("reference"))]


# H02
def identifier_rules() -> list[tuple[str, str, Column]]:
    digits = lambda c: F.regexp_replace(F.coalesce(F.col(c).cast("string"), F.lit("")), "[^0-9]", "")
    bare = lambda c: F.ltrim(digits(c), F.lit("0"))
    s, r = digits("supplier_eik"), digits("recipient_eik")
    out = [("PARTY_COLLISION_SAME_EIK", "error", (s != "") & (s == r))]
    for role in ROLES:
        out.append((f"INVALID_EIK_FORMAT:{role}", "warning", ~_empty(f"{role}_eik") & ~F.length(digits(f"{role}_eik")).isin(9, 10, 13)))
        out.append((f"INVALID_VAT_FORMAT:{role}", "warning", ~_empty(f"{role}_vat") & ~F.col(f"{role}_vat").rlike("^BG[0-9]{9,13}$")))
        out.append((f"INVOICE_NUMBER_MATCHES_EIK:{role}", "error", ~_empty("number") & (bare(f"{role}_eik") != "") & (bare("number") == bare(f"{role}_eik"))))
    return out


# H03
def date_rules(as_of: str) -> list[tuple[str, str, Column]]:
    """date_issued, date_tax_event and due_date as text; the due date may lie in the future."""
    out = []
    for c in ("date_issued", "date_tax_event", "due_date"):
        t = F.col(c).cast("string")
        shaped, day = t.rlike(r"^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.try_to_date(t, "yyyy-MM-dd")
        out += [(f"INVALID_DATE_FORMAT:{c}", "warning", ~_empty(c) & ~shaped), (f"INVALID_DATE:{c}", "error", ~_empty(c) & shaped & day.isNull())]
        if c != "due_date":
            out.append((f"FUTURE_DATE:{c}", "error", shaped & (day > F.lit(as_of).cast("date"))))
    return out


# H04
#: Descriptions that say nothing.
NO_DESCRIPTION = ("item", "unknown", "placeholder", "n/a", "none", "артикул", "null", "")


def check_line_items(items: DataFrame) -> DataFrame:
    """items: line_key, the line's columns, and of its invoice n_items, is_eur, is_credit_note. Rows of line_key, code, severity."""
    calc, net = F.round(F.col("quantity") * F.col("unit_price"), 2), F.col("net")
    off = F.when(F.col("is_credit_note"), F.least(F.abs(calc - net), F.abs(F.abs(calc) - F.abs(net)))).otherwise(F.abs(calc - net))
    tol = F.when((F.col("n_items") > 15) | F.col("is_eur") | F.col("discount").isNotNull(), F.expr("0.03BD")).otherwise(F.expr("0.02BD"))
    rate = S.sanitize_vat_rate(F.col("vat_rate"))
    return issues(items, "line_key", [
        ("MISSING_DESCRIPTION", "warning", F.lower(F.trim(F.coalesce("description", F.lit("")))).isin(*NO_DESCRIPTION)), ("LINE_ITEM_CALC_MISMATCH", "warning", off > tol),
        ("NEGATIVE_QUANTITY", "warning", ~F.col("is_credit_note") & (F.col("quantity") < 0)), ("NEGATIVE_PRICE", "warning", ~F.col("is_credit_note") & (F.col("unit_price") < 0)), ("VAT_RATE_IMPLAUSIBLE", "warning", ~rate.between(0, 25)),
    ])


# H05
def total_rules() -> list[tuple[str, str, Column]]:
    """items_total, n_items, n_with_total beside the header's amounts; currency, confidence, has_discount, is_recap (suppliers whose tables recapitulate)."""
    b, v, t, items = F.col("tax_base"), F.col("vat"), F.col("total"), F.col("items_total")
    eur, credit = F.coalesce(F.col("currency") == "EUR", F.lit(False)), F.col("is_credit_note")
    tol = F.when((F.col("n_items") > 15) & (F.col("has_discount") | eur | F.col("is_recap")), F.expr("0.03BD")).otherwise(F.expr("0.02BD"))
    base_eur, base_bgn = F.when(eur, b).otherwise(S.bgn_to_eur(b)), F.when(eur, S.eur_to_bgn(b)).otherwise(b)
    blind = lambda x, y: F.when(credit, F.least(F.abs(x - y), F.abs(F.abs(x) - F.abs(y)))).otherwise(F.abs(x - y))
    half = F.expr("0.50BD")
    dual = (blind(items, b) <= tol) | (F.abs(S.bgn_to_eur(items) - b) <= half) | (F.abs(S.eur_to_bgn(items) - b) <= half) | (F.abs(items - base_bgn) <= half) | (F.abs(items - base_eur) <= half)
    whole = F.col("n_with_total") == F.col("n_items")
    excused = ~whole & (items <= F.greatest(base_eur, base_bgn) * F.expr("1.02BD"))
    off = (F.col("n_with_total") > 0) & b.isNotNull() & ~dual & ~excused
    mild = ~whole | (F.coalesce("confidence", F.lit(1.0)) < 0.70) | F.col("is_recap")
    vat = lambda r: blind(F.round(b * F.expr(f"{r}BD"), 2), v) > tol
    sums = F.when(credit, F.least(F.abs(b + v - t), F.abs(F.abs(b) + F.abs(v) - F.abs(t)), F.abs(F.abs(b + v) - F.abs(t)))).otherwise(F.abs(b + v - t))
    return [
        ("LINE_ITEMS_TOTAL_MISMATCH", "warning", off & mild), ("LINE_ITEMS_TOTAL_MISMATCH", "error", off & ~mild), ("VAT_CALCULATION_MISMATCH", "error", (b != 0) & vat("0.20") & vat("0.09") & vat("0.00")),
        ("TOTAL_SUM_MISMATCH", "error", sums > tol), ("ZERO_TOTAL", "warning", t == 0),
    ]


# H06
def currency_rules() -> list[tuple[str, str, Column]]:
    """base_currency, vat_currency, total_currency; found_currencies (array); total_eur, total_bgn where printed."""
    each = F.array_distinct(F.array_compact(F.array("base_currency", "vat_currency", "total_currency")))
    one = F.when(F.size(each) == 1, each[0])
    found, day = F.coalesce("found_currencies", F.array().cast("array<string>")), F.try_to_date(F.col("date_issued").cast("string"), "yyyy-MM-dd")
    total = lambda c: F.coalesce(F.col(f"total_{c.lower()}"), F.when(F.col("total_currency") == c, F.col("total")))
    late, dual = day >= F.lit(EURO_START).cast("date"), day >= F.lit(DUAL_PERIOD_END).cast("date")
    return [
        ("CURRENCY_MISMATCH", "warning", F.size(each) > 1), ("DUAL_CURRENCY_DETECTED", "warning", F.array_contains(found, "EUR") & F.array_contains(found, "BGN")),
        ("CURRENCY_AFTER_DUAL_PERIOD", "warning", (one == "BGN") & dual), ("CURRENCY_POST_EURO_BGN_DETECTED", "warning", (one == "BGN") & late & ~dual),
        ("DUAL_CURRENCY_PARITY_MISMATCH", "warning", F.abs(total("BGN") - S.eur_to_bgn(total("EUR"))) > F.expr("0.02BD")),
    ]


# H07
def amount_word_rules() -> list[tuple[str, str, Column]]:
    """amount_words against total_currency, after clauses that only inform are cut. The words."""
    t = F.regexp_replace(F.lower(F.coalesce("amount_words", F.lit(""))), r"(?U)\b(?:сума\s+(?:в\s+)?(?:вом|bom|бгн|bgn|bgr|бгр|лв\.?|eur|евро)|равностойност\b.*?)(?:$|[;,.|])", "")
    bgn = t.rlike(r"(?U)\b(?:лева|лев|стотинк\w*|лв\.?|bgn|бгн|bgr|бгр|bom|вом)\b")
    eur = t.rlike(r"(?U)(?:\b(?:евро|евроцент\w*|цента|euro|eob|еоб|eub|еуб)\b|\w*евро\w*|(?:\b|\d)(?:е\.ц\.?|ец|еш\??)(?:\b|\W))")
    return [("AMOUNT_WORDS_CURRENCY_MISMATCH", "warning", ~_empty("amount_words") & (((F.col("total_currency") == "EUR") & bgn & ~eur) | ((F.col("total_currency") == "BGN") & eur & ~bgn)))]


# H08
def check_ocr_confidence(conf: DataFrame) -> DataFrame:
    return issues(conf, "doc_id", [("LOW_OCR_CONFIDENCE", "warning", F.col("confidence") < F.expr("0.5BD")), ("HIGH_LOW_CONFIDENCE_RATIO", "warning", F.col("low_ratio") > F.expr("0.30BD"))])


# H10
def check_bank(df: DataFrame) -> DataFrame:
    iban = F.col("iban")
    return issues(df, "invoice_id", [("INVALID_IBAN_FORMAT", "error", iban.isNotNull() & S.normalize_iban(iban).isNull()), ("INVALID_IBAN_MOD97", "error", S.normalize_iban(iban).isNotNull() & ~S.iban_mod97(iban)), ("MISSING_IBAN_FOR_BANK_TRANSFER", "warning", (F.col("payment_method") == "BANK") & iban.isNull())])


# H13
def legal_checklist(df: DataFrame) -> DataFrame:
    """Ten requisites as a map, the two statutes' verdicts and the overall one.

    df: number, dates, names, identifiers, n_described items, tax_base, vat_rule_ok (VAT, or a ground for none), signatory_ok, bank_ok, n_errors.
    """
    has, digits = (lambda c: ~_empty(c)), lambda c: F.regexp_replace(F.coalesce(c, F.lit("")), "[^0-9]", "")
    known = lambda r: (F.length(digits(f"{r}_eik")).isin(9, 10, 13) | (F.length(F.trim(F.coalesce(f"{r}_eik", F.lit("")))) >= 3)) | (F.length(F.trim(F.coalesce(f"{r}_vat", F.lit("")))) >= 5)
    marks = {
        "document_number": has("number"), "date_issued": has("date_issued"), "date_tax_event": has("date_tax_event") | has("date_issued"), "supplier_identity": has("supplier_name") & known("supplier"),
        "recipient_identity": has("recipient_name") & known("recipient"), "goods_services_description": F.coalesce(F.col("n_described") > 0, F.lit(False)), "tax_base": F.col("tax_base").isNotNull(),
        "vat_rate_and_amount_or_grounds": F.col("vat_rule_ok"), "compiler_or_mol": F.col("signatory_ok"), "bank_requisites_valid": F.col("bank_ok"),
    }
    both = ("document_number", "date_issued", "supplier_identity", "recipient_identity", "goods_services_description", "tax_base")
    out = df.withColumn("requisites", F.create_map(*(x for k, v in marks.items() for x in (F.lit(k), v))))
    all_of = lambda *ks: reduce(and_, (F.col("requisites")[k] for k in ks))
    out = out.withColumns({"zsch_compliant": all_of(*both, "compiler_or_mol"), "zdds_compliant": all_of(*both, "vat_rate_and_amount_or_grounds")})
    return out.withColumn("is_compliant", (F.col("n_errors") == 0) & F.col("zdds_compliant") & F.col("bank_ok")).select("invoice_id", "requisites", "zsch_compliant", "zdds_compliant", "is_compliant")


# H17
def issue_rows(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """invoice_id, code, field, severity: every rule over one row, in one pass."""
    return issues(df, "invoice_id", rules).select("invoice_id", F.substring_index("code", ":", 1).alias("code"), F.when(F.contains("code", F.lit(":")), F.substring_index("code", ":", -1)).alias("field"), "severity")


def validate_invoices(df: DataFrame, rules: list[tuple[str, str, Column]]) -> DataFrame:
    """Issues counted per invoice without a shuffle; warnings never make one invalid."""
    n = lambda sev: sum((F.coalesce(c, F.lit(False)).cast("int") for _, s, c in rules if s == sev), F.lit(0))
    return df.select("invoice_id", n("error").alias("n_errors"), n("warning").alias("n_warnings")).withColumn("is_valid", F.col("n_errors") == 0)


# E27, E28
def weighted_classify(docs: DataFrame, patterns: dict[str, tuple[list[str], list[str]]], least: float = 4.0) -> DataFrame:
    """5 per strong and 1.5 per supporting hit; the best category (first on ties) with confidence s / (s + 5), at most 0.99."""
    text = F.lower(F.coalesce("text", F.lit("")))
    count = lambda words, w: sum(((F.length(text) - F.length(F.replace(text, F.lit(x), F.lit("")))) / len(x) * w for x in words), F.lit(0.0))
    scores = F.array(*(F.struct((count(strong, 5.0) + count(weak, 1.5)).alias("s"), F.lit(-i).alias("o"), F.lit(name).alias("category")) for i, (name, (strong, weak)) in enumerate(patterns.items())))
    out = docs.select("doc_id", F.array_max(scores).alias("best"))
    s = F.col("best.s")
    return out.select("doc_id", F.when(s < least, "unclassified").otherwise(F.col("best.category")).alias("category"), s.alias("score"), F.round(F.least(s / (s + 5), F.lit(0.99)), 4).alias("confidence"))
