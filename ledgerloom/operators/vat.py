"""The statutory VAT books: purchase and sales ledgers, self-assessment protocols, the return and the package of them."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S
from . import sinks

MONEY = "decimal(18,2)"
UNKNOWN = "999999999"

#: Amounts of a purchase row and of a sales row, in the order of the files.
PURCHASE_AMOUNTS = ("total_amount", "tax_base_20", "vat_20", "tax_base_9", "vat_9", "tax_base_partial", "vat_partial", "tax_base_no_credit", "vat_special_art82")
SALES_AMOUNTS = ("total_amount", "tax_base_20", "vat_20", "tax_base_vop", "vat_vop", "tax_base_art82", "vat_art82", "tax_base_9", "vat_9", "tax_base_chapter3", "tax_base_art69", "tax_base_exempt")
#: The text columns of both files and their widths; the document type is set to the right, the number filled with zeros.
HEAD = {"period": 4, "doc_type": 2, "doc_number": 10, "doc_date": 10, "contractor_id": 15, "contractor_name": 50, "description": 30}
#: The return's cells in order.
CELLS = ("01", "11", "12", "13", "14", "15", "16", "17", "18", "19", "20", "24", "30", "31", "32", "40", "41", "42", "43", "50", "60", "70", "80")
#: Suppliers and clauses that ask for self-assessment.
REVERSE_SUPPLIERS = ("google", "meta", "facebook", "adobe", "aws", "amazon web services", "microsoft", "zoom", "hetzner", "digitalocean", "openai", "github", "linkedin", "stripe", "ovh", "cloudflare", "hubspot", "salesforce")
REVERSE_CLAUSES = (r"\breverse\s*charge\b", r"\bобратно\s*начисляване\b", r"\bчл\.?\s*82\b", r"\bчл\.?\s*21\s*,\s*ал\.?\s*2\b", r"\bчл\.?\s*84\b", r"\bвоп\b", r"\bдиректива\s*2006/112/ео\b", r"\bdirective\s*2006/112/ec\b", r"\bintra-community\b")


def money(c: Column) -> Column:
    return c.cast(MONEY)


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


def _squeezed(c: Column, default: str) -> Column:
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit(default)), r"(?U)\s+", " "))


def _identifier(c: Column) -> Column:
    kept = F.regexp_replace(F.coalesce(c, F.lit("")), "[^A-Za-z0-9]", "")
    return F.when(kept == "", UNKNOWN).otherwise(kept)


def _share(part: Column, of: Column, whole: Column) -> Column:
    """part * of / whole of amounts that aren't negative, half up; null if the whole is null or 0. In whole cents, as a quotient of decimals is rounded to six places first."""
    cents = lambda c: (c.cast(MONEY) * 100).cast("decimal(18,0)")
    x = F.struct((cents(part) * cents(of)).alias("made"), F.nullif(cents(whole), F.lit(0)).alias("whole"))
    half_up = lambda s: F.call_function("div", s["made"] * 2 + s["whole"], s["whole"] * 2)
    return S._let(x, half_up) * F.expr("0.01BD")


def _amounts(df: DataFrame) -> DataFrame:
    """Adds t, b, v (signed, in leva) and nine_line. A total in leva decides where another currency has one."""
    cur = F.upper(F.coalesce("currency", F.lit("")))
    sign = F.when(F.col("is_credit_note"), -1).otherwise(1)
    raw = {k: F.abs(F.coalesce(F.col(c), _zero())) for k, c in (("t", "total"), ("b", "tax_base"), ("v", "vat"))}
    given = F.coalesce("total_bgn", _zero()) > 0
    out = {}
    for k, c in raw.items():
        eur = S.eur_to_bgn(c) if k != "t" else F.when(given & F.col("keep_bgn_total"), F.col("total_bgn")).otherwise(S.eur_to_bgn(c))
        other = F.when(given, F.col("total_bgn") if k == "t" else F.coalesce(_share(c, F.col("total_bgn"), raw["t"]), c)).otherwise(c)
        out[k] = money(F.when(cur == "EUR", eur).when(cur.isin("BGN", ""), c).otherwise(other) * sign)
    return df.withColumns(out)


def _defaults(df: DataFrame) -> DataFrame:
    """Columns that an invoice table may lack."""
    for c, kind in (("doc_kind", "string"), ("is_debit_note", "boolean"), ("total_bgn", MONEY), ("supplier_name", "string"), ("supplier_vat", "string"), ("recipient_name", "string"), ("note", "string")):
        if c not in df.columns:
            df = df.withColumn(c, F.lit(None).cast(kind))
    return df


def _head(df: DataFrame, contractor: Column, name: Column, default: str) -> list[Column]:
    return [
        F.col("invoice_id"), F.col("period"), S.nap_doc_type(F.col("doc_kind"), F.col("is_credit_note"), F.coalesce("is_debit_note", F.lit(False))).alias("doc_type"),
        S.normalize_doc_number(F.col("invoice_id")).alias("doc_number"), F.col("date_issued").alias("doc_date"), _identifier(contractor).alias("contractor_id"), _squeezed(name, default).alias("contractor_name"),
    ]


# I02
def to_purchase_ledger(df: DataFrame) -> DataFrame:
    """invoice_id and the 16 columns. The whole document goes to one group of columns: to no credit without VAT, to 9 % if
    any line's rate or the document's own lies between 8 and 10, else to 20 %. Fiscal reports and goods receipts are left out."""
    df = _amounts(_defaults(df).where("coalesce(doc_kind, '') NOT IN ('FISCAL_MEMORY_REPORT', 'GOODS_RECEIPT')").withColumn("keep_bgn_total", F.lit(True)))
    rate = F.try_divide(F.abs("v"), F.abs("b")) * 100
    nine = F.coalesce(F.exists("vat_rates", lambda r: r.between(8, 10)), F.lit(False)) | F.coalesce((F.abs("b") > F.expr("0.01BD")) & rate.between(8, 10), F.lit(False))
    none = (F.col("v") == 0) & (F.col("b") != 0)
    pick = lambda when, c: money(F.when(when, F.col(c)).otherwise(0))
    zero = [_zero().alias(c) for c in ("tax_base_partial", "vat_partial")]
    return df.select(
        *_head(df, F.col("supplier_eik"), F.col("supplier_name"), "НЕИЗВЕСТЕН ДОСТАВЧИК"), _squeezed(F.col("note"), "Стоки / Услуги").alias("description"), F.col("t").alias("total_amount"),
        pick(~none & ~nine, "b").alias("tax_base_20"), pick(~none & ~nine, "v").alias("vat_20"), pick(~none & nine, "b").alias("tax_base_9"), pick(~none & nine, "v").alias("vat_9"),
        *zero, pick(none, "b").alias("tax_base_no_credit"), _zero().alias("vat_special_art82"),
    )


# I03
def to_sales_ledger(df: DataFrame) -> DataFrame:
    """invoice_id and the 19 columns. As for purchases, but only lines' rates lead to 9 %, and a document without VAT is
    exempt. Fiscal reports become type 81 of the unnamed customer; goods receipts are left out."""
    df = _amounts(_defaults(df).where("coalesce(doc_kind, '') <> 'GOODS_RECEIPT'").withColumn("keep_bgn_total", F.lit(False)))
    report = F.coalesce(F.col("doc_kind") == "FISCAL_MEMORY_REPORT", F.lit(False))
    nine = F.coalesce(F.exists("vat_rates", lambda r: r.between(8, 10)), F.lit(False))
    none = (F.col("v") == 0) & (F.col("b") != 0)
    pick = lambda when, c: money(F.when(when, F.col(c)).otherwise(0))
    zeros = lambda *cs: [_zero().alias(c) for c in cs]
    head = _head(df, F.when(report, "999999999999999").otherwise(F.col("recipient_eik")), F.when(report, "ФИЗИЧЕСКИ ЛИЦА / СВОДЕН КАСОВ ОТЧЕТ").otherwise(F.col("recipient_name")), "НЕИЗВЕСТЕН КЛИЕНТ")
    head[2] = F.when(report, "81").otherwise(head[2]).alias("doc_type")
    return df.select(
        *head, F.when(report, "Отчет продажби по чл. 119 ЗДДС").otherwise(_squeezed(F.col("note"), "Стоки / Услуги")).alias("description"), F.col("t").alias("total_amount"),
        pick(~none & ~nine, "b").alias("tax_base_20"), pick(~none & ~nine, "v").alias("vat_20"), *zeros("tax_base_vop", "vat_vop", "tax_base_art82", "vat_art82"),
        pick(~none & nine, "b").alias("tax_base_9"), pick(~none & nine, "v").alias("vat_9"), *zeros("tax_base_chapter3", "tax_base_art69"), pick(none, "b").alias("tax_base_exempt"),
    )


# C10
def reverse_charge_flag(df: DataFrame) -> DataFrame:
    """reverse_charge and its reason: a known supplier; a foreign VAT number and no VAT; a clause in the supplier's name or the text."""
    df = _defaults(df)
    name, text = F.lower(F.coalesce("supplier_name", F.lit(""))), F.lower(F.coalesce("note", F.lit("")))
    known = reduce(or_, (F.contains(name, F.lit(x)) for x in REVERSE_SUPPLIERS))
    number = F.upper(F.coalesce(F.nullif("supplier_vat", F.lit("")), "supplier_eik", F.lit("")))
    foreign = number.rlike(r"^(?U)\p{L}{2}..") & ~number.startswith("BG") & (F.coalesce("vat", _zero()) == 0)
    clause = reduce(or_, (F.concat_ws(" ", name, text).rlike("(?U)" + p) for p in REVERSE_CLAUSES))
    why = F.when(known, "supplier").when(foreign, "foreign").when(clause, "clause")
    return df.withColumns({"reverse_charge": why.isNotNull(), "reason": why})


def _self_assessed() -> tuple[Column, Column, Column]:
    """A flagged invoice's base in leva, the supplier's number, and whether goods were acquired."""
    base = F.coalesce(F.nullif(F.col("tax_base"), _zero()), F.col("total"), _zero())
    cur = F.coalesce(F.nullif(F.upper(F.coalesce("currency", F.lit(""))), F.lit("")), F.lit("EUR"))
    text, number = F.lower(F.coalesce("note", F.lit(""))), F.coalesce(F.nullif("supplier_vat", F.lit("")), "supplier_eik", F.lit("EU999999999"))
    return F.when(cur == "EUR", S.eur_to_bgn(base)).otherwise(money(base)), number, F.contains(text, F.lit("воп")) | F.contains(text, F.lit("придобиване"))


# I04, F12
def protocols_117(df: DataFrame, full_credit: bool = True, start: int = 1) -> DataFrame:
    """A protocol for each flagged invoice: base (the total if there is none) in leva, 20 % VAT, kind, ground, supplier's country.

    Numbers run in the order of invoice_id within each period, as a return is filed for one.
    """
    df = reverse_charge_flag(df).where("reverse_charge")
    bgn, number, vop = _self_assessed()
    out = df.withColumns({"base": bgn, "vat_due": money(F.round(bgn * F.expr("0.20BD"), 2))})
    place = F.row_number().over(W.partitionBy("period").orderBy("invoice_id")) + (start - 1)
    return out.select(
        "invoice_id", "period", F.lpad(place.cast("string"), 10, "0").alias("protocol"), F.col("date_issued").alias("protocol_date"), _squeezed(F.col("supplier_name"), "НЕИЗВЕСТЕН ДОСТАВЧИК").alias("supplier_name"),
        number.alias("supplier_vat"), F.when(number.rlike(r"^(?U)\p{L}{2}.."), F.upper(F.left(number, F.lit(2)))).otherwise("IE").alias("country"), S.normalize_doc_number(F.col("invoice_id")).alias("original_number"),
        F.when(vop, "VOP_GOODS").otherwise("REVERSE_CHARGE_SERVICE").alias("kind"), F.when(vop, "чл. 84 от ЗДДС (ВОП)").otherwise("чл. 82, ал. 2, т. 3 от ЗДДС (доставка на услуги)").alias("ground"),
        "base", F.col("vat_due").alias("vat"), money(F.col("base") + F.col("vat_due")).alias("total"), F.lit(full_credit).alias("full_credit"),
    )


# I05
def protocol_purchase_rows(p: DataFrame) -> DataFrame:
    zero, full = _zero(), F.col("full_credit")
    pick = lambda when, c: money(F.when(when, F.col(c)).otherwise(0))
    amounts = dict.fromkeys(PURCHASE_AMOUNTS, zero) | {"total_amount": F.col("total"), "tax_base_20": pick(full, "base"), "vat_20": pick(full, "vat"), "tax_base_no_credit": pick(~full, "base"), "vat_special_art82": F.col("vat")}
    return p.select("invoice_id", "period", *_protocol_head(), *(c.alias(k) for k, c in amounts.items()))


def protocol_sales_rows(p: DataFrame) -> DataFrame:
    vop = F.col("kind") == "VOP_GOODS"
    pick = lambda when, c: money(F.when(when, F.col(c)).otherwise(0))
    amounts = dict.fromkeys(SALES_AMOUNTS, _zero()) | {"total_amount": F.col("total"), "tax_base_vop": pick(vop, "base"), "vat_vop": pick(vop, "vat"), "tax_base_art82": pick(~vop, "base"), "vat_art82": pick(~vop, "vat")}
    return p.select("invoice_id", "period", *_protocol_head(), *(c.alias(k) for k, c in amounts.items()))


def _protocol_head() -> list[Column]:
    return [
        F.lit("09").alias("doc_type"), F.col("protocol").alias("doc_number"), F.col("protocol_date").alias("doc_date"), _identifier(F.col("supplier_vat")).alias("contractor_id"),
        F.left("supplier_name", F.lit(50)).alias("contractor_name"), F.left(F.concat(F.lit("Прот.117 ф-ра "), F.col("original_number")), F.lit(30)).alias("description"),
    ]


def protocol_postings(p: DataFrame) -> DataFrame:
    """Two pairs a protocol: 602 to 401 for the base, 4531 to 4532 for the VAT."""
    pair = lambda line, d, c, amount: F.struct(F.lit(line).alias("line"), F.lit(d).alias("debit_account"), F.lit(c).alias("credit_account"), F.col(amount).alias("amount"))
    return p.select("invoice_id", "period", "protocol", F.inline(F.array(pair(1, "602", "401", "base"), pair(2, "4531", "4532", "vat"))))


# G01
def ledger_union(purchases: DataFrame, sales: DataFrame, protocols: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Both books with the protocols' rows."""
    return purchases.unionByName(protocol_purchase_rows(protocols)), sales.unionByName(protocol_sales_rows(protocols))


def book_amounts(df: DataFrame, full_credit: bool = True) -> DataFrame:
    """invoice_id, period, book (purchase or sale) and the amounts of both books, protocols included, in one pass: what ``ledger_union`` gives, without texts and
    numbers. df: all invoices, with is_sale."""
    df = _amounts(reverse_charge_flag(df).withColumn("keep_bgn_total", ~F.col("is_sale")))
    kind, sale, b, v = F.coalesce("doc_kind", F.lit("")), F.col("is_sale"), F.col("b"), F.col("v")
    base, _, vop = _self_assessed()
    due, zero = money(F.round(base * F.expr("0.20BD"), 2)), _zero()
    nine = F.coalesce(F.exists("vat_rates", lambda r: r.between(8, 10)), F.lit(False)) | ~sale & F.coalesce((F.abs(b) > F.expr("0.01BD")) & (F.try_divide(F.abs(v), F.abs(b)) * 100).between(8, 10), F.lit(False))
    none = (v == 0) & (b != 0)
    pick = lambda when, c: money(F.when(when, c).otherwise(0))
    rated = {"total_amount": F.col("t"), "tax_base_20": pick(~none & ~nine, b), "vat_20": pick(~none & ~nine, v), "tax_base_9": pick(~none & nine, b), "vat_9": pick(~none & nine, v)}
    full = F.lit(full_credit)
    assessed = {"total_amount": money(base + due)}
    rows = (
        (~sale & ~kind.isin("FISCAL_MEMORY_REPORT", "GOODS_RECEIPT"), "purchase", rated | {"tax_base_no_credit": pick(none, b)}),
        (sale & (kind != "GOODS_RECEIPT"), "sale", rated | {"tax_base_exempt": pick(none, b)}),
        (~sale & F.col("reverse_charge"), "purchase", assessed | {"tax_base_20": pick(full, base), "vat_20": pick(full, due), "tax_base_no_credit": pick(~full, base), "vat_special_art82": due}),
        (~sale & F.col("reverse_charge"), "sale", assessed | {"tax_base_vop": pick(vop, base), "vat_vop": pick(vop, due), "tax_base_art82": pick(~vop, base), "vat_art82": pick(~vop, due)}),
    )
    names = dict.fromkeys((*PURCHASE_AMOUNTS, *SALES_AMOUNTS))
    made = F.array(*(F.when(when, F.struct(F.lit(book).alias("book"), *(own.get(c, zero).alias(c) for c in names))) for when, book, own in rows))
    return df.select("invoice_id", "period", F.inline(F.array_compact(made)))


# E15
#: Cells that are sums of one column of the sales' book.
SALES_CELLS = {"c11": "tax_base_20", "c12": "vat_20", "c13": "tax_base_vop", "c14": "vat_vop", "c15": "tax_base_art82", "c16": "vat_art82", "c17": "tax_base_9", "c18": "vat_9", "c19": "tax_base_chapter3", "c24": "tax_base_exempt"}


def vat_return(purchases: DataFrame, sales: DataFrame, coefficient: str = "1.00", prior: str = "0.00") -> DataFrame:
    """``return_of`` two books."""
    sale, buy = sales.withColumn("book", F.lit("sale")), purchases.withColumn("book", F.lit("purchase"))
    every = dict.fromkeys((*PURCHASE_AMOUNTS, *SALES_AMOUNTS))
    both = [df.select("period", "book", *(F.col(c) if c in df.columns else _zero().alias(c) for c in every)) for df in (sale, buy)]
    return return_of(both[0].unionByName(both[1]), coefficient, prior)


def return_of(rows: DataFrame, coefficient: str = "1.00", prior: str = "0.00") -> DataFrame:
    """All cells, one row a period: 12, 14, 16, 18 are the VAT of 11 (20 %), 13 (intra-EU), 15 (art. 82), 17 (9 %); 19 is chapter
    3, 24 exempt; 43 = 40 + 41 * 42; 20 - 43 goes to 50 or 60; 80 is what 70 leaves of 50. One aggregate over the rows of both books."""
    of = lambda book, c: money(F.sum(F.when(F.col("book") == book, c).otherwise(0)))
    buys = {"c31": F.col("tax_base_20") + F.col("tax_base_9"), "c32": F.col("tax_base_partial"), "none": F.col("tax_base_no_credit"), "c40": F.col("vat_20") + F.col("vat_9"), "c41": F.col("vat_partial")}
    sums = rows.groupBy("period").agg(
        *(of("sale", F.col(c)).alias(k) for k, c in SALES_CELLS.items()), *(of("purchase", c).alias(k) for k, c in buys.items()),
        F.count_if(F.col("book") == "sale").alias("n_sales"), F.count_if(F.col("book") == "purchase").alias("n_purchases"),
    )
    out = sums.withColumns({
        "c01": money(F.expr("c11 + c13 + c15 + c17 + c19 + c24")), "c20": money(F.expr("c12 + c14 + c16 + c18")), "c30": money(F.expr("c31 + c32 + none")),
        "c42": F.expr(f"{coefficient}BD").cast("decimal(4,2)"), "c70": F.lit(prior).cast(MONEY),
    })
    out = out.withColumn("c43", money(F.col("c40") + F.round(F.col("c41") * F.col("c42"), 2)))
    due = money(F.col("c20") - F.col("c43"))
    out = out.withColumns({"c50": money(F.greatest(due, F.lit(0))), "c60": money(F.greatest(-due, F.lit(0)))})
    out = out.withColumn("c80", money(F.greatest(F.col("c50") - F.col("c70"), F.lit(0))))
    return out.select("period", *(f"c{c}" for c in CELLS), "n_sales", "n_purchases")


# E16
def vat_return_audit(decl: DataFrame, purchases: DataFrame, sales: DataFrame, tol: str = "0.02") -> DataFrame:
    """A row per failed check: the sales' VAT against cell 20, the purchases' against 40, and 20 - 43 against 50 - 60."""
    sale = sales.select("period", money(F.expr("vat_20 + vat_vop + vat_art82 + vat_9")).alias("s"), _zero().alias("p"))
    buy = purchases.select("period", _zero().alias("s"), money(F.expr("vat_20 + vat_9")).alias("p"))
    sums = sale.unionByName(buy).groupBy("period").agg(money(F.sum("s")).alias("s"), money(F.sum("p")).alias("p"))
    both = decl.join(sums, "period", "left")
    zero = lambda c: F.coalesce(c, F.lit(0))
    off = (("SALES_VAT", zero("s") - F.col("c20")), ("PURCHASE_VAT", zero("p") - F.col("c40")), ("RESULT", F.expr("c20 - c43 - c50 + c60")))
    checks = F.array(*(F.struct(F.lit(n).alias("check"), money(d).alias("difference")) for n, d in off))
    return both.select("period", F.inline(checks)).where(F.abs("difference") > F.expr(f"{tol}BD"))


# K01, K02
def book_line(amounts: tuple[str, ...], fmt: str = "fixed") -> Column:
    """A row of a book as text: fixed width, or the columns apart by tabs (``tsv``) or semicolons (``csv``, names and descriptions quoted)."""
    text = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(""))
    amount = lambda c: F.coalesce(F.col(c), _zero()).cast(MONEY).cast("string")
    if fmt == "fixed":
        cut = {c: F.rpad(F.left(text(c), F.lit(w)), w, " ") for c, w in HEAD.items()}
        cut |= {"doc_type": F.lpad(F.left(text("doc_type"), F.lit(2)), 2, " "), "doc_number": F.lpad(F.left(text("doc_number"), F.lit(10)), 10, "0")}
        # amounts of more than 15 places aren't cut
        wide = lambda c: F.when(F.length(amount(c)) < 15, F.lpad(amount(c), 15, " ")).otherwise(amount(c))
        return F.concat(*(cut[c] for c in HEAD), *(wide(c) for c in amounts))
    quoted = lambda c: F.concat(F.lit('"'), text(c), F.lit('"')) if fmt == "csv" and c in ("contractor_name", "description") else text(c)
    return F.concat_ws("\t" if fmt == "tsv" else ";", *(quoted(c) for c in HEAD), *(amount(c) for c in amounts))


# K03
def return_lines(decl: DataFrame, company: dict[str, str]) -> DataFrame:
    """period, seq, line: the company's lines, then each cell as [cell]=value, in order."""
    head = [("ПЕРИОД", F.col("period"))] + [(k, F.lit(company.get(k, ""))) for k in ("ЕИК", "ДДС_НОМЕР", "ИМЕ", "АДРЕС", "ГРАД", "ПК", "МОЛ")]
    rows = head + [(c, F.col(f"c{c}").cast("string")) for c in CELLS]
    return decl.select("period", F.inline(F.array(*(F.struct(F.lit(i).alias("seq"), F.concat(F.lit(f"[{k}]="), v).alias("line")) for i, (k, v) in enumerate(rows)))))


# K13
def vat_package(purchases: DataFrame, sales: DataFrame, company: dict[str, str], fmt: str = "fixed") -> DataFrame:
    """period, file, seq, line: the three files of every period, from invoices; protocols are made and entered on the way.

    seq orders a file's lines: invoices by type, number and id, then protocols in the same way.
    """
    buys, sells = ledger_union(to_purchase_ledger(purchases), to_sales_ledger(sales), protocols_117(purchases))
    order = F.row_number().over(W.partitionBy("period").orderBy((F.col("doc_type") == "09"), "doc_type", "doc_number", "invoice_id"))
    book = lambda df, name, amounts: df.select("period", F.lit(name).alias("file"), order.alias("seq"), book_line(amounts, fmt).alias("line"))
    out = book(buys, "POKUPKI", PURCHASE_AMOUNTS).unionByName(book(sells, "PRODAGBI", SALES_AMOUNTS))
    every = purchases.withColumn("is_sale", F.lit(False)).unionByName(sales.withColumn("is_sale", F.lit(True)))
    return out.unionByName(return_lines(return_of(book_amounts(every)), company).select("period", F.lit("DEKLAR").alias("file"), (F.col("seq") + 1).alias("seq"), "line"))


def write_package(lines: DataFrame, path: str) -> None:
    """period, file, seq, line: a folder for each period and file, in cp1251 with CRLF, each file's lines in order."""
    sinks.write_lines(lines.repartition("period", "file").sortWithinPartitions("period", "file", "seq"), path, ("period", "file"))
