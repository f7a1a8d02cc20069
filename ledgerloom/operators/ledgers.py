"""From invoices to ledgers, postings and the VAT return. Money is DECIMAL(18,2), rounded line by line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

MONEY = "decimal(18,2)"


def money(c: Column) -> Column:
    return c.cast(MONEY)


def _zero() -> Column:
    return F.lit(0).cast(MONEY)


# I01
def reconcile_amounts(df: DataFrame, default_date: str = "2026-12-31") -> DataFrame:
    """One missing amount of base, VAT and total is deduced; VAT only if it comes to about 20 %."""
    b, v, t = F.col("tax_base"), F.col("vat"), F.col("total")
    guess = money(t - b)
    about20 = F.abs(guess - F.round(b * F.expr("0.20BD"), 2)) <= F.expr("0.02BD")
    return df.withColumns({
        "vat": F.when(v.isNull() & b.isNotNull() & t.isNotNull() & about20, guess).otherwise(v),
        "tax_base": F.when(b.isNull() & v.isNotNull() & t.isNotNull(), money(t - v)).otherwise(b),
        "total": F.when(t.isNull() & b.isNotNull() & v.isNotNull(), money(b + v)).otherwise(t),
        "effective_date": F.coalesce("date_tax_event", "date_issued", F.lit(default_date).cast("date")),
    })


# I08
#: Words of services, fuels, supplies and goods, with their account and reason.
ACCOUNT_WORDS = (
    (("услуга", "абонамент", "наем", "транспорт", "куриер", "ремонт", "софтуер"), "602", "външни услуги"),
    (("гориво", "дизел", "бензин", "масло", "газ"), "601", "горива"),
    (("консуматив", "почистващ", "хартия", "офис"), "609", "консумативи"),
    (("стока", "кафе", "напитка", "бира", "вино", "храна", "тютюн", "наргиле"), "304", "стоки"),
)


def expense_account(df: DataFrame, suppliers: DataFrame, groups=ACCOUNT_WORDS, default: str = "304") -> DataFrame:
    """df: invoice_id, supplier_eik and items (joined descriptions). Adds account and reason: a known supplier's (suppliers: eik,
    account, reason), else the first group with a word in the items, else the default."""
    eik = F.regexp_replace(F.upper(F.regexp_replace(F.coalesce("supplier_eik", F.lit("")), "[^0-9A-Za-z]", "")), "^BG(?=.)", "")
    own = suppliers.select(F.col("eik").alias("__eik"), F.col("account").alias("__account"), F.col("reason").alias("__reason"))
    out, text = df.join(own, eik == F.col("__eik"), "left"), F.lower(F.coalesce("items", F.lit("")))
    pick = lambda known, at, last: F.coalesce(known, F.coalesce(*(F.when(text.rlike("|".join(g[0])), g[at]) for g in groups)), F.lit(last))
    return out.withColumns({"account": pick(F.col("__account"), 1, default), "reason": pick(F.col("__reason"), 2, "стоки" if default == "304" else "разходи")}).drop("__eik", "__account", "__reason")


# I09
def service_or_goods(df: DataFrame, words: tuple[str, ...]) -> DataFrame:
    """602 if the supplier's name or an item has one of the words, else 304."""
    text = F.lower(F.concat_ws(" ", F.coalesce("supplier_name", F.lit("")), F.coalesce("items", F.lit(""))))
    return df.withColumn("account", F.when(text.rlike("|".join(words)), "602").otherwise("304"))


# I11
def direction(df: DataFrame, clients: DataFrame) -> DataFrame:
    """PURCHASE where the recipient is a client (clients: eik), else SALE where the supplier is, else PURCHASE."""
    of = lambda c: clients.select(F.col("eik").alias(c)).distinct()
    out = df.join(of("__r").withColumn("__is_r", F.lit(True)), F.col("recipient_eik") == F.col("__r"), "left").join(of("__s").withColumn("__is_s", F.lit(True)), F.col("supplier_eik") == F.col("__s"), "left")
    return out.withColumn("direction", F.when(F.col("__is_r"), "PURCHASE").when(F.col("__is_s"), "SALE").otherwise("PURCHASE")).drop("__r", "__is_r", "__s", "__is_s")


# I06
def to_journal_entries(df: DataFrame) -> DataFrame:
    """A row per posting: debit and credit account, amount (negative on credit notes), and the entry's own amounts and balance.

    df: account (of the expense) beside the header. A missing total or base is filled; a total off by up to 0.02 follows the
    sum; else the base gives way. Fiscal reports post to 501, 702 and 4532; goods receipts 304 to 401 for the total.
    """
    report, receipt = (F.coalesce(F.col("doc_kind") == k, F.lit(False)) for k in ("FISCAL_MEMORY_REPORT", "GOODS_RECEIPT"))
    credit = F.col("is_credit_note") & ~report & ~receipt
    amount = lambda c: money(F.abs(F.coalesce(c, _zero())) * F.when(credit, -1).otherwise(1))
    b, v, t = (F.col(c) for c in ("__b", "__v", "__t"))
    df = df.withColumns({"__b": amount("tax_base"), "__v": amount("vat"), "__t": amount("total")})
    off = b + v != t
    base = F.when((t == 0) & (b + v != 0), b).when((b == 0) & (t != 0) & (v == 0), t).when(F.abs(b + v - t) <= F.expr("0.02BD"), b).when(off & (v != 0), t - v).when(off, t).otherwise(b)
    total = F.when((t == 0) & (b + v != 0), b + v).when((b == 0) & (t != 0) & (v == 0), t).when(F.abs(b + v - t) <= F.expr("0.02BD"), b + v).otherwise(t)
    own_base = F.when(receipt, t).when(report, F.when((b == 0) & (v != 0) & (t != 0), t - v).otherwise(b)).otherwise(base)
    own_vat = F.when(receipt, _zero()).otherwise(v)
    own_total = F.when(receipt, t).when(report, F.when((t != 0) & (b == 0) & (v != 0), t).otherwise(b + v)).otherwise(total)
    df = df.withColumns({"entry_base": money(own_base), "entry_vat": money(own_vat), "entry_total": money(own_total)})
    post = lambda line, d, c, a: F.struct(F.lit(line).alias("line"), d.alias("debit_account"), c.alias("credit_account"), money(a).alias("amount"))
    first = post(1, F.when(report, "501").when(receipt, "304").otherwise(F.col("account")), F.when(report, "702").otherwise("401"), F.col("entry_base"))
    second = post(2, F.when(report, "501").otherwise("4531"), F.when(report, "4532").otherwise("401"), F.col("entry_vat"))
    rows = F.array_compact(F.array(F.when(report | receipt | (F.col("entry_base") != 0), first), F.when(report | ~receipt & (F.col("entry_vat") != 0), second)))
    return df.select("invoice_id", S.normalize_doc_number(F.col("invoice_id")).alias("doc_number"), "entry_base", "entry_vat", "entry_total", (F.col("entry_base") + F.col("entry_vat") == F.col("entry_total")).alias("is_balanced"), credit.alias("is_storno"), F.inline(rows))


# I07
def to_operations(df: DataFrame) -> DataFrame:
    """Up to four signed rows per invoice, for base > 0 and VAT > 0 only. A sale's debit and credit have the same sign, a purchase's
    opposite ones; a credit note turns both; an annulled sale is a pair of zeros. df: account of the expense (304 if there is none), is_annulled."""
    for c, v in (("account", "304"), ("is_annulled", False)):
        df = df if c in df.columns else df.withColumn(c, F.lit(v))
    off = F.coalesce("is_annulled", F.lit(False))
    turn = F.when(F.col("is_credit_note"), -1).otherwise(1)
    base, vat = (money(F.when(off, 0).otherwise(F.coalesce(c, F.lit(0)))) for c in ("tax_base", "vat"))
    sale, cash = F.col("is_sale"), F.col("payment_method") == "CASH"

    def row(when: Column, line: int, side: str, account: Column, amount: Column) -> Column:
        return F.when(when, F.struct(F.lit(line).alias("line"), F.lit(side).alias("direction"), account.alias("account"), money(amount).alias("amount")))

    money_account = F.when(cash, "501").otherwise(F.when(sale, "411").otherwise("401"))
    has_base, has_vat, none = base > 0, vat > 0, sale & off
    rows = F.array_compact(F.array(
        row(has_base & ~sale, 1, "D", F.col("account"), base * turn), row((has_base | none) & sale, 1, "D", money_account, base * turn),
        row(has_base & ~sale, 1, "K", money_account, -base * turn), row((has_base | none) & sale, 1, "K", F.lit("702"), base * turn),
        row(has_vat & ~sale, 2, "D", F.lit("4531"), vat * turn), row(has_vat & sale, 2, "D", money_account, vat * turn),
        row(has_vat & ~sale, 2, "K", money_account, -vat * turn), row(has_vat & sale, 2, "K", F.lit("4532"), vat * turn),
    ))
    return df.select("invoice_id", "period", "is_sale", "is_credit_note", F.inline(rows))


# I13, F13
def transfer_rows(df: DataFrame, start: int = 1001) -> DataFrame:
    """kon_id by position, then a nominal pair and a VAT pair; purchases carry opposite signs, sales the same."""
    ids = number_operations(df.where("tax_base IS NOT NULL"), start)
    sign = F.when(F.col("is_credit_note"), -1).otherwise(1)
    other = F.when(F.col("is_sale"), 1).otherwise(-1)

    def pair(kon: int, debit: Column, credit: Column, amount: str, vat: bool) -> list[Column]:
        row = lambda k, acc, s: F.struct(F.lit(kon).alias("kon"), F.lit(k).alias("is_kredit"), acc.alias("account"), money(F.col(amount) * s).alias("amount"), F.lit(vat).alias("is_vat"))
        return [row(2, debit, sign), row(1, credit, sign * other)]

    money_account = F.when(F.col("is_sale"), "411").otherwise("401")
    nominal = pair(1, F.when(F.col("is_sale"), money_account).otherwise("304"), F.when(F.col("is_sale"), "702").otherwise(money_account), "tax_base", False)
    vat = pair(2, F.when(F.col("is_sale"), money_account).otherwise("453"), F.when(F.col("is_sale"), "453").otherwise(money_account), "vat", True)
    rows = F.filter(F.array(*nominal, *vat), lambda r: ~r["is_vat"] | (r["amount"] != 0))
    return ids.select("kon_id", "invoice_id", F.col("is_sale"), F.inline(rows))


def number_operations(df: DataFrame, start: int = 1001) -> DataFrame:
    """kon_id = start + the place in order of invoice_id.

    Places come from counts of ranges of ids, in two levels: 4096 ids in a range, 4096 ranges in a group; a window holds one
    range, one group's ranges, or the groups (one for 16 million ids).
    """
    part, group = F.expr("invoice_id div 4096"), F.expr("invoice_id div 16777216")
    before = lambda w: F.sum("n").over(w) - F.col("n")
    parts = df.groupBy(group.alias("group"), part.alias("part")).agg(F.count("*").alias("n"))
    groups = parts.groupBy("group").agg(F.sum("n").alias("n")).select("group", before(W.orderBy("group")).alias("before_group"))
    parts = parts.select("group", "part", before(W.partitionBy("group").orderBy("part")).alias("before_part")).join(groups, "group").select("part", (F.col("before_group") + F.col("before_part")).alias("before"))
    placed = df.withColumn("part", part).withColumn("at", F.row_number().over(W.partitionBy("part").orderBy("invoice_id")))
    return placed.join(parts, "part").withColumn("kon_id", F.col("before") + F.col("at") + (start - 1)).drop("part", "at", "before")


# I14
def tax_period_check(df: DataFrame, period: Column) -> DataFrame:
    """Months between the document and the filing period: current, prior up to 12, expired beyond, or future."""
    off = (F.substring(period, 1, 4).cast("int") - F.year("date_tax_event")) * 12 + F.substring(period, 5, 2).cast("int") - F.month("date_tax_event")
    status = F.when(off < 0, "future").when(off == 0, "current").when(off <= 12, "prior").otherwise("expired")
    cell = F.when(status == "future", 0).when(status == "expired", 16).otherwise(10)
    return df.select("invoice_id", off.alias("month_offset"), status.alias("status"), cell.alias("cell"), F.when(status == "future", "ERROR").when(status == "expired", "WARNING").otherwise("INFO").alias("severity"))


# E17
def tax_period_summary(checked: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(f"n_{s}")
    return checked.agg(F.count("*").alias("n"), *(n(s) for s in ("current", "prior", "expired", "future")), (F.count_if(F.col("status") == "future") == 0).alias("batch_valid"))


# I15
def service_item(df: DataFrame) -> DataFrame:
    """An invoice without items gets one line of quantity 1: its base, or total / 1.20."""
    base = money(F.coalesce("tax_base", F.round(F.col("printed_total") / F.expr("1.20BD"), 2)))
    return df.where("n_lines IS NULL").select("invoice_id", F.lit("service").alias("description"), F.lit(1).cast("decimal(18,3)").alias("quantity"), base.alias("net"))


# I16
def dual_totals(df: DataFrame) -> DataFrame:
    """The other currency's total; the primary one is never converted."""
    cur = S.default_currency(F.col("currency"), F.col("date_issued"))
    return df.select("invoice_id", cur.alias("currency"), F.when(cur == "EUR", F.col("total")).otherwise(S.bgn_to_eur(F.col("total"))).alias("total_eur"), F.when(cur == "EUR", S.eur_to_bgn(F.col("total"))).otherwise(F.col("total")).alias("total_bgn"))


# I17
def scale_integer_totals(df: DataFrame, items: DataFrame) -> DataFrame:
    """An integer base whose hundredth is the items' sum within 0.05 is divided by 100, with VAT and total."""
    sums = items.groupBy("invoice_id").agg(money(F.sum("net")).alias("items"))
    out = df.join(sums, "invoice_id", "left")
    hit = (F.col("tax_base") % 1 == 0) & (F.abs(F.col("tax_base") / 100 - F.col("items")) <= F.expr("0.05BD"))
    cut = lambda c: money(F.when(hit, F.round(F.col(c) * F.expr("0.01BD"), 2)).otherwise(F.col(c)))
    return out.withColumns({"scaled": F.coalesce(hit, F.lit(False)), "tax_base": cut("tax_base"), "vat": cut("vat"), "total": cut("total")}).drop("items")


# I21
def repair_totals(df: DataFrame) -> DataFrame:
    """tax_base, vat and total brought together, and rule, what was done: the total in words (column words, may be null or missing) replaces a missing total, or one off by
    more than 1 if it fits the VAT; a base above the total is the total without 20 %; a base and VAT that add up but are exchanged are swapped; of three that are
    off by more than 0.03 the one pair with a rate of 20 or 9 % gives the third, else the one that is far off goes; a missing one follows from the others."""
    df = df if "words" in df.columns else df.withColumn("words", F.lit(None).cast("decimal(18,2)"))
    lit, zero = lambda x: F.expr(f"{x}BD"), F.lit(0)
    rate = lambda part, whole: (part > 0) & (whole > 0) & ((F.abs(part - whole * lit("0.20")) < whole * lit("0.02")) | (F.abs(part - whole * lit("0.09")) < whole * lit("0.02")))
    yes = lambda c: F.coalesce(c, F.lit(False))
    b, v, t, w = (F.col(c) for c in ("tax_base", "vat", "total", "words"))
    said = yes(w > 5)
    over = said & yes((F.abs(t - w) > 1) & rate(v, w - v))
    out = df.withColumns({"total": money(F.when(said & t.isNull() | over, w).otherwise(t)), "tax_base": money(F.when(over, w - v).otherwise(b)), "r0": F.when(over, "words").when(said & t.isNull(), "words")})
    out = out.withColumn("r1", F.when(yes((t > 0) & (b > t)), "inverted")).withColumn("tax_base", money(F.when(F.col("r1").isNotNull(), F.round(t / lit("1.20"), 2)).otherwise(b)))
    swap = yes((b > 0) & (v > 0) & (b < v) & (F.abs(b + v - t) <= lit("0.03")) & (F.abs(b - v * lit("0.20")) < v * lit("0.02")))
    out = out.withColumn("r2", F.when(swap, "swap")).withColumns({"tax_base": F.when(swap, v).otherwise(b), "vat": F.when(swap, b).otherwise(v)})
    one, two, three = rate(v, b), rate(t - b, b), rate(v, t - v)
    off = (
        F.when(one & ~two & ~three, "total").when(two & ~three, "vat").when(three & ~two, "base").when((b > 0) & (v > 0) & ((b + v) * 2 < t), "total")
        .when((t - v > 0) & (F.abs(b - (t - v)) > t * lit("0.5")), "base").when((t - b > 0) & (F.abs(v - (t - b)) > t * lit("0.5")), "vat").otherwise("open")
    )
    full = b.isNotNull() & v.isNotNull() & t.isNotNull()
    lacks = (
        F.when(full & (F.abs(b + v - t) > lit("0.03")), off).when(full, "ok").when(t.isNotNull() & v.isNotNull(), "base").when(t.isNotNull() & b.isNotNull(), F.when(t >= b, "vat").otherwise("rate"))
        .when(b.isNotNull() & v.isNotNull(), "total").otherwise("open")
    )
    out = out.withColumn("r3", lacks)
    r, vat20 = F.col("r3"), F.round(b * lit("0.20"), 2)
    fixed = {"tax_base": F.when(r == "base", t - v).otherwise(b), "vat": F.when(r == "vat", F.greatest(t - b, zero)).when(r == "rate", vat20).otherwise(v), "total": F.when(r == "total", b + v).when(r == "rate", b + vat20).otherwise(t)}
    return out.withColumns({k: money(c) for k, c in fixed.items()} | {"rule": F.concat_ws(" ", "r0", "r1", "r2", "r3")}).drop("r0", "r1", "r2", "r3", "words")


# E11, E12, E13
def operation_balance(rows: DataFrame) -> DataFrame:
    side = lambda d: money(F.coalesce(F.sum(F.when(F.col("direction") == d, F.abs("amount"))), F.lit(0)))
    return rows.groupBy("invoice_id").agg(side("D").alias("debit"), side("K").alias("credit")).withColumn("balanced", F.col("debit") == F.col("credit"))


def ledger_balance(rows: DataFrame) -> DataFrame:
    """Balanced if the sides cancel or are equal in size, within a cent."""
    side = lambda k: money(F.coalesce(F.sum(F.when(F.col("is_kredit") == k, F.col("amount"))), F.lit(0)))
    out = rows.groupBy("kon_id", "kon").agg(side(2).alias("debit"), side(1).alias("credit"))
    cent = F.expr("0.01BD")
    return out.withColumn("balanced", (F.abs(F.col("debit") + F.col("credit")) < cent) | (F.abs(F.abs("debit") - F.abs("credit")) < cent))


def trial_balance(rows: DataFrame) -> DataFrame:
    side = lambda k: money(F.coalesce(F.sum(F.when(F.col("is_kredit") == k, F.abs("amount"))), F.lit(0)))
    return rows.groupBy("account").agg(side(2).alias("debit"), side(1).alias("credit")).withColumn("balance", money(F.col("debit") - F.col("credit")))


# E14
def operations_from_rows(rows: DataFrame) -> DataFrame:
    """The header of an operation: base and VAT from its debits, total from the money accounts or base + VAT."""
    debit, vat = F.col("is_kredit") == 2, F.col("is_vat") | F.col("account").startswith("453")
    pick = lambda c: money(F.coalesce(F.sum(F.when(c, F.abs("amount"))), F.lit(0)))
    out = rows.groupBy("kon_id").agg(pick(debit & ~vat).alias("base"), pick(debit & vat).alias("vat"), F.sum(F.when(~debit & F.col("account").isin("501", "401", "503"), F.abs("amount"))).alias("t"), F.min_by("account", F.struct("kon", "is_kredit")).alias("first_account"))
    return out.select("kon_id", "base", "vat", money(F.coalesce("t", F.col("base") + F.col("vat"))).alias("total"), "first_account")


# E18
def journal_summary(rows: DataFrame) -> DataFrame:
    per = operation_balance(rows).join(rows.groupBy("invoice_id").agg(F.bool_or("is_credit_note").alias("storno")), "invoice_id")
    return per.agg(F.count("*").alias("n_documents"), money(F.sum("debit")).alias("debit"), money(F.sum("credit")).alias("credit"), F.bool_and("balanced").alias("all_balanced"), F.count_if("storno").alias("n_storno"))


# E10
def split_by_account(items: DataFrame, accounts: Column) -> DataFrame:
    """Per invoice, account and rate: net, VAT, count, first two descriptions; what is missing to the invoice's base goes to its largest group."""
    g = items.withColumn("account", accounts).groupBy("invoice_id", "account", "vat_rate")
    out = g.agg(money(F.sum("net")).alias("net"), money(F.sum("vat")).alias("vat"), F.count("*").alias("n_items"), F.slice(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("line_no", "description"))), lambda x: x["description"])), 1, 2).alias("descriptions"), F.first("tax_base").alias("tax_base"))
    w = W.partitionBy("invoice_id")
    out = out.withColumns({"rest": money(F.col("tax_base") - F.sum("net").over(w)), "rank": F.row_number().over(w.orderBy(F.desc("net"), "account", "vat_rate"))})
    return out.withColumn("net", money(F.col("net") + F.when(F.col("rank") == 1, F.col("rest")).otherwise(0))).drop("rest", "rank", "tax_base")
