"""Values read from the lines of documents, by witnesses in a stated order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import scalars as S

#: What names each currency in words, on a line of totals, and anywhere; misread forms included. ``<`` and ``>`` are the ends of a word.
BGN_IN_WORDS = ("<(лева|лев|стотинк[а-я]*|лв[.]?|bgn|бгн|bgr|бгр|bom|вом)>",)
EUR_IN_WORDS = ("<(евро|евроцент[а-я]*|цента|euro|eob|еоб|eub|еуб)>", "[а-яa-z0-9_]*евро[а-яa-z0-9_]*", "(<|[0-9])(е[.]ц[.]?|ец|еш[?]?)>")
BGN_ON_TOTAL = ("<(лв[.]?|bgn|бгн|лева|лев|bgr|бгр|bom|вом)>",)
EUR_ON_TOTAL = ("<(eur|евро|euro|eob|еоб|eub|еуб)>", "(<|[0-9])(е[.]ц[.]?|ец|еш[?]?)>")
BGN_MENTIONS = ("<bgn>", "<бгн>", "<лв>", "<лева>", "<лев>", "<стотинк[а-я]*>", "<bgr>", "<бгр>", "<bom>", "<вом>")
EUR_MENTIONS = ("<eur>", "<евро>", "€", "<евроцент[а-я]*>", "<euro>", "<eob>", "<еоб>", "<eub>", "<еуб>", "(<|[0-9])(е[.]ц[.]?|ец|еш[?]?)>")
#: Mentions for information only, and what follows the main clause of the amount in words.
EUR_INFORMATION = "<(равностойност +в +(eur|евро|eob|eub)|курс *[:=]? *1[.]95583|1 *eur *= *1[.]95583|информатив[а-я]* +в +евро)>"
BGN_INFORMATION = "<(равностойност +в +(лв|лева|bgn|bgr|bom|вом)|сума +(в +)?(лв|лева|bgn|bgr|bom|вом)|1 *(eur|евро) *= *1[.]95583 *(лв|лева|bgn|bgr|bom|вом)?)>"
ASIDE = "<(сума +(в +)?(вом|bom|бгн|bgn|bgr|бгр|лв[.]?|eur|евро)|равностойност>[^;,.|]*)($|[;,.|])"
#: Labels of the amount payable, and of information; the day from which the euro is the currency.
TOTAL_LABELS = ("сума за плащане", "сумазаплащане", "за плащане", "общо дължимо", "крайна сума", "total due", "общо за плащане")
INFORMATION_LABELS = ("равностойност", "курс", "информатив")
EURO_FROM = "2026-01-01"


def word_ends(pattern: str) -> str:
    """The pattern with ``<`` and ``>`` as the places where a word starts and ends."""
    return pattern.replace("<", r"(?<![\p{L}\p{N}_])").replace(">", r"(?![\p{L}\p{N}_])")


def _says(text: Column, patterns) -> Column:
    found = F.lit(False)
    for p in patterns:
        found = found | F.coalesce(text.rlike(word_ends(p)), F.lit(False))
    return found


def _counted(text: Column, patterns) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + F.regexp_count(text, F.lit(word_ends(p)))
    return out


def _one(bgn: Column, eur: Column) -> Column:
    """The currency if just one is named."""
    return F.when(bgn & ~eur, "BGN").when(eur & ~bgn, "EUR")


# E27
def currency_vote(lines: DataFrame, dates: DataFrame) -> DataFrame:
    """doc_id, currency and witness: the amount in words, else the first line of the amount payable that names just one, else the more mentions without those for
    information, else (a tie, or none) the issue date; without a date BGN. Documents without lines are decided by the date.

    lines: doc_id, page, line, text; dates: doc_id (unique), date_issued (a date or null). Mentions are counted within a line.
    """
    low = F.lower("text")
    words = F.regexp_replace(F.regexp_extract(low, "словом[ :]*(.*)$", 1), word_ends(ASIDE), "")
    total = F.lit(False)
    for label in TOTAL_LABELS:
        total = total | F.contains(low, F.lit(label))
    for label in INFORMATION_LABELS:
        total = total & ~F.contains(low, F.lit(label))
    seen = lines.select(
        "doc_id", F.struct("page", "line").alias("at"), F.when(F.contains(low, F.lit("словом")), words).alias("words"),
        F.when(total, _one(_says(low, BGN_ON_TOTAL), _says(low, EUR_ON_TOTAL) | F.contains(low, F.lit("€")))).alias("on_total"),
        _counted(low, BGN_MENTIONS).alias("bgn"), _counted(low, EUR_MENTIONS).alias("eur"), _counted(low, (BGN_INFORMATION,)).alias("bgn_info"), _counted(low, (EUR_INFORMATION,)).alias("eur_info"),
    )
    first = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("at"))).alias(c)
    votes = seen.groupBy("doc_id").agg(first("words"), first("on_total"), *(F.sum(c).alias(c) for c in ("bgn", "eur", "bgn_info", "eur_info")))
    out = dates.join(votes, "doc_id", "left")
    left = {c: F.greatest(F.coalesce(F.col(c), F.lit(0)) - F.coalesce(F.col(f"{c}_info"), F.lit(0)), F.lit(0)) for c in ("bgn", "eur")}
    said = _one(_says(F.col("words"), BGN_IN_WORDS), _says(F.col("words"), EUR_IN_WORDS))
    counted = F.when(left["bgn"] > left["eur"], "BGN").when(left["eur"] > left["bgn"], "EUR")
    by_date = F.when(F.col("date_issued") >= F.lit(EURO_FROM).cast("date"), "EUR").otherwise("BGN")
    witness = F.when(said.isNotNull(), "words").when(F.col("on_total").isNotNull(), "total").when(counted.isNotNull(), "mentions").otherwise("date")
    return out.select("doc_id", F.coalesce(said, "on_total", counted, by_date).alias("currency"), witness.alias("witness"))


#: Grounds for no VAT, in the order in which they are looked for, each by its patterns.
VAT_GROUNDS = (
    ("CHL_163A_REVERSE_CHARGE_SCRAP", "чл. 163а, ал. 1 от ЗДДС", ("<(чл[.]? *163 *а|163а)>.*(скрап|отпадъц|черни|цветни *метали)", "<(приложение *№? *2>|обратно +начисляване).*(скрап|отпадъц)", "<чл[.]? *163 *а *,? *ал[.]? *1>")),
    ("CHL_163A_REVERSE_CHARGE_GRAIN", "чл. 163а, ал. 2 от ЗДДС", ("<(чл[.]? *163 *а|163а)>.*(зърн|пшениц|царевиц|слънчоглед|рапиц|ечемик)", "<(приложение *№? *2>|обратно +начисляване).*(зърн|пшениц|царевиц|слънчоглед|рапиц)", "<чл[.]? *163 *а *,? *ал[.]? *2>")),
    ("CHL_163A_REVERSE_CHARGE", "чл. 163а от ЗДДС", ("<чл[.]? *163 *а>", "<163а *от *зддс>", "<приложение *№? *2 *от *зддс>")),
    ("CHL_82_AL_2_REVERSE_CHARGE", "чл. 82, ал. 2 от ЗДДС", ("<чл[.]? *82 *,? *ал[.]? *2>", "<чл[.]? *82[(]2[)]", "<tax +liability +shifted>")),
    ("REVERSE_CHARGE_GENERAL", "чл. 82 / чл. 163а от ЗДДС", ("<обратно +начисляване>", "<reverse +charge>", "<самоначисляване +на +ддс>")),
    ("CHL_53_VOD", "чл. 53 от ЗДДС", ("<чл[.]? *53>", "<вод>", "<вътреобщностна +доставка>", "<intra-community +supply>", "<art(icle)?[.]? *138>")),
    ("CHL_62_84_VOP", "чл. 62 / чл. 84 от ЗДДС", ("<чл[.]? *62>", "<чл[.]? *84>", "<воп>", "<вътреобщностно +придобиване>", "<intra-community +acquisition>")),
    ("CHL_141_TRIANGULAR", "чл. 141 от ЗДДС", ("<чл[.]? *141>", "<тристранна +операция>", "<triangular +operation>", "<art(icle)?[.]? *141>")),
    ("CHL_28_EXPORT", "чл. 28 от ЗДДС", ("<чл[.]? *28>", "<износ>", "<export>", "<доставка +извън +(ес|общността)>", "<art(icle)?[.]? *146>")),
    ("CHL_29_31_INTL_TRANSPORT", "чл. 29, 30, 31 от ЗДДС", ("<чл[.]? *29>", "<чл[.]? *30>", "<чл[.]? *31>", "<международен +транспорт>", "<international +transport>")),
    ("CHL_113_AL_9_NOT_REGISTERED", "чл. 113, ал. 9 от ЗДДС", ("<чл[.]? *113 *,? *ал[.]? *9>", "<чл[.]? *113[(]9[)]", "<нерегистрирано *(по *зддс)? *лице>", "<лицето +не +е +регистрирано +по +зддс>", "<доставчикът +не +е +регистриран +по +зддс>", "<не +е +рег[.]? *по *зддс>")),
    ("EXEMPT_SUPPLY_CHAPTER_4", "Глава четвърта от ЗДДС (чл. 38 - 50)", ("<чл[.]? *46>", "<чл[.]? *47>", "<чл[.]? *45>", "<чл[.]? *38>", "<чл[.]? *39>", "<чл[.]? *41>", "<чл[.]? *50>", "<освободена +доставка>", "<финансови +услуги>", "<застрахователни +услуги>")),
    ("EU_DIRECTIVE_2006_112", "Директива 2006/112/ЕО", ("<directive +2006/112(/ec)?>", "<директива +2006/112(/ео)?>", "<art(icle)?[.]? *196>")),
    ("EXPLICIT_STATUTORY_GROUNDS", "чл. 114, ал. 1, т. 11 от ЗДДС", ("<основание +за +(неначисляване|прилагане +на +нулева +ставка|0% *ддс|нулево +ддс) *[-:.]? *[^;,]{3,80}", "<правно +основание *[-:.]? *[^;,]{3,80}")),
)
FOREIGN_GROUND = ("CHL_82_AL_2_FOREIGN", "чл. 82, ал. 2 от ЗДДС")
#: Every pattern holds one of these stems, so a text without any is tested once.
GROUND_STEMS = ("чл", "163а", "приложение", "начисляване", "liability", "charge", "вод", "вътреобщностн", "intra-community", "art", "воп", "тристранна", "triangular", "износ", "export", "доставка", "транспорт", "transport", "регистриран", "рег", "услуги", "directive", "директива", "основание")


# H11
def check_vat_grounds(df: DataFrame) -> DataFrame:
    """invoice_id, is_zero (no VAT is charged), is_valid, code, article and issue. Without VAT (zero, a rate of zero, or none read and no room for it in the total) the text must
    name a ground: the first of ``VAT_GROUNDS`` counts; else a supplier with a foreign VAT number has one; else it is an error.

    df: invoice_id, tax_base, vat, total, rate (of the items, may be null), text, supplier_vat. Each distinct text of such invoices is searched once, and only
    if it holds one of the stems.
    """
    base, vat, total, rate = (F.col(c) for c in ("tax_base", "vat", "total", "rate"))
    yes = lambda c: F.coalesce(c, F.lit(False))
    zero = yes(vat == 0) | yes(rate == 0) | yes((base > 0) & vat.isNull()) & ~yes(total > base + F.expr("0.05BD")) & ~yes(rate > 0)
    own = df.select("invoice_id", zero.alias("is_zero"), F.when(zero, F.lower(F.coalesce("text", F.lit("")))).alias("low"), F.upper(F.coalesce("supplier_vat", F.lit(""))).alias("number"))
    at = F.lit(None).cast("int")
    for i, (_, _, patterns) in reversed(list(enumerate(VAT_GROUNDS))):
        at = F.when(_says(F.col("low"), patterns), i).otherwise(at)
    texts = own.where("low <> ''").select("low").distinct().where(F.col("low").rlike("|".join(GROUND_STEMS))).withColumn("at", at)
    out = own.join(texts, "low", "left")
    foreign = F.col("at").isNull() & F.col("number").rlike(r"^\p{L}{2}..") & ~F.col("number").startswith("BG")
    pick = lambda j: F.when(F.col("is_zero"), F.when(foreign, FOREIGN_GROUND[j]).otherwise(F.get(F.array(*(F.lit(g[j]) for g in VAT_GROUNDS)), F.col("at"))))
    missing = F.col("is_zero") & F.col("at").isNull() & ~foreign
    return out.select("invoice_id", "is_zero", (~missing).alias("is_valid"), pick(0).alias("code"), pick(1).alias("article"), F.when(missing, "MISSING_VAT_EXEMPTION_REASON").alias("issue"))


#: Cyrillic letters that look like Latin ones, and misread starts of account numbers, in the order of their replacement.
LOOK_ALIKES = ("АВСЕНІКМОРТХавсенікмортх", "ABCEHIKMOPTXabcehikmoptx")
MISREAD = (
    ("В[6О0БB]", "BG"), ("в[6о0бb]", "BG"), ("вВа", "BG"), ("ПВВ[8З3B]", "UBBS"), ("ВРВ[Г1IB]", "BPBI"), ("РКСВ", "PRCB"), ("ОМС[ВB]", "UNCR"), (r"\[ШСК", "UNCR"), ("ШЧС[ВB]", "UNCR"), ("З5ТЗ5А", "STSA"), ("5Т5А", "STSA"),
)
#: The bank of each code in an account number.
BANKS = {
    "UBBS": ("UBBSBGSF", "Обединена българска банка АД"), "BPBI": ("BPBIBGSF", "Юробанк България АД"), "PRCB": ("PRCBBGSF", "ПроКредит Банк (България) ЕАД"), "UNCR": ("UNCRBGSF", "УниКредит Булбанк АД"),
    "STSA": ("STSABGSF", "Банка ДСК АД"), "FINV": ("FINVBGSF", "Първа инвестиционна банка АД"), "RZBB": ("RZBBBGSF", "Райфайзенбанк (България) ЕАД"), "TTBB": ("TTBBBGSF", "Тексим Банк АД"),
    "CEKO": ("CEKOBGSF", "Централна кооперативна банка АД"), "BUIN": ("BUINBGSF", "Инвестбанк АД"), "BACX": ("BACXBGSF", "Българо-американска кредитна банка АД"), "IORT": ("IORTBGSF", "Интернешънъл Асет Банк АД"),
    "BNBG": ("BNBGBGSF", "Българска народна банка"),
}
#: Adjacent tokens that may hold one account number.
MOST_TOKENS = 7


def account_number(run: Column) -> Column:
    """Letters and digits of glued tokens with misread and look-alike letters put right."""
    for pattern, right in MISREAD:
        run = F.regexp_replace(run, pattern, right)
    bare = F.regexp_replace(F.upper(F.translate(run, *LOOK_ALIKES)), "[^A-Z0-9]", "")
    return F.regexp_replace(bare, "IBAN|TBAM|PBAM", "")


# M05
def extract_payment(tokens: DataFrame) -> DataFrame:
    """doc_id, iban, iban_valid, bank_code, bic, bank_name and method for each document with tokens.

    Runs of one to seven adjacent tokens are glued and put right; one of 22 signs that starts with BG and passes the check sum is the IBAN, the shortest, then the first one; else the
    first that has an IBAN's form (not valid). A BIC stands behind its label, else it and the bank's name follow from the IBAN. method: by bank, else in cash.

    tokens: doc_id, page, i, text. Only runs whose first token can start an account number or its label are put right; a run holds seven tokens at most.
    """
    w = W.partitionBy("doc_id").orderBy("page", "i")
    t = tokens.select("doc_id", F.row_number().over(w).alias("at"), *(F.col("text").alias("x0") if k == 0 else F.lead("text", k).over(w).alias(f"x{k}") for k in range(MOST_TOKENS)))
    starts = F.upper("x0").rlike("^[^A-ZА-Я0-9]*([BВ]|IBAN|TBAM|PBAM|ПВАМ|ТВАМ)")
    runs = F.transform(F.sequence(F.lit(1), F.lit(MOST_TOKENS)), lambda n: F.struct(n.alias("n"), account_number(F.array_join(F.slice(F.array(*(F.coalesce(f"x{k}", F.lit("")) for k in range(MOST_TOKENS))), 1, n), "")).alias("c")))
    shaped = F.filter(runs, lambda r: r["c"].rlike("^BG[0-9]{2}[A-Z]{4}[0-9]{4}[0-9A-Z]{10}$"))
    cand = t.where(starts).select("doc_id", "at", F.explode(shaped).alias("r")).select("doc_id", "at", "r.n", F.col("r.c").alias("iban")).withColumn("valid", S.iban_mod97(F.col("iban")))
    best = cand.groupBy("doc_id").agg(F.min_by(F.struct("iban", "valid"), F.struct(~F.col("valid"), "n", "at")).alias("b"))
    near = F.upper(F.translate(F.concat_ws(" ", "x0", "x1", "x2"), *LOOK_ALIKES))
    bic = F.nullif(F.regexp_extract(near, r"^(?:BIC|SWIFT|БИК)\s*[:./-]?\s*([A-Z]{6}[A-Z0-9]{2}(?:[A-Z0-9]{3})?)(?![A-Z0-9])", 1), F.lit(""))
    pair = F.lower(F.concat_ws(" ", "x0", "x1"))
    said = t.select("doc_id", "at", bic.alias("bic"), pair.rlike(r"банков\s*(път|превод)").alias("bank"), pair.rlike(r"^в\s*брой").alias("cash"))
    said = said.groupBy("doc_id").agg(F.min_by("bic", F.when(F.col("bic").isNotNull(), F.col("at"))).alias("said_bic"), F.max("bank").alias("bank"), F.max("cash").alias("cash"))
    code = F.substring("b.iban", 5, 4)
    of_bank = lambda j: F.try_element_at(F.create_map(*(F.lit(x) for k, v in BANKS.items() for x in (k, v[j]))), code)
    out = said.join(best, "doc_id", "left")
    method = F.when(F.col("bank"), "банков превод").when(F.col("cash"), "в брой")
    return out.select("doc_id", F.col("b.iban").alias("iban"), F.coalesce("b.valid", F.lit(False)).alias("iban_valid"), code.alias("bank_code"), F.coalesce("said_bic", of_bank(0)).alias("bic"), of_bank(1).alias("bank_name"), method.alias("method"))
