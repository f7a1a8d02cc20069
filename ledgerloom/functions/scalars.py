"""Column functions for identifiers, money and dates. All are built-in expressions.

``try_`` casts are used throughout: bad text gives null, as ANSI mode would fail on it.
"""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column
from pyspark.sql import functions as F

RATE = "1.95583BD"


def _digits(text: Column) -> Column:
    return F.regexp_replace(F.coalesce(text.cast("string"), F.lit("")), "[^0-9]", "")


def _digit(text: Column, i: int) -> Column:
    return F.substring(text, i, 1).try_cast("int")


def _weighted(text: Column, weights, first: int = 1) -> Column:
    return reduce(add, (_digit(text, first + i) * w for i, w in enumerate(weights)))


def _mod11(one: Column, two: Column) -> Column:
    return F.when(one % 11 < 10, one % 11).when(two % 11 < 10, two % 11).otherwise(0)


# B01
def parse_money(text: Column) -> Column:
    """European or English number text to DECIMAL(28,8); null if it is no number.

    Parentheses or a dash in front mean negative; currency words and all other letters are dropped; a euro sign read as 6
    or e after two decimals goes. Spaces group thousands, or part the cents ("109 74"); of other number groups the last with
    a separator counts. Of two kinds of separators the last is the decimal one; a single comma is, unless it groups three
    digits after more than two; several of a kind group.
    """
    return _let(F.trim(text.cast("string")), _money)


def _let(value: Column, then) -> Column:
    """``then`` of a column that is worked out once, however often it is named."""
    return F.transform(F.array(value), then)[0]


def _money(whole: Column) -> Column:
    glyph = r"\s*[6eE€](?![\p{L}\d])"
    bare = F.regexp_replace(F.regexp_replace(whole, r"^\((.*?)\)$", "$1"), rf"(\d+[,.]\d{{2}}){glyph}", "$1")
    bare = _let(bare, lambda t: F.when(t.rlike(r"[.,]\d{2}"), t).otherwise(F.regexp_replace(t, rf"(\d+)\s+(\d{{2}}){glyph}", "$1.$2")))
    bare = F.trim(F.regexp_replace(F.regexp_replace(bare, r"(?iu)лв\.?|лева|bgn|eur|евро|€", ""), r"[^\d.,\s\-–—−]", ""))

    def signed(t: Column) -> Column:
        kept = F.regexp_replace(F.trim(F.regexp_replace(t, r"[^\d.,\s]", "")), r"[.,]+$", "")
        value = _let(_let(F.regexp_replace(kept, r"([.,])\s+(\d{2})(?!\d)", "$1$2"), _group), _plain)
        return F.when(t.rlike(r"^[-–—−]") | whole.rlike(r"^\(.*\)$"), -value).otherwise(value)

    return _let(bare, signed)


def _group(t: Column) -> Column:
    """One number of those between blanks."""

    def of(parts: Column) -> Column:
        last, marked = F.element_at(parts, -1), F.filter(parts, lambda x: x.rlike(r"\d") & x.rlike("[.,]"))
        cents = last.rlike(r"^\d{2}$") & (F.size(marked) == 0)
        return F.when(cents, F.concat(F.array_join(F.slice(parts, F.lit(1), F.size(parts) - 1), ""), F.lit("."), last)).when(F.size(marked) > 0, F.element_at(marked, -1)).otherwise(last)

    grouped = t.rlike(r"^\d{1,3}(\s+\d{3})*\s+\d{3}([.,]\d{1,4})?$")
    one = F.when(~t.rlike(r"\s"), t).when(grouped, F.regexp_replace(t, r"\s+", "")).otherwise(_let(F.split(t, r"\s+"), of))
    return F.regexp_replace(one, r"[.,]+$", "")


def _plain(t: Column) -> Column:
    commas, dots = (F.length(t) - F.length(F.replace(t, F.lit(c), F.lit(""))) for c in ",.")
    without = lambda c: F.replace(t, F.lit(c), F.lit(""))
    after_comma, after_dot = F.length(F.substring_index(t, ",", -1)), F.length(F.substring_index(t, ".", -1))
    point = lambda c: F.replace(c, F.lit(","), F.lit("."))
    plain = (
        F.when((commas > 0) & (dots > 0), F.when(after_comma < after_dot, point(without("."))).otherwise(without(",")))
        .when(commas > 1, without(","))
        .when((commas == 1) & (after_comma == 3) & (F.length(t) > 6), without(","))
        .when(commas == 1, point(t))
        .when((dots > 1) & (after_dot == 3), without("."))
        .otherwise(t)
    )
    return _let(plain, lambda p: F.when(p.rlike(r"^[0-9]*\.?[0-9]+$|^[0-9]+\.$"), p.try_cast("decimal(28,8)")))


# B02
def parse_date(text: Column) -> Column:
    """ISO, D.M.YYYY and D.M.YY (up to 50 means 20xx); О reads 0, З reads 3; a day or month of 81-89 loses 80."""
    t = F.translate(F.trim(text.cast("string")), "ОоOoЗз", "000033")
    iso, dmy = "^(\\d{4})[-/.](\\d{1,2})[-/.](\\d{1,2})", "(\\d{1,2})[./-](\\d{1,2})[./-](\\d{4}|\\d{2})(?!\\d)"
    part = lambda p, i: F.regexp_extract(t, p, i).try_cast("int")
    is_iso = t.rlike(iso)
    y = F.when(is_iso, part(iso, 1)).otherwise(part(dmy, 3))
    y = F.when(~is_iso & (F.length(F.regexp_extract(t, dmy, 3)) == 2), F.when(y <= 50, y + 2000).otherwise(y + 1900)).otherwise(y)
    fix = lambda v: F.when(v.between(81, 89), v - 80).otherwise(v)
    m, d = fix(F.when(is_iso, part(iso, 2)).otherwise(part(dmy, 2))), fix(F.when(is_iso, part(iso, 3)).otherwise(part(dmy, 1)))
    return F.when(y.between(1990, 2100), F.try_to_date(F.format_string("%04d-%02d-%02d", y, m, d), "yyyy-MM-dd"))


# B03
#: The layouts that are read.
STRICT_LAYOUTS = ("yyyy-MM-dd", "yyyy/MM/dd", "yyyy.MM.dd", "dd.MM.yyyy", "dd/MM/yyyy", "dd-MM-yyyy")


def parse_date_strict(text: Column) -> Column:
    """Exactly six layouts on the first ten characters."""
    return F.coalesce(*(F.try_to_date(F.substring(F.trim(text.cast("string")), 1, 10), p) for p in STRICT_LAYOUTS))


# B04, B05, B06
def normalize_doc_number(text: Column) -> Column:
    """The last ten digits, zeros in front; ten zeros if there are none."""
    return F.lpad(F.right(_digits(text), F.lit(10)), 10, "0")


def match_doc_number(text: Column) -> Column:
    """Digits without zeros in front; 0 if none are left."""
    d = F.regexp_replace(_digits(text), "^0+", "")
    return F.when(d == "", "0").otherwise(d)


def undouble_number(text: Column) -> Column:
    """One half of a number of eight or more characters whose halves are equal."""
    n = F.length(text)
    half = F.substr(text, F.lit(1), (n / 2).cast("int"))
    return F.when((n >= 8) & (n % 2 == 0) & (F.concat(half, half) == text), half).otherwise(text)


# B07, B08
def check_digit9(base: Column) -> Column:
    """The ninth digit for eight. Weights 1 to 8, then 3 to 10."""
    return _mod11(_weighted(base, range(1, 9)), _weighted(base, range(3, 11)))


def eik9_valid(text: Column) -> Column:
    return F.coalesce(text.rlike("^[0-9]{9}$") & (check_digit9(text) == _digit(text, 9)), F.lit(False))


def eik13_valid(text: Column) -> Column:
    """The first nine are valid, and the last is the check digit of digits 9 to 12. The weights."""
    tail = _mod11(_weighted(text, (2, 7, 3, 5), 9), _weighted(text, (4, 9, 5, 7), 9))
    return F.coalesce(text.rlike("^[0-9]{13}$") & (check_digit9(text) == _digit(text, 9)) & (tail == _digit(text, 13)), F.lit(False))


def eik_valid(text: Column) -> Column:
    """9 and 13 digits by their sums; 10 digits are a person's and pass."""
    return eik9_valid(text) | eik13_valid(text) | F.coalesce(text.rlike("^[0-9]{10}$"), F.lit(False))


def eik_check_digit(text: Column) -> Column:
    """Nine digits with the ninth made right; others as they are."""
    return F.when(text.rlike("^[0-9]{9}$"), F.concat(F.substring(text, 1, 8), check_digit9(text).cast("string"))).otherwise(text)


# B09
#: What each digit is taken for.
CONFUSED = {"8": "0", "0": "8", "1": "7", "7": "1", "3": "8", "6": "5", "5": "6", "4": "6"}


def _repaired(digits: Column) -> Column:
    """Nine digits; as they are if valid, or unless exactly one swap of one digit makes them valid."""
    swap = lambda i: F.translate(F.substr(digits, i, F.lit(1)), "".join(CONFUSED), "".join(CONFUSED.values()))
    tries = F.transform(F.sequence(F.lit(1), F.lit(9)), lambda i: F.concat(F.substr(digits, F.lit(1), i - 1), swap(i), F.substr(digits, i + 1)))
    found = F.filter(tries, lambda c: (c != digits) & eik9_valid(c))
    return F.when(eik9_valid(digits), digits).when(F.size(found) == 1, F.element_at(found, 1)).otherwise(digits)


def eik_repair(text: Column) -> Column:
    """Nine digits repaired; text of any other number of digits as it is."""
    d = _digits(text)
    return F.when(F.length(d) == 9, _repaired(d)).otherwise(text)


# B10, B11
def normalize_eik(text: Column) -> Column:
    """Digits of an EIK, or null: nine are repaired; of 10 to 12 the first window of nine that is or can be made valid, else ten that
    don't start with 0; 13 lose an attached branch code if nine at an end are valid alone; of more the first valid window."""
    d, n = _digits(text), F.length(_digits(text))
    windows = F.transform(F.sequence(F.lit(1), F.greatest(n - 8, F.lit(1))), lambda i: F.substr(d, i, F.lit(9)))
    valid = lambda ws: F.try_element_at(F.filter(ws, lambda w: eik9_valid(w)), F.lit(1))
    repaired = F.transform(windows, lambda w: _repaired(w))
    whole = eik13_valid(d)
    thirteen = F.when(~whole & eik9_valid(F.substring(d, 1, 9)), F.substring(d, 1, 9)).when(~whole & eik9_valid(F.substring(d, 5, 9)), F.substring(d, 5, 9)).otherwise(d)
    return (
        F.when(n == 9, repaired[0])
        .when(n.between(10, 12), F.coalesce(valid(repaired), F.when((n == 10) & ~d.startswith("0"), d)))
        .when(n == 13, thirteen)
        .when(n > 13, valid(windows))
    )


def normalize_vat(text: Column) -> Column:
    """BG and the EIK's digits, or any 9, 10 or 13 digits; null else."""
    d = _digits(text)
    return F.concat(F.lit("BG"), F.coalesce(normalize_eik(text), F.when(F.length(d).isin(9, 10, 13), d)))


# B12
def normalize_iban(text: Column) -> Column:
    """Letters and digits in upper case, if it is BG and 22 characters; else null."""
    t = F.upper(F.regexp_replace(text, "[^0-9A-Za-z]", ""))
    return F.when(t.rlike("^BG[0-9A-Z]{20}$"), t)


def iban_mod97(text: Column) -> Column:
    """Whether the remainder is 1; the number is folded character by character and never built."""
    t = F.upper(F.regexp_replace(text, "\\s", ""))
    turned = F.concat(F.substr(t, F.lit(5)), F.substring(t, 1, 4))
    value = lambda c: F.when(c.between("0", "9"), c.try_cast("int")).otherwise(F.ascii(c) - 55)
    fold = F.aggregate(F.split(turned, ""), F.lit(0), lambda acc, c: F.when(c == "", acc).when(c.between("0", "9"), (acc * 10 + value(c)) % 97).otherwise((acc * 100 + value(c)) % 97))
    return F.coalesce(t.rlike("^[A-Z]{2}[0-9]{2}[0-9A-Z]{4,}$") & (fold == 1), F.lit(False))


def normalize_bic(text: Column) -> Column:
    t = F.upper(F.regexp_replace(text, "\\s", ""))
    return F.when(t.rlike("^[A-Z]{6}[A-Z0-9]{2}([A-Z0-9]{3})?$"), t)


# B13
def sanitize_vat_rate(text: Column, default: int = 20) -> Column:
    """A rate of at most 25 as it is; misread forms of 20 and all larger numbers 20 (or the default); null stays null."""
    t = F.trim(F.regexp_replace(F.trim(text.cast("string")), "%+$", ""))
    t = F.trim(F.regexp_replace(t, "^-", ""))
    # How 20 is misread.
    twenty = t.isin("2000", "20000", "200000", "2000.00", "2000.0", "200", "720", "720.00", "720.0", "72000", "120", "120.00", "3600", "36.00", "3000", "30000") | t.rlike(r"^[71/|I!l]20(\.0+)?$") | t.rlike(r"2000\d*|22000\d*")
    v = F.abs(t.try_cast("decimal(28,8)"))
    near = lambda x: F.abs(x - 20) < F.expr("0.5BD")
    return F.when(text.isNull(), None).when(twenty, F.lit(20)).when(v.isNull(), F.lit(default)).when(v <= 25, v).when(near(v / 100) | near(v / 10), F.lit(20)).otherwise(F.lit(default)).cast("decimal(5,2)")


# B14, B15
def eur_to_bgn(amount: Column) -> Column:
    return F.round(amount.cast("decimal(18,2)") * F.expr(RATE), 2).cast("decimal(18,2)")


def bgn_to_eur(amount: Column) -> Column:
    return F.round(amount.cast("decimal(18,2)") / F.expr(RATE), 2).cast("decimal(18,2)")


def parity_ok(eur: Column, bgn: Column, tol: str = "0.02") -> Column:
    return F.abs(eur_to_bgn(eur) - bgn) <= F.expr(f"{tol}BD")


def default_currency(currency: Column, issued: Column) -> Column:
    """Three letters in upper case; without any, EUR from 2026 on and BGN before."""
    c = F.upper(F.left(F.trim(currency), F.lit(3)))
    return F.when(F.coalesce(c, F.lit("")) != "", c).when(issued >= F.lit("2026-01-01").cast("date"), "EUR").otherwise("BGN")


# B16
#: Number words.
ONES = {"нула": 0, "един": 1, "една": 1, "едно": 1, "два": 2, "две": 2, "три": 3, "четири": 4, "пет": 5, "шест": 6, "седем": 7, "осем": 8, "девет": 9}
TEENS = {
    "десет": 10, "единадесет": 11, "единайсет": 11, "дванадесет": 12, "дванайсет": 12, "тринадесет": 13, "тринайсет": 13, "четиринадесет": 14, "четиринайсет": 14, "петнадесет": 15, "петнайсет": 15,
    "шестнадесет": 16, "шестнайсет": 16, "седемнадесет": 17, "седемнайсет": 17, "осемнадесет": 18, "осемнайсет": 18, "деветнадесет": 19, "деветнайсет": 19,
}
TENS = {"двадесет": 20, "тридесет": 30, "четиридесет": 40, "петдесет": 50, "шестдесет": 60, "шейсет": 60, "седемдесет": 70, "осемдесет": 80, "деветдесет": 90}
HUNDREDS = {
    "сто": 100, "двеста": 200, "триста": 300, "четиристотин": 400, "петстотин": 500, "шестстотин": 600, "шетстотин": 600, "шестототин": 600, "шестотин": 600, "седемстотин": 700, "осемстотин": 800,
    "деветстотин": 900,
}
THOUSANDS = ("хиляда", "хиляди")


def _number_of(words: Column) -> Column:
    """The number that an array of words names; other words are passed over; null for 0."""
    glued = {h + w: x + v for h, x in HUNDREDS.items() for w, v in (ONES | TEENS | TENS).items()}
    table = F.create_map(*(F.lit(x) for pair in (glued | ONES | TEENS | TENS | HUNDREDS).items() for x in pair))
    start = F.struct(F.lit(0).alias("total"), F.lit(0).alias("now"))
    step = lambda a, w: (
        F.when(w.isin(*THOUSANDS), F.struct((a["total"] + F.greatest(a["now"], F.lit(1)) * 1000).alias("total"), F.lit(0).alias("now")))
        .otherwise(F.struct(a["total"].alias("total"), (a["now"] + F.coalesce(F.try_element_at(table, w), F.lit(0))).alias("now")))
    )
    return F.aggregate(words, start, step, lambda a: F.nullif(a["total"] + a["now"], F.lit(0)))


def amount_in_words(text: Column) -> Column:
    """DECIMAL(18,2) of an amount in words, with cents in digits or words; null if there is none."""
    t, unit, cents = F.lower(F.trim(text)), r"(?:лв\.?|лева|bgn|eur|евро)", r"(?:ст\.?|стотинки?|цент[ажд]?|ценгж)"
    words = lambda p, i: F.split(F.trim(F.regexp_extract(t, p, i)), r"\s+")
    digits, spelled, whole = rf"(?U)([\w\s]+?){unit}\s*(?:[имо\s]*)?(\d{{1,2}})\s*{cents}", rf"(?U)([\w\s]+?){unit}\s*(?:[имо\s]+)?([\w\s]+?)\s*{cents}", rf"(?U)([\w\s]+?){unit}"
    amount = lambda leva, c: (leva + c.cast("decimal(18,2)") / 100).cast("decimal(18,2)")
    in_words = _number_of(words(spelled, 2))
    out = F.coalesce(
        F.when(t.rlike(digits), amount(_number_of(words(digits, 1)), F.regexp_extract(t, digits, 2).try_cast("int"))),
        F.when(t.rlike(spelled) & (in_words < 100), amount(_number_of(words(spelled, 1)), in_words)),
        F.when(t.rlike(whole), _number_of(words(whole, 1)).cast("decimal(18,2)")),
    )
    return F.when(F.length(t) >= 5, out)


# B17, B18, B19
#: Legal forms, in the order in which they are taken out.
LEGAL_FORMS = (
    r"еоод\s+енд\s+ко", r"eood\s*&\s*co", r"eood\s+and\s+co", "еоод", "оод", "еад", "ад", "ет", "сд", "кд", "кда", "дззд", "eood", "lood", "ead", "ad", "ltd", "llc", "gmbh", "corp", "inc",
    "ag", "sa", "bv",
)
#: Words that name no company by themselves.
GENERIC_WORDS = (
    "българия", "bulgaria", "софия", "sofia", "варна", "varna", "пловдив", "plovdiv", "бургас", "burgas", "европа", "europe", "интернешънъл", "international", "група", "group", "инвест",
    "invest", "трейдинг", "trading", "комерс", "commerce", "холдинг", "holding", "системс", "systems", "сървисиз", "services", "къмпани", "company", "глобал", "global", "експрес", "express",
    "транс", "trans", "логистик", "logistic", "логистикс", "logistics", "център", "center", "centre", "магазин", "shop", "маркет", "market",
)


def normalize_company(text: Column) -> Column:
    """Lower case, without punctuation and legal forms, single spaces; empty for null."""
    t = F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[\"'`«»„“.,()\-/\\:;!?*#]", " ")
    for form in LEGAL_FORMS:
        t = F.regexp_replace(t, rf"(?U)\b{form}\b", " ")
    return F.trim(F.regexp_replace(t, r"(?U)\s+", " "))


#: The statutory transliteration.
BG_EN = {
    "а": "a", "б": "b", "в": "v", "г": "g", "д": "d", "е": "e", "ж": "zh", "з": "z", "и": "i", "й": "y", "к": "k", "л": "l", "м": "m", "н": "n", "о": "o",
    "п": "p", "р": "r", "с": "s", "т": "t", "у": "u", "ф": "f", "х": "h", "ц": "ts", "ч": "ch", "ш": "sh", "щ": "sht", "ъ": "a", "ь": "y", "ю": "yu", "я": "ya",
}


def translit_bg_en(text: Column) -> Column:
    """Lower-cased text with each Cyrillic letter by the statutory table."""
    table = F.create_map(*(F.lit(x) for pair in BG_EN.items() for x in pair))
    return F.array_join(F.transform(F.split(F.lower(text), ""), lambda c: F.coalesce(F.try_element_at(table, c), c)), "")


#: Groups of Latin letters by sound, in order, then single ones.
EN_BG_GROUPS = (("sht", "щ"), ("dzh", "дж"), ("zh", "ж"), ("ch", "ч"), ("sh", "ш"), ("ts", "ц"), ("yu", "ю"), ("ya", "я"), ("ge", "дже"), ("gi", "джи"))
EN_BG_LETTERS = ("abcdefghijklmnopqrstuvwyz", "абкдефгхийклмнопкрстуввйз")


def translit_en_bg(text: Column) -> Column:
    """Lower-cased Latin text by its sound in Cyrillic letters."""
    t = F.lower(text)
    for en, bg in EN_BG_GROUPS:
        t = F.replace(t, F.lit(en), F.lit(bg))
    return F.translate(F.replace(t, F.lit("x"), F.lit("кс")), *EN_BG_LETTERS)


def distinctive_tokens(name: Column) -> Column:
    """Distinct words of three letters or more of a normalized name that aren't generic."""
    words = F.split(name, " ")
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) > 2) & ~w.isin(*GENERIC_WORDS)))


# B20
def clean_text(text: Column) -> Column:
    """Markdown links become their text; urls, tel: and brackets go; spaces are squeezed."""
    t = F.regexp_replace(text, "\\[([^\\]]*)\\]\\([^)]*\\)", "$1")
    t = F.regexp_replace(t, "https?://\\S+|tel:\\S*", "")
    return F.trim(F.regexp_replace(F.regexp_replace(t, "[\\[\\]]", ""), "\\s+", " "))


# B21, B22, B23
#: The statutory code of each document type.
DOC_CODES = {
    "INVOICE": "01", "DEBIT_NOTE": "02", "CREDIT_NOTE": "03", "CUSTOMS_DECLARATION": "07", "PROTOCOL_CHL_117": "09", "FISCAL_RECEIPT": "01", "PAYMENT_ORDER_NAP": "01",
    "FISCAL_MEMORY_REPORT": "81", "GOODS_RECEIPT": "00",
}


def nap_doc_type(kind: Column, is_credit: Column, is_debit: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in DOC_CODES.items() for x in pair))
    return F.when(is_credit, "03").when(is_debit, "02").otherwise(F.coalesce(F.try_element_at(table, F.upper(F.trim(kind))), F.lit("01")))


def target_period(text: Column) -> Column:
    """struct(year, month, code) of YYYYMM, YYYY-MM or MM.YYYY; null if it is none or the month is wrong."""
    t = F.trim(text)
    y = F.coalesce(F.nullif(F.regexp_extract(t, "^(\\d{4})[-./]?(\\d{2})$", 1), F.lit("")), F.nullif(F.regexp_extract(t, "^(\\d{1,2})[-./](\\d{4})$", 2), F.lit(""))).try_cast("int")
    m = F.coalesce(F.nullif(F.regexp_extract(t, "^(\\d{4})[-./]?(\\d{2})$", 2), F.lit("")), F.nullif(F.regexp_extract(t, "^(\\d{1,2})[-./](\\d{4})$", 1), F.lit(""))).try_cast("int")
    return F.when(m.between(1, 12), F.struct(y.alias("year"), m.alias("month"), F.format_string("%04d%02d", y, m).alias("code")))


def ole_date(day: Column) -> Column:
    return F.datediff(day, F.lit("1899-12-30").cast("date"))


def from_ole_date(number: Column) -> Column:
    return F.date_add(F.lit("1899-12-30").cast("date"), number.cast("int"))


def display_date(day: Column) -> Column:
    return F.date_format(day, "dd.MM.yyyy")


# B24
def stable_uuid(text: Column) -> Column:
    """32 hex digits in UUID layout; other text by name (version 5 in the DNS namespace)."""
    hexed = F.lower(F.replace(text, F.lit("-"), F.lit("")))
    dns = F.unhex(F.lit("6ba7b8109dad11d180b400c04fd430c8"))
    h = F.sha1(F.concat(dns, F.encode(text, "utf-8")))
    nibble = F.substring(F.lit("89ab89ab89ab89ab"), 1, 16)
    digit = F.conv(F.substring(h, 17, 1), 16, 10).cast("int")
    named = F.concat(F.substring(h, 1, 12), F.lit("5"), F.substring(h, 14, 3), F.substr(nibble, digit % 4 + 1, F.lit(1)), F.substring(h, 18, 15))
    bare = F.when(hexed.rlike("^[0-9a-f]{32}$"), hexed).otherwise(named)
    return F.concat_ws("-", F.substring(bare, 1, 8), F.substring(bare, 9, 4), F.substring(bare, 13, 4), F.substring(bare, 17, 4), F.substring(bare, 21, 12))


# B25
def normalize_bbox(left: Column, top: Column, width: Column, height: Column, pw: int = 2480, ph: int = 3508) -> Column:
    """struct of fractions of the page, cut to 0..1, four places."""
    cut = lambda v, size: F.round(F.least(F.greatest(v / size, F.lit(0.0)), F.lit(1.0)), 4)
    return F.struct(cut(left, pw).alias("x"), cut(top, ph).alias("y"), cut(width, pw).alias("w"), cut(height, ph).alias("h"))


# B26
def series_rules(number: Column, raw: Column | None = None) -> Column:
    """struct(length, prefix, regex, homoglyphs): what a corrected number says of its series; null without digits.

    The prefix is two or more leading zeros, one zero, four digits of ten, else two digits. homoglyphs maps what was read in
    place of a digit to it, where the raw text has as many characters.
    """
    d = _digits(number)
    n, zeros = F.length(d), F.length(F.regexp_extract(d, "^(0+)", 1))
    size = F.when(zeros >= 2, zeros).when(zeros == 1, 1).when(n == 10, 4).otherwise(2)
    prefix = F.substr(d, F.lit(1), size)
    fixed = (zeros >= 1) | (n == 10)
    regex = F.when(fixed, F.format_string("^%s\\d{%d}$", prefix, n - size)).otherwise(F.format_string("^\\d{%d}$", n))
    r = F.regexp_replace(F.coalesce(raw if raw is not None else F.lit(None).cast("string"), F.lit("")), r"\s+", "")
    pairs = F.filter(F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(F.substr(r, i, F.lit(1)).alias("k"), F.substr(d, i, F.lit(1)).alias("v"))), lambda x: ~x["k"].rlike("[0-9]"))
    both = F.flatten(F.transform(pairs, lambda x: F.array(x, F.struct(F.upper(x["k"]).alias("k"), x["v"].alias("v")), F.struct(F.lower(x["k"]).alias("k"), x["v"].alias("v")))))
    last = F.aggregate(both, F.expr("map_from_arrays(array(), array())").cast("map<string,string>"), lambda m, x: F.map_concat(F.map_filter(m, lambda k, v: k != x["k"]), F.create_map(x["k"], x["v"])))
    glyphs = F.when((F.length(r) == n) & ~r.rlike("^[0-9]*$"), last)
    return F.when(n > 0, F.struct(n.alias("length"), prefix.alias("prefix"), regex.alias("regex"), glyphs.alias("homoglyphs")))


# B27, B28, B29
def company_keywords(name: Column) -> Column:
    """The lower-cased name, then its words of three letters or more without legal forms; five at most."""
    words = F.filter(F.split(normalize_company(name), " "), lambda w: F.length(w) >= 3)
    return F.slice(F.array_distinct(F.concat(F.array(F.lower(F.trim(name))), words)), 1, 5)


def to_money(text: Column) -> Column:
    t = F.replace(F.regexp_replace(text.cast("string"), "\\s", ""), F.lit(","), F.lit("."))
    return F.coalesce(F.round(t.try_cast("decimal(28,8)"), 2).try_cast("decimal(18,2)"), F.expr("CAST(0 AS DECIMAL(18,2))"))


def payment_method(method: Column, iban: Column) -> Column:
    m = F.lower(F.coalesce(method, F.lit("")))
    base = F.when(m.rlike("cash|брой|каса"), "CASH").when(m.rlike("bank|банк|превод|transfer"), "BANK").otherwise("CASH")
    return F.when((base == "CASH") & F.coalesce(iban != "", F.lit(False)) & ~m.rlike("cash|брой|каса"), "BANK").otherwise(base)


# B31
def repair_future_date(day: Column, as_of: Column) -> Column:
    """A date after ``as_of``: month 9 or 10 within 30 days becomes 8; a year ending in 9 ends in 5; each only if then not in the future."""
    aug = F.try_to_date(F.concat(F.date_format(day, "yyyy"), F.lit("-08-"), F.date_format(day, "dd")), "yyyy-MM-dd")
    year5 = F.add_months(day, -48)
    return (
        F.when(day <= as_of, day)
        .when(F.month(day).isin(9, 10) & (F.datediff(day, as_of) <= 30) & (aug <= as_of), aug)
        .when((F.year(day) % 10 == 9) & (year5 <= as_of), year5)
        .otherwise(day)
    )
