"""The table chain and the currency's witnesses: values that the rules state, and pixel by pixel for the column profile."""

import datetime
import random
from decimal import Decimal

import numpy as np
import pytest
from pyspark.sql import functions as F

from ledgerloom.operators import extraction as X
from ledgerloom.operators import tables as T

TOKENS = "doc_id long, page int, i int, text string, left int, top int, width int, height int"


def tokens(spark, rows):
    """rows: (doc, page, text, left, top, width, height)."""
    return spark.createDataFrame([(d, p, i, t, l, y, w, h) for i, (d, p, t, l, y, w, h) in enumerate(rows)], TOKENS)


def test_column_types(spark):
    want = {
        "стойност": "total_price", "СТОЙНОСТ": "total_price", "ДОБРУДЖАНСКА": None, "НАДЕНИЦА": None, "ХАМБУРГСКИ": None, "САЛАМ": None, "КРЕНВИРШ": None, "описание на сделката": None,
        "място на сделката": None, "дата на данъчно събитие": None, "№": "index", "No": "index", "код": "index", "наименование": "description", "стока": "description", "описание": "description",
        "продукт": "description", "мярка": "unit", "ед. мярка": "unit", "ед.мярка": "unit", "м-ка": "unit", "количество": "quantity", "кол-во": "quantity", "кол.": "quantity", "бр.": "quantity",
        "ед. цена": "unit_price", "цена": "unit_price", "ед.цена": "unit_price", "ддс %": "vat_rate", "% ддс": "vat_rate", "ставка": "vat_rate", "стойност без ддс": "total_price", "сума": "total_price",
        "отстъпка": "discount", "търговска отстъпка": "discount", "отст.": "discount", "": None, "12.50": None,
    }
    df = spark.createDataFrame([(w,) for w in want], "w string")
    assert dict(map(tuple, df.select("w", T.column_type(F.col("w"))).collect())) == want


def plain_profile(rows, page_width=2500):
    """Spans of a page by a histogram of every pixel and its moving mean."""
    rows = [r for r in rows if r[2].strip() not in ("", *T.NOISE)]
    wide = max(page_width, max(l + w for _, _, _, l, _, w, _ in rows) + 50)
    hist = np.zeros(wide)
    for _, _, _, l, _, w, _ in rows:
        hist[max(0, min(wide - 1, l)) : max(0, min(wide - 1, l + w)) + 1] += 1
    on = np.round(np.convolve(hist, np.ones(25), mode="same")) >= 3
    edge = np.flatnonzero(np.diff(np.concatenate([[0], on.astype(int), [0]])))
    spans = []
    for s, e in zip(edge[::2].tolist(), (edge[1::2] - 1).tolist()):
        n = sum(s <= l + w // 2 <= e for _, _, _, l, _, w, _ in rows)
        if n and spans and s - spans[-1][1] < 20:
            spans[-1] = (spans[-1][0], e, spans[-1][2] + n)
        elif n:
            spans.append((s, e, n))
    return spans


def test_profile_pixel_by_pixel(spark):
    rng = random.Random(4)
    pages = {p: [(1, p, rng.choice(["12.50", "кафе", "|", "20%", "x"]), rng.choice([rng.randint(0, 2600), 300, 310, 2490]), 10 * i, rng.choice([0, 1, 2, 3, 30, rng.randint(1, 300)]), 20) for i in range(rng.choice([1, 3, 12, 40]))] for p in range(1, 40)}
    pages = {p: r for p, r in pages.items() if any(x[2] != "|" for x in r)}
    got = {}
    for r in T.column_profile(tokens(spark, [x for rows in pages.values() for x in rows])).collect():
        got.setdefault(r["page"], []).append((r["x_left"], r["x_right"], r["n_tokens"]))
    assert {p: sorted(v) for p, v in got.items()} == {p: s for p, rows in pages.items() if (s := plain_profile(rows))}


def test_profile_types(spark):
    rows = [("КАФЕ", 300, 80), ("ЛАВАЦА", 400, 100), ("1.000", 1420, 60), ("18.32", 1820, 60), ("20.00%", 2000, 60), ("18.32", 2220, 60)]
    got = T.column_profile(tokens(spark, [(1, 1, t, x, 100, w, 25) for t, x, w in rows])).orderBy("x_left").collect()
    assert [r["semantic_type"] for r in got] == ["description", "quantity", "unit_price", "vat_rate", "total_price"]  # the two words of one column are 20 apart
    assert T.column_profile(tokens(spark, [])).count() == 0


HEAD = [(1, 1, "№", 100, 500, 30, 25), (1, 1, "Наименование на стоката", 200, 500, 300, 25), (1, 1, "Мярка", 600, 500, 80, 25), (1, 1, "Количество", 750, 500, 120, 25), (1, 1, "Ед. цена", 950, 500, 100, 25), (1, 1, "Стойност", 1150, 500, 100, 25)]


def chain(spark, rows):
    lines = T.marked_lines(T.page_lines(tokens(spark, rows)))
    heads = T.validate_columns(T.table_headers(lines), lines)
    return lines, heads, T.continue_tables(heads, lines)


def test_headers_of_one_and_two_lines(spark):
    row = [("1", 100, 20), ("Кафе Лаваца", 200, 150), ("бр.", 600, 40), ("2.000", 750, 60), ("12.50", 950, 60), ("25.00", 1150, 60)]
    two = [(2, 1, "№", 100, 500, 30, 20), (2, 1, "Наименование", 200, 500, 150, 20), (2, 1, "Количество", 700, 525, 100, 20), (2, 1, "Ед. цена", 900, 525, 80, 20), (2, 1, "Стойност", 1100, 525, 80, 20)]
    two += [(2, 1, t, x, 560, w, 20) for t, x, w in (("1", 100, 20), ("Шоколад Милка", 200, 140), ("5", 700, 20), ("2.00", 900, 40), ("10.00", 1100, 50))]
    rows = HEAD + [(1, 1, t, x, 550, w, 25) for t, x, w in row] + two + [(3, 1, t, x, y, w, h) for _, _, t, x, y, w, h in HEAD]  # the third has no row
    lines, heads, tables = chain(spark, rows)
    got = {r["doc_id"]: [c["semantic_type"] for c in r["columns"]] for r in heads.collect()}
    assert got == {1: ["index", "description", "unit", "quantity", "unit_price", "total_price"], 2: ["index", "description", "quantity", "unit_price", "total_price"]}
    size = {r["doc_id"]: (r["line"], r["size"]) for r in heads.collect()}
    assert size == {1: (0, 1), 2: (0, 2)}
    first = heads.where("doc_id = 1").first()["columns"]
    assert first[0]["x_left"] == 0 and first[-1]["x_right"] == 1250 and first[1]["x_right"] == 565  # 35 before the next header, as the description is short of it
    items = {r["doc_id"]: r for r in T.line_items(tables, lines, spark.createDataFrame([], "doc_id long, base decimal(18,2)")).collect()}
    assert (items[1]["description"], items[1]["unit"], items[1]["quantity"], items[1]["price"], items[1]["total"]) == ("Кафе Лаваца", "бр.", Decimal("2.000"), Decimal("12.5000"), Decimal("25.00"))


def test_columns_are_proved_and_tables_continue(spark):
    head = [(1, 1, t, x, 500, w, 25) for t, x, w in (("Наименование", 200, 150), ("К-во", 600, 60), ("Опаковка", 800, 100), ("Ед.цена", 1000, 80), ("Стойност", 1200, 90))]
    row = lambda p, y, name, sku, n, price, total: [(1, p, name, 200, y, 120, 25), (1, p, sku, 600, y, 60, 25), (1, p, n, 800, y, 30, 25), (1, p, price, 1000, y, 50, 25), (1, p, total, 1200, y, 60, 25)]
    rows = head + row(1, 550, "хляб", "100200", "3", "2.00", "6.00") + row(1, 590, "мляко", "100201", "2", "1.50", "3.00")
    rows += [(1, 2, "Пренос", 200, 400, 80, 25), (1, 2, "9.00", 1200, 400, 60, 25)] + row(2, 500, "сирене", "100202", "1", "8.00", "8.00") + row(2, 540, "масло", "100203", "4", "2.50", "10.00")
    rows += [(1, 2, "Данъчна", 800, 700, 90, 25), (1, 2, "основа", 1000, 700, 80, 25), (1, 2, "27.00", 1200, 700, 60, 25)]
    rows += [(1, 4, "сам", 200, 500, 80, 25)] + row(4, 540, "без", "1", "1", "1.00", "1.00") + row(4, 580, "връзка", "1", "1", "1.00", "1.00")  # page 3 is missing
    lines, heads, tables = chain(spark, rows)
    assert [(r["matches"], [c["semantic_type"] for c in r["columns"]]) for r in heads.collect()] == [(2, ["description", "index", "quantity", "unit_price", "total_price"])]
    assert sorted((r["page"], r["kind"], r["n_rows"]) for r in tables.collect()) == [(1, "header", 2), (2, "continued", 2)]
    items = T.line_items(tables, lines, spark.createDataFrame([(1, Decimal("27.00"))], "doc_id long, base decimal(18,2)")).orderBy("item").collect()
    assert [(r["item"], r["page"], r["description"], r["article_code"], r["quantity"], r["total"]) for r in items] == [
        (1, 1, "хляб", "100200", 3, 6), (2, 1, "мляко", "100201", 2, 3), (3, 2, "сирене", "100202", 1, 8), (4, 2, "масло", "100203", 4, 10),
    ]


def test_items_lean_on_the_one_before(spark):
    def row(y, *cells):
        return [(1, 1, t, x, y, 60, 25) for t, x in cells]

    rows = HEAD + row(550, ("1", 100), ("Кафе", 200)) + row(580, ("2", 750), ("12.50", 950), ("25.00", 1150))  # numbers below
    rows += row(620, ("2", 100), ("Чай", 200), ("4", 750), ("1.00", 950)) + row(650, ("билков", 200))  # the total is missing; more text
    rows += row(690, ("3", 100), ("Мед", 200), ("90.00", 950), ("18.00", 1150), ("2", 750))  # a slipped point
    rows += row(730, ("4", 100), ("Сок", 200), ("5", 750), ("20.00", 1150)) + row(770, ("5", 100), ("Вода", 200), ("0.80", 950), ("999.00", 1150), ("2", 750))  # no price; above the base
    lines, _, tables = chain(spark, rows)
    got = T.line_items(tables, lines, spark.createDataFrame([(1, Decimal("100.00"))], "doc_id long, base decimal(18,2)")).orderBy("item").collect()
    assert [(r["description"], r["quantity"], r["price"], r["total"]) for r in got] == [
        ("Кафе", 2, Decimal("12.5"), 25), ("Чай билков", 4, 1, 4), ("Мед", 2, 9, 18), ("Сок", 5, 4, 20), ("Вода", 2, Decimal("0.8"), Decimal("1.60")),
    ]


@pytest.mark.parametrize(
    ("lines", "date", "want"),
    [
        (["ФАКТУРА", "Сума за плащане: 100.00 лв.", "Равностойност в EUR: 51.13 EUR курс 1.95583", "Словом: сто лева"], "2026-02-15", "BGN"),
        (["Сума за плащане: 50.00 EUR", "Равностойност в лева: 97.79 лв.", "Словом: петдесет евро"], "2026-03-01", "EUR"),
        (["Словом: двеста лева"], "2026-05-01", "BGN"),
        (["цена EUR цена BGN"], "2025-10-15", "BGN"),
        (["цена EUR цена BGN"], "2026-01-01", "EUR"),
        (["Общо 150.00 BGR"], "2025-08-10", "BGN"),
        (["Сума: 75.50 BOM"], "2025-09-01", "BGN"),
        (["Сума 12.00 ВОМ"], "2025-09-01", "BGN"),
        (["Нищо"], "2026-01-02", "EUR"),
        ([], None, "BGN"),
    ],
)
def test_currency(spark, lines, date, want):
    rows = spark.createDataFrame([(1, 1, i, t) for i, t in enumerate(lines)], "doc_id long, page int, line int, text string")
    dates = spark.createDataFrame([(1, date and datetime.date.fromisoformat(date))], "doc_id long, date_issued date")
    assert [r["currency"] for r in X.currency_vote(rows, dates).collect()] == [want]


def test_vat_grounds(spark):
    rows = [
        (1, "100.00", "20.00", "120.00", 20, "", "BG1"), (2, "100.00", "0.00", "100.00", None, "Метален скрап, чл. 163а, ал. 1 от ЗДДС", "BG1"), (3, "100.00", "0.00", "100.00", None, "по чл. 163 а, пшеница", "BG1"),
        (4, "100.00", "0.00", "100.00", None, "Reverse   charge", "BG1"), (5, "100.00", None, "100.00", None, "Заводска продажба", "DE123"), (6, "100.00", None, "120.00", None, "", "BG1"), (7, "100.00", "0.00", "100.00", None, "Заводска продажба", "BG1"),
        (8, "100.00", "0.00", "100.00", None, "обратно начисляване по чл. 82, ал. 2", None), (9, "100.00", "20.00", "120.00", 0, "износ", None), (10, None, None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, "invoice_id long, tax_base string, vat string, total string, rate int, text string, supplier_vat string")
    df = df.withColumns({c: F.col(c).cast("decimal(18,2)") for c in ("tax_base", "vat", "total")})
    got = {r["invoice_id"]: (r["is_zero"], r["is_valid"], r["code"]) for r in X.check_vat_grounds(df).collect()}
    assert got == {
        1: (False, True, None), 2: (True, True, "CHL_163A_REVERSE_CHARGE_SCRAP"), 3: (True, True, "CHL_163A_REVERSE_CHARGE_GRAIN"), 4: (True, True, "REVERSE_CHARGE_GENERAL"), 5: (True, True, "CHL_82_AL_2_FOREIGN"),
        6: (False, True, None), 7: (True, False, None), 8: (True, True, "CHL_82_AL_2_REVERSE_CHARGE"), 9: (True, True, "CHL_28_EXPORT"), 10: (False, True, None),
    }


def test_payment(spark):
    docs = {
        1: "IBAN: BG80 BNBG 9661 1020 3456 78 BIC: BNBGBGSD по банков път",  # the statutory example of a valid number
        2: "IBAN BG80BNBG96611020345679 в брой",  # a wrong digit
        3: "сметка В680ВNВG96611020345678",
        4: "нищо",
        5: "BG80BNBG9661102034 5679 BG80BNBG96611020345678",  # the valid one counts, not the first
    }
    rows = [(d, 1, i, w) for d, t in docs.items() for i, w in enumerate(t.split())]
    got = {r["doc_id"]: tuple(r)[1:] for r in X.extract_payment(spark.createDataFrame(rows, "doc_id long, page int, i int, text string")).collect()}
    good = "BG80BNBG96611020345678"
    assert got[1] == (good, True, "BNBG", "BNBGBGSD", "Българска народна банка", "банков превод")
    assert got[2] == ("BG80BNBG96611020345679", False, "BNBG", "BNBGBGSF", "Българска народна банка", "в брой")
    assert got[3][:2] == (good, True) and got[4] == (None, False, None, None, None, None) and got[5][:2] == (good, True)


def test_cells_of_a_line_are_worked_out_once(spark):
    """The tokens of a line go through the fold of double readings once, not once more for each use of its result."""
    columns = "array<struct<semantic_type:string,x_left:int,x_right:int,x_center:int>>"
    df = spark.createDataFrame([([(10, 0, "a", 20), (12, 1, "a", 20), (300, 2, "5", 20)], [("description", 0, 200, 20), ("quantity", 200, 500, 310)])], f"tokens array<struct<left:int,i:int,text:string,width:int>>, columns {columns}")
    out = df.select(T.cells(F.col("tokens"), F.col("columns")).alias("cell"))
    assert out.first()["cell"] == {"description": "a", "quantity": "5"}
    assert out._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") == 1
