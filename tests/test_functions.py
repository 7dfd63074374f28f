import pytest
from pyspark.sql import functions as F

from tallyforge.functions import coerce, predicates


def values(spark, column, *texts):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, x string")
    return [r[0] for r in df.orderBy("i").select(column(F.col("x"))).collect()]


def test_money_never_raises(spark):
    assert values(spark, coerce.money, "$1,234.50", "abc", None, "", "-3") == [1234.5, 0.0, 0.0, 0.0, -3.0]


def test_flags_and_ids(spark):
    assert values(spark, coerce.flag, "✓", "Y", "no", None) == [True, True, False, False]
    assert values(spark, coerce.request_id, "1001.0", "12", "x", None) == [1001, 12, None, None]
    assert values(spark, coerce.yes_no, "needs review", "0", None) == ["Yes", "No", "No"]


def test_dates(spark):
    assert [str(d) for d in values(spark, coerce.parse_date, "2026-01-05", "1/5/2026", "2026-13-01", None)] == ["2026-01-05", "2026-01-05", "None", "None"]
    got = values(spark, lambda x: coerce.normal_date(x, F.lit(2025)), "01/05", "1/5/26 shop", "paid 3-4-69", "3/4/71", "2024-02-30", "none")
    assert [str(d) for d in got] == ["2025-01-05", "2026-01-05", "2069-03-04", "2025-03-04", "None", "None"]


def test_amounts(spark):
    assert values(spark, coerce.amounts, "fee (12.50) - 3.00 1,000.25 -7.00") == [[-12.5, -3.0, 1000.25, -7.0]]
    assert values(spark, lambda x: coerce.pick_amount(coerce.amounts(x)), "0.00 5.00 9.00", "0.00", "none") == [5.0, 0.0, None]
    assert values(spark, coerce.strip_amounts, "SHOP 12.00 1,300.25", "SHOP 12") == ["SHOP", "SHOP 12"]


def test_check_numbers_and_payees(spark):
    assert values(spark, coerce.check_number, "No. 00123", "000", None) == ["123", "000", ""]
    got = values(spark, lambda x: coerce.payee_of(x, F.lit("")), "POS PURCHASE CORNER MARKET #12 LOT", "check #2419", "ACH DEBIT power co 01/12", "")
    assert got == ["Corner Market", "", "power co", ""]
    got = values(spark, lambda x: coerce.payee_of(x, F.lit("")), "ZELLE PAYMENT JANE", "LOWE'S", "Paypal *harbor", "wire transfer out 01/02/26")
    assert got == ["Jane", "Lowe'S", "harbor", "out"]


def test_phrases_and_ranges(spark):
    ago = lambda x: coerce.relative_phrase(x, F.lit("2026-06-15").cast("date"))
    assert values(spark, ago, "2026-06-15", "2026-06-14", "2026-06-10", "2026-06-01", "2026-01-01", "2024-01-01", "", None, "soon") == ["today", "yesterday", "5 days ago", "2 weeks ago", "5 months ago", "2024-01-01", "\u2014", "\u2014", "soon"]
    df = spark.createDataFrame([([0, 1, 2, 4],), ([],), ([6],), ([3, 1, 0],)], "p array<int>")
    assert [r[0] for r in df.select(coerce.range_of(F.col("p"))).collect()] == ["1-3,5", "", "7", "1-2,4"]
    kept = df.select(coerce.register_pages(F.col("p"), F.lit(2), F.lit(9), F.lit(4)).alias("k")).collect()
    assert [r["k"] for r in kept] == [[0, 4], [], [6], [0]]
    assert values(spark, coerce.service_date, "2026-01-05", "1/5/2026", "01/05/26", "2026/1/5", "05 January 2026") == ["2026-01-05", "2026-01-05", "2026-01-05", "2026-01-05", "05 January"]


def test_page_ranges(spark):
    assert values(spark, coerce.pages_of, "1-3,5, 2", "x,4-2", "7") == [[1, 2, 3, 5], [], [7]]


def test_sections(spark):
    got = values(spark, predicates.section_of, "DEPOSITS", "Check Register | x", "Daily Balances", "coffee shop", "Electronic debits continued")
    assert got == ["credit", "check", "end", None, "debit"]


@pytest.mark.parametrize(("text", "clean"), [("Corner Market", True), ("Wuulu", False), ("Target", True), ("Slon8if4 co", False), ("ORDER OF 77", False), ("Xqz Brt", False), ("", False), ("PAY TO THE ORDER OF Blue Sky Books", True), ("0 Qs.90", False), ("ORDER OFE Kluuh", False), ("ORDER OF _ Wuuku", False), ("ORDER OF_ Fhq", False), ("ORDER OF [Mqssn 97", False), ("Order Of", False), ("Order Of 4Gries Dcl @E1", False), ("CRDER OK Sam QS0-0j", False), ("Order Of _ 6 3 Zhe", False), ("STATE OF WINTER", True), ("ACME Co", True), ("Costbo Wholesale", True), ("A" * 81, False)])
def test_clean_payees(spark, text, clean):
    assert values(spark, predicates.is_clean_payee, text) == [clean]


def test_page_kinds(spark):
    summary = "Beginning balance 1.00 and then ending balance 2.00 with total deposits and total withdrawals for the period"
    rows = "01/02 shop one 12.00\n01/03 shop two 13.00\n01/04 shop three 14.00 and some more words to fill"
    mixed = summary + " 01/02 shop 12.00"
    assert values(spark, predicates.page_kind, "short", summary, rows, mixed, "eight words that are on one page here now ok") == ["blank", "reconciliation", "keep", "keep", "low_information"]


def test_line_predicates(spark):
    assert values(spark, lambda x: predicates.is_ocr_junk(x), "Terminal ID 5", "MEMO rent", "a@#$%^", "12 34 56", "MERCH BNKCD DEPOSIT", "on") == [True, True, True, True, False, True]
    assert values(spark, lambda x: predicates.is_candidate(x, F.lit(None).cast("string")), "coffee 3.00", "check 1234 3.00", "Zelle 3.00", "01/02 x 3.00", "Zelle") == [False, True, True, True, False]
    assert values(spark, predicates.is_amount_line, "one hundred dollars", "Blue Sky", "12 a", "and no/100") == [True, False, True, True]
    assert values(spark, lambda x: predicates.is_rejected_payee(x, ("harbor",)), "Regions Bank", "a@b@c", "Harbor co", "Harbor Cafe Works", "") == [True, True, True, False, False]
    assert values(spark, lambda x: predicates.is_boilerplate(x, "regions"), "my regions account", "Blue Sky", "void") == [True, False, True]
    assert values(spark, lambda x: predicates.is_credit_like(x, F.lit(-1.0)), "Regular deposit", "shop") == [True, False]


def test_keyword_class(spark):
    kind, sure = predicates.keyword_class(F.lit("deposit slip total deposit cash"), ["deposit slip", "cash"], ["pay to"])
    row = spark.range(1).select(kind.alias("k"), sure.alias("s")).first()
    assert row["k"] == "deposit_slip" and abs(row["s"] - 0.8) < 1e-9
