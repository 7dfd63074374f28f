import json
import random

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import lines, payees

STATEMENT = """STATEMENT PERIOD 01/01/2026 - 01/31/2026
Deposits and Other Credits 1,500.00 +
3 Withdrawals and Other Debits 350.25 -
DEPOSITS
01/05/2026 Regular deposit 1,000.00
01/09/2026 Cash 500.00
ELECTRONIC DEBITS
01/12/2026 Ach withdrawal
UTILITY CO 50.25
CHECK REGISTER
2419 01/20 100.00
* 2491 * 01/14 200.00
DAILY BALANCES
01/31 1,149.75"""


def statement(spark, text, key="s"):
    return spark.createDataFrame([(key, i, t) for i, t in enumerate(text.split("\n"))], "statement_id string, line_no int, text string")


def test_lines_to_transactions(spark):
    got = [(str(r["date"]), r["description"], r["amount"], r["check_no"], r["section"]) for r in lines.parse_lines(statement(spark, STATEMENT), F.lit(2026)).orderBy("ord").collect()]
    assert got == [
        ("2026-01-05", "Regular deposit", 1000.0, "", "credit"), ("2026-01-09", "Cash", 500.0, "", "credit"), ("2026-01-12", "Ach withdrawal UTILITY CO", -50.25, "", "debit"),
        ("2026-01-20", "Check #2419", -100.0, "2419", "check"), ("2026-01-14", "Check #2491", -200.0, "2491", "check"),
    ]


def test_lines_wait_and_flush(spark):
    text = "Zelle from Ann\n01/02/2026 coffee\nDEPOSITS\nlate words\n01/03 | Harbor Cafe | 12.00 | 900.00\nplain 7.00"
    got = [(str(r["date"]), r["description"], r["amount"], r["confidence"], r["review_reason"]) for r in lines.parse_lines(statement(spark, text), F.lit(2026)).orderBy("ord").collect()]
    assert got == [
        ("None", "Zelle from Ann", None, "Medium", "Missing date; Missing amount; Missing date; Missing amount"), ("2026-01-03", "Harbor Cafe", 12.0, "High", ""), ("2026-01-03", "plain", 7.0, "High", ""),
    ] or got == [
        ("None", "Zelle from Ann", None, "Medium", "Missing date; Missing amount; Missing date; Missing amount"), ("2026-01-02", "late words", None, "Medium", "Missing amount; Missing amount"),
        ("2026-01-03", "Harbor Cafe", 12.0, "High", ""), ("2026-01-03", "plain", 7.0, "High", ""),
    ]


def test_scan(spark):
    text = """DEPOSITS
01/16/2026 1 , 177. 0O
Regular Deposit
01/20/2026 Ach deposit 499.22
MERCH BNKCD NSD DEPOSIT
second line that continues
third line is too many
MEMO 123
01/21/2026 no amount follows
ELECTRONIC DEBITS
Ach withdrawal 34.65
01/12/2026
01/07/2026 EFTIACH payment
30.52 PAYPAL XFER
99.99
CHECK REGISTER
01/08 905.80 01/22 2505 340.97
2488
Denotes missing check
SUMMARY OF FEES
01/30/2026 After the end 5.00"""
    got = [(str(r["date"]), r["description"], r["amount"], r["check_no"], r["confidence"], r["needs_review"]) for r in lines.parse_scan(statement(spark, text), F.lit(2026)).orderBy("ord").collect()]
    assert got == [
        ("2026-01-16", "Regular Deposit", 1177.0, "", "Medium", "Yes"), ("2026-01-20", "Ach deposit MERCH BNKCD NSD DEPOSIT second line that continues", 499.22, "", "Medium", "Yes"),
        ("2026-01-12", "Ach withdrawal", -34.65, "", "Medium", "Yes"), ("2026-01-07", "EFT/ACH payment PAYPAL XFER", -30.52, "", "Medium", "Yes"),
        ("2026-01-08", "Check #2488", -905.8, "2488", "Medium", "Yes"), ("2026-01-22", "Check #2505", -340.97, "2505", "Medium", "Yes"),
    ]


def test_choice(spark):
    few, many = lines.parse_lines(statement(spark, "DEPOSITS\n01/02 cash deposit 1.00\n01/03 Total fees 3.00", "few"), F.lit(2026)), lines.parse_lines(statement(spark, "DEPOSITS\n01/02 aa 1.00\n01/03 bb 2.00\n01/04 cc 3.00", "many"), F.lit(2026))
    scan = lines.parse_scan(statement(spark, "DEPOSITS\n01/05/2026 more cash 9.00", "few").union(statement(spark, "DEPOSITS\n01/05/2026 more cash 9.00", "many")), F.lit(2026))
    got = sorted((r["statement_id"], r["amount"]) for r in lines.choose(few.union(many), scan).collect())
    assert got == [("few", 1.0), ("few", 9.0), ("many", 1.0), ("many", 2.0), ("many", 3.0)]


def fused_by_hand(texts):
    import re

    out, i = [], 0
    texts = [t.strip() for t in texts if t.strip()]
    date, verb, amount = r"^(\d\d/\d\d/\d{4})", r"(?i)\b(ach|debit|paypal|check)\b", r"\d+\.\d\d"
    while i < len(texts):
        a, b = texts[i], texts[i + 1] if i + 1 < len(texts) else ""
        alone = lambda x: re.fullmatch(r"\d\d/\d\d/\d{4}", x)
        row = lambda x: not re.match(date, x) and re.search(amount, x) and re.search(verb, x)
        if alone(b) and row(a):
            out.append(f"{b} {a}")
        elif alone(a) and b and row(b):
            out.append(f"{a} {b}")
        elif re.match(date, b) and re.search(amount, b) and not re.match(date, a) and not re.search(amount, a) and re.search(verb, a) and len(a.split()) <= 4 and not re.search(verb, b[10:]):
            out.append(f"{b[:10]} {a} {b[10:].strip()}")
        else:
            out.append(a)
            i -= 1
        i += 2
    return out


def test_split_dates_against_a_walk(spark):
    rng = random.Random(4)
    made = ["01/02/2026", "Ach withdrawal 3.00", "Paypal payment", "01/03/2026 7.00", "01/04/2026 check 8.00", "plain words", "Debit card 9.00", " "]
    texts = {f"s{k}": [rng.choice(made) for _ in range(40)] for k in range(12)}
    rows = [(k, i, t) for k, ts in texts.items() for i, t in enumerate(ts)]
    got = {}
    for r in lines.fuse_split_dates(spark.createDataFrame(rows, "statement_id string, line_no int, text string")).orderBy("statement_id", "line_no").collect():
        got.setdefault(r["statement_id"], []).append(r["text"])
    assert got == {k: fused_by_hand(ts) for k, ts in texts.items()}


def test_orphans(spark):
    spliced = [r["text"] for r in lines.splice_orphan_numbers(statement(spark, "01/05 100.00\n2419\nend\n01/08 905.80 01/22 2505 340.97\n2488\n01/09 1.00\n24\n01/10 2 3.00\n2500")).orderBy("line_no").collect()]
    assert spliced == ["01/05 2419 100.00", "end", "01/08 2488 905.80 01/22 2505 340.97", "01/09 1.00", "24", "01/10 2 3.00", "2500"]


def test_summary_and_year(spark):
    got = lines.statement_summary(statement(spark, STATEMENT)).first()
    assert (got["deposits"], got["withdrawals"], got["withdrawals_count"], got["deposits_count"]) == (1500.0, 350.25, 3, None)
    year = lambda text: lines.statement_year(statement(spark, text), 1999).first()["year"]
    assert [year(t) for t in (STATEMENT, "printed 2022\non May 3, 2023", "x" * 9000 + " 2024", "in 2020", "statement period\n2031 to 2032")] == [2026, 2023, 1999, 2020, 2031]


@pytest.mark.parametrize(("cells", "expected"), [
    ([["Date", "Description", "Amount"], ["01/05", "Shop", "12.00"]], ("2026-01-05", "Shop", 12.0, "")),
    ([["x"], ["02/03", "Cafe", "(4.00)"]], ("2026-02-03", "Cafe", -4.0, "")),
    ([["Checks paid"], ["2419", "01/05", "7.00"]], ("2026-01-05", "Check #2419", -7.0, "2419")),
    ([["Checks paid"], ["01/05", "2419", "7.00", "Harbor Cafe"]], ("2026-01-05", "Harbor Cafe", -7.0, "2419")),
    ([["Other debits"], ["01/05", "Harbor", "Cafe", "7.00", "900.00"]], ("2026-01-05", "Harbor Cafe", -7.0, "")),
    ([["Other debits"], ["Date", "Check Number", "Debit", "Who"], ["01/05", "2419", "7.00", "Harbor Cafe"]], ("2026-01-05", "Harbor Cafe", -7.0, "2419")),
    ([["Daily balances"], ["01/05", "Shop", "12.00"]], None),
])
def test_tables(spark, cells, expected):
    df = spark.createDataFrame([("s", 0, i, c) for i, c in enumerate(cells)], "statement_id string, table_no int, row_no int, cells array<string>")
    got = [(str(r["date"]), r["description"], r["amount"], r["check_no"]) for r in lines.parse_tables(df, F.lit(2026)).collect()]
    assert got == ([expected] if expected else [])


CROP = "crop_id string, idx int, text string, confidence double, y double"


def crop(spark, *texts):
    return spark.createDataFrame([("c", i, t, 0.9, 0.3) for i, t in enumerate(texts)], CROP)


def test_payee_of_crop(spark):
    one = lambda *texts, **k: payees.extract(crop(spark, *texts), payees.Profile(**k)).first()[1:5:3] or None
    assert one("SUNRISE HOLDINGS LLC", "PAY TO THE ORDER OF", "Blue Sky Books", "one hundred dollars") == ("SUNRISE HOLDINGS LLC", "scan")
    assert one("SUNRISE HOLDINGS LLC", "PAY TO THE ORDER OF", "Blue Sky Books", "one hundred dollars", payer_by_form=True) == ("Blue Sky Books", "next_line")
    assert one("Pay to the order of Harbor Cafe", "Blue Sky Books") in (("Harbor Cafe", "same_line"), ("Blue Sky Books", "next_line"))
    assert one("12.00", "void") == ("", "no_clean_candidate") and one("pay to", "12.00") == ("", "anchor_no_clean_candidate")
    assert one("Corner Market") == ("Corner Market", "first_clean")
    assert one("order of", "1", "2", "3", "4", "Corner Market", whole_crop=False) == ("", "anchor_no_clean_candidate")
    assert one("order of", "1", "2", "3", "4", "Corner Market", whole_crop=False, first_in_order=True) == ("Corner Market", "first_clean")
    signed = ("Corner Market Supply", "order of", "Authorized signature", "Ann Harbor")
    assert one(*signed, after_signature=40.0) == ("Ann Harbor", "next_line") and one(*signed, payer_words=("corner",)) == ("Ann Harbor", "next_line")


def test_legacy_payees(spark):
    one = lambda *texts: payees.extract(crop(spark, *texts), payees.Profile(legacy=True)).first()[1:5:3]
    assert one("pay to the order of Harbor Cafe") == ("Harbor Cafe", "same_line")
    assert one("order of", "12.00", "Corner Market") == ("Corner Market", "next_line")
    assert one("order of", "1", "2", "3", "Corner Market") == ("", "anchor_no_clean_candidate")
    assert one("12", "Corner Market") == ("Corner Market", "first_clean") and one("12") == ("", "no_clean_candidate")


def test_profiles(spark, tmp_path):
    (tmp_path / "harbor.json").write_text(json.dumps({"bank": "harbor", "after": 5, "anchors": ["to the"], "signature_pairs": [["a", "b"]]}))
    found = payees.Profile.load(str(tmp_path), "Harbor")
    assert (found.bank, found.after, found.anchors, found.signature_pairs, found.denied_bank) == ("harbor", 5, ("to the",), (("a", "b"),), "harbor")
    assert payees.Profile.load(str(tmp_path), "other") == payees.Profile()
    with pytest.raises(ValueError):
        payees.Profile.of({"nothing": 1})


def test_enriched_crops(spark):
    box = lambda y: [1.0, y, 9.0, y, 9.0, y + 5, 1.0, y + 5]
    made = [("a", 0, "PAY TO THE ORDER OF", 0.9, box(1.0)), ("a", 1, "Harbr Cafe", 0.8, box(20.0)), ("a", 2, "No 2419", 0.9, box(40.0)), ("b", 0, "deposit slip currency", 0.9, box(1.0)), ("z", 0, "PAY TO THE ORDER OF Blue Sky", 0.9, box(1.0))]
    texts = spark.createDataFrame(made, "crop_id string, idx int, text string, confidence double, bbox array<double>")
    crops = spark.createDataFrame([("a", 5), ("b", 5), ("z", 1)], "crop_id string, page int")
    rules = spark.createDataFrame([("harbr", "Harbor Cafe", "", "", 1)], "pattern string, payee string, client_override string, bank string, ord int")
    got = {r["crop_id"]: (r["extracted_payee"], r["extracted_check_no"], r["notes"]) for r in payees.enrich_crops(crops, texts, rules, first=5, last=9).collect()}
    assert got == {"a": ("Harbor Cafe", "2419", "hybrid"), "b": (None, None, None), "z": (None, None, None)}


def test_bank_and_number(spark):
    rows = spark.createDataFrame([("Acme  Co", ""), ("", "first bank routing"), ("", ""), ("Acme co", "second bank first bank routing")], "client string, text string")
    found = payees.detect_bank(rows, {"acme co": "one"}, [("first bank", "first"), ("second bank", "second"), ("routing", "first")])
    assert [(r["bank"], round(r["bank_confidence"], 2)) for r in found.collect()] == [("one", 0.95), ("first", 0.95), ("generic", 0.0), ("first", 0.98)]
    boxes = spark.createDataFrame([("c", 0, "No 1234", [90.0, 1.0, 99.0, 1.0, 99.0, 5.0, 90.0, 5.0]), ("c", 1, "9999", [1.0, 50.0, 9.0, 50.0, 9.0, 55.0, 1.0, 55.0])], "crop_id string, idx int, text string, bbox array<double>")
    assert payees.guess_check_number(boxes).first()["check_no"] == "9999"
    tokens = spark.createDataFrame([("c", 0, "1234", [90.0, 99.0], [1.0, 5.0]), ("c", 1, "9999", [1.0, 9.0], [50.0, 55.0]), ("c", 2, "$ 1,200.50", [60.0, 70.0], [40.0, 45.0])], "crop_id string, idx int, text string, xs array<double>, ys array<double>")
    assert payees.check_fields(tokens).first()[1:] == ("1234", 1200.5)


def test_tables_share_sorts_and_spread_by_their_rows(spark, monkeypatch):
    from tallyforge.operators import sequence

    monkeypatch.setattr(sequence, "ROWS_A_TASK", 2)
    rows = [(s, t, r, c) for s in "ab" for t in (1, 2) for r, c in enumerate([["Other debits"], ["Date", "Check", "Amount", "Description"], ["01/05", "2419", "10.25", "Cafe"]])]
    found = lines.parse_tables(spark.createDataFrame(rows, "statement_id string, table_no int, row_no int, cells array<string>"), F.lit(2026))
    assert found.rdd.getNumPartitions() == 6 and sorted(r["amount"] for r in found.collect()) == [-10.25] * 4
    assert found._jdf.queryExecution().sparkPlan().toString().count("Window [") <= 3


def test_crops_are_read_once_for_their_rules(spark, monkeypatch):
    seen, extract = spark.sparkContext.accumulator(0), payees.extract
    told = F.udf(lambda x: (seen.add(1), x)[1], "string").asNondeterministic()
    monkeypatch.setattr(payees, "extract", lambda rows, profile: extract(rows, profile).withColumn("payee", told("payee")))
    rows = spark.createDataFrame([(str(i), 0, "Pay to the order of Blue Sky Books", 0.9, 0.3) for i in range(5)], "crop_id string, idx int, text string, confidence double, y double")
    known = spark.createDataFrame([("blue", "Blue Sky", "", "", 1)], "pattern string, payee string, client_override string, bank string, ord int")
    assert [r["payee"] for r in payees.extract_with_rules(rows, known).collect()] == ["Blue Sky"] * 5 and seen.value == 5


def test_scans_are_read_once_and_spread_by_their_rows(spark, monkeypatch):
    from tallyforge.operators import sequence

    monkeypatch.setattr(sequence, "ROWS_A_TASK", 2)
    said = ["DEPOSITS", "01/05/2026 Regular deposit 1O.25", "STORE FRONT", " ", "Checks paid", "01/06 2419 12.00 01/07 2420 13.00", "Page 1 of 3"]
    text = spark.createDataFrame([(s, i, x) for s in "abc" for i, x in enumerate(said)], "statement_id string, line_no int, text string")
    found = lines.parse_scan(text, F.lit(2026))
    plan = found._jdf.queryExecution().sparkPlan().toString()
    assert plan.count("MapInArrow") == 1 and "Union" not in plan and plan.count("REPARTITION_BY_NUM") == 1 and "REPARTITION_BY_COL" not in plan
    assert "hashpartitioning(statement_id#" in plan and ", 9)" in plan  # 18 lines that are not blank
    got = sorted((r["statement_id"], r["ord"], r["description"], r["amount"], r["check_no"]) for r in found.collect())
    assert got == [(s, *r) for s in "abc" for r in ((1, "Regular deposit STORE FRONT", 10.25, ""), (2, "Check #2419", -12.0, "2419"), (3, "Check #2420", -13.0, "2420"))]


def test_text_lines_are_read_once(spark):
    said = ["DEPOSITS", "01/05/2026 | Harbor Cafe deposit | 10.25", "ELECTRONIC DEBITS", "01/06 Ach withdrawal", "UTILITY 12.00", "Page 1 of 3", "Checks paid", "2419 01/07 13.00", "memo"]
    text = spark.createDataFrame([("a", i, x) for i, x in enumerate(said)], "statement_id string, line_no int, text string")
    found = lines.parse_lines(text, F.lit(2026))
    assert "Union" not in found._jdf.queryExecution().sparkPlan().toString()
    got = [(str(r["date"]), r["description"], r["amount"], r["check_no"], r["section"]) for r in found.orderBy("ord").collect()]
    assert got == [("2026-01-05", "Harbor Cafe deposit", 10.25, "", "credit"), ("2026-01-06", "Ach withdrawal UTILITY", -12.0, "", "debit"), ("2026-01-07", "Check #2419", -13.0, "2419", "check")]
