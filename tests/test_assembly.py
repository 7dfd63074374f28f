"""Assembly and matching: the surveyed cases, and random statements against plain loops."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import assembly, matching, merging, receivables, reports, rules

ROWS = "statement_id string, ord long, check_no string, payee string, description string, amount double, source string"


def rows(spark, data):
    return spark.createDataFrame(data, ROWS)


def row(ord, amount, no="", payee="", description="", source="register", statement="s"):
    return (statement, ord, no, payee, description, amount, source)


def crop(ord, amount, no="", payee="", description="", statement="s"):
    return row(ord, amount, no, payee, description, "check_image_crop", statement)


def assembled(spark, register, checks):
    ledger, stats = assembly.assemble(rows(spark, register), rows(spark, checks))
    return ledger.collect(), stats.first()


def test_complete_register_takes_nothing(spark):
    ledger, stats = assembled(spark, [row(i, -100.0 - i) for i in range(98)], [crop(i, -500.0 - i, str(1000 + i)) for i in range(40)])
    assert len(ledger) == 98 and not stats["incomplete"] and not stats["sparse"]


@pytest.mark.parametrize(("register", "checks", "expected"), [
    ([row(i, -50.0 - i) for i in range(44)], [crop(i, -200.0 - i) for i in range(69)], {"supplemental": 69, "by_amount": 69, "skipped_by_amount": 0}),
    ([row(0, -413.63), row(1, -250.0)], [crop(0, -413.63), crop(1, -999.99)], {"supplemental": 1, "skipped_by_amount": 1}),
    ([row(0, -100.0, "1234")], [crop(0, -100.0, "1234")], {"supplemental": 0, "skipped_by_check_number": 1}),
    ([row(0, -10.0)], [crop(0, -25.0), crop(1, -30.0)], {"supplemental": 2, "sparse": True}),
    ([row(i, -100.0 - i) for i in range(44)], [crop(i, -(100.0 if i < 10 else 500.0) - i) for i in range(69)], {"supplemental": 59, "skipped_by_amount": 10, "pruned": 0}),
    ([row(i, -1000.0) for i in range(44)], [crop(0, -250.0, "1001"), crop(1, -238216.0), crop(2, -4995.71, "1002"), *(crop(3 + i, -100.0 - i) for i in range(50))], {"rejected_outliers": 1, "supplemental": 52}),
    ([row(i, -50.0) for i in range(44)], [crop(0, -6904.99, description="Regular Deposit"), crop(1, -300.0, "2001"), *(crop(2 + i, -120.0 - i) for i in range(50))], {"rejected_deposits": 1, "supplemental": 51}),
    ([row(i, -50.0) for i in range(44)], [*(crop(i, -250.0 - 3 * i, str(2000 + i)) for i in range(45)), crop(50, -52500.0), crop(51, -4995.71, "2099")], {"rejected_outliers": 1, "supplemental": 46}),
    ([row(0, -5.0, "", "", "Check 0012 paid")], [crop(0, -7.0, "12")], {"skipped_by_check_number": 1, "supplemental": 0}),
])
def test_assembly_cases(spark, register, checks, expected):
    _, stats = assembled(spark, register, checks)
    assert stats["incomplete"] and {k: stats[k] for k in expected} == expected | ({"pruned": 10} if expected.get("skipped_by_amount") == 10 else {})


def test_one_check_of_a_number(spark):
    checks = [crop(0, -280.0, "501"), crop(1, -6904.99, "501"), *(crop(2 + i, -90.0 - i) for i in range(50))]
    ledger, _ = assembled(spark, [row(i, -50.0) for i in range(44)], checks)
    assert [r["amount"] for r in ledger if r["check_no"] == "501"] == [-280.0]


def test_unmatched_register_rows_stay(spark):
    ledger, stats = assembled(spark, [row(0, 6904.99), row(1, -273.45), row(2, -500.0)], [crop(i, -150.0 - i) for i in range(50)])
    assert sum(r["source"] == "register" for r in ledger) == 3 and stats["pruned"] == 0


def test_best_of_a_crop(spark):
    data = [crop(0, -280.0, "501"), crop(1, -6904.99, "501"), crop(2, -150.0, "502"), crop(3, -1.0), crop(4, None), crop(5, -99999.0, "1"), crop(6, -3.0)]
    files = ["a", "a", "b", "", "c", "c", "c"]
    df = rows(spark, data).withColumn("crop_file", F.element_at(F.array(*map(F.lit, files)), F.col("ord").cast("int") + 1))
    assert sorted(r["ord"] for r in assembly.best_per_crop(df).collect()) == [0, 2, 3, 6]


def budget(spark, value):
    return spark.createDataFrame([("s", float(value))], "statement_id string, budget double")


def test_budget(spark):
    data = rows(spark, [crop(1, -400.0, "1001"), crop(2, -9000.0), crop(3, -8500.0), crop(4, -350.0, "1002")])
    kept = lambda b, cap=None: sorted(r["ord"] for r in assembly.budget_trim(data, budget(spark, b), cap).collect())
    assert kept(800) == [1, 4] and kept(50000) == [1, 2, 3, 4] and kept(0) == [1, 2, 3, 4] and kept(-5) == [1, 2, 3, 4]
    assert kept(4000) == [1, 2, 3, 4]  # what fits leaves more than the slack
    assert kept(800, 1) == [1, 2, 3, 4]
    fifty = rows(spark, [crop(i, -1.0) for i in range(50)])
    assert assembly.budget_trim(fifty, budget(spark, 800), 49).count() == 50


def random_statements(rng, n, numbers=6, amounts=8):
    register = [row(i, rng.choice([-1, -1, 1]) * (rng.randrange(amounts) * 0.01 + 5), rng.choice(["", str(rng.randrange(1, numbers))]), description=rng.choice(["Blue Sky Books", "Harbor Cafe", "x"]), statement=rng.choice("ab")) for i in range(n)]
    checks = [crop(i, -(rng.randrange(amounts) * 0.01 + 5), rng.choice(["", str(rng.randrange(1, numbers))]), rng.choice(["Blue Sky Book", "Harbour Cafe", ""]), statement=rng.choice("ab")) for i in range(n)]
    return register, checks


def size(x):
    return round(abs(x) * 100)


@pytest.mark.parametrize("seed", range(4))
def test_supplemental_against_a_loop(spark, seed):
    register, checks = random_statements(random.Random(seed), 40)
    expected = {}
    for s in "ab":
        left = Counter(size(r[5]) for r in register if r[0] == s and r[5] < 0)
        for c in (c for c in checks if c[0] == s):
            expected[s, c[1]] = ("supplemental", None)
            for r in (r for r in register if r[0] == s):
                if c[2] and r[2] == c[2]:
                    expected[s, c[1]] = ("check_number", r[1])
                    break
                if r[5] < 0 and abs(size(r[5]) - size(c[5])) <= 1 and left[size(r[5])] > 0:
                    left[size(r[5])] -= 1
                    expected[s, c[1]] = ("amount", r[1])
                    break
    got = {(r["statement_id"], r["ord"]): (r["decision"], r["register_ord"]) for r in assembly.supplemental(rows(spark, register), rows(spark, checks)).collect()}
    assert got == expected


@pytest.mark.parametrize("seed", range(4))
def test_matches_against_a_loop(spark, seed):
    register, checks = random_statements(random.Random(seed), 30, 40, 60)
    expected = set()
    for s in "ab":
        free = [r for r in register if r[0] == s]
        for c in (c for c in checks if c[0] == s):
            hit = next((r for r in free if c[2] and r[2] == c[2]), None)
            tier = "check_number"
            if hit is None:
                tier, hit = "amount", next((r for r in free if abs(size(r[5]) - size(c[5])) <= 1), None)
            if hit is None and c[3] and free:
                scored = [SequenceMatcher(None, c[3].lower(), r[4].lower()).ratio() for r in free]
                tier, hit = "name", free[scored.index(max(scored))] if max(scored) >= 0.6 else None
            if hit:
                free.remove(hit)
                expected.add((s, c[1], hit[1], tier))
    got = {(r["statement_id"], r["crop_ord"], r["ord"], r["tier"]) for r in matching.match_checks(rows(spark, register), rows(spark, checks)).collect()}
    assert got == expected and {t for *_, t in got} >= {"amount", "name"}


def test_tiers_and_notes(spark):
    txns = rows(spark, [row(1, -10.0, "7", description="x"), row(2, -20.0), row(3, -30.0, description="Blue Sky Books"), row(4, -40.0, "9", "Kept Name")])
    txns = txns.withColumns({"confidence": F.lit("Medium"), "needs_review": F.lit("No"), "review_reason": F.lit("OCR fallback path; low; Missing date")})
    crops = rows(spark, [crop(1, -99.0, "007", "Corner Market"), crop(2, -20.01), crop(3, None, payee="Blue Sky Book"), crop(4, -1.0, "9", "Q2x")])
    found = matching.match_checks(txns, crops)
    assert {(r["crop_ord"], r["ord"], r["tier"]) for r in found.collect()} == {(1, 1, "check_number"), (2, 2, "amount"), (3, 3, "name"), (4, 4, "check_number")}
    got = {r["ord"]: (r["payee"], r["confidence"], r["needs_review"], r["review_reason"]) for r in matching.apply_matches(txns, crops, found).collect()}
    assert got == {
        1: ("Corner Market", "High", "No", "low; Payee from check image (check# 7)"), 2: ("", "Low", "Yes", "low; Linked via amount $20.01 (no clean payee from image)"),
        3: ("Blue Sky Book", "High", "No", "low; Payee from check image (fuzzy desc match (0.96))"), 4: ("Kept Name", "Low", "Yes", "low; Linked via check# 9 (no clean payee from image)"),
    }


@pytest.mark.parametrize("seed", range(4))
def test_payees_against_a_loop(spark, seed):
    rng = random.Random(seed)
    register, checks = random_statements(rng, 30, 8)
    register = [(*r[:3], rng.choice(["", "Set", "uncategorized"]), *r[4:]) for r in register]
    expected = {}
    for s in "ab":
        mine, used = [c for c in checks if c[0] == s], set()
        numbers = {c[2]: c for c in mine if c[2]}
        for r in (r for r in register if r[0] == s):
            if r[2] and r[2] in numbers:
                c = numbers[r[2]]
                c = None if c[1] in used else c
            else:
                c = next((c for c in mine if c[1] not in used and abs(size(c[5]) - size(r[5])) <= 1), None)
            fill = c is not None and c[3] and r[3] in ("", "uncategorized")
            if fill:
                used.add(c[1])
            expected[s, r[1]] = (c[3], "check_image_crop") if fill else (r[3], "register")
    given = rows(spark, checks).select("statement_id", "ord", "check_no", F.col("payee").alias("pay_to"), "amount")
    got = {(r["statement_id"], r["ord"]): (r["payee"], r["source"]) for r in assembly.merge_payees(rows(spark, register), given).collect()}
    assert got == expected


def test_deposits_and_names_stay_apart(spark):
    data = [row(0, 273.45, description="Deposit misc"), crop(1, -273.45, description="Vendor"), crop(2, -150.0, description="Payee One"), crop(3, -150.0, description="Payee Two"), crop(4, -150.0, description="payee one")]
    assert sorted(r["ord"] for r in assembly.assembly_dedupe(rows(spark, data)).collect()) == [0, 1, 2, 3]


def test_reference_and_confidence(spark):
    kind = "statement_id string, deposits double, withdrawals double, checks int, transactions int"
    reported = spark.createDataFrame([("a", 1.0, None, None, None), ("b", None, None, None, None)], kind)
    summary = spark.createDataFrame([("a", 9.0, 9.0, 9), ("b", 2.0, 3.0, 49), ("c", None, None, None)], "statement_id string, deposits double, withdrawals double, withdrawals_count int")
    got = {r["statement_id"]: tuple(r)[1:] for r in reports.reference_totals(reported, summary).collect()}
    assert got == {"a": (1.0, None, None, None), "b": (2.0, 3.0, 49, None)}
    df = spark.createDataFrame([("High",), ("Low",), ("",), (None,), ("Medium",)], "confidence string")
    assert [reports.by_confidence(df, k).count() for k in ("High", "Show All", "", "Medium")] == [5, 5, 5, 2]


def test_rules_bootstrap(spark):
    kind = "pattern string, clean_payee string, suggested_category string, client_override string, last_used string"
    seed = spark.createDataFrame([("wal-mart", "Walmart", "Supplies", "", ""), ("payroll", "Payroll Run", "", "", "")], kind)
    ledger = spark.createDataFrame([("POS PURCHASE WAL-MART STORE #1234", "", "Uncategorized"), ("ACH DEBIT PAYROLL", "ACH DEBIT PAYROLL", "Own"), ("other", "", "")], "description string, payee string, category string")
    assert rules.bootstrap(None, seed) is seed and rules.bootstrap(seed.limit(0), seed) is seed
    out, used = rules.post_process(ledger, None, seed, day="2026-06-15")
    assert [(r["payee"], r["category"]) for r in out.collect()] == [("Walmart", "Supplies"), ("Payroll Run", "Own"), ("", "")]
    assert {r["pattern"]: r["last_used"] for r in used.collect()} == {"wal-mart": "2026-06-15", "payroll": "2026-06-15"}
    assert rules.match_count(ledger, "re:wal.mart") == 1 and rules.match_count(ledger, " ") == 0


def test_upserts_count_and_skip(spark):
    have = spark.createDataFrame([(1, "A", "old", True), (2, "B", "old", False)], "client_id int, business_name string, status string, is_deleted boolean")
    merged, n, ids = merging.upsert_clients(have, spark.createDataFrame([("A", "new"), ("C", "x"), ("D", "")], "business_name string, status string"))
    assert n.first()[:] == (2, 1) and {(r["business_name"], r["client_id"]) for r in ids.collect()} == {("A", 1), ("B", 2), ("C", 3), ("D", 4)}
    assert {r["business_name"]: (r["status"], r["is_deleted"]) for r in merged.collect()} == {"A": ("new", False), "B": ("old", False), "C": ("x", False), "D": (None, False)}
    requests = spark.createDataFrame([(10, 1, "Pending")], "request_id int, client_id int, status string")
    new = spark.createDataFrame([(10, "B", "Paid"), (11, "A", "Paid"), (None, "A", "x"), (12, "nobody", "x")], "request_id int, business_name string, status string")
    out, skipped = merging.upsert_requests(requests, new, have)
    assert {tuple(r) for r in out.select("request_id", "client_id", "status", "change").collect()} == {(10, 2, "Paid", "updated"), (11, 1, "Paid", "created")}
    assert {(r["business_name"], r["reason"]) for r in skipped.collect()} == {("A", "invalid request id"), ("nobody", "unknown client")}


def test_default_filters(spark):
    df = spark.createDataFrame([("Pending", "Rent", "2026-01-05"), ("Paid", "Tax", "2026-02-05")], "status string, request_type string, due_date string")
    whole = receivables.Filters(start="2026-01-05", end="2026-02-05", statuses=["Pending", "Received", "Invoiced", "Paid"], types=["Rent", "Tax", "Payroll", "Tax prep"])
    assert receivables.is_default(whole, df) and not receivables.is_default(whole, df, "Other")
    assert not receivables.is_default(receivables.Filters("overdue"), df)


def test_small_operators(spark, tmp_path):
    from tallyforge.functions import coerce
    from tallyforge.operators import crops
    from tallyforge.sources import sinks, tables

    checks = rows(spark, [crop(1, -5.0, "1", "A"), crop(2, -5.001, "1", "a "), crop(3, None), crop(4, None), crop(5, -5.0, "01", "A")]).withColumn("pay_to", F.col("payee"))
    assert sorted(r["ord"] for r in assembly.dedupe_check_dicts(checks).collect()) == [1, 3, 4, 5]
    graded = spark.createDataFrame([("W1", "Real", "c", "p"), ("wrong", "", "c", "p"), ("ok", "x", "", "p")], "grade string, notes string, candidate string, payee string")
    assert [r["truth"] for r in crops.human_truth(graded).collect()] == ["Real", "c", "p"]
    df = spark.createDataFrame([(1234.5, "12.0"), (None, "x")], "a double, n string")
    assert [tuple(r) for r in df.select(coerce.money_text(F.col("a")), coerce.request_label(F.col("n"), F.lit("Acme"))).collect()] == [("$1,234", "12 \u2013 Acme"), ("", "x \u2013 Acme")]
    assert merging.stamped(df, " ", F.lit("2026-01-01")).first()["updated_by"] == "system"
    ledger = spark.createDataFrame([("2026-01-05", "7", "c1"), ("2026-01-06", "", None)], "Date string, `Check#` string, linked_check_id string")
    whole = tables.canonical(ledger).withColumn("linked_check_id", F.when(F.col("`Check#`") != "", "c1"))
    sinks.export_run(whole, str(tmp_path / "run"))
    assert tables.baseline(spark, str(tmp_path / "run" / "transactions_all")).count() == 2 and tables.baseline(spark, str(tmp_path / "run" / "transactions_checks")).first()["linked_check_id"] == "c1"
    sinks.write_evidence(spark.createDataFrame([("p", "acct 1234567890")], "pdf string, note string"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).first()["note"] == "acct [acct]"
    sinks.export_deposits(spark.createDataFrame([("c", 1, "deposit_slip", "t"), ("d", 1, "check", "t")], "crop_id string, page int, class string, text string"), str(tmp_path / "d"))
    assert spark.read.json(str(tmp_path / "d")).first()["crop_id"] == "c"
    (tmp_path / "j").mkdir()
    (tmp_path / "j" / "1.json").write_text('{"crop_id": "c", "raw_text": "x"}\n{"crop_id": "z", "raw_text": "y"}')
    (tmp_path / "s.csv").write_text("crop_id,payee,reason\nc,Old,ranked\n")
    assert {r["crop_id"]: r["old_payee"] for r in tables.rescored(spark, str(tmp_path / "j"), str(tmp_path / "s.csv")).collect()} == {"c": "Old", "z": None}
    assert tables.latest_file(str(tmp_path / "j"), "*.json").name == "1.json" and tables.latest_file(str(tmp_path / "none")) is None
    assert reports.row_counts({"a": df}) == {"a": 2}
