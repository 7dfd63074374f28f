import json

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import assembly, lines, merging, reports, rules
from tallyforge.sources import sinks, tables
from tallyforge.streaming import evidence

CHECKS = "statement_id string, ord long, check_no string, payee string, description string, amount double, source string"


def rows(spark, data, schema=CHECKS):
    return spark.createDataFrame(data, schema)


def check(ord, no, amount, payee="", source="check_image_crop", description=""):
    return ("s", ord, no, payee, description, amount, source)


def ords(df):
    return sorted(r["ord"] for r in df.collect())


def test_cap_and_fence(spark):
    data = [check(i, "", -100.0 - i) for i in range(47)] + [check(100, "", -52500.0), check(101, "", -9000.0), check(102, "77", -9000.0), check(103, "", 0.0)]
    assert ords(assembly.drop_outliers(rows(spark, data))) == [*range(47), 102]


def test_exclusive_quartiles(spark):
    df = spark.sql("select array(10d, 20d, 30d, 45d, 100d) as v")
    assert df.select(assembly.exclusive_quartile(F.col("v"), 1), assembly.exclusive_quartile(F.col("v"), 3)).first()[:] == (15.0, 72.5)


def test_median_pick_and_dedupe(spark):
    data = [check(1, "5", -100.0), check(2, "0005", -9000.0), check(3, "6", -120.0), check(4, "", -110.0)]
    assert ords(assembly.median_pick(rows(spark, data))) == [1, 3, 4]
    twice = [check(1, "", -10.0, "A"), check(2, "", -10.0, "a "), check(3, "", None), check(4, "", None)]
    assert ords(assembly.dedupe_checks(rows(spark, twice))) == [1, 3, 4]


def test_assembly_dedupe_keeps_deposits(spark):
    data = [check(1, "", 50.0, source="register"), check(2, "", -50.0), check(3, "", -70.0, source="register"), check(4, "", -70.01), check(5, "9", -5.0), check(6, "09", -5.0)]
    assert ords(assembly.assembly_dedupe(rows(spark, data))) == [1, 2, 3, 5]


@pytest.mark.parametrize(("register", "checks", "expected"), [
    ([check(i, "", -1000.0 - i, source="register") for i in range(44)], [check(i, "", -(i + 1) * 3.0) for i in range(69)], 69),
    ([check(1, "12", -5.0, source="register")], [check(1, "0012", -7.0)], 0),
    ([check(1, "", -5.0, source="register"), check(2, "", -8.0, source="register")], [check(1, "", -5.0), check(2, "", -5.0)], 1),
    ([check(1, "", 5.0, source="register")], [check(1, "", -5.0)], 1),
])
def test_supplemental(spark, register, checks, expected):
    found = assembly.supplemental(rows(spark, register), rows(spark, checks))
    assert found.filter("decision = 'supplemental'").count() == expected


def test_rules_precedence(spark):
    ledger = spark.createDataFrame([("ACME PAY 1", "", ""), ("COFFEE", "COFFEE", "uncategorized"), ("bad [", "Set", "Own")], "description string, payee string, category string")
    known = [rules.Rule("acme", "Acme", "", "", 1), rules.Rule("acme pay", "Acme Payroll", "Wages", "", 2), rules.Rule("acme", "Client Acme", "", "c1", 3), rules.Rule("re:cof+ee", "Cafe", "Food", "", 4), rules.Rule("re:[", "Never", "Never", "", 5)]
    got = [(r["payee"], r["category"]) for r in rules.apply_rules(ledger, known, "C1").collect()]
    assert got == [("Client Acme", "Wages"), ("Cafe", "Food"), ("Set", "Own")]


def test_check_rules(spark):
    checks = spark.createDataFrame([(1, "pay blue sky", "Big Client LLC", "b1")], "id int, text string, client string, bank string")
    known = spark.createDataFrame([("blue", "Blue", "", "", 1), ("blue sky", "Blue Sky", "client", "", 2), ("re:blue.*y$", "Wrong bank", "", "b2", 3)], "pattern string, payee string, client_override string, bank string, ord int")
    assert rules.best_check_rule(checks, known, ["id"]).first()["payee"] == "Blue Sky"


def test_words(spark):
    words = spark.createDataFrame([(1, 5.0, 10.0, "b"), (1, 1.0, 9.0, "a"), (1, 1.0, 40.0, "c")], "page int, x double, y double, text string")
    assert sorted(r["text"] for r in lines.assemble_words(words, 20.0).collect()) == ["a b", "c"]


def test_reconcile(spark):
    kind = "statement_id string, deposits double, withdrawals double, checks int, transactions int"
    computed = spark.createDataFrame([(k, 10.0, 5.0, 1, 2) for k in "abcd"], kind)
    reported = spark.createDataFrame([("a", 10.01, 5.0, 1, 2), ("b", 10.02, None, None, 3), ("c", None, None, None, None)], kind)
    got = {r["statement_id"]: (r["status"], r["differences"]) for r in reports.reconcile(computed, reported).collect()}
    assert got == {"a": ("match", ""), "b": ("mismatch", "deposits,transactions"), "c": ("no_reference", ""), "d": ("no_reference", "")}


def test_updates(spark):
    master = spark.createDataFrame([(1, "a", True), (2, "b", False)], "id int, name string, is_deleted boolean")
    merged, unknown = merging.update(master, spark.createDataFrame([(2, "B"), (9, "x")], "id int, name string"), "id")
    assert {tuple(r) for r in merged.collect()} == {(1, "a", True), (2, "B", False)} and unknown.count() == 1
    up = merging.upsert(master, spark.createDataFrame([(1, ""), (3, "c")], "id int, name string"), ["id"], revive="is_deleted")
    assert {(r["id"], r["name"], r["is_deleted"], r["change"]) for r in up.collect()} == {(1, "a", False, "updated"), (2, "b", False, "kept"), (3, "c", False, "created")}


def test_pasted_ledger(spark):
    text = "```\nDate,Description,Payee,Amount,SignedAmount,Check#,Category,SubCategory,YearMonth,Confidence,NeedsReview,ReviewReason\n2026-01-05,Shop,,$5.00,,,,,,medium,,\n2026-01-06,Long,,1,1,,,,,,,,extra\n2026-01-07,Short,,7\nTOTALS: deposits=1,500.00 withdrawals=350.25 checks=2 transactions=5\n```"
    pasted = spark.createDataFrame(list(enumerate(text.split("\n"))), "line_no int, value string")
    got = [(r["Description"], r["SignedAmount"], r["YearMonth"], r["Confidence"], r["NeedsReview"], r["Category"]) for r in tables.pasted_ledger(pasted).orderBy("Date").collect()]
    assert got == [("Shop", 5.0, "2026-01", "Medium", "Yes", "Uncategorized"), ("Short", 7.0, "2026-01", "High", "No", "Uncategorized")]
    assert tables.pasted_totals(pasted).first()[:] == (1500.0, 350.25, 2, 5)


def test_service_responses(spark):
    leaf = lambda v: {"valueNumber": v, "confidence": 0.95}
    t = {"valueObject": {"Date": {"valueDate": "2026-01-05"}, "Description": {"valueString": "Shop"}, "DepositAmount": leaf(5.0), "WithdrawalAmount": leaf(5.0)}}
    response = {"documents": [{"fields": {"Accounts": {"valueArray": [{"valueObject": {"Transactions": {"valueArray": [t]}}}]}, "PayTo": {"content": "Blue"}, "NumberAmount": leaf(9.0)}}]}
    df = spark.createDataFrame([("s", json.dumps(response))], "statement_id string, json string")
    row = tables.statement_response(df).first()
    assert (row["amount"], row["confidence"], str(row["date"])) == (5.0, "High", "2026-01-05")
    assert [(r["description"], r["amount"]) for r in tables.checks_to_rows(tables.check_response(df)).collect()] == [("Blue", -9.0)]


def test_evidence_stream(spark, tmp_path):
    made = [(1, 'SMOKE_EVIDENCE pdf="a" json={"smoke_key": "k", "rows": 1}'), (2, 'SMOKE_EVIDENCE pdf="a" json={"smoke_key": "k", "rows": 2}'), (3, "noise"), (4, 'SMOKE_EVIDENCE pdf="a" json={bad')]
    batch = spark.createDataFrame(made, "line_no long, value string")
    assert [(r["smoke_key"], r["rows"]) for r in tables.latest_evidence(batch).collect()] == [("k", 2)]
    batch.write.json(str(tmp_path / "log"))
    q = evidence.start(evidence.latest(evidence.log_lines(spark, str(tmp_path / "log"))), "latest_evidence", str(tmp_path / "state"))
    q.processAllAvailable()
    q.stop()
    assert [(r["smoke_key"], r["rows"]) for r in spark.table("latest_evidence").collect()] == [("k", 2)]


def test_versions(spark, tmp_path):
    root = str(tmp_path / "t")
    for n in range(7):
        sinks.save_version(spark.range(n), root)
    assert sinks.current(spark, root).count() == 6
    assert sinks.undo(spark, root).count() == 5


def test_csv_sources(spark, tmp_path):
    (tmp_path / "c.csv").write_text("business_name,ein\nJoe's Grill,1\n ,2\nBarn Works,3\n")
    got = {r["business_name"]: r["industry_category"] for r in tables.clients_csv(spark, str(tmp_path / "c.csv")).collect()}
    assert got == {"Joe's Grill": "Restaurant/Bar", "Barn Works": "Restaurant/Bar"}
    (tmp_path / "r.csv").write_text("request_id,business_name,amount_due,due_date,bank_statement_received\n1001.0,A,abc,1/2/2026,✓\n")
    row = tables.requests_csv(spark, str(tmp_path / "r.csv")).first()
    assert (row["request_id"], row["amount_due"], str(row["due_date"]), row["bank_statement_received"], row["status"]) == ("1001", 0.0, "2026-01-02", True, "")
