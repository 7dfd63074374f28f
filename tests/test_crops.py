from pyspark.sql import functions as F

from tallyforge.functions import repair
from tallyforge.operators import crops


def one(spark, column, text):
    return spark.createDataFrame([(text,)], "x string").select(column(F.col("x"))).first()[0]


def test_repairs(spark):
    assert one(spark, repair.fix_money, "EFTIACH Debit 1 , Ooo. 00 to Oslo") == "EFT/ACH Debit 1,000.00 to Oslo"
    assert one(spark, repair.fix_money, "Pay TO the order") == "Pay TO the order"
    assert one(spark, repair.suggest_pattern, "POS PURCHASE CORNER MARKET #1234 TX") == "CORNER MARKET"
    assert one(spark, repair.suggest_pattern, "CHECK CARD PURCHASE HP STORE") == "HP STORE"
    assert one(spark, repair.suggest_pattern, "CHECK 2473") == "CHECK" and one(spark, repair.suggest_pattern, "DEPOSIT") == "DEPOSIT" and one(spark, repair.suggest_pattern, "") == ""
    assert one(spark, lambda x: repair.rewrite_reason(x, ["no payee"], F.lit("matched")), "No payee found; low sum; matched") == "low sum; matched"
    assert one(spark, repair.slug, " Blue Sky, Inc. ") == "blue-sky-inc"
    assert one(spark, lambda x: repair.expand_grade(x, {"A": "accept"}), "a") == "accept"


CROP = "page int, ord long, hash string, x int, y int, width int, height int, variance double"


def test_suppression(spark):
    made = [(1, 1, "a", 0, 0, 400, 200, 9.0), (1, 2, "a", 500, 500, 400, 200, 99.0), (1, 3, "b", 10, 10, 400, 200, 50.0), (1, 4, "c", 900, 0, 400, 200, 1.0), (2, 5, "d", 0, 0, 400, 200, 1.0)]
    assert sorted(r["ord"] for r in crops.suppress(spark.createDataFrame(made, CROP)).collect()) == [3, 4, 5]


def test_cache_and_preference(spark):
    c = spark.createDataFrame([("a", 1, 1), ("b", 1, 2), ("c", 9, 9)], "crop_id string, page int, row_number int")
    k = spark.createDataFrame([("a", 7, 7, "by id"), ("z", 1, 2, "by slot")], "crop_id string, page int, row_number int, text string")
    assert {r["crop_id"]: r["text"] for r in crops.from_cache(c, k).collect()} == {"a": "by id", "b": "by slot", "c": None}
    r = spark.createDataFrame([("hybrid: x", "New", "", "Old", "1"), ("", "New", "2", "Old", "1")], "notes string, enriched_payee string, enriched_check_no string, payee string, check_no string")
    assert [(x["payee"], x["check_no"]) for x in crops.prefer_enriched(r).collect()] == [("New", "1"), ("Old", "1")]


def test_summaries(spark):
    assert one(spark, crops.cost, "1-3,5") == 0.04
    c = spark.createDataFrame([(1, "check", "Blue", "", 3), (1, "deposit_slip", "", "", 1), (2, "check", "Blue", "g", 2)], "page int, class string, payee string, grade string, ord int")
    assert [tuple(r) for r in crops.classes_by_page(c, ["check", "deposit_slip"]).orderBy("page").collect()] == [(1, 1, 1), (2, 1, 0)]
    assert crops.ungraded(c, page=1).count() == 2 and [r["payee"] for r in crops.payee_samples(c, 5).collect()] == ["Blue"]
    lines = spark.createDataFrame([("c", i, t) for i, t in enumerate(["a", "b", "c", "hit", "d"])], "crop_id string, idx int, text string")
    assert crops.snippets(lines, "hit", 1).first()["snippet"] == "b | c | hit | d"
