"""The anchor index against loops over all patterns, and rule tables against compiled rules."""

import random

import pytest

from tallyforge.operators import anchors, rules


def words(rng, n):
    return " ".join("".join(rng.choices("abcé", k=rng.randint(1, 4))) for _ in range(n))


@pytest.mark.parametrize("broadcast", [True, False])
def test_contained_equals_the_loop(spark, monkeypatch, broadcast):
    rng = random.Random(1)
    texts = [words(rng, rng.randint(0, 6)).upper() if i % 3 else words(rng, 4) for i in range(200)] + ["", None, "x\ny", "😀ab"] * 2
    patterns = ["".join(rng.choices("abcdÉ ", k=rng.randint(0, 6))) for _ in range(300)] + ["", None, "\n", "😀A", "zzz", "x\nY"]
    if not broadcast:
        monkeypatch.setattr(anchors, "BROADCAST_ROWS", 0)
    found = anchors.contained(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame([(p,) for p in patterns], "pattern string"))
    pairs = [(r["text"], r["pattern"]) for r in found.collect()]
    assert len(pairs) == len(set(pairs))
    assert set(pairs) == {(t, p) for t in texts for p in patterns if t is not None and p is not None and p.lower() in t.lower()}
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan


def test_no_patterns_and_no_texts(spark):
    some, none = spark.createDataFrame([("a",)], "text string"), spark.createDataFrame([], "pattern string")
    assert anchors.occurrences(some, none).count() == 0
    assert anchors.occurrences(some.limit(0), none.union(some)).count() == 0


def test_expressions_in_passes(spark, monkeypatch):
    monkeypatch.setattr(anchors, "EXPRESSIONS", 2)
    texts = spark.createDataFrame([("One 12",), ("two",), ("re:x",)], "text string")
    patterns = spark.createDataFrame([("re:^o",), (r"re:\d{2}",), ("re:(",), ("re:o$",), ("two",), ("re:(?P<n>t)w",)], "pattern string")
    found = {tuple(r) for r in anchors.occurrences(texts, patterns).collect()}
    assert found == {("One 12", "re:^o"), ("One 12", r"re:\d{2}"), ("two", "re:o$"), ("two", "two"), ("two", "re:(?P<n>t)w")}


@pytest.mark.parametrize("client", ["", "Acme"])
def test_rule_table_equals_compiled_rules(spark, client):
    rng = random.Random(4)
    kinds = lambda: rng.choice(["", " ", "Food", "Uncategorized", "Rent"])
    known = [rules.Rule(("re:" if rng.random() < 0.1 else "") + "".join(rng.choices("abc", k=rng.randint(1, 4))), rng.choice(["", "Ab", "ab ca", "C"]), kinds(), rng.choice(["", "", "acme", " ACME ", "other"]), i) for i in range(80)]
    rows = [(i, words(rng, 3) if i % 9 else rng.choice([None, "", "ab ca"]), rng.choice(["", None, "ab ca", "Kept"]), rng.choice(["", "Uncategorized", "Kept", None])) for i in range(200)]
    ledger = spark.createDataFrame(rows, "ord int, description string, payee string, category string")
    table = spark.createDataFrame([(r.pattern, r.clean_payee, r.suggested_category, r.client_override, r.ord) for r in known], "pattern string, clean_payee string, suggested_category string, client_override string, ord int")
    key = lambda df: sorted(map(tuple, df.select("ord", "description", "payee", "category", "matched").collect()), key=lambda r: r[0])
    compiled = key(rules.apply_rules(ledger, known, client))
    assert key(rules.apply_rule_table(ledger, table, client)) == compiled
    assert {r["pattern"] for r in rules.fired_table(ledger, table, client).collect()} == {r["pattern"] for r in rules.fired(ledger, known, client)[0].collect()}


def test_post_process_with_many_rules(spark, monkeypatch):
    monkeypatch.setattr(rules, "COMPILED", 2)
    table = spark.createDataFrame([("shop", "The Shop", 1), ("corner shop", "Corner", 2), ("bank", "Bank", 3)], "pattern string, clean_payee string, ord int")
    ledger = spark.createDataFrame([(1, "CORNER SHOP 1", "", ""), (2, "other", "", "")], "ord int, description string, payee string, category string")
    out, used = rules.post_process(ledger, table.withColumn("last_used", table["pattern"].substr(0, 0)), table, day="2026-06-15")
    assert {r["ord"]: r["payee"] for r in out.collect()} == {1: "Corner", 2: ""}
    assert {r["pattern"] for r in used.filter("last_used = '2026-06-15'").collect()} == {"shop", "corner shop"}
