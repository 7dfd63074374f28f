"""Choices in rounds against walks in order, on statements where many want the same; and the fuzzy filter against all pairs."""

import random
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import alike, assembly, matching, rounds

LEG = "statement_id string, ord long, check_no string, amount double, description string, payee string, source string"
NAMES = ["Blue Sky Books", "Blue Sky Bank", "blue sky", "Harbor Cafe", "Harbour Cafe Ltd", "Corner", "corner market", "x", ""]


def legs(rng, n, ords):
    number = lambda: rng.choice(["", "", *map(str, range(1, 6))])
    return [(rng.choice("st"), rng.choice(ords) if ords else i * 3, number(), rng.choice([None, -1.0, -1.01, -1.02, -1.03, -5.0, -9.0, 0.0]), rng.choice(NAMES), rng.choice(["", *NAMES]), "register") for i in range(n)]


@pytest.fixture(params=range(4))
def both(request, spark):
    rng = random.Random(request.param)
    register, crops = legs(rng, 70, None), legs(rng, 60, None)
    return spark.createDataFrame(register, LEG), spark.createDataFrame(crops, LEG)


def same(walk, module, monkeypatch, pick):
    plain = sorted(map(str, pick(walk().collect())))
    monkeypatch.setattr(module, "LARGE", 1)
    assert sorted(map(str, pick(walk().collect()))) == plain and plain
    return plain


def test_matching(both, monkeypatch):
    tiers = same(lambda: matching.match_checks(*both), matching, monkeypatch, lambda rows: [(r["statement_id"], r["crop_ord"], r["ord"], r["tier"], r["alike"] and round(r["alike"], 9)) for r in rows])
    assert any("'name'" in t for t in tiers) and any("'amount'" in t for t in tiers)


def test_supplemental(both, monkeypatch):
    same(lambda: assembly.supplemental(*both), assembly, monkeypatch, lambda rows: [(r["statement_id"], r["ord"], r["decision"], r["register_ord"]) for r in rows])


def test_payees(both, monkeypatch):
    checks = both[1].withColumn("pay_to", F.col("payee"))
    same(lambda: assembly.merge_payees(both[0], checks), assembly, monkeypatch, lambda rows: [(r["statement_id"], r["ord"], r["payee"], r["source"]) for r in rows])


def test_some_large_and_some_small(both, monkeypatch):
    plain = sorted(map(str, matching.match_checks(*both).collect()))
    sizes = both[0].union(both[1]).groupBy("statement_id").count().collect()
    monkeypatch.setattr(matching, "LARGE", max(r["count"] for r in sizes))
    assert sorted(map(str, matching.match_checks(*both).collect())) == plain


def test_one_list_takes_few_rounds(spark):
    """Two thousand seekers of one list and as many slots; an outsider with the first slot moves them all on at once."""
    seekers = spark.createDataFrame([("s", 5 * i + 1, ["a"]) for i in range(2000)] + [("s", 0, ["b"]), ("s", 5003, ["b"])], "statement_id string, turn long, keys array<string>")
    lists = spark.createDataFrame([("s", "a", i, i) for i in range(1990)] + [("s", "b", 0, 0), ("s", "b", 700, 1)], "statement_id string, key string, slot long, preference long")
    choice = rounds.in_turn(seekers, lists)
    taken, expected = set(), {}
    for turn in sorted([(5 * i + 1, range(1990)) for i in range(2000)] + [(0, (0, 700)), (5003, (0, 700))]):
        slot = next((s for s in turn[1] if s not in taken), None)
        if slot is not None:
            expected[turn[0]] = slot
            taken.add(slot)
    assert {r["turn"]: r["slot"] for r in choice.chosen.collect()} == expected and choice.rounds <= 6


def test_nobody_and_nothing(spark):
    none = spark.createDataFrame([], "statement_id string, turn long, keys array<string>")
    lists = spark.createDataFrame([], "statement_id string, key string, slot long, preference long")
    assert rounds.in_turn(none, lists).chosen.count() == 0
    some = spark.createDataFrame([("s", 1, ["a", "b"]), ("s", 2, [])], none.schema)
    assert rounds.in_turn(some, lists).chosen.count() == 0


@pytest.mark.parametrize("block", [7, 20_000])
def test_alike_equals_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(alike, "BLOCK", block)
    monkeypatch.setattr(alike, "PAIRS", 50)
    rng = random.Random(2)
    text = lambda: "".join(rng.choices("abcdé 😀X", k=rng.randint(0, 14)))
    ours, theirs = [(rng.choice("st"), text()) for _ in range(60)], [(rng.choice("stu"), text()) for _ in range(150)] + [("s", None), (None, "abc")]
    found = alike.alike(spark.createDataFrame(ours, "statement_id string, text string"), spark.createDataFrame(theirs, "statement_id string, text string"), 0.6)
    clean = lambda t: (t or "").lower().strip(" ")
    expected = {(s, a, b, round(SequenceMatcher(None, clean(a), clean(b)).ratio(), 9)) for s, a in ours for t, b in theirs if s == t and clean(a) and clean(b) and SequenceMatcher(None, clean(a), clean(b)).ratio() >= 0.6}
    assert {(r["statement_id"], r["ours"], r["theirs"], round(r["ratio"], 9)) for r in found.collect()} == expected and len(expected) > 20


def test_the_filter_leaves_few_pairs():
    """Of random names most pairs are ruled out by counts alone."""
    rng = random.Random(6)
    names = ["".join(rng.choices("etaoinshrdlucmfwypvbgkjqxz", weights=range(26, 0, -1), k=rng.randint(5, 25))) for _ in range(400)]
    counts = alike.counts(names)
    assert alike.possible(counts[:200], counts[200:], 0.6).mean() < 0.5
