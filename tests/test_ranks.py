"""Values at ranks against sorting, whole and cut, with hot values."""

import random
import statistics

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import assembly, pieces, ranks


@pytest.mark.parametrize("cut", [False, True])
def test_ranks_and_medians(spark, monkeypatch, cut):
    if cut:
        monkeypatch.setattr(pieces, "LARGE", 5)
        monkeypatch.setattr(pieces, "PIECES", 4)
    rng = random.Random(1)
    rows = [(s, rng.choice([None, 1.0, 1.0, 2.5, float(rng.randint(3, 400))])) for s, n in (("a", 300), ("b", 1), ("c", 6), (None, 40)) for _ in range(n)] + [("d", None)]
    df = spark.createDataFrame(rows, "statement_id string, v double")
    values = {s: sorted(v for k, v in rows if k == s and v is not None) for s in ("a", "b", "c", None)}
    found = {r["statement_id"]: r for r in ranks.at_ranks(df, ["statement_id"], F.col("v"), lambda n: {"first": F.lit(1), "last": n, "third": F.lit(3), "beyond": n + 1}).collect()}
    assert set(found) == {s for s, v in values.items() if v}
    for s, r in found.items():
        v = values[s]
        assert (r["n"], r["first"], r["last"], r["third"], r["beyond"]) == (len(v), v[0], v[-1], v[2] if len(v) > 2 else None, None)
    assert {r["statement_id"]: r["m"] for r in ranks.medians(df, ["statement_id"], F.col("v"), "m").collect()} == {s: statistics.median(v) for s, v in values.items() if v}


def test_outliers_by_exclusive_quartiles(spark, monkeypatch):
    monkeypatch.setattr(pieces, "LARGE", 20)
    rng = random.Random(3)
    rows = [(s, i, rng.choice(["", "", "7"]), rng.choice([None, 0.0, -rng.uniform(1, 300), -rng.uniform(1, 300), -9000.0, -20_000.0])) for s, n in (("a", 200), ("b", 5), ("c", 2)) for i in range(n)]
    df = spark.createDataFrame(rows, "statement_id string, ord int, check_no string, amount double")
    expected = set()
    for s in "abc":
        mine = [r for r in rows if r[0] == s and r[3] and abs(r[3]) <= assembly.CHECK_CAP]
        sizes, fence = [abs(r[3]) for r in mine], None
        if len(sizes) >= 4:
            low, _, high = statistics.quantiles(sizes, n=4)
            fence = high + max(3 * (high - low), assembly.LEAST_FENCE)
        expected |= {(r[0], r[1]) for r in mine if fence is None or abs(r[3]) <= fence or r[2]}
    assert {(r["statement_id"], r["ord"]) for r in assembly.drop_outliers(df).collect()} == expected
