"""Parsers on statements that are cut in pieces: against plain walks through whole statements, and against no cut."""

import random
from datetime import date
from itertools import groupby
from operator import itemgetter

import pytest
from pyspark.sql import functions as F

from tallyforge.operators import lines, pieces
from tallyforge.operators.pieces import PIECE, Ordered


@pytest.fixture(params=[False, True], ids=["whole", "cut"])
def cut(request, monkeypatch):
    if request.param:
        monkeypatch.setattr(pieces, "LARGE", 10)
        monkeypatch.setattr(pieces, "PIECES", 8)
    return request.param


def ordered(spark, rows, kind):
    out = Ordered.of(spark.createDataFrame(rows, kind), ["statement_id"], "line_no")
    return out


def test_prefixes(spark, cut):
    rng = random.Random(3)
    rows = [(s, n, rng.choice([None, None, None, "a", "b"]), rng.random() < 0.3) for s, size in (("x", 90), ("y", 7), (None, 40), ("z", 11)) for n in rng.sample(range(10**6), size)]
    out = ordered(spark, rows, "statement_id string, line_no int, v string, t boolean")
    assert out.cut == cut and (out.rows.select(PIECE).distinct().count() > 3) == cut
    out = out.carried(last={"here": F.col("v")}, last_before={"before": F.struct("v")}, count={"n": F.col("t")}, count_before={"m": F.lit(True)}).followed({"next": F.col("v"), "after": F.col("line_no")})
    expected = []
    for s in ("x", "y", None, "z"):
        mine, here, n = sorted(r for r in rows if r[0] == s), None, 0
        for i, (_, no, v, t) in enumerate(sorted(mine, key=itemgetter(1))):
            mine = sorted(mine, key=itemgetter(1))
            here, n = v or here, n + t
            expected.append((s, no, here, mine[i - 1][2] if i else None, n, i, *((mine[i + 1][2], mine[i + 1][1]) if i + 1 < len(mine) else (None, None))))
    found = [(r["statement_id"], r["line_no"], r["here"], r["before"]["v"] if r["before"] else None, r["n"], r["m"], r["next"], r["after"]) for r in out.rows.collect()]
    assert sorted(found, key=str) == sorted(expected, key=str)


def plain_gather(events):
    """One walk through each statement, with its date, section and waiting lines as state."""
    out = []
    for s, group in groupby(sorted(events, key=lambda e: (str(e[0]), e[1])), key=itemgetter(0)):
        day = section = None
        waiting, hinted = [], False

        def end():
            text = " ".join(waiting).strip()
            if text and (hinted or day or section):
                out.append((s, day, text, None, None, section))  # noqa: B023

        for _, _, event, now, own, body, amount, number, named, kept in group:
            if event != "line" or own:
                end()
                waiting, hinted = [], False
            section = now
            if event in ("cells", "register"):
                out.append((s, own or (day if event == "register" else None), body, amount, number, section))
            day = own or day
            if event == "line" and amount is None and (kept or section):
                waiting.append(body)
                hinted = hinted or named
            elif event == "line" and amount is not None:
                if named or hinted or day or section:
                    out.append((s, day, " ".join([*waiting, body]).strip(), amount, None, section))
                waiting, hinted = [], False
        end()
    return out


@pytest.mark.parametrize("seed", range(3))
def test_gathering_equals_a_plain_walk(spark, cut, seed):
    rng = random.Random(seed)
    events = []
    for s, size in (("x", 150), ("y", 9), ("z", 60)):
        section = None
        for n in range(size):
            event = rng.choice(["heading", "cells", "register", *["line"] * 9])
            if event == "heading":
                section = rng.choice([None, "credit", "debit", "check"])
            own = date(2026, 1, rng.randint(1, 28)) if event != "heading" and rng.random() < 0.2 else None
            amount = float(rng.randint(1, 99)) if event != "heading" and rng.random() < 0.3 else None
            events.append((s, n * 3, event, section, own, None if event == "heading" else rng.choice(["", "a", "b c", "d"]) + str(n % 5), amount, "7" if event == "register" else None, rng.random() < 0.2, rng.random() < 0.5))
    kind = "statement_id string, line_no int, event string, section string, date date, body string, amount double, check_no string, named boolean, kept boolean"
    found = lines._in_place(lines._gathered(ordered(spark, events, kind))).orderBy("statement_id", "ord").collect()
    assert [(r["statement_id"], r["date"], r["description"], r["amount"], r["check_no"], r["section"]) for r in found] == plain_gather(events)
    for _, group in groupby(found, key=itemgetter("statement_id")):
        assert [r["ord"] for r in group] == list(range(1, sum(r["statement_id"] == _ for r in found) + 1))


def plain_strict(events):
    """One walk through each statement: the row that is open, and the last one with the lines it took."""
    out = []
    for s, group in groupby(sorted(events, key=lambda e: (str(e[0]), e[1])), key=itemgetter(0)):
        opened = last = before = None
        for _, no, event, section, day, body, amount, junk in group:
            if event in ("heading", "checks"):
                opened = None
                if event == "checks" or section != before:
                    last = None
                before = section
                continue
            if event == "dated":
                opened = [s, no, day, body, amount, section] if day else None
            elif amount is not None:
                if opened is None or opened[4] is not None:
                    continue
                opened[4] = amount
                opened[3] = opened[3] if junk or not body else f"{opened[3]} {body}".strip()
            elif junk:
                continue
            elif opened is not None:
                longer = f"{opened[3]} {body}".strip()
                opened[3] = longer if len(longer) <= lines.LONGEST else opened[3]
            else:
                if last is not None and last[6] < lines.CONTINUATIONS:
                    longer = lines._tidy(f"{last[3]} {body}".strip())
                    if len(longer) <= lines.LONGEST:
                        last[3], last[6] = longer, last[6] + 1
                continue
            if opened is not None and opened[4] is not None and lines._meaning(lines._tidy(opened[3])):
                opened[3] = lines._tidy(opened[3])
                last = [*opened, 0]
                out.append(last)
                opened = None
    return sorted(tuple(r[:6]) for r in out)


@pytest.mark.parametrize("seed", range(3))
def test_strict_reading_equals_a_plain_walk(spark, cut, seed):
    rng = random.Random(seed)
    events = []
    for s, size in (("x", 200), ("y", 9), ("z", 60)):
        section = None
        for n in range(size):
            event = rng.choice(["heading", "checks", *["dated"] * 4, *["line"] * 12])
            if event == "heading":
                section = rng.choice([None, "credit", "credit", "debit"])
            day = date(2026, 1, rng.randint(1, 28)) if event == "dated" and rng.random() < 0.8 else None
            amount = float(rng.randint(1, 99)) if event in ("dated", "line") and rng.random() < 0.3 else None
            body = rng.choice(["", "a", "store front", "9 9", "x" * 70, "EFTIACH pay 12.00"])
            events.append((s, n, event, "check" if event == "checks" else section, day, body, amount, rng.random() < 0.2))
    kind = "statement_id string, line_no int, event string, section string, date date, body string, amount double, junk boolean"
    found = lines._strict(ordered(spark, events, kind)).rows.select("statement_id", "line_no", "date", "description", "amount", "section").collect()
    assert sorted(map(tuple, found)) == plain_strict(events)


def statement(rng, size):
    kinds = [
        lambda: rng.choice(["DEPOSITS", "Other debits", "Checks paid", "ELECTRONIC DEBITS", "Page 1 of 3", "", "   "]), lambda: f"0{rng.randint(1, 9)}/1{rng.randint(0, 9)}/2026", lambda: f"Ach withdrawal {rng.randint(10, 99)}.25",
        lambda: f"0{rng.randint(1, 9)}/05 {rng.randint(10, 99)}.75", lambda: "2488", lambda: f"01/0{rng.randint(1, 9)}/2026 Paypal payment {rng.randint(10, 99)}.00", lambda: "STORE FRONT", lambda: "Debit Card",
        lambda: f"{rng.randint(100, 999)} 01/05 {rng.randint(10, 99)}.00", lambda: "01/05 2419 12.00 01/06 2420 13.00", lambda: "01/05/2026 | Harbor Cafe deposit | 12.00",
    ]
    return [rng.choice(kinds)() for _ in range(size)]


@pytest.mark.parametrize("parse", [lines.parse_lines, lines.parse_scan, lambda x, _: lines.fuse_split_dates(x), lambda x, _: lines.splice_orphan_numbers(x), lambda x, _: lines.until_terminator(x)])
def test_any_cut_gives_the_same_rows(spark, monkeypatch, parse):
    rng = random.Random(11)
    rows = [(s, n, t) for s, size in (("x", 300), ("y", 5), ("z", 80)) for n, t in enumerate(statement(rng, size))]
    text = spark.createDataFrame(rows, "statement_id string, line_no int, text string")
    key = lambda df: sorted(map(str, df.collect()))
    whole = key(parse(text, F.lit(2026)))
    assert len(whole) > 50
    for large, many in ((10, 8), (100, 4)):
        monkeypatch.setattr(pieces, "LARGE", large)
        monkeypatch.setattr(pieces, "PIECES", many)
        assert key(parse(text, F.lit(2026))) == whole
